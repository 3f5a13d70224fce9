"""Sources by file extension; any registered step class can be one."""

from __future__ import annotations

import logging
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from ..plans.step import BasePipelineStep

logger = logging.getLogger(__name__)

_LOADERS: dict[str, type[BasePipelineStep]] = {}


def register_loader(extension: str):
    """Class decorator; a later registration of the extension wins, with a warning."""

    def register(cls: type) -> type:
        if not (isinstance(cls, type) and issubclass(cls, BasePipelineStep)):
            raise TypeError(f"a loader must be a BasePipelineStep subclass, not {cls!r}")
        key = extension.lower()
        if key in _LOADERS:
            logger.warning("loader for %s replaced: %s -> %s", key, _LOADERS[key].__name__, cls.__name__)
        _LOADERS[key] = cls
        return cls

    return register


def path_exists(path: str) -> bool:
    """Through Hadoop's file system API, so hdfs://, s3a:// and globs are seen too."""
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


class LoaderFactory:
    @staticmethod
    def create(path, **options) -> BasePipelineStep:
        """FileNotFoundError first, then ValueError for an extension nobody registered."""
        if not path_exists(str(path)):
            raise FileNotFoundError(f"no such input: {path}")
        extension = PurePosixPath(str(path)).suffix.lower()
        if extension not in _LOADERS:
            raise ValueError(f"unsupported extension {extension!r}; supported: {', '.join(LoaderFactory.supported_extensions())}")
        return _LOADERS[extension](path, **options)

    @staticmethod
    def supported_extensions() -> list[str]:
        return sorted(_LOADERS)

    @staticmethod
    def registry() -> dict[str, str]:
        return {k: v.__name__ for k, v in _LOADERS.items()}
