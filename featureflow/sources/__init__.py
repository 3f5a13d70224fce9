"""Sources and sinks."""

from .factory import LoaderFactory, register_loader
from .loaders import CSVLoader, JSONLoader, ORCLoader, ParquetLoader
from .multifile import open_parquet_files, scan_parquet_files
from .predicates import dnf_predicate
from .sinks import CSVSink, JSONSink, ParquetSink, write_csv, write_json, write_parquet

__all__ = [
    "CSVLoader", "CSVSink", "JSONLoader", "JSONSink", "LoaderFactory", "ORCLoader", "ParquetLoader", "ParquetSink", "dnf_predicate",
    "open_parquet_files", "register_loader", "scan_parquet_files", "write_csv", "write_json", "write_parquet",
]
