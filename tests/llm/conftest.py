import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, with an extra column of a clashing name."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "digest", "node", "shard", "finish", "held_out"):
                df = df.withColumn(name, F.lit("mine"))
        return df

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
