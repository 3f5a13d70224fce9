import re
from collections import Counter

from helpers import SMALL
from pyspark.sql import functions as F
from test_dedup import brute_classes

import corpus_pipeline
from featureflow.llm.bpe import ByteBPE, vocabulary_path
from featureflow.llm.common import read, stored
from featureflow.llm.mixing import fair_queue
from featureflow.llm.quality import score_quality


def test_stages_against_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())
    good = {r.doc_id for r in score_quality(read(spark, SMALL, "documents"), read(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept["quality"][1]} == good
    before, after = kept["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(first.values()) == sorted(r.doc_id for r in after)
    before, after = kept["near_dedup"]
    classes = brute_classes([(r.doc_id, r.text) for r in before])
    assert sorted({c for c, _ in classes.values()}) == sorted(r.doc_id for r in after)
    before, after = kept["mixing"]
    plan = {r.doc_id: sum(2 * w >= r.size for w in r.pass_words if w > 0) for r in fair_queue(spark.createDataFrame(before, docs.schema)).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in plan.items() if n})
    bpe = ByteBPE(vocabulary_path())
    last = corpus_pipeline.STAGES[4][1](spark, docs, SMALL)
    sizes = dict(zip([r.doc_id for r in after], map(len, bpe.encode([r.text for r in after]))))
    assert all(r.n_tokens == sizes[r.doc_id] for r in last.collect()) and last.count() == len(after)


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, make_docs):
    rows = [(1, "same text of five words"), (1, "same text of five words"), (None, "no id at all"), (3, None), (4, ""), (5, "same  text of five words")]
    for table in (make_docs(rows), make_docs([])):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), name)
        assert docs.count() <= 2 * len(rows)
    kept = corpus_pipeline.exact_dedup_stage(spark, make_docs(rows), SMALL)
    assert sorted((str(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect()) == [("1", "same text of five words"), ("3", None), ("None", "no id at all")]
    assert kept.where(F.col("size") != "mine").count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark, make_docs):
    rows = [(None, "first text"), (None, "second different text"), (1, "alpha beta"), (1, "gamma delta"), (2, "solo"), (1, "alpha  beta"), (None, "first text"), (7, "one two three four five six")]
    docs = make_docs(rows)
    for name in ("w_file", "w_pos", "times", "name_0", "_metadata", "row_index", "file_path", "a.b", "taken", "kept"):
        docs = docs.withColumn(name, F.lit("mine"))
    distinct = sorted({(str(i), " ".join(t.split())) for i, t in rows})
    runs = []
    for table in (docs, docs.repartition(5)):
        for name, stage in corpus_pipeline.STAGES[1:3]:
            table = stored(stage(spark, table, SMALL), name)
            assert table.columns == docs.columns
            assert sorted((str(r.doc_id), " ".join(r.text.split())) for r in table.collect()) == distinct
        mixed = stored(corpus_pipeline.STAGES[3][1](spark, table, SMALL), "mixing")
        assert mixed.columns == docs.columns and {(str(r.doc_id), " ".join(r.text.split())) for r in mixed.collect()} <= set(distinct)
        runs.append(Counter((r.doc_id, r.text.replace("  ", " ")) for r in mixed.collect()))
    assert max(runs[0].values()) <= 2
