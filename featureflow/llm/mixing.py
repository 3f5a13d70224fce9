"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a shuffled order, passed twice at most. A document
that ends after ``c`` words of its queue has the virtual finish time ``c / weight``. The passes
of all documents are range-sorted by finish time. Along that order runs the total of the words
that all queues were served by then: each queue in proportion to its weight until its last
document finishes, after which the others share its part. Where the running total reaches the
budget the mix is truncated; a document open at that time counts the words served.

No task holds a source: shuffled prefix sums cut a source's hash range into buckets of about
``BUCKET_ROWS`` rows, and buckets into blocks of ``BLOCK_BUCKETS``; each level is summed on its
own and shifted by what lies before it. The running total is summed by sorted range, and only
the range in which it reaches the budget is looked at row by row. Virtual times are whole
numbers in units of 1 / ``L``, a common multiple of the weights, so sums do not round.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source
of its own, the last; repeated rows are documents of their own with equal keys; ties of the
shuffle go by doc_id, then size; an empty table gives an empty result; other columns are kept
by :func:`mixed_documents`, whatever their names, and ignored by :func:`fair_queue`.
"""

from __future__ import annotations

import uuid
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, located, own_columns, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
BUCKET_ROWS = 1024
BLOCK_BUCKETS = 1024


def _shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _cycled(values: list) -> Column:
    """The value of a source's number, the values repeating."""
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("source_no") - 1) % len(values) + 1).cast("int"))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Per source: source, source_no, rows, source_size, weight, target, cut (virtual time).

    Works on one row per source. The cut is the time V at which sum(min(cap, weight * V)) is
    the budget: with sources in the order in which they run dry, the first whose own end lies
    behind the time that the rest of the budget gives to the sources still open.
    """
    stats = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    stats = stats.withColumn("source_no", F.row_number().over(ordered))
    stats = stats.withColumn("weight", _cycled([float(w) for w in weights]))
    stats = stats.withColumn("cap", (F.col("source_size") * passes).cast("double"))
    dry = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stats = stats.withColumn("ends", F.col("cap") / F.col("weight"))
    stats = stats.withColumn("served", F.sum("cap").over(dry.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
    stats = stats.withColumn("open_weight", F.sum("weight").over(dry.rowsBetween(W.currentRow, W.unboundedFollowing)))
    stats = stats.withColumn("budget", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
    stats = stats.withColumn("level", (F.col("budget") - F.col("served")) / F.col("open_weight"))
    found = F.min(F.when(F.col("level") <= F.col("ends"), F.struct("ends", "source_no", "level"))).over(everything)
    stats = stats.withColumn("cut", F.coalesce(found["level"], F.max("ends").over(everything)))
    return stats.select(
        "source", "source_no", "rows", "source_size", "weight", F.least("cap", F.col("weight") * F.col("cut")).alias("target"), "cut"
    )


def _units(weights, share: float) -> tuple[list[int], int, Fraction]:
    """Whole weights in the given proportion, a common multiple L of them, and the share."""
    exact = [Fraction(w).limit_denominator(10**6) for w in weights]
    whole = [int(w * lcm(*(x.denominator for x in exact))) for w in exact]
    part = Fraction(share).limit_denominator(10**6)
    return whole, lcm(*whole, part.denominator), part


def _ends(rows: DataFrame, seed: str) -> DataFrame:
    """Adds ``end``, the words of a row's queue up to and with the row."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS))
    rows = rows.withColumn("shuffle", _shuffle_key(F.col("doc_id"), seed))
    spot = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(spot * buckets / F.lit(2**32)).cast("long"))
    upto = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS))
    blocks = sums.groupBy(F.col("source_no").alias("k_source"), F.col("block").alias("k_block")).agg(F.sum("words").alias("words"))
    blocks = blocks.select("k_source", "k_block", (F.sum("words").over(upto("k_source").orderBy("k_block")) - F.col("words")).alias("k_shift"))
    sums = sums.withColumn("shift", F.sum("words").over(upto("source_no", "block").orderBy("bucket")) - F.col("words"))
    sums = sums.join(blocks, (F.col("source_no") == F.col("k_source")) & (F.col("block") == F.col("k_block")))
    sums = sums.select(F.col("source_no").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.col("shift") + F.col("k_shift")).alias("b_shift"))
    rows = rows.withColumn("within", F.sum("size").over(upto("source_no", "bucket").orderBy("shuffle", "doc_id", "size")))
    # Merged: the buckets grow with the rows, which are dealt by bucket already.
    rows = rows.join(sums.hint("merge"), (F.col("source_no") == F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return rows.withColumn("end", F.col("b_shift") + F.col("within")).drop("b_source", "b_bucket", "b_shift", "bucket", "shuffle", "within")


def queue(rows: DataFrame, passes: int, unit: int) -> DataFrame:
    """The passes of all rows that hold words, range-sorted by ``finish``; ``cell`` numbers the ranges.

    ``closes`` is the weight of a source on its last pass of its last row, and 0 elsewhere.
    """
    items = rows.where("size > 0").select("whole", "source_no", "source_size", "end", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("k"))
    words = F.col("end") + F.col("k") * F.col("source_size")
    last = words == F.col("source_size") * passes
    items = items.select((words * F.floor(F.lit(unit) / F.col("whole"))).alias("finish"), "source_no", F.when(last, F.col("whole")).otherwise(0).alias("closes"))
    return items.repartitionByRange("finish").sortWithinPartitions("finish", "source_no").withColumn("cell", F.spark_partition_id())


def cut_time(items: DataFrame, open_weight: int, budget: int) -> Fraction | None:
    """The virtual time at which the running total along ``items`` meets ``budget`` (words times L); None: never.

    Up to the finish time f of an item, sources that closed before it were served all they have,
    which is their weight times their last finish time, and the others f times their weight.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    goal = wide(F.lit(str(budget)))
    closed = wide(F.col("closes")) * wide(F.col("finish"))
    served = lambda gone, had: wide(F.lit(open_weight) - gone) * wide(F.col("finish")) + wide(had)
    # One row per range; what closes inside a range is closed at its end.
    cells = items.groupBy("cell").agg(F.max("finish").alias("finish"), F.sum("closes").alias("gone"), F.sum(closed).alias("had"))
    upto = W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cells.select("cell", "finish", F.sum("gone").over(upto).alias("gone"), F.sum("had").over(upto).alias("had"))
    cell = sums.where(served(F.col("gone"), F.col("had")) >= goal).agg(F.min("cell")).first()[0]
    if cell is None:
        return None
    ahead = cells.where(F.col("cell") < cell).agg(F.sum("gone"), F.sum("had")).first()
    gone_ahead, had_ahead = int(ahead[0] or 0), int(ahead[1] or 0)
    earlier = W.orderBy("finish", "source_no").rowsBetween(W.unboundedPreceding, -1)
    inside = items.where(F.col("cell") == cell).select(
        "finish",
        "source_no",
        (F.coalesce(F.sum("closes").over(earlier), F.lit(0)) + F.lit(gone_ahead)).alias("gone"),
        (F.coalesce(F.sum(closed).over(earlier), wide(F.lit(0))) + wide(F.lit(str(had_ahead)))).alias("had"),
    )
    met = inside.where(served(F.col("gone"), F.col("had")) >= goal).agg(F.min(F.struct("finish", "source_no", "gone", "had")).alias("m")).first()["m"]
    return Fraction(budget - int(met["had"]), open_weight - int(met["gone"]))


def fair_queue(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix", names: list[Column] | None = None) -> DataFrame:
    """One row per document in the order of the mix (global range sort by finish time).

    doc_id, source, size, source_size, target, taken, finish (virtual finish time of its first
    pass), pass_words (array: words served in each pass); ``names`` (columns that name a row)
    are carried as name_0, name_1 ...
    """
    carried = [n.alias(f"name_{i}") for i, n in enumerate(names or [])]
    rows = stored(docs.select("doc_id", "source", word_count("text").alias("size"), *carried), "mix-rows")
    whole, unit, part = _units(weights, share)
    targets = source_targets(rows, weights, share, passes).withColumnRenamed("source", "queue").withColumn("whole", _cycled(whole).cast("long"))
    targets = stored(targets, "mix-targets")  # one row per source
    placed = _ends(rows.join(targets, F.col("source").eqNullSafe(F.col("queue")), "left").drop("queue"), seed)
    placed = stored(placed, "mix-placed")
    items = stored(queue(placed, passes, unit), "mix-queue")
    known = targets.where("source_size > 0").agg(F.sum("whole"), F.sum("source_size")).first()
    cut = cut_time(items, int(known[0] or 0), int(part * unit * int(known[1] or 0)))
    served = F.col("source_size") * passes
    if cut is not None:
        for w in sorted(set(whole)):
            served = F.when(F.col("whole") == w, F.lit(int(cut * w / unit)).cast("long")).otherwise(served)
    end = F.col("end")
    words = [F.greatest(F.lit(0), F.least(F.col("size"), served - (end - F.col("size") + F.col("source_size") * k))).cast("long") for k in range(passes)]
    out = placed.withColumn("finish", end / F.col("weight")).withColumn("pass_words", F.array(*words))
    out = out.withColumn("taken", sum(words[1:], words[0]))
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "finish", "pass_words", *[f"name_{i}" for i in range(len(carried))])
    discard(rows, items)
    return out.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, once for each pass that takes them.

    A document open at the cut is taken if at least half its words were served. Rows are found
    by their place in the input, so rows that share a doc_id are taken each on its own.
    """
    docs, names = located(docs)
    plan = fair_queue(docs, names=names, **how)
    times = F.size(F.filter("pass_words", lambda w: (w > 0) & (w * 2 >= F.col("size"))))
    times = stored(plan.select("name_0", "name_1", times.alias("times")).where("times > 0"), "mix-times")
    again = f"pass_{uuid.uuid4().hex}"
    # Merged at every size: the plan grows with the documents, so a broadcast that happens to fit is no plan.
    taken = docs.join(times.hint("merge"), (names[0] == times["name_0"]) & (names[1] == times["name_1"]))
    return taken.select(*own_columns(docs), F.explode(F.sequence(F.lit(1), times["times"])).alias(again)).drop(again)
