"""K-d tree sharding by bytes (DataFrame functions only).

Rows with equal texts form one item, so that copies meet in one shard; only an item of more bytes
than a whole shard is dealt row by row. Items have three metadata dimensions: size, source and
first doc_id. A tree node that must yield ``k`` shards is cut at the weighted (byte) quantile that
its left half's shards have room for, along the dimension in which its items spread widest, until
every node yields one shard.

An item that fills a good part of a shard cannot be balanced by a cut, which falls on either side
of it. Items above 1 / ``HEAVY`` of a shard (HEAVY times the shards at most, as their bytes add up
to all) are therefore laid out first, largest first, each into the emptiest shard, and the tree
fills the room that is left.

Weighted quantiles are found by radix descent: every item has a 62-bit key in each dimension (the
value, then a hash that splits ties). One pass counts items and sums bytes by the first ``RADIX``
bits of the key, for all open nodes and all dimensions at once, with partial aggregation; it tells
the spread and the bin that holds the quantile. Only that bin is looked at again, until it weighs
``LOOSE`` of a shard or holds one item. Items are never rewritten: their node follows from the cuts, which
are constants of the plan. The driver sees one row per open node and dimension, never more than three times
the number of shards.

Law: ``bytes`` (shard sizes near equal). Defined cases: a null text has no bytes and equals the
other null texts, not the empty text; null sources and doc_ids lie before all others; repeated
rows are copies; ties in every dimension are split by hash; with fewer items than shards some
shards stay empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stored

SHARDS = 40
OVERHEAD = 16
#: Items above this part of a shard are laid out before the tree.
HEAVY = 64
#: A cut may miss its quantile by this part of a shard.
LOOSE = 1 / 1000
RADIX = 10
KEY_BITS = 62
#: Bits of the value in the key of each dimension; the others are a hash.
VALUE_BITS = {"k_size": 31, "k_source": 14, "k_id": 31}
#: Rows that one task numbers when slots are given out.
SLOT_ROWS = 8192
DIMENSIONS = tuple(VALUE_BITS)


def keyed(items: DataFrame) -> DataFrame:
    """Adds the keys to items with v_size, v_source (0 to 1), v_id and tie (a 62-bit hash)."""
    low = items.agg(*[f(c).alias(f"{n}_{c}") for c in ("v_size", "v_id") for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    for d, v in zip(DIMENSIONS, ("v_size", "v_source", "v_id")):
        lo, hi = (0.0, 1.0) if v == "v_source" else (low[f"lo_{v}"] or 0.0, low[f"hi_{v}"] or 0.0)
        bits = VALUE_BITS[d]
        scaled = F.floor((F.col(v) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float(2**bits - 1))).cast("long")
        items = items.withColumn(d, F.shiftleft(scaled, KEY_BITS - bits) + F.shiftright("tie", bits))
    return items


def laid_out(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size: in the order given, each into the emptiest shard (ties: the first)."""
    held = [(0, s) for s in range(shards)]
    out = []
    for n in sizes:
        filled, s = held[0]
        heapq.heapreplace(held, (filled + n, s))
        out.append(s)
    return out


def _of(values: dict[int, tuple], level: int, **kinds: str) -> Column:
    """The values of a row's node as a struct, NULL for nodes without them. The nodes of a level are 2^level and up."""
    none = (None,) * len(kinds)
    cells = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(values.get(n, none), kinds.items())]) for n in range(2**level, 2 ** (level + 1))]
    return F.get(F.array(*cells), (F.col("node") - 2**level).cast("int"))


def _noded(items: DataFrame, levels: list[dict[int, tuple[str, int]]]) -> DataFrame:
    """Adds ``node``: each level of cuts {node: (dimension, first key of the right child)} sends items on.

    The cuts are constants of the plan, fewer than the shards.
    """
    if not levels:
        return items.withColumn("node", F.lit(1).cast("long"))

    def cells(level: int, cuts: dict[int, tuple[str, int]]) -> Column:
        found = [cuts.get(n) for n in range(2**level, 2 ** (level + 1))]
        return F.array(*[F.struct(F.lit(c and DIMENSIONS.index(c[0])).cast("int").alias("dim"), F.lit(c and c[1]).cast("long").alias("edge")) for c in found])

    def sent(node: Column, cut: Column) -> Column:
        own = F.get(cut, (node - F.size(cut)).cast("int"))  # a level has as many places as its first node's number
        right = F.get(F.array(*DIMENSIONS), own["dim"]) >= own["edge"]
        return F.when(right.isNull(), node).otherwise(2 * node + right.cast("long"))

    return items.withColumn("node", F.aggregate(F.array(*[cells(k, c) for k, c in enumerate(levels)]), F.lit(1).cast("long"), sent))


def _running(value: str, *keys: str) -> Column:
    return F.sum(value).over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))


def kd_tree(items: DataFrame, room: list[float], loose: float = LOOSE) -> DataFrame:
    """Adds ``shard`` to items with bytes and the keys of DIMENSIONS; ``room`` has the bytes that each shard may take."""
    open_nodes, leaves, levels = {1: (0, len(room))}, {}, []  # node -> (first shard, shards); the tree is kept on the driver
    near = loose * sum(room) / len(room)
    while True:
        for n in [n for n, (_, k) in open_nodes.items() if k == 1]:
            leaves[n] = open_nodes.pop(n)[0]
        if not open_nodes:
            break
        share = {}
        for n, (first, k) in open_nodes.items():
            left, whole = sum(room[first : first + k // 2]), sum(room[first : first + k])
            share[n] = left / whole if whole > 0 else (k // 2) / k
        found = _quantiles(_noded(items, levels), len(levels), share, near)
        levels.append({n: found[n] for n in open_nodes if n in found})
        children = {}
        for n, (first, k) in open_nodes.items():
            if n in found:  # a node without items is dropped: its shards stay empty
                children[2 * n], children[2 * n + 1] = (first, k // 2), (first + k // 2, k - k // 2)
        open_nodes = children
    shard = F.create_map(*[F.lit(x) for pair in leaves.items() for x in pair])  # one entry per shard
    return _noded(items, levels).withColumn("shard", F.element_at(shard, F.col("node").cast("int"))).drop("node")


def _quantiles(items: DataFrame, level: int, share: dict[int, float], near: float) -> dict[int, tuple[str, int]]:
    """Of each node in ``share`` that has items: its widest dimension, and the first key beyond its share of bytes."""
    left = KEY_BITS - RADIX
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("key")) for i, d in enumerate(DIMENSIONS)])).alias("k")
    at = items.withColumn("share", _of({n: (x,) for n, x in share.items()}, level, share="double")["share"]).where("share is not null")
    at = at.select("node", "share", "bytes", pairs).select("node", "share", "bytes", "k.*")
    bins = at.groupBy("node", "dim", F.shiftright("key", left).alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.first("share").alias("share"))
    whole = W.partitionBy("node", "dim")
    mean = F.sum(F.col("bin") * F.col("n")).over(whole) / F.sum("n").over(whole)
    bins = bins.withColumn("mean", mean).withColumn("want", F.sum("bytes").over(whole) * F.col("share")).withColumn("run", _running("bytes", "node", "dim"))
    spread = F.sum(F.col("n") * F.pow(F.col("bin") - F.col("mean"), F.lit(2.0)))
    met = F.min(F.when(F.col("run") >= F.col("want"), F.struct("bin", "run", "bytes", "n", "want"))).alias("c")
    state: dict[int, dict] = {}
    for r in bins.groupBy("node", "dim").agg(spread.alias("spread"), met).orderBy("node", "dim").collect():
        if r["node"] not in state or r["spread"] > state[r["node"]]["spread"]:
            c = r["c"]
            state[r["node"]] = {"spread": r["spread"], "dim": r["dim"], "prefix": c["bin"], "want": c["want"] - (c["run"] - c["bytes"]), "held": c["bytes"], "n": c["n"], "left": left}
    while True:
        again = {n: o for n, o in state.items() if o["left"] > 0 and o["n"] > 1 and o["held"] > near}
        if not again:
            break
        asked = {n: (o["dim"], o["prefix"], o["left"], min(RADIX, o["left"]), float(o["want"])) for n, o in again.items()}
        inside = items.withColumn("s", _of(asked, level, dim="int", prefix="long", left="int", step="int", want="double")).where("s.dim is not null")
        inside = inside.select("node", "bytes", "s", F.get(F.array(*DIMENSIONS), F.col("s.dim")).alias("key")).where(F.expr("shiftright(key, s.left) = s.prefix"))
        bins = inside.groupBy("node", F.expr("shiftright(key, s.left - s.step)").alias("bin"))
        bins = bins.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.first("s.want").alias("want")).withColumn("run", _running("bytes", "node"))
        for r in bins.where(F.col("run") >= F.col("want")).groupBy("node").agg(F.min(F.struct("bin", "run", "bytes", "n")).alias("c")).collect():
            o, c = state[r["node"]], r["c"]
            o["want"] -= c["run"] - c["bytes"]
            o["prefix"], o["held"], o["n"], o["left"] = c["bin"], c["bytes"], c["n"], o["left"] - min(RADIX, o["left"])
    # The last bin goes to the side that leaves the smaller error.
    return {n: (DIMENSIONS[o["dim"]], (o["prefix"] + (1 if o["held"] - o["want"] <= o["want"] else 0)) << o["left"]) for n, o in state.items()}


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit(1), text).alias("b"),
        text.isNull().alias("none"),
    )
    raw = rows = stored(rows, "shard-rows")
    whole = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    # Groups larger than a shard are fewer than the shards. Their rows are items themselves, told apart by a hash.
    large = rows.groupBy("a", "b", "none").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > whole) & (F.col("n") > 1))
    large = F.broadcast(large.select(F.col("a").alias("l_a"), F.col("b").alias("l_b"), F.col("none").alias("l_none")))
    rows = rows.join(large, (F.col("a") == F.col("l_a")) & (F.col("b") == F.col("l_b")) & (F.col("none") == F.col("l_none")), "left")
    own = F.when(F.col("l_a").isNotNull(), F.xxhash64("doc_id", "source")).otherwise(F.lit(0))
    rows = rows.select("doc_id", "source", "size", "text_crc32", "a", "b", F.xxhash64("none", own).alias("o"))
    items = rows.groupBy("a", "b", "o").agg(F.sum("size").alias("bytes"), F.min("source").alias("v_name"), F.min("doc_id").alias("first_id"), F.first("size").alias("one_size"))
    name = F.conv(F.substring(F.md5("v_name"), 1, 7), 16, 10).cast("double") / F.lit(float(2**28))
    items = items.select(
        *("a", "b", "o", "bytes"),
        F.log2(F.col("one_size").cast("double")).alias("v_size"),
        F.coalesce(name, F.lit(0.0)).alias("v_source"),
        F.coalesce(F.col("first_id").cast("double"), F.lit(-1.0)).alias("v_id"),
        F.shiftrightunsigned(F.xxhash64("a", "b", "o"), 2).alias("tie"),
    )
    items = stored(items, "kd-items")
    heavy = items.where(F.col("bytes") > whole / HEAVY).select("a", "b", "o", "bytes").collect()  # HEAVY x shards rows at most
    heavy.sort(key=lambda r: (-r["bytes"], r["a"], r["b"], r["o"]))
    homes = laid_out([r["bytes"] for r in heavy], shards)
    room = [whole] * shards
    for r, s in zip(heavy, homes):
        room[s] -= r["bytes"]
    placed = kd_tree(keyed(items.where(F.col("bytes") <= whole / HEAVY)), [max(0.0, x) for x in room]).select("a", "b", "o", "shard")
    fixed = ", ".join(f"({r['a']}L, {r['b']}L, {r['o']}L, {s})" for r, s in zip(heavy, homes))
    if fixed:
        placed = placed.unionByName(spark.sql(f"SELECT * FROM VALUES {fixed} AS t(a, b, o, shard)"))
    placed = placed.select(F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("o").alias("p_o"), "shard")
    same = (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b")) & (F.col("o") == F.col("p_o"))
    placed_rows = stored(rows.join(placed, same).select("doc_id", "size", "text_crc32", "shard"), "kd-rows")
    discard(raw, items)
    return _slotted(placed_rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slotted(rows: DataFrame, shards: int) -> DataFrame:
    """Numbers the rows of each shard from 0 without a task per shard."""
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    sums = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.select(F.col("shard").alias("s_shard"), F.col("part").alias("s_part"), (F.sum("n").over(earlier) - F.col("n")).alias("shift"))
    inner = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("slot", F.row_number().over(inner) - 1)
    rows = rows.join(sums, (F.col("shard") == F.col("s_shard")) & (F.col("part") == F.col("s_part")))
    return rows.withColumn("slot", (F.col("slot") + F.col("shift")).cast("long"))
