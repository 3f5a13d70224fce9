"""Near-duplicate classes by Order MinHash with banded alignment.

A text is the sequence of its five-word k-mers. For the candidate search each is labelled with
its occurrence (the third "a b c d e" is another item than the first). A sketch takes the
``TAKEN`` labelled k-mers with the smallest hash and keeps them in text order, so texts share it
when they share these k-mers and their order. ``SKETCHES`` of them with different hashes make the
bands of the candidate search. Where a k-mer is repeated, an edit of an early occurrence moves the
later labels, and their order says nothing; a pair with such a text meets by the same k-mers
without order, in bands of their own that are kept only where a text with repeats is among them.
Candidates are verified by an alignment of the two k-mer sequences, without labels, inside the
band of diagonals that the threshold allows: with ``m`` k-mers aligned in order, of ``a`` and
``b``, the similarity is m / (a + b - m), and a link needs ``SIMILARITY`` (0.8) or more. Labelled
k-mers that two texts share are as many as k-mers that any alignment could pair, so filters over
sets of them lose no pair.

Equal texts are one node. A band's bucket is not expanded into pairs:
its members are compared with one leader, band group after band group, and only where a bucket
still holds several components. What is left in the end, members of buckets with several
components, goes through an exact prefix filter: of two texts as similar as asked, the rarest
fifth of their k-mers (counted over all that is left) must have one in common. A text whose own
k-mers fill its fifth has no partner and makes no pair, which is what keeps large families of
copies of copies from being compared with each other. Pairs that also agree in enough of
``BITS`` one-bit minima and in ``AGREE`` sketches are verified, first the pairs that look
linked and then, between what is still apart, all that may be. A pair at the threshold meets
all this with a probability of 0.9999 or more, whatever the number of texts.

The texts of nodes that share a bucket are gathered once; all rounds verify from that table. Before
texts, k-mers or keys are shuffled, rows that meet nothing are left out by a table of ``SLOTS`` bits
that every task gets (:func:`_thinned`): it lets through all that is asked for, and by chance some more.

Defined cases: null texts and texts without words are duplicates of one another; texts of fewer than
five words have one k-mer, all their words; very long texts are read whole; class_id is the
smallest doc_id of the class (null only if all are null); rows repeated with one doc_id count in
class_size, and of several rows with the class's doc_id the first by place is ``kept``, so every class
keeps exactly one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .graph import components

KMER = 5
TAKEN = 3
SKETCHES = 24
SIMILARITY = 0.8
AGREE = 2
#: One-bit minima of the last comparison. At the threshold 0.9 of them agree; the second bound
#: lies 4.7 standard deviations below.
BITS = 2048
NEAR_BITS = (1850, 1779)
#: Texts with one k-mer in their prefixes that meet in one block.
BLOCK_TEXTS = 4096
#: Smallest ids of a text that travel with it, so that pairs come out once.
FIRST_IDS = 64
#: Bands compared with leaders in one round; those from SKETCHES on are without order.
ROUNDS = (range(0, 4), range(4, 2 * SKETCHES))
#: Bits of the table that thins rows out, a power of 2; 64 of them are one row of it.
SLOTS = 2**24
SEED = 11

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ROOT = np.uint64(0x100000001B3)
_SEEDS = np.random.default_rng(SEED).integers(1, 2**63, SKETCHES).astype(np.uint64)
_STEPS = np.random.default_rng(SEED + 1).integers(1, 2**62, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    space = _IS_SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _ROOT)]), dtype=np.uint64)
    letters = raw[~space].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    letters *= powers[np.arange(len(letters)) - np.repeat(first, lengths)]
    return _mixed(np.add.reduceat(letters, first) + lengths.astype(np.uint64) * _ODD)


def text_kmers(text: str | None) -> np.ndarray:
    """One 64-bit item per k-mer, in text order."""
    with np.errstate(over="ignore"):
        words = word_hashes(text or "")
        if not len(words):
            return words
        if len(words) < KMER:
            return _mixed(np.array([(words * _STEPS[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))
        n = len(words) - KMER + 1
        h = np.zeros(n, np.uint64)
        for j in range(KMER):
            h += words[j : j + n] * _STEPS[j]
        return _mixed(h)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """The k-mers with later occurrences renamed, unique within the text; first ones keep their value."""
    n = len(kmers)
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return kmers
    at = np.arange(n)
    start = np.where(np.concatenate([[True], ~same]), at, 0)
    with np.errstate(over="ignore"):
        later = _mixed(s + (at - np.maximum.accumulate(start)).astype(np.uint64) * _ODD)
    out = np.empty(n, np.uint64)
    out[order] = np.where(np.concatenate([[False], same]), later, s)
    return out


def labelled_kmers(text: str | None) -> np.ndarray:
    """One 64-bit item per k-mer, in text order, unique within the text."""
    return labelled(text_kmers(text))


def sketches(kmers: np.ndarray) -> list[int]:
    """SKETCHES signed 64-bit keys, each of TAKEN k-mers in text order; fixed ones for no k-mers."""
    return all_sketches(kmers)[:SKETCHES]


def all_sketches(kmers: np.ndarray) -> list[int]:
    """The keys of :func:`sketches`, then as many of the same k-mers without order."""
    n = len(kmers)
    if not n:
        return np.concatenate([_SEEDS, ~_SEEDS]).astype(np.int64).tolist()
    out = np.zeros((2, SKETCHES), np.uint64)
    lanes = SKETCHES if n <= 20_000 else 1  # long texts are ranked one hash at a time
    with np.errstate(over="ignore"):
        for lo in range(0, SKETCHES, lanes):
            v = (kmers[None, :] ^ _SEEDS[lo : lo + lanes, None]) * _MIX
            v ^= v >> np.uint64(32)
            v *= _ODD
            at = np.argpartition(v, TAKEN - 1, axis=1)[:, :TAKEN] if n > TAKEN else np.tile(np.arange(n), (len(v), 1))
            at.sort(axis=1)
            for row, seeds, taken in ((0, _SEEDS, kmers[at]), (1, ~_SEEDS, np.sort(kmers[at], axis=1))):
                key = seeds[lo : lo + lanes].copy()
                for j in range(at.shape[1]):
                    key = _mixed(key * _STEPS[5] + taken[:, j])
                out[row, lo : lo + lanes] = key
    return out.ravel().astype(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned k-mers over all k-mers of both, by a banded alignment; 0.0 if below ``least``."""
    na, nb = len(a), len(b)
    if not na and not nb:
        return 1.0
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    # At the threshold both texts have (na + nb) (1 - least) / (1 + least) unaligned k-mers together.
    # Rounding must not narrow the band; where it widens it, the similarity still decides.
    width = int((na + nb) * (1 - least) / (1 + least) + 1e-6)
    # Some best alignment pairs equal beginnings and equal ends.
    short = min(na, nb)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    found, ids = np.unique(np.concatenate([a[head : na - tail], b[head : nb - tail]]), return_inverse=True)
    x, y = ids[: na - tail - head], ids[na - tail - head :]
    in_x, in_y = np.bincount(x, minlength=len(found)), np.bincount(y, minlength=len(found))
    most = head + tail + int(np.minimum(in_x, in_y).sum())
    if most < least * (na + nb - most):
        return 0.0
    i, j = np.flatnonzero(in_y[x] > 0), np.flatnonzero(in_x[y] > 0)
    unique = in_x[x[i]].max(initial=0) <= 1 and in_y[y[j]].max(initial=0) <= 1
    aligned = head + tail + (_increasing if unique else _banded)(x[i], i, y[j], j, width)
    found = aligned / (na + nb - aligned)
    return found if found >= least else 0.0


def _increasing(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, width: int) -> int:
    """Longest alignment of two orders (x at i, y at j) of the same unique items: an increasing run."""
    at = j[np.argsort(y)][np.argsort(np.argsort(x))]
    at = at[np.abs(i - at) <= width]
    if (np.diff(at) > 0).all():
        return len(at)
    tails: list[int] = []
    for p in at.tolist():
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails)


def _banded(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, width: int) -> int:
    """Longest common subsequence of x (at i) and y (at j) inside the band, bit-parallel.

    Bit k of ``row`` is 0 where the length grows at x[k]; only the bits inside the band are held.
    """
    order = np.argsort(x, kind="stable")
    starts = np.searchsorted(x[order], y).tolist()
    ends = np.searchsorted(x[order], y, "right").tolist()
    places = order.tolist()
    first = np.searchsorted(i, j - width).tolist()
    last = np.searchsorted(i, j + width, "right").tolist()
    row = low = high = aligned = 0
    for start, end, lo, hi in zip(starts, ends, first, last):
        if hi > high:
            row |= ((1 << (hi - high)) - 1) << (high - low)
            high = hi
        if lo > low:
            aligned += lo - low - (row & ((1 << (lo - low)) - 1)).bit_count()
            row >>= lo - low
            low = lo
        match = 0
        for k in places[start:end]:
            if lo <= k < hi:
                match |= 1 << (k - lo)
        match &= row
        if match:
            row = ((row + match) | (row ^ match)) & ((1 << (high - low)) - 1)
    return aligned + high - low - row.bit_count()


def node_of(text):
    """16 bytes that name a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _sketched(batches):
    for pdf in batches:
        sizes, keys, repeats = [], [], []
        for t in pdf["text"]:
            own = text_kmers(t if isinstance(t, str) else None)
            k = labelled(own)
            sizes.append(len(k))
            keys.append(all_sketches(k))
            repeats.append(bool((k != own).any()))
        yield pd.DataFrame(
            {"doc_id": pdf["doc_id"].astype("Int64"), "w_file": pdf["w_file"], "w_pos": pdf["w_pos"], "node": pdf["node"], "n": np.array(sizes, np.int32), "keys": keys, "repeats": np.array(repeats, bool)}
        )


def _verified(batches):
    held: dict[bytes, np.ndarray] = {}
    room = 0

    def kmers(node, text):
        nonlocal room
        node = bytes(node)
        if node not in held:
            if room > 4_000_000:
                held.clear()
                room = 0
            held[node] = text_kmers(text)
            room += len(held[node])
        return held[node]

    for pdf in batches:
        linked = [similarity(kmers(a, x), kmers(b, y)) > 0 for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["a_text"], pdf["b_text"])]
        yield pdf.loc[np.array(linked, bool), ["a", "b"]]


def near_classes(docs: DataFrame, names: list[Column] | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    ``names`` are two bigint columns that name a row; they come out as w_file and w_pos. Without
    them rows are numbered as they are read.
    """
    file, place = names or (F.lit(0), F.monotonically_increasing_id())
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", node_of(F.col("text")).alias("node"))
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), file.cast("long").alias("w_file"), place.alias("w_pos"), "text", node_of(F.col("text")).alias("node"))
    rows = stored(numbered.mapInPandas(_sketched, "doc_id long, w_file long, w_pos long, node binary, n int, keys array<long>, repeats boolean"), "omh")
    nodes = stored(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("repeats").alias("repeats")), "omh-nodes")
    places = nodes.select("node", "n", "repeats", F.posexplode("keys").alias("band", "key"))
    # Of the keys without order, those that a text with repeats may have.
    loose = nodes.where("repeats").select(F.explode(F.slice("keys", SKETCHES + 1, SKETCHES)).alias("key"))
    places = _thinned(places, "key", loose, unless=(F.col("band") < SKETCHES) | F.col("repeats"))
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max((F.col("band") < SKETCHES) | F.col("repeats")).alias("asked"))
    shared = shared.where("size > 1 and asked").select(F.col("key").alias("s_key"))
    # Hashed, not sorted: the keys are unique, so no task's table grows with a hot one.
    buckets = stored(places.drop("repeats").join(shared.hint("shuffle_hash"), F.col("key") == F.col("s_key"), "left_semi"), "omh-buckets")
    asked = buckets.select(F.col("node").alias("w")).distinct()
    known = stored(_thinned(nodes, "node", buckets).select(F.col("node").alias("k_node"), "keys", "repeats"), "omh-known")
    # Texts that are not asked for are left out, and copies reduced to one text, before the shuffle.
    texts = _thinned(picked, "node", buckets).groupBy(F.col("node").alias("t_node")).agg(F.first("text").alias("text"))
    texts = stored(texts.join(asked, F.col("t_node") == F.col("w"), "left_semi"), "omh-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a, b): sketches first, whole texts for what is left."""
        for side in ("a", "b"):
            own = known.select("k_node", F.col("keys").alias(f"{side}_keys"), F.col("repeats").alias(f"{side}_repeats"))
            pairs = pairs.join(own, F.col(side) == F.col("k_node")).drop("k_node")
        pairs = stored(pairs.where(_agree("a_keys", "b_keys", F.col("a_repeats") | F.col("b_repeats")) >= AGREE).select("a", "b"), "omh-agreeing")
        own = _thinned(texts, "t_node", pairs.select(F.col("a").alias("t_node")).union(pairs.select("b")))
        full = pairs.join(own.withColumnRenamed("text", "a_text"), F.col("a") == F.col("t_node")).drop("t_node")
        full = full.join(own.withColumnRenamed("text", "b_text"), F.col("b") == F.col("t_node")).drop("t_node")
        links = stored(full.mapInPandas(_verified, "a binary, b binary"), "omh-links")
        discard(pairs)
        return links

    classes = None  # node -> component, for nodes with links
    tested = None
    candidates: list[DataFrame] = []

    def compared(pairs: DataFrame):
        nonlocal tested, classes
        pairs = pairs.distinct()
        if tested is not None:
            done = tested.select(F.col("a").alias("d_a"), F.col("b").alias("d_b"))
            pairs = pairs.join(done, (F.col("a") == F.col("d_a")) & (F.col("b") == F.col("d_b")), "left_anti")
        pairs = stored(pairs, "omh-candidates")
        tested = pairs if tested is None else tested.union(pairs)
        candidates.append(pairs)
        if pairs.isEmpty():
            return
        links = verified(pairs)
        if not links.isEmpty():
            before, classes = classes, _joined(classes, links)
            discard(before)
        discard(links)

    for bands in ROUNDS:
        placed = _placed(buckets.where(F.col("band").isin(list(bands))), classes)
        heads = placed.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "n", "part")).alias("head"), F.min("part").alias("lo"), F.max("part").alias("hi")
        )
        # Stored, so that the join reads both sides from shuffles, of which hot keys are split.
        heads = stored(heads.where("lo <> hi").select(F.col("key").alias("h_key"), "head"), "omh-leaders")
        met = placed.join(heads, F.col("key") == F.col("h_key")).where((F.col("part") != F.col("head.part")) & _similar_size(F.col("n"), F.col("head.n")))
        compared(met.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")))
        discard(heads)
    placed = _placed(buckets, classes)
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(F.col("key").alias("h_key"))
    mixed = stored(mixed, "omh-mixed")
    left = stored(placed.join(mixed, F.col("key") == F.col("h_key"), "left_semi").select("node", "n").distinct(), "omh-open")
    items, prefixes = _prefixes(left, texts)
    bits = None
    for near in NEAR_BITS:
        heads = _mixed_heads(_placed(prefixes, classes))
        if bits is None:  # components only grow, so later rounds ask for no other node
            bits = _thinned(items, "i_node", heads.select(F.col("node").alias("i_node")))
            bits = stored(bits.mapInPandas(_bits, "b_node binary, bits array<long>"), "omh-bits")
        compared(_prefix_pairs(heads, bits, near))
        discard(heads)
    discard(nodes, buckets, known, texts, mixed, left, items, prefixes, bits, *candidates)
    own = ["doc_id", "w_file", "w_pos"]
    out = _placed(rows.select(*own, "node"), classes).select(*own, "part")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *own)).alias("w")
    sizes = stored(out.groupBy(F.col("part").alias("s_part")).agg(first, F.count(F.lit(1)).alias("class_size")), "omh-sizes")
    out = out.join(sizes, F.col("part") == F.col("s_part"))
    kept = (F.col("w_file") == F.col("w.w_file")) & (F.col("w_pos") == F.col("w.w_pos"))
    return out.select("doc_id", F.col("w.doc_id").alias("class_id"), "class_size", kept.alias("kept"), *(own[1:] if names else []))


def _thinned(rows: DataFrame, column: str, wanted: DataFrame, unless: Column | None = None) -> DataFrame:
    """The rows whose ``column`` is in that of ``wanted`` (or that meet ``unless``), and by chance some others.

    Values are hashed to SLOTS bits; the bits that are set come to every task as at most SLOTS / 64 rows.
    """
    slot = F.xxhash64(column).bitwiseAND(F.lit(SLOTS - 1))
    word, bit = F.shiftright(slot, 6), F.expr("shiftleft(1L, cast(w_slot & 63 as int))")
    held = wanted.select(slot.alias("w_slot")).groupBy(F.shiftright("w_slot", 6).alias("w_word")).agg(F.bit_or(bit).alias("w_bits"))
    found = rows.withColumn("w_slot", slot).join(F.broadcast(held), word == F.col("w_word"), "inner" if unless is None else "left")
    there = F.coalesce(F.col("w_bits"), F.lit(0)).bitwiseAND(bit) != 0
    return found.where(there if unless is None else unless | there).select(*rows.columns)


def _placed(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Adds the component of each node as ``part``."""
    if classes is None:
        return rows.withColumn("part", F.col("node"))
    return rows.join(classes, F.col("node") == F.col("c_node"), "left").withColumn("part", F.coalesce("comp", "node")).drop("c_node", "comp")


def _prefixes(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K-mers of each node (i_node, ids), and the shared ones among its prefix (node, n, id).

    A prefix is the first n - ceil(0.8 n) + 1 k-mers in the order of (texts that hold it, k-mer).
    """
    own = _thinned(texts, "t_node", nodes.select(F.col("node").alias("t_node")))  # texts let through by chance count in df alone
    items = stored(own.mapInPandas(_kmer_ids, "i_node binary, ids array<long>"), "omh-kmers")
    rows = items.select("i_node", F.explode("ids").alias("id"))
    common = rows.groupBy("id").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("id", "c_id")
    rows = rows.join(common, F.col("id") == F.col("c_id")).select("i_node", F.struct("df", "id").alias("item"))
    shared = rows.groupBy("i_node").agg(F.sort_array(F.collect_list("item")).alias("items"))  # one text's k-mers
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-9)) + 1
    shared = shared.join(nodes, F.col("i_node") == F.col("node")).withColumn("most", (prefix - (F.col("n") - F.size("items"))).cast("int"))
    heads = shared.where("most > 0").select("node", "n", F.explode(F.slice("items", 1, F.col("most"))).alias("item"))
    return items, stored(heads.select("node", "n", F.col("item.id").alias("id")), "omh-prefixes")


def _mixed_heads(heads: DataFrame) -> DataFrame:
    """Prefix rows whose id occurs in several components, and the number of blocks that its texts are cut into."""
    mixed = heads.groupBy("id").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("texts")).where("lo <> hi")
    mixed = stored(mixed.select(F.col("id").alias("m_id"), F.ceil(F.col("texts") / BLOCK_TEXTS).cast("int").alias("blocks")), "omh-mixed-ids")
    return stored(heads.join(mixed, F.col("id") == F.col("m_id")).drop("m_id"), "omh-heads")


def _prefix_pairs(heads: DataFrame, bits: DataFrame, near: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share an id and agree in ``near`` bits.

    Texts that share an id meet block by block, so that no task compares more than BLOCK_TEXTS of
    them with as many others.
    """
    cut = not heads.where("blocks > 1").isEmpty()
    own = heads.groupBy(F.col("node").alias("q_node")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, FIRST_IDS).alias("own"))  # one text's k-mers
    own = own.join(bits, F.col("q_node") == F.col("b_node")).drop("b_node")
    heads = heads.join(own, F.col("node") == F.col("q_node")).drop("q_node")
    meet = F.col("x.id") == F.col("y.id")
    meet = meet & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & _similar_size(F.col("x.n"), F.col("y.n"))
    # Folded, not written out as 32 terms: the compiled condition of a join is only fast while it is small.
    apart = F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(apart, F.lit(0), lambda total, n: total + n)
    # A pair that shares any of the smallest ids of both comes out once, at the smallest it shares.
    first = F.array_min(F.array_intersect("x.own", "y.own"))
    meet = meet & (differ <= BITS - near) & (F.col("x.id") == F.coalesce(first, F.col("x.id")))
    # Texts of one block meet those of the same rows, which are shuffled once for both sides.
    single = heads.where("blocks = 1").drop("blocks")
    ends = F.col("x.node").alias("a"), F.col("y.node").alias("b")
    pairs = single.alias("x").join(single.alias("y"), meet).select(*ends)
    if cut:
        many = heads.where("blocks > 1")
        spot, others = F.pmod(F.xxhash64("node", "id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        x = many.withColumn("i", spot).withColumn("j", others).drop("blocks").alias("x")
        y = many.withColumn("j", spot).withColumn("i", others).drop("blocks").alias("y")
        met = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & meet)
        pairs = pairs.union(met.select(*ends))
    return pairs


def _bits(batches):
    for pdf in batches:
        bits = [one_bit_minima(np.asarray(i, np.int64).view(np.uint64)) for i in pdf["ids"]]
        yield pd.DataFrame({"b_node": pdf["i_node"], "bits": bits})


def one_bit_minima(kmers: np.ndarray) -> list[int]:
    """BITS bits, each the lowest bit of the smallest k-mer under a hash of its own."""
    n = len(kmers)
    r = np.random.default_rng(SEED + 2)
    odd = r.integers(1, 2**62, BITS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.zeros(BITS, np.uint8)
    if not n:
        return np.packbits(low).view(np.int64).tolist()
    lanes = max(1, min(BITS, 500_000 // max(1, n)))
    with np.errstate(over="ignore"):
        for lo in range(0, BITS, lanes):
            v = kmers[None, :] * odd[lo : lo + lanes, None]
            v ^= v >> np.uint64(31)
            best = kmers[v.argmin(axis=1)]
            low[lo : lo + lanes] = (_mixed(best ^ odd[lo : lo + lanes]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(low).view(np.int64).tolist()


def _kmer_ids(batches):
    for pdf in batches:
        yield pd.DataFrame({"i_node": pdf["t_node"], "ids": [labelled_kmers(t).astype(np.int64) for t in pdf["text"]]})


def _similar_size(a, b):
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _agree(a: str, b: str, repeats):
    """Sketches that two nodes share: with order, or without it where one of them repeats a k-mer."""
    start = F.when(repeats, SKETCHES + 1).otherwise(1)
    own = [F.slice(F.col(c), start, F.lit(SKETCHES)) for c in (a, b)]
    return F.size(F.filter(F.zip_with(*own, lambda x, y: x == y), lambda same: same))


def _joined(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links: (c_node, comp)."""
    nodes = links.select(F.col("a").alias("n")).union(links.select("b")).distinct()
    if classes is None:
        found = components(links)
        return stored(nodes.join(found, F.col("n") == F.col("node")).select(F.col("n").alias("c_node"), F.col("label").alias("comp")), "omh-classes")
    side = lambda c: links.join(classes, F.col(c) == F.col("c_node"), "left").select("a", "b", F.coalesce("comp", c).alias("p"))
    left = side("a").withColumnRenamed("p", "p_a")
    lifted = left.join(classes, F.col("b") == F.col("c_node"), "left").select(F.col("p_a").alias("a"), F.coalesce("comp", "b").alias("b"))
    merged = components(lifted.where("a <> b").distinct())
    every = classes.select("c_node", "comp").union(nodes.join(classes, F.col("n") == F.col("c_node"), "left_anti").select(F.col("n"), F.col("n")))
    every = every.join(merged, F.col("comp") == F.col("node"), "left").select("c_node", F.coalesce("label", "comp").alias("comp"))
    return stored(every, "omh-classes")
