"""Exact dedup by a minimal perfect hash over the distinct digests of history.

History is grouped once by SHA-256 of the white-space-normalised text. Its distinct digests
are dealt over shards; each shard gets a minimal perfect hash (levels of collision-free bit
arrays) whose slots hold the full digest, the winner's locator (doc_id and place in the input)
and the number of copies. New rows, pre-aggregated by digest, look their slot up and compare all
32 bytes: equal bytes make them repeats of the slot's winner, the others are grouped separately.

Defined cases: a null text counts as empty, and all empty texts are equal; null doc_ids lose
against any other (a group of null ids only has a null keep_id); rows repeated with one doc_id
count in group_size, and the first by place is the one that stays, so every group keeps exactly
one row; rows of one doc_id with different texts belong to their texts' groups; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, stored

#: Digests per shard: bounds what one task of the build or lookup holds.
SHARD_KEYS = 4096
GAMMA = 2.0
#: The winner's locator, in the order of preference: whether it has no doc_id, doc_id, file and position.
LOCATOR = ("w_none", "w_id", "w_file", "w_pos")
_INDEX = "shard int, sizes array<long>, bits binary, digests binary, winners binary, copies binary"
_GROUPS = f"digest binary, {', '.join(f'{c} long' for c in LOCATOR)}, group_size long, repeat boolean"


def digest_of(text):
    """SHA-256 (binary) of a text column with each white-space run made one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a + b * np.uint64(2 * level + 1)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))


def _halves(digests: list) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(bytes(d) for d in digests), dtype=np.uint64).reshape(-1, 4)
    return raw[:, 0], raw[:, 1]


def build_levels(digests: list) -> tuple[list[int], np.ndarray]:
    """Level sizes and one concatenated 0/1 array with exactly one set bit per digest."""
    a, b = _halves(digests) if digests else (np.empty(0, np.uint64),) * 2
    sizes, parts = [], []
    while len(a):
        size = max(8, int(len(a) * GAMMA))
        at = (_mixed(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        parts.append((hits == 1).astype(np.uint8))
        sizes.append(size)
        a, b = a[hits[at] > 1], b[hits[at] > 1]
    return sizes, np.concatenate(parts) if parts else np.empty(0, np.uint8)


def slots_of(digests: list, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest: 0..n-1 for members, any slot or -1 for others (compare bytes)."""
    out = np.full(len(digests), -1, np.int64)
    if not digests or not sizes:
        return out
    a, b = _halves(digests)
    rank = np.cumsum(bits) - bits
    left, base = np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + (_mixed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at] == 1
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = [bytes(d) for d in pdf["digest"]]
    sizes, bits = build_levels(digests)
    order = np.argsort(slots_of(digests, sizes, bits))
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [b"".join(digests[i] for i in order)],
            "winners": [pdf[[*LOCATOR]].to_numpy(np.int64)[order].tobytes()],
            "copies": [pdf["group_size"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _lookup(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    digests = [bytes(d) for d in new["digest"]]
    places, copies = new[[*LOCATOR]].to_numpy(np.int64), new["group_size"].to_numpy(np.int64)
    if len(index):
        row = index.iloc[0]
        sizes = [int(s) for s in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)]
        slots = slots_of(digests, sizes, bits)
        held = row["digests"]
        total = np.frombuffer(row["copies"], np.int64).copy()
        keep = np.frombuffer(row["winners"], np.int64).reshape(-1, len(LOCATOR)).copy()
    else:
        slots, held, total, keep = np.full(len(digests), -1), b"", np.empty(0, np.int64), np.empty((0, len(LOCATOR)), np.int64)
    member = np.array([s >= 0 and held[32 * s : 32 * s + 32] == d for s, d in zip(slots, digests)], dtype=bool)
    found = slots[member]
    total[found] += copies[member]  # one row per new digest, so no slot occurs twice
    for slot, rival in zip(found.tolist(), places[member]):
        if tuple(rival) < tuple(keep[slot]):
            keep[slot] = rival
    places = np.concatenate([keep, places[~member]])
    return pd.DataFrame(
        {
            "digest": [held[32 * i : 32 * i + 32] for i in range(len(total))] + [d for d, m in zip(digests, member) if not m],
            **{c: places[:, k] for k, c in enumerate(LOCATOR)},
            "group_size": np.concatenate([total, copies[~member]]),
            "repeat": np.concatenate([np.isin(np.arange(len(total)), found), np.zeros((~member).sum(), bool)]),
        }
    )


def _grouped(rows: DataFrame) -> DataFrame:
    place = F.struct(F.col("doc_id").isNull().cast("long").alias("w_none"), F.coalesce("doc_id", F.lit(0)).alias("w_id"), "w_file", "w_pos")
    groups = rows.groupBy("digest").agg(F.min(place).alias("w"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("digest", "w.*", "group_size")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """Sharded minimal perfect hash over ``groups`` (digest, locator, group_size)."""
    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(_build, _INDEX)


def lookup(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """History and new digests together: digest, locator, group_size, repeat.

    ``repeat`` marks historical digests that the new rows repeat; digests that the slots do
    not hold come out as groups of their own.
    """
    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_lookup, _GROUPS)


def exact_dedup(docs: DataFrame, is_history=None, names: list[Column] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``is_history`` is a condition on doc_id that tells the rows indexed first from those that
    arrive later; by default a hash of doc_id splits the table in halves. It has no influence
    on the result, which is exact for any split. ``names`` are two bigint columns that name a
    row; they come out as w_file and w_pos. Without them rows are numbered as they are read.
    """
    if is_history is None:
        is_history = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
    file, place = names or (F.lit(0), F.monotonically_increasing_id())
    old = F.coalesce(is_history, F.lit(True)).alias("old")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), old, file.cast("long").alias("w_file"), place.alias("w_pos"))
    rows = stored(rows, "digests")
    shards = max(1, -(-rows.count() // SHARD_KEYS))
    index = stored(build_index(_grouped(rows.where("old")), shards), "mph-index")
    groups = stored(lookup(_grouped(rows.where("not old")), index, shards), "mph-groups")
    discard(index)
    groups = groups.select(F.col("digest").alias("g_digest"), F.when(F.col("w_none") == 0, F.col("w_id")).alias("keep_id"), "group_size", F.col("w_file").alias("g_file"), F.col("w_pos").alias("g_pos"))
    joined = rows.join(groups, F.col("digest") == F.col("g_digest"), "left")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("w_file") == F.col("g_file")) & (F.col("w_pos") == F.col("g_pos"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["w_file", "w_pos"] if names else []),
    )
