"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner product is turned into nearness on a sphere by one more coordinate,
sqrt(max norm^2 - norm^2), which is 0 for queries. A tree cuts the points at the median of a
random projection, level by level, down to leaves of about ``LEAF_ROWS`` vectors. A query
enters all trees at once: one priority queue, ordered by the margins by which it lies on the other
side of the cuts on the way, summed, hands out the most promising leaf of any tree until enough rows are seen. The leaves' vectors are
then reranked exactly, in double precision.

The cuts are fitted on at most ``SAMPLE`` distinct vectors (lowest hash first); every vector is
indexed. The number of rows a query visits is a share of all, found on the same sample:
the share at which ``RECALL`` of the sample's true neighbours are reached. A table of up to
``WHOLE`` distinct vectors is one leaf and searched whole; a recall of 1 asks for that, and so for the
exact result, at every size. A score is summed in the order of the components. Equal vectors are indexed once, with
their k + 1 smallest ids (no query can return more of them).

Each vector is stored once per tree. Queries are sent to the leaves they visit, and work is dealt
by (leaf, part of its rows, block of its queries): a leaf of more than ``PART_ROWS`` rows is cut
into parts, the visits of one with more than ``QUERY_BLOCK`` into blocks. A row is copied once for
each block of its own leaf, a visit once for each part, so what is moved is the products that
are computed over some thousands, and no group grows with the table.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have
another length than most vectors (ties: the longer), and rows with a null vec_id, take no part;
a row repeated with its vec_id is one candidate, and rows of one vec_id with several vectors
share one list of results; ties go to the smaller vec_id; fewer
candidates than k are all returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

K = 20
TREES = 8
LEAF_ROWS = 512
SAMPLE = 8192
SAMPLE_QUERIES = 128
RECALL = 0.95
#: Distinct vectors of a table that is searched whole.
WHOLE = 8192
PART_ROWS = 4096
QUERY_BLOCK = 4096
#: Queries that one task sends to their leaves, about.
SEARCHED = 256
SEED = 7


class Forest:
    """Complete binary trees; node i has the children 2i + 1 (below the cut) and 2i + 2."""

    def __init__(self, sample: np.ndarray, top: float, depth: int, trees: int = TREES, seed: int = SEED):
        self.top, self.depth = top, depth
        r = np.random.default_rng(seed)
        points = self.lifted(sample)
        inner = 2**depth - 1
        self.planes = r.normal(size=(trees, inner, points.shape[1]))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True) if inner else 1.0
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(points), np.int64)
            for level in range(depth):
                for n in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = node == n
                    value = points[mine] @ self.planes[t, n]
                    self.cuts[t, n] = np.median(value) if len(value) else 0.0
                    node[mine] = 2 * n + 1 + (value > self.cuts[t, n])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """[tree, row] -> leaf number."""
        points = self.lifted(x)
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for t in range(len(self.planes)):
            node = out[t]
            for _ in range(self.depth):
                value = np.einsum("ij,ij->i", points, self.planes[t][node])
                node = 2 * node + 1 + (value > self.cuts[t][node])
            out[t] = node - (2**self.depth - 1)
        return out

    def order(self, q: np.ndarray, counts: np.ndarray, most: float):
        """(tree, leaf) in the order of the shared queue until ``most`` rows are counted."""
        point = np.append(q / np.sqrt(q @ q) * self.top, 0.0)
        margins = self.planes @ point - self.cuts
        first_leaf = 2**self.depth - 1
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        seen = 0
        while queue and seen < most:
            off, t, n = heapq.heappop(queue)
            while n < first_leaf:
                m = margins[t, n]
                near, far = (2 * n + 2, 2 * n + 1) if m > 0 else (2 * n + 1, 2 * n + 2)
                heapq.heappush(queue, (off + abs(m), t, far))
                n = near
            leaf = n - first_leaf
            if counts[t, leaf]:
                seen += int(counts[t, leaf])
                yield t, leaf, seen


def visited_share(forest: Forest, sample: np.ndarray, k: int = K, recall: float = RECALL) -> float:
    """Rows to visit, counted in all trees, over all rows, to reach ``recall`` in the sample."""
    leaves = forest.leaves(sample)
    counts = np.stack([np.bincount(row, minlength=2**forest.depth) for row in leaves])
    chosen = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    reached = []
    for i in chosen:
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 1) - 1)[: min(k, len(sample) - 1)]
        found = np.full(len(near), np.inf)
        for t, leaf, seen in forest.order(sample[i], counts, np.inf):
            hit = leaves[t, near] == leaf
            found[hit] = np.minimum(found[hit], seen)
        reached.append(found)
    return float(np.quantile(np.concatenate(reached), recall) / len(sample)) if reached else 1.0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    found = found.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return found.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """embedding and its k + 1 smallest ids."""
    # The rank filter runs before the shuffle too: a repeated vector sends k + 1 ids per task.
    least = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    ids = rows.distinct().withColumn("n", least).where(F.col("n") <= k + 1)
    return ids.groupBy("embedding").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))


def fitted(points: DataFrame, k: int = K, recall: float = RECALL) -> tuple[Forest, float]:
    """The forest over ``points``, and the rows to visit, counted in all trees, over all rows."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    total, top = points.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = _matrix([r["embedding"] for r in points.orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()])
    depth = 0 if total <= WHOLE or recall >= 1 else int(np.ceil(np.log2(total / LEAF_ROWS)))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) / 8)))))
    forest = Forest(sample, float(top), depth, TREES if depth else 1)
    return forest, visited_share(forest, sample, k, recall) if depth else 1.0


def nearest(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row that meets ``is_query``.

    With a ``recall`` of 1 all rows are searched and the result is exact.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "ann-rows")
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == lengths["n"])
    points = stored(distinct_points(rows, k), "ann-points")
    forest, share = fitted(points, k, recall)
    leaves = 2**forest.depth
    shared = spark.sparkContext.broadcast(forest)  # trees x leaves planes; the leaves are bounded by the sample

    def dealt(batches):
        f = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            found = f.leaves(_matrix(pdf["embedding"]))
            for t in range(len(found)):
                yield pd.DataFrame({"cell": t * leaves + found[t], "ids": pdf["ids"], "embedding": pdf["embedding"]})

    cells = stored(points.mapInPandas(dealt, "cell long, ids array<long>, embedding array<double>"), "ann-cells")
    counts = np.zeros((len(forest.planes), leaves), np.int64)
    for r in cells.groupBy("cell").count().collect():  # one row per leaf
        counts[divmod(r["cell"], leaves)] = r["count"]
    most = share * counts[0].sum()
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    sizes = spark.sparkContext.broadcast(counts)

    def searched(batches):
        f, held = shared.value, sizes.value
        for pdf in batches:
            at, cell = [], []
            for i, q in enumerate(_matrix(pdf["embedding"])):
                for t, leaf, _ in f.order(q, held, most):
                    at.append(i)
                    cell.append(t * leaves + leaf)
            out = pdf.iloc[at].reset_index(drop=True)
            yield pd.DataFrame({"cell": np.array(cell, np.int64), "query_id": out["query_id"], "embedding": out["embedding"]})

    asking = queries.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-asking // SEARCHED))
    asked = queries.repartition(tasks, "query_id").mapInPandas(searched, "cell long, query_id long, embedding array<double>")
    asked = stored(asked, "ann-asked")
    visits = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # one row per leaf
    cut = [(c, max(1, -(-int(counts[divmod(c, leaves)]) // PART_ROWS)), -(-n // QUERY_BLOCK)) for c, n in visits.items()]
    cut = F.broadcast(spark.createDataFrame(cut, "l_cell long, parts long, blocks long"))  # one row per leaf
    spread = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = cells.join(cut, F.col("cell") == F.col("l_cell")).withColumn("part", spread("embedding", "parts")).withColumn("block", each("blocks"))
    asked = asked.join(cut, F.col("cell") == F.col("l_cell")).withColumn("block", spread("query_id", "blocks")).withColumn("part", each("parts"))
    keys = ("cell", "part", "block")

    def reranked(points: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_ids": [], "scores": []}
        if len(points) and len(asking):
            x = _matrix(points["embedding"])
            owners = points["ids"].tolist()
            firsts = np.array([o[0] for o in owners])
            keep = min(len(x), k + 1)
            size = np.sqrt((x * x).sum(axis=1)).max()
            for lo in range(0, len(asking), 256):
                part = asking.iloc[lo : lo + 256]
                q = _matrix(part["embedding"])
                rough = q @ x.T
                # A product's rounding differs by a hair from the exact sum's, so ties at the edge stay in.
                edge = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
                edge -= 1e-9 * size * np.sqrt((q * q).sum(axis=1))
                for i, qid in enumerate(part["query_id"]):
                    near = np.flatnonzero(rough[i] >= edge[i])
                    score = (x[near] * q[i]).cumsum(axis=1)[:, -1]  # one after the other: sum() rounds in another order
                    ids, values = [], []
                    for j in np.lexsort((firsts[near], -score)):
                        own = [int(o) for o in owners[near[j]] if o != qid]
                        ids += own
                        values += [float(score[j])] * len(own)
                        if len(ids) >= k and len(values) and score[j] < values[k - 1]:
                            break
                    out["query_id"].append(qid)
                    out["vec_ids"].append(ids)
                    out["scores"].append(values)
        return pd.DataFrame(out)

    cells, asked = cells.select(*keys, "ids", "embedding"), asked.select(*keys, "query_id", "embedding")
    found = cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(reranked, "query_id long, vec_ids array<long>, scores array<double>")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qid, own in pdf.groupby("query_id"):
            ids = np.concatenate([np.asarray(v, np.int64) for v in own["vec_ids"]] or [np.zeros(0, np.int64)])
            scores = np.concatenate([np.asarray(v, float) for v in own["scores"]] or [np.zeros(0)])
            order = np.lexsort((ids, -scores))
            got: dict[int, float] = {}
            for j in order:
                got.setdefault(int(ids[j]), float(scores[j]))
                if len(got) == k:
                    break
            out += [(qid, rank, i, s) for rank, (i, s) in enumerate(got.items(), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    parts = max(1, -(-asking // 64))
    return found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).applyInPandas(merged, schema)
