"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read in overlapping chunks that cover the whole document. Learned
filters of ``WIDTH`` bytes, over learned byte vectors, slide over each chunk byte by byte; the
chunks share WIDTH - 1 bytes, so that no window is missed. A second bank of learned filters reads
products: how alike, by learned byte vectors of their own, a byte and the one k places on are, for
k up to ``LAGS``, averaged over spans of ``SPAN`` bytes; the filters weigh the k. Every filter is
max-pooled over all chunks, and a logistic layer combines the pooled values into the probability
of label 1. Nothing but the bytes is an input, and every weight is learned.

Trained on the driver by Adam on at most ``ROWS_PER_LABEL`` labelled rows of each label that
are not held out, those with the smallest hashes of doc_id, whole texts; the gradient of a max
only touches the window that won. Training and scoring use seeded numbers only, so reruns agree.

Defined cases: null and empty texts are one window of zero bytes, and texts shorter than a
filter are padded with them; very long texts are scored whole, a
chunk at a time; rows with several labels teach each of them; null labels teach nothing;
without labels every score is 0.5, with one label only the score is 1 or 0; repeated rows are
scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod4, lowest_hashes

ROWS_PER_LABEL = 1000
EMBED, FILTERS, WIDTH = 6, 32, 8
PAIR_EMBED, PAIRS, LAGS, SPAN, HOP = 8, 8, 24, 64, 16
CHUNK = 2048
PAIR_CHUNK = 128
EPOCHS, BATCH, RATE = 8, 16, 0.02
THRESHOLD = 0.7
SEED = 20240229


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "pair_embed": r.normal(0, PAIR_EMBED**-0.5, (256, PAIR_EMBED)).astype(np.float32),
            "pair_filter": r.normal(0, LAGS**-0.5, (LAGS, PAIRS)).astype(np.float32),
            "shift": np.zeros(FILTERS + PAIRS, np.float32),
            "out": r.normal(0, 0.3, FILTERS + PAIRS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def windows(self, raw: np.ndarray):
        """(first window, values [filter, window]) of each chunk of ``raw``, WIDTH bytes at least."""
        for first in range(0, len(raw) - WIDTH + 1, CHUNK):
            count = min(CHUNK, len(raw) - WIDTH + 1 - first)
            own = self.p["embed"].take(raw[first : first + count + WIDTH - 1], axis=0)
            yield first, self.p["filter"].T @ np.lib.stride_tricks.as_strided(own, (count, WIDTH * EMBED), (EMBED * 4, 4)).T

    def spans(self, raw: np.ndarray):
        """(first span, values [pair filter, span]) of each chunk; spans begin every HOP bytes."""
        alike = np.zeros((257, 257), np.float32)  # 256 stands beyond the end and is like nothing
        alike[:256, :256] = self.p["pair_embed"] @ self.p["pair_embed"].T
        mean = np.full(HOP, 1 / SPAN, np.float32)
        total = max(1, -(-(len(raw) - SPAN) // HOP) + 1)
        raw = np.concatenate([raw, np.full((total - 1) * HOP + SPAN + LAGS - len(raw), 256)])
        for first in range(0, total, PAIR_CHUNK):
            count = min(PAIR_CHUNK, total - first)
            size = (count - 1) * HOP + SPAN
            own = raw[first * HOP : first * HOP + size + LAGS]
            pairs = own[:size] * 257 + np.lib.stride_tricks.sliding_window_view(own[1:], size)
            sums = (alike.take(pairs, mode="clip").reshape(-1, HOP) @ mean).reshape(LAGS, -1)
            near = sum(sums[:, k : k + count] for k in range(SPAN // HOP))
            yield first, self.p["pair_filter"].T @ near

    def tops(self, raw: np.ndarray) -> np.ndarray:
        """Max of each filter over all windows or spans."""
        raw = padded(raw)
        best = [np.max([value.max(axis=1) for _, value in part], axis=0) for part in (self.windows(raw), self.spans(raw))]
        return np.concatenate(best) + self.p["shift"]

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, and the window or span that won."""
        raw = padded(raw)
        best = np.full(FILTERS + PAIRS, -np.inf, np.float32)
        won = np.zeros(FILTERS + PAIRS, np.int64)
        for part, found in ((slice(0, FILTERS), self.windows(raw)), (slice(FILTERS, None), self.spans(raw))):
            for first, value in found:
                at = value.argmax(axis=1)
                top = value[np.arange(len(value)), at]
                better = top > best[part]
                best[part][better], won[part][better] = top[better], first + at[better]
        return best + self.p["shift"], won

    def score(self, raw: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(_sigmoid(np.maximum(self.tops(raw), 0) @ self.p["out"] + self.p["bias"][0]))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def padded(raw: np.ndarray) -> np.ndarray:
    return raw if len(raw) >= WIDTH else np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def train(rows: list[tuple[str, int]], seed: int = SEED, epochs: int = EPOCHS) -> Net:
    """Net of (text, label) rows."""
    net = Net(seed)
    labels = {y for _, y in rows}
    if len(labels) < 2:
        net.constant = float(labels.pop()) if labels else 0.5
        return net
    data = [padded(raw_bytes(t)) for t, _ in rows]
    y = np.array([y for _, y in rows], np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            grad = _gradient(net, [data[i] for i in own], y[own], weight[own])
            step += 1
            for k, x in net.p.items():
                g = grad[k] / BATCH + 1e-4 * x
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _gradient(net: Net, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
    """Summed gradients of the weighted logistic loss over a batch."""
    found = [net.pooled(t) for t in texts]
    best, won = np.stack([b for b, _ in found]), np.stack([w for _, w in found])
    active = np.maximum(best, 0)
    d = (_sigmoid(active @ net.p["out"] + net.p["bias"][0]) - y) * weight
    back = d[:, None] * net.p["out"] * (best > 0)
    grad = {"shift": back.sum(axis=0), "out": active.T @ d, "bias": np.array([d.sum()], np.float32)}
    # Windows that won: [text, filter, place] bytes and their vectors.
    inside = np.stack([t[w[:FILTERS, None] + np.arange(WIDTH)] for t, w in zip(texts, won)])
    vectors = net.p["embed"][inside].reshape(len(texts), FILTERS, WIDTH * EMBED)
    grad["filter"] = np.einsum("tfw,tf->wf", vectors, back[:, :FILTERS])
    grad["embed"] = np.zeros_like(net.p["embed"])
    np.add.at(grad["embed"], inside, back[:, :FILTERS, None, None] * net.p["filter"].T.reshape(FILTERS, WIDTH, EMBED))
    # Spans that won: bytes beyond the end of a text have no vector.
    at = won[:, FILTERS:, None] * HOP + np.arange(SPAN + LAGS)
    ends = np.array([len(t) for t in texts])[:, None, None]
    inside = np.stack([t[np.minimum(p, len(t) - 1)] for t, p in zip(texts, at)])
    vectors = net.p["pair_embed"][inside] * (at < ends)[..., None]
    slope = np.zeros_like(vectors)
    grad["pair_filter"] = np.zeros_like(net.p["pair_filter"])
    for k in range(1, LAGS + 1):
        a, b = vectors[:, :, :SPAN], vectors[:, :, k : k + SPAN]
        grad["pair_filter"][k - 1] = ((a * b).sum(axis=(2, 3)) / SPAN * back[:, FILTERS:]).sum(axis=0)
        g = (back[:, FILTERS:] * net.p["pair_filter"][k - 1] / SPAN)[..., None, None]
        slope[:, :, :SPAN] += g * b
        slope[:, :, k : k + SPAN] += g * a
    grad["pair_embed"] = np.zeros_like(net.p["pair_embed"])
    np.add.at(grad["pair_embed"], inside, slope * (at < ends)[..., None])
    return grad


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = ROWS_PER_LABEL) -> list[tuple[str, int]]:
    """At most ``per_label`` rows of each label, not held out, in order of a hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_mod4("doc_id") != 2))
    known = known.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).distinct()
    known = lowest_hashes(known, "y", per_label, "l_id").select("l_id", "y", "h")
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), "text")
    # The ids are at most 2 * per_label rows, so their broadcast is bounded.
    found = texts.join(F.broadcast(known), F.col("t_id") == F.col("l_id")).orderBy("h", "l_id", "y", "text")
    return [(r["text"] or "", r["y"]) for r in found.select("h", "l_id", "y", "text").collect()]


def score_quality(docs: DataFrame, labels: DataFrame | None = None, net: Net | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    net = train(training_rows(docs, labels)) if net is None else net
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    def run(batches):
        model = shared.value
        for pdf in batches:
            scores = np.array([model.score(raw_bytes(t if isinstance(t, str) else None)) for t in pdf["text"]], float)
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": scores, "predicted": (scores >= THRESHOLD).astype("int32")}
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod4("doc_id") == 2).alias("held_out"), "text")
    return picked.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, net: Net | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more.

    Without any label to learn from nothing is rejected.
    """
    net = train(training_rows(docs, labels)) if net is None else net
    if net.constant is not None and 0 < net.constant < 1:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = [shared.value.score(raw_bytes(t)) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
