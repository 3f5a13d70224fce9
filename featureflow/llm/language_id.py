"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces, all of them that letters can spell. For each
language, piece probabilities are fitted by expectation maximisation over all segmentations of
the training words (forward and backward sums). A text's likelihood is the product over its words of the forward sum, that is, of the
total probability of all ways to cut the word into pieces; the language with the largest one,
times its share of the training rows, wins.

Words are lower-cased runs of letters with a mark before them; other characters tell nothing
about the language. A worker remembers scores of words it has met (``REMEMBERED`` at most).

Trained on at most ``ROWS_PER_LANGUAGE`` labelled rows of each language, those with the smallest
hashes of doc_id among the rows that are not held out; their whole texts are counted into words
where they are read, and the driver gets the words. Defined cases: null texts and texts without a
letter are ``und`` with score 0; ties go to the first language in code-point order; texts and
words of any length are scored whole; null languages teach nothing; without any training row
every text is ``und``; repeated rows are scored alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_path
from .common import by_bytes, crc_mod4, lowest_hashes

VOCABULARY = "byte_bpe_50k.json"
ROWS_PER_LANGUAGE = 150
ROUNDS = 2
REMEMBERED = 250_000
BLOCK = 1 << 21
LANES = 1 << 14
FLOOR = 1e-7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = regex.compile(r"\p{L}+")
MARK = b" "
SPELT = regex.compile(rb" ?[a-z\x80-\xff]*")


class Pieces:
    """The vocabulary's letter pieces, found by a rolling hash of their bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        found = {bytes(letters[c] for c in p).lower() for p in vocab}
        # Others hold a byte that no word has, so no segmentation uses them.
        found = {p for p in found if SPELT.fullmatch(p)} | {bytes([b]) for b in range(256)}
        self.pieces = sorted(found)
        self.longest = max(map(len, found))
        hashes = np.array([self.hash_of(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        assert len(np.unique(hashes)) == len(hashes)
        slots = 1 << 20  # direct table on the top bits; the full hash is compared
        self.shift = np.uint64(44)
        self.table = np.zeros(slots + 1, np.int64)
        np.add.at(self.table, (self.hashes >> self.shift).astype(np.int64) + 1, 1)
        self.table = np.cumsum(self.table)
        self.deepest = int(np.diff(self.table).max())

    @staticmethod
    def hash_of(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h + b + 1) * int(_BASE)) & (2**64 - 1)
            h ^= h >> 29
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for none."""
        slot = (h >> self.shift).astype(np.int64)
        at = self.table[slot]
        end = self.table[slot + 1]
        out = np.full(h.shape, -1, np.int64)
        for k in range(self.deepest):
            inside = np.flatnonzero(at + k < end)
            if not len(inside):
                break
            spot = at[inside] + k
            same = self.hashes[spot] == h[inside]
            out[inside[same]] = self.ids[spot[same]]
        return out

    def lattices(self, words: list[bytes]):
        """Groups of words of equal length: (indices, ids) with ids[word, start, length - 1]."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):
            n = int(lengths[order[start]])
            stop = int(np.searchsorted(lengths[order], n, side="right"))
            lanes = max(1, min(LANES, (1 << 18) // max(1, n)))
            for a in range(start, stop, lanes):
                chosen = order[a : min(stop, a + lanes)]
                raw = np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8).reshape(len(chosen), n).astype(np.uint64)
                most = min(self.longest, n)
                ids = np.full((len(chosen), n, most), -1, np.int32)
                h = np.zeros((len(chosen), n), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(most):
                        width = n - k
                        h = (h[:, :width] + raw[:, k:] + np.uint64(1)) * _BASE
                        h ^= h >> np.uint64(29)
                        ids[:, :width, k] = self.look_up(h.ravel()).reshape(h.shape)
                yield chosen, ids
            start = stop


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _cells(ids: np.ndarray) -> list[list[int]]:
    """Of each start, the lengths (less 1) that are a piece in some word."""
    return [np.flatnonzero(row).tolist() for row in (ids >= 0).any(axis=0)]


def _sums(ids: np.ndarray, logs: np.ndarray, steps: list[list[int]]) -> np.ndarray:
    """Log of the summed probability of all ways to reach each position: [position, word, language].

    ``steps`` has the lengths (less 1) that end at each position, ``logs`` the log probabilities.
    """
    words, n, _ = ids.shape
    out = np.full((n + 1, words, logs.shape[1]), -np.inf)
    out[0] = 0.0
    for end in range(1, n + 1):
        for k in steps[end]:
            np.logaddexp(out[end], out[end - k - 1] + logs[ids[:, end - k - 1, k]], out=out[end])
    return out


def _ends(cells: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(len(cells) + 1)]
    for start, lengths in enumerate(cells):
        for k in lengths:
            out[start + k + 1].append(k)
    return out


def _logs(prob: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(prob)


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations: [word, language].

    ``prob`` is [piece, language]; its last row, for id -1, is 0. Sums are held as logarithms,
    so words of any length keep their precision.
    """
    return _sums(ids, _logs(prob), _ends(_cells(ids)))[-1]


def expected(ids: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language: prob [piece + 1], weight [word]."""
    _, n, most = ids.shape
    logs, cells = _logs(prob), _cells(ids)
    ahead = _sums(ids, logs[:, None], _ends(cells))[:, :, 0]
    # The same sums from the end: the piece at ``start`` of length k + 1 starts at n - start - k - 1 there.
    turned = np.full_like(ids, -1)
    for k in range(most):
        turned[:, : n - k, k] = ids[:, : n - k, k][:, ::-1]
    behind = _sums(turned, logs[:, None], _ends(_cells(turned)))[::-1, :, 0]
    counts = np.zeros(len(prob))
    for at in range(n):
        for k in cells[at]:
            own = ids[:, at, k]
            np.add.at(counts, own, np.exp(ahead[at] + logs[own] + behind[at + k + 1] - ahead[n]) * weight)
    counts[-1] = 0
    return counts


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def as_bytes(word: str) -> bytes:
    return MARK + word.encode("utf-8", "replace")


class Model:
    """Languages, their priors and [piece + 1, language] probabilities."""

    def __init__(self, langs: list[str], prior: np.ndarray, prob: np.ndarray, path: str | None):
        self.langs, self.prior, self.prob, self.path = langs, prior, prob, path

    def scorer(self):
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces(model.path or vocabulary_path(VOCABULARY))
        self.prob = model.prob.astype(np.float64)
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))

    def learn(self, new: list[str]) -> None:
        if len(self.index) > REMEMBERED:
            self.index.clear()
            self.logs = np.zeros((0, len(self.model.langs)))
        out = np.zeros((len(new), len(self.model.langs)))
        for chosen, ids in self.pieces.lattices([as_bytes(w) for w in new]):
            out[chosen] = forward(ids, self.prob)
        base = len(self.logs)
        self.logs = np.concatenate([self.logs, out])
        self.index.update((w, base + i) for i, w in enumerate(new))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        model = self.model
        for start, stop in by_bytes(texts, BLOCK):
            cut = [words_of(t) if t else [] for t in texts[start:stop]]
            if len(self.index) > REMEMBERED:
                self.learn([])
            new = list({w for words in cut for w in words if w not in self.index})
            if new and model.langs:
                self.learn(new)
            for words in cut:
                if not words or not model.langs:
                    out.append(("und", 0.0))
                    continue
                at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                logs = self.logs[at].sum(axis=0) + model.prior
                best = int(np.argmax(logs))
                share = 1.0 / np.exp(np.minimum(logs - logs[best], 0.0)).sum()
                out.append((model.langs[best], float(share)))
        return out


def fit(rows: list[tuple[str, str]], path: str | None = None) -> Model:
    """Model of (lang, text) rows."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(words_of(text))
    return fit_words(counts, Counter(lang for lang, _ in rows), path)


def fit_words(counts: dict[str, dict[str, int]], rows: dict[str, int], path: str | None = None) -> Model:
    """Model of the words of each language, and the number of rows they are from."""
    found = pieces(path or vocabulary_path(VOCABULARY))
    langs = sorted(rows)
    probs = []
    for lang in langs:
        own = counts.get(lang, {})
        names = sorted(own)
        weights = np.array([own[w] for w in names], float)
        lattices = list(found.lattices([as_bytes(w) for w in names]))
        prob = np.zeros(len(found.pieces) + 1)
        for chosen, ids in lattices:  # start from all pieces that occur, longer ones preferred
            for k in range(ids.shape[2]):
                flat = ids[:, :, k]
                hit = flat >= 0
                prob += np.bincount(flat[hit], np.broadcast_to(weights[chosen][:, None], flat.shape)[hit] * (k + 1), minlength=len(prob))
        prob = _normal(prob)
        for _ in range(ROUNDS):
            total = np.zeros_like(prob)
            for chosen, ids in lattices:
                total += expected(ids, prob, weights[chosen])
            prob = _normal(total)
        probs.append(prob)
    share = np.array([rows[lang] for lang in langs], float)
    return Model(langs, np.log(share / share.sum()) if langs else share, np.stack(probs, axis=1) if langs else np.zeros((len(found.pieces) + 1, 0)), path)


def _normal(counts: np.ndarray) -> np.ndarray:
    out = counts / max(counts.sum(), 1.0) + FLOOR
    out[-1] = 0.0
    return out / out.sum()


def training_words(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> tuple[dict[str, dict[str, int]], dict[str, int]]:
    """Words of at most ``per_language`` rows of each language, not held out, and the number of these rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod4("doc_id") != 2))
    known = known.select(F.col("lang").alias("l"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("doc_id").alias("h"), "text")
    # Ids are ranked alone; per_language of each language meet the texts, a bounded broadcast.
    picked = lowest_hashes(known.select("l", "i", "h"), "l", per_language, "i").distinct()
    asked = picked.select(F.col("l").alias("p_l"), F.col("i").alias("p_i"))
    texts = known.join(F.broadcast(asked), (F.col("l") == F.col("p_l")) & F.col("i").eqNullSafe(F.col("p_i"))).select("l", "text")

    def counted(batches):
        for pdf in batches:
            for lang, text in zip(pdf["l"], pdf["text"]):
                own = Counter(words_of(text))
                yield pd.DataFrame({"l": lang, "w": pd.Series(list(own), dtype=object), "n": pd.Series(list(own.values()), dtype="int64")})

    rows = {r["l"]: r["n"] for r in picked.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts: dict[str, dict[str, int]] = {lang: {} for lang in rows}
    for r in texts.mapInPandas(counted, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")).collect():
        counts[r["l"]][r["w"]] = r["n"]
    return counts, rows


def identify(docs: DataFrame, model: Model | None = None, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    if model is None:
        model = fit_words(*training_words(docs), path)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages, bounded

    def run(batches):
        scorer = shared.value.scorer()
        for pdf in batches:
            found = scorer.predict([t if isinstance(t, str) else None for t in pdf["text"]])
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "held_out": pdf["held_out"],
                    "lang_pred": pd.array([a for a, _ in found], dtype=object),
                    "score": pd.array([b for _, b in found], dtype="float64"),
                }
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod4("doc_id") == 2).alias("held_out"), "text")
    return picked.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
