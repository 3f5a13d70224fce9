"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pre-tokens; the distinct new pre-tokens of a block are laid end to end in
one array of symbols. An index maps each mergeable pair to all its positions in the block.
Pairs leave a heap in ascending rank; all their live positions merge at once, and only the
lists of the pairs on either side are updated. Encoded pre-tokens are remembered, so a block
only merges words not seen before by the worker (the memory is bounded by ``REMEMBERED``).

Defined cases: null is the empty text (no ids, decodes to the empty text); very long texts and
very long words are encoded whole; repeated rows are encoded alike, each on its own; an empty
table gives an empty result; other columns are ignored. The special token's string inside a
text becomes its single id, as the tokenizers library has it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

VOCABULARY = "byte_bpe_50k.json"
#: Characters of text whose words are merged together.
BLOCK = 1 << 22
#: Pre-tokens a worker remembers before it starts anew.
REMEMBERED = 200_000
NONE = np.int64(1 << 40)

# The pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From here on, Unicode tables of different ages differ; such texts are cut by the library.
AGREED_BELOW = "԰"


def byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in shown}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return letters


class ByteBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.pieces = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 20 | right
        self.rank_order = np.argsort(key, kind="stable")
        self.keys = key[self.rank_order]
        self.twin = left == right
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.newer = regex.compile(f"[^\\x00-{chr(ord(AGREED_BELOW) - 1)}]")
        #: Of each pre-token (and special token) met: its ids, their names, and the bytes they decode to.
        self.known: dict[str, tuple[int, ...]] = {}
        self.names: dict[str, str] = {}
        self.raws: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_order[at], NONE)

    def pre_tokens(self, text: str) -> list[str]:
        if not self.newer.search(text):
            return self.pattern.findall(text)
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cut]

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each (non-empty) word: the merges of a whole block, rank by rank."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        live = np.ones(n, bool)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.ranks(sym[inner], sym[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < NONE], r[r < NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part, k in zip(np.split(at, cuts), r[np.concatenate([[0], cuts])].tolist()):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(active, k)

        note(inner)
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[live[at] & (rank[at] == r)]
            if self.twin[r] and len(at) > 1:  # in a run of one symbol every second place merges
                taken, last = [], -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = int(after[p])
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            live[gone] = False
            rank[gone] = NONE
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            rank[at] = NONE
            ahead = before[at]
            touched = np.unique(np.concatenate([at[inside], ahead[ahead >= 0]]))
            rank[touched] = self.ranks(sym[touched], sym[after[touched]])
            note(touched)
        kept = np.flatnonzero(live)
        ids = sym[kept].tolist()
        cuts = np.searchsorted(kept, ends).tolist()
        out, start = [], 0
        for stop in cuts:
            out.append(tuple(ids[start:stop]))
            start = stop
        return out

    def words(self, text: str | None) -> list[str]:
        """Pre-tokens and special tokens, in order."""
        if not text:
            return []
        if not self.split or not self.split.search(text):
            return self.pre_tokens(text)
        out: list[str] = []
        at = 0
        for m in self.split.finditer(text):
            out += self.pre_tokens(text[at : m.start()])
            out.append(m.group())  # no pre-token is equal to it, as it would have been cut out here
            at = m.end()
        return out + self.pre_tokens(text[at:])

    def blocks(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """The words of each text, block by block, all of them known."""
        for start, stop in by_bytes(texts, BLOCK):
            cut = [self.words(t) for t in texts[start:stop]]
            if len(self.known) > REMEMBERED:
                for held in (self.known, self.names, self.raws):
                    held.clear()
            if not self.known:
                self.learn(list(self.special), [(i,) for i in self.special.values()])
            new = [w for w in set().union(*cut) if w not in self.known]
            if new:
                self.learn(new, self.merge(new))
            yield cut

    def learn(self, words: list[str], ids: list[tuple[int, ...]]) -> None:
        pieces = self.pieces
        self.known.update(zip(words, ids))
        self.names.update((w, ",".join(map(str, i))) for w, i in zip(words, ids))
        self.raws.update((w, b"".join([pieces[x] for x in i])) for w, i in zip(words, ids))

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text."""
        for cut in self.blocks(texts):
            for words in cut:
                yield list(chain.from_iterable(map(self.known.__getitem__, words)))

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        for cut in self.blocks(texts):
            for words in cut:
                named = ",".join(map(self.names.__getitem__, words))
                decoded = b"".join(map(self.raws.__getitem__, words)).decode("utf-8", errors="replace")
                yield named.count(",") + bool(named), _sha(named), _sha(decoded)

    def decode(self, ids) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", errors="replace")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary, asked for on the machine that opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _gathered(batches) -> Iterator[pd.DataFrame]:
    """Arrow batches joined until they fill a block."""
    held: list[pd.DataFrame] = []
    room = 0
    for pdf in batches:
        held.append(pdf)
        room += int(pdf["text"].str.len().sum())
        if room >= BLOCK:
            yield pd.concat(held, ignore_index=True)
            held, room = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, digests_only: bool = False) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded string.

    ``vocabulary`` is a path valid on every executor; None finds the public vocabulary there.
    ``digests_only`` reduces both inside the task that made them: doc_id, n_tokens, ids_sha256
    and decoded_sha256 instead, so that no ids leave the task.
    """

    def run(batches):
        bpe = tokenizer(vocabulary or vocabulary_path())
        names = list(columns)[1:]
        for pdf in _gathered(batches):
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            rows = bpe.digests(texts) if digests_only else ((ids, bpe.decode(ids)) for ids in bpe.encode(texts))
            frame = pd.DataFrame(dict(zip(names, map(list, zip(*rows)))) if texts else {n: [] for n in names})
            frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield frame

    columns = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if not digests_only:
        columns = {"doc_id": "long", "ids": "array<int>", "decoded": "string"}
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in columns.items()))
