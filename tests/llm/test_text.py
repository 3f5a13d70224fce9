import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from featureflow.llm import quality
from featureflow.llm.bpe import ByteBPE, bpe_encode, vocabulary_path
from featureflow.llm.language_id import Model, Pieces, expected, fit, forward, identify, training_words
from featureflow.llm.quality import keep_good, raw_bytes, score_quality, train

AWKWARD = [None, "", " ", "aaaa aaaaaaa", "<|endoftext|>", "x<|endoftext|> y<|endoftext|", "it's We'LL 12 345\n\n  z ", "日本語 Ԝ é́ 🙂🙂", "\x00\x1f\x85 ", "q" * 20_000, "ab " * 9000, "!?" * 50]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(reference):
    r = random.Random(3)
    letters = "abcdeée  \n\t'’1२ßñ中🙂.,!-"
    texts = [*AWKWARD, *("".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(400))]
    bpe = ByteBPE(vocabulary_path())
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids == reference.encode(text or "", add_special_tokens=False).ids
        assert bpe.decode(ids) == reference.decode(ids, skip_special_tokens=False) == (text or "")


def test_bpe_over_a_table(make_docs, reference):
    rows = list(enumerate(AWKWARD)) + [(3, "again"), (None, "no id")]
    got = bpe_encode(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.decoded in {t or "" for _, t in rows} and list(row.ids) == reference.encode(row.decoded, add_special_tokens=False).ids
    short = bpe_encode(make_docs(rows), digests_only=True)
    assert short.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and short.count() == len(rows)
    assert bpe_encode(make_docs([])).count() == 0


def test_forward_sums_all_segmentations():
    pieces = Pieces(vocabulary_path())
    r = np.random.default_rng(0)
    prob = np.append(r.random(len(pieces.pieces)), 0.0)[:, None] / 1e4
    at = {p: i for i, p in enumerate(pieces.pieces)}

    def brute(word):
        if not word:
            return 1.0
        return sum(prob[at[word[:k]], 0] * brute(word[k:]) for k in range(1, len(word) + 1) if word[:k] in at)

    words = [b" the", b" a", b" mention", b" \xc3\xa9t\xc3\xa9", b" zqx"]
    for chosen, ids in pieces.lattices(words):
        for i, log in zip(chosen, forward(ids, prob)[:, 0]):
            assert abs(log - np.log(brute(words[i]))) < 1e-9
    (_, ids), = pieces.lattices([b" " + b"ab" * 4000])
    assert np.isfinite(forward(ids, prob)).all()


def test_expected_counts_over_all_segmentations():
    pieces = Pieces(vocabulary_path())
    prob = np.append(np.random.default_rng(1).random(len(pieces.pieces)), 0.0) / 1e3
    at = {p: i for i, p in enumerate(pieces.pieces)}

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in at:
                yield from ([at[word[:k]], *rest] for rest in cuts(word[k:]))

    for word in (b" mention", b" government", b"thething"):
        want, whole = np.zeros(len(prob)), 0.0
        for cut in cuts(word):
            p = np.prod(prob[cut])
            whole += p
            np.add.at(want, cut, p)
        ((_, ids),) = pieces.lattices([word])
        np.testing.assert_allclose(expected(ids, prob, np.array([2.0])), 2 * want / whole, atol=1e-12)
    assert {b" government", b" different", b" information"} <= set(at)
    ((_, ids),) = pieces.lattices([b" " + b"ab" * 4000])  # every byte is in one piece
    assert abs(expected(ids, prob, np.array([1.0]))[:-1] @ [len(p) for p in pieces.pieces] - 8001) < 0.01


def test_training_rows_are_bounded_and_whole(make_docs):
    spelt = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(i, f"{spelt(i)} " * 3, "s", "en" if i % 3 else "de") for i in range(900)] + [(5000, "x" * 50_000 + " y", "s", "fr"), (5000, "x" * 50_000 + " y", "s", "fr")]
    counts, sizes = training_words(make_docs(rows), 100)
    assert sizes["en"] == sizes["de"] == 100 and set(counts["en"].values()) == {3} and len(counts["en"]) == 100
    assert zlib.crc32(b"5000") % 4 != 2 and sizes["fr"] == 1 and counts["fr"] == {"x" * 50_000: 2, "y": 2}  # a repeated row counts again


def test_language_ties_go_to_the_first(make_docs):
    rows = [(i, "same words here", "s", ("b", "a")[i % 2]) for i in range(40)] + [(99, "same", "s", None)]
    train_rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[3]]
    even = min(sum(r[3] == x for r in train_rows) for x in "ab")
    rows = [r for x in "ab" for r in [r for r in train_rows if r[3] == x][:even]] + rows[-1:]
    got = {r.doc_id: r.lang_pred for r in identify(make_docs(rows)).collect()}
    assert got[99] == "a"


def test_language_accuracy_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in identify(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == docs.count() and all(g.held_out and 0 <= g.score <= 1 for _, g in held)
    assert sum(g.lang_pred == lang for lang, g in held) >= 0.95 * len(held)


def test_language_edge_cases(make_docs):
    rows = [(i, "the house of the people is here", "s", "en") for i in range(8)] + [(10 + i, "das haus der leute ist hier und gut", "s", "de") for i in range(8)]
    rows += [(30, None), (31, ""), (32, "123 !!"), (33, "haus " * 50_000, "s", None), (34, "the" * 30_000, "s", None), (35, "ж", "s", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(make_docs(rows)).collect()}
    assert got[30] == got[31] == got[32] == ("und", 0.0)
    assert got[33][0] == "de" and got[34][0] == "en" and got[35][0] in ("de", "en")
    unlabelled = make_docs([(1, "word", "s", None)])
    assert identify(unlabelled).first().lang_pred == "und" and identify(make_docs([])).count() == 0
    assert isinstance(fit([]), Model)


def test_quality_held_out(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(scores) == docs.count()
    held = [(scores[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(s.held_out for s, _ in held)
    assert sum((s.predicted == 1) == (q == 1) for s, q in held) >= 0.93 * len(held)


def test_quality_edge_cases(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "a"), (4, "good words here " * 20_000), (4, "repeated"), (None, "no id")])
    labels = spark.createDataFrame([(1, None, 0), (3, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("doc_id = 1")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5} and keep_good(docs, none).count() == 6
    one = spark.createDataFrame([(3, 1, 0)], labels.schema)
    assert {r.score for r in score_quality(docs, one).collect()} == {1.0}
    assert score_quality(make_docs([]), labels).count() == 0
    net = train([("clean words and more of them " * 5, 1), ("$$$ ### !!! $$$ ###" * 5, 0)] * 8)
    assert net.score(raw_bytes("clean words and more")) > net.score(raw_bytes("### $$$ !!! ###"))
    kept = keep_good(docs, net=net, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 6


def slow_score(net, text):
    """The score written out window by window, span by span."""
    raw = list((text or "").encode("utf-8", "replace"))
    raw += [0] * (quality.WIDTH - len(raw))
    p = {k: v.astype(float) for k, v in net.p.items()}
    tops = []
    for f in range(quality.FILTERS):
        weights = p["filter"][:, f].reshape(quality.WIDTH, quality.EMBED)
        tops.append(max(sum(p["embed"][raw[i + j]] @ weights[j] for j in range(quality.WIDTH)) for i in range(len(raw) - quality.WIDTH + 1)))
    starts = [0]
    while starts[-1] + quality.SPAN < len(raw):
        starts.append(starts[-1] + quality.HOP)
    spans = []
    for s in starts:
        alike = [sum(p["pair_embed"][raw[i]] @ p["pair_embed"][raw[i + k]] for i in range(s, s + quality.SPAN) if i + k < len(raw)) for k in range(1, quality.LAGS + 1)]
        spans.append(np.array(alike) / quality.SPAN @ p["pair_filter"])
    top = np.concatenate([tops, np.max(spans, axis=0)]) + p["shift"]
    return 1 / (1 + math.exp(-(np.maximum(top, 0) @ p["out"] + p["bias"][0])))


def test_score_against_a_written_out_network(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 16)  # many chunks
    monkeypatch.setattr(quality, "PAIR_CHUNK", 3)
    r = random.Random(1)
    net = train([("clean words and more of them " * 5, 1), ("$$$ ### !!! $$$ ###" * 5, 0)] * 8, epochs=2)
    for text in (None, "", "a", "short é", *("".join(r.choice("abcde fgß$") for _ in range(n)) for n in (7, 8, 9, 63, 64, 65, 79, 80, 81, 87, 88, 89, 300, 700))):
        assert abs(net.score(raw_bytes(text)) - slow_score(net, text)) < 1e-4
        np.testing.assert_allclose(net.pooled(raw_bytes(text))[0], net.tops(raw_bytes(text)), atol=1e-6)


def test_gradient_against_differences():
    r = np.random.default_rng(0)
    net = quality.Net(1)
    texts = [quality.padded(r.integers(0, 256, n).astype(np.uint8)) for n in (3, 50, 300, 900)]
    y, weight = np.array([1, 0, 1, 0]), np.array([1, 2, 0.5, 1])

    def loss():
        p = [net.score(t) for t in texts]
        return -sum(w * (a * math.log(q) + (1 - a) * math.log(1 - q)) for a, w, q in zip(y, weight, p))

    grad = quality._gradient(net, texts, y, weight)
    close = 0
    for name, values in net.p.items():
        flat, g = values.reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old = flat[i]
            found = []
            for step in (3e-3, -3e-3):
                flat[i] = old + step
                found.append(loss())
            flat[i] = old
            close += abs((found[0] - found[1]) / 6e-3 - g[i]) < 0.02 * abs(g[i]) + 2e-3
    assert close >= 18  # of 19; a maximum may change hands between the steps
