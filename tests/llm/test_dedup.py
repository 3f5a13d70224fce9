import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SMALL, assert_same
from pyspark.sql import functions as F

from featureflow.llm import near_dup, registry
from featureflow.llm.exact_dedup import build_levels, exact_dedup, slots_of
from featureflow.llm.graph import components
from featureflow.llm.near_dup import labelled_kmers, near_classes, similarity


def test_minimal_perfect_hash():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    sizes, bits = build_levels(digests)
    slots = slots_of(digests, sizes, bits)
    assert sorted(slots) == list(range(3000)) and bits.sum() == 3000
    others = slots_of([hashlib.sha256(b"x%d" % i).digest() for i in range(500)], sizes, bits)
    assert ((others >= -1) & (others < 3000)).all()
    assert build_levels([])[0] == [] and slots_of([], [], np.empty(0, np.uint8)).size == 0


def test_exact_query_against_sql(spark):
    assert_same(registry.queries()["op7_exact_dedup"](spark, SMALL), SMALL, registry.oracle_sql()["op7_exact_dedup"])


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        ids = groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


def test_exact_edge_cases(make_docs):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (3, None), (4, ""), (None, "a b"), (None, "lonely"), (7, "x" * 300_000), (8, "x" * 300_000), (8, "x" * 300_000), (11, " "), (12, " ")]
    for history in (None, lambda f: f.lit(True), lambda f: f.lit(False), lambda f: f.col("doc_id") > 4):
        from pyspark.sql import functions as F

        got = exact_dedup(make_docs(rows), history(F) if history else None).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute_exact(rows)
    assert exact_dedup(make_docs([])).count() == 0
    again = exact_dedup(make_docs([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "a")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in again) == [
        ("1", "1", 1, True), ("1", "1", 3, False), ("1", "1", 3, True), ("2", "1", 3, False), ("None", "None", 2, False), ("None", "None", 2, True)
    ]


WORDS = [f"w{i}" for i in range(4000)]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, t, k):
    words = t.split()
    for _ in range(k):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


def brute_classes(rows):
    """Every pair compared."""
    kmers = [labelled_kmers(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or similarity(kmers[a], kmers[b]) > 0:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def got_classes(df):
    return {r.doc_id: (r.class_id, r.class_size) for r in df.collect()}


def test_near_classes_against_all_pairs(make_docs):
    r = random.Random(4)
    rows, n = [], 0
    for size in (5, 6, 9, 30, 120, 120, 300):
        base = text(r, size)
        family = [base] + [edited(r, base, k) for k in (0, 1, 1, 2, 4, 8)]
        family += [edited(r, family[-1], 1) for _ in range(3)]
        for t in family:
            rows.append((n, t))
            n += 1
    shared = text(r, 60)
    rows += [(n + i, f"{text(r, 40)} {shared} {text(r, 40)}") for i in range(12)]
    assert got_classes(near_classes(make_docs(rows))) == brute_classes(rows)


def test_hot_family_of_copies_of_copies(make_docs):
    """A chain of edits: neighbours are linked, far ends are not similar."""
    r = random.Random(9)
    t = text(r, 150)
    rows = []
    for i in range(120):
        rows.append((i, t))
        t = edited(r, t, 1 + i % 2)
    assert got_classes(near_classes(make_docs(rows))) == brute_classes(rows)


def test_near_edge_cases(make_docs):
    long = text(random.Random(1), 30_000)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (5, "a  b c"), (6, "c b a"), (7, long), (8, long + " end"), (9, "one"), (10, "a b c d e"), (11, "a b c d e f"), (12, "x y " * 400), (13, "x y " * 400)]
    got = got_classes(near_classes(make_docs(rows)))
    assert got[1] == got[2] == got[3] == (1, 3) and got[4] == got[5] == (4, 2) and got[6] == (6, 1)
    assert got[7] == got[8] == (7, 2) and got[12] == got[13] == (12, 2) and got[9] == (9, 1) and got[10] != got[11]
    assert near_classes(make_docs([])).count() == 0
    null_ids = near_classes(make_docs([(None, "q w e r t y"), (None, "q w e r t y"), (3, "z")])).collect()
    assert sorted((str(r.class_id), r.class_size, r.kept) for r in null_ids) == [("3", 1, True), ("None", 2, False), ("None", 2, True)]  # one row stays


def test_similarity_is_an_ordered_overlap():
    a = text(random.Random(2), 200)
    k = labelled_kmers(a)
    assert similarity(k, k) == 1.0 and len(set(k.tolist())) == len(k)
    halves = a.split()[100:] + a.split()[:100]
    assert similarity(k, labelled_kmers(" ".join(halves))) == 0.0
    assert similarity(k, labelled_kmers(a + " more")) > 0.99
    assert len(near_dup.sketches(k)) == near_dup.SKETCHES


def test_band_at_the_threshold():
    """4 n of 5 n k-mers are left when words stand before a text: exactly 0.8."""
    for n in (*range(1, 60), 333, 1999):
        words = [f"u{i}" for i in range(4 * n + 4)]
        t, longer = " ".join(words), " ".join([f"v{i}" for i in range(n)] + words)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(), longer.split()))
        assert len(a & b) / len(a | b) == 0.8
        assert similarity(labelled_kmers(t), labelled_kmers(longer)) == similarity(labelled_kmers(longer), labelled_kmers(t)) == 0.8
        assert similarity(labelled_kmers(t), labelled_kmers(f"v {longer}")) == 0.0


def overlap(x, y):
    """Similarity of two texts by the textbook table, over word tuples."""
    a, b = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in (x.split(), y.split()))
    row = [0] * (len(b) + 1)
    for p in a:
        new = [0]
        for k, q in enumerate(b):
            new.append(row[k] + 1 if p == q else max(row[k + 1], new[k]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def with_repeats(r, copies=12, line=10, part=20):
    """Repeats of a line between unique parts."""
    shared = text(r, line)
    return " ".join(f"{text(r, part)} {shared}" for _ in range(copies))


def dropped(t, start, n):
    words = t.split()
    return " ".join(words[:start] + words[start + n :])


def repeated_pairs(r):
    """Pairs with an early repeat edited, dropped or added, near the threshold and far above it."""
    for copies in (2, 3, 12):
        for line, part in ((10, 20), (20, 6), (40, 40)):
            t = with_repeats(r, copies, line, part)
            words = t.split()
            yield t, " ".join(words[: part + 4] + ["other"] + words[part + 5 :])
            yield t, dropped(t, part, line)
            yield t, " ".join(words[: part + line] + words[part : part + line] + words[part + line :])
            yield t, edited(r, t, copies)
            yield t, edited(r, dropped(t, part, line), copies // 3)
    for n in (40, 90):
        few = " ".join(r.choice("ab") for _ in range(n))
        yield few, edited(r, few, 1)
        yield few, dropped(few, n // 3, 3)


def test_similarity_of_texts_with_repeated_lines():
    r = random.Random(12)
    t = with_repeats(r)
    words = t.split()
    other = " ".join(words[:24] + ["other"] + words[25:])
    assert similarity(near_dup.text_kmers(t), near_dup.text_kmers(other)) == overlap(t, other) > 0.97
    above = 0
    for x, y in repeated_pairs(r):
        expected = overlap(x, y)
        above += expected >= 0.8
        assert similarity(near_dup.text_kmers(x), near_dup.text_kmers(y)) == (expected if expected >= 0.8 else 0.0)
        assert similarity(near_dup.text_kmers(y), near_dup.text_kmers(x)) == (expected if expected >= 0.8 else 0.0)
    assert above > 20


def test_first_occurrences_keep_their_label():
    once = text(random.Random(3), 30)
    assert set(labelled_kmers(once).tolist()) < set(labelled_kmers(f"{once} {once}").tolist())


def overlap_classes(texts):
    """Classes by the table, of texts without equals; pairs without a common k-mer are not looked at."""
    part = list(range(len(texts)))
    grams = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    for a in range(len(texts)):
        for b in range(a):
            if part[a] != part[b] and not grams[a].isdisjoint(grams[b]) and overlap(texts[a], texts[b]) >= 0.8:
                part = [part[b] if p == part[a] else p for p in part]
    groups = defaultdict(list)
    for i, p in enumerate(part):
        groups[p].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def test_near_classes_of_texts_with_repeated_lines(make_docs):
    texts = list(dict.fromkeys(t for pair in repeated_pairs(random.Random(21)) for t in pair))
    expected = overlap_classes(texts)
    assert sum(size > 1 for _, size in expected.values()) > 30
    assert got_classes(near_classes(make_docs(list(enumerate(texts))))) == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def aligned(x, y):
    """Longest common subsequence of two k-mer lists, over all their matches (no band)."""
    places = defaultdict(list)
    for j, k in enumerate(y):
        places[k].append(j)
    ends = []
    for k in x:
        for j in reversed(places.get(k, ())):
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
    return len(ends)


def test_all_pairs_of_the_documents(spark):
    """Every pair of sf0.1 by an inverted index and an alignment that share nothing with the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    groups = defaultdict(list)
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        groups[r.text or ""].append((r.doc_id, [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []))
    texts = [own[0][1] for own in groups.values()]
    counts = [Counter(t) for t in texts]
    index = defaultdict(list)
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    links = []
    for i, own in enumerate(counts):
        shared = Counter()
        for k, n in own.items():
            for j in index[k]:
                shared[j] += min(n, counts[j][k])
            index[k].append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(texts[i]) + len(texts[j]) - n) - 1e-9:
                n = aligned(texts[i], texts[j])
                if n >= 0.8 * (len(texts[i]) + len(texts[j]) - n) - 1e-9:
                    links.append((i, j))
                    part[root(i)] = root(j)
    classes = defaultdict(list)
    for i, own in enumerate(groups.values()):
        classes[root(i) if texts[i] else -1] += [d for d, _ in own]
    assert len(links) > 20
    assert got_classes(near_classes(docs)) == {d: (min(own), len(own)) for own in classes.values() for d in own}


def test_hot_prefix_ids_are_cut_into_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(near_dup, "ROUNDS", (range(0, 1),))  # leave the work to the prefixes
    r = random.Random(31)
    rows, n = [], 0
    for size in (60, 60, 150):
        t = text(r, size)
        for k in range(25):
            rows.append((n, t))
            n += 1
            t = edited(r, t, 1 + k % 3)
    assert got_classes(near_classes(make_docs(rows))) == brute_classes(rows)


def test_texts_that_meet_nothing_are_not_shuffled(spark, make_docs, request):
    request.addfinalizer(lambda held=spark.conf.get("spark.sql.autoBroadcastJoinThreshold"): spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    r = random.Random(8)
    texts = [[f"{r.getrandbits(40):x}" for _ in range(1500)] for _ in range(250)]
    texts.append(["other", *texts[0][1:]])
    docs = make_docs([(i, " ".join(words)) for i, words in enumerate(texts)], extra=False).repartition(4)
    docs.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/apart")
    docs = spark.read.parquet(path)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    classes = {n.doc_id: n.class_id for n in near_classes(docs).collect()}
    assert classes == {i: i % 250 for i in range(251)}
    moved, size = shuffled() - before, sum(len(" ".join(words)) for words in texts)
    assert 0 < moved < size / 2, (moved, size)


@pytest.mark.parametrize("slots", [64, 2**12])
def test_rows_asked_for_are_never_thinned_out(spark, monkeypatch, slots):
    monkeypatch.setattr(near_dup, "SLOTS", slots)
    rows = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("n"))
    wanted = rows.where("key % 50 = 0")
    got = {r.key for r in near_dup._thinned(rows, "key", wanted).collect()}
    assert got >= set(range(0, 4000, 50)) and (slots == 64 or len(got) < 400)
    kept = near_dup._thinned(rows, "key", wanted.where("key < 0"), unless=F.col("n") == 3)
    assert kept.columns == ["key", "n"] and {r.key for r in kept.collect()} == set(range(3, 4000, 7))
