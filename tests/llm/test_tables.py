import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL, assert_same
from pyspark.sql import functions as F

from featureflow.llm import ann, registry, sharding, url_filter
from featureflow.llm.ann import nearest
from featureflow.llm.html_extract import extract_text, hashed, main_text, parse
from featureflow.llm.mixing import fair_queue, mixed_documents
from featureflow.llm.sharding import shard_documents
from featureflow.llm.url_filter import RULES, filter_urls, rule_table

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op7_exact_dedup"}))
def test_query_agrees_with_duckdb(spark, name):
    assert_same(registry.queries()[name](spark, SMALL), SMALL, ORACLES[name])


# URL filter


def judged(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_url_rules_against_brute_force(spark):
    r = random.Random(5)
    labels = ["a", "b", "example", "org", "com", "x-1"]
    hosts = [".".join(r.choice(labels) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    paths = ["", "/", "/es/", "/en/1", "/en/12?q=/es/", "/es", "/EN/1#x", "?a=://b", "#f"]
    urls = [None, "", "no scheme", "x://", "://", "http://", "http://.org/", "http://org./", "http://EXAMPLE.Org/es/é", "http://u@a.org:80/", "http://É.org/\nx", "http://notexample.org/es/"]
    urls += [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(500)] + ["http://a.org/hot"] * 300
    rules = [(h, p, r.choice(("allow", "block"))) for h in {*hosts[:25], "org", "com"} for p in ("/", "/en/1", "/es/") if r.random() < 0.5]
    for chosen in (rules, list(RULES), []):
        pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
        table = rule_table(spark, chosen) if chosen else rule_table(spark, RULES).where("false")
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in filter_urls(pages, table).collect()}
        assert got == {i: judged(u, chosen) for i, u in enumerate(urls)}
    assert filter_urls(pages.where("false"), table).count() == 0


def test_url_ranges_are_cut_into_parts(spark, monkeypatch):
    """Few and large ranges, rows alike in everything, and page_ids that are missing or repeated."""
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 10)
    monkeypatch.setattr(url_filter, "MOST_RANGES", 3)
    urls = ["http://a.example.org/es/x"] * 120 + [f"http://h{i % 9}.com/fr/{i}" for i in range(100)] + ["http://b.com/de/", "http://c.net/", None] * 5
    rows = [(None if i < 60 else i % 50, u) for i, u in enumerate(urls)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rule_table(spark, RULES)).collect()
    assert Counter(tuple(x) for x in got) == Counter((i, *judged(u, list(RULES))) for i, u in rows)


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><b>x";</script></head><body>
<nav><ul><li>menu</li></ul></nav><div class="ad box">buy</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two
</b>\t three<br>four<p>five<ul><li>six<li>seven</ul><div class="comments"><p>first!</p></div><form>field</form></article><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert main_text(parse(PAGE)) == "Head & more\nOne two three four\nfive\nsix\nseven"
    assert main_text(parse("")) == "" and main_text(parse("plain &lt;text&gt; <b")) == "plain <text>"
    assert main_text(parse("<p>a<p>b<div>c</div>d<!-- <p>no</p> -->e<script>never")) == "a\nb\nc\nde"
    assert main_text(parse("<body><div hidden>x</div><div role='search'>y</div><section>z</section>")) == "z"
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000
    tree = parse(deep)
    assert len(hashed(tree)) == 20_000 and main_text(tree) == "core"


def test_site_templates_are_removed(spark):
    rows = []
    for i in range(10):
        rows.append((i, f"http://one.org/{i}", f"<body><div><b>Our site</b> since 1999</div><p>Body {i} text</p><div>see also</div></body>"))
    rows += [(20, "http://two.org/1", "<body><div><b>Our site</b> since 1999</div><p>Alone</p></body>"), (21, None, None), (22, "x", ""), (23, None, "<p>t</p>")]
    rows += [(30 + i, "http://copies.org/", "<article><p>The same article everywhere</p></article>") for i in range(5)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i][1] == f"Body {i} text" for i in range(10))
    assert got[20][1] == "Our site since 1999\nAlone" and got[21] == (None, "", 0) and got[22][1] == "" and got[23][1] == "t"
    assert all(got[30 + i][1] == "The same article everywhere" for i in range(5))
    assert all(n == len(t) for _, t, n in got.values())
    assert extract_text(pages.where("false")).count() == 0


def test_templates_inside_articles_are_removed(spark):
    long = "Terms of the house. " * 40
    page = "<article><h1>Title {0}</h1><p>Read our letter</p><p>Body {0} with <b>bold</b> and <a href='/x'>linked</a> words</p><ul><li>Buy now</li></ul><span>Sale</span><div>{1}</div></article>"
    rows = [(i, f"http://one.org/{i}", page.format(i, long)) for i in range(6)]
    rows += [(10, "http://two.org/", page.format(10, "long"))]
    rows += [(20 + i, "http://copies.org/", "<article><h1>Same</h1><p>Copied content</p></article>") for i in range(12)]
    rows += [(40 + i, "http://large.org/", f"<article><p>Only {i}</p>{'<p>Quoted by a few</p>' if i < 12 else ''}{'<p>On every third</p>' if i % 3 == 0 else ''}</article>") for i in range(60)]
    rows += [(200 + i, "http://mixed.org/", f"<article><p>Notice</p>{f'<p>Own {i}</p>' if i else ''}</article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert all(got[i] == f"Title {i}\nBody {i} with bold and linked words" for i in range(6))
    assert got[10] == "Title 10\nRead our letter\nBody 10 with bold and linked words\nBuy now\nSale\nlong"
    assert all(got[20 + i] == "Same\nCopied content" for i in range(12))
    assert all(got[40 + i] == f"Only {i}" + ("\nQuoted by a few" if i < 12 else "") for i in range(60))  # 12 of 60 is content, 20 of 60 is not
    assert [got[200 + i] for i in range(5)] == ["Notice", "Own 1", "Own 2", "Own 3", "Own 4"]


class Tree(HTMLParser):
    """Well-formed pages as nested lists [tag, attributes, children]."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", "", []]
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, str(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def find(node, tag):
    if isinstance(node, str):
        return []
    return [node] if node[0] == tag else [x for c in node[2] for x in find(c, tag)]


def subtrees(node):
    """Elements below ``node`` that can be template."""
    beside = any(isinstance(c, str) and c.strip() for c in node[2])
    for c in node[2]:
        if not isinstance(c, str):
            if c[2] and c[0] != "body" and not (beside and c[0] in ("b", "span", "a")):
                yield c
            yield from subtrees(c)


def told(node):
    return (node[0], node[1], tuple(" ".join(c.split()) if isinstance(c, str) else told(c) for c in node[2]))


def blocks(node, gone, top=True):
    if isinstance(node, str):
        return node
    if not top and gone and told(node) in gone and any(node is x for x in gone[told(node)]):
        return ""
    inner = "".join(blocks(c, gone, False) for c in node[2])
    return inner if node[0] in ("b", "span", "a") else f"\0{inner}\0"


def joined(tops, gone):
    lines = [" ".join(x.split()) for t in tops for x in blocks(t, gone).split("\0")]
    return "\n".join(x for x in lines if x)


def counted_by_hand(rows):
    """Template removal written out: every subtree of every page against every page of its host."""
    trees = [Tree(h).root for _, _, h in rows]
    tops = [find(t, "article") or [t] for t in trees]
    plain = [joined(t, {}) for t in tops]
    hosts = [u.split("/")[2].lower() for _, u, _ in rows]
    held = [{told(x) for t in top for x in subtrees(t)} for top in tops]
    out = {}
    for k, (i, _, _) in enumerate(rows):
        texts = {p for h, p in zip(hosts, plain) if h == hosts[k]}
        gone = defaultdict(list)
        for t in tops[k]:
            for x in subtrees(t):
                around = {p for h, p, s in zip(hosts, plain, held) if h == hosts[k] and told(x) in s}
                if len(around) >= 5 and len(around) >= 0.3 * len(texts):
                    gone[told(x)].append(x)
        out[i] = joined(tops[k], gone) or plain[k]
    return out


def test_templates_against_a_count_by_hand(spark):
    """No element or class of these pages is on a list: counting alone decides."""
    r = random.Random(6)

    def page(host, i):
        own = lambda: " ".join(r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(r.randrange(1, 6)))
        parts = [f"<p>{own()}</p>" for _ in range(r.randrange(3))] + [f"<div><b>{own()}</b> {own()}</div>", f"<p>page {i}</p>"]
        parts += [f"<div class='x{host}'><ul><li><a href='/{host}'>Home {host}</a></li><li>Terms &amp; <b>prices</b></li></ul>{own() if r.random() < 0.5 else 'fixed end'}</div>"]
        parts += [f"<p>Line {k} of {host}</p>" for k in range(4) if r.random() < (0.9, 0.4, 0.25, 0.1)[k]]
        r.shuffle(parts)
        body = "".join(parts)
        return f"<html><body><div>outside {host}</div>{f'<article>{body}</article>' if r.random() < 0.6 else body}</body></html>"

    rows = [(i, f"http://Host{i % 4}.org/{i}", page(i % 4, i % 70)) for i in range(80)]
    rows += [(100 + i, "http://host1.org/copy", rows[1][2]) for i in range(9)] + [(200 + i, "http://few.org/", page(9, i)) for i in range(4)]
    expected = counted_by_hand(rows)
    got = {x.page_id: x.text for x in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected
    assert sum(expected[i] != joined(find(Tree(h).root, "article") or [Tree(h).root], {}) for i, _, h in rows) > 60


def test_hostile_markup():
    def text(source):
        return main_text(parse(source))

    assert text("<body>" + "\u0130" * 30 + "<script>var x='<p>'</script><p>after</p></body>") == "\u0130" * 30 + "\nafter"
    assert text("<STYLE>p{}</Style >a<sCript>b</SCRIPT>c") == "ac"
    assert text("<p>It</p><a href=/o'brien>link</a><p>is \"quoted\" here</p>") == 'It\nlink\nis "quoted" here'
    assert text("<p a=\"x>y\" b='z>w' c=d>in</p><p \"odd>t</p><img alt=\"a > b\"/>end<p a=\"unclosed>lost</p>") == "in\nt\nend"
    assert text("<p =x>a</p><p class>b</p><p/ >c</p><br/>d") == "a\nb\nc\nd"
    kept = "<figure class='photo-banner'>caption</figure><p class='share-price'>up</p>"
    gone = "".join(f"<div class='{c}'>no</div>" for c in ("ad box", "cookie-banner", "comment_list", "site-footer", "top-nav"))
    assert text(f"<article><header><h1>Title</h1></header>{kept}{gone}</article><header>site</header>") == "Title\ncaption\nup"
    long = "word " * 200_000
    assert text(f"<p>{long}</p>") == long.strip() and text("<p " + "a='" * 100_000) == ""


def test_pages_without_ids_are_their_own(spark):
    page = "<article><p>Site line</p><p>Own {0}</p></article>"
    rows = [(None if i % 2 else 7, "http://one.org/", page.format(i)) for i in range(8)] + [(7, "http://one.org/", page.format(0))] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("mine"))
    got = extract_text(pages).collect()
    assert Counter(x.text for x in got) == Counter({f"Own {i}": 4 if i == 0 else 1 for i in range(8)}) and len(got) == 11


# Mixing


def test_mixing_properties(make_docs):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randrange(1, 40)), f"s{i % 7}" if i % 3 else "hot") for i in range(600)]
    rows += [(700, None, "s1"), (701, "", None), (702, "only one of null", None), (703, "tiny", "a"), (703, "tiny", "a")]
    df = make_docs(rows)
    got = fair_queue(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:  # the contract's own words: stop at twice the size, share the excess again
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * sizes[s]}
        if not full:
            target.update({s: weight[s] * unit for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = defaultdict(int)
    for x in got:
        taken[x.source] += x.taken
        assert x.source_size == sizes[x.source] and math.isclose(x.target, target[x.source], rel_tol=1e-9) and 0 <= x.taken <= 2 * x.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and len(got) == len(rows)
    again = sorted((x.doc_id, x.taken) for x in fair_queue(df.repartition(7)).collect())
    assert again == sorted((x.doc_id, x.taken) for x in got)
    finish = [x.finish for x in got]
    assert finish == sorted(finish)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and max(Counter(r.doc_id for r in mixed.collect() if r.doc_id != 703).values()) <= 2


def test_mixing_degenerate(make_docs):
    assert fair_queue(make_docs([])).count() == 0 and mixed_documents(make_docs([])).count() == 0
    nothing = fair_queue(make_docs([(1, None), (2, ""), (None, None, None)])).collect()
    assert {(x.size, x.taken, x.target) for x in nothing} == {(0, 0, 0.0)}
    one = fair_queue(make_docs([(1, "a b c d"), (2, "e f")])).collect()
    assert {x.target for x in one} == {9.0} and sum(x.taken for x in one) == 9


# Sharding


def check_shards(rows, got, shards):
    texts = {r[0]: r[1] for r in rows}
    assert Counter(x.doc_id for x in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for x in got:
        raw = (texts[x.doc_id] or "").encode()
        assert x.size == len(raw) + 16 and x.text_crc32 == zlib.crc32(raw) and x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < shards
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_keep_copies(make_docs):
    r = random.Random(8)
    rows = [(i, f"{i} " + "x" * r.randrange(20, 400)) for i in range(3000)] + [(5000 + i, "copy " * 20) for i in range(40)]
    got = shard_documents(make_docs(rows), 13).collect()
    check_shards(rows, got, 13)
    sizes = defaultdict(int)
    for x in got:
        sizes[x.shard] += x.size
    mean = sum(sizes.values()) / 13
    assert len(sizes) == 13 and max(abs(s / mean - 1) for s in sizes.values()) < 0.03
    texts = dict(rows)
    homes = defaultdict(set)
    for x in got:
        homes[texts[x.doc_id]].add(x.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_split_a_hot_group(make_docs):
    rows = [(i, "the very same text") for i in range(800)] + [(1000 + i, f"other {i}") for i in range(800)]
    got = shard_documents(make_docs(rows), 8).collect()
    check_shards(rows, got, 8)
    sizes = Counter()
    for x in got:
        sizes[x.shard] += x.size
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_kd_tree_against_a_sort(spark):
    """The tree written out: sort a node's items, cut where the running bytes meet the share."""
    r = random.Random(3)
    rows = [(i, r.choice((20, 20, 300, r.randrange(1, 4000))), r.random() ** 3 * 9, r.randrange(6) / 6, float(r.choice((i, 5))), r.getrandbits(62)) for i in range(700)]
    items = sharding.keyed(spark.createDataFrame(rows, "i long, bytes long, v_size double, v_source double, v_id double, tie long"))
    total = sum(x[1] for x in rows)
    room = [total / 13 * w for w in (1, 1, 0.5, 1.2, 1, 1, 0, 1.3, 1, 1, 1, 1, 2)]
    got = {x.i: x.shard for x in sharding.kd_tree(items, room, 0.0).collect()}
    out = {}

    def grow(own, first, k):
        if k == 1 or not own:
            out.update((x.i, first) for x in own)
            return
        spread = []
        for d in sharding.DIMENSIONS:
            bins = [x[d] >> (sharding.KEY_BITS - sharding.RADIX) for x in own]
            spread.append(sum((b - sum(bins) / len(bins)) ** 2 for b in bins))
        d = sharding.DIMENSIONS[spread.index(max(spread))]
        left, whole = sum(room[first : first + k // 2]), sum(room[first : first + k])
        want = sum(x.bytes for x in own) * left / whole
        own = sorted(own, key=lambda x: x[d])
        run = 0
        for at, x in enumerate(own):
            run += x.bytes
            if run >= want:
                break
        if run - want <= want - (run - x.bytes):
            at += 1
        grow(own[:at], first, k // 2)
        grow(own[at:], first + k // 2, k - k // 2)

    grow(items.collect(), 0, len(room))
    assert got == out and len(set(got.values())) == 12
    sizes = Counter()
    for x in sharding.kd_tree(items, room).collect():
        sizes[x.shard] += x.bytes
    assert all(abs(sizes[s] - n) < 0.15 * total / 13 for s, n in enumerate(room))


def test_heavy_items_fill_the_emptiest_shard():
    assert sharding.laid_out([9, 8, 7, 3, 3, 1], 3) == [0, 1, 2, 2, 1, 0] and sharding.laid_out([], 3) == []


def test_groups_of_up_to_a_shard_stay_whole(make_docs):
    rows = [(i, f"group {i % 5} " * 30) for i in range(500)] + [(1000 + i, f"{i} " + "y" * r) for i, r in enumerate(random.Random(4).choices(range(20, 300), k=900))]
    rows += [(None, "no id"), (None, "no id"), (7, "group 0 " * 30), (8, None, None)]
    table = make_docs(rows)
    got = table.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("c")).distinct().join(shard_documents(table, 8).withColumnRenamed("doc_id", "d"), F.col("c") == F.col("text_crc32"))
    homes, sizes = defaultdict(set), Counter()
    for x in got.select("text", "shard").distinct().collect():
        homes[x.text].add(x.shard)
    assert all(len(h) == 1 for h in homes.values())
    for x in shard_documents(table, 8).collect():
        sizes[x.shard] += x.size
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8


def test_shards_degenerate(make_docs):
    rows = [(1, None), (2, ""), (3, "y" * 100_000), (None, "z", None), (4, "z")]
    check_shards(rows, shard_documents(make_docs(rows)).collect(), 40)
    assert shard_documents(make_docs([])).count() == 0
    assert {x.shard for x in shard_documents(make_docs(rows), 1).collect()} == {0}


# Neighbours


def brute_nearest(ids, x, q, k):
    score = (x * x[q]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_nearest_is_exact_when_all_is_visited(spark):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(300, 6)), 1)
    x[50:90] = x[10]  # a repeated vector and many ties
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, score int")
    x = x.astype(np.float32).astype(float)
    ids = np.arange(300)
    got = defaultdict(list)
    for n in sorted(nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda n: (n.query_id, n.rank)):
        got[n.query_id].append((n.vec_id, n.score))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        assert found == brute_nearest(ids, x, q, 20)


def test_ranks_agree_with_duckdb_beyond_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(ann, "WHOLE", 0)
    monkeypatch.setattr(ann, "LEAF_ROWS", 64)
    monkeypatch.setattr(ann, "PART_ROWS", 300)
    sf_dir = "/root/testdata/sf0.1"
    assert_same(registry.ann_small_table(spark, sf_dir), sf_dir, ORACLES["ann_small_table"])


def test_ranks_of_scores_that_differ_by_rounding(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=64)
    rows = [(i, [1.0] * 64 if i == 0 else r.permutation(x).tolist()) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    assert_same(registry.ann_small_table(spark, str(tmp_path)), str(tmp_path), ORACLES["ann_small_table"])


def test_nearest_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [2.0, 1.0]), (1, None), (2, []), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [-1.0, 5.0]), (8, [-1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((n.query_id, n.rank, n.vec_id, n.score) for n in nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 8, -1.0), (20, 1, 8, 3.0), (20, 2, 0, 2.0)]
    assert nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0 and nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_recall_of_a_real_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "WHOLE", 0)
    monkeypatch.setattr(ann, "LEAF_ROWS", 64)
    monkeypatch.setattr(ann, "PART_ROWS", 30)  # leaves and their visits are cut
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(set)
    for n in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[n.query_id].add(n.vec_id)
    at = {i: k for k, i in enumerate(ids.tolist())}
    recall = [len(got[q] & {i for i, _ in brute_nearest(ids, x, at[q], 20)}) / 20 for q in got]
    assert len(got) == sum(ids % 20 == 0) and np.mean(recall) >= 0.9


def test_recall_and_visits_as_shipped(spark):
    """50,000 vectors in 400 clusters of different sizes, searched with the settings that production uses."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(400, 32))
    owner = r.choice(400, 50_000, p=np.arange(1, 401) / 80_200)
    x = (centres[owner] + 0.35 * r.normal(size=(50_000, 32))).astype(np.float32)
    ids = np.arange(50_000)
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": list(x)})).repartition(8)
    asked = F.col("vec_id") % 250 == 0
    got = defaultdict(set)
    for n in nearest(df, asked).collect():
        got[n.query_id].add(n.vec_id)
    x = x.astype(float)
    recall = [len(got[q] & {i for i, _ in brute_nearest(ids, x, q, 20)}) / 20 for q in range(0, 50_000, 250)]
    assert len(got) == 200 and np.mean(recall) >= 0.9
    forest, share = ann.fitted(ann.distinct_points(ann.usable(df), ann.K))
    leaves = forest.leaves(x)
    counts = np.stack([np.bincount(row, minlength=2**forest.depth) for row in leaves])
    seen = []
    for q in range(0, 50_000, 2500):
        rows = np.zeros(len(x), bool)
        for t, leaf, _ in forest.order(x[q], counts, share * len(x)):
            rows |= leaves[t] == leaf
        seen.append(rows.mean())
    assert forest.depth == 7 and np.mean(seen) < 0.3
