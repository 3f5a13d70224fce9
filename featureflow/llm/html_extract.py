"""Main text of web pages with site template removal.

A page is parsed into a tree. Every element's subtree gets a 64-bit hash of its tags, classes
and text, in articles as elsewhere and at any length; Spark counts, with partial aggregation,
around how many different main texts of a host each hash occurs. Subtrees that recur around
``LEAST_PAGES`` of them and ``LEAST_SHARE`` of all are template and are deleted; a page of which
nothing would be left is a copy of content and stays whole. A share is asked for at every size,
since on a large host a line that some dozens of articles quote is content. An inline element counts
only where no text stands beside it. What is boilerplate by its element, role or class
(navigation, footers, forms, scripts ...) goes as well, and the article's blocks are joined. A
``header`` inside an article holds its title and is read; one outside any article goes.

A page is parsed once, into the pieces of its blocks; a piece carries the hashes of the subtrees
around it that could be template. Pages without such hashes are done. For the others, hashes
that recur are sent back by (host, hash), a join that AQE splits for a hot host; no task sees
all pages of a host.

Defined cases: null or empty html gives the empty text; html cut off inside a tag loses the
open tag only; unclosed elements are closed as browsers do; quotes open a value only after an
equals sign; a null url is a host of its own, the empty one; pages with equal main texts count
once, so repeated rows and exact copies are no template; rows that share a page_id, or have none,
are pages of their own; very long pages are parsed whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A subtree is template if it occurs around this many different main texts of its host at least ...
LEAST_PAGES = 5
#: ... and around this share of them.
LEAST_SHARE = 0.3

# Elements of the HTML standard by their role.
RAW_ELEMENTS = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_ELEMENTS = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label legend map menu nav noembed noframes "
    "noscript object optgroup option script select style svg template textarea title video".split()
)
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say where or how such a part stands, and nothing about what it is.
PLACE_NAMES = frozenset("area bar block bottom box container global left list main page right section site slot sub top wrapper".split())
DROPPED_ROLES = frozenset("banner navigation contentinfo complementary search form alert dialog menu menubar".split())
#: Part of a sentence where text stands beside them.
INLINE_ELEMENTS = frozenset("b i em strong span a q cite code u s sub sup small".split())
CLOSES_P = BLOCK_ELEMENTS - {"html", "body", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "dd", "dt"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table td th select div section article body html".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))|<(?:!|\?|/(?=[^a-zA-Z]))[^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>]*+))?+|=)*+)(>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW_ELEMENTS}
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "chars")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.hash, self.chars = 0, 0


def parse(source: str) -> Node:
    """Element tree; text children are decoded strings."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            stack[-1].children.append(html_lib.unescape(text))
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag or not m.group(4):  # a comment, a declaration, or a tag that the end cuts off
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "article", "body", "html") and tag not in BLOCK_ELEMENTS:
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, SCOPES)
        if tag in CLOSES_SAME:
            _close(stack, CLOSES_SAME[tag], SCOPES - {"td", "th"} if tag in ("td", "th", "tr") else SCOPES - CLOSES_SAME[tag])
        node = Node(tag, m.group(3).strip())
        stack[-1].children.append(node)
        if tag in VOID_ELEMENTS:
            continue
        if tag in RAW_ELEMENTS:
            found = _RAW_ENDS[tag].search(source, at)
            end = found.start() if found else n
            if end > at:
                node.children.append(source[at:end])
            close = source.find(">", end)
            at = close + 1 if close >= 0 else n
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], scopes) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scopes:
            return


def hashed(root: Node) -> list[Node]:
    """All elements below ``root``, children first, with hash and text length filled in."""
    out: list[Node] = []
    work = [(root, False)]
    while work:
        node, done = work.pop()
        if not done:
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))
            continue
        h = xxhash.xxh64(f"{node.tag} {node.attrs}".encode("utf-8", "replace"))
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                node.chars += c.chars
            else:
                h.update(b"t" + " ".join(c.split()).encode("utf-8", "replace"))
                node.chars += len(c)
        node.hash = h.intdigest()
        out.append(node)
    return out[:-1]


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def boilerplate(node: Node) -> bool:
    """Whether an element is none of the main text by its name, class, id or role."""
    if node.tag in DROPPED_ELEMENTS:
        return True
    if node.tag in ("article", "main", "body", "html") or not node.attrs:
        return False
    for name, value in _ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id") and any(map(_names_boilerplate, value.split())):
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
    return False


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id names a part to drop: ``cookie-banner`` and ``site-footer``, but not ``photo-banner``."""
    parts = [p for p in _NAME_PARTS.split(name) if p and p not in PLACE_NAMES]
    return bool(parts) and DROPPED_NAMES.issuperset(parts)


def pieces(root: Node) -> list[tuple[str | None, tuple[int, ...]]]:
    """(text, hashes of removable subtrees around it) in page order; None ends a block.

    Reads the articles, or the whole body if there is none.
    """
    articles = _tops(root, "article") or _tops(root, "main")
    out: list[tuple[str | None, tuple[int, ...]]] = []
    for top in articles or [root]:
        work: list = [(top, (), False)]
        while work:
            node, marks, beside = work.pop()
            if node is None:
                out.append((None, ()))
            elif isinstance(node, str):
                out.append((node, marks))
            elif node.tag == "br":
                out.append((" ", marks))
            elif node is not top and (boilerplate(node) or (node.tag == "header" and not articles)):
                continue
            else:
                if node is not top and removable(node) and not (beside and node.tag in INLINE_ELEMENTS):
                    marks = (*marks, signed(node.hash))
                if node.tag in BLOCK_ELEMENTS:
                    out.append((None, ()))
                    work.append((None, (), False))
                beside = any(isinstance(c, str) and not c.isspace() for c in node.children)
                work.extend((c, marks, beside) for c in reversed(node.children))
        out.append((None, ()))
    return out


def removable(node: Node) -> bool:
    """Whether an element may be template: not empty, and no container of the content."""
    return bool(node.children) and node.tag not in ("html", "body", "article", "main", "head")


def assembled(parts: Iterable[tuple[str | None, Iterable[int]]], template: frozenset[int] = frozenset()) -> str:
    """Blocks without the template's pieces, joined by line feeds."""
    blocks: list[str] = []
    line: list[str] = []
    for text, marks in parts:
        if text is not None:
            if not template or template.isdisjoint(marks):
                line.append(text)
        elif line:
            block = " ".join("".join(line).split())
            if block:
                blocks.append(block)
            line.clear()
    return "\n".join(blocks)


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    return assembled(pieces(root), template)


def _tops(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a kind, in page order, outside boilerplate."""
    out, work = [], [root]
    while work:
        node = work.pop()
        if node.tag == tag:
            out.append(node)
        elif node is root or not boilerplate(node):
            work.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def host_of(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.lower(rest)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host_of(F.col("url"))).alias("host"), "html")
    parsed = hosted.mapInPandas(_parsed, f"page_id long, url string, host long, text string, core long, marks array<long>, parts {_PARTS}")
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed-pages")
    marked = parsed.where(F.size("marks") > 0)
    trees = marked.select("row", "host", "core", F.explode("marks").alias("hash"))
    # Pages with equal main texts are copies of content; they count once.
    sizes = parsed.select("host", "core").distinct().groupBy(F.col("host").alias("s_host")).agg(F.count(F.lit(1)).alias("host_texts"))
    counts = trees.select("host", "hash", "core").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    recurring = counts.join(sizes, F.col("host") == F.col("s_host")).where(F.col("n") >= LEAST_SHARE * F.col("host_texts"))
    recurring = recurring.select(F.col("host").alias("r_host"), F.col("hash").alias("r_hash"))
    found = trees.join(recurring, (F.col("host") == F.col("r_host")) & (F.col("hash") == F.col("r_hash")))
    found = found.groupBy(F.col("row").alias("m_row")).agg(F.collect_set("hash").alias("template"))  # one page's subtrees
    found = stored(found, "page-templates")  # its size is known then, and decides how texts are joined
    marked = marked.join(found, F.col("row") == F.col("m_row"), "left").select("page_id", "url", "parts", "template")
    done = parsed.where(F.size("marks") == 0).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
    return done.unionByName(marked.mapInPandas(_cleaned, "page_id long, url string, text string, n_chars long"))


_PARTS = "array<struct<t:string,m:array<bigint>>>"


def _parsed(batches):
    for pdf in batches:
        rows = []
        for source in pdf["html"]:
            parts = pieces(_with_hashes(source)) if isinstance(source, str) and source else []
            marks = sorted({m for _, own in parts for m in own})
            text = assembled(parts)
            core = signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace")))
            rows.append((None, core, marks, [{"t": t, "m": list(m)} for t, m in parts]) if marks else (text, core, [], []))
        out = pd.DataFrame(rows, columns=["text", "core", "marks", "parts"])
        out.insert(0, "page_id", pdf["page_id"].astype("Int64").array)
        out.insert(1, "url", pdf["url"].array)
        out.insert(2, "host", pdf["host"].array)
        yield out


def _cleaned(batches):
    for pdf in batches:
        out = []
        for parts, template in zip(pdf["parts"], pdf["template"]):
            gone = frozenset(int(x) for x in template) if template is not None else frozenset()
            parts = [(p["t"], p["m"] if p["m"] is not None else ()) for p in parts]
            out.append(assembled(parts, gone) or assembled(parts))
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": pd.array(out, dtype=object), "n_chars": [len(t) for t in out]})


def _with_hashes(source: str) -> Node:
    root = parse(source)
    hashed(root)
    return root
