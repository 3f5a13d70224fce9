"""URL rules by a sort-merge range join.

A url's host is written in reverse (``www.example.org`` -> ``org.example.www.``), so the host
of a rule and all its subdomains are one interval of keys. Urls are dealt and sorted by key
range; each rule goes to the ranges its interval meets. In a range, one sweep over both sorted
sides keeps the stack of rule hosts whose intervals hold the current key; the longest path
prefix is looked up in each, from the top of the stack down, and the longest rule wins.

A range is a slice of (key, path, page_id), so a hot host, or one hot url, is cut over many. The
bounds of at most ``MOST_RANGES`` ranges pass through the driver; a range of more than
``RANGE_ROWS`` urls, on larger tables or where rows are alike in all three, is dealt in parts that
are swept each on its own against the range's rules, so no task holds more.

Defined cases: null urls and urls without ``://`` have an empty host and path and fall to the
default verdict, as do urls without any rule; ``longest`` is the length of the rule's host plus
path (ties: the longer host, then block); rules repeated with one host and path count once,
block before allow; repeated rows are judged each; an empty table gives an empty result; no
rules at all give every row the default; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: (host, path, verdict) of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
#: Urls that one task sweeps, about; key ranges at most.
RANGE_ROWS = 50_000
MOST_RANGES = 4096
_OUT = "page_id long, host string, path string, rule string, verdict string"


def split_url(url):
    """(host, path) columns of a url column."""
    found = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.expr("substring(__url, locate('://', __url) + 3)")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lowered).otherwise(""), F.when(found, path).otherwise("")


def reversed_host(host):
    """Canonical key: labels in reverse, each closed by a dot, so that prefixes end at labels."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


class HostRules:
    """The rules of one host; the longest path prefix is found by lengths, longest first."""

    def __init__(self, key: str, host: str, rules: Iterable[tuple[str, str]]):
        self.key, self.host, self.paths = key, host, {}
        for path, verdict in rules:
            if self.paths.get(path) != "block":
                self.paths[path] = verdict
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def best(self, path: str):
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.paths:
                return n + len(self.host), len(self.host), path[:n]
        return None


def sweep(urls: Iterable[tuple[str, str]], hosts: list[HostRules]) -> Iterator[tuple[str | None, str | None]]:
    """(rule, verdict) for each (key, path); urls and hosts are sorted by key."""
    stack: list[HostRules] = []
    at = 0
    for key, path in urls:
        while at < len(hosts) and hosts[at].key <= key:
            while stack and not hosts[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(hosts[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        top = None
        for h in reversed(stack):
            found = h.best(path)
            if found and (top is None or found > top[0]):
                top = (found, h)
        if top is None:
            yield None, None
        else:
            yield top[1].host + top[0][2], top[1].paths[top[0][2]]


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none), verdict."""
    spark = pages.sparkSession
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("__url"))
    host, path = split_url(F.col("__url"))
    keyed = picked.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    # Rows are counted from the page ids alone, before anything is dealt.
    ranges = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, -(-pages.select("page_id").count() // RANGE_ROWS)))
    dealt = keyed.repartitionByRange(ranges, "key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    dealt = stored(dealt.withColumn("cell", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "url-ranges")
    bounds = dealt.groupBy("cell").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell")
    cells = [(r["cell"], r["lo"], r["hi"], -(-r["n"] // (2 * RANGE_ROWS))) for r in bounds.collect()]  # about MOST_RANGES rows at most
    if not cells:
        return spark.createDataFrame([], _OUT)
    names = ("cell", "lo", "hi", "parts")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in cells])
    cut = F.broadcast(spark.createDataFrame([(c, parts) for c, _, _, parts in cells], "c_cell int, parts int"))
    dealt = dealt.join(cut, F.col("cell") == F.col("c_cell")).withColumn("part", F.pmod("place", "parts").cast("int")).drop("c_cell", "parts", "place")
    ruled = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    ruled = ruled.select(reversed_host(F.col("host")).alias("key"), "host", "path", "verdict").where("key <> ''").distinct()
    # The interval of a rule is [key, key with its last dot raised); ranges are sorted, so it meets a run of them.
    beyond = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    met = F.filter(table, lambda c: (c["hi"] >= F.col("key")) & (c["lo"] < beyond))
    ruled = ruled.select(F.explode(F.transform(met, lambda c: F.struct(c["cell"], c["parts"]))).alias("c"), "key", "host", "path", "verdict")
    ruled = ruled.select(F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)).alias("part"), "key", "host", "path", "verdict")

    def judge(urls: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        urls = urls.sort_values(["key", "path"], kind="stable") if len(urls) else urls
        hosts = [HostRules(k, h, zip(g["path"], g["verdict"])) for (k, h), g in own.groupby(["key", "host"], sort=False)]
        hosts.sort(key=lambda h: h.key)
        found = list(sweep(zip(urls["key"], urls["path"]), hosts))
        return pd.DataFrame(
            {
                "page_id": urls["page_id"].astype("Int64"),
                "host": urls["host"],
                "path": urls["path"],
                "rule": pd.array([r for r, _ in found], dtype=object),
                "verdict": pd.array([v or default for _, v in found], dtype=object),
            }
        )

    return dealt.groupBy("cell", "part").cogroup(ruled.groupBy("cell", "part")).applyInPandas(judge, _OUT)
