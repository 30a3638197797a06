"""URL filters as a sort-merge range join.

A rule is a host and a path. It fits the urls of its host and of all subdomains whose path starts with the
rule's. Host labels in reverse order before the path make a canonical key, in which a rule is the interval of
the keys that start with its own. A url has such a key for its host and for each parent domain, as far up as
rules have labels. The keys of a batch are sorted and swept together with the sorted rules; a stack holds the
nested rules that are active, of which the top is the longest. The sweep leaps by bisection over rules that lie
between two keys, so a batch costs its own size times the logarithm of the number of rules. Of the rules at a url's several keys the one
with the longest text wins, then the one with the longer host.

Rules are broadcast in blocks of RULES_AT_ONCE; each further block is one more pass over the urls, without a
shuffle, so there can be any number of them. Batches are swept by themselves, so a host with very many urls
is spread as its rows are.

Null urls and urls without :// have an empty host and path and fit no rule. Repeated rows have a row each.
Very long urls are taken whole. Ties between rules of equal text and host go to the last in order of the verdict.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import prepare

Rule = tuple[str, str, str]
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
#: About 100 MB.
RULES_AT_ONCE = 500_000
_END = "\x01"


def canonical(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + _END + path


def keys(host: str, path: str, labels: int) -> list[str]:
    """Canonical keys of the host and its parents with at most ``labels`` labels."""
    own = host.split(".")
    return [".".join(reversed(own[-n:])) + _END + path for n in range(1, min(labels, len(own)) + 1)] if host else []


def parents(keys: list[str]) -> list[int]:
    """Of sorted keys, for each the last one before it that it starts with, or -1: the nesting of the intervals."""
    out, stack = [], []
    for i, key in enumerate(keys):
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def sweep(urls: list[tuple[str, int]], rules: list[str], parent: list[int]) -> Iterator[tuple[int, int]]:
    """(number of the url, number of the longest rule) where one fits. Both lists are in order of their keys.

    The stack of active rules is a path in their nesting, so only its top is kept. Where many rules lie between two
    urls the sweep leaps over them by bisection: what is active then hangs together with the last rule before the url.
    """
    at, top = 0, -1
    for key, url in urls:
        if at < len(rules) and rules[at] <= key:
            at = bisect_right(rules, key, at)
            top = at - 1
        while top >= 0 and not key.startswith(rules[top]):
            top = parent[top]
        if top >= 0:
            yield url, top


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each url: the id, host, path, rule (its host and path, or null) and verdict."""
    for _, host, path in rules:
        if not host or not path.startswith("/"):
            raise ValueError(f"a rule needs a host and a path that starts with /: {host!r} {path!r}")
    spark = pages.sparkSession
    prepare(spark)
    host, path = host_and_path(F.col(url_col).cast("string"))
    out = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("size"), F.lit(0).alias("labels"))
    kind = out.schema["id"].dataType.simpleString()
    for lo in range(0, len(rules), RULES_AT_ONCE):
        block = spark.sparkContext.broadcast(sorted((canonical(h.lower(), p), v, h.lower(), p) for v, h, p in rules[lo : lo + RULES_AT_ONCE]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = block.value
            starts = [r[0] for r in own]
            nesting = parents(starts)
            labels = max(r[2].count(".") + 1 for r in own)
            for batch in batches:
                hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                rule, verdict, size, length = (batch.column(k).to_pylist() for k in (3, 4, 5, 6))
                urls = sorted((key, i) for i, (h, p) in enumerate(zip(hosts, paths, strict=True)) for key in keys(h, p, labels))
                for i, r in sweep(urls, starts, nesting):
                    _, v, h, p = own[r]
                    if (len(h) + len(p), len(h)) > (size[i], length[i]):
                        rule[i], verdict[i], size[i], length[i] = h + p, v, len(h) + len(p), len(h)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(size, pa.int32()), pa.array(length, pa.int32())], ["id", "host", "path", "rule", "verdict", "size", "labels"])

        out = out.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, size int, labels int")
    return out.drop("size", "labels").withColumnRenamed("id", id_col)
