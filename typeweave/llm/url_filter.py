"""URL filters: a trie of allow and block rules, longest match wins.

A rule is a host and a path prefix. It fits its host and all subdomains when
the URL's path starts with the rule's path. The trie's first edges are host
labels from the right (``org``, then ``example``), the next are whole path
segments, and a node holds the rules that end there by the part of a segment
that they still ask for. Of the rules that fit, the longest one decides, by the
characters of host and path together; of two as long, the one with the longer
host; of an allow and a block entry that are the same, the block entry.

The trie is broadcast only while the rules are at most ``TRIE_BYTES`` long in
all. A longer list is joined by host suffix and path prefix instead, with the
same results: a URL asks for the prefixes of those lengths that the suffix has
rules of, so each key of the join has one rule.

Defined results: a null URL, or one without ``://``, has an empty host and
path and fits no rule (also none with an empty host, which can't be given);
repeated rows are judged one by one; very long URLs are judged whole; other
columns are kept, and an input column named like a result column
is replaced; an empty table gives no rows; without rules, all get the default.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.llm.arrays import bounded
from typeweave.operators.names import unused
from typeweave.sources.tables import handed_over

TRIE_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block") or not self.host:
            raise ValueError(f"not a rule: {self}")

    @property
    def name(self) -> str:
        return self.host + self.path


    @property
    def rank(self) -> tuple[int, int, bool]:
        return len(self.name), len(self.host), self.verdict == "block"


class Trie:
    """Nodes are dicts; under None a node has its endings by length, longest first."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for rule in sorted(rules, key=lambda r: r.verdict == "block"):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *whole, part = rule.path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {}).setdefault(len(part), {})[part] = rule
        self._sort(self.root)

    def _sort(self, root: dict) -> None:
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if None in node:
                node[None] = dict(sorted(node[None].items(), reverse=True))
            waiting += [n for key, n in node.items() if key is not None]

    def match(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            found = self._by_path(node.get("/"), path)
            if found and (best is None or found.rank > best.rank):
                best = found
        return best

    @staticmethod
    def _by_path(node: dict | None, path: str) -> Rule | None:
        best, at = None, 0
        while node is not None:
            end = path.find("/", at)
            for n, endings in node.get(None, {}).items():
                if (rule := endings.get(path[at : at + n])) is not None:
                    best = rule
                    break
            if end < 0:
                break
            node, at = node.get(path[at:end]), end + 1
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """As the module's text defines them."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def judged(df: DataFrame, url: str, rules: list[Rule], default: str) -> DataFrame:
    """Adds host, path, rule (null where none fits) and verdict to each row."""
    parts = df.withColumns(dict(zip(("host", "path"), host_and_path(F.col(url)))))
    if sum(len(r.name.encode()) for r in rules) > TRIE_BYTES:
        return _judged_by_join(parts, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in batches:
            hits = [match(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [r and r.name for r in hits], "verdict": [r and r.verdict for r in hits]})

    hit, = unused(parts.columns, "found")
    return (
        bounded(parts).withColumn(hit, found("host", "path"))
        .withColumns({"rule": F.col(hit)["rule"], "verdict": F.coalesce(F.col(hit)["verdict"], F.lit(default))})
        .drop(hit)
    )


def _judged_by_join(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same for a rule list of any length: distinct (host, path) pairs meet rules by host suffix and path prefix."""
    spark = parts.sparkSession
    one = {(r.host, r.path): r for r in sorted(rules, key=lambda r: r.verdict == "block")}
    table = handed_over(spark.createDataFrame([(r.host, r.path, r.verdict) for r in one.values()], "suffix string, prefix string, said string"), "url-rules")
    lengths = handed_over(table.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths")), "url-rule-lengths")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rank: Column = F.struct(
        (F.length("suffix") + F.length("prefix")).alias("chars"), F.length("suffix").alias("host_chars"),
        F.concat("suffix", "prefix").alias("rule"), F.col("said").alias("verdict"),
    )
    asked = handed_over(parts.select("host", "path").distinct(), "urls").withColumn("suffix", F.explode(suffixes)).join(lengths, "suffix")
    fits = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    best = (
        asked.select("host", "path", "suffix", F.explode(fits).alias("prefix")).join(table, ["suffix", "prefix"])
        .groupBy("host", "path").agg(F.max(rank).alias("best"))
    )
    best_of, = unused(parts.columns, "best")
    best = best.withColumnRenamed("best", best_of)
    return (
        parts.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col(best_of)["rule"], "verdict": F.coalesce(F.col(best_of)["verdict"], F.lit(default))})
        .drop(best_of)
    )
