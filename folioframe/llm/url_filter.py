"""URL filter: a broadcast trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str  # fits itself and its subdomains
    path: str  # fits paths that start with it


class PathNode:
    """A path segment: `below` has whole segments, `ends` the unfinished last segments by their length."""

    __slots__ = ("below", "ends")

    def __init__(self):
        self.below: dict[str, PathNode] = {}
        self.ends: dict[int, dict[str, Rule]] = {}


class HostNode:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class UrlTrie:
    """Rules by reversed host labels, then path segments.

    The rule with the most host labels wins, then the one with the longest path; of two entries with
    the same host and path the block wins.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root = HostNode()
        for rule in rules:
            rule = Rule(rule[0], rule[1].translate(_FOLD), rule[2])
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block: {rule.verdict}")
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, HostNode())
            node.paths = node.paths or PathNode()
            *whole, last = rule.path.split("/")
            at = node.paths
            for segment in whole:
                at = at.below.setdefault(segment, PathNode())
            same = at.ends.setdefault(len(last), {})
            if last not in same or rule.verdict == "block":
                same[last] = rule

    def find(self, host: str, path: str) -> Rule | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._longest(node.paths, segments) or best
        return best

    @staticmethod
    def _longest(at: PathNode | None, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            if at is None:
                break
            for n in sorted(at.ends, reverse=True):
                rule = at.ends[n].get(segment[:n]) if len(segment) >= n else None
                if rule:
                    best = rule
                    break
            at = at.below.get(segment)
        return best


def url_parts(url):
    """Columns (host, path) of a url column; both empty for null and where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """Append host, path, rule (host + path of the longest fitting rule, or null) and verdict.

    The rules are a driver-side parameter, so the broadcast trie does not grow with the table;
    `max_rules` is its bound and a longer list is refused. No shuffle; one pass over the urls. Null or
    malformed urls have an empty host and path and get `default` unless a rule has an empty host.
    Columns named like the new ones are replaced, all others kept whatever their names; repeated rows and very long urls are
    judged one by one, whole; an empty table gives none.
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the trie is bounded to {max_rules}")
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r.host + r.path for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    host, path = url_parts(F.col(f"`{url}`"))
    # the caller's columns wait under names that clash with none here
    given = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in ("host", "path", "rule", "verdict")}
    out = df.select(*(F.col(f"`{c}`").alias(n) for c, n in given.items()), host.alias("host"), path.alias("path")).withColumn("found", find("host", "path"))
    return out.select(*(F.col(n).alias(c) for c, n in given.items()), "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
