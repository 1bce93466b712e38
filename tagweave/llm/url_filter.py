"""URL filter: allow and block rules in one trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.jobs import prepare

#: The trie is broadcast; a longer list raises.
MAX_RULES = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; an empty path fits every path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


class RuleTrie:
    """Longest match: more host labels first, then the longer path; block wins between equal rules.

    A node is [labels, segments, tails, lengths]: child nodes by the next host label, child nodes by the
    next whole path segment, the rules that end here by the rest of their last segment, and the lengths
    of these rests, longest first. A segment is looked up once for each of the lengths.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root = self._node()
        rules = sorted(set(rules), key=lambda r: r.verdict != "block")
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        ends = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node[0].setdefault(label, self._node())
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node[1].setdefault(segment, self._node())
            node[2].setdefault(tail, rule)
            ends[id(node)] = node
        for node in ends.values():
            node[3] = sorted({len(tail) for tail in node[2]}, reverse=True)

    @staticmethod
    def _node() -> list:
        return [{}, {}, {}, ()]

    def match(self, host: str, path: str) -> Rule | None:
        nodes = [self.root]
        for label in reversed(host.split(".")) if host else ():
            child = nodes[-1][0].get(label)
            if child is None:
                break
            nodes.append(child)
        segments = path.split("/")
        for node in reversed(nodes):
            found, depth = None, 0
            while True:
                here = segments[depth]
                for n in node[3]:
                    rule = node[2].get(here[:n]) if n <= len(here) else None
                    if rule is not None:
                        found = rule
                        break
                node = node[1].get(here) if depth + 1 < len(segments) else None
                if node is None:
                    break
                depth += 1
            if found is not None:
                return found
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """Verdict on every page: page_id, host, path, rule, verdict.

    Other columns are ignored. Null and malformed urls have an empty host and path and, unless a rule
    fits those, no rule; pages without a rule get ``default``. Repeated rows are judged alike.
    """
    spark = prepare(pages.sparkSession)
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule STRING, verdict STRING")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(host, path)]
        return pd.DataFrame(
            {
                "rule": [None if r is None else str(r) for r in found],
                "verdict": [default if r is None else r.verdict for r in found],
            },
            dtype=object,
        )

    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parts.withColumn("judged", judge("host", "path"))
    return judged.select("page_id", "host", "path", "judged.rule", "judged.verdict")
