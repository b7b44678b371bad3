"""Allow and block lists of hosts and paths, matched by a trie whose longest entry decides.

Host labels are walked from the last to the first, then the path segment by
segment. The trie is built on the driver and broadcast while the rules are at
most MOST_RULES rows and MOST_BYTES of text; more of them are dealt by hash to
several tries, which pass over the pages one after the other and keep the
longest rule so far, so that no task ever holds more than one bounded trie.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: Bounds of one broadcast trie.
MOST_RULES, MOST_BYTES = 200_000, 16 << 20
VERDICTS = ("allow", "block")
RULES_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(slots=True)
class Segments:
    """Path segments below a host: ``tails`` are what rules ask of the segment that follows, by its length."""

    after: dict[str, "Segments"] = field(default_factory=dict)
    tails: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Labels:
    """Host labels, the last one first."""

    below: dict[str, "Labels"] = field(default_factory=dict)
    paths: Segments | None = None


class Trie:
    """Rules (host, path, verdict); of two verdicts on one host and path, block stands."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root, self.rules = Labels(), list(rules)
        for host, path, verdict in self.rules:
            self._add(host, path, verdict)

    def __reduce__(self):
        """Sent as its rules: a trie as deep as a long path would not be pickled."""
        return Trie, (self.rules,)

    def _add(self, host: str, path: str, verdict: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, Labels())
        node.paths = at = node.paths or Segments()
        *whole, tail = path.split("/")
        for segment in whole:
            at = at.after.setdefault(segment, Segments())
        if at.tails.get(tail, ("", "allow"))[1] == "allow":
            at.tails[tail] = (host + path, verdict)
        at.lengths = sorted({*at.lengths, len(tail)}, reverse=True)

    @staticmethod
    def _longest(at: Segments | None, path: str) -> tuple[str, str] | None:
        found, start = None, 0
        while at is not None:
            for length in at.lengths:
                if hit := at.tails.get(path[start : start + length]):
                    found = hit
                    break
            slash = path.find("/", start)
            if slash < 0:
                break
            at, start = at.after.get(path[start:slash]), slash + 1
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the rule with most characters; of equally long ones, that of the longer host."""
        best, node = self._longest(self.root.paths, path), self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            hit = self._longest(node.paths, path)
            if hit and (best is None or len(hit[0]) >= len(best[0])):
                best = hit
        return best


def _rank(rule: str) -> tuple[int, int]:
    """Characters of the rule, and of its host."""
    return len(rule), len(rule.partition("/")[0])


def parse_rules(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """The table of rules from lines like ``block example.com/en/``."""
    rows = []
    for line in lines:
        verdict, _, address = line.strip().partition(" ")
        host, slash, path = address.strip().partition("/")
        rows.append((host, slash + path, verdict))
    return spark.createDataFrame(rows, RULES_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; path: what follows up to ``?`` or ``#``. Both are empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _tries(rules: DataFrame) -> Iterable[Trie]:
    """One trie, or as many as hold MOST_RULES rules and MOST_BYTES each."""
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    size = clean.agg(F.count("*").alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes"), F.count_if(F.coalesce(~F.col("verdict").isin(*VERDICTS), F.lit(True))).alias("unknown")).first()
    if size["unknown"]:
        raise ValueError(f"a rule's verdict is allow or block; {size['unknown']} rules have another")
    parts = max(1, math.ceil(size["n"] / MOST_RULES), math.ceil((size["bytes"] or 0) / MOST_BYTES))
    if parts > 1:
        clean = written(clean, "url-rules")
    for part in range(parts):
        yield Trie(tuple(r) for r in clean.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part).toLocalIterator())


def judge_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A rule (host, path, verdict) fits its host and all subdomains where the
    url's path starts with the rule's; an empty rule host fits every page. The
    longest rule decides, ``default`` where none fits (rule is null). Null urls
    and those without ``://`` have an empty host and path. Hosts are compared
    label by label, as they stand (a port or a final dot is part of its label).
    Repeated rows are judged one by one; no rules or an empty table are fine.
    Columns other than page_id and url are not read.
    """
    if default not in VERDICTS:
        raise ValueError("the default verdict is allow or block")
    host, path = host_and_path(F.col("url").cast("string"))
    none = F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), none.alias("rule"), none.alias("verdict"))
    for k, trie in enumerate(_tries(rules)):
        if k:
            rows = written(rows, "judged-pages")
        rows = _pass(rows, trie)
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _pass(rows: DataFrame, trie: Trie) -> DataFrame:
    """``rows`` with the rule and verdict of ``trie`` wherever its rule is longer than the one that stands."""
    held = rows.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        match = held.value.match
        for batch in batches:
            hosts, paths, rule, verdict = (batch.column(i).to_pylist() for i in range(1, 5))
            for i, hit in enumerate(map(match, hosts, paths)):
                if hit and (rule[i] is None or _rank(hit[0]) > _rank(rule[i])):
                    rule[i], verdict[i] = hit
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
