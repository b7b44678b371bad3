"""Removal of long byte strings that stand more than once in a corpus, by hash-compared suffix sorting.

Of the substrings of half its length of a string of LENGTH bytes, the one with the
smallest hash is its anchor; equal strings have equal anchors at equal places. Consecutive strings with the
same anchor form a run, about one for each hundred bytes. Spark joins runs by
anchor: an anchor met once ends there, runs whose whole texts are equal are
repeated as a whole, and only runs with equal anchors and different texts need
to be compared. These groups are suffix-sorted: prefix polynomial hashes and
binary search give the common extension of two suffixes in logarithmic time,
a mergesort puts the suffixes that start at the anchors in order, neighbours'
extensions are verified byte by byte, and the part left of the anchor decides
among the strings that agree on the right. Groups with very many different
runs are compared string by string in a grouped aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import SLOTS, fixed_table
from .store import written
from .textkernel import BASE, BYTE_CODES, PIECE_BYTES, U, mix, power_table, prefix_hashes, span_hashes

#: Bytes of a string, where the caller names no other length.
LENGTH = 400
#: Longer texts are worked on in sections that overlap by one byte less than a string.
SECTION = 1 << 20
_PLACE = U((1 << 24) - 1)
#: Different runs of one anchor that one task sorts; and bytes that it holds, about.
GROUP, GROUP_BYTES = 4000, 2 << 20
RUN = "anchor long, run long, key long, at long, strings int, left int"


def _gram(length: int) -> int:
    """Bytes of the anchors of strings of this length."""
    return length // 2


def _sections(batch: pa.RecordBatch, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (key, place in its text, bytes), each list about PIECE_BYTES."""
    held, size = [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SECTION):
            held.append((key, at, text[at : at + SECTION + length - 1]))
            size += len(held[-1][2])
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(parts: list[bytes], length: int) -> tuple[bytes, dict[str, np.ndarray]]:
    """The joined bytes and, for each run: section, first string's place, number of strings, anchor's distance, hashes of anchor and run."""
    joined = b"".join(parts)
    data = np.frombuffer(joined, np.uint8)
    end = np.cumsum([len(x) for x in parts])
    prefix = prefix_hashes(BYTE_CODES[data])
    size = _gram(length)
    most = length - size + 1
    n = len(data) - size + 1
    gram = mix((prefix[size:] - prefix[:n]) * power_table(BASE, n))
    least = (gram & ~_PLACE) | np.arange(n, dtype=U)
    width = 1
    while 2 * width <= most:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - most + 1], least[most - width :])
    anchor = (least & _PLACE).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in end[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(inside)
    own = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(own) != 0))))
    strings = np.diff(np.append(first, len(at)))
    start, place = at[first], own[first]
    run = mix(span_hashes(prefix, start, start + strings - 1 + length) ^ mix((place - start).astype(U)))
    return joined, {"section": np.searchsorted(end, start, side="right"), "start": start, "strings": strings, "left": place - start, "anchor": gram[place].view(np.int64), "run": run.view(np.int64), "base": end - np.array([len(x) for x in parts])}


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", text).alias("key"), F.col(text).cast("string").alias("text"))


def runs_of(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The runs of all rows; a row is known by the hash of its doc_id and text."""

    def run(batches):
        for batch in batches:
            for held in _sections(batch, length):
                _, r = _runs([x[2] for x in held], length)
                key = np.array([x[0] for x in held], np.int64)[r["section"]]
                at = np.array([x[1] for x in held], np.int64)[r["section"]] + r["start"] - r["base"][r["section"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["anchor"]), pa.array(r["run"]), pa.array(key), pa.array(at), pa.array(r["strings"].astype(np.int32)), pa.array(r["left"].astype(np.int32))], names=["anchor", "run", "key", "at", "strings", "left"])

    return _keyed(docs, text).mapInArrow(run, RUN)


def _slot(anchor: np.ndarray, run: np.ndarray) -> np.ndarray:
    return (mix(anchor.view(U) ^ run.view(U)) & U(SLOTS - 1)).astype("<u4")


def texts_of(docs: DataFrame, wanted: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``wanted`` (anchor, run, key, at, n) with the bytes of each run, cut again from the documents.

    A table of fixed size says which runs may be wanted, so that most others
    stay where they are read; the join decides.
    """

    def slots(batches):
        for batch in batches:
            yield _slot(batch.column(0).to_numpy(), batch.column(1).to_numpy()).astype(np.int64)

    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(fixed_table(wanted.select("anchor", "run"), slots) > 0))

    def run(batches):
        want = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            for held in _sections(batch, length):
                joined, r = _runs([x[2] for x in held], length)
                some = np.flatnonzero(want[_slot(r["anchor"], r["run"])])
                section, start = r["section"][some], r["start"][some]
                key = np.array([x[0] for x in held], np.int64)[section]
                at = np.array([x[1] for x in held], np.int64)[section] + start - r["base"][section]
                cut = [joined[s : s + c - 1 + length] for s, c in zip(start.tolist(), r["strings"][some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["anchor"][some]), pa.array(r["run"][some]), pa.array(key), pa.array(at), pa.array(r["strings"][some].astype(np.int32)), pa.array(r["left"][some].astype(np.int32)), pa.array(cut, pa.binary())], names=["anchor", "run", "key", "at", "strings", "left", "bytes"])

    return _keyed(docs, text).mapInArrow(run, f"{RUN}, bytes binary").join(wanted, ["anchor", "run", "key", "at"])


class Suffixes:
    """Suffixes of the joined bytes, each with its own end, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.prefix = prefix_hashes(BYTE_CODES[data])
        self.power = power_table(BASE, len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search."""
        x, y = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        px, py, wx, wy = self.prefix[x], self.prefix[y], self.power[x], self.power[y]
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = (self.prefix[x + middle] - px) * wx == (self.prefix[y + middle] - py) * wy
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a stands before suffix b."""
        n = self.common(a, b)
        ends_a, ends_b = n == self.length[a], n == self.length[b]
        last = len(self.data) - 1
        byte_a, byte_b = self.data[np.minimum(self.start[a] + n, last)], self.data[np.minimum(self.start[b] + n, last)]
        return np.where(ends_a | ends_b, ends_a & ~ends_b, byte_a < byte_b)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Suffixes by group, then in order: a mergesort of all groups at once."""
        now = np.argsort(group, kind="stable")
        if not len(now):
            return now
        head = np.flatnonzero(np.concatenate(([True], np.diff(group[now]) != 0)))
        size = np.diff(np.append(head, len(now)))
        base, total = np.repeat(head, size), np.repeat(size, size)
        rank = np.arange(len(now)) - base
        width = 1
        while width < size.max():
            pair = rank // (2 * width) * 2 * width
            right = rank - pair >= width
            other = np.where(right, pair, pair + width)
            count = np.clip(total - other, 0, width)
            low, high = np.zeros(len(now), np.int64), count
            while (todo := np.flatnonzero(low < high)).size:
                middle = (low[todo] + high[todo]) // 2
                own, sibling = now[todo], now[base[todo] + other[todo] + middle]
                # Those of the left half go before equals of the right half.
                passed = np.where(right[todo], ~self.before(own, sibling), self.before(sibling, own))
                low[todo] = np.where(passed, middle + 1, low[todo])
                high[todo] = np.where(passed, high[todo], middle)
            place = base + pair + (rank - pair - right * width) + low
            merged = np.empty_like(now)
            merged[place] = now
            now, width = merged, 2 * width
        return now


def repeated_strings(anchor: np.ndarray, texts: list[bytes], left: np.ndarray, strings: np.ndarray, n: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings of each run stand elsewhere in its group too: a row for each run, column j for the string at its place j."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    suffixes = Suffixes(data, start + left, size - left)
    order = suffixes.order(anchor)
    common = suffixes.common(order[:-1], order[1:])
    common[anchor[order[:-1]] != anchor[order[1:]]] = -1
    joined = data.tobytes()
    for i in np.flatnonzero(common > 0).tolist():
        x, y, c = int(suffixes.start[order[i]]), int(suffixes.start[order[i + 1]]), int(common[i])
        if joined[x : x + c] != joined[y : y + c]:
            common[i] = next(k for k in range(c) if joined[x + k] != joined[y + k])
    out = np.zeros((len(texts), length - _gram(length) + 1), bool)
    place, prefix, power = suffixes.start[order], suffixes.prefix, suffixes.power
    left, strings, many = left[order], strings[order], n[order]
    for before in range(int(left.max(initial=-1)) + 1):  # bytes of the string left of its anchor
        here = np.flatnonzero((before <= left) & (before > left - strings))
        if len(here) < 2:
            continue
        agrees = np.concatenate(([0], np.cumsum(common < length - before)))[here]
        began = place[here] - before
        own = mix((prefix[place[here]] - prefix[began]) * power[began]) if before else np.zeros(len(here), U)
        which = _classes(agrees, own)
        total = np.bincount(which, weights=many[here])
        again = total[which] > 1
        out[order[here[again]], (left - before)[here[again]]] = True
    return out


def _classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each different pair of values."""
    order = np.lexsort((b, a))
    new = np.concatenate(([True], (np.diff(a[order]) != 0) | (b[order][1:] != b[order][:-1])))
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return which


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column + 1) of each stretch of set flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last


def compared(runs: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """Byte ranges (key, low, high) of the runs met once whose strings stand in another run of the anchor."""

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "run"])
        texts = pdf["bytes"].tolist()
        again = repeated_strings(pdf["anchor"].to_numpy(), texts, pdf["left"].to_numpy(np.int64), pdf["strings"].to_numpy(np.int64), pdf["n"].to_numpy(), length)
        row, first, last = _stretches(again)
        key, at = pdf["key"].to_numpy()[row], pdf["at"].to_numpy()[row]
        return pd.DataFrame({"key": key, "low": at + first, "high": at + last - 1 + length})

    return runs.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups))).groupBy("group").applyInPandas(sort, "key long, low long, high long")


def counted(runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same ranges for anchors with very many different runs: strings are counted by their digests."""

    def strings(batches):
        for batch in batches:
            rows = []
            for key, at, c, n, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows += [(hashlib.blake2b(text[j : j + length], digest_size=16).digest(), key, at + j, n) for j in range(c)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["digest", "key", "low", "n"])

    each = runs.dropDuplicates(["anchor", "run"]).select("key", "at", "strings", "n", "bytes").mapInArrow(strings, "digest binary, key long, low long, n long")
    again = each.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    return each.join(again, "digest").select("key", "low", (F.col("low") + length).alias("high"))


def repeated_ranges(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, low, high): byte ranges, possibly overlapping, of all repeated strings of the rows."""
    runs = written(runs_of(docs, text, length), "dedup-runs")
    # Written, so that both sides of the join are plain exchanges and Spark can split the runs of a very common anchor.
    twice = written(runs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("mixed")).where("n > 1").select("anchor", "mixed"), "dedup-twice")
    met = written(runs.join(twice, "anchor"), "dedup-met")
    whole = [F.col("key"), F.col("at").alias("low"), (F.col("at") + F.col("strings") - 1 + length).alias("high")]
    equal = met.where("NOT mixed").select(*whole)
    different = written(met.where("mixed").groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")).select("anchor", "run", "one.key", "one.at", "n"), "dedup-different")
    # A stage of its own, so that Spark can split the copies of a very common run.
    several = written(met.where("mixed").join(different.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select(*whole), "dedup-several")
    sizes = different.groupBy("anchor").agg(F.count("*").alias("runs"))
    with_text = written(texts_of(docs, different, text, length).join(sizes, "anchor"), "dedup-texts")
    groups = max(1, -(-int(with_text.agg(F.sum(F.length("bytes"))).first()[0] or 0) // GROUP_BYTES))
    ranges = equal.union(several).union(compared(with_text.where(F.col("runs") <= GROUP).drop("runs"), groups, length)).union(counted(with_text.where(F.col("runs") > GROUP), length))
    return ranges.distinct()


def _kept(text: bytes, ranges: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and what stays of the text."""
    spans: list[list[int]] = []
    for r in sorted((r["low"], r["high"]) for r in ranges or ()):
        if spans and r[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], r[1])
        else:
            spans.append(list(r))
    out, at = [], 0
    for low, high in spans:
        out.append(text[at:low])
        at = high
    return [tuple(s) for s in spans], b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), with_text: bool = False, length: int = LENGTH) -> DataFrame:
    """``columns`` of every row with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the text without the strings of ``length`` bytes that stand more than once.

    A null text is an empty one and stays null in ``kept``. Repeated rows are
    copies of each other. Cuts may fall inside a character; what is then no
    whole character is left out of ``kept``, while kept_sha256 is of the bytes.
    Rows are told apart by a 64-bit hash of doc_id and text; runs count as
    equal where the 64-bit hashes of their anchor and of all their bytes both
    are. Texts shorter than a string, empty ones and an empty table lose
    nothing; very long texts are worked on in overlapping sections. Columns
    not named are not read.
    """
    spans = repeated_ranges(docs, length=length).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    all_columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    joined = docs.select(*all_columns, F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text")).join(spans, "key", "left").drop("key")
    schema = joined.drop("text", "ranges").schema
    for name, kind in [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *[("kept", "string")] * with_text]:
        schema = schema.add(name, kind)

    def cut(batches):
        for batch in batches:
            n = batch.num_columns
            rows = []
            for text, ranges in zip(batch.column(n - 2).cast(pa.large_binary()).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                spans, rest = _kept(text or b"", ranges)
                size = len(text or b"")
                rows.append((size, size - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), None if text is None else rest.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[i] for r in rows], kinds[i]) for i in range(4 + with_text)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *made], names=schema.names)

    return joined.mapInArrow(cut, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(columns)})
