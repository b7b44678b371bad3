"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing places the longest pieces first, each in the fullest open
sequence that still has room for it. Pieces of one length are alike, so the
plan for a corpus of any size follows from how many pieces there are of each
length: at most ``capacity`` counts reach the driver. There, a segment tree
over the remaining capacities finds the tightest open sequences in logarithmic
time; runs of equal pieces go to runs of equally full sequences at once, which
gives the same sequences as one piece at a time. Each piece then takes its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textkernel import pieces
from .tokens import encoder

CAPACITY = 2048
#: Pieces of one length that one task ranks.
RANKED_ROWS = 50_000


class CapacityTree:
    """A segment tree over remaining capacities 0 to ``capacity``: which of them some open sequences have."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        """``n`` sequences from number ``first`` on have ``room`` left."""
        if n > 0:
            self.open[room].append((first, n))
            node = self.width + room
            while node and not self.any[node]:
                self.any[node] = 1
                node //= 2

    def take(self, room: int) -> tuple[int, int]:
        run = self.open[room].pop()
        if not self.open[room]:
            node = self.width + room
            self.any[node] = 0
            node //= 2
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node //= 2
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open sequence has."""
        node = self.width + least
        while not self.any[node]:
            while node & 1:  # a right child: nothing more to its right below this parent
                node //= 2
                if node == 0:
                    return None
            node += 1
            if node & (node - 1) == 0:  # went past the last node of the level
                return None
        while node < self.width:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.width


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, pieces in each sequence, offset of the first in each), by length and rank."""
    tree, new, out = CapacityTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                n = -(-left // each)
                run = (new, n)
                new += n
            else:
                run, each = tree.take(room), room // length
            first, n = run
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            rest = min(rest, each - 1)
            out.append((length, rank, full * each + rest, first, each, capacity - room))
            rank += full * each + rest
            left -= full * each + rest
            tree.add(room - each * length, first, full)
            if rest:
                tree.add(room - rest * length, first + full, 1)
            tree.add(room, first + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            for low, high in pieces(batch.column(1)):
                ids, sizes = known.encode(batch.column(1).slice(low, high - low))
                rows, at = [], 0
                for doc, n in zip(batch.column(0).slice(low, high - low).to_pylist(), sizes.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    rows += [(doc, k, s, len(x := own[s : s + capacity]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, n + 1, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        known.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null text is an empty one: a single ``end_id``. Only documents longer
    than ``capacity`` are cut. Repeated rows, and rows with a null doc_id, are
    packed each. An empty table gives no rows. Other columns are not read.
    """
    cut = written(cut_documents(docs, tokenizer, capacity, end_id), "packing-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    runs = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    # A length that very many pieces have is ranked in shares, each in its own task.
    shares = max(1, -(-max(counts.values(), default=0) // RANKED_ROWS))
    shared = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    ahead = shared.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = shared.withColumn("within", within).join(ahead, ["length", "share"]).withColumn("rank", F.col("ahead") + F.col("within"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            at = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + at // run[:, 4]), pa.array(run[:, 5] + at % run[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return chosen.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
