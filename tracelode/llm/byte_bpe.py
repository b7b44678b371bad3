"""Byte-level BPE over Arrow batches: distinct words are merged together, step by step.

The texts of a batch are cut into words by the public pattern. Words that are
not held ready are merged all at once: their ids lie in one array, and each
step replaces, in every word that still has one, the first adjacent pair of
lowest rank. The ranks of all pairs lie in a rank map without collisions, in
which two small sums find a pair's only place. Long words are merged one by
one through a heap, so their time grows with n log n. Merged words stay ready
for the next texts, up to a bound. Decoding concatenates the byte pieces of
the ids.
"""

from __future__ import annotations

import base64
import heapq
import random
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an id or rank; NO_PAIR is the rank of pairs that never merge.
ID_BITS = 17
NO_PAIR = 1 << ID_BITS
#: Words whose ids a task holds ready, at most; they are dropped together when there are more.
READY = 200_000
#: Bytes of a word from which on it is merged through a heap.
LONG_WORD = 64
#: Characters of the texts that are worked on together, about.
PIECE_CHARS = 1 << 20
#: Letters and numbers of Unicode 17 and 18, which the public library's Unicode 16 does not have: they are signs to it.
LATER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9"
    r"\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2"
    r"\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
ENCODED = "doc_id long, ids array<int>, n_tokens long, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def library_pattern(pattern: str) -> str:
    """The public pattern with letters and numbers as the library's Unicode has them."""
    return "(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{LATER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER}]]")


def place_pairs(pairs: dict[tuple[int, int], int], seed: int = 5) -> tuple[list[int], list[int]]:
    """(shifts, table) such that pair (a, b), as the number k = a << ID_BITS | b, has its only place in ``table`` at (k ^ shifts[k % len(shifts)]) % len(table).

    The entry there is k << ID_BITS | rank.
    """
    draw = random.Random(seed)
    groups: list[list[int]] = [[] for _ in range(max(1, len(pairs) // 3) | 1)]
    ranks = {a << ID_BITS | b: rank for (a, b), rank in pairs.items()}
    for k in ranks:
        groups[k % len(groups)].append(k)
    size = max(7, len(pairs) * 4 // 3) | 1
    table, shifts = [1 << 62] * size, [0] * len(groups)
    for g in sorted(range(len(groups)), key=lambda g: -len(groups[g])):
        while True:
            shift = draw.getrandbits(33)
            places = {(k ^ shift) % size for k in groups[g]}
            if len(places) == len(groups[g]) and all(table[p] == 1 << 62 for p in places):
                break
        shifts[g] = shift
        for k in groups[g]:
            table[(k ^ shift) % size] = k << ID_BITS | ranks[k]
    return shifts, table


class ByteBpe:
    """Encodes and decodes with one vocabulary, in which every single byte and at most NO_PAIR pieces must be."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = READY):
        if len(ranks) > NO_PAIR or max(ranks.values(), default=0) >= NO_PAIR or any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError(f"the vocabulary needs every single byte and ranks below {NO_PAIR}")
        self.pattern, self.most = library_pattern(pattern), most
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        pairs = {(a, b): rank for piece, rank in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None}
        self.shifts, self.table = (np.array(x, np.int64) for x in place_pairs(pairs))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs; another pair's entry, or an empty one, differs above the rank's bits."""
        pair = a << ID_BITS | b
        entry = self.table[(pair ^ self.shifts[pair % len(self.shifts)]) % len(self.table)]
        return np.minimum(entry ^ pair << ID_BITS, NO_PAIR)

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word; one merge of every unfinished word in each step."""
        out: list[tuple[int, ...]] = [()] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        number = np.flatnonzero(size)
        size = size[number]
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        while len(ids):
            head = np.cumsum(size) - size
            rank = np.full(len(ids), NO_PAIR, np.int64)
            rank[:-1] = self.ranks_of(ids[:-1], ids[1:])
            rank[head + size - 1] = NO_PAIR
            low, at = np.divmod(np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), head), len(ids))
            done = low == NO_PAIR
            for k, first, n in zip(number[done].tolist(), head[done].tolist(), size[done].tolist(), strict=True):
                out[k] = tuple(ids[first : first + n].tolist())
            stay = np.repeat(~done, size)
            ids[at[~done]] = low[~done]
            stay[at[~done] + 1] = False
            ids, number, size = ids[stay], number[~done], size[~done] - 1
        return out

    def merged_long(self, word: bytes) -> tuple[int, ...]:
        """The ids of one long word: pairs wait in a heap, and those whose ends have changed are passed over."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        first = self.ranks_of(ids[:-1], ids[1:]).tolist()
        ids, end = ids.tolist(), len(word)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(first) if rank < NO_PAIR]
        heapq.heapify(heap)
        shifts, table = self.shifts, self.table

        def push(i: int, j: int) -> None:
            pair = ids[i] << ID_BITS | ids[j]
            entry = int(table[(pair ^ int(shifts[pair % len(shifts)])) % len(table)]) ^ pair << ID_BITS
            if entry < NO_PAIR:
                heapq.heappush(heap, (entry, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= end or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return tuple(x for x in ids if x >= 0)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ENCODED for batches of (doc_id, text)."""
        import regex

        cut = regex.compile(self.pattern).findall
        ready: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            low, held = 0, 0
            for k in range(batch.num_rows):
                held += len(batch.column(1)[k].as_py() or "")
                if held >= PIECE_CHARS or k + 1 == batch.num_rows:
                    yield self._encoded(batch.slice(low, k + 1 - low), cut, ready)
                    low, held = k + 1, 0

    def _encoded(self, batch: pa.RecordBatch, cut, ready: dict[str, tuple[int, ...]]) -> pa.RecordBatch:
        words = [cut(text or "") for text in batch.column(1).to_pylist()]
        new = list(set(chain.from_iterable(words)).difference(ready))
        if len(ready) + len(new) > self.most:
            ready.clear()
            new = list(set(chain.from_iterable(words)))
        encoded = [w.encode() for w in new]
        short = [k for k, w in enumerate(encoded) if len(w) < LONG_WORD]
        ready |= zip((new[k] for k in short), self.merged([encoded[k] for k in short]), strict=True)
        ready |= {new[k]: self.merged_long(w) for k, w in enumerate(encoded) if len(w) >= LONG_WORD}
        ids = [list(chain.from_iterable(map(ready.__getitem__, w))) for w in words]
        ends = np.cumsum([0, *map(len, ids)])
        flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        decoded = [b"".join(map(self.pieces.__getitem__, x)) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "n_tokens", "decoded"])


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = READY) -> DataFrame:
    """doc_id, ids (an array), n_tokens and decoded (bytes) of every row's whole text.

    Null and empty texts have no ids and decode to no bytes; an empty table
    gives no rows. Repeated rows and rows with a null doc_id are encoded each.
    Other columns are not read. Very long texts are encoded whole. ``most``,
    the words that a task holds ready, changes the time, never the ids. The
    vocabulary must hold every single byte.
    """
    bpe = docs.sparkSession.sparkContext.broadcast(ByteBpe(ranks, pattern, most))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: bpe.value.batches(batches), ENCODED)
