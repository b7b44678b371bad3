"""Set-similarity join of documents on word shingles, by T-occurrence search.

Two sets of sizes n and m reach the similarity only if they share at least T
shingles, so a partner of a document stands in SHARED of the inverted lists of
its n - T + SHARED rarest shingles (in T of them where T is less). A query is answered by DivideSkip: the longest of
its inverted lists are set aside, a heap merges the short ones and counts how
often each document occurs, and what may still reach T is probed in the long
lists by binary search.

In Spark, a shuffle by shingle builds the lists of rare shingles of all
documents at once and says which documents meet at all. Lengths of lists come
from a table of fixed size, in which all documents are counted; any fixed order
of shingles gives whole results, a good one gives short lists. Documents with equal sets are one node throughout. The links that
join a list's documents are found in two steps, so that groups of near copies
do not make pairs in the square of their size: first every document is held
against one document of its lists, then the pairs of each list that are still
in different components, all of them. Each step is a T-occurrence search of
its queries among the documents that they meet, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import written
from .textkernel import Texts, U, mix, pieces, shingle_sets

WIDTH = 5
#: Slots of the table of list lengths, and of the one of documents wanted for probing.
SLOTS = 1 << 22
CHUNK = 1 << 16
#: Bytes of list entries that a group holds, about.
GROUP_BYTES = 8 << 20
#: Short lists that two documents must share: each set gives so many more shingles to them than one would need.
SHARED = 2
#: An entry of a list. Of a shingle's hash 40 bits travel: others that share them cost a search and change nothing.
ENTRY = (("low", "<u4"), ("high", "<u1"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4"))
ENTRY_BYTES = sum(np.dtype(t).itemsize for _, t in ENTRY)
#: Pairs that leave a task in one batch.
PAIRS = 200_000
#: Partners that a query is searched among at once, about, and the weight of a probe when lists are set aside.
BLOCK, SKIP = 64, 0.01


def set_nodes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, from its sorted shingles; equal sets have equal names."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)))))
    edge = np.concatenate(([0], np.cumsum(sizes)))
    other = np.zeros(len(sizes), U)
    np.bitwise_xor.at(other, doc, mix(values * U(0xC2B2AE3D27D4EB4F)))
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ mix(other + sizes.astype(U))).view(np.int64)


def _each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the batches with the shingles, set sizes and nodes of their last column."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for low, high in pieces(column):
            values, sizes = shingle_sets(Texts(column.slice(low, high - low)), WIDTH)
            yield batch.slice(low, high - low), values, sizes, set_nodes(values, sizes)


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), node and n_shingles of every row."""

    def run(batches):
        for part, _, sizes, nodes in _each_piece(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(nodes), pa.array(sizes.astype(np.int64))], names=["doc_id", "key", "node", "n_shingles"])

    chosen = docs.select(F.col("doc_id").cast("long"), _key(), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, key long, node long, n_shingles long")


def _key() -> F.Column:
    return F.xxhash64("doc_id", "text").alias("key")


def _new_ones(seen: set[int], nodes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the non-empty sets that this task has not met before."""
    out = []
    for i, node in enumerate(nodes.tolist()):
        if sizes[i] and node not in seen:
            seen.add(node)
            out.append(i)
    return np.array(out, np.int64)


def fixed_table(rows: DataFrame, slots: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each slot number occurs: summed in the tasks, then by chunks; SLOTS numbers in all reach the driver, in one job.

    ``slots`` makes arrays of slot numbers of the batches of ``rows``.
    """
    import zstandard

    def count(batches):
        table = np.zeros(SLOTS, np.uint32)
        for some in slots(batches):
            if 8 * len(some) > SLOTS:
                table += np.bincount(some, minlength=SLOTS).astype(np.uint32)
            else:
                np.add.at(table, some, 1)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        found = [(i, squeeze(part.tobytes())) for i, part in enumerate(table.reshape(-1, CHUNK)) if part.any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        have: dict[int, np.ndarray] = {}
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(expand(blob), np.uint32)
                have[i] = have[i] + part if i in have else part
        squeeze = zstandard.ZstdCompressor(level=1).compress
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([squeeze(x.tobytes()) for x in have.values()], pa.binary())], names=["chunk", "counts"])

    parts = rows.mapInArrow(count, "chunk int, counts binary").repartition(SLOTS // CHUNK, "chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(SLOTS, np.uint32)
    expand = zstandard.ZstdDecompressor().decompress
    for row in parts.collect():  # SLOTS numbers at most
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(expand(bytes(row["counts"])), np.uint32)
    return out


def list_lengths(docs: DataFrame) -> np.ndarray:
    """Length of the inverted lists of all documents, summed over the shingles of a slot."""

    def slots(batches):
        seen: set[int] = set()
        for _, values, sizes, nodes in _each_piece(batches):
            chosen = np.zeros(len(sizes), bool)
            chosen[_new_ones(seen, nodes, sizes)] = True
            yield (values[np.repeat(chosen, sizes)] & U(SLOTS - 1)).astype(np.int64)

    return fixed_table(docs.select(F.col("text").cast("string")), slots)


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """T: the least intersection of sets of sizes n and m for the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def short_lists(docs: DataFrame, lengths: np.ndarray, percent: int, groups: int) -> DataFrame:
    """Entries of all documents' short lists, packed by (group of shingles, task)."""
    wide = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        seen: set[int] = set()
        table = wide.value
        for _, values, sizes, nodes in _each_piece(batches):
            new = _new_ones(seen, nodes, sizes)
            if not len(new):
                continue
            edge = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, table[(values & U(SLOTS - 1)).astype(np.int64)], doc))
            kept = np.minimum(sizes, sizes - (percent * sizes + 99) // 100 + SHARED)
            size = kept[new]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            token = values[order[np.repeat(edge[new], size) + at]]
            group = (token & U((1 << 24) - 1)).astype(np.int64) % groups
            order = np.argsort(group, kind="stable")
            token, doc_of, cut = token[order], np.repeat(new, size)[order], np.searchsorted(group[order], np.arange(groups + 1))
            columns = [c.astype(t) for c, (_, t) in zip((token & U(0xFFFFFFFF), (token >> U(32)) & U(0xFF), nodes[doc_of], sizes[doc_of], at[order]), ENTRY, strict=True)]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([b"".join(c[cut[g] : cut[g + 1]].tobytes() for c in columns) for g in some], pa.binary())], names=["group", "entries"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "group int, entries binary")


def _can_link(n, i, m, j, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m that meet at places i and j of the order, for the SHARED-th time at most, may still share enough."""
    n, i, m, j = (x.astype(np.int64) for x in (n, i, m, j))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (SHARED - 1 + np.minimum(n - i, m - j) >= required(n, m, percent))


def _enough(n: F.Column, m: F.Column, shared: F.Column, percent: int) -> F.Column:
    """Whether sets of sizes n and m that meet in ``shared`` short lists meet often enough to link."""
    return shared >= F.least(F.lit(SHARED), F.ceil(percent * (n + m) / (100 + percent)))


def _entries(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """token, node, n and at of packed entries."""
    parts: list[list[np.ndarray]] = [[] for _ in ENTRY]
    for blob in blobs:
        count, start = len(blob) // ENTRY_BYTES, 0
        for part, (_, kind) in zip(parts, ENTRY, strict=True):
            part.append(np.frombuffer(blob, kind, count, start))
            start += count * np.dtype(kind).itemsize
    low, high, node, n, at = (np.concatenate(p) for p in parts)
    return low.astype(np.int64) | high.astype(np.int64) << 32, node, n, at


def merge_lists(packed: DataFrame, percent: int) -> DataFrame:
    """The short lists of two documents or more: token, node, n, at, first and first_n (the list's hub, where it may link with the node).

    The hub is the document that has the fewest rarer shingles than the list's:
    of near copies the one that the others were made from, or the one least
    changed, so that most of them link with it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token, node, n, at = _entries(pdf["entries"].tolist())
        order = np.lexsort((node, token))
        token, node, n, at = (x[order] for x in (token, node, n, at))
        same = (token[1:] == token[:-1]) & (node[1:] == node[:-1])
        kept = np.concatenate(([True], ~same))
        token, node, n, at = (x[kept] for x in (token, node, n, at))
        size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token)))
        kept = np.repeat(size > 1, size)
        token, node, n, at = (x[kept] for x in (token, node, n, at))
        size = size[size > 1]
        start = np.repeat(np.cumsum(size) - size, size)
        head = np.lexsort((node, at, start))[start]
        may = (node[head] != node) & _can_link(n, at, n[head], at[head], percent) if len(node) else np.zeros(0, bool)
        first = pd.array(np.where(may, node[head], 0), dtype="Int64")
        first[~may] = pd.NA
        return pd.DataFrame({"token": token, "node": node, "n": n.astype(np.int64), "at": at.astype(np.int64), "first": first, "first_n": n[head].astype(np.int64)})

    return packed.groupBy("group").applyInPandas(run, "token long, node long, n long, at long, first long, first_n long")


def pairs_apart(lists: DataFrame, known: DataFrame, percent: int, groups: int) -> DataFrame:
    """Pairs of a list's nodes that are in different components of ``known``, may link and meet in SHARED lists."""
    placed = lists.join(known, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("component"))

    def run(batches):
        held = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame(columns=["token", "node", "n", "at", "component"], dtype=np.int64)])
        held = held.sort_values(["token", "component", "node"])
        token, node, n, at, component = (held[c].to_numpy(np.int64) for c in ("token", "node", "n", "at", "component"))
        edge = np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token)) if len(token) else np.zeros(1, np.int64)
        out, waiting = [], 0
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            if component[low] == component[high - 1]:
                continue
            # Every entry with those of later components: blocks of a list's entries, never a list of all pairs.
            later = low + np.searchsorted(component[low:high], component[low:high], side="right")
            for i in range(low, high):
                j = np.arange(later[i - low], high)
                j = j[_can_link(np.full(len(j), n[i]), np.full(len(j), at[i]), n[j], at[j], percent)]
                if len(j):
                    turned = node[j] < node[i]
                    own, own_n = np.full(len(j), node[i]), np.full(len(j), n[i])
                    out.append(np.stack((np.where(turned, node[j], own), np.where(turned, own, node[j]), np.where(turned, n[j], own_n), np.where(turned, own_n, n[j]))))
                    waiting += len(j)
            if waiting > PAIRS:
                yield _batch(out)
                out, waiting = [], 0
        if out:
            yield _batch(out)

    def _batch(out: list[np.ndarray]) -> pa.RecordBatch:
        pairs, many = np.unique(np.concatenate(out, axis=1), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(row)) for row in pairs), pa.array(many)], names=["a", "b", "n", "m", "shared"])

    met = placed.repartition(groups, "token").mapInArrow(run, "a long, b long, n long, m long, shared long").groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    return met.where(_enough(F.col("n"), F.col("m"), F.col("shared"), percent)).select("a", "b")


def occurrences(query: np.ndarray, members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the ``members`` reach the overlap that their size and the query's ask for; all are sorted sets.

    DivideSkip over the inverted lists of the query's shingles: the longest
    lists are set aside, fewer than the least overlap asked for; a heap merges
    the short ones and counts each member; one that may still reach its overlap
    is probed in the long lists, from the shortest on, by binary search.
    """
    size = np.array([len(m) for m in members])
    need = required(len(query), size, percent)
    token, owner = np.concatenate(members), np.repeat(np.arange(len(members)), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    low, high = np.searchsorted(token, query, side="left"), np.searchsorted(token, query, side="right")
    by_length = np.argsort(high - low, kind="stable")
    least = int(need.min())
    aside = min(least - 1, int(least / (SKIP * np.log2(max(2, int((high - low).max()))) + 1)))
    short, long = by_length[: len(query) - aside], by_length[len(query) - aside :]
    count = np.zeros(len(members), np.int64)
    for member in heapq.merge(*(owner[a:b].tolist() for a, b in zip(low[short], high[short], strict=True) if b > a)):
        count[member] += 1
    good = np.zeros(len(members), bool)
    spans = list(zip(low[long].tolist(), high[long].tolist(), strict=True))
    for member in np.flatnonzero(count + aside >= need).tolist():
        have, left, wanted = int(count[member]), aside, int(need[member])
        for a, b in spans:
            if have >= wanted or have + left < wanted:
                break
            place = a + int(np.searchsorted(owner[a:b], member))
            have += place < b and owner[place] == member
            left -= 1
        good[member] = have >= wanted
    return good


def linked(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the similarity: each a is a query against the inverted lists of its b.

    A query with very many partners is searched in blocks of about BLOCK of
    them, in as many tasks; its blocks are summed before they are joined.
    """
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def slots(batches):
        for batch in batches:
            yield (batch.column(0).to_numpy().view(U) & U(SLOTS - 1)).astype(np.int64)

    wanted = spark.sparkContext.broadcast(np.packbits(fixed_table(nodes, slots) > 0))

    def run(batches):
        seen: set[int] = set()
        bits = np.unpackbits(wanted.value).astype(bool)
        for _, values, sizes, own in _each_piece(batches):
            edge = np.concatenate(([0], np.cumsum(sizes)))
            new = _new_ones(seen, own, sizes * bits[(own.view(U) & U(SLOTS - 1)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(own[new]), pa.array([values[edge[i] : edge[i + 1]].tobytes() for i in new], pa.binary())], names=["node", "shingles"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "node long, shingles binary")
    sets = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    blocks = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "join-blocks")
    dealt = pairs.join(blocks, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("block"), "b")
    members = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "shingles")
    queries = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "block", F.col("a").alias("b"), "shingles")

    def search(batches):
        own, query, names, sets_ = None, None, [], []

        def done() -> pa.RecordBatch:
            good = occurrences(query, sets_, percent) if names else np.zeros(0, bool)
            some = np.array(names, np.int64)[good]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), own[0], np.int64)), pa.array(some)], names=["a", "b"])

        for batch in batches:
            for a, block, b, shingles in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (a, block) != own:
                    if own is not None:
                        yield done()
                    own, query, names, sets_ = (a, block), None, [], []
                if a == b:
                    query = np.frombuffer(shingles, "<u8")
                else:
                    names.append(b)
                    sets_.append(np.frombuffer(shingles, "<u8"))
        if own is not None:
            yield done()

    rows = members.union(queries).repartition("a", "block").sortWithinPartitions("a", "block")
    return rows.mapInArrow(search, "a long, b long")


def node_components(docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another set; ``rows`` are those of ``sets_of(docs)``."""
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    groups = max(16, -(-int(total) * ENTRY_BYTES // (100 // (100 - percent) * GROUP_BYTES)))
    lists = written(merge_lists(short_lists(docs, list_lengths(docs), percent, groups), percent), "join-lists")
    met = lists.where("first IS NOT NULL").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.first("first_n").alias("n"), F.first("n").alias("m"))
    once = written(met.where(_enough(F.col("n"), F.col("m"), F.col("shared"), percent)).select("a", "b"), "join-first-pairs")
    links = written(linked(docs, once, percent), "join-links")
    asked = once.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(pairs_apart(lists, components(links), percent, groups).join(asked, ["a", "b"], "left_anti"), "join-pairs")
    return components(links.union(linked(docs, rest, percent)) if not rest.isEmpty() else links)


def join_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows link when their sets' intersection is at least ``percent`` hundredths
    of the union. A null or empty text, or one without words, links with
    nothing: its component_id is its own doc_id. Rows with equal sets are
    linked, repeated rows too. A null doc_id takes part; a component whose
    rows all have null ids has a null component_id. Other columns are not
    read. Names of sets are 64-bit hashes of all their shingles.
    """
    rows = written(sets_of(docs), "join-sets")
    full = rows.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("least")).join(node_components(docs, rows, percent), "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = nodes.join(smallest, "component").select("node", "component_id")
    return full.join(of_node, "node").select("doc_id", "n_shingles", "component_id").union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the row with the smallest doc_id stays.

    Where ids are equal or null, the hash of the text decides, ids before
    nulls; of rows with the same doc_id and text one stays. Rows without words
    are linked with nothing and stay all.
    """
    rows = written(sets_of(docs), "join-sets")
    full = rows.where("n_shingles > 0").join(node_components(docs, rows, percent), "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = full.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("__kept"), F.lit(True).alias("__once"))
    wordless = rows.where("n_shingles = 0").select(F.col("key").alias("__kept"), F.lit(False).alias("__once")).distinct()
    stays = docs.withColumn("__key", _key()).join(chosen.union(wordless), F.col("__key") == F.col("__kept")).drop("__kept")
    return stays.where("__once").dropDuplicates(["__key"]).union(stays.where("NOT __once")).select(*docs.columns)
