"""Near-duplicate vectors by inverted lists with product-quantised residuals and exact rerank.

Coarse centres and subspace code books are fitted on a bounded sample; every
vector is assigned to its nearest centre and keeps the codes of its residual
and the length of its coding error. A query probes each list whose cell comes
near enough; table lookups give its distance to every coded vector of the
list, and as the true distance differs by at most the coding error, the lookup
never loses a link; what is left gets its exact cosine in double precision.

All vectors are queries. Equal vectors are one node with a multiplicity, so
copies are not compared among each other. Lists are dealt out in blocks of
vectors and of queries; a block returns counts for each vector and a spanning
forest of its links, not the links.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written

#: Vectors that the centres and code books are fitted on: SAMPLE for each list, SAMPLE * MOST_LISTS at most, those with the smallest hash. Every vector is indexed.
SAMPLE, MOST_LISTS, CODES, SUBSPACE = 32, 2048, 64, 8
#: Vectors, and queries, of one block.
BLOCK = 2000
#: How far beyond its own cell's border a query looks, as a multiple of what partners in random directions need.
MARGIN = 1.2


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T), axis=1)


def _means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means centres; k is at most the number of rows."""
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centres)
    return centres


@dataclass
class Index:
    """Centres, code books of the residual's subspaces, and how far over a cell's border to probe."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]
    radius: float
    reach: float

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the coding error) of unit vectors."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, cut], book) for cut, book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        coded = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return own, codes, np.sqrt(np.einsum("ij,ij->i", rest - coded, rest - coded))

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """Distance of each vector to the border between its own cell and each other cell."""
        far = np.einsum("ij,ij->i", self.centres, self.centres) - 2 * (x @ self.centres.T)
        own = np.argmin(far, axis=1)
        apart = np.sqrt(np.maximum(1e-24, ((self.centres[own][:, None, :] - self.centres[None]) ** 2).sum(2)))
        out = (far - far[np.arange(len(x)), own][:, None]) / (2 * apart)
        out[np.arange(len(x)), own] = 0
        return out

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.flatnonzero(row) for part in np.array_split(x, max(1, len(x) // 256)) for row in self.beyond(part) <= self.reach]

    def lookup(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each query to the coded form of each vector of a list."""
        rest = queries - self.centres[number]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = (np.einsum("ij,ij->i", rest[:, cut], rest[:, cut])[:, None] - 2 * rest[:, cut] @ book.T + np.einsum("ij,ij->i", book, book)).astype(np.float32)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def list_count(n: int) -> int:
    """Lists for ``n`` vectors: about the root of n, so that lists and centres grow alike."""
    return int(min(MOST_LISTS, max(1, 2 ** round(np.log2(max(1, n) ** 0.5)))))


def fit(sample: np.ndarray, n: int, threshold: float, seed: int = 11) -> Index:
    """The index for ``n`` unit vectors, fitted on a sample of them."""
    random = np.random.default_rng(seed)
    lists = min(list_count(n), max(1, len(sample) // 8))
    centres = _means(sample, lists, random)
    rest = sample - centres[_nearest(sample, centres)]
    width = sample.shape[1]
    cuts = [slice(i, min(width, i + SUBSPACE)) for i in range(0, width, SUBSPACE)]
    books = [_means(rest[:, c], min(CODES, len(sample)), random) for c in cuts]
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    # A partner at the radius in a random direction comes nearer to a border by about radius / sqrt(width), normally distributed.
    reach = min(radius, MARGIN * 3 * radius / np.sqrt(width)) if lists > 1 else radius
    return Index(centres, books, cuts, radius, reach)


def _forest(a: np.ndarray, b: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that join what the links (a, b), places in ``name``, join."""
    label = name.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    some = np.unique(np.concatenate((a, b)))
    return name[some], label[some]


def _unit(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()], np.float64).reshape(len(column), width)


def link_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Links are pairs with cosine of at least ``threshold``; none below it is
    returned. Null, empty and zero vectors, and vectors with null or non-finite
    components, link with nothing: n_links 0, component_id their vec_id, kept
    true. Vectors of different lengths never link; each length has an index of
    its own. Rows with equal vectors are linked. A null vec_id takes part and
    is never the smallest; if it stands alone its component_id is null and it
    is kept. An empty table gives no rows. Columns other than vec_id and
    embedding are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("raw"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(rows.select("vec_id", F.when(fine, F.xxhash64("v")).alias("node"), F.when(fine, F.size("v")).alias("width"), F.when(fine, F.col("raw")).alias("raw")), "vectors")
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"), F.first("width").alias("width"), F.first("raw").alias("raw")), "vector-nodes")
    found = [_links_of_width(nodes.where(F.col("width") == r["width"]), r["width"], r["n"], threshold) for r in nodes.groupBy("width").agg(F.count("*").alias("n")).collect()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = reduce(DataFrame.union, found)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = nodes.select("node", "many", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = least.join(smallest, "component").join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(of_node, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _scaled(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision; scaled before squaring, so that very long or short ones keep their direction."""
    x = _unit(column, width)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _links_of_width(nodes: DataFrame, width: int, n: int, threshold: float) -> DataFrame:
    """(node, links, root) of the nodes (node, many, raw) that link, several rows for each: numbers of links, and a forest of them.

    Vectors travel as they are stored and become unit vectors where they are
    used, so single precision is half the shuffle.
    """
    spark = nodes.sparkSession
    sample = nodes.orderBy("node").limit(SAMPLE * list_count(n)).select("raw").toArrow().column(0).combine_chunks()
    index = spark.sparkContext.broadcast(fit(_scaled(sample, width), n, threshold))
    stored = dict(nodes.dtypes)["raw"]

    def assign(batches):
        for batch in batches:
            x = _scaled(batch.column(2), width)
            own, codes, error = index.value.encode(x)
            probes = index.value.probes(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))], names=["node", "many", "raw", "list", "codes", "error", "probes"])

    placed = written(nodes.select("node", "many", "raw").mapInArrow(assign, f"node long, many long, raw {stored}, list int, codes binary, error double, probes array<int>"), "vector-lists")
    held = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    asked = {r["list"]: r["n"] for r in placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame([(k, -(-m // BLOCK), -(-asked.get(k, 0) // BLOCK)) for k, m in held.items()], "list int, blocks int, turns int")
    part = lambda m: F.pmod(F.xxhash64("node"), m).cast("int")
    members = placed.select("node", "many", "raw", "list", "codes", "error").join(F.broadcast(blocks), "list").select("list", part(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "node", "many", "raw", "codes", "error")
    queries = placed.select("node", "raw", F.explode("probes").alias("list")).join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part(F.col("turns")).alias("turn"), "node", F.lit(0).cast("long").alias("many"), "raw", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        of_list = pdf["codes"].notna().to_numpy()
        a, b = pdf[~of_list], pdf[of_list]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, y = (_scaled(pa.array(side["raw"]), width) for side in (a, b))
        codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1)
        name_a, name_b = a["node"].to_numpy(), b["node"].to_numpy()
        near = index.value.lookup(x, int(key[0]), codes) - b["error"].to_numpy()[None] <= index.value.radius + 1e-3
        near &= name_a[:, None] != name_b[None]
        i, j = np.nonzero(near)
        good = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
        i, j = i[good], j[good]
        if not len(i):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        links = np.bincount(i, weights=b["many"].to_numpy()[j], minlength=len(a)).astype(np.int64)
        name, place = np.unique(np.concatenate((name_a, name_b)), return_inverse=True)
        node, root = _forest(place[i], place[len(a) + j], name)
        asked = pd.Series(links, index=name_a)
        return pd.DataFrame({"node": node, "links": asked.reindex(node).fillna(0).astype(np.int64).to_numpy(), "root": root})

    return written(members.unionByName(queries).groupBy("list", "block", "turn").applyInPandas(compare, "node long, links long, root long"), "vector-links")
