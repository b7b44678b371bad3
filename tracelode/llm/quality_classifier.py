"""Quality classifier on averaged, hashed subword vectors.

A word's vector is the mean of learned vectors of the word and of its character
n-grams, all hashed to BUCKETS rows; a document's is the mean over its words,
where each word that stood in the document before adds the vector of a repeat;
a softmax layer follows. Both layers are trained on the driver by stochastic
gradient descent in numpy, on a bounded sample of labelled documents. Features
are made in Spark tasks, for training and scoring alike. As a mean of sums is
linear, scoring folds both layers into one number for each bucket.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import BYTE_CODES, PIECE_BYTES, Texts, U, mix, pieces, prefix_hashes, span_hashes

BUCKETS, DIMENSIONS = 1 << 17, 10
GRAMS = (3, 4, 5)
#: The model is fitted on at most so many labelled documents, those with the smallest hash of doc_id.
SAMPLE = 2500
#: Passes over the sample, documents in a step, and step sizes of the layer and of the table.
EPOCHS, BATCH, RATE, TABLE_RATE = 6, 8, 0.1, 5.0
REPEAT = 0
THRESHOLD = 0.3


def _distinct_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each word, its distinct word, buckets of all distinct words, number of each)."""
    start, end, doc = texts.words()
    size = end - start
    out = np.concatenate(([0], np.cumsum(size)))
    data = texts.data[np.repeat(start - out[:-1], size) + np.arange(out[-1])]
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(out), pa.py_buffer(data)]).dictionary_encode()
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in found.dictionary.to_pylist()), np.uint8)
    high = np.cumsum(np.diff(np.frombuffer(found.dictionary.buffers()[1], np.int64)[: len(found.dictionary) + 1]) + 2)
    low = np.concatenate(([0], high[:-1]))
    prefix = prefix_hashes(BYTE_CODES[joined])
    owner, hashes = [np.arange(len(low))], [span_hashes(prefix, low, high)]
    of_byte = np.repeat(np.arange(len(low)), high - low)
    for n in GRAMS:
        at = np.flatnonzero(of_byte[: len(joined) - n + 1] == of_byte[n - 1 :]) if len(joined) >= n else np.zeros(0, np.int64)
        owner.append(of_byte[at])
        hashes.append(span_hashes(prefix, at, at + n) ^ U(n))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (1 + mix(np.concatenate(hashes)) % U(BUCKETS - 1)).astype(np.int64)[order]
    return doc, found.indices.to_numpy(), bucket, np.bincount(owner, minlength=len(low))


def _repeats(texts: Texts, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    n = np.bincount(doc, minlength=texts.n)
    each = np.unique(doc * (int(word.max(initial=0)) + 1) + word)
    return n - np.bincount(each // (int(word.max(initial=0)) + 1), minlength=texts.n)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that add up to one) of each document; nothing for one without words."""
    texts = Texts(column)
    doc, word, bucket, many = _distinct_words(texts)
    repeats, n = _repeats(texts, doc, word), np.bincount(doc, minlength=texts.n)
    first = np.cumsum(many) - many
    edge = np.concatenate(([0], np.cumsum(n)))
    out = []
    for i in range(texts.n):
        own, times = np.unique(word[edge[i] : edge[i + 1]], return_counts=True)
        if not len(own):
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        size = many[own]
        place = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        share = np.append(np.repeat(times / size, size), repeats[i]) / (n[i] + repeats[i])
        found, which = np.unique(np.append(bucket[place], REPEAT), return_inverse=True)
        out.append((found, np.bincount(which, weights=share)))
    return out


@dataclass
class Model:
    """Score of each bucket, and of an empty document."""

    bucket: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        texts = Texts(column)
        doc, word, bucket, many = _distinct_words(texts)
        n, repeats = np.bincount(doc, minlength=texts.n), _repeats(texts, doc, word)
        total = repeats * self.bucket[REPEAT]
        if len(many):
            of_word = np.add.reduceat(self.bucket[bucket], np.cumsum(many) - many) / many
            total = total + np.bincount(doc, weights=of_word[word], minlength=texts.n)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(1, n + repeats), -500, 500)))


def train(documents: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent of both layers. Without documents of both kinds, the score is the share of good ones."""
    share = float(np.clip((good.sum() + 1) / (len(good) + 2), 1e-6, 1 - 1e-6))
    prior = float(np.log(share / (1 - share)))
    if len(set(good.tolist())) < 2:
        return Model(np.zeros(BUCKETS), prior)
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.array([-prior / 2, prior / 2])
    steps, done = EPOCHS * -(-len(documents) // BATCH), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(documents))
        for k in range(0, len(order), BATCH):
            chosen = order[k : k + BATCH]
            left = 1 - done / steps
            rate = RATE * left
            done += 1
            rows, local = np.unique(np.concatenate([documents[i][0] for i in chosen]), return_inverse=True)
            weight = np.concatenate([documents[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(documents[i][0]) for i in chosen])
            vector = table[rows]
            mean = np.stack([np.bincount(owner, weights=weight * vector[local, d], minlength=len(chosen)) for d in range(DIMENSIONS)], axis=1)
            logit = mean @ layer.T + bias
            chance = np.exp(logit - logit.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(chosen)), good[chosen].astype(int)] -= 1
            back = chance @ layer
            layer -= rate * chance.T @ mean
            bias -= 0.1 * rate * chance.mean(0)
            for d in range(DIMENSIONS):
                table[rows, d] -= TABLE_RATE * left * np.bincount(local, weights=weight * back[owner, d], minlength=len(rows))
    folded = table @ (layer[1] - layer[0])
    return Model(folded, float(bias[1] - bias[0]))


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled rows that are not held out; a document labelled twice counts as good only if no label says otherwise."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~_held_out()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("good").cast("int").alias("good"), "text")

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for low, high in pieces(column):
                found = features(column.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:2]), pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in found], pa.binary())], names=["doc_id", "good", "bucket", "weight"])

    # `sample` documents at most; where a doc_id stands several times, all its rows, up to the same number.
    kept = rows.mapInArrow(run, "doc_id long, good int, bucket binary, weight binary").orderBy("doc_id", "bucket").limit(sample).collect()
    return train([(np.frombuffer(r["bucket"], "<i4").astype(np.int64), np.frombuffer(r["weight"], "<f4").astype(float)) for r in kept], np.array([r["good"] for r in kept], np.int64))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only ``text`` enters the score.

    Null and empty texts, and texts of white space, get the score of no words.
    Repeated rows get equal scores; for a null doc_id held_out is false.
    """
    wide = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            score = [wide.value.score(column.slice(low, high - low)) for low, high in pieces(column, PIECE_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
