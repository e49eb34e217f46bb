"""Quality classifier (op5): logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates (McMahan et al., 2013).

Features: words and pairs of neighbouring words, hashed to 2^BITS places, each present or not, over the square root of their number; and a constant. A word that equals the one before it
is read as a mark of repetition, whatever word it is, so that what is learned of one repeated word holds for others. Training: at most SAMPLE labelled
documents, those with the smallest hash of their id (SAMPLE is a parameter, not a share of the input), joined to their texts where those
are read; their features (under 2^BITS numbers each), not their texts, go to one task, which sorts them by hash, reads them EPOCHS times from that sort, batch by batch, and returns the nonzero
weights. Scoring: every document, whole text, as a sparse dot product with those weights.

Labels are used only for documents whose crc32 of the id as text is not 0 modulo FOLDS; the others are held out. Scores depend on the text alone. ALPHA, L1, L2 and EPOCHS were chosen by
training without the documents of remainder 1 and comparing on those.

Labels with a null id or quality, or without a document, are ignored; where an id has several labels or documents, each different pair trains once, up to SAMPLE pairs. Without labels of both
kinds, every score is the share of label 1 (0.5 without any). Null or empty text has the constant only and gets its score. Null doc_id: not held out. Repeated rows get
equal scores. Empty documents give an empty result. Other columns are ignored, or passed through by score().
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import keep, map_texts, raw, table, without

BITS, SAMPLE, EPOCHS, FOLDS, THRESHOLD = 20, 12_000, 8, 5, 0.3
ALPHA, BETA, L1, L2 = 30.0, 1.0, 1.0, 0.1
#: Words of a text are counted in chunks of so many, so that very long texts need little memory.
CHUNK = 200_000
#: The mark of repetition (no crc32 is as large), and multipliers of words and pairs.
MARK = np.uint64(1 << 32)
_TURN = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Distinct places (0 is the constant) and the value each has."""
    words = text.split()
    found, last = [np.zeros(1, np.uint32)], None
    for i in range(0, len(words), CHUNK):
        part = words[i : i + CHUNK + 1]  # a pair needs the next chunk's first word
        h = np.fromiter(map(crc32, part), np.uint64, len(part))
        h[1:][h[1:] == h[:-1]], first = MARK, h[0]
        raw_last = np.uint64(crc32(part[-2])) if len(part) > 1 else None
        if last is not None and first == last:
            h[0] = MARK
        last = raw_last
        one, pair = h * _TURN[0], (h[:-1] * _TURN[1] + h[1:]) * _TURN[2]
        found.append(np.unique(np.concatenate([one >> np.uint64(64 - bits), pair >> np.uint64(64 - bits)])).astype(np.uint32))
    at = np.unique(np.concatenate(found))
    return at, 1.0 / float(np.sqrt(len(at)))


class Ftrl:
    """FTRL-proximal with L1 and L2."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, value: float, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w.sum()) * value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _featured(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t, bits) for t in raw(b)]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([at.tobytes() for at, _ in found], pa.binary()), pa.array([v for _, v in found], pa.float64())], ["quality", "h", "t", "at", "value"])


def _train(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """batches: (epoch, quality, at, value) in the order of training."""
    model, n, ones = Ftrl(bits), 0, 0
    for b in batches:
        for q, at, v in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            model.update(np.frombuffer(at, np.uint32), v, q)
            n, ones = n + 1, ones + q
    if ones in (0, n):
        p = ones / n if n else 0.5
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([float(np.log(p + 0.01) - np.log(1.01 - p))])], ["place", "weight"])
        return
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["place", "weight"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the model; at most a few hundred thousand, as the sample is bounded."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "quality").limit(sample)
    chosen = F.broadcast(keep(chosen, "labels"))  # sample rows of three numbers
    own = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    pairs = own.select("doc_id", "t").join(chosen, "doc_id").distinct().orderBy("h", "doc_id", "quality", "t").limit(sample)
    pairs = F.broadcast(keep(pairs, "sample"))  # sample rows of four numbers
    texts = own.join(pairs, ["doc_id", "t"]).select("text", "quality", "h", "t")
    rows = map_texts(texts, lambda x: _featured(x, bits), "quality int, h long, t long, at binary, value double")
    rows = rows.groupBy("h", "t", "quality").agg(F.min("at").alias("at"), F.min("value").alias("value"))  # repeated rows, combined before the shuffle
    turns = rows.repartition(1).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).sortWithinPartitions("epoch", "h", "t", "quality")
    got = turns.select("epoch", "quality", "at", "value").mapInArrow(lambda x: _train(x, bits), "place long, weight double").toPandas()
    if not len(got):  # no partition, no row
        return np.zeros(1, np.int64), np.zeros(1)
    return got["place"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], columns: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """The named columns of docs (all, if none are named) with score: the chance of label 1."""
    places, weights = docs.sparkSession.sparkContext.broadcast(model[0]), docs.sparkSession.sparkContext.broadcast(model[1])
    own = without(docs, "score")
    columns = own.columns if columns is None else columns
    own = own.select(*columns, *([] if "text" in columns else ["text"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[places.value] = weights.value
        for b in batches:
            out = []
            for text in raw(b):
                at, value = features(text, bits)
                out.append(sigmoid(float(w[at].sum()) * value))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(out, pa.float64())], [*columns, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(columns)])
    return map_texts(own, rows, f"{schema}, score double")


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
