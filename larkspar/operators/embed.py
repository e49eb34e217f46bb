"""Embedding of texts by a pluggable embedder, only where no unit of equal content has a vector yet."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.operators.catalog import cached_embeddings


#: Texts sent to a server in one call, at most.
TOGETHER = 64


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Deterministic: signed counts of hashed words, to unit length."""

    dims: int = 64

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dims)
        for w in re.findall(r"\w+", text):
            h = crc32(w.encode())
            v[h % self.dims] += 1 if h >> 16 & 1 else -1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).astype(np.float32).tolist()


@dataclass(frozen=True)
class DigestEmbedder:
    """Deterministic: signs from a text's SHAKE-256, so that equal texts have equal vectors and others are far apart. Finds exact copies only."""

    dims: int = 64

    def embed(self, text: str) -> list[float]:
        bits = np.unpackbits(np.frombuffer(hashlib.shake_256(text.encode()).digest(self.dims // 8), np.uint8))
        return ((2.0 * bits - 1) / np.sqrt(len(bits))).astype(np.float32).tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """A server that takes {"model", "input"} at <base>/api/embed and returns {"embeddings": [[...]]}. Any other answer than 2xx is an error."""

    model: str = "bge-m3"
    base: str = "http://localhost:11434"
    timeout: float = 60.0

    def with_url(self, base: str) -> HttpEmbedder:
        return HttpEmbedder(self.model, base, self.timeout)

    def embed(self, text: str) -> list[float]:
        return self._ask(text)[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """One call for several texts."""
        return self._ask(texts)

    def _ask(self, what: str | list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": what}).encode()
        request = urllib.request.Request(f"{self.base}/api/embed", body, {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)["embeddings"]


def _embedded(embedder: Embedder, texts: list[str]) -> list[list[float] | None]:
    """Together, where the embedder takes several texts; where that fails, one by one, null where one fails."""
    if len(texts) > 1 and hasattr(embedder, "embed_batch"):
        try:
            return list(embedder.embed_batch(texts))
        except OSError:
            pass
    out: list[list[float] | None] = []
    for t in texts:
        try:
            out.append(embedder.embed(t))
        except OSError:
            out.append(None)
    return out


def embed_bodies(rows: DataFrame, embedder: Embedder, column: str = "body") -> DataFrame:
    """rows with embedding; null where the embedder fails."""

    rows = rows.drop("embedding")
    at, names = rows.columns.index(column), [*rows.columns, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(at).to_pylist(), []
            for i in range(0, len(texts), TOGETHER):
                out += _embedded(embedder, texts[i : i + TOGETHER])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["embedding array<float>"])
    return rows.mapInArrow(run, schema)


def with_embeddings(rows: DataFrame, units: DataFrame, embedder: Embedder) -> DataFrame:
    """rows (content_hash, body, ...) with embedding: from the units where equal content has one, else from the embedder, each content once."""
    cached = cached_embeddings(rows, units)
    missing = cached.where("embedding is null").groupBy("content_hash").agg(F.first("body").alias("body"))
    fresh = embed_bodies(missing, embedder).select("content_hash", F.col("embedding").alias("_new"))
    return cached.join(fresh, "content_hash", "left").withColumn("embedding", F.coalesce("embedding", "_new")).drop("_new")
