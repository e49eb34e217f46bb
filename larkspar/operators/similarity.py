"""Exact cosine joins and k-nearest-neighbour lookups over vectors, and an approximate one.

block_join() multiplies blocks of unit vectors with numpy. While the corpus is at most BROADCAST_BYTES it is sent to every task and the queries stream past it; beyond
that, both sides are cut into blocks of BLOCK_BYTES and meet block by block (each side is copied once for each block of the other), so memory stays bounded at any
size. With k, each block pair returns the best k of its queries, and a window over those few rows picks the final k. Queries that have k partners of a similarity of
1 - EQUAL or more, which nothing else can beat, don't go there: _settled() finds these by a plain join on cells of a few projections.

Pruning (exact): blocks are made of the vectors nearest to a common pivot where pivots are given; a pair of blocks whose angle between pivots exceeds both radii
and the threshold's angle together can't hold a match and is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.scalars import at_least, pair_key
from larkspar.functions.vectors import dot, norm
from larkspar.tables import written

BROADCAST_BYTES, BLOCK_BYTES, PIVOTS, MOST_PIVOTS = 64 << 20, 32 << 20, 64, 512
#: Stands for a null group.
NONE = -(1 << 63)
_ROWS, _COLUMNS, MARGIN = 1024, 16_384, 1e-4
#: Similarities from 1 - EQUAL on are found by cells: CELLS projections of unit vectors in steps of WIDTH; such vectors are at most sqrt(2 * EQUAL) apart, which REACH exceeds. Vectors
#: of the corpus in a cell up to which it is joined.
EQUAL, CELLS, WIDTH, REACH, CROWDED = 1e-10, 8, 0.01, 2e-5, 64


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    """Unit vectors as rows; zero vectors stay zero. An error if lengths differ."""
    if isinstance(vectors, list):
        lengths = {len(v) for v in vectors}
        if len(lengths) > 1:
            raise ValueError(f"vectors of different dimensions: {sorted(lengths)}")
    m = np.array(vectors, np.float64).reshape(len(vectors), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _hits(ids: pa.Array, a: np.ndarray, other: pa.Array, b: np.ndarray, threshold: float | None, k: int | None, names: tuple[str, ...] = ("q", "c", "similarity"), same: tuple[np.ndarray, np.ndarray, bool] | None = None) -> Iterator[pa.RecordBatch]:
    """(id, other id, similarity) of two sets of unit vectors: those at or above the threshold, of each id the best k (and those as similar as the last of them).

    Tiles of _ROWS by _COLUMNS are multiplied in single precision, which finds candidates with a margin; those found are computed again in double precision. With k, what the
    tiles so far have found bars what is below each row's k-th best. same: numbers of the ids and of the others, and whether only equal or only different ones may meet (negative: any)."""
    narrow = b.astype(np.float32).T
    for i in range(0, len(ids), _ROWS):
        x = a[i : i + _ROWS]
        x32 = x.astype(np.float32)
        bar = np.full(len(x), -np.inf if threshold is None else threshold - MARGIN, np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best = np.full((len(x), 0), -np.inf, np.float32)
        for j in range(0, narrow.shape[1], _COLUMNS):
            s = x32 @ narrow[:, j : j + _COLUMNS]
            ok = ~np.isnan(s)
            if same:
                mine, theirs, equal = same[0][i : i + _ROWS, None], same[1][None, j : j + _COLUMNS], same[2]
                ok &= (mine < 0) | ((mine == theirs) == equal)
            ok &= s >= bar[:, None]
            if k is not None and ok.any():
                best = np.concatenate([best, np.where(ok, s, -np.inf)], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
                    bar = np.maximum(bar, best.min(axis=1) - MARGIN)
                    ok &= s >= bar[:, None]
            rows, columns = np.nonzero(ok)
            for n in range(0, len(rows), 65_536):
                r, c = rows[n : n + 65_536], columns[n : n + 65_536] + j
                exact = np.einsum("ij,ij->i", x[r], b[c])
                if threshold is not None:
                    keep = exact.astype(np.float32) >= np.float32(threshold)
                    r, c, exact = r[keep], c[keep], exact[keep]
                if k is None:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + i)), other.take(pa.array(c)), pa.array(exact)], list(names))
                else:
                    found.append((r, c, exact))
        if found:
            r, c, exact = (np.concatenate(y) for y in zip(*found, strict=True))
            order = np.lexsort((-exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.searchsorted(r, r)  # where each row's best stands
            last = np.minimum(first + k - 1, np.searchsorted(r, r, "right") - 1)
            keep = exact >= exact[last]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[keep] + i)), other.take(pa.array(c[keep])), pa.array(exact[keep])], list(names))


def _size(df: DataFrame) -> tuple[int, int]:
    n, dims = df.agg(F.count("*"), F.max(F.size("v"))).first()
    return n, 8 * n * (dims or 1)


def _celled(batches: Iterator[pa.RecordBatch], around: bool) -> Iterator[pa.RecordBatch]:
    """The rows (id, v, ...) with the cell of v; around: once for each cell that is within REACH. Vectors without a direction have none."""
    mix = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(CELLS)], np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        u = _unit(_rows(b.column(1)))
        r = np.random.default_rng(42).normal(size=(u.shape[1], CELLS))
        at = u @ (r / np.maximum(np.sqrt((r * r).sum(axis=0)), 1e-300)) / WIDTH
        rows = np.flatnonzero(np.isfinite(at).all(axis=1) & u.any(axis=1))
        cells = np.floor(at[rows])
        if around:
            low, high = (np.floor(at[rows] + d * REACH / WIDTH) for d in (-1, 1))
            whole = (low == high).all(axis=1)
            extra = [(n, c) for n, x, y in zip(rows[~whole], low[~whole], high[~whole], strict=True) for c in product(*({i, j} for i, j in zip(x, y, strict=True)))]
            rows = np.concatenate([rows[whole], np.array([n for n, _ in extra], np.int64)])
            cells = np.concatenate([cells[whole], np.array([c for _, c in extra], np.float64).reshape(-1, CELLS)])
        keys = (cells.astype(np.int64).view(np.uint64) * mix).sum(axis=1, dtype=np.uint64).view(np.int64)
        got = b.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*got.columns, pa.array(keys)], [*b.schema.names, "cell"])


def _equal(batches: Iterator[pa.RecordBatch], threshold: float | None) -> Iterator[pa.RecordBatch]:
    """(q, c, similarity) of rows (q, c, a, b) whose vectors a and b have a similarity of 1 - EQUAL or more, computed as _hits() does."""
    for b in batches:
        if b.num_rows:
            s = np.einsum("ij,ij->i", _unit(_rows(b.column(2))), _unit(_rows(b.column(3))))
            ok = pa.array((s >= 1 - EQUAL) & (True if threshold is None else s.astype(np.float32) >= np.float32(threshold)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s).filter(ok)], ["q", "c", "similarity"])


def _settled(queries: DataFrame, corpus: DataFrame, threshold: float | None, k: int, same: bool | None, apart: Column | None) -> tuple[DataFrame, DataFrame]:
    """(the queries that are left, (q, c, similarity) of the others): the best k of each query that has k partners of a similarity of 1 - EQUAL or more. All such partners of a query are seen, so
    nothing else can be among its best. Of equal vectors (of one g) the first k by c stand for all, and one more where apart may take one away. Queries in cells that stay crowded are left."""
    g = [] if same is None else ["g"]

    def celled(df: DataFrame, around: bool) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(lambda x: _celled(x, around), f"{schema}, cell long")

    copies = W.partitionBy("cell", "v", *g).orderBy("c")
    there = celled(corpus, True).withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + (apart is not None)).drop("r")
    there = written(there, "cells")
    crowded = there.groupBy("cell").count().where(F.col("count") > CROWDED).select("cell")
    there = there.join(crowded, "cell", "left_anti").withColumnsRenamed({"v": "b", "g": "theirs"})
    met = celled(queries, False).withColumnRenamed("v", "a").join(there, "cell")
    if same is not None:
        met = met.where((F.col("g") == NONE) | ((F.col("g") == F.col("theirs")) == F.lit(same)))
    if apart is not None:
        met = met.where(apart)
    q_type, c_type = queries.schema["q"].dataType.simpleString(), corpus.schema["c"].dataType.simpleString()
    found = met.select("q", "c", "a", "b").mapInArrow(lambda x: _equal(x, threshold), f"q {q_type}, c {c_type}, similarity double")
    best = W.partitionBy("q").orderBy(F.desc("similarity"), "c")
    found = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), "settled")
    done = found.where(F.col("r") == k).select("q")
    return queries.join(done, "q", "left_anti"), (found if k == 1 else found.join(done, "q", "left_semi")).drop("r")


def block_join(queries: DataFrame, corpus: DataFrame, threshold: float | None = None, k: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES, same: bool | None = None, apart: Column | None = None) -> DataFrame:
    """(q, c, similarity) for queries (q, v) against corpus (c, v): cosine at least threshold, of each q the best k (ties by c). Null vectors are left out.

    Keys may be of any orderable type; each q and c is taken to be unique. same: both sides have a number g, and before the k are chosen only those of equal (True) or different (False) g
    count; a null g of a query takes all, a null g of the corpus differs from any. apart: a condition on q and c that all but one c of each q meet at least (it is not the unit itself, say); pairs
    that don't are left out before the k are chosen."""
    extra = [] if same is None else [F.coalesce(F.col("g").cast("long"), F.lit(NONE)).alias("g")]
    queries, corpus = queries.where("v is not null").select("q", "v", *extra), corpus.where("v is not null").select("c", "v", *extra)
    q_type, c_type = queries.schema["q"].dataType, corpus.schema["c"].dataType
    schema = f"q {q_type.simpleString()}, c {c_type.simpleString()}, similarity double"
    n, size = _size(corpus)
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    most = k if k is None or apart is None else k + 1
    if size <= broadcast_bytes:
        got = corpus.toArrow()
        held = queries.sparkSession.sparkContext.broadcast((got["c"].combine_chunks(), _unit(_rows(got["v"])), None if same is None else got["g"].to_numpy()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            other, b, theirs = held.value
            for batch in batches:
                for i in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(i, _ROWS)
                    yield from _hits(part.column(0), _unit(_rows(part.column(1))), other, b, threshold, most, same=_groups(part, theirs, same))

        found = _spread(queries).mapInArrow(near, schema)
    else:
        queries = written(queries, "queries")  # read up to four times below
        _one_length(queries, corpus)
        settled = None
        if k is not None and 0 < k <= CROWDED:
            left, settled = _settled(queries, corpus, threshold, k, same, apart)
            queries = written(left, "left")
        nq, q_size = _size(queries)
        if settled is not None and not nq:
            return settled
        nq, nc = max(1, math.ceil(q_size / block_bytes)), math.ceil(size / block_bytes)
        left = queries.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(nq))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)).cast("array<bigint>")))
        right = corpus.withColumn("j", F.pmod(F.xxhash64("c"), F.lit(nc))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            return _met(a, b, ("q", "c"), threshold, most, same)

        found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)
        if settled is not None:
            found = found.unionByName(settled)
    if apart is not None:
        found = found.where(apart)
    if k is None:
        return found
    best = W.partitionBy("q").orderBy(F.desc("similarity"), "c")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _one_length(*sides: DataFrame) -> None:
    """An error if lengths differ."""
    lengths = reduce(DataFrame.unionByName, (x.select(F.size("v").alias("n")) for x in sides)).agg(F.min("n"), F.max("n")).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of different dimensions: {sorted(lengths)}")


def _rows(v) -> list | np.ndarray:
    """A list column as a matrix, or as lists where lengths differ or values are missing."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat, n = v.flatten(), len(v)
    lengths = np.diff(v.offsets.to_numpy())
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n and not flat.null_count and not v.null_count and (lengths == lengths[0]).all() else v.to_pylist()


def _groups(queries: pa.RecordBatch | pa.Table, theirs: np.ndarray | None, same: bool | None) -> tuple[np.ndarray, np.ndarray, bool] | None:
    if same is None or theirs is None:
        return None
    mine = pa.table(queries)["g"].to_numpy() if isinstance(queries, pa.Table) else queries.column(2).to_numpy()
    codes = {g: i for i, g in enumerate(np.unique(np.concatenate([mine, theirs])).tolist())}
    number = lambda x, none: np.array([none if g == NONE else codes[g] for g in x.tolist()], np.int64)
    return number(mine, -1), number(theirs, -2), same


def _met(a: pa.Table, b: pa.Table, ids: tuple[str, str], threshold: float | None, k: int | None, same: bool | None = None) -> pa.Table:
    """_hits() of two blocks that meet."""
    x, y = a[ids[0]].combine_chunks(), b[ids[1]].combine_chunks()
    empty = pa.schema([("q", x.type), ("c", y.type), ("similarity", pa.float64())])
    if not len(x) or not len(y):
        return empty.empty_table()
    return pa.Table.from_batches(list(_hits(x, _unit(_rows(a["v"])), y, _unit(_rows(b["v"])), threshold, k, same=None if same is None else _groups(a, b["g"].to_numpy(), same))), empty)


def _spread(df: DataFrame) -> DataFrame:
    """Vectors are little data for much arithmetic: as many partitions as there are cores to use."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def pivoted(vectors: DataFrame, key: str, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key, v, block) with each vector's nearest pivot, the pivots and each block's radius as an angle. The pivots are the vectors with the smallest key hashes (a fixed number)."""
    chosen = [r["v"] for r in vectors.where("v is not null").orderBy(F.xxhash64(key), key).limit(pivots).select("v").collect()]
    p = _unit(chosen)

    @F.pandas_udf("block int, angle double")
    def place(v: pd.Series) -> pd.DataFrame:
        s = _unit(v.tolist()) @ p.T
        return pd.DataFrame({"block": s.argmax(axis=1), "angle": np.arccos(np.clip(s.max(axis=1), -1, 1))})

    placed = written(vectors.where("v is not null").withColumn("at", place("v")).select(key, "v", "at.block", "at.angle"), "pivoted")
    radius = np.zeros(len(p))
    for b, a in placed.groupBy("block").agg(F.max("angle")).collect():
        radius[b] = a
    return placed.drop("angle"), p, radius


def self_join(vectors: DataFrame, threshold: float, broadcast_bytes: int = BROADCAST_BYTES, pivots: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of (id, v) with cosine at least threshold; exact.

    Beyond broadcast_bytes, only block pairs meet that the pivots' triangle inequality leaves open. There are about a quarter of the square root of the vectors, PIVOTS at least and
    MOST_PIVOTS at most."""
    n, size = _size(vectors.where("v is not null"))
    if size <= broadcast_bytes:
        got = block_join(vectors.select(F.col("id").alias("q"), "v"), vectors.select(F.col("id").alias("c"), "v"), threshold)
        return got.where("q < c").select(F.col("q").alias("a"), F.col("c").alias("b"), "similarity")
    placed, p, radius = pivoted(vectors, "id", pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n) // 4)))
    angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-9
    between = np.arccos(np.clip(p @ p.T, -1, 1))
    zero = threshold <= 0  # zero vectors have similarity 0 to everything
    open_pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p)) if zero or between[i, j] <= radius[i] + radius[j] + angle]
    spark = vectors.sparkSession
    meets = F.broadcast(spark.createDataFrame(open_pairs, "i int, j int"))  # at most pivots squared over two
    parts = max(1, math.ceil(size / len(p) / BLOCK_BYTES))
    sub = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    placed = placed.withColumn("sub", sub)
    left = placed.join(meets, placed["block"] == meets["i"]).select("i", "j", F.col("sub").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("y"), "id", "v")
    right = placed.join(meets, placed["block"] == meets["j"]).select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("x"), F.col("sub").alias("y"), "id", "v").toDF("i", "j", "x", "y", "id", "v")
    kind = vectors.schema["id"].dataType.simpleString()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        got = _met(a, b, ("id", "id"), threshold, None)
        inside = bool(a.num_rows and b.num_rows and a["i"][0].as_py() == a["j"][0].as_py())
        return got.append_column("inside", pa.array([inside] * got.num_rows, pa.bool_()))

    keys = ["i", "j", "x", "y"]
    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"q {kind}, c {kind}, similarity double, inside boolean")
    # within a block every pair comes in both orders
    return got.where(F.when(F.col("inside"), F.col("q") < F.col("c")).otherwise(F.col("q") != F.col("c"))).select(F.least("q", "c").alias("a"), F.greatest("q", "c").alias("b"), "similarity")


def catalyst_self_join(vectors: DataFrame, threshold: float) -> DataFrame:
    """self_join() as a plain join with a similarity expression: for small tables and for checking the others."""
    x = vectors.where("v is not null").withColumn("n", norm("v"))
    a, b = x.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), x.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    s = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)).otherwise(dot("va", "vb") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)))
    return a.join(b, F.col("a") < F.col("b")).withColumn("similarity", s).where(at_least("similarity", threshold)).select("a", "b", "similarity")


def approximate_self_join(vectors: DataFrame, threshold: float, bucket: float = 0.5, tables: int = 6, seed: int = 42) -> DataFrame:
    """self_join() by random projections: may miss pairs. Opt-in; prunes only where similar vectors are far closer than others."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = vectors.where("v is not null").withColumn("n", norm("v")).where("n > 0").select("id", array_to_vector(F.transform(F.col("v").cast("array<double>"), lambda x: x / F.col("n"))).alias("u"))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    pairs = model.approxSimilarityJoin(unit, unit, math.sqrt(2 * (1 - threshold)) + 1e-9, distCol="d")
    got = pairs.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), (1 - F.col("d") * F.col("d") / 2).alias("similarity"))
    return got.where("a < b").where(at_least("similarity", threshold))


def knn(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, prefilter: Callable[[DataFrame], DataFrame] | None = None, postfilter: Column | None = None) -> DataFrame:
    """One lookup for all of single searches, filtered searches, batch scans and hooks: the k nearest of the corpus for each query.

    prefilter narrows the corpus before the k are chosen; postfilter drops rows of (q, c, similarity) after."""
    got = block_join(queries, prefilter(corpus) if prefilter else corpus, threshold, k)
    return got.where(postfilter) if postfilter is not None else got


def scan_pairs(units: DataFrame, threshold: float, k: int = 100, selected: DataFrame | None = None, cross_only: bool = False, approximate: bool = False) -> DataFrame:
    """(unit_a, unit_b, similarity) as a scan finds them: for each selected unit the k nearest of ALL units, itself included, then the threshold, then no unit with itself,
    then (cross_only) no two units of one project, if both are selected; in canonical order, once each.

    units: (qualified_name, project_id, embedding); selected: as many of them as are asked for, all by default. approximate: pairs by random projections, of which some may be missing and
    which aren't cut to k; for stores too large for the exact way."""
    asked = units if selected is None else selected
    if approximate:
        found = approximate_self_join(units.select(F.col("qualified_name").alias("id"), F.col("embedding").alias("v")), threshold)
        names = asked.select(F.col("qualified_name").alias("q"), F.col("project_id").alias("pq"))
        both = found.select(F.col("a").alias("q"), F.col("b").alias("c"), "similarity").unionByName(found.select(F.col("b").alias("q"), F.col("a").alias("c"), "similarity")).join(names, "q")
        if cross_only:
            both = both.join(names.select(F.col("q").alias("c"), F.col("pq").alias("pc")), "c", "left").where(F.col("pc").isNull() | (F.col("pc") != F.col("pq")))
        a, b = pair_key("q", "c")
        return both.select(a.alias("unit_a"), b.alias("unit_b"), "similarity").groupBy("unit_a", "unit_b").agg(F.max("similarity").alias("similarity"))
    got = block_join(asked.select(F.col("qualified_name").alias("q"), F.col("embedding").alias("v")), units.select(F.col("qualified_name").alias("c"), F.col("embedding").alias("v")), threshold, k).where("q <> c")
    if cross_only:
        p = asked.select("qualified_name", "project_id")
        got = got.join(p.select(F.col("qualified_name").alias("q"), F.col("project_id").alias("pq")), "q").join(p.select(F.col("qualified_name").alias("c"), F.col("project_id").alias("pc")), "c", "left")
        got = got.where(F.col("pc").isNull() | (F.col("pc") != F.col("pq")))
    a, b = pair_key("q", "c")
    return got.select(a.alias("unit_a"), b.alias("unit_b"), "similarity").groupBy("unit_a", "unit_b").agg(F.max("similarity").alias("similarity"))


def compare(a: DataFrame, b: DataFrame, threshold: float = 0.8, k: int = 50) -> DataFrame:
    """scan_pairs() between two sets of units: queries from a, candidates from b."""
    got = block_join(a.select(F.col("qualified_name").alias("q"), F.col("embedding").alias("v")), b.select(F.col("qualified_name").alias("c"), F.col("embedding").alias("v")), threshold, k)
    x, y = pair_key("q", "c")
    return got.select(x.alias("unit_a"), y.alias("unit_b"), "similarity").groupBy("unit_a", "unit_b").agg(F.max("similarity").alias("similarity"))


def ranked(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Highest similarity first, ties by names."""
    got = pairs.orderBy(F.desc("similarity"), "unit_a", "unit_b")
    return got if limit is None else got.limit(limit)
