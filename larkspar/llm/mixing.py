"""Mixing sources to target weights by capped water-filling (op7). DataFrame operations only.

Targets. All sources together get BUDGET times the words there are, shared by weight; a source stops at EPOCHS times its own words and what it leaves is shared
anew by weight until no source is above its cap. In closed form: sources that stop are those with the smallest cap for each unit of weight, so with the sources
sorted by that ratio, the level of the first source that the remaining budget doesn't fill is everyone's words for each unit of weight. That is two running sums
over the table of sources (a row a source, never documents).

Sampling. target / size = whole + fraction. Every document of a source is taken whole times, and once more if its seeded hash is at most the source's cutoff: the
hash at which the running size, in hash order, comes nearest to the fraction. The running size is found in two steps, sums for each hash bucket (combined before
the shuffle) and then the rows of the one bucket that holds the cutoff, so a source with a third of all rows never meets in one task. Given the cutoffs, taking
is a local comparison. Reruns agree: the hash depends on doc_id and seed only.

Null or empty text: size 0, taken 0 words. Null source: a source of its own, last in order. Null doc_id hashes as an empty id. Rows with equal doc_id and source
are taken alike. An empty table gives an empty result. Other columns pass unchanged through mix().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.llm.common import SPACED, keep, table

BUDGET, EPOCHS, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), 7
#: Sources up to which their table is broadcast (a few hundred bytes each); beyond, Spark's shuffled joins.
BROADCAST_SOURCES = 20_000
HASH_BITS = 60


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def unit_hash(seed: int = SEED) -> Column:
    """60 bits of the MD5 of doc_id and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, budget: float = BUDGET, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target.

    One row a source comes in, never documents, so the windows without a partition see a table of sources: some 50 bytes a row, sorted with spill, so that ten million sources take
    one task about a minute."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest, whole = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing), by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = x.withColumn("level", left / F.sum("weight").over(rest)).withColumn("fills", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("fills"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(W.partitionBy())
    return x.withColumn("target", F.least("cap", F.coalesce(first["level"] * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def cutoffs(rows: DataFrame, budget: float = BUDGET, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, size, u) of all documents: (source, source_size, weight, target, whole, cutoff)."""
    n = rows.count()
    shift = HASH_BITS - min(16, max(0, math.ceil(math.log2(max(1, n) / 64))))
    buckets = keep(rows.groupBy("source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    sources = keep(targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), budget, epochs, weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate)).withColumn("need", (rate - F.floor(rate)) * F.col("source_size"))
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    near = F.broadcast(sources) if small else sources
    order = W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    b = buckets.withColumnRenamed("source", "name").join(near, F.col("name").eqNullSafe(F.col("source"))).withColumn("sum", F.sum("size").over(order))
    edge = b.where(F.col("sum") >= F.col("need")).groupBy("source", "source_size", "weight", "target", "whole", "need").agg(F.min(F.struct("bucket", (F.col("sum") - F.col("size")).alias("before"))).alias("edge"))
    edge = keep(edge.select("source", "source_size", "weight", "target", "whole", "need", "edge.bucket", "edge.before"), "edges")
    key = edge.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "need")
    inside = rows.withColumn("bucket", F.shiftright("u", shift)).join(F.broadcast(key) if small else key, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.groupBy("s", "u", "before", "need").agg(F.sum("size").alias("size"))  # null or repeated ids share a hash: one row, combined before the shuffle
    running = F.sum("size").over(W.partitionBy("s").orderBy("u").rowsBetween(W.unboundedPreceding, 0))
    choices = inside.select("s", "u", (F.col("before") + running).alias("sum"), "need").unionByName(key.select("s", (F.shiftleft("b", shift) - 1).alias("u"), F.col("before").alias("sum"), "need"))
    best = choices.groupBy("s").agg(F.min(F.struct(F.abs(F.col("sum") - F.col("need")), F.col("u"))).alias("best"))
    best = best.select("s", F.col("best.u").alias("cutoff"))
    return keep(edge.join(F.broadcast(best) if small else best, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "weight", "target", "whole", "cutoff"), "cutoffs")


def _with_copies(docs: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """docs with __copies, __target and __source_size."""
    c = cuts.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("cutoff").alias("__cutoff"))
    if c.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        c = F.broadcast(c)
    return docs.join(c, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", F.col("__whole") + (unit_hash(seed) <= F.col("__cutoff")).cast("long"))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", "source", n_words("text").alias("size"), unit_hash(seed).alias("u"))


def mix(docs: DataFrame, seed: int = SEED, budget: float = BUDGET, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (not at all, once, up to EPOCHS times); columns stay."""
    cuts = cutoffs(keep(sizes(docs, seed), "sizes"), budget, epochs, weights)
    took = _with_copies(docs, cuts, seed).where("__copies > 0")
    return took.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(sizes(table(spark, sf_dir, "documents")), "sizes")
    got = _with_copies(rows, cutoffs(rows), SEED)
    return got.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


OP7_SQL = r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 15))::BIGINT AS u FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM rows GROUP BY source),
capped AS (SELECT *, [5, 2, 1][((k - 1) % 3 + 1)::BIGINT] AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
goal AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, k LIMIT 1))::DOUBLE AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal),
needs AS (SELECT *, floor(rate) AS whole, (rate - floor(rate)) * source_size AS need FROM rates),
running AS (SELECT r.source, u, abs(sum(size) OVER (PARTITION BY r.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - need) AS gap
    FROM rows r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source UNION ALL SELECT source, -1, need FROM needs),
cuts AS (SELECT source, min(u) AS cutoff FROM (SELECT *, min(gap) OVER (PARTITION BY source) AS least_gap FROM running) WHERE gap = least_gap GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN u <= cutoff THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
"""
