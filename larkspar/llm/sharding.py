"""Sharding by sampled splitters (op4): shards of near-equal bytes, as ranges of the order of (hash of the text, doc_id).

1. Sample. Rows enter the sample with a chance in proportion to their size (decided by a hash, so reruns agree); the sample's size is a parameter times the number
   of ranges, which follows the total size up to MAX_RANGES, so what is collected is bounded. Quantiles of the sampled keys are the splitters. A key that is a
   splitter twice over (a large group of copies) gets a range of its own.
2. Subdivide. Ranges above twice the mean size are cut into pieces by a hash of doc_id, so a group with a third of all rows is spread over tasks.
3. Large units. Groups of equal texts of more than LARGE of a shard's share are placed first, the largest to the emptiest shard. Groups of several rows above WHOLE
   of a share are no units: they are subdivided like any other rows, or, where each of their texts is above LARGE, document by document. There are at most shards / LARGE units.
4. Place. The rest fills the shards up to a common level in key order: exact sizes of the pieces (at most a few times MAX_RANGES) give each piece's offset, within
   a piece a running sum continues it, and a row goes to the shard that the middle of its group (above WHOLE: of itself) falls into. So equal texts stay together unless their
   group is above WHOLE, and shards differ by about LARGE of a share at most, unless a single text is larger than a share. Slots are ranks within the shard, from counts by shard and piece.

Law: bytes. Size is the text's UTF-8 bytes plus 1. Null text counts as empty; null doc_id sorts first. Repeated rows get a slot each. Fewer rows than shards leave
shards empty. An empty table gives an empty result. Other columns pass unchanged through shard(); columns named shard or slot are replaced.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.llm.common import keep, table, without
from larkspar.llm.parts import Parts, attach

SHARDS, BYTES_A_RANGE, MIN_RANGES, MAX_RANGES, SAMPLES_A_RANGE, LARGE, WHOLE = 16, 4 << 20, 128, 65_536, 16, 0.01, 0.05


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("__size", F.octet_length(text).cast("long") + 1).withColumn("__h", F.xxhash64(text))


def splitters(rows: DataFrame, total: int) -> np.ndarray:
    """Range boundaries over __h from a size-weighted sample."""
    ranges = min(MAX_RANGES, max(MIN_RANGES, total // BYTES_A_RANGE))
    chance = F.col("__size") * F.lit(ranges * SAMPLES_A_RANGE / max(1, total))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("__h", "doc_id", F.lit(4)), 12) / F.lit(float(1 << 52)) < chance)
    keys = np.sort(np.array([r[0] for r in drawn.select("__h").collect()], np.int64))
    if not len(keys):
        return keys
    cuts, times = np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges], return_counts=True)
    hot = cuts[times > 1]
    return np.unique(np.concatenate([cuts, hot[hot < np.iinfo(np.int64).max] + 1]))


def _located(df: DataFrame, cuts: np.ndarray, first: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """df with __range, the number of cuts up to __h, and __piece, the range's first piece plus a hash of doc_id modulo its pieces.

    Hashes are spread evenly, so their leading bits lead to a few cuts each: a broadcast table of twice as many rows as there are cuts, at most."""
    bits = max(1, math.ceil(math.log2(len(cuts) + 1)))
    lead = cuts >> np.int64(64 - bits)
    rows = []
    for k in range(-(1 << (bits - 1)), 1 << (bits - 1)):
        i, j = (int(x) for x in np.searchsorted(lead, [k, k + 1]))
        rows.append((k, i, cuts[i:j].tolist(), first[i : j + 1].tolist(), pieces[i : j + 1].tolist()))
    near = F.broadcast(df.sparkSession.createDataFrame(rows, "__lead long, __i int, __cuts array<bigint>, __first array<int>, __pieces array<int>"))
    got = df.withColumn("__lead", F.shiftright("__h", 64 - bits)).join(near, "__lead").withColumn("__k", F.size(F.filter("__cuts", lambda c: c <= F.col("__h"))))
    salt = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1)
    piece = F.get("__first", F.col("__k")) + F.pmod(salt, F.get("__pieces", F.col("__k"))).cast("int")
    return got.withColumn("__range", F.col("__i") + F.col("__k")).withColumn("__piece", piece).drop("__lead", "__i", "__cuts", "__first", "__pieces", "__k")


def placed_first(thin: DataFrame, total: int, shards: int) -> tuple[list[tuple[int, int]], list[tuple[int, int | None, int]], list[int]]:
    """(__h, shard) of the large groups, (__h, doc_id, shard) of large texts in groups that are too large, and the bytes each shard has from them."""
    groups = thin.groupBy("__h").agg(F.sum("__size").alias("s"), F.count("*").alias("n"))
    share = total / shards
    units = groups.where((F.col("s") > LARGE * share) & ((F.col("n") == 1) | (F.col("s") <= WHOLE * share))).select("s", "__h")
    found: list[tuple[int, int, tuple]] = [(r["s"], r["__h"], ()) for r in units.collect()]
    split = groups.where((F.col("s") > WHOLE * share) & (F.col("n") > 1) & (F.col("s") > LARGE * share * F.col("n"))).select("__h")
    split = F.broadcast(split)  # under shards / WHOLE rows
    documents = thin.join(split, "__h", "left_semi").groupBy("__h", F.col("doc_id").cast("long").alias("d")).agg(F.sum("__size").alias("s"))
    found += [(r["s"], r["__h"], (r["d"],)) for r in documents.collect()]  # of both, under shards / LARGE rows
    heap: list[tuple[int, int]] = [(0, k) for k in range(shards)]
    whole, single, held = [], [], [0] * shards
    for size, h, d in sorted(found, key=lambda u: (-u[0], u[1], repr(u[2]))):
        now, k = heapq.heappop(heap)
        heapq.heappush(heap, (now + size, k))
        held[k] = now + size
        if d:
            single.append((h, d[0], k))
        else:
            whole.append((h, k))
    return whole, single, held


def levels(held: list[int], rest: int) -> list[int]:
    """Where each shard's part of the rest ends (running sums), when the rest fills the shards up to a common level."""
    order = sorted(held)
    level, left = 0.0, float(rest)
    for k, h in enumerate(order):
        upper = order[k + 1] if k + 1 < len(order) else math.inf
        if (upper - h) * (k + 1) >= left:
            level = h + left / (k + 1)
            break
        left -= (upper - h) * (k + 1)
    return [int(x) for x in np.cumsum([max(0.0, level - h) for h in held])]


def shard(thin: DataFrame, shards: int = SHARDS) -> DataFrame:
    """thin (from keyed(): doc_id, __size, __h and others, no texts) with shard and slot."""
    spark = thin.sparkSession
    total = thin.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    cuts = splitters(thin, total)
    ones = np.ones(len(cuts) + 1, np.int64)
    by_range = dict(_located(thin, cuts, ones, ones).groupBy("__range").agg(F.sum("__size")).collect())  # at most 2 * MAX_RANGES rows
    sizes = np.array([by_range.get(r, 0) for r in range(len(cuts) + 1)], np.int64)
    pieces = np.maximum(1, np.ceil(sizes / max(1.0, 2 * total / len(sizes)))).astype(np.int64)
    first, alone = np.cumsum(pieces) - pieces, np.repeat(pieces > 1, pieces).tolist()
    whole, single, held = placed_first(thin, total, shards)
    large = F.broadcast(spark.createDataFrame(whole, "__l long, __one int"))
    texts = F.broadcast(spark.createDataFrame(single, "__m long, __d long, __two int"))

    def placed(df: DataFrame) -> DataFrame:
        got = _located(df, cuts, first, pieces).drop("__range").join(large, F.col("__h") == F.col("__l"), "left")
        got = got.join(texts, (F.col("__h") == F.col("__m")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left").withColumn("__fixed", F.coalesce("__one", "__two")).drop("__l", "__m", "__d", "__one", "__two")
        return got.withColumn("__fill", F.when(F.col("__fixed").isNull(), F.col("__size")).otherwise(0))

    exact = sorted(placed(thin).groupBy("__piece").agg(F.sum("__fill")).collect())  # at most a few times MAX_RANGES rows
    starts = np.cumsum([0, *(s for _, s in exact)]).tolist()
    offsets = F.broadcast(spark.createDataFrame([(p, at, alone[p]) for (p, _), at in zip(exact, starts, strict=False)], "__piece int, __at long, __alone boolean"))
    order = W.partitionBy("__piece").orderBy("__h", "doc_id", "__size")
    group = W.partitionBy("__piece", "__h")
    x = placed(thin).withColumn("__end", F.sum("__fill").over(order.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("__group", F.sum("__fill").over(group)).withColumn("__group_end", F.max("__end").over(group)).join(offsets, "__piece")
    row_wise = F.col("__alone") | (F.col("__group") > WHOLE * total / shards)
    twice_mid = F.when(row_wise, 2 * F.col("__end") - F.col("__fill")).otherwise(2 * F.col("__group_end") - F.col("__group")) + 2 * F.col("__at")
    ends = levels(held, starts[-1])
    filled = F.size(F.filter(F.array(*(F.lit(2 * e).cast("long") for e in ends[:-1])), lambda e: e <= twice_mid)) if shards > 1 else F.lit(0)
    x = x.withColumn("shard", F.coalesce("__fixed", filled))
    x = x.withColumn("__n", F.row_number().over(W.partitionBy("__piece", "shard").orderBy("__h", "doc_id", "__size")))
    x = keep(x.select(*thin.columns, "__piece", "shard", "__n"), "shards")
    counts, at, now = [], 0, None
    for s, p, n in sorted(x.groupBy("shard", "__piece").count().collect()):  # pieces, and a row more for each large unit and boundary at most
        at, now = (0, s) if s != now else (at, now)
        counts.append((s, p, at))
        at += n
    before = F.broadcast(spark.createDataFrame(counts, "shard int, __piece int, __before long"))
    return x.join(before, ["shard", "__piece"]).withColumn("slot", F.col("__before") + F.col("__n") - 1).select(*thin.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot. Rows are placed by id and size alone and stay where they are (see larkspar.llm.parts): texts aren't shuffled. A sink that wants files by shard has
    partitionBy("shard")."""
    parts = Parts(without(docs, "shard", "slot"))
    thin = keep(keyed(parts.df).select(parts.column.alias("part"), parts.row.alias("row"), "doc_id", "__size", "__h"), "sizes")
    return attach(parts, shard(thin, shards).select("part", "row", "shard", "slot"), "places")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    got = shard(keep(docs.select("doc_id", "__size", "__h", crc), "sizes"))
    return got.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
