import random

import pytest
from pyspark.sql import functions as F

from larkspar.llm import parts


def test_buckets_are_spark_partitions(spark):
    r = random.Random(1)
    xs = [0, 1, 7, (1 << 63) - 1, *(r.getrandbits(63) for _ in range(500))]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", F.hash("x").alias("h")).collect()
    assert all(parts.spark_hash(x) == h for x, h in got)


@pytest.mark.parametrize("least", [40_000, 32 << 20])
def test_attach_finds_its_rows(spark, odd, tmp_path, monkeypatch, least):
    """Rows of equal content are told apart; other splits in the second scan."""
    monkeypatch.setattr(parts, "LEAST_PART", least)
    extra = odd.withColumn("part", F.lit("mine")).withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("s", F.struct(F.lit(1).alias("x"), F.array(F.lit(2.5)).alias("y")))
    many = extra.unionByName(extra).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), (F.col("id") % 90).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("mine").alias("part"), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.struct(F.lit(1).alias("x"), F.array(F.lit(2.5)).alias("y")).alias("s")))
    path = f"file://{tmp_path}/d.parquet"
    many.repartition(3).write.option("parquet.block.size", 64 << 10).parquet(path)
    docs = spark.read.parquet(path).withColumn("more", F.lit("x"))
    p = parts.Parts(docs)
    ids = p.df.select(p.column.alias("part"), p.row.alias("row"), "doc_id")
    chosen = ids.where("doc_id % 3 = 0 or doc_id is null").withColumn("shard", F.col("doc_id") * 2).drop("doc_id")
    name, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(name, "100k")
        got = parts.attach(p, chosen, "test")
    finally:
        spark.conf.set(name, old)
    assert got.columns == [*docs.columns, "shard"]
    want = docs.where("doc_id % 3 = 0 or doc_id is null").withColumn("shard", F.col("doc_id") * 2)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert parts.attach(p, chosen.limit(0), "none").count() == 0
    assert parts.attach(parts.Parts(odd), chosen.limit(0).select("part", "row"), "none").columns == odd.columns
