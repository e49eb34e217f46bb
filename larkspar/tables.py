"""Tables in the cluster's shared folder, and gapless row numbers without a single-task sort."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        folder = tempfile.mkdtemp(prefix="larkspar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/larkspar/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder below spark.checkpoint.dir; where that is unset and all runs in one process (a local master), a temporary folder is made and set."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables this application wrote to the shared folder. For when its results have been written elsewhere: results that are still lazy read them."""
    delete(spark, _base(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table and read back: computed once, lineage cut, size known to the planner."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is read from fewer splits than there are cores (a small file); else as it is. For work that takes far longer than moving the rows."""
    n, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():  # counting its partitions would run it
        return df
    return df.repartition(n) if plan.toRdd().getNumPartitions() < n else df


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_number", start: int = 1) -> DataFrame:
    """Adds gapless numbers in the given order. Rows are range-partitioned and sorted once and written with their places; a row a partition is collected, for where its numbers begin."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumn("__part", F.shiftright("__at", 33).cast("int"))
    offsets, total = [], start
    for part, n in sorted(placed.groupBy("__part").count().collect()):
        offsets.append((part, total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __base long"))
    within = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    return placed.join(base, "__part").withColumn(name, F.col("__base") + within).drop("__part", "__base", "__at")
