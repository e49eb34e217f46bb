"""The hook lookup as a stream: files of JSON events in, answers out, micro-batch by micro-batch against the tables as they are then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspar.operators.embed import Embedder
from larkspar.operators.hook import HookConfig, hook_lookup
from larkspar.schemas import HOOK_EVENT


def event_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """PostToolUse events of the JSON files that appear in a folder."""
    reader = spark.readStream.schema(HOOK_EVENT).option("mode", "FAILFAST")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder).where("hook_event_name = 'PostToolUse'")


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, tables: Callable[[], tuple[DataFrame, DataFrame | None, DataFrame | None]], config: HookConfig, embedder: Embedder, available_now: bool = True, version: Callable[[], object] | None = None) -> StreamingQuery:
    """Appends (batch, event, result) to a Parquet folder. tables gives units, pairs and projects at the start of each micro-batch; with version, only where what that gives has changed
    since the batch before (a store's versions, say), and they are cached in between. A batch that is run again replaces what it wrote."""
    held: dict[str, object] = {}

    def current() -> tuple:
        if version is None:
            return tables()
        now = version()
        if "tables" not in held or held["version"] != now:
            for old in held.get("tables", ()):
                if old is not None:
                    old.unpersist()
            held.update(version=now, tables=tuple(t if t is None else t.cache() for t in tables()))
        return held["tables"]

    def lookup(batch: DataFrame, batch_id: int) -> None:
        events = batch.withColumn("event", F.sha2(F.to_json(F.struct("*")), 256)).dropDuplicates(["event"])
        units, pairs, projects = current()
        hook_lookup(events, units, pairs, projects, config, embedder).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = event_stream(spark, folder).writeStream.foreachBatch(lookup).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
