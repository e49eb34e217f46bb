"""Hook events from JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.schemas import HOOK_EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(event, and the event's fields) of JSON lines; a broken line is an error."""
    got = spark.read.schema(HOOK_EVENT).option("mode", "FAILFAST").json(path)
    return got.withColumn("event", F.sha2(F.to_json(F.struct("*")), 256))


def event_of(spark: SparkSession, document: str) -> DataFrame:
    """One event from one document; an empty document is an event without anything in it."""
    d = json.loads(document) if document else {}
    tool = d.get("tool_input")
    row = (d.get("hook_event_name"), d.get("tool_name"), (tool.get("file_path"), tool.get("content")) if tool else None, d.get("cwd"))
    return spark.createDataFrame([row], HOOK_EVENT).withColumn("event", F.lit("0"))
