"""Language-server dumps: symbol trees and calls as JSON lines, and the functions in them.

A collector beside the engine talks to the servers and writes the dumps; the engine reads them, so analysis is repeatable and distributed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.functions.scalars import lines
from larkspar.schemas import CALLS, SYMBOLS
from larkspar.tables import written


@dataclass(frozen=True)
class Rules:
    """Which symbol kinds are functions (and what they are called), which name their members, and the prefix of names."""

    prefix: str
    kinds: dict[str, str]
    parents: tuple[str, ...]
    cut_signature: bool = False
    skip_broken: bool = False


#: Extraction rules of each language.
RULES = {
    "rust": Rules("rust", {"FUNCTION": "function", "METHOD": "method"}, ("CLASS", "STRUCT", "ENUM", "MODULE")),
    "swift": Rules("swift", {"FUNCTION": "function", "METHOD": "method", "CONSTRUCTOR": "init"}, ("CLASS", "STRUCT", "ENUM"), True, True),
    "typescript": Rules("ts", {"FUNCTION": "function", "METHOD": "method", "CONSTRUCTOR": "constructor"}, ("CLASS", "INTERFACE", "OBJECT")),
    "vue": Rules("vue", {"FUNCTION": "function", "METHOD": "method", "CONSTRUCTOR": "constructor"}, ("CLASS", "INTERFACE", "OBJECT", "MODULE")),
    "java": Rules("java", {"METHOD": "method", "CONSTRUCTOR": "constructor"}, ("CLASS", "INTERFACE", "ENUM")),
}


class LanguageAdapter(Protocol):
    """What a collector offers for one project."""

    def start(self) -> None: ...
    def get_functions(self) -> DataFrame: ...
    def get_source_files(self) -> list[str]: ...
    def get_call_hierarchy(self) -> DataFrame: ...
    def stop(self) -> None: ...


def read_symbols(spark: SparkSession, path: str, language: str) -> DataFrame:
    """A symbol dump; broken rows are skipped or are an error, as the language's collector has it."""
    return spark.read.schema(SYMBOLS).option("mode", "DROPMALFORMED" if RULES[language].skip_broken else "FAILFAST").json(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALLS).option("mode", "FAILFAST").json(path)


def _nearest_parents(symbols: DataFrame, parents: tuple[str, ...]) -> DataFrame:
    """symbols with owner: the name of the nearest ancestor that names its members. One join a level of nesting, until no symbol is left open."""
    up = symbols.select("file_path", F.col("symbol_id").alias("at"), F.col("name").alias("up_name"), F.col("kind").alias("up_kind"), F.col("parent_id").alias("up"))
    known = symbols.withColumn("at", F.col("parent_id")).withColumn("owner", F.lit(None).cast("string"))
    done = None
    for _ in range(200):
        known = written(known.join(up, ["file_path", "at"], "left").withColumn("owner", F.when(F.col("up_kind").isin(*parents), F.col("up_name"))).withColumn("at", F.when(F.col("owner").isNull(), F.col("up"))).drop("up_name", "up_kind", "up"), "owners")
        finished = known.where("at is null").drop("at")
        done = finished if done is None else done.unionByName(finished)
        known = known.where("at is not null")
        if not known.limit(1).count():
            return done
    raise ValueError("symbols nest deeper than 200 levels, or in a circle")


def slice_lines(text: Column | str, first: Column | str, last: Column | str) -> Column:
    """Lines first to last (from 0, both included) joined; empty if the range leaves the text."""
    all_lines = lines(text)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (first, last))
    return F.when((b < F.size(all_lines)) & (a <= b + 1), F.array_join(F.slice(all_lines, a + 1, b - a + 1), "\n")).otherwise("")


def functions(symbols: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """RAW_UNIT rows (0-based lines, both included) and ord of the functions in a symbol dump; files: (file_path, content)."""
    r = RULES[language]
    own = _nearest_parents(symbols, r.parents).where(F.col("kind").isin(*r.kinds))
    full = F.concat(F.lit(f"{r.prefix}:"), "file_path", F.lit("::"), F.coalesce(F.concat("owner", F.lit("::")), F.lit("")), "name")
    if r.cut_signature:
        full = F.when(F.col("name") != "", F.replace(full, F.col("name"), F.element_at(F.split("name", r"\("), 1))).otherwise(full)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in r.kinds.items() for x in kv)), F.col("kind"))
    got = own.join(files, "file_path")
    return got.select(full.alias("qualified_name"), "file_path", kind.alias("kind"), F.col("start_line").alias("range_start"), F.col("end_line").alias("range_end"), slice_lines("content", "start_line", "end_line").alias("body"), "selection_line", "selection_column", "ord")


def at_least_lines(units: DataFrame, n: int) -> DataFrame:
    """Units whose last line is n or more below the first (so n + 1 physical lines)."""
    return units.where(F.col("range_end") - F.col("range_start") >= n)


@dataclass
class DumpAdapter:
    """A LanguageAdapter over dumps."""

    spark: SparkSession
    symbols: str
    calls: str
    files: DataFrame
    language: str

    def start(self) -> None:
        pass

    def get_functions(self) -> DataFrame:
        return functions(read_symbols(self.spark, self.symbols, self.language), self.files, self.language)

    def get_source_files(self) -> list[str]:
        return [r[0] for r in self.files.select("file_path").collect()]

    def get_call_hierarchy(self) -> DataFrame:
        return read_calls(self.spark, self.calls)

    def stop(self) -> None:
        pass
