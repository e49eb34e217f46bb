"""What the training-data operators share: texts from Arrow batches, words, and tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspar.tables import delete, spread
from larkspar.tables import shared_path as scratch_path

#: Bytes of an Arrow batch of texts.
BATCH = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of plain text: runs without ASCII whitespace.
SPACED = r"[^\x20\x09-\x0D]+"
#: Words without punctuation: ASCII letters and digits, and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Maps A-Z to a-z and every ASCII byte that is no letter or digit to a space, so that split() gives the ALNUM words.
ALNUM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Kept:
    """A table written to the shared folder: its lineage is cut, an executor's loss costs nothing, and its size is known to the planner."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None, **options: object):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        (df.write.partitionBy(by) if by else df.write).options(**options).parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only for tables that no later plan reads."""
        delete(self.spark, self.path)


def keep(df: DataFrame, name: str) -> DataFrame:
    return Kept(df, name).df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names in any case, which the operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together (one longer text alone), so that what is built for a range stays small."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over rows with texts: small files spread over all cores, and batches of at most about BATCH bytes (a setting of the session, which is only ever lowered), as each is held several
    times by the JVM and by Python."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, f"{BATCH}b")
    return spread(df).mapInArrow(f, schema)


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def alnum_words(c: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(c, F.lit(""))), F.lit(ALNUM), F.lit(0))


def identified(df: DataFrame) -> tuple[DataFrame, Column]:
    """df and its rows' identity: hash of the file and index in it. Rows that say the same are told apart. Tables without a row index (anything but a Parquet scan) are first written to the
    shared folder. The column is for use on the DataFrame that is returned, before any join."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        df = keep(df, "rows")
    return df, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row"))
