"""Parts of a table that every pass over it knows alike, and what is sent back to them.

A part is a range of rows of one file, by their index in the file, among rows of about one size; a row of a part's size is a part of its own. So a row's part follows from
the data and numbers fixed before the first pass, never from how Spark splits the files: each pass may run with other splits, tasks and executors. A task may hold a piece of
a part or pieces of several. Tables without a row index (anything but a Parquet scan) are first written to the shared folder.

What an exchange sends back to parts is written to one of at most MOST_BUCKETS folders, sorted by part in small row groups, and read by the parts' own tasks from the shared
folder (any file system pyarrow knows). A part without a row there is an error: the files changed between two passes.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from larkspar.llm.common import Kept, identified, map_texts

#: Bytes of text in a part, at least and at most; folders for what comes back to the parts, at most; bytes of a row group in them.
LEAST_PART, MOST_PART, MOST_BUCKETS, ROW_GROUP = 32 << 20, 512 << 20, 4096, 2 << 20
#: Rows of up to so many times the mean size count as of one size (a part may have so many times the bytes it is meant to have, where all its rows are long).
WIDE = 32


class Parts:
    """df: the table; column: a row's part (long, not negative); row: its index in its file; total: bytes of the text column; bytes: those of a part."""

    def __init__(self, df: DataFrame, text: str = "text"):
        self.df, _ = identified(df)
        df = self.df
        size = F.octet_length(text)
        self.total, n = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
        self.bytes = min(MOST_PART, max(LEAST_PART, self.total // 8192))
        self.buckets = min(MOST_BUCKETS, max(1, math.ceil(self.total / self.bytes)))
        mean = max(1.0, self.total / max(1, n))
        # rows of one size class (up to WIDE times the mean, WIDE times that, ...) share a part, the larger the fewer
        wide = F.coalesce(F.when(size > mean * WIDE, F.ceil(F.log2(size / F.lit(mean)) / math.log2(WIDE)) - 1), F.lit(0))
        rows = F.greatest(F.lit(1.0), F.lit(self.bytes / mean) / F.pow(F.lit(float(WIDE)), wide))
        self.row = F.col("_metadata.row_index").cast("long")
        self.column = F.shiftrightunsigned(F.xxhash64("_metadata.file_path", wide, F.floor(self.row / rows)), 1)

    @property
    def rows(self) -> DataFrame:
        """df with part and row as __part and __row."""
        return self.df.select(self.column.alias("__part"), self.row.alias("__row"), *self.df.columns)

    def sent_back(self, df: DataFrame, name: str, order: tuple[str, ...] = ()) -> Kept:
        """Writes rows with a column part so that Side finds them."""
        rows = df.withColumn("bucket", F.pmod(F.hash("part"), F.lit(self.buckets))).repartition(self.buckets, "part").sortWithinPartitions("bucket", "part", *order)
        return Kept(rows, name, by="bucket", **{"parquet.block.size": ROW_GROUP})


def spark_hash(x: int) -> int:
    """Spark's hash() of a long, by which repartition() deals rows out: so a bucket is one partition."""
    h = 42
    for k in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Side:
    """What was sent back, for the tasks of a pass. make turns a part's rows into what is looked up; the last few are kept, as a task's rows come from few parts at a time."""

    def __init__(self, path: str, buckets: int, make: Callable[[pa.Table], object], most: int = 2):
        self.path, self.buckets, self.make, self.most = path, buckets, make, most
        self.held: OrderedDict[int, object] = OrderedDict()

    def of(self, part: int):
        if part in self.held:
            self.held.move_to_end(part)
        else:
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[part] = self.make(self._rows(part))
        return self.held[part]

    def _rows(self, part: int) -> pa.Table:
        where, path = fs.FileSystem.from_uri(self.path)
        found = []
        for info in where.get_file_info(fs.FileSelector(f"{path}/bucket={spark_hash(part) % self.buckets}", allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                with where.open_input_file(info.path) as f:
                    file = pq.ParquetFile(f)
                    at = file.schema_arrow.get_field_index("part")
                    groups = []
                    for g in range(file.num_row_groups):
                        known = file.metadata.row_group(g).column(at).statistics
                        if known is None or not known.has_min_max or known.min <= part <= known.max:
                            groups.append(g)
                    if groups:
                        t = file.read_row_groups(groups, use_threads=False)
                        found.append(t.filter(pa.compute.equal(t["part"], part)))
        t = pa.concat_tables(found) if found else None
        if not t:
            raise RuntimeError(f"no exchange for part {part} in {self.path}: the input changed between two passes")
        return t


def _attach(batches: Iterator[pa.RecordBatch], side: Side, added: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        row = batch.column(1).to_numpy(zero_copy_only=False)
        for now in np.unique(part).tolist():
            rows, columns = side.of(now)
            at = np.flatnonzero(part == now)
            place = np.minimum(np.searchsorted(rows, row[at]), max(0, len(rows) - 1))
            hit = rows[place] == row[at] if len(rows) else np.zeros(len(at), bool)
            if hit.any():
                old = batch.take(pa.array(at[hit])) if hit.sum() < batch.num_rows else batch
                new = columns.take(pa.array(place[hit]))
                yield pa.RecordBatch.from_arrays([*old.columns[2:], *(new[c].combine_chunks() for c in added)], schema=schema)


def _by_row(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    t = t.filter(pa.compute.greater_equal(t["row"], 0)).sort_by("row")
    return t["row"].to_numpy(), t


def attach(parts: Parts, chosen: DataFrame, name: str, columns: list[str] | None = None, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """The rows of parts.df that chosen (part, row, ...) names, once each, with its other columns added. Rows are read where they are: none is shuffled, only chosen is.

    columns: those of parts.df that are wanted, all by default. then: what is made of these rows, of the given schema, by the same Python worker."""
    added = [c for c in chosen.columns if c not in ("part", "row")]
    there = parts.df.select(parts.column.alias("part")).distinct().select("part", F.lit(-1).cast("long").alias("row"), *(F.lit(None).cast(chosen.schema[c].dataType).alias(c) for c in added))
    back = parts.sent_back(chosen.select("part", "row", *added).unionByName(there), name, ("row",))
    side = Side(back.path, parts.buckets, _by_row)
    wanted = parts.df.columns if columns is None else columns
    fields = StructType([StructField(f.name, f.dataType) for f in [*(parts.df.schema[c] for c in wanted), *(chosen.schema[c] for c in added)]])
    arrow = to_arrow_schema(fields)
    rows = parts.rows if columns is None else parts.df.select(parts.column.alias("__part"), parts.row.alias("__row"), *columns)
    if then is None:
        return map_texts(rows, lambda x: _attach(x, side, added, arrow), fields)
    return map_texts(rows, lambda x: then(_attach(x, side, added, arrow)), schema)
