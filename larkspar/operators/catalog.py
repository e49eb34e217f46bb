"""The four tables as versioned folders, and their changes as DataFrame -> DataFrame functions.

A table is <root>/<name>/v=<n>; the newest version that has its commit marker counts. A change writes a whole new version (one job, so all or nothing) and never
touches the one that its plan reads. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.scalars import pair_key
from larkspar.schemas import PAIR_STATUSES, TABLES
from larkspar.tables import number_rows


class Catalog:
    """Tables below a root folder of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name, schema in TABLES.items():
            if self.version(name) is None:
                self._write(name, spark.createDataFrame([], schema), 0)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, tail: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}")

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(x[2:]) for x in found if x.startswith("v=") and fs.exists(self._path(f"{name}/{x}/_SUCCESS")))

    def version(self, name: str) -> int | None:
        return max(self.versions(name), default=None)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v={self.version(name)}")

    def _write(self, name: str, df: DataFrame, version: int) -> None:
        schema = TABLES[name]
        df.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")

    def replace(self, name: str, df: DataFrame) -> int:
        """Makes df the table's next version."""
        version = (self.version(name) or 0) + 1
        self._write(name, df, version)
        return version

    def vacuum(self, name: str, keep: int = 2) -> None:
        for v in self.versions(name)[:-keep]:
            self._fs().delete(self._path(f"{name}/v={v}"), True)


def _next_ids(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """Numbers new rows from the table's largest id on."""
    top = old.agg(F.max("id")).first()[0] or 0
    return number_rows(new, order, "id", top + 1)


def _last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys, the last by seq."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in others))


def add_projects(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """projects with those of wanted (name, root_path, language) whose root path is new; known ones stay as they are."""
    new = wanted.groupBy("root_path").agg(F.min(F.struct("name", "language")).alias("x")).select("root_path", "x.name", "x.language")
    new = _next_ids(new.join(projects, "root_path", "left_anti"), projects, ["root_path"])
    return projects.unionByName(new.withColumn("last_indexed_at", F.lit(None).cast("timestamp")))


def touch_project(projects: DataFrame, project_id: int, when: Column | None = None) -> DataFrame:
    """Sets the time of indexing (now, by default)."""
    return projects.withColumn("last_indexed_at", F.when(F.col("id") == project_id, when if when is not None else F.current_timestamp()).otherwise(F.col("last_indexed_at")))


def projects_by_name(projects: DataFrame) -> DataFrame:
    return projects.orderBy("name", "id")


def project_by_path(projects: DataFrame, root_path: str) -> DataFrame:
    return projects.where(F.col("root_path") == root_path)


def units_of_projects(units: DataFrame, ids: list[int] | None) -> DataFrame:
    """All units for None, none for an empty list."""
    return units if ids is None else units.where(F.col("project_id").isin(ids)) if ids else units.where("false")


def unit(units: DataFrame, name: str) -> DataFrame:
    return units.where(F.col("qualified_name") == name)


def units_of_file(units: DataFrame, path: str) -> DataFrame:
    return units.where(F.col("file_path") == path)


def delete_units_of_file(units: DataFrame, path: str) -> DataFrame:
    return units.where(~F.col("file_path").eqNullSafe(path))


def with_inherited_group(incoming: DataFrame, units: DataFrame) -> DataFrame:
    """group_id of incoming rows: that of another unit of equal structure (of those with a group, the first by name), else their own."""
    known = units.where("group_id is not null").select("structure_hash", F.col("qualified_name").alias("n"), F.col("group_id").alias("g"))
    # two names suffice: the first that is not the row's own
    first = known.groupBy("structure_hash").agg(F.min(F.struct("n", "g")).alias("x"))
    other = known.join(first, "structure_hash").where("n <> x.n").groupBy("structure_hash").agg(F.min(F.struct("n", "g")).alias("y"))
    got = incoming.join(first, "structure_hash", "left").join(other, "structure_hash", "left")
    inherited = F.when(F.col("x.n") != F.col("qualified_name"), F.col("x.g")).otherwise(F.col("y.g"))
    return got.withColumn("group_id", F.coalesce(inherited, "group_id")).select(*incoming.columns)


def upsert_units(units: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """Units by qualified_name: place, kind and hashes are overwritten; the project stays; a new embedding replaces the old one only if there is one; a group stays once set.

    Of incoming rows with one name the last by seq counts."""
    rows = _last(incoming, ["qualified_name"], seq).drop(seq) if seq else incoming
    rows = with_inherited_group(rows, units)
    o, n = units.alias("o"), rows.alias("n")
    there = F.col("n.qualified_name").isNotNull()

    def newer(c: str) -> Column:
        return F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, F.col("o.qualified_name") == F.col("n.qualified_name"), "full").select(
        F.coalesce("o.qualified_name", "n.qualified_name").alias("qualified_name"),
        F.when(F.col("o.qualified_name").isNotNull(), F.col("o.project_id")).otherwise(F.col("n.project_id")).alias("project_id"),
        *(newer(c) for c in ("file_path", "kind", "range_start", "range_end", "content_hash", "structure_hash")),
        F.coalesce("n.embedding", "o.embedding").alias("embedding"),
        F.coalesce("o.group_id", "n.group_id").alias("group_id"),
    )


def cached_embeddings(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows with the embedding of any unit of equal content (null: none is known)."""
    known = units.where("embedding is not null").groupBy("content_hash").agg(F.min_by("embedding", "qualified_name").alias("embedding"))
    return rows.drop("embedding").join(known, "content_hash", "left")


def upsert_pairs(pairs: DataFrame, incoming: DataFrame, reason: str | None, seq: str | None = None) -> DataFrame:
    """Pairs by their canonical names: similarity and reason are overwritten (the reason even by null), id and status stay; new pairs get status new."""
    a, b = pair_key("unit_a", "unit_b")
    rows = incoming.withColumn("_a", a).withColumn("_b", b).drop("unit_a", "unit_b").withColumnsRenamed({"_a": "unit_a", "_b": "unit_b"})
    keep = ["unit_a", "unit_b", "similarity"]
    rows = _last(rows.select(*keep, seq), keep[:2], seq).drop(seq) if seq else rows.select(*keep).groupBy("unit_a", "unit_b").agg(F.max("similarity").alias("similarity"))
    rows = rows.withColumn("similarity", F.col("similarity").cast("float"))
    why = F.lit(reason).cast("string")
    o, n = pairs.alias("o"), rows.alias("n")
    on = (F.col("o.unit_a") == F.col("n.unit_a")) & (F.col("o.unit_b") == F.col("n.unit_b"))
    hit = F.col("n.unit_a").isNotNull()
    old = o.join(n, on, "left").select("o.id", "o.unit_a", "o.unit_b", F.coalesce("n.similarity", "o.similarity").alias("similarity"), "o.status", F.when(hit, why).otherwise(F.col("o.trigger_reason")).alias("trigger_reason"))
    new = _next_ids(rows.join(pairs, ["unit_a", "unit_b"], "left_anti"), pairs, ["unit_a", "unit_b"])
    return old.unionByName(new.withColumn("status", F.lit("new")).withColumn("trigger_reason", why))


def set_pair_status(pairs: DataFrame, ids: list[int], status: str) -> DataFrame:
    if status not in PAIR_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return pairs.withColumn("status", F.when(F.col("id").isin(ids), F.lit(status)).otherwise(F.col("status")))


def delete_pairs_of(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.where((F.col("unit_a") != name) & (F.col("unit_b") != name))


def add_group(groups: DataFrame, project_id: int, name: str, reason: str | None = None, pattern: str | None = None) -> tuple[DataFrame, int]:
    """groups with one more, and its id."""
    new_id = (groups.agg(F.max("id")).first()[0] or 0) + 1
    row = groups.sparkSession.createDataFrame([(new_id, project_id, name, reason, pattern)], TABLES["similarity_groups"])
    return groups.unionByName(row), new_id


def assign_group(units: DataFrame, names: list[str], group_id: int) -> DataFrame:
    """Puts units into a group; each has one, so an earlier one is replaced."""
    return units.withColumn("group_id", F.when(F.col("qualified_name").isin(names), F.lit(group_id)).otherwise(F.col("group_id")))


def groups_of_project(groups: DataFrame, project_id: int) -> DataFrame:
    return groups.where(F.col("project_id") == project_id)


def members(units: DataFrame, group_id: int) -> DataFrame:
    return units.where(F.col("group_id") == group_id).orderBy("qualified_name")


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
