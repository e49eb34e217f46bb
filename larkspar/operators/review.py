"""Review of similar pairs: the joined list, counts by status, project statistics, ignoring a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.functions.scalars import at_least, pair_key, pair_status
from larkspar.operators.catalog import set_pair_status


def joined_pairs(pairs: DataFrame, units: DataFrame, threshold: float | None = None, project_id: int | None = None, status: str | None = None) -> DataFrame:
    """Pairs with file and first line of both units; pairs with a missing unit vanish. The project is that of unit_a."""
    wanted = pairs if threshold is None else pairs.where(at_least("similarity", threshold))
    if status is not None:
        wanted = wanted.where(F.col("status") == status)
    a = units.select(F.col("qualified_name").alias("unit_a"), F.col("project_id").alias("project_a"), F.col("file_path").alias("file_a"), F.col("range_start").alias("start_a"))
    b = units.select(F.col("qualified_name").alias("unit_b"), F.col("file_path").alias("file_b"), F.col("range_start").alias("start_b"))
    if project_id is not None:
        a = a.where(F.col("project_a") == project_id)
    got = wanted.join(a, "unit_a").join(b, "unit_b")
    return got.select("id", "unit_a", "unit_b", "similarity", pair_status("status").alias("status"), "trigger_reason", "file_a", "start_a", "file_b", "start_b")


def across_projects(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs whose units are not in the same project; a unit that isn't among units is in none."""
    p = units.select("qualified_name", "project_id")
    got = pairs.join(p.select(F.col("qualified_name").alias("unit_a"), F.col("project_id").alias("_pa")), "unit_a", "left").join(p.select(F.col("qualified_name").alias("unit_b"), F.col("project_id").alias("_pb")), "unit_b", "left")
    return got.where(~F.col("_pa").eqNullSafe(F.col("_pb"))).select(*pairs.columns)


def pairs_by_status(pairs: DataFrame, units: DataFrame, project_id: int | None = None) -> DataFrame:
    """(project_id, status, n), by the project of unit_a."""
    u = units.select(F.col("qualified_name").alias("unit_a"), "project_id")
    if project_id is not None:
        u = u.where(F.col("project_id") == project_id)
    return pairs.join(u, "unit_a").groupBy("project_id", "status").agg(F.count("*").alias("n"))


def project_stats(projects: DataFrame, units: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """A row a project: total_units, pairs_by_status (a map without the statuses that don't occur), total_groups."""
    n_units = units.groupBy("project_id").agg(F.count("*").alias("total_units"))
    by_status = pairs_by_status(pairs, units).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("pairs_by_status"))
    n_groups = groups.groupBy("project_id").agg(F.count("*").alias("total_groups"))
    got = projects.select(F.col("id").alias("project_id")).join(n_units, "project_id", "left").join(by_status, "project_id", "left").join(n_groups, "project_id", "left")
    zero = F.lit(0).cast("long")
    empty = F.create_map().cast("map<string,bigint>")
    return got.select("project_id", F.coalesce("total_units", zero).alias("total_units"), F.coalesce("pairs_by_status", empty).alias("pairs_by_status"), F.coalesce("total_groups", zero).alias("total_groups"))


def find_pair(pairs: DataFrame, units: DataFrame, a: str, b: str) -> DataFrame:
    """The joined pair of two units, in either order."""
    x, y = min(a, b, key=str.encode), max(a, b, key=str.encode)
    return joined_pairs(pairs, units).where((F.col("unit_a") == x) & (F.col("unit_b") == y))


def ignore_pair(pairs: DataFrame, units: DataFrame, a: str, b: str) -> tuple[DataFrame, bool]:
    """pairs with that one ignored, and whether there was one."""
    ids = [r["id"] for r in find_pair(pairs, units, a, b).select("id").collect()]
    return (set_pair_status(pairs, ids, "ignored"), True) if ids else (pairs, False)


def without_ignored(matches: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of matches whose two names are no ignored pair, in either order."""
    x, y = pair_key(a, b)
    ignored = pairs.where("status = 'ignored'").select(F.least("unit_a", "unit_b").alias("_x"), F.greatest("unit_a", "unit_b").alias("_y"))
    return matches.withColumn("_x", x).withColumn("_y", y).join(ignored, ["_x", "_y"], "left_anti").select(*matches.columns)
