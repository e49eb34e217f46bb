"""Lookup of edited functions among the indexed ones, for one event, a table of events or a stream."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.scalars import basename, is_code_file, percent_whole, short_name
from larkspar.operators.embed import Embedder, embed_bodies
from larkspar.operators.extract import extract_functions
from larkspar.operators.review import without_ignored
from larkspar.operators.similarity import block_join
from larkspar.tables import written

SCOPES, NOTIFY = ("all", "project", "cross"), ("block", "user")
#: Ignored partners of a query up to which the join makes room for them.
MANY_IGNORED = 64
#: Tasks that share the functions of one working folder.
DEALT = 64


@dataclass(frozen=True)
class HookConfig:
    threshold: float = 0.85
    min_lines: int = 5
    scope: str = "all"
    max_results: int = 3
    notify: str = "block"
    model: str = "bge-m3"
    scope_first: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None, prefix: str = "LARKSPAR_") -> HookConfig:
        """Defaults, overridden by the environment (but scope_first, which callers set). Numbers that don't parse keep the default; an unknown scope is all, an unknown way to notify is block."""
        env = dict(os.environ) if env is None else env
        c = HookConfig()
        for name, kind in (("threshold", float), ("min_lines", int), ("max_results", int)):
            try:
                c = replace(c, **{name: kind(env[prefix + name.upper()])})
            except (KeyError, ValueError):
                pass
        if prefix + "SCOPE" in env:
            c = replace(c, scope=env[prefix + "SCOPE"] if env[prefix + "SCOPE"] in ("project", "cross") else "all")
        if prefix + "NOTIFY" in env:
            c = replace(c, notify="user" if env[prefix + "NOTIFY"] == "user" else "block")
        return replace(c, model=env.get(prefix + "MODEL", c.model))


def in_scope(scope: str, candidate: Column | str, current: Column | str) -> Column:
    """Whether a unit's project is in scope; an unknown current project takes all."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (candidate, current))
    if scope == "project":
        return b.isNull() | a.eqNullSafe(b)
    if scope == "cross":
        return b.isNull() | ~a.eqNullSafe(b)
    return F.lit(True)


def similar_units(queries: DataFrame, units: DataFrame, pairs: DataFrame | None, config: HookConfig, scope_first: bool = True) -> DataFrame:
    """MATCH rows (and query columns event, project_id) for queries (event, qualified_name, file_path, line, project_id, embedding); equal queries are one.

    Never a unit with itself, never an ignored pair. scope_first: scope is applied before each query's best max_results are chosen. Otherwise the nearest
    max(3 * max_results, 50) that are neither are taken first, and the threshold, scope and max_results apply to those (for scope all, that is the same).

    The join itself keeps each query's best only: as many as are wanted, and as many as it has ignored partners (up to MANY_IGNORED; queries with more are joined by threshold alone)."""
    scope_first = scope_first or config.scope not in ("project", "cross")
    wanted = config.max_results if scope_first else max(3 * config.max_results, 50)
    apart = F.col("q.qualified_name") != F.col("c.qualified_name")
    same = {"project": True, "cross": False}.get(config.scope) if scope_first else None
    q = queries.where("embedding is not null").select(F.struct("event", "qualified_name", "file_path", "line", "project_id").alias("q"), F.col("embedding").alias("v"), F.col("project_id").alias("g")).dropDuplicates(["q"])
    corpus = units.select(F.struct("qualified_name", "project_id", "file_path", "range_start").alias("c"), F.col("embedding").alias("v"), F.col("project_id").alias("g"))
    if pairs is None:
        near = block_join(q, corpus, config.threshold, wanted, same=same, apart=apart)
    else:
        ignored = pairs.where("status = 'ignored'").select(F.explode(F.array("unit_a", "unit_b")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        q = q.join(ignored, q["q.qualified_name"] == ignored["name"], "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("name")
        q = written(q, "hook_queries")  # asked three times below
        most = q.where(F.col("n") <= MANY_IGNORED).agg(F.max("n")).first()[0] or 0
        near = block_join(q.where(F.col("n") <= MANY_IGNORED), corpus, config.threshold, wanted + most, same=same, apart=apart)
        if q.where(F.col("n") > MANY_IGNORED).limit(1).count():
            near = near.unionByName(block_join(q.where(F.col("n") > MANY_IGNORED), corpus, config.threshold, same=same, apart=apart))
    got = near.select("q", "similarity", "q.event", "q.project_id", F.col("q.qualified_name").alias("current_name"), F.col("q.file_path").alias("current_file"), F.col("q.line").alias("current_line"), F.col("c.qualified_name").alias("similar_name"), F.col("c.project_id").alias("similar_project"), F.col("c.file_path").alias("similar_file"), F.col("c.range_start").alias("similar_line"))
    if pairs is not None:
        got = without_ignored(got, pairs, "current_name", "similar_name")
    got = got.withColumn("is_cross_project", F.coalesce(F.col("similar_project") != F.col("project_id"), F.lit(True)))
    best = W.partitionBy("q").orderBy(F.desc("similarity"), "similar_name")
    if not scope_first:
        got = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= wanted).drop("r")
    got = got.where(in_scope(config.scope, "similar_project", "project_id"))
    got = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= config.max_results)
    return got.select("event", "project_id", "current_name", "current_file", "current_line", "similar_name", "similar_file", "similar_line", F.col("similarity").cast("float").alias("similarity"), "is_cross_project")


#: The wording of the report.
HEAD, CROSS = "⚠️ 检测到相似代码:", " [跨项目]"
CURRENT, SIMILAR = "  ├─ 当前: ", "  └─ 相似: "


def _tail(command: str) -> str:
    return "\n".join(["📋 处理方式:", "  1. 复用: import 或调用已有实现，避免重复", f'  2. 忽略: 运行 {command} ignore "<当前>" "<相似>" 标记为合理重复', "  3. 继续: 如果逻辑不同只是结构相似，直接继续编写"])


def report(matches: DataFrame, command: str = "larkspar") -> DataFrame:
    """(event, message): the matches of each event as one text, best first."""

    def at(side: str) -> Column:
        return F.concat(basename(f"{side}_file"), F.lit(":"), F.col(f"{side}_line").cast("string"), F.lit(" "), short_name(f"{side}_name"), F.lit("()"))

    block = F.concat(F.lit("  ("), percent_whole("similarity").cast("string"), F.lit("%)"), F.when(F.col("is_cross_project"), CROSS).otherwise(""), F.lit(f"\n{CURRENT}"), at("current"), F.lit(f"\n{SIMILAR}"), at("similar"), F.lit("\n"))
    order = F.struct("current_line", "current_name", (-F.col("similarity")).alias("s"), "similar_name", block.alias("text"))
    got = matches.groupBy("event").agg(F.array_sort(F.collect_list(order)).alias("rows"))  # at most max_results for each function of an event
    return got.select("event", F.concat_ws("\n", F.lit(HEAD), F.concat_ws("\n", F.transform("rows", lambda r: r["text"])), F.lit(_tail(command))).alias("message"))


def results(events: DataFrame, messages: DataFrame, notify: str = "block") -> DataFrame:
    """(event, result): each event's answer as JSON; {} without a message."""
    answer = F.struct(F.lit("block").alias("decision"), F.col("message").alias("reason")) if notify == "block" else F.struct(F.col("message").alias("systemMessage"))
    got = events.select("event").join(messages, "event", "left")
    return got.select("event", F.when(F.col("message").isNull(), F.lit("{}")).otherwise(F.to_json(answer)).alias("result"))


def edited_units(events: DataFrame, config: HookConfig, embedder: Embedder) -> DataFrame:
    """The functions in the code that PostToolUse events write, embedded; of other events, and files that are no code, nothing."""
    ids = ["event", *(c for c in ("project_id", "cwd") if c in events.columns)]
    code = events.where(F.col("hook_event_name") == "PostToolUse").select(*ids, F.col("tool_input.file_path").alias("file_path"), F.col("tool_input.content").alias("content"))
    code = code.where(F.col("content").isNotNull() & is_code_file("file_path"))
    found = extract_functions(code, config.min_lines, ids).withColumn("line", F.col("range_start"))
    return embed_bodies(found, embedder)


def hook_lookup(events: DataFrame, units: DataFrame, pairs: DataFrame | None, projects: DataFrame | None, config: HookConfig, embedder: Embedder) -> DataFrame:
    """(event, result) for events (event, and the fields of HOOK_EVENT). An event's project is the one whose root path is its cwd. Whether
    scope comes before or after the nearest are chosen is config.scope_first."""
    found = edited_units(events, config, embedder)
    if "project_id" not in found.columns:
        found = _placed(found, projects)
    return results(events, report(similar_units(found, units, pairs, config, config.scope_first)), config.notify)


def _placed(found: DataFrame, projects: DataFrame | None) -> DataFrame:
    """found with project_id by cwd. Most events may come from one folder, so its rows are dealt out over DEALT tasks, each with a copy of the projects."""
    if projects is None:
        return found.withColumn("project_id", F.lit(None).cast("long"))
    every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<bigint>"))
    roots = projects.select(F.col("root_path").alias("cwd"), F.col("id").alias("project_id"), every.alias("deal"))
    return found.withColumn("deal", F.pmod(F.xxhash64("event", "qualified_name"), F.lit(DEALT))).join(roots, ["cwd", "deal"], "left").drop("deal")


def needs_index(events: DataFrame, projects: DataFrame) -> DataFrame:
    """events with needs_index: whether their cwd is no known project yet."""
    known = projects.select(F.col("root_path").alias("cwd"), F.lit(True).alias("_known"))
    return events.join(known, "cwd", "left").withColumn("needs_index", F.col("cwd").isNotNull() & F.col("_known").isNull()).drop("_known")
