"""Command line: python -m larkspar.cli <command>. Tables live below --root; functions come from a symbol dump (--symbols) or, for Rust and Swift, from the sources themselves."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.api import ArchitectureAnalyzer, MermaidGenerator, Store
from larkspar.functions import scalars as sc
from larkspar.operators import callgraph, catalog, hook, mermaid, similarity
from larkspar.operators.embed import Embedder, HashingEmbedder, HttpEmbedder, with_embeddings
from larkspar.operators.extract import extract_functions
from larkspar.sources import events, files, symbols

PAIRS_SHOWN, SCAN_SHOWN, COMPARE_SHOWN = 20, 20, 30


def _embedder(args: argparse.Namespace) -> Embedder:
    return HttpEmbedder(args.model, args.embed_url) if args.embed_url else HashingEmbedder()


def functions_of(spark: SparkSession, path: str, language: str, dump: str | None) -> DataFrame:
    """RAW_UNIT rows of a project, with 0-based lines, both included."""
    source = files.source_files(spark, path, language)
    if dump:
        return symbols.functions(symbols.read_symbols(spark, dump, language), source, language)
    found = extract_functions(source, 1)
    return found.withColumn("range_start", F.col("range_start") - 1).withColumn("range_end", F.col("range_end") - 1).withColumn("ord", F.col("range_start"))


def _similarity(pair) -> str:
    return f"{pair['similarity'] * 100:.2f}%"


def _show_pairs(rows: list, total: int, shown: int) -> None:
    for i, p in enumerate(rows[:shown]):
        print(f"\n[{i + 1}] {_similarity(p)}")
        for side in "ab":
            print(f"  {side.upper()}: {os.path.basename(p[f'file_{side}'])}:{p[f'start_{side}']} {p[f'unit_{side}'].split('::')[-1]}")
    if total > shown:
        print(f"\n... {total - shown} more")


def index(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    path = os.path.abspath(args.path)
    n = store.index(args.name or os.path.basename(path), path, args.lang, functions_of(spark, path, args.lang, args.symbols), _embedder(args), args.min_lines)
    print(f"Indexed {n} functions")


def scan(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    ids = None if args.project is None else [r["id"] for r in store.projects.where(F.col("name").isin(args.project)).collect()]
    got = store.scan(args.threshold, args.cross_only, ids, approximate=args.approximate)
    total = got.count()
    print(f"Found {total} similar pairs (threshold: {args.threshold * 100:.0f}%)")
    _show_pairs(got.limit(SCAN_SHOWN).collect(), total, SCAN_SHOWN)


def compare(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    sides = []
    for path, lang in ((args.path_a, args.lang_a), (args.path_b, args.lang_b)):
        u = functions_of(spark, os.path.abspath(path), lang, None).withColumn("content_hash", sc.content_hash("body"))
        sides.append(with_embeddings(u, store.units.limit(0), _embedder(args)))
    got = similarity.ranked(similarity.compare(*sides, threshold=args.threshold))
    total = got.count()
    print(f"Found {total} similar pairs (threshold: {args.threshold * 100:.0f}%)")
    named = got.limit(COMPARE_SHOWN).select("similarity", sc.format_name("unit_a").alias("a"), sc.format_name("unit_b").alias("b"))
    for i, r in enumerate(named.collect()):
        print(f"\n[{i + 1}] {_similarity(r)}\n  A: {r['a']}\n  B: {r['b']}")
    if total > COMPARE_SHOWN:
        print(f"\n... {total - COMPARE_SHOWN} more")


def status(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    names = {r["id"]: r["name"] for r in store.projects.collect()}
    for r in store.status().orderBy("project_id").collect():
        print(f"{names[r['project_id']]}: {r['total_units']} units, {r['total_groups']} groups, pairs {json.dumps(r['pairs_by_status'], sort_keys=True)}")


def projects(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    for r in catalog.projects_by_name(store.projects).collect():
        print(f"[{r['id']}] {r['name']} ({r['language']}) {r['root_path']} {r['last_indexed_at'] or 'never indexed'}")


def pairs(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    got = store.list_pairs(args.threshold, args.project_id, args.status, 1 << 30)
    for r in got.limit(args.limit).select("id", "similarity", "status", sc.format_name("unit_a").alias("a"), sc.format_name("unit_b").alias("b")).collect():
        print(f"[{r['id']}] {_similarity(r)} {r['status']}: {r['a']} <-> {r['b']}")
    if (total := got.count()) > args.limit:
        print(f"... {total - args.limit} more")


def ignore(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    print("Ignored" if store.ignore(args.unit_a, args.unit_b) else "No such pair")


def group_create(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    print(f"Group {store.create_group(args.project_id, args.name, args.reason, args.pattern)}")


def group_add(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    for name in store.add_to_group(args.group_id, args.units):
        print(f"Unknown unit: {name}", file=sys.stderr)


def group_list(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    for r in store.list_groups(args.project_id).collect():
        print(f"[{r['id']}] project {r['project_id']}: {r['name']}{' - ' + r['reason'] if r['reason'] else ''}")


def group_members(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    for r in store.group_members(args.group_id).select(sc.format_name("qualified_name").alias("n")).collect():
        print(r["n"])


def _graph(spark: SparkSession, args: argparse.Namespace) -> ArchitectureAnalyzer:
    units = functions_of(spark, os.path.abspath(args.path), args.lang, args.symbols)
    return ArchitectureAnalyzer.of(units, symbols.read_calls(spark, args.calls))


def diagram(spark: SparkSession, store: Store | None, args: argparse.Namespace) -> None:
    g = _graph(spark, args)
    rows = mermaid.module_diagram(g.nodes, g.edges, os.path.abspath(args.path)) if args.type == "module" else mermaid.call_graph(g.nodes, g.edges, MermaidGenerator().with_max_nodes(args.max_nodes).max_nodes)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(mermaid.text(rows, fenced=True))
    else:
        print(mermaid.text(rows))


def dead_code(spark: SparkSession, store: Store | None, args: argparse.Namespace) -> None:
    got = _graph(spark, args).find_dead_code().orderBy(*callgraph.KEY)
    if args.json:
        print(json.dumps([{"name": r["name"], "file": r["file_path"], "line": r["line"]} for r in got.collect()], indent=2, ensure_ascii=False))
        return
    rows = got.withColumn("rel", sc.relative_path("file_path", os.path.abspath(args.path))).collect()
    print(f"\nFound {len(rows)} potentially unreferenced functions:\n")
    for r in rows:
        print(f"  {r['rel']}:{r['line']}\n    {r['name']}\n")


def call_tree(spark: SparkSession, store: Store | None, args: argparse.Namespace) -> None:
    rows = _graph(spark, args).get_call_tree(args.function, args.direction == "incoming", args.depth).orderBy("ord").collect()
    if args.json:
        print(json.dumps([{"name": r["name"], "depth": r["depth"]} for r in rows], indent=2, ensure_ascii=False))
    else:
        for r in rows:
            print("  " * r["depth"] + r["name"])


def run_hook(spark: SparkSession, store: Store, args: argparse.Namespace) -> None:
    config = hook.HookConfig.from_env()
    event = events.event_of(spark, sys.stdin.read())
    got = hook.hook_lookup(event, store.units, store.pairs, store.projects, config, _embedder(args))
    print(got.first()["result"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspar", description="Code similarity and call graphs on Spark")
    p.add_argument("--root", default=os.path.join(os.path.expanduser("~"), ".larkspar"))
    p.add_argument("--embed-url", help="embedding server; without one, words are hashed")
    p.add_argument("--model", default="bge-m3")
    sub = p.add_subparsers(required=True)

    def command(name: str, run: Callable, parent=sub, graph: bool = False) -> argparse.ArgumentParser:
        c = parent.add_parser(name)
        c.set_defaults(run=run, graph=graph)
        if graph:
            c.add_argument("path")
            c.add_argument("--lang", default="rust", choices=sorted(files.WALKS))
            c.add_argument("--symbols")
            c.add_argument("--calls", required=True, help="call dump (JSON lines)")
        return c

    c = command("index", index)
    c.add_argument("path")
    c.add_argument("--lang", default="rust", choices=sorted(files.WALKS))
    c.add_argument("--name")
    c.add_argument("--symbols", help="symbol dump (JSON lines)")
    c.add_argument("--min-lines", type=int, default=3)
    c = command("scan", scan)
    c.add_argument("--threshold", type=float, default=0.85)
    c.add_argument("--cross-only", action="store_true")
    c.add_argument("--project", action="append")
    c.add_argument("--approximate", action="store_true", help="random projections: faster on very large stores, may miss pairs")
    c = command("compare", compare)
    for side in "ab":
        c.add_argument(f"path_{side}")
    for side in "ab":
        c.add_argument(f"--lang-{side}", default="typescript", choices=sorted(files.WALKS))
    c.add_argument("--threshold", type=float, default=0.8)
    command("status", status)
    command("projects", projects)
    c = command("pairs", pairs)
    c.add_argument("--project-id", type=int)
    c.add_argument("--status")
    c.add_argument("--threshold", type=float)
    c.add_argument("--limit", type=int, default=PAIRS_SHOWN)
    c = command("ignore", ignore)
    c.add_argument("unit_a")
    c.add_argument("unit_b")
    c.add_argument("--reason", help="accepted and not kept")
    group = sub.add_parser("group").add_subparsers(required=True)
    c = command("create", group_create, group)
    c.add_argument("project_id", type=int)
    c.add_argument("name")
    c.add_argument("--reason")
    c.add_argument("--pattern")
    c = command("add", group_add, group)
    c.add_argument("group_id", type=int)
    c.add_argument("units", nargs="+")
    command("list", group_list, group).add_argument("--project-id", type=int)
    command("members", group_members, group).add_argument("group_id", type=int)
    c = command("diagram", diagram, graph=True)
    c.add_argument("--type", default="call", choices=("call", "module"))
    c.add_argument("--max-nodes", type=int, default=mermaid.MAX_NODES)
    c.add_argument("--output")
    command("dead-code", dead_code, graph=True).add_argument("--json", action="store_true")
    c = command("call-tree", call_tree, graph=True)
    c.add_argument("function")
    c.add_argument("--direction", default="outgoing", choices=("outgoing", "incoming"))
    c.add_argument("--depth", type=int, default=5)
    c.add_argument("--json", action="store_true")
    command("hook", run_hook)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("larkspar").getOrCreate()
    args.run(spark, None if args.graph else Store(spark, args.root), args)


if __name__ == "__main__":
    main()
