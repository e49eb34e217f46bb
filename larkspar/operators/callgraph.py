"""Call graphs: nodes (file_path, line, name) and edges (src_file, src_line, dst_file, dst_line, ord).

An edge says that src calls dst; ord is its place among the calls of src. Ends need not be nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.functions.scalars import is_entry_point, module_of, short_name
from larkspar.tables import written

KEY = ["file_path", "line"]
#: Rounds after which a traversal writes its state instead of growing its plan.
CUT_EVERY = 4


def build_nodes(units: DataFrame, order: str = "ord") -> DataFrame:
    """A node for each place a unit is selected at; of several, the last in order."""
    rows = units.select("file_path", F.col("selection_line").alias("line"), short_name("qualified_name").alias("name"), F.col(order).alias("_o"))
    return rows.groupBy(*KEY).agg(F.max_by("name", "_o").alias("name"))


def callers(edges: DataFrame) -> DataFrame:
    """Edges turned round: (src, dst) become callee and caller."""
    return edges.select(F.col("dst_file").alias("src_file"), F.col("dst_line").alias("src_line"), F.col("src_file").alias("dst_file"), F.col("src_line").alias("dst_line"), "ord")


def _is_src(nodes: DataFrame, edges: DataFrame):
    return (nodes["file_path"] == edges["src_file"]) & (nodes["line"] == edges["src_line"])


def _is_dst(nodes: DataFrame, edges: DataFrame):
    return (nodes["file_path"] == edges["dst_file"]) & (nodes["line"] == edges["dst_line"])


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing calls and that are no entry points. Callers outside the node set count."""
    return nodes.join(edges, _is_dst(nodes, edges), "left_anti").where(~is_entry_point("name"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with n_callers, n_callees and degree; several calls between two nodes count as several."""
    out = edges.groupBy(F.col("src_file").alias("file_path"), F.col("src_line").alias("line")).agg(F.count("*").alias("n_callees"))
    into = edges.groupBy(F.col("dst_file").alias("file_path"), F.col("dst_line").alias("line")).agg(F.count("*").alias("n_callers"))
    got = nodes.join(out, KEY, "left").join(into, KEY, "left").na.fill(0, ["n_callers", "n_callees"])
    return got.withColumn("degree", F.col("n_callers") + F.col("n_callees"))


def busiest(nodes: DataFrame, edges: DataFrame, n: int = 100) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), *KEY).limit(n)


def edges_within(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the chosen nodes; several stay several."""
    keys = chosen.select(*KEY)
    return edges.join(keys, _is_src(keys, edges), "left_semi").join(keys, _is_dst(keys, edges), "left_semi")


def modules(nodes: DataFrame, workspace: str = "") -> DataFrame:
    return nodes.select(module_of("file_path", workspace).alias("module")).distinct()


def module_edges(nodes: DataFrame, edges: DataFrame, workspace: str = "") -> DataFrame:
    """(from_module, to_module, n) of calls between nodes of different modules."""
    at = nodes.select(*KEY, module_of("file_path", workspace).alias("m"))
    a = at.select(F.col("file_path").alias("src_file"), F.col("line").alias("src_line"), F.col("m").alias("from_module"))
    b = at.select(F.col("file_path").alias("dst_file"), F.col("line").alias("dst_line"), F.col("m").alias("to_module"))
    calls = edges.groupBy("src_file", "src_line", "dst_file", "dst_line").agg(F.count("*").alias("k"))
    got = calls.join(a, ["src_file", "src_line"]).join(b, ["dst_file", "dst_line"]).where("from_module <> to_module")
    return got.groupBy("from_module", "to_module").agg(F.sum("k").alias("n"))


def find_function(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that name (of several, the least by file and line), else one whose name ends with it after a pair of colons."""
    found = nodes.where((F.col("name") == name) | F.col("name").endswith(f"::{name}"))
    return found.orderBy((F.col("name") != name), *KEY).limit(1)


def tree_bfs(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 5, incoming: bool = False) -> DataFrame:
    """(root_file, root_line, file_path, line, name, depth): the nodes within depth calls of each root, with their least distance.

    One join and one anti-join against what has been visited, a round; nodes that aren't in the node set end a path."""
    e = callers(edges) if incoming else edges
    e = e.select("src_file", "src_line", F.col("dst_file").alias("file_path"), F.col("dst_line").alias("line")).distinct()
    e = e.join(nodes.select(*KEY), KEY, "left_semi")
    top = roots.select(F.col("file_path").alias("root_file"), F.col("line").alias("root_line"), *KEY).distinct().withColumn("depth", F.lit(0)).join(nodes.select(*KEY), KEY, "left_semi")
    seen = front = top
    for d in range(1, depth + 1):
        step = front.select("root_file", "root_line", F.col("file_path").alias("src_file"), F.col("line").alias("src_line")).join(e, ["src_file", "src_line"])
        step = step.select("root_file", "root_line", *KEY).distinct().join(seen, ["root_file", "root_line", *KEY], "left_anti")
        front = step.withColumn("depth", F.lit(d))
        if d % CUT_EVERY == 0:
            front = written(front, "front")
        seen = seen.unionByName(front)
        if d % CUT_EVERY == 0:
            seen = written(seen, "seen")
    return seen.join(nodes, KEY).select("root_file", "root_line", "file_path", "line", "name", "depth")


def _walk(pdf: pd.DataFrame, depth: int) -> list[tuple]:
    """Depth-first order from the group's root, with one visited set for the whole walk: a node that was met first along a long way is not met again along a short one."""
    children: dict[tuple, list[tuple]] = {}
    names: dict[tuple, str] = {}
    for r in pdf.sort_values(["ord", "dst_file", "dst_line"], kind="stable").itertuples(index=False):
        at = (r.file_path, r.line)
        names[at] = r.name
        if r.dst_file is not None and r.dst_file == r.dst_file:
            children.setdefault(at, []).append((r.dst_file, int(r.dst_line)))
    root = (pdf["root_file"].iloc[0], int(pdf["root_line"].iloc[0]))
    seen, out, stack = set(), [], [(root, 0)]
    while stack:
        at, d = stack.pop()
        if d > depth or at in seen:
            continue
        seen.add(at)
        if at not in names:
            continue
        out.append((*root, len(out), *at, names[at], d))
        stack += [(c, d + 1) for c in reversed(children.get(at, []))]
    return out


def tree_dfs(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 5, incoming: bool = False) -> DataFrame:
    """(root_file, root_line, ord, file_path, line, name, depth): each root's call tree in preorder, as a depth-first walk with a depth bound and one visited set makes it.

    The walk of a root is sequential, but sees only what is within depth calls of it, which tree_bfs() finds with joins; roots are walked in parallel. Of parallel edges only the first
    matters, and edges of the last level don't: what meets in a root's task is a row for each pair of nodes within depth of it that call each other, some 200 bytes each. A root that
    reaches a few million such pairs needs a task of a GB; tree_bfs() has no such bound."""
    near = tree_bfs(nodes, edges, roots, depth, incoming)
    e = callers(edges) if incoming else edges
    e = e.groupBy(F.col("src_file").alias("file_path"), F.col("src_line").alias("line"), "dst_file", "dst_line").agg(F.min("ord").alias("ord"))
    rows = near.where(F.col("depth") < depth).join(e, KEY, "left").unionByName(near.where(F.col("depth") >= depth), allowMissingColumns=True).select("root_file", "root_line", *KEY, "name", "dst_file", "dst_line", F.coalesce("ord", F.lit(0)).alias("ord"))
    names = ["root_file", "root_line", "ord", "file_path", "line", "name", "depth"]

    def walk(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.DataFrame(_walk(groups, depth), columns=names)  # type: ignore[arg-type]

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"root_file string, root_line {kinds['line']}, ord int, file_path string, line {kinds['line']}, name string, depth int"
    return rows.groupBy("root_file", "root_line").applyInPandas(walk, schema)
