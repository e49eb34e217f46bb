"""Mermaid diagrams of call graphs: one row a line, (ord, line), and the text of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.functions.scalars import node_id, ref_id
from larkspar.operators.callgraph import busiest, edges_within, module_edges, modules
from larkspar.tables import number_rows

MAX_NODES = 100
#: What lines are put in order by.
_ORDER = (("a", "long"), ("b", "string"), ("c", "long"), ("d", "long"), ("e", "string"), ("f", "long"))


def _lines(*parts: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Numbers the lines of each part in its order (the fields of _ORDER, ascending), after a header. Lines are numbered by ranges, so a diagram may have any number of them."""
    spark = parts[0][0].sparkSession
    got = spark.createDataFrame([(0, "flowchart TD")], "part int, line string").withColumn("order", F.struct(*(F.lit(None).cast(t).alias(n) for n, t in _ORDER)))
    for k, (df, order) in enumerate(parts):
        columns = dict(zip((n for n, _ in _ORDER), order, strict=False))
        got = got.unionByName(df.select(F.lit(k + 1).alias("part"), "line", F.struct(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in _ORDER)).alias("order")))
    return number_rows(got, ["part", "order"], "ord", 0).select(F.col("ord").cast("int").alias("ord"), "line")


def call_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The nodes with most calls and the calls between them. Uncalled nodes, leaves and others differ in shape."""
    top = busiest(nodes, edges, max_nodes)
    at = ref_id("file_path", "line")
    shape = F.when(F.col("n_callers") == 0, F.concat(at, F.lit("[["), "name", F.lit("]]"))).when(F.col("n_callees") == 0, F.concat(at, F.lit("(["), "name", F.lit("])"))).otherwise(F.concat(at, F.lit("["), "name", F.lit("]")))
    boxes = top.withColumn("line_text", F.concat(F.lit("    "), shape)).select("degree", "file_path", F.col("line").alias("at"), F.col("line_text").alias("line"))
    order = top.select(F.col("file_path").alias("src_file"), F.col("line").alias("src_line"), "degree")
    calls = edges_within(edges, top).join(order, ["src_file", "src_line"])
    arrows = calls.withColumn("line", F.concat(F.lit("    "), ref_id("src_file", "src_line"), F.lit(" --> "), ref_id("dst_file", "dst_line")))
    return _lines((boxes, [-F.col("degree"), F.col("file_path"), F.col("at")]), (arrows, [-F.col("degree"), F.col("src_file"), F.col("src_line"), F.col("ord"), F.col("dst_file"), F.col("dst_line")]))


def module_diagram(nodes: DataFrame, edges: DataFrame, workspace: str = "") -> DataFrame:
    """Modules, and arrows with the number of calls between them."""
    boxes = modules(nodes, workspace).withColumn("line", F.concat(F.lit("    "), node_id("module"), F.lit("["), "module", F.lit("]")))
    arrows = module_edges(nodes, edges, workspace).withColumn("line", F.concat(F.lit("    "), node_id("from_module"), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), node_id("to_module")))
    return _lines((boxes, [F.lit(0), F.col("module")]), (arrows, [F.lit(0), F.col("from_module"), F.lit(0), F.lit(0), F.col("to_module")]))


def text(diagram: DataFrame, fenced: bool = False) -> str:
    body = "\n".join(r["line"] for r in diagram.orderBy("ord").collect())
    return f"```mermaid\n{body}\n```\n" if fenced else body
