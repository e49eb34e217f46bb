"""The domain's tables, derived from the driver's: every row of them, no subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions.scalars import content_hash, structure_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code units, with vectors where there are any."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.regexp_replace("source", "^src", "").cast("long").alias("project_id"), "source")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    path = F.concat(F.lit("/ws/"), "source", F.lit("/m"), (F.col("doc_id") % 5).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = F.concat("lang", F.lit(":"), path, F.lit("::T"), (F.col("doc_id") % 10).cast("string"), F.lit("::unit_"), F.col("doc_id").cast("string"))
    got = d.join(e, "doc_id", "left")
    kind = F.when(F.col("doc_id") % 3 == 0, "method").otherwise("function")
    return got.select(name.alias("qualified_name"), "project_id", path.alias("file_path"), kind.alias("kind"), (F.col("doc_id") % 7).cast("int").alias("range_start"), (F.col("doc_id") % 7 + F.col("doc_id") % 11).cast("int").alias("range_end"), F.col("text").alias("body"), "embedding", "doc_id")


def hashed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units() as stored: hashes instead of bodies; every 17th name has a group."""
    u = units(spark, sf_dir)
    group = F.when(F.col("doc_id") % 17 == 0, F.col("doc_id") % 5).cast("long")
    return u.select("qualified_name", "project_id", "file_path", "kind", "range_start", "range_end", content_hash("body").alias("content_hash"), structure_hash("body").alias("structure_hash"), "embedding", group.alias("group_id"))


UNITS_SQL = r"""u AS (SELECT concat(d.lang, ':/ws/', d.source, '/m', d.doc_id % 5, '/doc_', d.doc_id, '.txt::T', d.doc_id % 10, '::unit_', d.doc_id) AS qualified_name,
    regexp_replace(d.source, '^src', '')::BIGINT AS project_id, concat('/ws/', d.source, '/m', d.doc_id % 5, '/doc_', d.doc_id, '.txt') AS file_path,
    CASE WHEN d.doc_id % 3 = 0 THEN 'method' ELSE 'function' END AS kind, (d.doc_id % 7)::INT AS range_start, (d.doc_id % 7 + d.doc_id % 11)::INT AS range_end,
    d.text AS body, e.embedding, d.doc_id, CASE WHEN d.doc_id % 17 = 0 THEN d.doc_id % 5 END AS group_id
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.regexp_replace("source", "^src", "").cast("long").alias("id"), F.col("source").alias("name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: the brand is the file, the key the line. Suppliers too, by nation; two in five have an entry point's name."""
    path = F.concat(F.lit("/ws/"), F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/part.rs"))
    parts = table(spark, sf_dir, "part").select(path.alias("file_path"), F.col("p_partkey").alias("line"), F.col("p_name").alias("name"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("serve_", "run_", "ship_", "Main_", "pack_"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    file = F.concat(F.lit("/ws/Nation/"), F.col("s_nationkey").cast("string"), F.lit("/supplier.rs"))
    return parts.unionByName(table(spark, sf_dir, "supplier").select(file.alias("file_path"), (-1 - F.col("s_suppkey")).alias("line"), F.concat(kind, "s_name").alias("name")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, from all line items: the first supplier of an order calls the order's first part, each item's part that of the next item (unless it is the same). So suppliers are never
    called. Orders are small, so no window is large."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    got = items.select("l_orderkey", F.coalesce(F.lag("l_partkey").over(order), -1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), F.row_number().over(order).alias("k")).where("src <> dst")
    at = nodes(spark, sf_dir).select("file_path", "line")
    a = at.select(F.col("file_path").alias("src_file"), F.col("line").alias("src"))
    b = at.select(F.col("file_path").alias("dst_file"), F.col("line").alias("dst"))
    return got.join(a, "src").join(b, "dst").select("src_file", F.col("src").alias("src_line"), "dst_file", F.col("dst").alias("dst_line"), (F.col("l_orderkey") * 100 + F.col("k")).alias("ord"))


GRAPH_SQL = """n AS (SELECT concat('/ws/', replace(p_brand, '#', '/'), '/part.rs') AS file_path, p_partkey AS line, p_name AS name FROM part UNION ALL
    SELECT concat('/ws/Nation/', s_nationkey, '/supplier.rs'), -1 - s_suppkey, concat(['serve_', 'run_', 'ship_', 'Main_', 'pack_'][(s_suppkey % 5 + 1)::INT], s_name) FROM supplier),
e AS (SELECT a.file_path AS src_file, src AS src_line, b.file_path AS dst_file, dst AS dst_line, l_orderkey * 100 + k AS ord FROM (
    SELECT l_orderkey, coalesce(lag(l_partkey) OVER w, -1 - l_suppkey) AS src, l_partkey AS dst, row_number() OVER w AS k FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) x
    JOIN n a ON a.line = src JOIN n b ON b.line = dst WHERE src <> dst)"""


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as functions, a region a file; a supplier's nation calls those of its customers, in the order of the first order (all orders and line items)."""
    n = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/ws/region"), F.col("n_regionkey").cast("string"), F.lit(".rs"))
    at = n.select(path.alias("file_path"), F.col("n_nationkey").alias("line"), F.col("n_name").alias("name"))
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    pairs = sold.join(of, "l_orderkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    calls = pairs.where("s_nationkey <> c_nationkey and (s_nationkey + c_nationkey) % 3 <> 0").groupBy(F.col("s_nationkey").alias("src_line"), F.col("c_nationkey").alias("dst_line")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    calls = calls.withColumn("ord", F.col("ord") * 10_000 + F.col("src_line") * 100 + F.col("dst_line"))
    a, b = at.select(F.col("file_path").alias("src_file"), F.col("line").alias("src_line")), at.select(F.col("file_path").alias("dst_file"), F.col("line").alias("dst_line"))
    return at, calls.join(a, "src_line").join(b, "dst_line").select("src_file", "src_line", "dst_file", "dst_line", "ord")


NATIONS_SQL = """n AS (SELECT concat('/ws/region', n_regionkey, '.rs') AS file_path, n_nationkey AS line, n_name AS name FROM nation),
e AS (SELECT s_nationkey AS src_line, c_nationkey AS dst_line, min(l_orderkey * 10 + l_linenumber) * 10000 + s_nationkey * 100 + c_nationkey AS ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey AND (s_nationkey + c_nationkey) % 3 <> 0 GROUP BY s_nationkey, c_nationkey)"""
