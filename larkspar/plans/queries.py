"""The registered queries of the similarity and call-graph operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.functions import scalars as sc
from larkspar.functions.vectors import bytes_to_embedding, embedding_to_bytes
from larkspar.operators import callgraph as cg
from larkspar.operators import catalog, hook, mermaid, review, similarity
from larkspar.operators.embed import DigestEmbedder, with_embeddings
from larkspar.operators.extract import extract_functions
from larkspar.plans import fixtures as fx
from larkspar.plans.fixtures import GRAPH_SQL, NATIONS_SQL, UNITS_SQL
from larkspar.plans.registry import ORACLES, QUERIES, query
from larkspar.sources.symbols import at_least_lines
from larkspar.tables import number_rows, shared_path, written

#: No pair of the test vectors reaches the usual 0.85.
T = 0.3
def _r(c: str = "similarity") -> Column:
    return F.round(c, 4).alias("similarity")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("qualified_name"), F.col("label").cast("long").alias("project_id"), "embedding")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


# Similarity joins


@query(f"SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round({_COS}, 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS}::FLOAT >= {T}::FLOAT")
def sim_pairs_exact(spark, d):
    got = similarity.self_join(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), T)
    return got.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), _r())


_SCAN = f"""near AS (SELECT a.vec_id AS q, b.vec_id AS c, a.label AS pq, b.label AS pc, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a CROSS JOIN embeddings b)"""


@query(f"WITH {_SCAN} SELECT least(q, c) AS unit_a, greatest(q, c) AS unit_b, round(max(s), 4) AS similarity FROM near WHERE r <= 100 AND s::FLOAT >= {T}::FLOAT AND q <> c GROUP BY 1, 2")
def sim_scan(spark, d):
    return similarity.scan_pairs(_vectors(spark, d), T).select("unit_a", "unit_b", _r())


@query(f"WITH {_SCAN} SELECT least(q, c) AS unit_a, greatest(q, c) AS unit_b, round(max(s), 4) AS similarity FROM near WHERE r <= 100 AND s::FLOAT >= {T}::FLOAT AND q <> c AND pq <> pc GROUP BY 1, 2")
def sim_pairs_cross(spark, d):
    return similarity.scan_pairs(_vectors(spark, d), T, cross_only=True).select("unit_a", "unit_b", _r())


@query(
    f"WITH near AS (SELECT a.vec_id AS q, b.vec_id AS c, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label = 1) SELECT least(q, c) AS unit_a, greatest(q, c) AS unit_b, round(max(s), 4) AS similarity FROM near WHERE r <= 50 AND s::FLOAT >= 0.2::FLOAT GROUP BY 1, 2"
)
def sim_compare_ab(spark, d):
    v = _vectors(spark, d)
    return similarity.compare(v.where("project_id = 0"), v.where("project_id = 1"), 0.2).select("unit_a", "unit_b", _r())


@query(f"WITH {_SCAN} SELECT q, c, r AS place, round(s, 4) AS similarity FROM near WHERE r <= 10")
def sim_knn_topk(spark, d):
    v = _vectors(spark, d)
    got = similarity.knn(v.select(F.col("qualified_name").alias("q"), F.col("embedding").alias("v")), v.select(F.col("qualified_name").alias("c"), F.col("embedding").alias("v")), 10)
    return got.select("q", "c", F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "c")).cast("long").alias("place"), _r())


@query(
    f"WITH near AS (SELECT a.vec_id AS q, b.vec_id AS c, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.label >= 5) SELECT q, c, round(1 - s, 4) AS distance FROM near WHERE r <= 5 AND s::FLOAT >= 0.1::FLOAT"
)
def sim_knn_filtered(spark, d):
    """A predicate inside the search: it counts before the k are chosen."""
    v = _vectors(spark, d)
    got = similarity.knn(v.select(F.col("qualified_name").alias("q"), F.col("embedding").alias("v")), v.select(F.col("qualified_name").alias("c"), F.col("embedding").alias("v"), "project_id"), 6, 0.1, lambda c: c.where("project_id >= 5"))
    got = catalog.first_of(got.where("q <> c").withColumn("one", F.lit(1)), ["q", "c"], ["one"])
    best = W.partitionBy("q").orderBy(F.desc("similarity"), "c")
    return got.withColumn("r", F.row_number().over(best)).where("r <= 5").select("q", "c", F.round(1 - F.col("similarity"), 4).alias("distance"))


# Stored pairs and their review


def _pairs(spark, d):
    u = fx.units(spark, d)
    got = similarity.self_join(u.select(F.col("qualified_name").alias("id"), F.col("embedding").alias("v")), T)
    got = number_rows(got.select(F.col("a").alias("unit_a"), F.col("b").alias("unit_b"), F.col("similarity").cast("float").alias("similarity")), ["unit_a", "unit_b"], "id")
    status = F.element_at(F.array(*(F.lit(x) for x in ("new", "confirmed", "redundant", "ignored"))), (F.col("id") % 4 + 1).cast("int"))
    return written(got.withColumn("status", status).withColumn("trigger_reason", F.when(F.col("id") % 3 == 0, "scan")), "pairs").select("id", "unit_a", "unit_b", "similarity", "status", "trigger_reason")


_PAIRS = f"""{UNITS_SQL}, p0 AS (SELECT a.qualified_name AS unit_a, b.qualified_name AS unit_b, {_COS}::FLOAT AS similarity FROM u a JOIN u b ON a.qualified_name < b.qualified_name WHERE {_COS}::FLOAT >= {T}::FLOAT),
p1 AS (SELECT row_number() OVER (ORDER BY unit_a, unit_b) AS id, * FROM p0),
p AS (SELECT *, ['new', 'confirmed', 'redundant', 'ignored'][id % 4 + 1] AS status, CASE WHEN id % 3 = 0 THEN 'scan' END AS trigger_reason FROM p1)"""


@query(
    f"WITH {_PAIRS} SELECT id, unit_a, unit_b, round(similarity::DOUBLE, 4) AS similarity, status, a.file_path AS file_a, a.range_start AS start_a, b.file_path AS file_b, b.range_start AS start_b FROM p JOIN u a ON a.qualified_name = unit_a JOIN u b ON b.qualified_name = unit_b WHERE similarity >= 0.32::FLOAT"
)
def pairs_joined(spark, d):
    got = review.joined_pairs(_pairs(spark, d), fx.units(spark, d), 0.32)
    return similarity.ranked(got).select("id", "unit_a", "unit_b", F.round(F.col("similarity").cast("double"), 4).alias("similarity"), "status", "file_a", "start_a", "file_b", "start_b")


@query(f"WITH {_PAIRS} SELECT id, unit_a, unit_b, format('{{:.2f}}%', (similarity * 100::FLOAT)::DOUBLE) AS percent, CAST(floor(similarity * 100::FLOAT) AS INT) AS whole FROM p ORDER BY similarity DESC, unit_a, unit_b LIMIT 20")
def pairs_top20(spark, d):
    """The list that is shown: a limit is its feature."""
    got = similarity.ranked(_pairs(spark, d), 20)
    return got.select("id", "unit_a", "unit_b", sc.percent_text("similarity").alias("percent"), sc.percent_whole("similarity").alias("whole"))


@query(f"WITH {_PAIRS} SELECT project_id, status, count(*) AS n FROM p JOIN u ON unit_a = qualified_name GROUP BY ALL")
def pairs_by_status(spark, d):
    return review.pairs_by_status(_pairs(spark, d), fx.units(spark, d))


@query(f"WITH {_PAIRS} SELECT p.id, unit_a, unit_b FROM p JOIN u a ON a.qualified_name = unit_a JOIN u b ON b.qualified_name = unit_b WHERE a.project_id <> b.project_id")
def pairs_across_projects(spark, d):
    return review.across_projects(_pairs(spark, d), fx.units(spark, d)).select("id", "unit_a", "unit_b")


def _groups(spark, d):
    p = fx.projects(spark, d)
    return p.where("id % 3 <> 1").select((F.col("id") * 2).alias("id"), F.col("id").alias("project_id"), F.concat(F.lit("group "), "name").alias("name"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("pattern"))


@query(
    f"WITH {_PAIRS}, j AS (SELECT DISTINCT project_id FROM u), s AS (SELECT project_id, status, count(*) AS n FROM p JOIN u ON unit_a = qualified_name GROUP BY ALL) SELECT project_id, (SELECT count(*) FROM u WHERE u.project_id = j.project_id) AS total_units, coalesce((SELECT string_agg(concat(status, '=', n), ',' ORDER BY status) FROM s WHERE s.project_id = j.project_id), '') AS pairs, CASE WHEN project_id % 3 <> 1 THEN 1 ELSE 0 END::BIGINT AS total_groups FROM j"
)
def project_stats(spark, d):
    got = review.project_stats(fx.projects(spark, d), fx.units(spark, d), _pairs(spark, d), _groups(spark, d))
    text = F.array_join(F.transform(F.map_entries("pairs_by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select("project_id", "total_units", text.alias("pairs"), "total_groups")


@query(
    f"WITH {_PAIRS}, i AS (SELECT greatest(a.qualified_name, b.qualified_name) AS ub, least(a.qualified_name, b.qualified_name) AS ua, {_COS}::FLOAT AS s FROM u a JOIN u b ON a.qualified_name < b.qualified_name WHERE {_COS}::FLOAT >= 0.28::FLOAT AND {_COS}::FLOAT < 0.32::FLOAT), nw AS (SELECT * FROM i ANTI JOIN p ON ua = unit_a AND ub = unit_b) SELECT id, unit_a, unit_b, status, CASE WHEN s IS NULL THEN trigger_reason ELSE 'rescan' END AS trigger_reason FROM p LEFT JOIN i ON ua = unit_a AND ub = unit_b UNION ALL SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY ua, ub), ua, ub, 'new', 'rescan' FROM nw"
)
def pairs_upsert(spark, d):
    """A later scan, whose pairs come in the other order: known ones keep id and status."""
    u = fx.units(spark, d)
    late = similarity.self_join(u.select(F.col("qualified_name").alias("id"), F.col("embedding").alias("v")), 0.28).where(~sc.at_least("similarity", 0.32))
    got = catalog.upsert_pairs(_pairs(spark, d), late.select(F.col("b").alias("unit_a"), F.col("a").alias("unit_b"), "similarity"), "rescan")
    return got.select("id", "unit_a", "unit_b", "status", "trigger_reason")


@query(f"WITH {_PAIRS}, x AS (SELECT min(unit_a) AS g FROM p) SELECT id, unit_a, unit_b, CASE WHEN id IN (1, 2, 3) THEN 'confirmed' ELSE status END AS status FROM p, x WHERE unit_a <> g AND unit_b <> g")
def pairs_status_and_delete(spark, d):
    p = _pairs(spark, d)
    gone = p.agg(F.min("unit_a")).first()[0]
    return catalog.delete_pairs_of(catalog.set_pair_status(p, [1, 2, 3], "confirmed"), gone or "").select("id", "unit_a", "unit_b", "status")


# Units


_STRUCTURE = r"array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(body, '\r?\n$', ''), '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '//')), chr(10))"


@query(
    f"""WITH {UNITS_SQL}, o AS (SELECT *, sha256(body) AS content_hash, sha256({_STRUCTURE}) AS sh FROM u WHERE doc_id % 4 <> 0), n AS (SELECT *, sha256(concat(body, 'x')) AS content_hash, sha256({_STRUCTURE}) AS sh FROM u WHERE kind = 'method'),
g AS (SELECT n.qualified_name, (SELECT o.group_id FROM o WHERE o.sh = n.sh AND o.qualified_name <> n.qualified_name AND o.group_id IS NOT NULL ORDER BY o.qualified_name LIMIT 1) AS inherited FROM n)
SELECT coalesce(o.qualified_name, n.qualified_name) AS qualified_name, CASE WHEN o.qualified_name IS NULL THEN n.project_id + 100 ELSE o.project_id END AS project_id, CASE WHEN n.qualified_name IS NULL THEN o.file_path ELSE concat(n.file_path, '.moved') END AS file_path,
CASE WHEN n.qualified_name IS NULL THEN o.content_hash ELSE n.content_hash END AS content_hash, coalesce(n.embedding, o.embedding) IS NOT NULL AS embedded, coalesce(o.group_id, g.inherited, -1) AS group_id FROM o FULL JOIN n ON o.qualified_name = n.qualified_name LEFT JOIN g ON g.qualified_name = n.qualified_name"""
)
def units_upsert(spark, d):
    """Methods come again, moved and changed; a quarter of all units is new."""
    u = fx.units(spark, d)
    old = fx.hashed_units(spark, d).join(u.where("doc_id % 4 <> 0").select("qualified_name"), "qualified_name", "left_semi")
    late = u.where("kind = 'method'").select("qualified_name", (F.col("project_id") + 100).alias("project_id"), F.concat("file_path", F.lit(".moved")).alias("file_path"), "kind", "range_start", "range_end", sc.content_hash(F.concat("body", F.lit("x"))).alias("content_hash"), sc.structure_hash("body").alias("structure_hash"), "embedding", F.lit(None).cast("long").alias("group_id"))
    got = catalog.upsert_units(old.select(late.columns), late)
    return got.select("qualified_name", "project_id", "file_path", "content_hash", F.col("embedding").isNotNull().alias("embedded"), F.coalesce("group_id", F.lit(-1).cast("long")).alias("group_id"))


@query(f"WITH {UNITS_SQL}, k AS (SELECT sha256(body) AS h, arg_min(doc_id, qualified_name) AS of FROM u WHERE embedding IS NOT NULL GROUP BY 1) SELECT qualified_name, of IS NOT NULL AS known FROM u LEFT JOIN k ON sha256(body) = h")
def embedding_cache(spark, d):
    u = fx.hashed_units(spark, d)
    return catalog.cached_embeddings(u.select("qualified_name", "content_hash"), u).select("qualified_name", F.col("embedding").isNotNull().alias("known"))


@query(f"WITH {UNITS_SQL} SELECT qualified_name, coalesce(len(embedding), 0) AS dims, embedding IS NOT NULL AS round_trip FROM u")
def embedding_bytes(spark, d):
    u = fx.units(spark, d).select("qualified_name", "embedding", bytes_to_embedding(embedding_to_bytes("embedding")).alias("back"))
    return u.select("qualified_name", F.when(F.col("back").isNotNull(), F.size("back")).otherwise(0).cast("long").alias("dims"), F.coalesce(F.col("embedding") == F.col("back"), F.lit(False)).alias("round_trip"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS short_hash FROM documents")
def content_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", sc.content_hash("text").alias("content_hash"), sc.short_content_hash("text").alias("short_hash"))


@query(f"SELECT doc_id, sha256({_STRUCTURE.replace('body', 'text')}) AS structure_hash FROM documents")
def structure_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", sc.structure_hash("text").alias("structure_hash"))


_NORMAL = r"""regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '\r?\n', ' ', 'g'), '/\*/|(?s:/\*.*?\*/)', '', 'g'), '\s+', ' ', 'g')), '"(?:\\.|[^"\\])*(?:"|\\?$)', '"$STR"', 'g'), '[0-9][0-9.]*', '$NUM', 'g')"""


@query(f"SELECT doc_id, {_NORMAL} AS code, substr(sha256({_NORMAL}), 1, 16) AS hash FROM documents")
def normalize_code(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", sc.normalize_code("text").alias("code"), sc.normalized_hash("text").alias("hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups_by_content_hash(spark, d):
    return fx.table(spark, d, "documents").groupBy(sc.content_hash("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(
    rf"""WITH {UNITS_SQL} SELECT qualified_name, string_split(qualified_name, '::')[-1] AS short_name, concat(regexp_replace(qualified_name, '^.*?::', ''), ' (', string_split(string_split(qualified_name, '::')[1], '/')[-1], ')') AS format_name,
    string_split(file_path, '/')[-1] AS base, regexp_replace(qualified_name, '::|[/.\-]', '_', 'g') AS node_id, concat(regexp_replace(file_path, '::|[/.\-]', '_', 'g'), '_', range_start) AS ref_id,
    replace(regexp_replace(regexp_replace(substr(file_path, 4), '^/+', ''), '([^/])\.[^./]*$', '\1'), '/', '::') AS module, CASE WHEN file_path LIKE '/ws/src1/%' THEN substr(file_path, 10) ELSE file_path END AS relative FROM u"""
)
def names(spark, d):
    u = fx.units(spark, d)
    return u.select("qualified_name", sc.short_name("qualified_name").alias("short_name"), sc.format_name("qualified_name").alias("format_name"), sc.basename("file_path").alias("base"), sc.node_id("qualified_name").alias("node_id"), sc.ref_id("file_path", "range_start").alias("ref_id"), sc.module_of("file_path", "/ws").alias("module"), sc.relative_path("file_path", "/ws/src1/").alias("relative"))


@query(
    "SELECT page_id, CASE lower(regexp_extract(path, '(?:^|/)[^/]+\\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'swift' THEN 'swift' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' END AS language FROM (SELECT page_id, concat('/a.b/f', page_id, ['.rs', '.SWIFT', '.py', '.ts', '.go', '.md', ''][(page_id % 7)::INT + 1]) AS path FROM pages)"
)
def language_of(spark, d):
    ext = F.element_at(F.array(*(F.lit(x) for x in (".rs", ".SWIFT", ".py", ".ts", ".go", ".md", ""))), (F.col("page_id") % 7 + 1).cast("int"))
    return fx.table(spark, d, "pages").select("page_id", sc.language_of(F.concat(F.lit("/a.b/f"), F.col("page_id").cast("string"), ext)).alias("language"))


@query(f"WITH {UNITS_SQL} SELECT qualified_name, range_end - range_start AS n FROM u WHERE range_end - range_start >= 3")
def min_lines_filter(spark, d):
    return at_least_lines(fx.units(spark, d), 3).select("qualified_name", (F.col("range_end") - F.col("range_start")).alias("n"))


@query(f"WITH {UNITS_SQL} SELECT qualified_name, project_id FROM u WHERE project_id IN (1, 3)")
def units_of_projects(spark, d):
    u = fx.units(spark, d).select("qualified_name", "project_id")
    return catalog.units_of_projects(u, [1, 3]).unionByName(catalog.units_of_projects(u, []))


@query(f"WITH {UNITS_SQL} SELECT qualified_name, 2 AS group_id FROM u WHERE group_id = 2")
def group_members(spark, d):
    return catalog.members(fx.hashed_units(spark, d), 2).select("qualified_name", F.col("group_id").cast("int").alias("group_id"))


@query("SELECT row_number() OVER (ORDER BY name) + 3 AS id, name FROM (SELECT DISTINCT source AS name FROM documents WHERE source NOT IN ('src0', 'src1', 'src2')) UNION ALL SELECT * FROM (VALUES (1, 'old'), (2, 'old'), (3, 'old')) t(id, name)")
def projects_added(spark, d):
    """Known root paths keep their names; new ones get the next ids."""
    old = spark.createDataFrame([(i + 1, "old", f"/ws/src{i}", "rust", None) for i in range(3)], "id long, name string, root_path string, language string, last_indexed_at timestamp")
    wanted = fx.table(spark, d, "documents").select(F.col("source").alias("name"), F.concat(F.lit("/ws/"), "source").alias("root_path"), F.lit("rust").alias("language"))
    return catalog.projects_by_name(catalog.add_projects(old, wanted)).select("id", "name")


# Hook


def _hook_queries(spark, d):
    u = fx.units(spark, d).where("embedding is not null")
    return u.select(F.col("doc_id").cast("string").alias("event"), "qualified_name", "file_path", F.col("range_start").alias("line"), "project_id", "embedding")


_HOOK = f"""{_PAIRS}, near AS (SELECT a.qualified_name AS current_name, b.qualified_name AS similar_name, a.project_id <> b.project_id AS is_cross_project, {_COS} AS s FROM u a JOIN u b ON a.qualified_name <> b.qualified_name WHERE {_COS}::FLOAT >= {T}::FLOAT)"""
_HOOK_END = "SELECT current_name, similar_name, round(s::FLOAT::DOUBLE, 4) AS similarity, is_cross_project FROM (SELECT *, row_number() OVER (PARTITION BY current_name ORDER BY s DESC, similar_name) AS r FROM near WHERE {}) WHERE r <= 3"


def _hook(spark, d, scope, pairs=None):
    got = hook.similar_units(_hook_queries(spark, d), fx.units(spark, d).select("qualified_name", "project_id", "file_path", "range_start", "embedding"), pairs, hook.HookConfig(threshold=T, scope=scope))
    return got.select("current_name", "similar_name", F.round(F.col("similarity").cast("double"), 4).alias("similarity"), "is_cross_project")


@query(f"WITH {_HOOK} {_HOOK_END.format('true')}")
def hook_lookup_all(spark, d):
    return _hook(spark, d, "all")


@query(f"WITH {_HOOK} {_HOOK_END.format('NOT is_cross_project')}")
def hook_lookup_project(spark, d):
    return _hook(spark, d, "project")


@query(f"WITH {_HOOK} {_HOOK_END.format('is_cross_project')}")
def hook_lookup_cross(spark, d):
    return _hook(spark, d, "cross")


@query(f"WITH {_HOOK} {_HOOK_END.format("NOT EXISTS (SELECT 1 FROM p WHERE status = 'ignored' AND unit_a = least(current_name, similar_name) AND unit_b = greatest(current_name, similar_name))")}")
def hook_lookup_ignored(spark, d):
    return _hook(spark, d, "all", _pairs(spark, d))


def _code_events(spark, d):
    """An event for each part: a small Rust file is written."""
    p = fx.table(spark, d, "part")
    code = F.concat(F.lit("struct S {\n    a: u32,\n}\n\nimpl S {\n    fn f"), F.col("p_partkey").cast("string"), F.lit('(&self) -> u32 {\n        // '), "p_name", F.lit('\n        let s = "}";\n        let t = '), F.col("p_size").cast("string"), F.lit(";\n        self.a + t\n    }\n}\n"))
    return p.select(F.col("p_partkey").cast("string").alias("event"), F.lit("PostToolUse").alias("hook_event_name"), F.lit("Write").alias("tool_name"), F.struct(F.concat(F.lit("/ws/f"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("file_path"), code.alias("content")).alias("tool_input"), F.lit("/ws/src1").alias("cwd"))


@query(
    r"""SELECT concat('rust:/ws/f', p_partkey, '.rs::S::f', p_partkey) AS qualified_name, 'method' AS kind, 6 AS range_start, 11 AS range_end,
    sha256(concat('// Struct fields:', chr(10), 'a: u32', chr(10), chr(10), '    fn f', p_partkey, '(&self) -> u32 {', chr(10), '        // ', p_name, chr(10), '        let s = "}";', chr(10), '        let t = ', p_size, ';', chr(10), '        self.a + t', chr(10), '    }')) AS body_hash FROM part"""
)
def extract_rust(spark, d):
    files = _code_events(spark, d).select("tool_input.file_path", "tool_input.content")
    return extract_functions(files, 5).select("qualified_name", "kind", "range_start", "range_end", sc.content_hash("body").alias("body_hash"))


def _code_index(spark, d):
    """Stored units that are the functions of the same files in another project."""
    u = extract_functions(_code_events(spark, d).select("tool_input.file_path", "tool_input.content"), 5)
    u = u.withColumn("qualified_name", F.concat(F.lit("old:"), "qualified_name")).withColumn("content_hash", sc.content_hash("body"))
    u = written(u, "code_units")  # read twice by the next line
    u = with_embeddings(u, fx.hashed_units(spark, d).limit(0), DigestEmbedder())
    return written(u.select("qualified_name", F.lit(2).cast("long").alias("project_id"), "file_path", "range_start", "embedding"), "code_index")


#: The nearest of a written function is the same function of the index.
_ANSWER = """to_json({'decision': 'block', 'reason': concat('⚠️ 检测到相似代码:', chr(10), '  (100%) [跨项目]', chr(10), '  ├─ 当前: f', p_partkey, '.rs:6 f', p_partkey, '()', chr(10), '  └─ 相似: f', p_partkey, '.rs:6 f', p_partkey, '()', chr(10), chr(10),
    '📋 处理方式:', chr(10), '  1. 复用: import 或调用已有实现，避免重复', chr(10), '  2. 忽略: 运行 larkspar ignore "<当前>" "<相似>" 标记为合理重复', chr(10), '  3. 继续: 如果逻辑不同只是结构相似，直接继续编写')})::VARCHAR"""
_CONTENT = """concat('struct S {', chr(10), '    a: u32,', chr(10), '}', chr(10), chr(10), 'impl S {', chr(10), '    fn f', p_partkey, '(&self) -> u32 {', chr(10), '        // ', p_name, chr(10), '        let s = "}";', chr(10), '        let t = ', p_size, ';', chr(10), '        self.a + t', chr(10), '    }', chr(10), '}', chr(10))"""
_EVENT = f"to_json({{'hook_event_name': 'PostToolUse', 'tool_name': 'Write', 'tool_input': {{'file_path': concat('/ws/f', p_partkey, '.rs'), 'content': {_CONTENT}}}, 'cwd': '/ws/src1'}})::VARCHAR"


@query(f"SELECT p_partkey::VARCHAR AS event, {_ANSWER} AS result FROM part")
def hook_results(spark, d):
    """Each event's answer as JSON, from the code it writes."""
    projects = spark.createDataFrame([(1, "src1", "/ws/src1")], "id long, name string, root_path string")
    return hook.hook_lookup(_code_events(spark, d), _code_index(spark, d), None, projects, hook.HookConfig(max_results=1), DigestEmbedder())


@query(f"SELECT sha256({_EVENT}) AS event, {_ANSWER} AS result, 0 AS batch FROM part")
def hook_stream(spark, d):
    """The same events from JSON files, as a stream that ends when they are read."""
    from larkspar.streaming import hook as stream

    base = shared_path(spark, "stream")
    _code_events(spark, d).drop("event").write.json(f"{base}/in")
    index = _code_index(spark, d)
    q = stream.run(spark, f"{base}/in", f"{base}/out", f"{base}/state", lambda: (index, None, None), hook.HookConfig(max_results=1), DigestEmbedder(), version=lambda: 1)
    q.awaitTermination()
    return spark.read.schema("event string, result string, batch int").parquet(f"{base}/out")


# Call graphs


@query(f"WITH {GRAPH_SQL} SELECT file_path, line, name FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE dst_file = file_path AND dst_line = line) AND NOT regexp_matches(lower(name), 'main|test_|_test|new|default|init|setup|run')")
def dead_code(spark, d):
    return cg.dead_code(fx.nodes(spark, d), fx.edges(spark, d))


@query(f"WITH {GRAPH_SQL}, dead AS (SELECT file_path AS file, line, name FROM n ANTI JOIN e ON dst_file = file_path AND dst_line = line) SELECT file, line, name, regexp_matches(lower(name), 'main|test_|_test|new|default|init|setup|run') AS entry FROM dead")
def uncalled(spark, d):
    n, e = fx.nodes(spark, d), fx.edges(spark, d)
    got = n.join(e, (n["file_path"] == e["dst_file"]) & (n["line"] == e["dst_line"]), "left_anti")
    return got.select(F.col("file_path").alias("file"), "line", "name", sc.is_entry_point("name").alias("entry"))


_DEGREE = "g AS (SELECT n.*, (SELECT count(*) FROM e WHERE dst_line = line) AS n_callers, (SELECT count(*) FROM e WHERE src_line = line) AS n_callees FROM n), top AS (SELECT *, n_callers + n_callees AS degree FROM g ORDER BY degree DESC, file_path, line LIMIT {})"


@query(f"WITH {GRAPH_SQL}, {_DEGREE.format(100)} SELECT file_path, line, n_callers, n_callees, degree FROM top")
def node_degree_topn(spark, d):
    return cg.busiest(fx.nodes(spark, d), fx.edges(spark, d), 100).select("file_path", "line", "n_callers", "n_callees", "degree")


@query(f"WITH {GRAPH_SQL}, {_DEGREE.format(100)} SELECT src_line, dst_line, count(*) AS n FROM e WHERE src_line IN (SELECT line FROM top) AND dst_line IN (SELECT line FROM top) GROUP BY ALL")
def edges_within_topn(spark, d):
    n, e = fx.nodes(spark, d), written(fx.edges(spark, d), "edges")
    return cg.edges_within(e, cg.busiest(n, e, 100)).groupBy("src_line", "dst_line").agg(F.count("*").alias("n"))


_MODULE = r"replace(regexp_replace(regexp_replace(substr({}, 4), '^/+', ''), '([^/])\.[^./]*$', '\1'), '/', '::')"
_MODULES = f"m AS (SELECT {_MODULE.format('src_file')} AS from_module, {_MODULE.format('dst_file')} AS to_module, count(*) AS n FROM e WHERE src_file <> dst_file GROUP BY ALL)"


@query(f"WITH {GRAPH_SQL}, {_MODULES} SELECT * FROM m")
def module_edges(spark, d):
    return cg.module_edges(fx.nodes(spark, d), fx.edges(spark, d), "/ws")


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT {_MODULE.format('file_path')} AS module FROM n")
def module_set(spark, d):
    return cg.modules(fx.nodes(spark, d), "/ws")


def _tree_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {GRAPH_SQL}, {_DEGREE.format(5)}, x AS (SELECT DISTINCT {a} AS f, {b} AS t FROM e),
t AS (SELECT line AS root_line, line, 0 AS depth FROM top UNION SELECT root_line, x.t, depth + 1 FROM t JOIN x ON x.f = t.line WHERE depth < 3),
d AS (SELECT root_line, line, min(depth) AS depth FROM t GROUP BY ALL) SELECT d.root_line, d.line, name, depth FROM d JOIN n ON n.line = d.line"""


def _tree(spark, d, incoming):
    n, e = fx.nodes(spark, d), written(fx.edges(spark, d), "edges")
    roots = written(cg.busiest(n, e, 5), "roots")
    return cg.tree_bfs(n, e, roots, 3, incoming).select("root_line", "line", "name", "depth")


@query(_tree_sql("src_line", "dst_line"))
def call_tree_out_bfs(spark, d):
    return _tree(spark, d, False)


@query(_tree_sql("dst_line", "src_line"))
def call_tree_in_bfs(spark, d):
    return _tree(spark, d, True)


def _dfs_sql(a: str, b: str, depth: int) -> str:
    """Each root's walk as one row that is rewritten: its stack, what it has seen, and what it has just met."""
    return f"""WITH RECURSIVE {NATIONS_SQL}, c AS (SELECT {a} AS line, list({{'line': {b}, 'd': 0}} ORDER BY ord DESC, {b} DESC) AS next FROM e GROUP BY 1),
w AS (SELECT line AS root, [{{'line': line, 'd': 0}}] AS stack, []::BIGINT[] AS seen, NULL::BIGINT AS met, NULL::INT AS depth, NULL::INT AS ord FROM n UNION ALL
    SELECT root, CASE WHEN new THEN list_concat(rest, list_transform(coalesce(next, []), lambda x: {{'line': x.line, 'd': top.d + 1}})) ELSE rest END, CASE WHEN new THEN list_append(seen, top.line) ELSE seen END,
        CASE WHEN new THEN top.line END, CASE WHEN new THEN top.d END, CASE WHEN new THEN len(seen) END
    FROM (SELECT *, top.d <= {depth} AND NOT list_contains(seen, top.line) AS new FROM (SELECT root, stack[-1] AS top, stack[:-2] AS rest, seen FROM w WHERE len(stack) > 0)) LEFT JOIN c ON c.line = top.line)
SELECT root AS root_line, w.ord, met AS line, name, depth FROM w JOIN n ON n.line = met"""


@query(_dfs_sql("src_line", "dst_line", 4))
def call_tree_dfs(spark, d):
    """Depth-first from every nation, with a depth bound and one visited set."""
    n, e = fx.nation_graph(spark, d)
    return cg.tree_dfs(n, written(e, "edges"), n, 4).select("root_line", "ord", "line", "name", "depth")


@query(_dfs_sql("dst_line", "src_line", 3))
def call_tree_dfs_in(spark, d):
    n, e = fx.nation_graph(spark, d)
    return cg.tree_dfs(n, written(e, "edges"), n, 3, incoming=True).select("root_line", "ord", "line", "name", "depth")


@query()
def call_tree_dfs_parts(spark, d):
    """The same over all parts, from the five busiest; too large for SQL."""
    n, e = fx.nodes(spark, d), written(fx.edges(spark, d), "edges")
    return cg.tree_dfs(n, e, written(cg.busiest(n, e, 5), "roots"), 3)


@query(f"WITH {GRAPH_SQL}, w AS (SELECT max(name) AS name FROM n) SELECT file_path, line, n.name FROM n JOIN w ON n.name = w.name ORDER BY file_path, line LIMIT 1")
def find_function(spark, d):
    n = fx.nodes(spark, d)
    return cg.find_function(n, n.agg(F.max("name")).first()[0] or "")


_ID = r"regexp_replace({}, '::|[/.\-]', '_', 'g')"


@query(
    f"""WITH {GRAPH_SQL}, {_DEGREE.format(100)}, boxes AS (SELECT row_number() OVER (ORDER BY degree DESC, file_path, line) AS k, concat('    ', {_ID.format('file_path')}, '_', line, CASE WHEN n_callers = 0 THEN '[[' WHEN n_callees = 0 THEN '([' ELSE '[' END, name, CASE WHEN n_callers = 0 THEN ']]' WHEN n_callees = 0 THEN '])' ELSE ']' END) AS line FROM top),
arrows AS (SELECT row_number() OVER (ORDER BY degree DESC, src_file, src_line, ord, dst_file, dst_line) AS k, concat('    ', {_ID.format('src_file')}, '_', src_line, ' --> ', {_ID.format('dst_file')}, '_', dst_line) AS line FROM e JOIN top a ON a.line = src_line WHERE dst_line IN (SELECT line FROM top))
SELECT 0::INT AS ord, 'flowchart TD' AS line UNION ALL SELECT k::INT, line FROM boxes UNION ALL SELECT (k + (SELECT count(*) FROM boxes))::INT, line FROM arrows"""
)
def mermaid_callgraph(spark, d):
    return mermaid.call_graph(fx.nodes(spark, d), written(fx.edges(spark, d), "edges"))


@query(
    f"""WITH {GRAPH_SQL}, {_MODULES}, b AS (SELECT row_number() OVER (ORDER BY module) AS k, concat('    ', {_ID.format('module')}, '[', module, ']') AS line FROM (SELECT DISTINCT {_MODULE.format('file_path')} AS module FROM n)),
a AS (SELECT row_number() OVER (ORDER BY from_module, to_module) AS k, concat('    ', {_ID.format('from_module')}, ' -->|', n, '| ', {_ID.format('to_module')}) AS line FROM m)
SELECT 0::INT AS ord, 'flowchart TD' AS line UNION ALL SELECT k::INT, line FROM b UNION ALL SELECT (k + (SELECT count(*) FROM b))::INT, line FROM a"""
)
def mermaid_modules(spark, d):
    return mermaid.module_diagram(fx.nodes(spark, d), written(fx.edges(spark, d), "edges"), "/ws")


from larkspar.plans import source_queries, store_queries  # noqa: E402, F401
