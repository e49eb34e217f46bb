"""Queries over the store: its tables through changes and versions, the commands on it, and the hook's answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.api import Scanner, Store
from larkspar.functions import scalars as sc
from larkspar.operators import catalog, hook, review
from larkspar.operators.embed import HashingEmbedder
from larkspar.plans import fixtures as fx
from larkspar.plans.fixtures import UNITS_SQL
from larkspar.plans.queries import _COS, _HOOK, _PAIRS, T, _code_events, _hook_queries, _pairs
from larkspar.plans.registry import query
from larkspar.sources.symbols import at_least_lines
from larkspar.tables import shared_path

# Tables


def _projects(spark, d):
    p = fx.projects(spark, d)
    return p.select("id", "name", F.concat(F.lit("/ws/"), "name").alias("root_path"), F.lit("rust").alias("language"), F.lit(None).cast("timestamp").alias("last_indexed_at"))


@query("SELECT DISTINCT regexp_replace(source, '^src', '')::BIGINT AS id, CASE WHEN source = 'src1' THEN 2024 END::INT AS year FROM documents")
def projects_touched(spark, d):
    """The time of indexing of one project is set."""
    got = catalog.touch_project(_projects(spark, d), 1, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return got.select("id", F.year("last_indexed_at").alias("year"))


@query(f"WITH {UNITS_SQL}, f AS (SELECT min(file_path) AS file FROM u) SELECT qualified_name, file_path FROM u, f WHERE file_path <> file")
def units_deleted_of_file(spark, d):
    u = fx.units(spark, d)
    return catalog.delete_units_of_file(u, u.agg(F.min("file_path")).first()[0] or "").select("qualified_name", "file_path")


@query(f"WITH {UNITS_SQL}, f AS (SELECT max(file_path) AS file, max(qualified_name) AS name FROM u) SELECT qualified_name, 'file' AS found FROM u, f WHERE file_path = file UNION ALL SELECT qualified_name, 'name' FROM u, f WHERE qualified_name = name")
def units_looked_up(spark, d):
    """Units of one file, and one unit by name."""
    u = fx.units(spark, d)
    file, name = u.agg(F.max("file_path"), F.max("qualified_name")).first()
    got = catalog.units_of_file(u, file or "").select("qualified_name", F.lit("file").alias("found"))
    return got.unionByName(catalog.unit(u, name or "").select("qualified_name", F.lit("name").alias("found")))


_SCHEMA = "id long, project_id long, name string, reason string, pattern string"


@query(f"WITH {UNITS_SQL}, k AS (SELECT qualified_name, row_number() OVER (ORDER BY qualified_name) AS r FROM u) SELECT u.qualified_name, CASE WHEN r <= 5 THEN 12 WHEN r <= 9 THEN 11 ELSE group_id END::BIGINT AS group_id FROM u JOIN k USING (qualified_name)")
def groups_assigned(spark, d):
    """Two groups are made after an old one, and the first units by name put into them; a later group replaces an earlier one."""
    groups = spark.createDataFrame([(10, 1, "old", None, None)], _SCHEMA)
    groups, a = catalog.add_group(groups, 2, "a", "alike", "A*")
    groups, b = catalog.add_group(groups, 3, "b")
    u = fx.hashed_units(spark, d)
    names = [r[0] for r in u.select("qualified_name").orderBy("qualified_name").limit(9).collect()]
    u = catalog.assign_group(catalog.assign_group(u, names, a), names[:5], b)
    assert {r["id"] for r in groups.collect()} == {10, a, b}
    return u.select("qualified_name", "group_id")


@query("SELECT row_number() OVER (ORDER BY concat('g', id % 7), id, n) AS place, id * 10 + n AS id, concat('g', id % 7) AS project_name FROM (SELECT DISTINCT regexp_replace(source, '^src', '')::BIGINT AS id FROM documents), (VALUES (1), (2)) v(n)")
def groups_in_project_order(spark, d):
    """All groups in the order of their projects' names."""
    store = Store(spark, shared_path(spark, "store"))
    p = _projects(spark, d)
    store.db.replace("projects", p.withColumn("name", F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    store.db.replace("similarity_groups", p.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.col("id").alias("project_id")).select((F.col("project_id") * 10 + F.col("n")).alias("id"), "project_id", F.lit("x").alias("name"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("pattern")))
    rows = store.list_groups().collect()  # two for each project
    return spark.createDataFrame([(i + 1, r["id"], r["project_name"]) for i, r in enumerate(rows)], "place long, id long, project_name string")


@query(f"SELECT a.vec_id AS unit_a, b.vec_id AS unit_b, round({_COS}, 4) AS similarity FROM embeddings a JOIN embeddings b ON concat(a.label, ':', lpad(a.vec_id::VARCHAR, 9, '0')) < concat(b.label, ':', lpad(b.vec_id::VARCHAR, 9, '0')) WHERE {_COS}::FLOAT >= {T}::FLOAT")
def scanner_pairs(spark, d):
    """A brute-force scan: each pair once, in the order of the units' places."""
    e = fx.table(spark, d, "embeddings")
    pos = F.concat(F.col("label").cast("string"), F.lit(":"), F.lpad(F.col("vec_id").cast("string"), 9, "0"))
    got = Scanner().with_threshold(T).scan_similarities(e.select(pos.alias("pos"), F.col("vec_id").alias("qualified_name"), "embedding"))
    return got.select("unit_a", "unit_b", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT p.id, unit_a, unit_b, p.status FROM p JOIN u a ON a.qualified_name = unit_a JOIN u b ON b.qualified_name = unit_b WHERE p.status = 'confirmed'")
def pairs_of_status(spark, d):
    return review.joined_pairs(_pairs(spark, d), fx.units(spark, d), status="confirmed").select("id", "unit_a", "unit_b", "status")


@query(f"WITH {_PAIRS} SELECT p.id, unit_a, unit_b, p.status FROM p JOIN u a ON a.qualified_name = unit_a JOIN u b ON b.qualified_name = unit_b WHERE a.project_id = 1 AND similarity >= 0.31::FLOAT")
def pairs_of_project(spark, d):
    return review.joined_pairs(_pairs(spark, d), fx.units(spark, d), 0.31, project_id=1).select("id", "unit_a", "unit_b", "status")


@query(f"WITH {_PAIRS}, x AS (SELECT arg_min(id, id) AS first FROM p WHERE status <> 'ignored') SELECT id, unit_a, unit_b, CASE WHEN id = first THEN 'ignored' ELSE status END AS status, true AS known FROM p, x")
def pair_ignored(spark, d):
    """A pair is ignored by its two names, given in the other order."""
    p, u = _pairs(spark, d), fx.units(spark, d)
    r = p.where("status <> 'ignored'").orderBy("id").first()
    got, known = review.ignore_pair(p, u, r["unit_b"], r["unit_a"]) if r else (p, True)
    return got.select("id", "unit_a", "unit_b", "status", F.lit(known).alias("known"))


# Commands on a store


def _store(spark, d) -> Store:
    store = Store(spark, shared_path(spark, "store"))
    store.db.replace("projects", _projects(spark, d))
    store.db.replace("code_units", fx.hashed_units(spark, d))
    return store


_SCAN = f"""{UNITS_SQL}, near AS (SELECT a.qualified_name AS q, b.qualified_name AS c, a.project_id AS pq, b.project_id AS pc, {_COS} AS s, row_number() OVER (PARTITION BY a.qualified_name ORDER BY {_COS} DESC, b.qualified_name) AS r
    FROM u a JOIN u b ON a.embedding IS NOT NULL AND b.embedding IS NOT NULL), found AS (SELECT least(q, c) AS unit_a, greatest(q, c) AS unit_b, max(s) AS s, bool_and(pq <> pc) AS x FROM near WHERE r <= 100 AND s::FLOAT >= {T}::FLOAT AND q <> c GROUP BY 1, 2)"""


@query(f"WITH {_SCAN} SELECT unit_a, unit_b, round(s::FLOAT::DOUBLE, 4) AS similarity, 'new' AS status, 'scan' AS trigger_reason, a.file_path AS file_a, b.file_path AS file_b FROM found JOIN u a ON a.qualified_name = unit_a JOIN u b ON b.qualified_name = unit_b")
def command_scan(spark, d):
    """The scan command on a store: pairs are found, stored and listed."""
    got = _store(spark, d).scan(T)
    return got.select("unit_a", "unit_b", F.round(F.col("similarity").cast("double"), 4).alias("similarity"), "status", "trigger_reason", "file_a", "file_b")


@query(f"WITH {_SCAN} SELECT unit_a, unit_b, round(s::FLOAT::DOUBLE, 4) AS similarity FROM found WHERE x")
def command_scan_cross(spark, d):
    got = _store(spark, d).scan(T, cross_only=True)
    return got.select("unit_a", "unit_b", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


@query(f"WITH {_SCAN} SELECT project_id, count(*) AS total_units, (SELECT count(*) FROM found JOIN u a ON a.qualified_name = unit_a WHERE a.project_id = v.project_id) AS new_pairs, CASE WHEN project_id = 1 THEN 1 ELSE 0 END::BIGINT AS total_groups FROM u v GROUP BY project_id")
def command_status(spark, d):
    """Scan, then make a group, then the status of all projects."""
    store = _store(spark, d)
    store.scan(T)
    store.create_group(1, "mine")
    got = store.status()
    return got.select("project_id", "total_units", F.coalesce(F.col("pairs_by_status")["new"], F.lit(0).cast("long")).alias("new_pairs"), "total_groups")


@query(f"WITH {_SCAN}, o AS (SELECT unit_a, unit_b FROM found ORDER BY unit_a, unit_b LIMIT 1) SELECT f.unit_a, f.unit_b, CASE WHEN o.unit_a IS NULL THEN 'new' ELSE 'ignored' END AS status FROM found f LEFT JOIN o ON o.unit_a = f.unit_a AND o.unit_b = f.unit_b")
def command_scan_after_ignore(spark, d):
    """A pair that was ignored stays so through a second scan; unknown pairs aren't ignored."""
    store = _store(spark, d)
    store.scan(T)
    first = store.pairs.orderBy("unit_a", "unit_b").first()
    assert store.ignore(first["unit_b"], first["unit_a"]) and not store.ignore("no", "such")
    store.scan(T)
    return store.pairs.select("unit_a", "unit_b", "status")


@query(
    """SELECT concat('rust:/ws/f', p_partkey, '.rs::S::f', p_partkey) AS qualified_name, 1 AS project_id, 'method' AS kind, 5 AS range_start, 10 AS range_end, 64 AS dims, 2 AS versions,
    sha256(concat('// Struct fields:', chr(10), 'a: u32', chr(10), chr(10), '    fn f', p_partkey, '(&self) -> u32 {', chr(10), '        // ', p_name, chr(10), '        let s = "}";', chr(10), '        let t = ', p_size, ';', chr(10), '        self.a + t', chr(10), '    }')) AS content_hash FROM part"""
)
def command_index(spark, d):
    """A project is indexed twice: its functions are extracted, hashed, embedded where that content is new, and stored once."""
    from larkspar.operators.extract import extract_functions

    store = Store(spark, shared_path(spark, "store"))
    found = extract_functions(_code_events(spark, d).select("tool_input.file_path", "tool_input.content"), 1)
    raw = at_least_lines(found.withColumn("range_start", F.col("range_start") - 1).withColumn("range_end", F.col("range_end") - 1), 3)
    store.index("one", "/ws", "rust", raw, HashingEmbedder())
    n = store.index("one", "/ws", "rust", raw, HashingEmbedder())
    assert n == store.units.count() and store.projects.count() == 1
    versions = len([v for v in store.db.versions("code_units") if v])
    return store.units.select("qualified_name", F.col("project_id").cast("int").alias("project_id"), "kind", "range_start", "range_end", F.size("embedding").alias("dims"), F.lit(versions).alias("versions"), "content_hash")


@query(f"WITH {UNITS_SQL} SELECT qualified_name, 'v1' AS version FROM u UNION ALL SELECT qualified_name, 'v2' FROM u WHERE project_id <> 1 UNION ALL SELECT '0 empty', 'v0'")
def store_versions(spark, d):
    """A table's versions: empty at first, replaced as a whole, older ones readable until they are vacuumed."""
    store = Store(spark, shared_path(spark, "store"))
    u = fx.hashed_units(spark, d)
    empty = store.units.count() == 0
    first = store.db.replace("code_units", u)
    old = store.units
    second = store.db.replace("code_units", store.units.where("project_id <> 1"))
    got = old.select("qualified_name", F.lit(f"v{first}").alias("version")).unionByName(store.units.select("qualified_name", F.lit(f"v{second}").alias("version")))
    return got.unionByName(spark.createDataFrame([("0 empty" if empty else "not empty", "v0")], "qualified_name string, version string"))


@query("SELECT a.vec_id AS q, c, r AS place, round(s, 4) AS similarity FROM embeddings a JOIN (SELECT x.vec_id AS q, y.vec_id AS c, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS r FROM embeddings x CROSS JOIN embeddings y WHERE y.label >= 3) ON q = a.vec_id WHERE r <= 4")
def store_search(spark, d):
    """A search over the store's units, narrowed before the nearest are chosen."""
    store = Store(spark, shared_path(spark, "store"))
    e = fx.table(spark, d, "embeddings")
    name = F.lpad(F.col("vec_id").cast("string"), 9, "0")
    none = F.lit(None)
    store.db.replace("code_units", e.select(name.alias("qualified_name"), F.col("label").cast("long").alias("project_id"), none.cast("string").alias("file_path"), none.cast("string").alias("kind"), none.cast("int").alias("range_start"), none.cast("int").alias("range_end"), none.cast("string").alias("content_hash"), none.cast("string").alias("structure_hash"), "embedding", none.cast("long").alias("group_id")))
    got = store.search_similar(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), 4, where="project_id >= 3")
    best = W.partitionBy("q").orderBy(F.desc("similarity"), "qualified_name")
    return got.select("q", F.col("qualified_name").cast("long").alias("c"), F.row_number().over(best).cast("long").alias("place"), F.round("similarity", 4).alias("similarity"))


# Hook answers

_FIRST_K = """ranked AS (SELECT *, row_number() OVER (PARTITION BY current_name ORDER BY s DESC, similar_name) AS k FROM near)"""


def _first_k(spark, d, scope):
    u = fx.units(spark, d).select("qualified_name", "project_id", "file_path", "range_start", "embedding")
    got = hook.similar_units(_hook_queries(spark, d), u, None, hook.HookConfig(threshold=0.0, scope=scope, max_results=1), scope_first=False)
    return got.select("current_name", "similar_name", F.round(F.col("similarity").cast("double"), 4).alias("similarity"), "is_cross_project")


def _first_k_sql(where: str) -> str:
    near = _HOOK.replace(f">= {T}::FLOAT)", ">= 0.0::FLOAT)")
    return f"WITH {near}, {_FIRST_K} SELECT current_name, similar_name, round(s::FLOAT::DOUBLE, 4) AS similarity, is_cross_project FROM (SELECT *, row_number() OVER (PARTITION BY current_name ORDER BY s DESC, similar_name) AS r FROM ranked WHERE k <= 50 AND {where}) WHERE r <= 1"


@query(_first_k_sql("NOT is_cross_project"))
def hook_lookup_first_k_project(spark, d):
    """The nearest 50 come first, then the scope: where none of them is in scope, there is no match."""
    return _first_k(spark, d, "project")


@query(_first_k_sql("is_cross_project"))
def hook_lookup_first_k_cross(spark, d):
    return _first_k(spark, d, "cross")


_BLOCK = "concat('  (', floor(s::FLOAT * 100::FLOAT)::INT, '%)', CASE WHEN is_cross_project THEN ' [跨项目]' ELSE '' END, chr(10), '  ├─ 当前: doc_', c_id, '.txt:', c_line, ' unit_', c_id, '()', chr(10), '  └─ 相似: doc_', s_id, '.txt:', s_line, ' unit_', s_id, '()', chr(10))"
_TAIL = "concat('📋 处理方式:', chr(10), '  1. 复用: import 或调用已有实现，避免重复', chr(10), '  2. 忽略: 运行 larkspar ignore \"<当前>\" \"<相似>\" 标记为合理重复', chr(10), '  3. 继续: 如果逻辑不同只是结构相似，直接继续编写')"
_REPORT = f"""WITH {UNITS_SQL}, near AS (SELECT a.doc_id AS c_id, a.range_start AS c_line, b.doc_id AS s_id, b.range_start AS s_line, b.qualified_name AS similar_name, a.project_id <> b.project_id AS is_cross_project, {_COS} AS s
    FROM u a JOIN u b ON a.qualified_name <> b.qualified_name WHERE {_COS}::FLOAT >= {T}::FLOAT),
best AS (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY s DESC, similar_name) AS r FROM near),
text AS (SELECT c_id, string_agg({_BLOCK}, chr(10) ORDER BY s::FLOAT DESC, similar_name) AS blocks FROM best WHERE r <= 3 GROUP BY c_id),
message AS (SELECT c_id, concat('⚠️ 检测到相似代码:', chr(10), blocks, chr(10), {_TAIL}) AS message FROM text)"""


def _report(spark, d):
    u = fx.units(spark, d).select("qualified_name", "project_id", "file_path", "range_start", "embedding")
    got = hook.similar_units(_hook_queries(spark, d), u, None, hook.HookConfig(threshold=T), scope_first=True)
    return hook.report(got)


@query(f"{_REPORT} SELECT c_id::VARCHAR AS event, message FROM message")
def hook_report(spark, d):
    """What is told of each unit's matches, over the table's vectors."""
    return _report(spark, d)


@query(f"{_REPORT} SELECT doc_id::VARCHAR AS event, CASE WHEN message IS NULL THEN '{{}}' ELSE to_json({{'decision': 'block', 'reason': message}})::VARCHAR END AS result FROM u LEFT JOIN message ON c_id = doc_id")
def hook_answers(spark, d):
    """Each event's answer as JSON, over the table's vectors; {} without a match."""
    events = fx.units(spark, d).select(F.col("doc_id").cast("string").alias("event"))
    return hook.results(events, _report(spark, d))


@query("SELECT doc_id::VARCHAR AS event, cwd IS NOT NULL AND cwd NOT IN ('/ws/src1', '/ws/src2') AS needs_index FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN concat('/ws/src', doc_id % 4) END AS cwd FROM documents)")
def hook_needs_index(spark, d):
    """Whether an event's folder is no known project yet."""
    events = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("event"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("/ws/src"), (F.col("doc_id") % 4).cast("string"))).alias("cwd"))
    known = spark.createDataFrame([("/ws/src1",), ("/ws/src2",)], "root_path string")
    return hook.needs_index(events, known).select("event", "needs_index")


@query("SELECT doc_id, sc AS name, floor(s::FLOAT * 100::FLOAT)::INT AS whole FROM (SELECT doc_id, lang AS sc, (doc_id % 101) / 100.0 AS s FROM documents)")
def percents(spark, d):
    """Whole per cent, multiplied in single precision."""
    return fx.table(spark, d, "documents").select("doc_id", F.col("lang").alias("name"), sc.percent_whole((F.col("doc_id") % 101) / F.lit(100.0)).alias("whole"))
