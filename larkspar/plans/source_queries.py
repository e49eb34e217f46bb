"""Queries over sources: extraction of functions, symbol dumps, folders of files, event files, function names and configuration."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from larkspar.api import ArchitectureAnalyzer
from larkspar.functions import scalars as sc
from larkspar.operators import callgraph, hook
from larkspar.operators.extract import extract_functions
from larkspar.plans import fixtures as fx
from larkspar.plans.registry import query
from larkspar.sources import events, files, symbols
from larkspar.tables import shared_path

# Functions of sources


def _code(spark, d, ext: str, template: str):
    """A file for each part: the template with {k}, {size} and {name} filled in."""
    p = fx.table(spark, d, "part")
    content = F.lit(template)
    for mark, column in (("{k}", "p_partkey"), ("{size}", "p_size"), ("{name}", "p_name")):
        content = F.replace(content, F.lit(mark), F.col(column).cast("string"))
    return p.select(F.concat(F.lit("/ws/f"), F.col("p_partkey").cast("string"), F.lit(ext)).alias("file_path"), content.alias("content"))


def _text_sql(template: str) -> str:
    parts = template.replace("'", "''")
    return f"replace(replace(replace('{parts}', '{{k}}', p_partkey::VARCHAR), '{{size}}', p_size::VARCHAR), '{{name}}', p_name)"


def _units_sql(template: str, ext: str, rows: list[tuple[str, str, str, int, int, str]]) -> str:
    """The rows by hand: (language, name after the file, kind, first line, last line, what stands before the body)."""
    out = []
    for language, tail, kind, first, last, context in rows:
        body = "\n".join(template.split("\n")[first - 1 : last])
        out.append(f"SELECT concat('{language}/ws/f', p_partkey, '{ext}::', {_text_sql(tail)}) AS qualified_name, '{kind}' AS kind, {first} AS range_start, {last} AS range_end, sha256({_text_sql(context + body)}) AS body_hash FROM part")
    return " UNION ALL ".join(out)


def _extracted(spark, d, ext, template):
    got = extract_functions(_code(spark, d, ext, template), 5)
    return got.select("qualified_name", "kind", "range_start", "range_end", sc.content_hash("body").alias("body_hash"))


RUST = """pub async fn run{k}(n: u32) -> u32 {
    let open = '{';
    let raw = r#"} " {name}"#;
    /* } /* nested { */ } */
    n + {size}
}

fn tiny() {}

struct Plain{k}<T> {
    #[serde(rename = "x")]
    items: HashMap<String, Vec<(u8, T)>>,
    /// a comment, with a comma
    pub at: (u32, u32),
}

impl<T> Show for Plain{k}<T> where T: Copy {
    fn generic(&self) -> u32 {
        let s = "\\\\";
        let c = '\\'';
        {size}
    }
}

impl Plain{k} {
    #[inline]
    pub(crate) unsafe fn get(&self) -> &[u8] {
        fn inner() { 1; }
        let text = "{name} \\" }";
        // }
        text.as_bytes()
    }
}
"""
_RUST_FIELDS = "// Struct fields:\nitems: HashMap<String, Vec<(u8, T)>>\npub at: (u32, u32)\n\n"


@query(_units_sql(RUST, ".rs", [("rust:", "run{k}", "function", 1, 6, ""), ("rust:", "Show::generic", "method", 18, 22, ""), ("rust:", "Plain{k}::get", "method", 27, 32, _RUST_FIELDS)]))
def extract_rust_free(spark, d):
    """Free functions, methods of traits and of types, nested generics, attributes, and every kind of literal and comment."""
    return _extracted(spark, d, ".rs", RUST)


SWIFT = """class Shelf{k}: Base {
    var size: Int = {size}
    private let label = "}"
    lazy var twice: Int = {
        return size * 2
    }

    init(a: Int) {
        let b = a
        /* { */
        self.size = b
    }

    override func show{k}() -> String {
        // } {name}
        let t = #"a "quoted" }"#
        let u = \"\"\"
            { {name}
            \"\"\"
        return t + u
    }
}

func free{k}(x: Int) {
    let y = x + {size}
    let z = "\\\\(y) }"
    print(z)
}

extension Shelf{k} {
    subscript(i: Int) -> Int {
        let j = i
        let k = j
        return k
    }
    func small() {}
}
"""
_SWIFT_FIELDS = '// Class properties:\nvar size: Int = {size}\nprivate let label = "}"\nlazy var twice: Int = {\n        return size * 2\n    }\n\n'


@query(
    _units_sql(
        SWIFT, ".swift",
        [("swift:", "Shelf{k}::init", "method", 8, 12, _SWIFT_FIELDS), ("swift:", "Shelf{k}::show{k}", "method", 14, 21, _SWIFT_FIELDS), ("swift:", "free{k}", "function", 24, 28, ""), ("swift:", "Shelf{k}::unknown", "method", 31, 35, "")],
    )
)
def extract_swift(spark, d):
    """Methods, initialisers, subscripts, free functions and stored properties."""
    return _extracted(spark, d, ".swift", SWIFT)


# Symbol dumps

#: A file's symbols: id, parent, kind, name, first line, last line.
_TREE = (
    (1, None, None, "Type{k}", 0, 9), (2, 1, "METHOD", "go(a:b:)", 1, 3), (3, 1, "CONSTRUCTOR", "init(x:)", 4, 4), (4, 2, "FUNCTION", "local()", 2, 2), (5, None, "FUNCTION", "free", 6, 8), (6, None, "MODULE", "mod{k}", 9, 12),
    (7, 6, "METHOD", "within", 10, 99), (8, 6, "VARIABLE", "value", 9, 9),
)
_TYPES = ("CLASS", "STRUCT", "INTERFACE", "ENUM", "OBJECT")


def _dump(spark, d):
    """A dump with a tree for each customer, and the files."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    path = F.concat(F.lit("/ws/c"), F.col("k").cast("string"))
    text = F.concat(F.lit("line 0 of "), "c_name", *(F.lit(f"\nline {i}") for i in range(1, 10)), F.lit("\n"))
    kind = F.element_at(F.array(*(F.lit(t) for t in _TYPES)), (F.col("k") % len(_TYPES) + 1).cast("int"))
    rows = F.array(*(F.struct(F.lit(i).alias("symbol_id"), F.lit(p).cast("int").alias("parent_id"), (kind if t is None else F.lit(t)).alias("kind"), F.replace(F.lit(n), F.lit("{k}"), F.col("k").cast("string")).alias("name"), F.lit(a).alias("start_line"), F.lit(z).alias("end_line")) for i, p, t, n, a, z in _TREE))
    s = c.select(path.alias("file_path"), F.inline(rows)).select("file_path", "symbol_id", "parent_id", F.col("symbol_id").alias("ord"), "name", "kind", "start_line", "end_line", F.col("start_line").alias("selection_line"), F.lit(4).alias("selection_column"))
    return s, c.select(path.alias("file_path"), text.alias("content"))


def _symbols_sql(language: str) -> str:
    r = symbols.RULES[language]
    types = ", ".join(f"'{t}'" for t in _TYPES)
    parents, out = ", ".join(f"'{p}'" for p in r.parents), []
    for i, parent, kind, name, a, z in _TREE:
        if kind not in r.kinds:
            continue
        owner = "''"
        if parent in (1, 2):  # a method names no members, so what is in it belongs to the type
            owner = f"CASE WHEN type IN ({parents}) THEN concat('Type', k, '::') ELSE '' END"
        elif parent == 6:
            owner = f"CASE WHEN 'MODULE' IN ({parents}) THEN concat('mod', k, '::') ELSE '' END"
        shown = name.split("(")[0] if r.cut_signature else name
        body = "''" if z > 9 else f"array_to_string(lines[{a + 1}:{z + 1}], chr(10))"
        out.append(f"SELECT concat('{r.prefix}:/ws/c', k, '::', {owner}, '{shown}') AS qualified_name, '{r.kinds[kind]}' AS kind, {a} AS range_start, {z} AS range_end, sha256({body}) AS body_hash, {i} AS ord FROM t")
    head = f"WITH t AS (SELECT c_custkey AS k, [{types}][(c_custkey % {len(_TYPES)} + 1)::INT] AS type, list_concat([concat('line 0 of ', c_name)], list_transform(range(1, 10), lambda i: concat('line ', i))) AS lines FROM customer)"
    return f"{head} {' UNION ALL '.join(out)}"


def _symbols(language: str):
    def run(spark, d):
        dump, text = _dump(spark, d)
        path = shared_path(spark, "dump")
        dump.write.json(path)
        got = symbols.functions(symbols.read_symbols(spark, path, language), text, language)
        return got.select("qualified_name", "kind", "range_start", "range_end", sc.content_hash("body").alias("body_hash"), "ord")

    run.__doc__ = f"Functions of a {language} symbol dump, written as JSON lines and read back."
    return run


for _language in symbols.RULES:
    query(_symbols_sql(_language), f"symbols_{_language}")(_symbols(_language))


@query(
    "SELECT concat('/ws/c', c_custkey) AS file_path, line, name FROM customer, (VALUES (1, 'go(a:b:)', 0), (1, 'go(a:b:)', 1), (10, 'within', 0), (10, 'within', 1), (6, 'free', 1)) v(line, name, odd) WHERE odd = c_custkey % 2"
)
def adapter_graph(spark, d):
    """A project's functions and calls from its dumps, and what nobody calls: methods call the free function in every other file, and it calls the local one."""
    dump, text = _dump(spark, d)
    paths = [shared_path(spark, "dump"), shared_path(spark, "calls")]
    dump.write.json(paths[0])
    ends = F.array(F.struct(F.lit(1).alias("a"), F.lit(6).alias("b")), F.struct(F.lit(6).alias("a"), F.lit(2).alias("b")))
    k = F.substring("file_path", 6, 20).cast("long")
    calls = text.select("file_path", F.posexplode(ends).alias("ord", "x")).where((F.col("x.a") == 6) | (k % 2 == 0))
    calls.select(F.col("file_path").alias("src_file"), F.col("x.a").alias("src_line"), F.col("file_path").alias("dst_file"), F.col("x.b").alias("dst_line"), F.lit("x").alias("dst_name"), "ord").write.json(paths[1])
    adapter = symbols.DumpAdapter(spark, *paths, text, "typescript")
    adapter.start()
    got = ArchitectureAnalyzer.of(adapter.get_functions(), adapter.get_call_hierarchy()).find_dead_code()
    adapter.stop()
    return got


@query("SELECT concat('/ws/', l_returnflag) AS file_path, l_suppkey AS line, concat('p', arg_max(l_partkey, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000)) AS name FROM lineitem GROUP BY l_returnflag, l_suppkey")
def graph_nodes(spark, d):
    """Of the units selected at one place, the last is the node."""
    u = fx.table(spark, d, "lineitem").select(F.concat(F.lit("/ws/"), "l_returnflag").alias("file_path"), F.col("l_suppkey").alias("selection_line"), F.concat(F.lit("rust:x::T::p"), F.col("l_partkey").cast("string")).alias("qualified_name"), (F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 10_000 + F.col("l_partkey") % 10_000).alias("ord"))
    return callgraph.build_nodes(u)


# Folders

#: Files below each nation's folder, and the languages whose walk lists them.
_FILES = {
    "a.rs": "rust", "deep/er/.hidden.rs": "rust", "target/no.rs": "", "B.RS": "", "c.swift": "swift", "Pods/no.swift": "", "build/no.swift": "", "d.ts": "typescript vue", "d.d.ts": "", "vite.config.js": "", "e.tsx": "typescript vue",
    "node_modules/no.js": "", ".output/f.mjs": "typescript", "g.vue": "vue", "h.java": "java", "bin/no.java": "", "src/main/i.java": "java", "noextension": "", ".rs": "",
}
_FILES_SQL = ", ".join(f"('{f}', '{x}')" for f, langs in _FILES.items() for x in langs.split())


def _walked(spark, d):
    base = urlparse(shared_path(spark, "sources"))
    if base.scheme not in ("", "file"):
        raise RuntimeError("folders are walked on a file system that is mounted everywhere")
    for r in fx.table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # 25 folders
        for f in _FILES:
            path = os.path.join(base.path, str(r["n_nationkey"]), f)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as out:
                out.write(f"{r['n_name']} é\r\n{f}")
    return base.path


@query(f"WITH f(file, language) AS (VALUES {_FILES_SQL}) SELECT language, concat(n_nationkey, '/', file) AS path, sha256(concat(n_name, ' é', chr(13), chr(10), file)) AS content_hash FROM nation, f")
def source_walks(spark, d):
    """Each language's files below a folder, read whole."""
    root = _walked(spark, d)
    got = None
    for language in files.WALKS:
        x = files.source_files(spark, root, language).select(F.lit(language).alias("language"), sc.relative_path("file_path", root).alias("path"), sc.content_hash("content").alias("content_hash"))
        got = x if got is None else got.unionByName(x)
    return got


# Events, names, configuration


@query("SELECT 'PostToolUse' AS hook_event_name, 'Write' AS tool_name, concat('/ws/f', p_partkey, '.rs') AS file_path, sha256(concat(p_name, chr(10), '\"é\"')) AS content_hash, CASE WHEN p_partkey % 2 = 0 THEN '/ws/src1' END AS cwd, 64 AS event_length FROM part")
def events_read(spark, d):
    """Hook events written as JSON lines and read back."""
    p = fx.table(spark, d, "part")
    e = p.select(F.lit("PostToolUse").alias("hook_event_name"), F.lit("Write").alias("tool_name"), F.struct(F.concat(F.lit("/ws/f"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("file_path"), F.concat("p_name", F.lit('\n"é"')).alias("content")).alias("tool_input"), F.when(F.col("p_partkey") % 2 == 0, "/ws/src1").alias("cwd"))
    path = shared_path(spark, "events")
    e.write.json(path)
    got = events.read_events(spark, path)
    return got.select("hook_event_name", "tool_name", "tool_input.file_path", sc.content_hash("tool_input.content").alias("content_hash"), "cwd", F.length("event").alias("event_length"))


@query("SELECT doc_id, concat('swift:', source, '::', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('P', doc_id % 3, '::') END, lang) AS full_name, concat('rust:', source, '::', lang) AS free_name, concat(repeat('  ', doc_id % 4), lang) AS indented, CASE WHEN doc_id % 5 = 0 THEN 'ignored' WHEN doc_id % 5 = 1 THEN 'confirmed' ELSE 'new' END AS status FROM documents")
def unit_names(spark, d):
    """Names of units with and without an owner, indentation, and stored statuses (unknown ones read as new)."""
    doc = fx.table(spark, d, "documents")
    owner = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("P"), (F.col("doc_id") % 3).cast("string")))
    status = F.element_at(F.array(*(F.lit(x) for x in ("ignored", "confirmed", "new", "Ignored", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return doc.select("doc_id", sc.unit_name("swift", "source", owner, "lang").alias("full_name"), sc.unit_name("rust", "source", None, "lang").alias("free_name"), F.concat(sc.indent((F.col("doc_id") % 4).cast("int")), "lang").alias("indented"), sc.pair_status(status).alias("status"))


_ENVIRONMENTS = {
    "none": {}, "all": {"THRESHOLD": "0.5", "MIN_LINES": "9", "SCOPE": "cross", "MAX_RESULTS": "7", "NOTIFY": "user", "MODEL": "m"}, "broken": {"THRESHOLD": "high", "MIN_LINES": "", "SCOPE": "galaxy", "MAX_RESULTS": "x", "NOTIFY": "shout"}, "project": {"SCOPE": "project", "THRESHOLD": "1"},
}


@query("SELECT * FROM (VALUES ('none', 0.85, 5, 'all', 3, 'block', 'bge-m3'), ('all', 0.5, 9, 'cross', 7, 'user', 'm'), ('broken', 0.85, 5, 'all', 3, 'block', 'bge-m3'), ('project', 1.0, 5, 'project', 3, 'block', 'bge-m3')) t(name, threshold, min_lines, scope, max_results, notify, model)")
def hook_config(spark, d):
    """The hook's settings from environments: defaults, all set, all broken."""
    rows = []
    for name, env in _ENVIRONMENTS.items():
        c = hook.HookConfig.from_env({f"LARKSPAR_{k}": v for k, v in env.items()})
        rows.append((name, c.threshold, c.min_lines, c.scope, c.max_results, c.notify, c.model))
    return spark.createDataFrame(rows, "name string, threshold double, min_lines int, scope string, max_results int, notify string, model string")
