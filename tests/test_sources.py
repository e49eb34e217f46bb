import json

import pytest

from larkspar.operators import hook
from larkspar.operators.embed import HashingEmbedder
from larkspar.operators.extract import functions_of
from larkspar.sources import events, files, symbols

RUST = """pub fn tally(stock: &[u32]) -> u32 {
    let brace = "}";
    let mut sum = 0;
    for n in stock { sum += n; }
    sum
}

struct Shelf {
    /// in metres
    width: u32,
    pub books: HashMap<String, u32>,
}

impl Shelf {
    pub fn fill(&mut self) {
        fn helper() {
            let a = 'a';
            let b = '}';
            drop((a, b));
        }
        helper();
    }
    fn tidy() {}
}

impl<T> Sorted for Shelf {
    fn order(&self) {
        let label = r#"} "top" {"#;
        // }
        /* } */
        label
    }
}
"""
SWIFT = """
func weigh() {
    var grams = 12
    grams += 1
    let unit = "g}"
    print(grams, unit)
}

class Crate {
    var owner: String = "{"
    let depth = 4

    init(depth: Int) {
        assert(depth > 0)
        print(depth)
        // }
    }

    override func unload() {
        while depth > 0 {
            break
        }
        print(owner)
    }
}
"""


def test_rust_functions():
    got = {u[0]: u for u in functions_of(RUST, "t.rs", 5)}
    assert list(got) == ["rust:t.rs::tally", "rust:t.rs::Shelf::fill", "rust:t.rs::Sorted::order"]
    assert got["rust:t.rs::tally"][2:5] == ("function", 1, 6)
    method = got["rust:t.rs::Shelf::fill"]
    assert method[2] == "method" and method[5].startswith("// Struct fields:\nwidth: u32\npub books: HashMap<String, u32>\n\n    pub fn fill")
    assert "Struct fields" not in got["rust:t.rs::Sorted::order"][5]
    assert functions_of(RUST, "t.rs", 5, strict_names=True)[0][0] == "rust::t.rs::tally"
    assert len(functions_of(RUST, "t.rs", 1)) == 4  # helper is not a unit of its own


def test_generic_type_has_no_plain_name():
    assert [u[0] for u in functions_of("impl Stack<T> {\n fn push() {\n 1\n }\n}", "a.rs", 2)] == ["rust:a.rs::push"]


def test_swift_functions():
    got = {u[0]: u for u in functions_of(SWIFT, "t.swift", 5)}
    assert list(got) == ["swift:t.swift::weigh", "swift:t.swift::Crate::init", "swift:t.swift::Crate::unload"]
    assert got["swift:t.swift::Crate::unload"][5].startswith('// Class properties:\nvar owner: String = "{"\nlet depth = 4\n\n    override func unload')


@pytest.mark.parametrize(
    ("language", "code"),
    [
        ("rust", 'a // x { \n/* b /* c */ d */ e "f\\"{" r"g\\" br#"h"##" \'{\' \'\\n\' \'\\u{1F600}\' &\'static x'), ("rust", "x /* open { "), ("rust", 'x "open {'), ("rust", 'x r##"open "# {'), ("rust", 'for"bar"'), ("rust", "\\"),
        ("swift", 'a """\n { " }\n""" b #"c " d"# "e\\"" // f'), ("swift", 'x """ open {'), ("swift", 'x ##"open "#'), ("swift", "'{'"),
    ],
)
def test_blanking_equals_a_walk_by_character(language, code):
    from larkspar.operators.extract import blanked

    def walk():
        out, i, n = list(code), 0, len(code)
        while i < n:
            j = i
            if code.startswith("//", i):
                j = (code + "\n").find("\n", i)
            elif code.startswith("/*", i):
                depth, j = 1, i + 2
                while j < n and depth:
                    depth += code.startswith("/*", j) - code.startswith("*/", j)
                    j += 2 if code.startswith(("/*", "*/"), j) else 1
            elif language == "swift" and code.startswith('"""', i):
                j = code.find('"""', i + 3) + 3 if '"""' in code[i + 3 :] else n
            else:
                k = i
                if language == "rust" and (i == 0 or not (code[i - 1].isalnum() or code[i - 1] == "_")):
                    k += 2 if code.startswith("br", i) else 1 if code.startswith("r", i) else 0
                hashes = len(code[k:]) - len(code[k:].lstrip("#"))
                if code.startswith('"', k + hashes) and (k > i if language == "rust" else hashes and (i == 0 or code[i - 1] != "#")):
                    end = '"' + "#" * hashes
                    at = code.find(end, k + hashes + 1)
                    j = n if at < 0 else at + len(end)
                elif code[i] == '"':
                    j = i + 1
                    while j < n and code[j] != '"':
                        j += 2 if code[j] == "\\" else 1
                    j += 1
                elif language == "rust" and code[i] == "'":
                    for literal in ("'{'", "'\\n'", "'\\u{1F600}'"):
                        if code.startswith(literal, i):
                            j = i + len(literal)
            for k in range(i, min(j, n)):
                out[k] = out[k] if out[k] == "\n" else " "
            i = max(j, i + 1)
        return "".join(out)

    assert blanked(code, language) == walk()


def test_other_languages_have_no_units():
    assert functions_of("def f():\n pass", "a.py", 1) == [] and functions_of("x", "a.md", 1) == []


@pytest.mark.parametrize(
    ("language", "want"),
    [("rust", ["_a.rs", "x/.b.rs"]), ("typescript", ["c.ts", "x/d.mjs"]), ("vue", ["c.ts", "v.vue", "x/d.mjs"]), ("java", [])],
)
def test_walks(tmp_path, language, want):
    for name in ("_a.rs", "x/.b.rs", "target/no.rs", "c.ts", "c.d.ts", "vite.config.ts", "x/d.mjs", "node_modules/e.js", "v.vue", "A.RS", "build/J.java"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [p[len(str(tmp_path)) + 1 :] for p in files.list_files(str(tmp_path), language)] == want
    assert files.list_files(str(tmp_path / "target"), "rust") == []


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.rs").write_bytes("fn é() {}\r\n".encode())
    assert [tuple(r) for r in files.source_files(spark, str(tmp_path), "rust").collect()] == [(str(tmp_path / "a.rs"), "fn é() {}\r\n")]
    assert files.read_store(spark, f"file://{tmp_path}").count() == 1


def test_symbol_dump(spark, tmp_path):
    rows = [
        ("/f", 1, None, 0, "Outer", "CLASS", 0, 9, 0, 0),
        ("/f", 2, 1, 1, "run(x:)", "METHOD", 1, 2, 1, 4),
        ("/f", 3, 2, 2, "local()", "FUNCTION", 1, 1, 1, 8),
        ("/f", 4, None, 3, "free()", "FUNCTION", 8, 99, 8, 0),
        ("/f", 5, 1, 4, "init(a:)", "CONSTRUCTOR", 3, 3, 3, 0),
    ]
    names = [f.name for f in symbols.SYMBOLS]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    text = spark.createDataFrame([("/f", "l0\nl1\nl2\nl3\n")], "file_path string, content string")
    dump = symbols.read_symbols(spark, f"file://{tmp_path}/s.json", "swift")
    got = {r["ord"]: r for r in symbols.functions(dump, text, "swift").collect()}
    assert {k: (r["qualified_name"], r["kind"], r["body"]) for k, r in got.items()} == {
        1: ("swift:/f::Outer::run", "method", "l1\nl2"),
        2: ("swift:/f::Outer::local", "function", "l1"),
        3: ("swift:/f::free", "function", ""),
        4: ("swift:/f::Outer::init", "init", "l3"),
    }
    java = symbols.functions(symbols.read_symbols(spark, f"file://{tmp_path}/s.json", "java"), text, "java")
    assert {(r["qualified_name"], r["kind"]) for r in java.collect()} == {("java:/f::Outer::run(x:)", "method"), ("java:/f::Outer::init(a:)", "constructor")}


def test_broken_dump_rows(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"file_path": "/f", "name": "a"}\n{broken\n')
    assert symbols.read_symbols(spark, f"file://{tmp_path}/s.json", "swift").select("name", "file_path", "kind", "ord").collect()[0][0] == "a"
    with pytest.raises(Exception, match="(?i)malformed"):
        symbols.read_symbols(spark, f"file://{tmp_path}/s.json", "rust").collect()


def test_events(spark):
    assert events.event_of(spark, "").first()["hook_event_name"] is None
    got = events.event_of(spark, '{"hook_event_name": "PostToolUse", "tool_input": {"file_path": "/a.rs", "content": "x"}, "cwd": "/p"}').first()
    assert (got["tool_input"]["file_path"], got["cwd"]) == ("/a.rs", "/p")
    with pytest.raises(ValueError, match="(?i)expecting"):
        events.event_of(spark, "{broken")


def test_config():
    c = hook.HookConfig.from_env({})
    assert (c.threshold, c.min_lines, c.scope, c.max_results, c.notify, c.model) == (0.85, 5, "all", 3, "block", "bge-m3")
    c = hook.HookConfig.from_env({"LARKSPAR_THRESHOLD": "x", "LARKSPAR_MIN_LINES": "7", "LARKSPAR_SCOPE": "odd", "LARKSPAR_NOTIFY": "user"})
    assert (c.threshold, c.min_lines, c.scope, c.notify) == (0.85, 7, "all", "user")


def hook_case(spark, **config):
    event = json.dumps({"hook_event_name": "PostToolUse", "tool_input": {"file_path": "/p/t.rs", "content": RUST}, "cwd": "/p"})
    body = functions_of(RUST, "t.rs", 5)[0][5]
    u = spark.createDataFrame([("rust:/q/o.rs::bar", 2, "/q/o.rs", 20, HashingEmbedder().embed(body)), ("rust:/p/o.rs::baz", 1, "/p/o.rs", 5, HashingEmbedder().embed(body))], "qualified_name string, project_id long, file_path string, range_start int, embedding array<float>")
    projects = spark.createDataFrame([(1, "/p")], "id long, root_path string")
    got = hook.hook_lookup(events.event_of(spark, event), u, None, projects, hook.HookConfig(threshold=0.99, **config), HashingEmbedder())
    return json.loads(got.first()["result"])


def test_hook_blocks_or_notifies(spark):
    got = hook_case(spark)
    assert set(got) == {"decision", "reason"} and got["decision"] == "block"
    assert "检测到相似代码" in got["reason"] and "100%" in got["reason"] and "o.rs:20 bar()" in got["reason"] and "[跨项目]" in got["reason"]
    assert set(hook_case(spark, notify="user")) == {"systemMessage"}
    assert "bar()" not in hook_case(spark, scope="project")["reason"] and "baz()" not in hook_case(spark, scope="cross")["reason"]


def test_hook_without_code_is_empty(spark):
    for doc in ("", "{}", '{"hook_event_name": "Other"}', '{"hook_event_name": "PostToolUse", "tool_input": {"file_path": "/a.md", "content": "x"}}', '{"hook_event_name": "PostToolUse", "tool_input": {"file_path": "/a.rs"}}'):
        u = spark.createDataFrame([], "qualified_name string, project_id long, file_path string, range_start int, embedding array<float>")
        got = hook.hook_lookup(events.event_of(spark, doc), u, None, None, hook.HookConfig(), HashingEmbedder())
        assert got.first()["result"] == "{}"


def test_report_of_one_match(spark):
    m = spark.createDataFrame([("e", "rust:test.rs::foo", "/path/to/test.rs", 10, "rust:other.rs::bar", "/path/to/other.rs", 20, 0.95, False)], "event string, current_name string, current_file string, current_line int, similar_name string, similar_file string, similar_line int, similarity float, is_cross_project boolean")
    lines = hook.report(m).first()["message"].split("\n")
    assert lines[1:5] == ["  (95%)", "  ├─ 当前: test.rs:10 foo()", "  └─ 相似: other.rs:20 bar()", ""]


def test_needs_index(spark):
    e = events.event_of(spark, '{"cwd": "/new"}').unionByName(events.event_of(spark, '{"cwd": "/p"}')).unionByName(events.event_of(spark, ""))
    projects = spark.createDataFrame([(1, "/p")], "id long, root_path string")
    assert {r["cwd"]: r["needs_index"] for r in hook.needs_index(e, projects).collect()} == {"/new": True, "/p": False, None: False}


def test_functions_of_one_folder_are_dealt_out(spark):
    e = spark.createDataFrame([(str(i), f"n{i}", "/p" if i < 90 else "/q" if i < 95 else None) for i in range(100)], "event string, qualified_name string, cwd string")
    projects = spark.createDataFrame([(1, "/p"), (2, "/r")], "id long, root_path string")
    got = hook._placed(e, projects)
    assert sorted((int(r["event"]), r["project_id"]) for r in got.collect()) == [(i, 1 if i < 90 else None) for i in range(100)]
    assert [f.name for f in got.schema] == ["cwd", "event", "qualified_name", "project_id"] and "deal" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["project_id"] for r in hook._placed(e, None).limit(1).collect()] == [None]
