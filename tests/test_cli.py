import io
import json

import pytest

from larkspar.cli import main

CODE = "fn alpha() {\n    let a = 1;\n    let b = 2;\n    beta();\n}\n\nfn beta() {\n    let a = 1;\n    let b = 2;\n    let c = 3;\n}\n\nfn gamma() {\n    let a = 1;\n    let b = 2;\n    let c = 3;\n}\n"


@pytest.fixture
def project(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.rs").write_text(CODE)
    f = str(tmp_path / "p" / "a.rs")
    calls = [{"src_file": f, "src_line": 1, "dst_file": f, "dst_line": 7, "dst_name": "beta", "ord": 0}]
    (tmp_path / "calls.json").write_text("\n".join(map(json.dumps, calls)))
    return tmp_path


def run(spark, capsys, project, *argv):
    capsys.readouterr()
    main(["--root", f"file://{project}/db", *argv], spark)
    return capsys.readouterr().out


def test_similarity_commands(spark, capsys, project, monkeypatch):
    p = str(project / "p")
    assert run(spark, capsys, project, "index", p) == "Indexed 3 functions\n"
    out = run(spark, capsys, project, "scan", "--threshold", "0.7")
    assert "A: a.rs:6 beta" in out and "B: a.rs:12 gamma" in out
    assert "beta (a.rs) <-> gamma (a.rs)" in run(spark, capsys, project, "pairs", "--threshold", "0.7")
    assert "3 units" in run(spark, capsys, project, "status") and p in run(spark, capsys, project, "projects")
    assert run(spark, capsys, project, "ignore", f"rust:{p}/a.rs::gamma", f"rust:{p}/a.rs::beta") == "Ignored\n"
    assert run(spark, capsys, project, "ignore", "x", "y") == "No such pair\n"
    assert run(spark, capsys, project, "group", "create", "1", "twins") == "Group 1\n"
    run(spark, capsys, project, "group", "add", "1", f"rust:{p}/a.rs::beta")
    assert "twins" in run(spark, capsys, project, "group", "list") and "beta" in run(spark, capsys, project, "group", "members", "1")
    out = run(spark, capsys, project, "compare", p, p, "--lang-a", "rust", "--lang-b", "rust")
    assert "100.00%" in out
    event = {"hook_event_name": "PostToolUse", "tool_input": {"file_path": "/new.rs", "content": CODE.replace("gamma", "delta")}, "cwd": p}
    monkeypatch.setenv("LARKSPAR_MIN_LINES", "4")
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(event)))
    assert json.loads(run(spark, capsys, project, "hook"))["decision"] == "block"


def test_graph_commands(spark, capsys, project):
    args = [str(project / "p"), "--calls", f"file://{project}/calls.json"]
    dead = json.loads(run(spark, capsys, project, "dead-code", *args, "--json"))
    assert [(d["name"], d["line"]) for d in dead] == [("alpha", 1), ("gamma", 13)]
    assert "  a.rs:13\n    gamma" in run(spark, capsys, project, "dead-code", *args)
    assert run(spark, capsys, project, "call-tree", *args, "alpha") == "alpha\n  beta\n"
    assert json.loads(run(spark, capsys, project, "call-tree", *args, "beta", "--direction", "incoming", "--json")) == [{"name": "beta", "depth": 0}, {"name": "alpha", "depth": 1}]
    assert run(spark, capsys, project, "diagram", *args).startswith("flowchart TD\n")
    run(spark, capsys, project, "diagram", *args, "--type", "module", "--output", str(project / "m.md"))
    assert (project / "m.md").read_text() == "```mermaid\nflowchart TD\n    a[a]\n```\n"
