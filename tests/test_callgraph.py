import pytest

from larkspar.api import ArchitectureAnalyzer, MermaidGenerator
from larkspar.operators import callgraph as cg
from larkspar.operators import mermaid


def graph(spark, nodes, edges):
    """nodes: names; a node stands in /ws/<name>.rs, line 1. edges: pairs of names in calling order."""
    n = spark.createDataFrame([(f"/ws/{x}.rs", 1, x) for x in nodes], "file_path string, line int, name string")
    e = spark.createDataFrame([(f"/ws/{a}.rs", 1, f"/ws/{b}.rs", 1, i) for i, (a, b) in enumerate(edges)], "src_file string, src_line int, dst_file string, dst_line int, ord int")
    return n, e


def tree(spark, nodes, edges, root, **kw):
    n, e = graph(spark, nodes, edges)
    return [(r["name"], r["depth"]) for r in ArchitectureAnalyzer(n, e).get_call_tree(root, **kw).orderBy("ord").collect()]


def test_dead_code(spark):
    n, e = graph(spark, ["main", "helper", "unused", "called_from_outside"], [("main", "helper"), ("elsewhere", "called_from_outside")])
    assert [r["name"] for r in cg.dead_code(n, e).collect()] == ["unused"]


def test_tree_directions_depth_and_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a")]
    assert tree(spark, "abc", edges, "a") == [("a", 0), ("b", 1), ("c", 2)]
    assert tree(spark, "abc", edges, "a", max_depth=1) == [("a", 0), ("b", 1)]
    assert tree(spark, "abc", edges, "a", incoming=True) == [("a", 0), ("c", 1), ("b", 2)]
    assert tree(spark, "abc", edges, "nowhere") == []


def test_tree_is_depth_first_with_one_visited_set(spark):
    edges = [("root", "a"), ("root", "b"), ("a", "b"), ("b", "c")]
    assert tree(spark, ["root", "a", "b", "c"], edges, "root", max_depth=2) == [("root", 0), ("a", 1), ("b", 2)]
    n, e = graph(spark, ["root", "a", "b", "c"], edges)
    got = cg.tree_bfs(n, e, n.where("name = 'root'"), 2).collect()
    assert {(r["name"], r["depth"]) for r in got} == {("root", 0), ("a", 1), ("b", 1), ("c", 2)}


def test_unknown_callees_end_a_path(spark):
    assert tree(spark, ["a", "b"], [("a", "gone"), ("gone", "b"), ("a", "b")], "a") == [("a", 0), ("b", 1)]


def test_tree_equals_a_recursive_walk(spark):
    import random

    r = random.Random(4)
    nodes = [f"f{i}" for i in range(30)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(70)]
    calls = {}
    for a, b in edges:
        calls.setdefault(a, []).append(b)

    def walk(x, d, seen, out):
        if d > 4 or x in seen:
            return out
        seen.add(x)
        out.append((x, d))
        for y in calls.get(x, []):
            walk(y, d + 1, seen, out)
        return out

    for root in ("f0", "f7"):
        assert tree(spark, nodes, edges, root, max_depth=4) == walk(root, 0, set(), [])


def test_find_function(spark):
    n = spark.createDataFrame([("/b", 2, "x::f"), ("/a", 9, "f"), ("/a", 3, "f")], "file_path string, line int, name string")
    assert tuple(cg.find_function(n, "f").first())[:2] == ("/a", 3)
    assert cg.find_function(n.where("line = 2"), "f").count() == 1


def test_nodes_are_built_last_wins(spark):
    u = spark.createDataFrame([("rust:a::T::one", "/a", 4, 0), ("rust:a::two", "/a", 4, 1)], "qualified_name string, file_path string, selection_line int, ord int")
    assert [r["name"] for r in cg.build_nodes(u).collect()] == ["two"]


def test_degrees_count_multi_edges(spark):
    n, e = graph(spark, "ab", [("a", "b"), ("a", "b")])
    assert {r["name"]: (r["n_callers"], r["n_callees"], r["degree"]) for r in cg.degrees(n, e).collect()} == {"a": (0, 2, 2), "b": (2, 0, 2)}


def test_mermaid(spark):
    n, e = graph(spark, ["top", "mid", "leaf"], [("top", "mid"), ("mid", "leaf"), ("mid", "gone")])
    text = MermaidGenerator().generate_call_graph(ArchitectureAnalyzer(n, e))
    assert text.split("\n")[0] == "flowchart TD"
    assert "    _ws_top_rs_1[[top]]" in text and "    _ws_leaf_rs_1([leaf])" in text and "    _ws_mid_rs_1[mid]" in text
    assert "    _ws_top_rs_1 --> _ws_mid_rs_1" in text and "gone" not in text
    small = MermaidGenerator().with_max_nodes(1).generate_call_graph(ArchitectureAnalyzer(n, e))
    assert len(small.split("\n")) == 2
    assert mermaid.text(mermaid.module_diagram(n, e, "/ws"), fenced=True).startswith("```mermaid\nflowchart TD\n    leaf[leaf]")


@pytest.mark.parametrize("workspace", ["/ws", ""])
def test_module_edges(spark, workspace):
    n, e = graph(spark, "ab", [("a", "b"), ("a", "b"), ("a", "a"), ("a", "gone")])
    p = "" if workspace else "ws::"
    assert [tuple(r) for r in cg.module_edges(n, e, workspace).collect()] == [(f"{p}a", f"{p}b", 2)]
