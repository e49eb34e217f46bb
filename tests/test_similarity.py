import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.api import Scanner
from larkspar.operators import similarity as s


def vectors(spark, m, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, v array<float>")


def exact(m, t):
    u = np.array(m, np.float32).astype(float)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, n, out=np.zeros_like(u), where=n > 0)
    c = u @ u.T
    return {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if np.float32(c[i, j]) >= np.float32(t)}


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("t", [0.3, 0.9])
def test_self_join_both_ways(spark, broadcast, t):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    m = np.concatenate([centres[r.integers(0, 12, 150)] + r.normal(size=(150, 16)) * 0.3, np.zeros((1, 16))])
    got = s.self_join(vectors(spark, m), t, broadcast_bytes=broadcast, pivots=8)
    assert {(x["a"], x["b"]) for x in got.collect()} == exact(m, t)


def test_catalyst_join_equals_block_join(spark):
    m = np.random.default_rng(2).normal(size=(60, 8))
    a = {(x["a"], x["b"], round(x["similarity"], 9)) for x in s.self_join(vectors(spark, m), 0.2).collect()}
    assert a == {(x["a"], x["b"], round(x["similarity"], 9)) for x in s.catalyst_self_join(vectors(spark, m), 0.2).collect()}


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_knn(spark, broadcast):
    v = vectors(spark, [[1, 0, 0, 0], [0.9, 0.1, 0, 0], [0, 1, 0, 0]], "c")
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0])], "q long, v array<float>")
    got = s.block_join(q, v, k=2, broadcast_bytes=broadcast, block_bytes=64).orderBy(F.desc("similarity")).collect()
    assert [r["c"] for r in got] == [0, 1]


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_knn_equals_brute_force_with_ties(spark, broadcast):
    r = np.random.default_rng(3)
    m = r.integers(-1, 2, size=(80, 4)).astype(float)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    v = vectors(spark, m)
    got = s.block_join(v.select(F.col("id").alias("q"), "v"), v.select(F.col("id").alias("c"), "v"), k=5, broadcast_bytes=broadcast, block_bytes=512)
    found = {}
    for x in got.collect():
        found.setdefault(x["q"], []).append(x["similarity"])
    for i in range(80):
        assert sorted(found[i], reverse=True) == pytest.approx(sorted(u @ u[i], reverse=True)[:5])


def test_dimensions_must_agree(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "c long, v array<float>")
    with pytest.raises(Exception, match="different dimensions"):
        s.block_join(v.withColumnRenamed("c", "q"), v, 0.1).collect()


def test_null_and_empty(spark):
    none = spark.createDataFrame([(1, None)], "c long, v array<float>")
    assert s.block_join(none.withColumnRenamed("c", "q"), none, 0.1).count() == 0


def units(spark, rows):
    return spark.createDataFrame(rows, "qualified_name string, project_id long, embedding array<float>")


def test_scan_takes_k_before_its_filters(spark):
    u = units(spark, [("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.01]), ("c", 2, [1.0, 0.1])])
    assert {tuple(r)[:2] for r in s.scan_pairs(u, 0.9, k=2).collect()} == {("a", "b"), ("b", "c")}
    assert s.scan_pairs(u, 0.9, k=2, cross_only=True).select("unit_a", "unit_b").collect() == [("b", "c")]


def test_scan_keeps_hits_outside_the_selection(spark):
    u = units(spark, [("a", 1, [1.0, 0.0]), ("z", 9, [1.0, 0.0])])
    chosen = u.where("project_id = 1")
    assert s.scan_pairs(u, 0.9, selected=chosen, cross_only=True).select("unit_a", "unit_b").collect() == [("a", "z")]


def test_compare(spark):
    a, b = units(spark, [("q", 1, [1.0, 0.0])]), units(spark, [("c", 2, [1.0, 0.0]), ("d", 2, [0.0, 1.0])])
    assert s.compare(a, b).select("unit_a", "unit_b").collect() == [("c", "q")]


def test_approximate_join_recalls(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 32))
    m = np.concatenate([base, base + r.normal(size=(40, 32)) * 0.05])
    want = exact(m, 0.95)
    got = {(x["a"], x["b"]) for x in s.approximate_self_join(vectors(spark, m), 0.95).collect()}
    assert got <= want and len(got) >= 0.8 * len(want)


def test_scanner(spark):
    u = spark.createDataFrame([("b", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("c", 2, [0.0, 1.0])], "qualified_name string, pos int, embedding array<float>")
    got = Scanner().with_threshold(0.5).scan_similarities(u).collect()
    assert [(r["unit_a"], r["unit_b"]) for r in got] == [("b", "a")]
    raw = spark.createDataFrame([("x", 0, 2), ("y", 0, 3)], "qualified_name string, range_start int, range_end int")
    assert [r[0] for r in Scanner().index_project(raw).select("qualified_name").collect()] == ["y"]


def test_approximate_scan_recalls(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 32))
    m = centres[r.integers(0, 30, 240)] + r.normal(size=(240, 32)) * 0.2
    u = vectors(spark, m, "qualified_name").select(F.col("qualified_name").cast("string"), (F.col("qualified_name") % 3).alias("project_id"), F.col("v").alias("embedding"))
    want = {tuple(x) for x in s.scan_pairs(u, 0.8, 240).select("unit_a", "unit_b").collect()}
    got = {tuple(x) for x in s.scan_pairs(u, 0.8, approximate=True).select("unit_a", "unit_b").collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want
    cross = {tuple(x) for x in s.scan_pairs(u, 0.8, cross_only=True, approximate=True).select("unit_a", "unit_b").collect()}
    assert cross == {(a, b) for a, b in got if int(a) % 3 != int(b) % 3}


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
@pytest.mark.parametrize("same", [True, False])
def test_groups_count_before_the_nearest_are_chosen(spark, broadcast, same, monkeypatch):
    monkeypatch.setattr(s, "_COLUMNS", 7)
    monkeypatch.setattr(s, "_ROWS", 5)
    r = np.random.default_rng(6)
    m = r.normal(size=(60, 6))
    g = [None if i % 11 == 0 else i % 4 for i in range(60)]
    v = spark.createDataFrame([(i, [float(x) for x in m[i]], g[i]) for i in range(60)], "id long, v array<float>, g long")
    got = {}
    for x in s.block_join(v.withColumnRenamed("id", "q"), v.withColumnRenamed("id", "c"), 0.0, 3, broadcast_bytes=broadcast, block_bytes=512, same=same).collect():
        got.setdefault(x["q"], set()).add(x["c"])
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(60):
        open_to = [j for j in range(60) if g[i] is None or (g[i] == g[j]) == same]
        want = sorted((j for j in open_to if u[i] @ u[j] >= 0), key=lambda j: -(u[i] @ u[j]))[:3]
        assert got.get(i, set()) == set(want)


@pytest.mark.parametrize("crowded", [64, 2])
@pytest.mark.parametrize("same", [None, True, False])
def test_equal_vectors_settle_queries_and_the_rest_meet_in_blocks(spark, same, crowded, monkeypatch):
    """Copies, scaled copies, near ones, zero vectors and vectors of their own, beyond the broadcast, against all pairs; a crowded of 2 leaves most queries to the blocks."""
    monkeypatch.setattr(s, "CROWDED", crowded)
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 6)).astype(np.float32)
    m = np.concatenate([base, base[:8], base[:6] * 4, base[:5], base[:4] + np.float32(0.01), np.zeros((2, 6), np.float32)]).astype(np.float32)
    g = [None if i % 7 == 0 else i % 3 for i in range(len(m))]
    v = spark.createDataFrame([(i, [float(x) for x in m[i]], g[i]) for i in range(len(m))], "id long, v array<float>, g long")
    got = {}
    for x in s.block_join(v.withColumnRenamed("id", "q"), v.withColumnRenamed("id", "c"), 0.7, 2, broadcast_bytes=0, block_bytes=512, same=same, apart=F.col("q") != F.col("c")).collect():
        got.setdefault(x["q"], []).append((-x["similarity"], x["c"]))
    u = s._unit(m)
    for i in range(len(m)):
        open_to = [j for j in range(len(m)) if j != i and (same is None or g[i] is None or (g[i] == g[j]) == same)]
        near = [(-np.einsum("i,i", u[i], u[j]), j) for j in open_to]
        want = sorted((round(x, 12), j) for x, j in near if -x >= 0.7)[:2]
        assert sorted((round(x, 12), j) for x, j in got.get(i, [])) == want


def test_settled_queries_meet_no_blocks(spark):
    m = np.random.default_rng(9).normal(size=(40, 16))
    v = vectors(spark, m)
    q, c = v.withColumnRenamed("id", "q"), v.withColumnRenamed("id", "c")
    got = s.block_join(q, c, 0.85, 1, broadcast_bytes=0, block_bytes=512)
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["q"], x["c"]) for x in got.collect()) == [(i, i) for i in range(40)]
    left, _ = s._settled(q, c.where("c < 30"), 0.85, 1, None, None)
    assert sorted(x["q"] for x in left.collect()) == list(range(30, 40))


def test_lengths_must_agree_beyond_the_broadcast(spark):
    q, c = spark.createDataFrame([(1, [1.0])], "q long, v array<float>"), spark.createDataFrame([(1, [1.0, 2.0])], "c long, v array<float>")
    with pytest.raises(Exception, match="different dimensions"):
        s.block_join(q, c, 0.1, 1, broadcast_bytes=0).collect()
