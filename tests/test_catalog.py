import pytest
from pyspark.sql import functions as F

from larkspar import schemas
from larkspar.api import Store
from larkspar.operators import catalog as c
from larkspar.operators import review
from larkspar.operators.embed import HashingEmbedder, with_embeddings
from larkspar.tables import clear, number_rows, written


def unit(name, project=1, body="h", structure="s", embedding=None, group=None, path="/f.rs"):
    return (name, project, path, "function", 1, 9, body, structure, embedding, group)


def units(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CODE_UNITS)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SIMILAR_PAIRS)


def test_unit_upsert_keeps_project_group_and_vector(spark):
    old = units(spark, unit("a", 1, "h1", "s1", [1.0], 7), unit("b", 1))
    new = units(spark, unit("a", 2, "h2", "s2", None, 8), unit("c", 3))
    got = {r["qualified_name"]: r for r in c.upsert_units(old, new).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["project_id"], got["a"]["content_hash"], got["a"]["embedding"], got["a"]["group_id"]) == (1, "h2", [1.0], 7)
    assert got["c"]["project_id"] == 3


def test_unit_upsert_takes_the_last_of_equal_names(spark):
    new = units(spark, unit("a", body="first"), unit("a", body="last")).withColumn("seq", F.monotonically_increasing_id())
    assert [r["content_hash"] for r in c.upsert_units(units(spark), new, "seq").collect()] == ["last"]


def test_group_is_inherited_by_structure(spark):
    old = units(spark, unit("a", structure="s", group=5), unit("b", structure="s", group=6))
    new = units(spark, unit("x", structure="s"), unit("a", structure="s"), unit("y", structure="t", group=9))
    got = {r[0]: r[1] for r in c.with_inherited_group(new, old).select("qualified_name", "group_id").collect()}
    assert got == {"x": 5, "a": 6, "y": 9}


def test_cached_embeddings_and_embedder(spark):
    old = units(spark, unit("a", body="h1", embedding=[1.0, 0.0]), unit("b", body="h2"))
    rows = spark.createDataFrame([("n1", "h1", "one"), ("n2", "h2", "two words"), ("n3", "h2", "two words")], "qualified_name string, content_hash string, body string")
    got = {r[0]: r[1] for r in with_embeddings(rows, old, HashingEmbedder(2)).select("qualified_name", "embedding").collect()}
    assert got["n1"] == [1.0, 0.0] and got["n2"] == got["n3"] and len(got["n2"]) == 2


def test_pair_upsert_is_order_independent_and_keeps_status(spark):
    p = pairs(spark, (4, "a", "b", 0.5, "confirmed", "scan"))
    new = spark.createDataFrame([("b", "a", 0.95), ("d", "c", 0.7)], "unit_a string, unit_b string, similarity float")
    got = {r["unit_a"]: r for r in c.upsert_pairs(p, new, None).collect()}
    assert (got["a"]["id"], got["a"]["status"], got["a"]["trigger_reason"]) == (4, "confirmed", None)
    assert got["a"]["similarity"] == pytest.approx(0.95)
    assert (got["c"]["id"], got["c"]["unit_b"], got["c"]["status"]) == (5, "d", "new")
    again = c.upsert_pairs(pairs(spark), spark.createDataFrame([("b", "a", 0.9, 1), ("a", "b", 0.8, 2)], "unit_a string, unit_b string, similarity float, seq int"), "hook", "seq")
    assert [(r["unit_a"], round(r["similarity"], 3)) for r in again.collect()] == [("a", 0.8)]


def test_pair_status_delete_and_ignore(spark):
    p = pairs(spark, (1, "a", "b", 0.9, "new", None), (2, "b", "c", 0.8, "new", None))
    u = units(spark, unit("a"), unit("b"))
    assert [r["status"] for r in c.set_pair_status(p, [2], "redundant").orderBy("id").collect()] == ["new", "redundant"]
    with pytest.raises(ValueError, match="unknown status"):
        c.set_pair_status(p, [1], "odd")
    assert [r["id"] for r in c.delete_pairs_of(p, "a").collect()] == [2]
    changed, found = review.ignore_pair(p, u, "b", "a")
    assert found and changed.where("id = 1").first()["status"] == "ignored"
    assert review.ignore_pair(p, u, "b", "c")[1] is False  # c is no unit, so the joined pair is gone
    m = spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string")
    assert review.without_ignored(m, changed, "x", "y").collect() == [("c", "b")]


def test_stats_leave_out_absent_statuses(spark):
    u = units(spark, unit("a"), unit("b"), unit("c", 2))
    p = pairs(spark, (1, "a", "b", 0.9, "new", None))
    projects = spark.createDataFrame([(1, "p", "/p", "rust", None), (2, "q", "/q", "rust", None)], schemas.PROJECTS)
    groups, new_id = c.add_group(spark.createDataFrame([], schemas.GROUPS), 1, "g")
    got = {r["project_id"]: r.asDict() for r in review.project_stats(projects, u, p, groups).collect()}
    assert new_id == 1
    assert got[1] == {"project_id": 1, "total_units": 2, "pairs_by_status": {"new": 1}, "total_groups": 1}
    assert got[2] == {"project_id": 2, "total_units": 1, "pairs_by_status": {}, "total_groups": 0}


def test_empty_id_list_selects_nothing(spark):
    u = units(spark, unit("a"), unit("b", 2))
    assert (c.units_of_projects(u, None).count(), c.units_of_projects(u, []).count(), c.units_of_projects(u, [2]).count()) == (2, 0, 1)
    assert c.delete_units_of_file(u, "/f.rs").count() == 0 and c.units_of_file(u, "/f.rs").count() == 2 and c.unit(u, "a").count() == 1


def test_numbers_are_gapless(spark):
    got = number_rows(spark.range(1000).selectExpr("id * 7 % 1000 AS k"), ["k"], "n", 5).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))


def test_store_end_to_end(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    raw = [(f"rust:/p/a.rs::f{i}", "/p/a.rs", "function", i * 10, i * 10 + 5, body, i * 10, 0) for i, body in enumerate(["let a = one two three", "let a = one two three", "quite other words here"])]
    df = spark.createDataFrame(raw, schemas.RAW_UNIT)
    assert store.index("p", "/p", "rust", df, HashingEmbedder()) == 3
    assert store.index("p", "/p", "rust", df.limit(0), HashingEmbedder()) == 0
    assert store.projects.count() == 1 and store.projects.first()["last_indexed_at"] is not None
    got = store.scan(0.99)
    assert [(r["unit_a"], r["unit_b"], r["trigger_reason"]) for r in got.collect()] == [("rust:/p/a.rs::f0", "rust:/p/a.rs::f1", "scan")]
    assert store.scan(0.99, cross_only=True, project_ids=[1]).count() == 1  # one project: nothing is filtered from the list
    assert store.ignore("rust:/p/a.rs::f1", "rust:/p/a.rs::f0") is True
    assert store.list_pairs(status="ignored").count() == 1 and store.list_pairs(status="new").count() == 0
    g = store.create_group(1, "handlers")
    assert store.add_to_group(g, ["rust:/p/a.rs::f0", "nowhere"]) == ["nowhere"]
    assert [r["qualified_name"] for r in store.group_members(g).collect()] == ["rust:/p/a.rs::f0"]
    assert store.list_groups().count() == store.list_groups(1).count() == 1
    status = store.status().first()
    assert (status["total_units"], status["pairs_by_status"], status["total_groups"]) == (3, {"ignored": 1}, 1)
    q = store.units.where("qualified_name like '%f2'").select(F.lit(1).alias("q"), F.col("embedding").alias("v"))
    assert store.search_similar(q, 1).first()["qualified_name"] == "rust:/p/a.rs::f2"
    assert store.search_similar(q, 1, where="qualified_name not like '%f2'").first()["qualified_name"] != "rust:/p/a.rs::f2"
    store.db.vacuum("code_units", 1)
    assert len(store.db.versions("code_units")) == 1


def test_clear_deletes_what_was_written(spark):
    from pathlib import Path

    df = written(spark.range(3).toDF("x"), "gone")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and df.count() == 3
    clear(spark)
    assert not folder.exists()
