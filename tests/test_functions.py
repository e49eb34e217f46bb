import math

import pytest
from pyspark.sql import functions as F

from larkspar.functions import scalars as sc
from larkspar.functions.vectors import bytes_to_embedding, cosine, embedding_to_bytes


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""]), ("a", ["a"])],
)
def test_lines(spark, text, want):
    assert one(spark, sc.lines("t"), t=text) == want


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("fn f() { x } // note", "fn f() { x }"),
        ("fn f() { /* a\nb */ x }", "fn f() {  x }"),
        ("fn  f()\t{\n x }", "fn f() { x }"),
        ('let s = "one";', 'let s = "two";'),
        ("let n = 1.5;", "let n = 22;"),
    ],
)
def test_normalised_hash_ignores(spark, a, b):
    assert one(spark, sc.normalized_hash("t"), t=a) == one(spark, sc.normalized_hash("t"), t=b)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ('a "x\\"y" b', 'a "$STR" b'),
        ('a "open', 'a "$STR"'),
        ("x1 = 3.14.15", "x$NUM = $NUM"),
        ("a /* open", "a /* open"),
        ("a /*/ b", "a b"),
        ('u = "http://x"', 'u = "$STR"'),
        ("a  b", "a b"),
    ],
)
def test_normalize_code(spark, code, want):
    assert one(spark, sc.normalize_code("t"), t=code) == want


def test_structure_hash_trims_every_white_space(spark):
    assert one(spark, sc.structure_text("t"), t="\t a \n\n// c\n  // d\n b \n") == "a\nb"
    assert len(one(spark, sc.structure_hash("t"), t="a")) == 64
    assert len(one(spark, sc.short_content_hash("t"), t="a")) == 16


@pytest.mark.parametrize(("name", "want"), [("a:::b", ":b"), ("a::b::c", "c"), ("a", "a"), ("a::", "")])
def test_short_name(spark, name, want):
    assert one(spark, sc.short_name("n"), n=name) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [("rust:/a/b.rs::T::f", "T::f (b.rs)"), ("swift:swift:rust:x::f", "f (x)"), ("rust:swift:x::f", "f (swift:x)"), ("plain", "plain")],
)
def test_format_name(spark, name, want):
    assert one(spark, sc.format_name("n"), n=name) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("/ws/src/lib.rs", "src::lib"), ("/ws/.hidden", ".hidden"), ("/other/a.b/c", "other::a.b::c"), ("/wsx/a.rs", "x::a"), ("/ws/a.tar.gz", "a.tar")],
)
def test_module_of(spark, path, want):
    assert one(spark, sc.module_of("p", "/ws"), p=path) == want


def test_node_id(spark):
    assert one(spark, sc.node_id("n"), n="a::b/c.d-e") == "a_b_c_d_e"


@pytest.mark.parametrize(("path", "want"), [("foo.RS", "rust"), ("a/b.tsx", "typescript"), ("readme.md", None), ("a.rs/x", None), (".rs", None), ("noext", None)])
def test_language_of(spark, path, want):
    assert one(spark, sc.language_of("p"), p=path) == want
    assert one(spark, sc.is_code_file("p"), p=path) == (want is not None)


@pytest.mark.parametrize(("name", "want"), [("main", True), ("Renew", True), ("truncate", True), ("prune_x", True), ("helper", False), ("a_TEST", True), ("test", False)])
def test_entry_points_are_substrings(spark, name, want):
    assert one(spark, sc.is_entry_point("n"), n=name) is want


def test_percent_is_single_precision(spark):
    assert one(spark, sc.percent_whole("s"), s=0.95) == 95
    assert one(spark, sc.percent_text("s"), s=0.9) == "90.00%"


def test_threshold_is_single_precision_and_nan_is_below(spark):
    assert one(spark, sc.at_least("s", 0.95), s=0.95) is True
    assert one(spark, sc.at_least("s", 0.0), s=math.nan) is False


def test_pairs_are_ordered_by_bytes(spark):
    a, b = sc.pair_key("a", "b")
    assert one(spark, F.array(a, b), a="\U0001f600", b="�") == ["�", "\U0001f600"]


def test_unknown_status_reads_as_new(spark):
    assert one(spark, sc.pair_status("s"), s="odd") == "new"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 1.0], 0)],
)
def test_cosine(spark, a, b, want):
    assert one(spark, cosine("a", "b"), a=a, b=b) == pytest.approx(want)


def test_cosine_of_close_vectors(spark):
    assert one(spark, cosine("a", "b"), a=[1.0, 2.0, 3.0], b=[1.1, 2.1, 3.1]) > 0.99


def test_vector_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(bytes_to_embedding("b")).collect()] == [None, [], None]
    v = spark.createDataFrame([([1.0, 2.5, -3.140000104904175, 0.0],)], "v array<float>")
    assert v.select(bytes_to_embedding(embedding_to_bytes("v"))).first()[0] == [1.0, 2.5, -3.140000104904175, 0.0]
