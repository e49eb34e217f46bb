"""SimHash near-duplicates by multi-index hashing (op2).

Fingerprints: 64 bits from the XXH64 (seed 42) of a text's 3-word shingles. Links: pairs of fingerprints that differ in at most two bits. A fingerprint has two
32-bit segments; of a linked pair, one segment differs in at most one bit. So each distinct fingerprint probes, for either segment, the 33 values of the
Hamming ball of radius 1 in a table keyed by segment value, and complete distances verify what it fetches.

A segment value that more than HEAVY distinct fingerprints share (boilerplate, large groups of near copies) would return all pairs of its bucket. Such buckets
are left to an exact way instead: each fingerprint that reaches one lists the 65 words within one bit of itself, and fingerprints that list the same word are
linked to the least of them. Two fingerprints list a common word exactly if they differ in at most two bits, and no word is listed by more than 65 of them, so
this loses no link and makes no invalid one (any two listers of a word are within two bits of each other).

Equal texts have equal fingerprints and meet once, in the aggregate over fingerprints; only rows of ids and fingerprints are shuffled, never texts.

Nulls and texts without a word have fingerprint zero and are linked like any other. A null doc_id is larger than every other; a component of nulls only has a
null id. Repeated rows are kept. An empty table gives an empty result. Other columns are ignored, or passed through by dedup().

dedup_similar() takes another law, for texts that say nearly the same: Jaccard similarity of their sets of five-word shingles, 0.8 or more. Fingerprints of shingles differ in about 10 of 64
bits there, out of reach of small balls, so candidates come from fingerprints of 256 bits of a text's different words: eight 32-bit segments, balls of radius 1. Complete distances of these
and of fingerprints of 256 bits of the shingles drop most of the others, and the shingles themselves, read again from the texts that are left, decide. Of crowded segment values, a few partners of each text
are tried first; then all links that these have not joined are found by what the texts of a crowd differ in (see crowded_links()), so crowding loses no link. Texts of equal words are one text. Odd rows are as above; texts of under five words are near only where they are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.llm.common import Kept, keep, map_texts, raw, table
from larkspar.llm.graph import components
from larkspar.llm.parts import Parts, attach

SHINGLE, BITS, HEAVY, SEED = 3, 2, 64, 42
#: Fingerprints a task expands into probes, at most.
A_TASK = 1 << 16
#: Texts that make a segment value crowded when there are more; those of it that each of them meets beside the least one; bits of 256 in which near texts' fingerprints of
#: words and of shingles may differ (at a similarity of 0.8, those of shingles differ in 39 with a standard deviation of 6); multipliers that make four numbers of a word's hash.
CROWD, NEAR, WIDE_BITS, SHINGLE_BITS = 16, 2, 72, 64
#: Texts of a crowd that its centre is taken from, about.
CENTRE = 64
#: Texts and bytes of shingles in a block, about.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 16 << 20
_MIX = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]], np.uint64)
_TURN = np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned integer."""
    words = text.lower().split()  # of bytes: A-Z and ASCII whitespace only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 16_384):
        part = np.unpackbits(h[i : i + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t, shingle) for t in raw(b)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], [*b.schema.names[:-1], "f"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *ids: Column) -> DataFrame:
    """(doc_id, ids, f) for each row of docs; f is the fingerprint as a signed long."""
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *ids, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields[:-1])
    return map_texts(got, lambda batches: _fingerprints(batches, shingle), f"{schema}, f long")


def _segments(f: str) -> list:
    """Both segments of f, each with its number in bit 32."""
    return [F.col(f).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f, 32).bitwiseOR(F.lit(1 << 32))]


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) between distinct fingerprints in column f, whose components are those of all links of at most two differing bits."""
    distinct = fps.select("f").distinct()
    n = distinct.count()
    # each fingerprint becomes 66 rows below, so many tasks share them, however few bytes they come from
    distinct = distinct.repartition(max(distinct.sparkSession.sparkContext.defaultParallelism, n // A_TASK), "f")
    index = distinct.select("f", F.explode(F.array(*_segments("f"))).alias("key"))
    ball = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(1 << i if i >= 0 else 0).cast("long").alias("mask")) for s in (0, 1) for i in range(-1, 32)))
    low, high = _segments("f")
    probes = distinct.select("f", F.explode(ball).alias("b")).select("f", F.when(F.col("b.s") == 0, low).otherwise(high).bitwiseXOR(F.col("b.mask")).alias("key"))
    crowded = Kept(index.groupBy("key").count().where(F.col("count") > heavy).select("key"), "heavy")
    dense = bool(crowded.df.limit(1).count())
    light = index.join(crowded.df, "key", "left_anti") if dense else index
    t = light.select("key", F.col("f").alias("v")).hint("shuffle_hash")
    p = probes.select("key", F.col("f").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS
    edges = p.join(t, (p["key"] == t["key"]) & (F.col("u") < F.col("v")) & near).select("u", "v")
    if dense:
        reach = probes.join(crowded.df, "key", "left_semi").select("f").distinct()
        masks = F.array(*(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in [0, *(1 << i for i in range(64))]))
        listed = reach.select("f", F.explode(masks).alias("m")).select("f", F.col("f").bitwiseXOR(F.col("m")).alias("word"))
        hubs = listed.groupBy("word").agg(F.min("f").alias("v"), F.count("*").alias("n")).where("n > 1")
        edges = edges.unionByName(listed.join(hubs, "word").where("f <> v").select(F.col("f").alias("u"), "v").distinct())
    return edges


def members(rows: DataFrame) -> DataFrame:
    """(f, component_id) for the fingerprints in rows (doc_id, f), component_id being the smallest doc_id of the component."""
    distinct = keep(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct)).select(F.col("node").alias("f"), "root")
    placed = distinct.join(roots, "f", "left").select("f", F.coalesce("root", "f").alias("root"), "first")
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(ids, "root").select("f", "root", "component_id")


def _comparable(df: DataFrame) -> list[str]:
    """Columns that can be hashed."""
    return [f.name for f in df.schema.fields if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind]


def dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component_id (of null, of each component): that of its smallest doc_id; of rows with that doc_id, that of the smallest hash of all columns, so reruns choose equal rows. All columns pass
    unchanged. Rows stay where they are (see larkspar.llm.parts): texts aren't shuffled."""
    parts = Parts(docs)
    ids = parts.column.alias("part"), parts.row.alias("row"), F.xxhash64(*_comparable(parts.df)).alias("tie")
    rows = keep(fingerprints(parts.df, shingle, *ids), "fingerprints")
    found = rows.join(members(rows), "f").withColumn("group", F.struct(F.col("component_id").isNull(), F.coalesce("component_id", "root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "part", "row")
    first = found.groupBy("group").agg(F.min(order).alias("x"))
    return attach(parts, first.select("x.part", "x.row"), "chosen")


# Near duplicates by similarity of texts: the same search, wider fingerprints for candidates, and the texts' own shingles to verify them


def wide_fingerprint(parts: set[bytes]) -> np.ndarray:
    """The SimHash of a set, of 256 bits, as four unsigned numbers."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    ones, n = np.zeros(256, np.int64), len(h)
    for i in range(0, n, 16_384):
        x = h[i : i + 16_384, None] * _MIX
        x = (x ^ (x >> np.uint64(32))) * _TURN
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 32), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def _grams(w: list[bytes], shingle: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])


def _wide(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, found = [], []
        for t in raw(b):
            w = t.lower().split()
            key.append(xxhash.xxh3_128_digest(b" ".join(w)))
            found.append([*wide_fingerprint(set(w)), *wide_fingerprint(set(_grams(w, shingle)))])
        f = np.array(found, "<u8").reshape(len(found), 8).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(key, pa.binary()), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(8))], [*b.schema.names[:-1], "key", *_F, *_G])


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(n, shingles): of each text the sorted different hashes of its shingles."""
    for b in batches:
        found = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _grams(t.lower().split(), shingle)), np.uint64)).view(np.int64) for t in raw(b)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        values = np.concatenate([np.zeros(0, np.int64), *found])
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("__n")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], ["n", "shingles"])


#: The fingerprint of the different words, and that of the different shingles.
_F, _G = [f"f{k}" for k in range(4)], [f"g{k}" for k in range(4)]


def _near(a: str, b: str) -> Column:
    """Whether the complete fingerprints of two texts leave it open that they are near."""
    words, shingles = (reduce(Column.__add__, (F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in fs)) for fs in (_F, _G))
    return (words <= WIDE_BITS) & (shingles <= SHINGLE_BITS)


def _eight() -> Column:
    """The eight segments of f, each with its number above its bits."""
    halves = [h for f in _F for h in (F.col(f).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f, 32))]
    return F.array(*(h.bitwiseOR(F.lit(k << 32)) for k, h in enumerate(halves)))


def _masks() -> Column:
    return F.array(*(F.lit(m).cast("long") for m in [0, *(1 << i for i in range(32))]))


def _crowded(texts: DataFrame, heavy: int) -> DataFrame | None:
    """The segment values that more than heavy texts share; None if there are none."""
    found = keep(texts.select(F.explode(_eight()).alias("segment")).groupBy("segment").count().where(F.col("count") > heavy).select("segment"), "crowded")
    return found if found.limit(1).count() else None


def candidates(texts: DataFrame, heavy: int = CROWD, near: int = NEAR) -> DataFrame:
    """(u, v), u < v, of numbered texts (n, f0 to f3, g0 to g3) that may be near: one of the eight 32-bit segments of f differs in at most one bit, f in at most WIDE_BITS and g in at most SHINGLE_BITS.

    Of a segment value that more than heavy texts share, each text meets only the least of them and the next few in the order of complete fingerprints. So pairs are linear in the texts.
    crowded_links() finds the other links of such values, once it is known which texts these have already joined."""
    segments, masks = _eight(), _masks()
    index = texts.select("n", F.explode(segments).alias("segment"))
    crowded = _crowded(texts, heavy)
    dense = crowded is not None
    light = index.join(crowded, "segment", "left_anti") if dense else index
    probes = light.select("n", F.explode(F.transform(masks, lambda m: F.col("segment").bitwiseXOR(m))).alias("segment"))
    pairs = probes.select("segment", F.col("n").alias("u")).join(light.select("segment", F.col("n").alias("v")).hint("shuffle_hash"), "segment").where("u < v").select("u", "v")
    known = []
    if dense:
        whole = keep(texts.select("n", F.struct(*_F, *_G).alias("f"), F.explode(segments).alias("segment")).join(crowded, "segment", "left_semi"), "whole")
        order = W.partitionBy("segment").orderBy("f", "n")
        following = whole.select("n", "f", F.array(*(F.lead(F.struct("n", "f"), k).over(order) for k in range(1, near + 1))).alias("next"))
        beside = following.select(F.struct("n", "f").alias("x"), F.explode("next").alias("y")).where("y is not null")
        least = keep(whole.groupBy("segment").agg(F.min(F.struct("n", "f")).alias("y")), "least")
        star = whole.join(least, "segment").select(F.struct("n", "f").alias("x"), "y")
        # both sides' fingerprints are at hand, so only what is near leaves these
        known = [p.select("x.n", F.col("y.n").alias("m"), F.col("x.f").alias("a"), F.col("y.f").alias("b")).where(_near("a", "b")).select("n", "m") for p in (beside, star)]
        # the least of a crowded value and texts without one meet the least of what is one bit off
        few = light.unionByName(least.select("y.n", "segment"))
        off = few.select("n", F.explode(F.transform(masks, lambda m: F.col("segment").bitwiseXOR(m))).alias("segment")).join(least, "segment").select("n", F.col("y.n").alias("m"))
        pairs = pairs.unionByName(_ordered(off))
    fps = texts.select("n", F.struct(*_F, *_G).alias("f"))
    met = pairs.distinct().join(fps.select(F.col("n").alias("u"), F.col("f").alias("a")), "u").join(fps.select(F.col("n").alias("v"), F.col("f").alias("b")), "v")
    met = met.where(_near("a", "b")).select("u", "v")
    return reduce(DataFrame.unionByName, (met, *map(_ordered, known))).distinct()


def crossing(texts: DataFrame, roots: DataFrame, heavy: int = CROWD) -> DataFrame | None:
    """The pairs that candidates() leaves out, but for those of one component of roots (n, root), which are joined already: (u, v), u < v, of texts of different components that are equal in a crowded
    segment value, or differ in one bit of a segment of which one value is crowded, and whose complete fingerprints leave it open that they are near. None if no value is crowded.

    There are as many as the square of a crowd of texts that are alike but not near, so nothing runs this but tests, which hold crowded_links() against it.

    Texts of one value and component are a class. Classes meet first, so nothing is spent on pairs within a component, however large; of two classes that meet, the smaller one's texts are sent to the
    other's, and only what is near leaves that join."""
    crowded = _crowded(texts, heavy)
    if crowded is None:
        return None
    masks = _masks()
    reach = keep(crowded.select(F.explode(F.transform(masks, lambda m: F.col("segment").bitwiseXOR(m))).alias("segment")).distinct(), "reach")
    rows = texts.select("n", F.struct(*_F, *_G).alias("f"), F.explode(_eight()).alias("segment")).join(reach, "segment", "left_semi")
    rows = keep(rows.join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")), "reached")
    classes = rows.groupBy("segment", "root").agg(F.count("*").alias("size")).join(crowded.withColumn("full", F.lit(True)), "segment", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    classes = keep(classes, "classes")
    a = classes.where("full").select(F.col("segment").alias("s"), F.col("root").alias("r"), F.col("size").alias("m"), F.explode(F.transform(masks, lambda m: F.col("segment").bitwiseXOR(m))).alias("segment"))
    # two crowded values meet from either side, so the lesser value (and root, within a value) asks
    met = a.join(classes, "segment").where("r <> root and (not full or s < segment or (s = segment and r < root))")
    small, large = F.struct("s", "r"), F.struct(F.col("segment").alias("s"), F.col("root").alias("r"))
    met = met.select(F.when(F.col("m") <= F.col("size"), small).otherwise(large).alias("x"), F.when(F.col("m") <= F.col("size"), large).otherwise(small).alias("y"))
    met = met.select(F.col("x.s").alias("segment"), F.col("x.r").alias("root"), "y")
    asking = met.join(rows, ["segment", "root"]).select(F.col("y.s").alias("segment"), F.col("y.r").alias("root"), "n", F.col("f").alias("a")).distinct()
    there = rows.select("segment", "root", F.col("n").alias("m"), F.col("f").alias("b"))
    return _ordered(asking.join(there, ["segment", "root"]).where(_near("a", "b")).select("n", "m")).distinct()


def crowds(texts: DataFrame, heavy: int = CROWD) -> DataFrame | None:
    """(crowd, n): the texts of each crowd, so that two texts of which one has a crowded segment value and the other has it too, or one that differs in one bit, are in a crowd together. None if no value is crowded.

    A crowd is made of crowded values that differ in one bit or share at least an eighth of the lesser one's texts, directly or through others."""
    crowded = _crowded(texts, heavy)
    if crowded is None:
        return None
    around = crowded.select(F.col("segment").alias("value"), F.explode(F.transform(_masks(), lambda m: F.col("segment").bitwiseXOR(m))).alias("segment"))
    index = texts.select("n", F.explode(_eight()).alias("segment"))
    whole = keep(index.join(crowded, "segment", "left_semi"), "whole")
    sizes = keep(whole.groupBy("segment").agg(F.count("*").alias("size")), "sizes")
    values = whole.groupBy("n").agg(F.sort_array(F.collect_list("segment")).alias("s"))
    both = values.select(F.explode("s").alias("u"), "s").select("u", F.explode("s").alias("v")).where("u < v").groupBy("u", "v").agg(F.count("*").alias("both"))
    sized = both.join(sizes.select(F.col("segment").alias("u"), F.col("size").alias("x")), "u").join(sizes.select(F.col("segment").alias("v"), F.col("size").alias("y")), "v")
    beside = around.join(crowded, "segment", "left_semi").where("value < segment").select(F.col("value").alias("u"), F.col("segment").alias("v"))
    roots = components(sized.where("8 * both >= least(x, y)").select("u", "v").unionByName(beside)).select(F.col("node").alias("value"), "root")
    reach = keep(around.join(roots, "value", "left").select("segment", F.coalesce("root", "value").alias("crowd")).distinct(), "reach")
    return keep(index.join(reach, "segment").select("crowd", "n").distinct(), "crowds")


def crowded_links(members: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of crowds (crowd, n) of texts with their sets (n, shingles) and the components they have so far (roots: n, root): edges (u, v) that are links, and pairs (u, v) among which are all other links
    of one crowd but for those of texts that the components or the first edges join. Both tables have u < v.

    Texts are written as what they differ in from their crowd's centre C, the shingles of over half of a sample of it: D(x) is the symmetric difference of x and C. Let r = (1 - similarity) / (1 + similarity)
    and e(x) = |D(x)| - r |x|. x and y are near exactly if the symmetric difference of D(x) and D(y), which is that of x and y, is at most r (|x| + |y|), that is, if 2 |D(x) & D(y)| >= e(x) + e(y).

    So all pairs with e(x) + e(y) <= 0 are near; the text m with the least e is near all of their texts, and edges to it join them. Every other link has a common difference, which crowds of like texts
    have few of: in any one order of differences, the first common one of x and y is not among the last (e(x) + e(y)) / 2 - 1 of either (prefix filter). Texts are put in bands of like e, and each sends, for each band
    that it may have a link to, the differences that come first, the rarest in front and those that no other text has left out. None of this depends on what C is, only the number of pairs does."""
    ratio = Fraction(str(similarity))
    p, q = ((1 - ratio) / (1 + ratio)).as_integer_ratio()
    sizes = keep(members.groupBy("crowd").agg(F.count("*").alias("size")), "sizes")
    rows = members.join(sizes, "crowd").join(sets, "n").join(roots, "n", "left").select("crowd", "n", F.coalesce("root", "n").alias("root"), "size", "shingles")
    rows = keep(rows, "crowded_sets")
    sample = rows.where(F.pmod(F.xxhash64("n"), F.col("size")) < CENTRE)
    taken = sample.groupBy("crowd").agg(F.count("*").alias("taken"))
    counted = sample.select("crowd", F.explode("shingles").alias("shingle")).groupBy("crowd", "shingle").agg(F.count("*").alias("having"))
    centres = keep(counted.join(taken, "crowd").where("2 * having > taken").groupBy("crowd").agg(F.collect_list("shingle").alias("centre")), "centres")
    none = F.array().cast("array<bigint>")
    rows = rows.join(centres, "crowd", "left").withColumn("centre", F.coalesce("centre", none))
    rows = rows.withColumn("differences", F.concat(F.array_except("shingles", "centre"), F.array_except("centre", "shingles")))
    # e times q, so that all is exact
    rows = rows.select("crowd", "n", "root", "differences", F.size("differences").cast("long").alias("d"), F.size("shingles").cast("long").alias("size"))
    rows = keep(rows.withColumn("e", F.lit(q) * F.col("d") - F.lit(p) * F.col("size")), "differences")
    least = keep(rows.groupBy("crowd").agg(F.min(F.struct("e", "n", "root")).alias("m")), "least")
    rows = rows.join(least, "crowd").withColumn("joined", F.col("e") + F.col("m.e") <= 0)
    star = keep(_ordered(rows.where("joined and root <> m.root").select("n", F.col("m.n").alias("m"))).distinct(), "star")
    rows = rows.withColumn("root", F.when(F.col("joined"), F.col("m.root")).otherwise(F.col("root"))).drop("m")
    # a band's width follows the texts' sizes, of which those of links differ by a factor of 1 / similarity at most
    apart = math.ceil(-math.log2(similarity))
    level = F.floor(F.log2(F.col("size").cast("double")))
    width = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), level) * F.lit(p / q / 2))
    rows = rows.withColumn("band", F.struct("joined", level.alias("level"), F.floor(F.col("d") / width).alias("step")))
    bands = rows.groupBy("crowd", "band").agg(F.min("e").alias("e"), F.max("d").alias("d"))
    bands = keep(bands.groupBy("crowd").agg(F.collect_list(F.struct("band", "e", "d")).alias("bands")), "bands")
    shared = lambda b: F.greatest(F.lit(1), F.ceil((F.col("e") + b["e"]) / F.lit(2.0 * q)))  # noqa: E731  at least so many common differences with a text of the band
    open_ = lambda b: ~(F.col("joined") & b["band"]["joined"]) & (F.abs(F.col("band.level") - b["band"]["level"]) <= apart) & (shared(b) <= F.least("d", b["d"]))
    rows = rows.join(bands, "crowd").withColumn("bands", F.transform(F.filter("bands", open_), lambda b: F.struct(b["band"].alias("band"), (F.col("d") - shared(b) + 1).alias("first"))))
    rows = keep(rows.where(F.size("bands") > 0).select("crowd", "n", "root", "d", "e", "band", "bands", "differences"), "banded")
    each = rows.select("crowd", "n", F.explode("differences").alias("x")).select("crowd", "n", F.xxhash64("crowd", "x").alias("x"))
    rare = each.groupBy("x").agg(F.count("*").alias("having")).where("having > 1")
    common = each.join(rare, "x").groupBy("crowd", "n").agg(F.sort_array(F.collect_list(F.struct("having", "x"))).alias("common"))
    rows = rows.drop("differences").join(common, ["crowd", "n"]).withColumn("alone", F.col("d") - F.size("common"))
    rows = rows.withColumn("common", F.transform("common", lambda c, i: F.struct(c["x"].alias("x"), (F.col("d") - F.col("alone") - i).alias("rest"))))

    def sent(b: Column) -> Column:
        low, high = F.least(F.col("band"), b["band"]), F.greatest(F.col("band"), b["band"])
        first = F.slice("common", 1, F.greatest(F.lit(0), b["first"] - F.col("alone")).cast("int"))
        return F.transform(first, lambda c: F.struct(F.xxhash64(low, high, c["x"]).alias("key"), c["rest"].alias("rest"), (F.col("band") <= b["band"]).alias("low"), (F.col("band") >= b["band"]).alias("high")))

    asked = keep(rows.select("n", "root", "e", F.explode(F.flatten(F.transform("bands", sent))).alias("s")).select("n", "root", "e", "s.*"), "asked_differences")
    a, b = (asked.where(c).select("key", *(F.col(x).alias(f"{c}_{x}") for x in ("n", "root", "e", "rest"))) for c in ("low", "high"))
    fits = F.lit(2 * q) * F.least("low_rest", "high_rest") >= F.col("low_e") + F.col("high_e")
    met = a.join(b, "key").where(F.col("low_root") != F.col("high_root")).where(fits)
    return star, keep(_ordered(met.select(F.col("low_n").alias("n"), F.col("high_n").alias("m"))).distinct(), "crossing")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("n <> m").select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v"))


def similar_members(parts: Parts, shingle: int = 5, similarity: float = 0.8, heavy: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, part, row, tie, n) of all rows, n being the number of their text (equal words: one text), and (n, root) of the texts that are near another one."""
    names = _comparable(parts.df)
    ids = parts.df.select(F.col("doc_id").cast("long").alias("doc_id"), parts.column.alias("part"), parts.row.alias("row"), F.xxhash64(*names).alias("tie"), "text")
    rows = keep(map_texts(ids, lambda x: _wide(x, shingle), "doc_id long, part long, row long, tie long, key binary, " + ", ".join(f"{c} long" for c in (*_F, *_G))), "fingerprints")
    texts = rows.groupBy("key").agg(F.min(F.struct("part", "row", *_F, *_G)).alias("x")).select("key", "x.*")
    texts = keep(texts.withColumn("n", F.monotonically_increasing_id()), "texts")
    spread_out = texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, texts.count() // (A_TASK // 4)), "n")
    links = _verified(parts, texts, keep(candidates(spread_out, heavy), "pairs"), shingle, similarity)
    roots = keep(components(links).select(F.col("node").alias("n"), "root"), "roots")
    together = crowds(spread_out, heavy)
    if together is not None:
        sets = _sets(parts, texts, together.select("n").distinct(), shingle)
        star, more = crowded_links(together, sets, roots, similarity)
        further = [star, keep(_by_blocks(more, sets, similarity), "links")]
        if any(x.limit(1).count() for x in further):
            roots = components(reduce(DataFrame.unionByName, (links, *further))).select(F.col("node").alias("n"), "root")
    return rows.join(texts.select("key", "n"), "key").select("doc_id", "part", "row", "tie", "n"), roots


def _sets(parts: Parts, texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(n, shingles) of the texts whose n is wanted, made again of the texts."""
    asked = wanted.join(texts, "n").select("part", "row", F.col("n").alias("__n"))
    return keep(attach(parts, asked, "asked", ["text"], lambda x: _shingles(x, shingle), "n long, shingles array<bigint>"), "shingles")


def _verified(parts: Parts, texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles have the similarity."""
    sets = _sets(parts, texts, pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct(), shingle)
    met = pairs.join(sets.select(F.col("n").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("n").alias("v"), F.col("shingles").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return keep(met.where(both >= F.lit(similarity) * (F.size("a") + F.size("b") - both)).select("u", "v"), "links")


def _by_blocks(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets have the similarity, for many pairs of few texts: texts are cut into blocks, and a set is sent once to each pair of blocks that has a pair of texts,
    instead of once for each pair of texts."""
    n, values = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    count = max(8, n // BLOCK_TEXTS, 8 * values // BLOCK_BYTES)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(count))
    asked = keep(pairs.select(F.least(place("u"), place("v")).alias("i"), F.greatest(place("u"), place("v")).alias("j"), "u", "v"), "blocked")
    needed = asked.select("i", "j").distinct().select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    there = sets.withColumn("block", place("n")).join(needed, "block").select(F.col("i").alias("k"), F.col("j").alias("l"), "n", "shingles")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(_similar(a, b, similarity), pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return asked.groupBy("i", "j").cogroup(there.groupBy("k", "l")).applyInArrow(meet, "u long, v long")


def _similar(pairs: pa.Table, sets: pa.Table, similarity: float) -> list[np.ndarray]:
    """u and v of the pairs whose sets (sorted as unsigned numbers, without repeats, never empty) have the similarity."""
    if not pairs.num_rows:
        return [np.zeros(0, np.int64)] * 2
    lists = sets["shingles"].combine_chunks()
    flat, at, n = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), sets["n"].to_numpy()
    order = np.argsort(n)
    u, v = pairs["u"].to_numpy(), pairs["v"].to_numpy()
    by = np.argsort(u, kind="stable")
    u, v = u[by], v[by]
    x, y = (order[np.searchsorted(n, w, sorter=order)] for w in (u, v))
    near = np.zeros(len(u), bool)
    size = np.diff(at)
    start = 0
    while start < len(u):
        # pairs of one text, of about a million shingles together at most
        end = min(int(np.searchsorted(u, u[start], "right")), start + 1 + int(np.searchsorted(np.cumsum(size[y[start : start + 65_536]]), 1 << 20)))
        mine, theirs = flat[at[x[start]] : at[x[start] + 1]], [flat[at[k] : at[k + 1]] for k in y[start:end]]
        other = np.concatenate(theirs)
        hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        sizes = size[y[start:end]]
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
        near[start:end] = both >= similarity * (len(mine) + sizes - both)
        start = end
    return [u[near], v[near]]


def dedup_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, heavy: int = CROWD) -> DataFrame:
    """docs with one row of each group of near duplicates: texts of equal words, and texts whose sets of shingles have a Jaccard similarity of at least similarity, directly or through
    others. The row with the smallest doc_id stays (then: of the smallest hash of all columns). All columns pass unchanged; rows stay where they are.

    Candidates are found as links() finds its own, in fingerprints of the texts' different words, four times as long, which near texts leave almost alone; verified candidates are
    near, so no wrong link is made, but a near pair is missed where all its segments differ in two bits or more (see README for the measured recall)."""
    parts = Parts(docs)
    rows, near = similar_members(parts, shingle, similarity, heavy)
    found = rows.join(near, "n", "left").withColumn("group", F.coalesce("root", "n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "part", "row")
    return attach(parts, found.groupBy("group").agg(F.min(order).alias("x")).select("x.part", "x.row"), "chosen")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    got = rows.join(members(rows), "f")
    return got.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
