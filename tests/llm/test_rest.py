import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from compare import oracle, result
from pyspark.sql import functions as F

import corpus_pipeline
from larkspar.llm import classifier, decontaminate, mixing, queries, sharding, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert result(queries.QUERIES[name](spark, sf)) == oracle(queries.ORACLES[name], sf)


# Mixing


def brute_targets(sizes, budget=1.5, cap=2.0, weights=(5, 2, 1)):
    """Round by round: share what is left by weight, stop those above their cap, share their excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    r = np.random.default_rng(seed)
    sizes = {f"s{i}": int(x) for i, x in enumerate(r.integers(0, 10, 9) * r.integers(1, 10_000, 9))} | {None: 50, "Ä": 7}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_op7_odd_rows(spark, odd, folder):
    path = folder(documents=odd.withColumn("size", F.lit("mine")).withColumn("target", F.lit(1)).withColumn("u", F.lit(1)))
    got = mixing.op7_mixing(spark, path)
    for r in got.collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert mixing.op7_mixing(spark, folder(documents=odd.limit(0))).count() == 0


def test_op7_sources_come_near_their_targets(spark):
    got = mixing.op7_mixing(spark, "/root/testdata/sf0.01").groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most"))
    for r in got.collect():
        assert abs(r["taken"] - r["target"]) <= r["most"]


def test_op7_without_broadcast_is_the_same(spark, sf, monkeypatch):
    want = result(mixing.op7_mixing(spark, sf))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert result(mixing.op7_mixing(spark, sf)) == want and want


def test_op7_null_and_repeated_ids_share_a_hash(spark, docs, folder):
    d = docs(*[(None, "a b c", "en", "s")] * 500, *[(7, "a b", "en", "s")] * 100, *[(i, "x y z", "en", "t") for i in range(1000, 1300)], (None, None, None, None))
    got = mixing.op7_mixing(spark, folder(documents=d)).collect()
    assert len(got) == 901 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert len({(r["doc_id"], r["size"], r["taken"]) for r in got if r["size"] in (2, 3) and r["doc_id"] in (None, 7)}) == 2


def test_mix_repeats_rows(spark, odd):
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    again = mixing.mix(odd)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect()))


# Sharding


def check_shards(rows, texts, n=16):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for s, x in by.items():
        assert 0 <= s < n and sorted(r["slot"] for r in x) == list(range(len(x)))
    return {s: sum(r["size"] for r in x) for s, x in by.items()}


def test_op4(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op4_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        t = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    sizes = check_shards(rows, docs)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(x - mean) for x in sizes.values()) <= 2 * sharding.LARGE * mean
    groups = {}
    for r in rows:
        groups.setdefault(docs[r["doc_id"]], []).append(r)
    small = [g for g in groups.values() if sum(r["size"] for r in g) <= sharding.WHOLE * mean]
    assert all(len({r["shard"] for r in g}) == 1 for g in small) and any(len(g) > 1 for g in small)


def plain_placement(docs, cuts, shards=16):
    """doc_id -> (shard, slot) in plain Python, given the splitters."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    salt = lambda i: xxhash.xxh64_intdigest(struct.pack("<i", 5), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) >> 1
    rows = [(signed(xxhash.xxh64_intdigest(t.encode(), 42)), i, len(t.encode()) + 1) for i, t in docs.items()]
    total = sum(r[2] for r in rows)
    share = total / shards
    sizes = [0] * (len(cuts) + 1)
    where = {i: int(np.searchsorted(cuts, h, "right")) for h, i, _ in rows}
    for _, i, size in rows:
        sizes[where[i]] += size
    pieces = [max(1, math.ceil(x / max(1, 2 * total / len(sizes)))) for x in sizes]
    first = [sum(pieces[:k]) for k in range(len(pieces))]
    piece = {i: first[r] + salt(i) % pieces[r] for i, r in where.items()}
    alone = [n > 1 for n in pieces for _ in range(n)]
    groups = {}
    for h, i, size in rows:
        groups.setdefault(h, []).append((i, size))
    units = []
    for h, g in groups.items():
        s = sum(x for _, x in g)
        if s > sharding.LARGE * share and (len(g) == 1 or s <= sharding.WHOLE * share):
            units.append((s, h, "()", [i for i, _ in g]))
        elif s > sharding.WHOLE * share and s > sharding.LARGE * share * len(g):
            units += [(x, h, f"({i},)", [i]) for i, x in g]
    held, fixed = [0] * shards, {}
    for s, _, _, ids in sorted(units, key=lambda u: (-u[0], u[1], u[2])):
        k = min(range(shards), key=lambda k: (held[k], k))
        held[k] += s
        fixed |= dict.fromkeys(ids, k)
    order = sorted(rows, key=lambda r: (piece[r[1]], r))
    at, ends = 0, {}
    for _, i, size in order:
        at += 0 if i in fixed else size
        ends[i] = at
    levels = sharding.levels(held, at)
    together = {}
    for h, i, size in order:
        g = together.setdefault((piece[i], h), [0, 0])
        g[0], g[1] = g[0] + (0 if i in fixed else size), max(g[1], ends[i])
    shard = {}
    for h, i, size in order:
        fill, (group, end) = 0 if i in fixed else size, together[piece[i], h]
        twice = 2 * ends[i] - fill if alone[piece[i]] or group > sharding.WHOLE * share else 2 * end - group
        shard[i] = fixed.get(i, sum(2 * e <= twice for e in levels[:-1]))
    n, out = [0] * shards, {}
    for _, i, _ in order:
        out[i] = (shard[i], n[shard[i]])
        n[shard[i]] += 1
    return out


@pytest.mark.parametrize("hot", [0, 400])
def test_op4_placement_equals_plain_python(spark, docs, folder, hot):
    """Texts of sf0.01, and the same with a hot text, a text above a share and middling ones."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    if hot:
        texts |= {10_000 + i: "the same hot text" * 20 for i in range(hot)} | {20_000: "x" * 400_000} | {20_001 + i: "y" * 3_000 for i in range(60)}
    path = folder(documents=docs(*texts.items()))
    thin = sharding.keyed(spark.read.parquet(f"{path}/documents.parquet")).select("doc_id", "__size", "__h")
    cuts = sharding.splitters(thin, thin.agg(F.sum("__size")).first()[0])
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op4_sharding(spark, path).collect()}
    assert got == plain_placement(texts, cuts)


def test_op4_hot_text_is_split(spark, docs, folder):
    rows = sharding.op4_sharding(spark, folder(documents=docs(*[(i, "the same text") for i in range(600)], *[(i, f"text {i} of its own") for i in range(600, 1000)]))).collect()
    sizes = check_shards(rows, None)
    mean = sum(sizes.values()) / 16
    assert max(abs(x - mean) for x in sizes.values()) <= 40


def test_op4_one_text_above_a_share(spark, docs, folder):
    rows = sharding.op4_sharding(spark, folder(documents=docs((0, "x" * 50_000), *[(i, "y" * (i % 50) + str(i)) for i in range(1, 900)]))).collect()
    sizes = check_shards(rows, None)
    alone = next(r["shard"] for r in rows if r["doc_id"] == 0)
    rest = [x for s, x in sizes.items() if s != alone]
    assert sizes[alone] == 50_001 and len(rest) == 15 and max(rest) - min(rest) <= 120


def test_op4_levels():
    assert sharding.levels([0, 0, 0, 0], 40) == [10, 20, 30, 40]
    assert sharding.levels([30, 0, 10, 0], 40) == [0, 16, 23, 40]
    assert sharding.levels([100, 0], 10) == [0, 10]


def test_op4_odd_rows(spark, odd, folder):
    rows = sharding.op4_sharding(spark, folder(documents=odd)).collect()
    check_shards(rows, None)
    assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"]) == sorted((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in odd.collect() if r["doc_id"])
    assert sharding.op4_sharding(spark, folder(documents=odd.limit(0))).count() == 0
    got = sharding.shard_documents(odd.withColumn("shard", F.lit("mine")).withColumn("size", F.lit("kept")))
    assert got.columns == [*odd.columns, "size", "shard", "slot"] and got.count() == odd.count()


# Decontamination

ITEM = "Which river flows through the old town of the northern province, and where does it meet the sea at last?"


def test_op6_finds_substitutions_and_parts(spark, docs):
    words = ITEM.split()
    swapped = [("changed" if i % 6 == 3 else w) for i, w in enumerate(words)]
    half = ["changed" if i % 2 else w for i, w in enumerate(words)]
    b = spark.createDataFrame([(1, ITEM), (2, "too short to tell"), (3, None), (4, "")], "item_id long, text string")
    d = docs(
        (1, f"intro words {ITEM} and more"), (2, "x " + " ".join(swapped).upper().replace(" ", " - ")), (3, " ".join(half)), (4, " ".join(words[:14])), (5, "nothing of the kind, the old town of the sea"), (6, None), (7, ""), (8, "too short to tell"), (None, ITEM), (1, f"intro words {ITEM} and more"),
    )
    got = decontaminate.findings(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (4, 1), (8, 2), (None, 1)} and len(got) == 5
    assert {r["doc_id"]: r["equal_words"] for r in got}[1] == 20
    extra = d.withColumn("words", F.lit("mine")).withColumn("seed", F.lit(1)).withColumn("item_id", F.lit(2))
    kept = decontaminate.clean(extra, b)
    assert kept.columns == extra.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7]
    assert decontaminate.findings(d.limit(0), b).count() == 0 and decontaminate.findings(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == d.count()


@pytest.mark.parametrize("seeds", [1_000_000, 0])
def test_op6_short_items_count_whole(spark, docs, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "yes"), (3, "a b c d"), (4, "l1 l2 l3 l4 l5 l6 l7 l8 l9 l10 l11 l12"), (5, "p q r s t")], "item_id long, text string")
    d = docs(
        (1, "say One two, three four FIVE six!"), (2, "one two three four five"), (3, "yes and no"), (4, "Yes!"), (5, "a b c d e"), (6, "A b; c d."), (7, "x l1 l2 l3 l4 l5 l6 l7 l8 l9 l10 l11 l12 x"), (8, "x l1 l2 l3 l4 l5 l6 l7 l8 l9 l10 l11 x l12 x"), (9, "p q r s t"),
        (10, "one two x three four five six"),
    )
    got = {(r["doc_id"], r["item_id"], r["equal_words"]) for r in decontaminate.findings(d, b).collect()}
    assert got == {(1, 1, 6), (4, 2, 1), (6, 3, 4), (7, 4, 12), (9, 5, 5)}
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == {2, 3, 5, 8, 10}


def test_op6_finds_a_passage_deep_in_a_very_long_text(spark, docs):
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    filler = " ".join(f"z{i}" for i in range(60_000))
    d = docs((1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {filler}"))
    assert [(r["doc_id"], r["start"]) for r in decontaminate.findings(d, b).collect()] == [(1, 60_000)]


def test_op6_finds_short_runs_within_other_text(spark, docs):
    words = ITEM.split()
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    other = " ".join(f"other{i}" for i in range(30))
    runs = [(i, f"{other} {' '.join(words[a : a + n])} {other}") for i, (a, n) in enumerate((a, n) for n in (10, 13, 14, 15) for a in (0, 3, 20 - n))]
    got = {r["doc_id"] for r in decontaminate.findings(docs(*runs), b).collect()}
    assert got == set(range(3, 12))
    assert {r["doc_id"] for r in decontaminate.clean(docs(*runs), b).collect()} == {0, 1, 2}


def test_op6_every_allowed_pattern_of_replacements_has_a_seed():
    masks = (*decontaminate.MASKS, decontaminate.SHORT)
    for n in (13, 14, 15, 18, 20):
        for gone in itertools.combinations(range(n), n - math.ceil(decontaminate.SHARE * n)):
            assert any(not any(k + p in gone for p in mask) for mask in masks for k in range(n - max(mask)))


def test_op6_finds_replacements_that_only_late_or_short_seeds_survive(spark, docs):
    words = ITEM.split()[:13]
    old = [{k + p for p in mask} for mask in decontaminate.MASKS for k in range(3)]
    patterns = [gone for gone in itertools.combinations(range(13), 2) if all(seed & set(gone) for seed in old)]
    d = docs(*[(i, " ".join("changed" if j in gone else w for j, w in enumerate(words))) for i, gone in enumerate(patterns)])
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert patterns and {r["doc_id"] for r in decontaminate.findings(d, b).collect()} == set(range(len(patterns)))


def test_op6_without_broadcast_is_the_same(spark, sf, monkeypatch):
    want = result(decontaminate.op6_decontaminate(spark, sf))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert result(decontaminate.op6_decontaminate(spark, sf)) == want and want


def test_op6_odd_rows(spark, odd):
    b = spark.createDataFrame([(1, ITEM), (None, ITEM)], "item_id long, text string")
    assert decontaminate.findings(odd, b).count() == 0
    assert decontaminate.clean(odd, b).count() == odd.count()


# Classifier


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = classifier.op5_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    s, y = np.array([r["score"] for r in got]), np.array([r["quality"] for r in got]) == 1
    rank = s.argsort().argsort() + 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.97 and (s[y] >= 0.3).mean() > 0.98 and (s[~y] < 0.3).mean() > 0.6


def plain_features(text):
    words, seen = text.split(), {0}
    stream = [(1 << 32) if i and w == words[i - 1] else zlib.crc32(w) for i, w in enumerate(words)]
    low = (1 << 64) - 1
    seen |= {(h * 0xC2B2AE3D27D4EB4F & low) >> 44 for h in stream}
    seen |= {((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 & low) >> 44 for a, b in itertools.pairwise(stream)}
    return sorted(seen)


def test_op5_equals_a_plain_loop(spark, sf):
    """The whole query again: features as sets, FTRL updates one weight at a time, in the order of the sample's hashes."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()
    sample = [(plain_features(docs[r["doc_id"]]), r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= classifier.L1:
            return 0.0
        return -(z[k] - math.copysign(classifier.L1, z[k])) / ((classifier.BETA + math.sqrt(n[k])) / classifier.ALPHA + classifier.L2)

    def chance(at):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(map(weight, at)) / math.sqrt(len(at))))))

    for _ in range(classifier.EPOCHS):
        for at, y in sample:
            g = (chance(at) - y) / math.sqrt(len(at))
            for k, w in [(k, weight(k)) for k in at]:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / classifier.ALPHA * w
                n[k] = old + g * g
    got = {r["doc_id"]: r for r in classifier.op5_classifier(spark, sf).collect()}
    assert got.keys() == docs.keys() and len(sample) > 20
    for i, text in docs.items():
        s = chance(plain_features(text))
        assert got[i]["score"] == pytest.approx(s, abs=1e-6) and (got[i]["predicted"] == (s >= 0.3) or abs(s - 0.3) < 1e-6)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op5_repeated_ids_and_rows(spark, docs, folder):
    """Many documents of one id, and many repeated rows, don't outgrow the sample."""
    d = docs(*[(1, f"good words number {i}") for i in range(200)], *[(2, "bad bad bad")] * 300, *[(i, "some other text") for i in range(3, 9)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(d, labels, sample=50)
    again = classifier.train(d.unionByName(d).repartition(5), labels, sample=50)
    assert (model[0] == again[0]).all() and (model[1] == again[1]).all()
    got = classifier.op5_classifier(spark, folder(documents=d, labels=labels))
    assert got.count() == d.count() and got.where("score is null or score < 0 or score > 1").count() == 0


def test_op5_held_out_labels_and_metadata_do_not_matter(spark, sf, folder):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = result(classifier.op5_classifier(spark, folder(documents=d, labels=labels)))
    flipped = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = result(classifier.op5_classifier(spark, folder(documents=d.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")), labels=flipped)))
    assert a == b


def test_op5_odd_rows(spark, odd, folder):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, None), (None, 1, 1), (6, None, 0), (99, 1, 0), (9, 5, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = classifier.op5_classifier(spark, folder(documents=odd, labels=labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert all(r["score"] == pytest.approx(0.5) for r in classifier.op5_classifier(spark, folder(documents=odd, labels=labels.limit(0))).collect())
    assert classifier.op5_classifier(spark, folder(documents=odd.limit(0), labels=labels)).count() == 0
    extra = classifier.score(odd.withColumn("score", F.lit("mine")), classifier.train(odd, labels))
    assert extra.columns == [*odd.columns, "score"] and extra.count() == odd.count()


def test_op5_features_of_chunks_equal_those_of_the_whole(monkeypatch):
    for text in (" ".join(f"w{i % 50}" for i in range(1000)).encode(), " ".join(f"w{i // 5}" for i in range(300)).encode(), b"a " * 50, b"a", b"a b", b""):
        monkeypatch.setattr(classifier, "CHUNK", 200_000)
        whole = classifier.features(text)
        assert whole[0].tolist() == plain_features(text)
        for chunk in (1, 2, 7):
            monkeypatch.setattr(classifier, "CHUNK", chunk)
            assert (classifier.features(text)[0] == whole[0]).all()


def test_ftrl_learns_by_the_formula():
    m = classifier.Ftrl(4)
    at = np.array([0, 3])
    m.update(at, 0.5, 1)
    g = (0.5 - 1) * 0.5
    assert m.z[at] == pytest.approx([g, g]) and m.n[at] == pytest.approx([g * g, g * g])
    assert classifier.sigmoid(0) == 0.5 and math.isclose(classifier.sigmoid(-100) + classifier.sigmoid(100), 1)


# WARC

PAGES = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [(1, "http://a/ä b\r\nX: y", "<p>Ä</p>\r\n\r\nWARC/1.1"), (2, None, "<p>Ä</p>\r\n\r\nWARC/1.1"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x" * 200_000), (5, "http://e", "x" * 200_000), (None, "http://n", "alone"), (None, "http://n2", "shared"), (7, "http://g", "shared"), (None, None, None)],
        PAGES,
    )


def brute_warc(rows):
    best = {}
    for r in rows:
        h = r["html"] or ""
        best[h] = max(best.get(h, -1), -1 if r["page_id"] is None else r["page_id"])
    out, done = [], set()
    import base64

    for r in rows:
        h = r["html"] or ""
        i, top = r["page_id"], None if best[h] == -1 else best[h]
        first = i == top and (h, i) not in done
        if first:
            done.add((h, i))
        out.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def test_op8_odd_rows(spark, pages, folder):
    got = warc.op8_warc(spark, folder(pages=pages))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_warc(pages.collect())
    assert warc.op8_warc(spark, folder(pages=pages.limit(0))).count() == 0
    extra = pages.withColumn("digest", F.lit("mine")).withColumn("offset", F.lit(1))
    assert warc.op8_warc(spark, folder(pages=extra)).count() == pages.count()


def test_op8_archives_are_standard_and_round_trip(spark, pages, tmp_path):
    """Small archives and ranges; every record again with plain gzip and by hand."""
    import gzip
    from pathlib import Path

    base = f"file://{tmp_path}/warc"
    index = warc.write(pages, base, archive_bytes=300)
    rows = index.collect()
    assert len({r["archive"] for r in rows}) > 1
    whole = {}
    for r in rows:
        data = Path(tmp_path, "warc", r["archive"]).read_bytes()
        record = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")
        whole.setdefault(r["archive"], []).append((r["offset"], record))
    for name, records in whole.items():
        assert gzip.decompress(Path(tmp_path, "warc", name).read_bytes()) == b"".join(x for _, x in sorted(records))
    payloads = {r["html"] or "" for r in pages.collect()}
    import pyarrow as pa

    got = warc.read(index.where("record_type = 'response'"), base, lambda r: {"p": r["payload"]}, "p binary", pa.schema([("p", pa.binary())])).collect()
    assert sorted(bytes(r["p"]).decode() for r in got) == sorted(payloads)


def test_op8_small_payloads_can_all_be_responses(spark, pages):
    _, thin, revisits = warc.decided(pages, min_bytes=10)
    got = thin.join(revisits, ["part", "row"])
    assert got.where("size < 10").count() == 0 and got.where("size >= 10").count() == 2


def test_op8_without_broadcast_is_the_same(spark, pages, folder, monkeypatch):
    path = folder(pages=pages)
    monkeypatch.setattr(warc, "BROADCAST_SHARED", 0)
    assert sorted(map(tuple, warc.op8_warc(spark, path).collect()), key=repr) == brute_warc(pages.collect())


def test_op8_hot_payload_over_many_files_and_parts(spark, tmp_path, monkeypatch):
    """A third of all pages share a payload; parts smaller than a file; other splits in the second scan than in the first."""
    from larkspar.llm import parts

    monkeypatch.setattr(parts, "LEAST_PART", 20_000)
    rows = [(i, f"http://h/{i}", "the same page" if i % 3 == 0 else f"page {i // 2} " * (i % 40)) for i in range(3000)]
    spark.createDataFrame(rows, PAGES).repartition(4).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = warc.op8_warc(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_warc([{"page_id": i, "html": h} for i, _, h in rows])


def test_op8_ranges():
    assert list(warc.ranges([(0, 10), (10, 5), (100, 5), (500, 5)], gap=85, most=1000)) == [(0, 3, 0, 105), (3, 4, 500, 505)]
    assert list(warc.ranges([(0, 10), (10, 10)], gap=5, most=15)) == [(0, 1, 0, 10), (1, 2, 10, 20)]
    assert list(warc.ranges([])) == []


# Pipeline


def test_pipeline_equals_its_operators_by_hand(spark, sf):
    import test_dedup
    import test_scans

    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    good = {r["doc_id"] for r in queries.QUERIES["op3_quality"](spark, sf).where("kept").collect()}
    docs = [r for r in docs if r["doc_id"] in good]
    assert all(not test_scans.brute_quality(r["text"])[5] for r in docs)
    comp, _, _ = test_dedup.brute_similar([(r["doc_id"], r["text"]) for r in docs])
    docs = [r for r, c in zip(docs, comp, strict=True) if r["doc_id"] == c]
    leaked = {r[0] for r in oracle(f"SELECT DISTINCT doc_id FROM ({decontaminate.OP6_SQL})", sf)}
    docs = [r for r in docs if r["doc_id"] not in leaked]
    sizes = {}
    for r in docs:
        r["size"] = len((r["text"] or "").split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = brute_targets(sizes)
    took = {}
    for s in sizes:
        rate = target[s] / sizes[s] if sizes[s] else 0
        whole, need = math.floor(rate), (rate - math.floor(rate)) * sizes[s]
        order = sorted((int(hashlib.md5(f"{r['doc_id']}:7".encode()).hexdigest()[:15], 16), r["doc_id"], r["size"]) for r in docs if r["source"] == s)
        best, total, cut = need, 0, 0
        for k, (_, _, size) in enumerate(order):
            total += size
            if abs(total - need) < best:
                best, cut = abs(total - need), k + 1
        for k, (_, i, _) in enumerate(order):
            took[i] = whole + (k < cut)
    got = corpus_pipeline.run(spark, sf).collect()
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {i: n for i, n in took.items() if n}
    check_shards([r.asDict() | {"size": len(r["text"].encode()) + 1} for r in got], None)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, folder, stage):
    path = folder(documents=odd, benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    f = dict(corpus_pipeline.STAGES)[stage]
    got = f(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert set(odd.columns) <= set(got.columns) and got.count() <= 2 * odd.count()
    if stage != "sharding":
        assert got.columns == odd.columns
    assert f(spark, odd.limit(0), path).count() == 0


def test_pipeline_on_odd_rows(spark, odd, docs, folder):
    """Nulls, empty and very long texts, repeated rows and ids through all stages at once, and an empty table."""
    prose = [(100 + i, " ".join(f"word{(i * 7 + k * k) % 500}" for k in range(60)), "en", "s" if i % 3 else None) for i in range(40)]
    leaked = [(300, " ".join(f"x{k}" for k in range(30)) + f" {ITEM} " + " ".join(f"y{k}" for k in range(30)))]
    b = spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string")
    path = folder(documents=odd.unionByName(docs(*prose, *prose[:5], *leaked)), benchmark=b)
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in got}
    assert 300 not in ids and len(ids & {100 + i for i in range(40)}) > 20 and all(r["shard"] in range(16) for r in got)
    check_shards([r.asDict() | {"size": len(r["text"].encode()) + 1} for r in got], None)
    assert corpus_pipeline.run(spark, folder(documents=odd.limit(0), benchmark=b)).count() == 0
