import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspar.llm import common, parts, simhash, substring
from larkspar.llm.graph import components

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> component_id for each, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in rows]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(24)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("heavy", [64, 3, 0])
def test_links_find_every_component(spark, heavy):
    """Random fingerprints, chains of near ones, and a crowd that shares a segment."""
    r = random.Random(heavy)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:20]:
        for _ in range(6):
            f ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.append(f)
    high = r.getrandbits(32) << 32
    fps += [high | r.getrandbits(32) for _ in range(40)] + [high | (1 << a) | (1 << b) for a in range(12) for b in range(a)]
    rows = list(enumerate(sorted(set(fps))))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in rows], "i long, f long")
    got = {x["node"]: x["root"] for x in components(simhash.links(df, heavy)).collect()}
    groups, want = {}, brute_components(rows)
    for i, f in rows:
        s = f - (1 << 64) if f >= 1 << 63 else f
        groups.setdefault(got.get(s, s), set()).add(i)
    expected = {}
    for (i, _), c in zip(rows, want, strict=True):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_op2_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in simhash.op2_simhash(spark, sf).collect()}
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for (i, f), c in zip(rows, brute_components(rows), strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (format(f, "016x"), c)


def test_op2_odd_rows(spark, odd, folder):
    got = simhash.op2_simhash(spark, folder(documents=odd)).collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in odd.collect()]
    want = sorted(((i, format(f, "016x"), c) for (i, f), c in zip(rows, brute_components(rows), strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_op2_empty(spark, odd, folder):
    assert simhash.op2_simhash(spark, folder(documents=odd.limit(0))).count() == 0


def test_dedup_keeps_one_of_each_component(spark, odd):
    extra = odd.withColumn("f", F.lit("mine")).withColumn("component_id", F.lit(1)).withColumn("group", F.lit(2)).withColumn("rid", F.lit(3))
    got = simhash.dedup(extra)
    assert got.columns == extra.columns
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in odd.collect()]
    comp = brute_components(rows)
    keys = {(c if c is not None else ("null", f)) for (_, f), c in zip(rows, comp, strict=True)}
    kept = got.collect()
    assert len(kept) == len(keys)
    assert {r["doc_id"] for r in kept} == {None if isinstance(k, tuple) else k for k in keys}
    assert {r["f"] for r in kept} == {"mine"}


def brute_similar(rows, shingle=5, least=0.8):
    """rows: (doc_id, text) -> for each the least doc_id of its group, over all pairs that share a shingle; and the pairs of unequal texts."""
    words = [tuple(WS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in rows]
    sets = {w: {w[i : i + shingle] for i in range(len(w) - shingle + 1)} or {w} for w in set(words)}
    having, root = {}, {w: w for w in sets}
    for w, g in sets.items():
        for x in g:
            having.setdefault(x, []).append(w)
    pairs = set()
    for w, g in sets.items():
        shared = {}
        for x in g:
            for other in having[x]:
                if other > w:
                    shared[other] = shared.get(other, 0) + 1
        pairs |= {(w, o) for o, n in shared.items() if n >= least * (len(g) + len(sets[o]) - n)}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            first[find(w)] = min(i, first.get(find(w), i))
    return [first.get(find(w)) for w in words], pairs, words


def test_dedup_similar_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = simhash.dedup_similar(docs)
    assert kept.columns == docs.columns
    group, pairs, _ = brute_similar(rows)
    assert pairs and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group))


@pytest.mark.parametrize("heavy", [64, 4])
def test_dedup_similar_recall(spark, docs, heavy):
    """Random texts, copies with about one word in a hundred replaced, and a crowd of near copies, against all pairs; a heavy of 4 makes most segment values crowded."""
    r = random.Random(heavy)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(30, 300))) for _ in range(150)]

    def near(t):
        w = t.split()
        for _ in range(max(1, len(w) // 100)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return " ".join(w)

    texts += [near(t) for t in texts[:100] for _ in range(2)] + [near(texts[3]) for _ in range(150)] + texts[:20]
    rows = list(enumerate(texts))
    d = docs(*rows)
    p = parts.Parts(d)
    found, near_ones = simhash.similar_members(p, heavy=heavy)
    got = {x["doc_id"]: x["root"] if x["root"] is not None else -1 - x["n"] for x in found.join(near_ones, "n", "left").collect()}
    group, pairs, words = brute_similar(rows)
    ids = {w: i for i, w in enumerate(words)}
    linked = sum(got[ids[a]] == got[ids[b]] for a, b in pairs)
    assert linked >= 0.9 * len(pairs) and len(pairs) > 1000
    merged = {}
    for i, g in enumerate(group):
        merged.setdefault(got[i], set()).add(g)
    assert all(len(x) == 1 for x in merged.values())  # no wrong link


def test_dedup_similar_odd_rows(spark, odd):
    extra = odd.withColumn("n", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("__x", F.create_map(F.lit("a"), F.lit(1)))
    got = simhash.dedup_similar(extra)
    assert got.columns == extra.columns
    group, _, words = brute_similar([(r["doc_id"], r["text"]) for r in odd.collect()])
    want = {w: g for g, w in zip(group, words, strict=True)}  # no two texts here are near
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(want.values(), key=repr)
    assert simhash.dedup_similar(odd.limit(0)).count() == 0


def brute_removed(rows, window=13):
    """(doc_id, text) -> (n_words, n_removed, hash) by a table of all windows."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, 1 << 63), 1 << 63 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (1 << 63 if i is None else i):
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_op10_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = substring.op10_substring(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows)


def test_op10_over_many_parts_and_flushes(spark, docs, folder, monkeypatch):
    """Passages shared between files, within a file and within a text; small flushes and blocks."""
    monkeypatch.setattr(substring, "BLOCK", 1 << 10)
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(400)]
    passages = [" ".join(r.choices(vocabulary, k=r.randrange(12, 40))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 60))) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(passages))
        if i % 7 == 0:
            parts.append(parts[0])
        rows.append((i // 2 if i % 10 == 0 else i, "  ".join(parts)))
    rows += [(None, passages[0]), (None, passages[0]), (500, None), (501, "")]
    df = docs(*rows).repartition(9)
    path = folder(documents=df)
    got = substring.op10_substring(spark, path).collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows)


@pytest.mark.parametrize("before,after", [("256k", "64m"), ("64m", "200k")])
def test_op10_does_not_depend_on_splits(spark, docs, tmp_path, monkeypatch, before, after):
    """The last pass runs with other splits than the first two, over parts smaller and larger than either."""
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(4000)]
    rows += [(4000 + i, rows[i][1] + f" end {i}") for i in range(0, 4000, 2)] + [(9000 + i, " ".join(x[1] for x in rows[i * 50 : i * 50 + 50])) for i in range(5)]
    path = f"file://{tmp_path}/documents.parquet"
    docs(*rows).repartition(2).write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 16 << 10).parquet(path)
    want = brute_removed(rows)
    monkeypatch.setattr(common, "spread", lambda df: df)
    name, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for least in (100_000, 32 << 20):
            monkeypatch.setattr(parts, "LEAST_PART", least)
            spark.conf.set(name, before)
            got = substring.remove(spark.read.parquet(path), ["doc_id"])
            first = got.rdd.getNumPartitions()
            spark.conf.set(name, after)
            got = got.select("*")  # planned anew
            assert got.rdd.getNumPartitions() != first
            assert sorted(map(tuple, got.collect()), key=repr) == want
    finally:
        spark.conf.set(name, old)


def test_op10_says_so_if_files_change_between_passes(spark, docs, tmp_path):
    path = f"file://{tmp_path}/documents.parquet"
    docs((1, "a b c d e f g h i j k l m n o"), (2, "x a b c d e f g h i j k l m n o")).write.parquet(path)
    got = substring.remove(spark.read.parquet(path), ["doc_id"])
    docs((1, "p"), (2, "a b c d e f g h i j k l m n o p q r")).repartition(1).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    with pytest.raises(Exception, match="changed between two passes|does not exist|FILE_NOT_EXIST"):
        got.select("*").collect()


def test_op10_odd_rows_and_other_inputs(spark, odd, folder):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, substring.op10_substring(spark, folder(documents=odd)).collect()), key=repr) == brute_removed(rows)
    extra = odd.withColumn("n_words", F.lit("mine")).withColumn("part", F.lit(1))
    got = substring.remove(extra, ["doc_id"], texts=True)  # no file scan: written first
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"] and got.count() == len(rows)
    assert substring.op10_substring(spark, folder(documents=odd.limit(0))).count() == 0


def test_packing_is_exact():
    import numpy as np

    r = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.sort(r.integers(0, 1 << 63, 999, np.uint64) * np.uint64(2)), np.array([3, 3, 3], np.uint64)):
        assert (substring._unpack(substring._pack(x), len(x)) == x).all()


def crowd():
    """Six hundred words with blocks of words replaced: texts near their neighbours in a chain (but not those further on), all alike in most segments of the words' fingerprints."""
    r = random.Random(11)
    common = [f"w{i}" for i in range(400)]
    r.shuffle(common)
    texts = []
    for k in range(60):
        w = list(common)
        for j in range(k % 20):
            w[20 * j + 3] = f"x{j}a{k // 20 % 3}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("heavy", [16, 2])
def test_crowded_values_lose_no_link(spark, docs, heavy, monkeypatch):
    """Against all pairs that the law of candidates leaves open, with the partners that are tried first cut to none."""
    monkeypatch.setattr(simhash, "NEAR", 0)
    texts = crowd()
    rows = list(enumerate(texts))
    found, near_ones = simhash.similar_members(parts.Parts(docs(*rows)), heavy=heavy)
    got = {x["doc_id"]: x["root"] if x["root"] is not None else -1 - x["n"] for x in found.join(near_ones, "n", "left").collect()}
    words = [t.encode().split() for t in texts]
    f = [(simhash.wide_fingerprint(set(w)), simhash.wide_fingerprint(set(simhash._grams(w, 5))), set(simhash._grams(w, 5))) for w in words]
    bits = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    cut = lambda a: [int(x) >> s & 0xFFFFFFFF for x in a for s in (0, 32)]
    law = 0
    for i in range(len(f)):
        for j in range(i):
            (a, ga, sa), (b, gb, sb) = f[i], f[j]
            close = any((x ^ y).bit_count() <= 1 for x, y in zip(cut(a), cut(b), strict=True))
            if texts[i] != texts[j] and close and bits(a, b) <= simhash.WIDE_BITS and bits(ga, gb) <= simhash.SHINGLE_BITS and len(sa & sb) >= 0.8 * len(sa | sb):
                law += 1
                assert got[i] == got[j], (i, j)
    assert law > 100


def test_crossing_pairs_are_those_of_different_components(spark):
    r = np.random.default_rng(3)
    base = r.integers(-(1 << 62), 1 << 62, 8)
    f = np.tile(base, (60, 1))
    f[:, 4] ^= r.integers(0, 1 << 20, 60)
    f[:, 0] ^= np.where(np.arange(60) % 3 == 0, 1 << 5, 0)
    t = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(f)], "n long, " + ", ".join(f"{c} long" for c in (*simhash._F, *simhash._G)))
    roots = spark.createDataFrame([(i, i % 2) for i in range(40)], "n long, root long")
    got = simhash.crossing(t, roots, heavy=16).collect()
    root = {i: i % 2 if i < 40 else i for i in range(60)}
    assert sorted((x["u"], x["v"]) for x in got) == [(i, j) for i in range(60) for j in range(i + 1, 60) if root[i] != root[j]]


def test_sets_in_blocks_equal_sets(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 64, 60, np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(40, 60), replace=False), r.integers(0, 1 << 64, 3, np.uint64)])) for _ in range(30)]
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    s = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "n long, shingles array<bigint>")
    got = simhash._by_blocks(spark.createDataFrame(pairs, "u long, v long"), s, 0.7)
    want = [(i, j) for i, j in pairs if len(set(sets[i]) & set(sets[j])) >= 0.7 * len(set(sets[i]) | set(sets[j]))]
    assert 0 < len(want) < len(pairs) and sorted(map(tuple, got.collect())) == want


def test_crowds_of_alike_texts_need_few_pairs(spark, docs, monkeypatch):
    """Four hundred texts with up to seven of 150 words replaced: all alike, most not near. Their groups are those of all pairs, but far from all pairs are verified."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(400):
        w = list(base)
        for j in r.sample(range(150), r.randrange(2, 8)):
            w[j] = f"x{k}a{j}"
        texts.append(" ".join(w))
    tried, real = [], simhash._by_blocks

    def counted(pairs, *args):
        tried.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(simhash, "_by_blocks", counted)
    rows = list(enumerate(texts))
    found, near_ones = simhash.similar_members(parts.Parts(docs(*rows)))
    got = {x["doc_id"]: x["root"] if x["root"] is not None else -1 - x["n"] for x in found.join(near_ones, "n", "left").collect()}
    group, pairs, _ = brute_similar(rows)
    assert len({(got[i], g) for i, g in enumerate(group)}) == len(set(group)) == len(set(got.values())) > 100
    assert pairs and sum(tried) < 4 * len(rows)


@pytest.mark.parametrize("similarity,centre", [(0.8, 64), (0.8, 1), (0.55, 64), (0.4, 3)])
def test_crowded_links_find_every_component(spark, similarity, centre, monkeypatch):
    """Against all pairs: two kinds of alike sets in one crowd, sets of other sizes, strangers and some components that are known."""
    monkeypatch.setattr(simhash, "CENTRE", centre)
    r = np.random.default_rng(int(100 * similarity) + centre)
    new = lambda k: r.integers(0, 1 << 64, k, np.uint64)
    sets = []
    for size, many in ((90, 70), (60, 40), (7, 25), (300, 12)):
        base = new(size)
        for _ in range(many):
            x = base.copy()
            at = r.choice(size, r.integers(0, int(size * (1.2 - similarity)) + 1), replace=False)
            x[at] = np.where(r.random(len(at)) < 0.5, base[at - 1], new(len(at)))
            sets.append(set(x.tolist()))
    sets += [set(new(k).tolist()) for k in (1, 2, 40)]
    edges = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    both = [i for i in range(len(sets)) if i % 3]  # a second crowd of some of them
    members = spark.createDataFrame([(1, i) for i in range(len(sets))] + [(2, i) for i in both], "crowd long, n long")
    s = spark.createDataFrame([(i, np.sort(np.array(list(x), np.uint64)).view(np.int64).tolist()) for i, x in enumerate(sets)], "n long, shingles array<bigint>")
    known = sorted(edges)[:5]
    roots = components(spark.createDataFrame(known, "u long, v long")).select(F.col("node").alias("n"), "root")
    star, more = (set(map(tuple, x.collect())) for x in simhash.crowded_links(members, s, roots, similarity))
    assert star <= edges

    def groups(links):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(i for i in range(len(root)) if find(i) == k) for k in set(map(find, root))}

    assert groups({*star, *(more & edges), *known}) == groups(edges)
    assert 5 < len(groups(edges)) < len(sets)
