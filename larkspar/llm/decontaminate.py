"""Benchmark decontamination by spaced seeds (op6). DataFrame operations only.

Words are ASCII letters and digits (A-Z lower-cased) and everything beyond ASCII; punctuation and layout don't count. A spaced seed is the hash of the words at
fixed positions of a window; words at the positions between don't matter, so a seed still matches where some of those have been replaced. MASKS are chosen so
that for any regular distance of five words or more between replacements one of them finds places to match, and SHORT for what is left.

The documents' seeds are computed within the scan's own stage. While the benchmark has at most BROADCAST_SEEDS seeds (three numbers each; its items' words are of
the same order), they are joined there to its broadcast seeds, and only matches leave the stage, each verified in place: of the words around the seed, up to REACH,
that both texts have at that alignment, at least SHARE must be equal, and there must be MIN_WORDS of them; a window of MIN_WORDS to REACH words that holds the seed will do, so that
a run of MIN_WORDS words within other text counts as it does at a text's edge (the SQL knows the first kind of window only). Beyond that size, rows of (row key, place, seed) are shuffled
to the benchmark's seeds, and the alignments that meet go back to their documents to be verified in the same way. Matches are grouped by document and item,
combined before the shuffle.

Items under MIN_WORDS words can't be told from chance in parts, so they count whole and unchanged only: items of SHORTEST words or more anywhere in a text, shorter ones where they are all
of it. Each length that occurs has a seed of its own, the hash of all its words. Null or empty texts are clean; a null item text has no seeds. Null ids stay null:
their matches are reported with a null id. Repeated rows are one finding in findings(), and clean() removes each of them. Empty tables give an empty result or
leave the documents unchanged. Other columns are ignored, or passed through by clean().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import alnum_words, identified, keep, table
from larkspar.tables import spread

MASKS = ((0, 1, 3, 5, 6, 8), (0, 2, 3, 7, 8, 10))
#: Found by search: with it, and each mask up to its own last place, every pattern of replacements that SHARE allows in 13 to 20 words leaves a seed. The SQL has MASKS only.
SHORT = (0, 2, 3, 4, 6)
MIN_WORDS, REACH, SHARE, SHORTEST = 13, 20, 0.8, 5
SPAN = 1 + max(map(max, MASKS))
BROADCAST_SEEDS = 1_000_000


def _hashed(text: str | Column) -> Column:
    return F.transform(alnum_words(F.col(text) if isinstance(text, str) else text), lambda w: F.xxhash64(w))


def _at(words: str, place: Column) -> Column:
    return F.get(F.col(words), place)


def _seeds(words: str, place: str, lengths: list[int]) -> Column:
    """The seed of each mask at a place, as an array, and that of each length of short items; null for a mask that goes beyond the last word; a mask's number is part of its seed."""
    fits = lambda mask: F.col(place) < F.size(words) - max(mask)
    found = [F.when(fits(mask), F.xxhash64(F.lit(m), *(_at(words, F.col(place) + p) for p in mask))) for m, mask in enumerate((*MASKS, SHORT))]
    for n in lengths:
        ok = F.col(place) <= F.size(words) - n if n >= SHORTEST else F.size(words) == n
        found.append(F.when(ok, F.xxhash64(F.lit(100 + n), *(_at(words, F.col(place) + p) for p in range(n)))))
    return F.array(*found)


def _places(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """A row for each place a seed can start at. The outer explode keeps Spark from testing the word array in a filter, which would build it twice."""
    last = F.size(words) - min(1 + min(map(max, (*MASKS, SHORT))), *lengths, 99)
    got = df.withColumn("place", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return got.withColumn("seed", F.explode_outer(F.when(F.col("place").isNotNull(), _seeds(words, "place", lengths))))


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(iid, item_id, item): each item and its word hashes; (seed, iid, start): its seeds and their places; the lengths of items under MIN_WORDS words."""
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("iid"), "item_id", _hashed("text").alias("item")).where(F.size("item") > 0)
    items = keep(rows.dropDuplicates(["iid"]), "items")
    lengths = sorted(r[0] for r in items.where(F.size("item") < MIN_WORDS).select(F.size("item")).distinct().collect())  # under MIN_WORDS numbers
    found = _places(items, "item", []).where(F.size("item") >= MIN_WORDS).where("seed is not null").select("seed", "iid", F.col("place").alias("start"))
    for n in lengths:
        found = found.unionByName(items.where(F.size("item") == n).select(F.xxhash64(F.lit(100 + n), *(_at("item", F.lit(p)) for p in range(n))).alias("seed"), "iid", F.lit(0).alias("start")))
    return items, keep(found.distinct(), "seeds"), lengths


def _verified(met: DataFrame) -> DataFrame:
    """Rows with words, item, shift (where the item's first word would stand) and start (a seed's place in the item): those that agree around the seed, with equal_words of the whole."""
    mid = F.col("start") + SPAN // 2
    low = F.greatest(F.lit(0), -F.col("shift"), F.least(mid - REACH // 2, F.size("item") - REACH))
    high = F.least(F.size("item"), F.size("words") - F.col("shift"), F.greatest(mid + REACH // 2, F.lit(REACH)))
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("words") - F.col("shift"))
    met = met.withColumn("low", low).withColumn("high", high).withColumn("first", first).withColumn("last", last)

    def equal(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.sequence(a, b - 1), lambda i: _at("item", i) == _at("words", i + F.col("shift"))))

    def good(a: Column, b: Column) -> Column:
        return (b - a >= MIN_WORDS) & (equal(a, b) >= SHARE * (b - a))

    def some(a: Column, b: Column, f: Callable[[Column], Column]) -> Column:
        return F.when(a <= b, F.exists(F.sequence(a, b), f)).otherwise(False)

    least, end = F.greatest(F.col("first"), F.col("start") + SPAN - REACH), F.least(F.col("start") + SPAN, F.col("last"))
    short = some(least, F.col("start"), lambda a: some(F.greatest(a + MIN_WORDS, end), F.least(a + REACH, F.col("last")), lambda b: good(a, b)))
    whole = (F.col("first") == 0) & (F.col("last") == F.size("item")) & (equal(F.col("first"), F.col("last")) == F.size("item"))
    met = met.where(F.when(F.size("item") < MIN_WORDS, whole).otherwise(good(F.col("low"), F.col("high")) | short))
    return met.withColumn("equal_words", equal(F.col("first"), F.col("last")))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified matches of (doc_id, text) rows: doc_id, the row's identity rid, item_id, where the item's first word would stand, its words and how many are equal."""
    items, seeds, lengths = benchmark_seeds(benchmark)
    docs, rid = identified(docs)
    own = spread(docs.select("doc_id", rid.alias("rid"), "text"))
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        places = _places(own.select("doc_id", "rid", _hashed("text").alias("words")), "words", lengths)
        met = places.join(F.broadcast(seeds), "seed").withColumn("shift", F.col("place") - F.col("start")).join(F.broadcast(items), "iid")
    else:
        places = _places(own.select("rid", _hashed("text").alias("words")), "words", lengths).select("rid", "place", "seed")
        hits = places.join(seeds.hint("shuffle_hash"), "seed").select("rid", "iid", "start", (F.col("place") - F.col("start")).alias("shift")).distinct()
        hits = keep(hits, "hits")
        met = own.hint("shuffle_merge").join(hits, "rid").withColumn("words", _hashed("text")).drop("text").join(items, "iid")
    return _verified(met).select("doc_id", "rid", "item_id", F.col("shift").alias("start"), F.size("item").alias("item_words"), "equal_words")


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, equal_words, start) for each document and item of which it holds a passage: of its alignments, that with most equal words, then the first."""
    best = F.max(F.struct("equal_words", (-F.col("start")).alias("s"))).alias("best")
    got = matches(docs, benchmark).groupBy("doc_id", "item_id", "item_words").agg(best)
    return got.select("doc_id", "item_id", "item_words", F.col("best.equal_words").alias("equal_words"), (-F.col("best.s")).alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage; columns stay."""
    docs, rid = identified(docs)
    hit = matches(docs, benchmark).select(F.col("rid").alias("__rid")).distinct()
    return docs.withColumn("__rid", rid).join(keep(hit, "contaminated"), "__rid", "left_anti").drop("__rid")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    parts = []
    for m, mask in enumerate(MASKS):
        parts.append(f"SELECT {{id}}, k, w, concat_ws(' ', {m}, {', '.join(f'w[k + {p + 1}]' for p in mask)}) AS seed FROM {{rows}}")
    seeds = " UNION ALL ".join(parts)
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, {word}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({low}, {word}) AS w FROM benchmark),
dk AS (SELECT doc_id, w, unnest(range(len(w) - {SPAN - 1})) AS k FROM d),
bk AS (SELECT item_id, w, unnest(range(len(w) - {SPAN - 1})) AS k FROM b WHERE len(w) >= {MIN_WORDS}),
ds AS ({seeds.format(id="doc_id", rows="dk")}),
bs AS ({seeds.format(id="item_id", rows="bk")}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.k - bs.k AS shift, bs.k AS start, ds.w AS dw, bs.w AS bw FROM ds JOIN bs USING (seed)),
spans AS (SELECT *, greatest(0, -shift, least(start + {SPAN // 2 - REACH // 2}, len(bw) - {REACH})) AS low, least(len(bw), len(dw) - shift, greatest(start + {SPAN // 2 + REACH // 2}, {REACH})) AS high,
    greatest(0, -shift) AS lo, least(len(bw), len(dw) - shift) AS hi FROM hits),
counted AS (SELECT *, len(list_filter(range(low, high), lambda i: bw[i + 1] = dw[i + shift + 1])) AS near, len(list_filter(range(lo, hi), lambda i: bw[i + 1] = dw[i + shift + 1])) AS eq
    FROM spans WHERE high - low >= {MIN_WORDS}),
good AS (SELECT doc_id, item_id, len(bw)::INT AS item_words, eq::INT AS equal_words, shift::INT AS start, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY eq DESC, shift) AS r
    FROM counted WHERE near >= {SHARE} * (high - low))
SELECT doc_id, item_id, item_words, equal_words, start FROM good WHERE r = 1
"""


OP6_SQL = _sql()
