"""Quality rules by distribution divergence (op3).

Base rules: too few words, or too many words in windows that repeat within the text. The method's verdict: a document's histograms of character classes and of
its language's common words are compared, by Jensen-Shannon distance (base 2, 0 to 1), to references for its language; a document far from either is rejected.
Histograms of short texts are noise, so each comparison has a minimum length.

References: for each language, the mean of the normalised histograms of all its documents that pass the base rules and the length guards. They are counted over
the whole corpus in a first pass (fixed-point sums, so reruns agree to the bit); a language is compared only if MIN_REFERENCE such documents exist. Languages
without a list of common words share one reference "other" for character classes and have no word comparison. What is collected is one row for each
of the (at most five) languages and bin. The second pass scores and filters, row by row; nothing is shuffled but the sums.

Texts above LONG bytes are worked on in pieces, so that memory stays at a few times the text whatever it repeats; their windows and lines are told apart by 128 bits of hash instead of byte by
byte.

Null or empty text: no words, fails. Null or unknown lang: "other". Repeated rows get equal verdicts. Without documents there are no references and no rows.
Other columns are ignored, or passed through unchanged by filter_quality().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import ALNUM_BYTES, map_texts, raw, table

#: Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus ne pas il ce se sont avec aux son elle mais ou nous cette d l s été leur fait être a ont ses comme sa",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era",
}
LANGS = (*COMMON, "other")
WORDS = {lang: [w.encode() for w in COMMON.get(lang, "").split()] for lang in LANGS}
_KNOWN = {lang: frozenset(w) for lang, w in WORDS.items()}
SYMBOLS = b"#*$%&|<>"
#: Bytes above which a text is worked on in pieces of CHUNK bytes.
LONG, CHUNK = 4 << 20, 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
MIN_N_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Length guards, in characters and words; documents a reference needs; and the largest distances that are kept.
MIN_CHARS, MIN_COMPARED, MIN_REFERENCE, MAX_CLASS, MAX_WORDS = 300, 100, 20, 0.32, 0.36
ONE = 1 << 30
CLASSES = ("space", "lower", "upper", "digit", "beyond", "stop", "symbol", "other")


def _class_of(b: int) -> int | None:
    c = chr(b)
    if b >= 0x80:
        return 4 if b >= 0xC0 else None  # a character counts at its first byte
    if c in " \t\n\r\x0b\x0c":
        return 0
    if c.isalnum():
        return 3 if c.isdigit() else 1 if c.islower() else 2
    return 5 if c in ".,;:!?'\"()-" else 6 if b in SYMBOLS else 7


_SYMBOLS = np.frombuffer(SYMBOLS, np.uint8)
_IN_WORDS = np.array([b for b in range(256) if not 0x80 <= b < 0xC0 and bytes([b]) not in b" \t\n\r\x0b\x0c"])
_CLASS = np.array([[float(_class_of(b) == k) for k in range(len(CLASSES))] for b in range(256)])
_MULT = np.random.default_rng(8).integers(0, 2**63, REPEAT_WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text cut at white space into pieces of about so many bytes."""
    i = 0
    while i < len(text):
        m = _SPACE.search(text, i + size)
        j = m.start() if m else len(text)
        yield text[i:j]
        i = j


def _byte_counts(text: bytes) -> np.ndarray:
    return sum((np.bincount(np.frombuffer(text, np.uint8, min(CHUNK, len(text) - i), i), minlength=256) for i in range(0, len(text), CHUNK)), np.zeros(256, np.int64))


def _window_keys(h: np.ndarray, window: int, multipliers: np.ndarray) -> np.ndarray:
    n = len(h) - window + 1
    k = np.zeros(n, np.uint64)
    for j in range(window):
        k += h[j : j + n] * multipliers[j]
    return k


def _long_repeats(text: bytes, window: int = REPEAT_WINDOW) -> tuple[int, int]:
    """n_words and n_repeat_words of a long text in little memory (some 60 bytes a word): windows are told apart by 128 bits of hash."""

    def hashed(f) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(np.array([f(w) & 0xFFFFFFFFFFFFFFFF for w in p.split()], np.uint64) for p in _pieces(text))])

    h = hashed(hash)
    n_words = len(h)
    if n_words <= window:
        return n_words, 0
    k = _window_keys(h, window, _MULT)
    del h
    s = np.sort(k)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    del s
    if not len(twice):
        return n_words, 0
    place = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
    at = np.flatnonzero(twice[place] == k)
    del place
    k, other = k[at], _window_keys(hashed(xxhash.xxh3_64_intdigest), window, _MULT[::-1])[at]
    order = np.lexsort((other, k))
    same = (k[order][1:] == k[order][:-1]) & (other[order][1:] == other[order][:-1])
    at = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    cover = np.zeros(n_words + 1, np.int32)
    cover[at] += 1
    cover[at + window] -= 1
    return n_words, int((np.cumsum(cover) > 0).sum())


def n_and_repeats(text: bytes) -> tuple[int, int]:
    """n_words and n_repeat_words."""
    if len(text) > LONG:
        return _long_repeats(text)
    words = text.split()
    return len(words), repeated_words(words)


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one; in long texts told apart by 128 bits of hash."""
    if len(text) <= LONG:
        lines = [x for x in text.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))
    found, i = [], 0
    while i < len(text):  # whole lines of about a piece together
        j = text.find(b"\n", i + CHUNK)
        j = len(text) if j < 0 else j
        found.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in text[i:j].split(b"\n") if x.strip()), "<u8").reshape(-1, 2))
        i = j + 1
    h = np.concatenate([np.zeros((0, 2), "<u8"), *found])
    order = np.lexsort((h[:, 0], h[:, 1]))
    return int((h[order][1:] == h[order][:-1]).all(axis=1).sum())


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that stand twice or more in the text. Hashes find the windows, comparing them settles it."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    k = _window_keys(h, window, _MULT)
    s = np.sort(k)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(k, twice))
    keys = [tuple(words[i : i + window]) for i in at.tolist()]
    times = Counter(keys)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, key in zip(at.tolist(), keys, strict=True):
        if times[key] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n, repeats = n_and_repeats(text)
    counts = _byte_counts(text)
    return n, int(counts[_IN_WORDS].sum()), int(counts[_SYMBOLS].sum()), _dup_lines(text), repeats


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_N_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def histograms(text: bytes, lang: str) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Normalised histograms of character classes, and of common words with all others as one last bin; None where the text is too short or the list empty."""
    classes = _byte_counts(text) @ _CLASS
    chars = classes.sum()
    known = _KNOWN[lang]
    c = classes / chars if chars >= MIN_CHARS else None
    n, times = 0, Counter()
    for p in (text,) if len(text) <= LONG else _pieces(text):
        words = p.translate(ALNUM_BYTES).split() if known else []
        n += len(words)
        times.update(filter(known.__contains__, words))
    if n < MIN_COMPARED:
        return c, None
    counts = [times[w] for w in WORDS[lang]]
    return c, np.array([*counts, n - sum(counts)]) / n


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def _langs(batch: pa.RecordBatch) -> list[str]:
    return [x if x in COMMON else "other" for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, bin, n, total): sums of the histograms of the documents that make the references, for this partition."""
    total: dict[tuple[str, int], np.ndarray] = {}
    n: Counter = Counter()
    for b in batches:
        for text, lang in zip(raw(b), _langs(b), strict=True):
            if failed(*n_and_repeats(text)):
                continue
            for kind, h in enumerate(histograms(text, lang)):
                if h is not None:
                    total[lang, kind] = total.get((lang, kind), 0) + np.rint(h * ONE).astype(np.int64)
                    n[lang, kind] += 1
    rows = [(lang, kind, i, n[lang, kind], int(x)) for (lang, kind), t in total.items() for i, x in enumerate(t)]
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "kind", "bin", "n", "total"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))


def references(docs: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """By language and kind (0: character classes, 1: common words) the reference histogram. Bounded: five languages, under a hundred bins."""
    sums = map_texts(docs.select("text", "lang"), _sums, "lang string, kind int, bin int, n long, total long").groupBy("lang", "kind", "bin").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)")))
    found: dict[tuple[str, int], dict[int, float]] = {}
    for lang, kind, i, n, total in sums.collect():
        if n >= MIN_REFERENCE:
            found.setdefault((lang, kind), {})[i] = float(total) / n
    out = {}
    for k, bins in found.items():
        h = np.array([bins[i] for i in range(len(bins))])
        out[k] = h / h.sum()
    return out


def distances(text: bytes, lang: str, refs: dict[tuple[str, int], np.ndarray]) -> tuple[float | None, float | None]:
    return tuple(js_distance(h, refs[lang, kind]) if h is not None and (lang, kind) in refs else None for kind, h in enumerate(histograms(text, lang)))  # type: ignore[return-value]


def _kept(is_failed: bool, d: tuple[float | None, float | None]) -> bool:
    return not is_failed and (d[0] is None or d[0] <= MAX_CLASS) and (d[1] is None or d[1] <= MAX_WORDS)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def score(docs: DataFrame, refs: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """(doc_id, base counts, base_failed, both distances (null: not compared), kept) for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lang in zip(raw(b), _langs(b), strict=True):
                x = base(text)
                bad, d = failed(x[0], x[4]), distances(text, lang, refs)
                out.append((*x, bad, *d, _kept(bad, d)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES))], ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text", "lang"), rows, f"doc_id {ids}, {FIELDS}")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    refs = references(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text, lang in zip(raw(b), _langs(b), strict=True):
                bad = failed(*n_and_repeats(text))
                keep.append(not bad and _kept(bad, distances(text, lang, refs)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, rows, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, references(docs))
    return got.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _sql() -> str:
    """The same rows by SQL: base counts, references and distances."""
    bins = ", ".join(f"('{lang}', {i}, '{w.decode()}')" for lang in COMMON for i, w in enumerate(WORDS[lang]))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    keepers = (r"[^ \t\n\r\x0b\x0c]", "[^a-z]", "[^A-Z]", "[^0-9]", r"[\x00-\x7F]", r"""[^.,;:!?''"()-]""", "[^#*$%&|<>]")
    counts = ", ".join(f"length(regexp_replace(text, '{p}', '', 'g'))" for p in keepers)
    lead = ", ".join(f"lead(x, {k}) OVER o" for k in range(1, REPEAT_WINDOW))
    div = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + r) / 2)) ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON)}) THEN lang ELSE 'other' END AS lang FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM d),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t),
s AS (SELECT doc_id, i, concat_ws(' ', x, {lead}) AS s FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(x, {REPEAT_WINDOW - 1}) OVER o IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WINDOW})) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM s) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT t.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM t LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < {MIN_N_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
classes AS (SELECT doc_id, lang, base_failed, length(text) AS n, [{counts}] AS k FROM f WHERE length(text) >= {MIN_CHARS}),
hc AS (SELECT doc_id, lang, base_failed, 0 AS kind, i AS bin, (CASE WHEN i < 7 THEN k[i + 1] ELSE n - list_sum(k) END)::DOUBLE / n AS p FROM classes, range(8) r(i)),
common(lang, bin, word) AS (VALUES {bins}),
fw AS (SELECT doc_id, lang, base_failed, len(a) AS n FROM f WHERE len(a) >= {MIN_COMPARED} AND lang <> 'other'),
seen AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(a) AS x FROM f) GROUP BY ALL),
hw0 AS (SELECT fw.*, bin, coalesce(k, 0) AS k FROM fw JOIN common USING (lang) LEFT JOIN seen ON seen.doc_id = fw.doc_id AND x = word),
hw AS (SELECT doc_id, lang, base_failed, 1 AS kind, bin, k::DOUBLE / n AS p FROM hw0 UNION ALL SELECT doc_id, lang, base_failed, 1, 1000, (n - sum(k))::DOUBLE / n FROM hw0 GROUP BY doc_id, lang, base_failed, n),
h AS (SELECT * FROM hc UNION ALL SELECT * FROM hw),
r0 AS (SELECT lang, kind, bin, sum(round_even(p * {ONE}, 0)::BIGINT)::DOUBLE / count(*) AS r FROM h WHERE NOT base_failed GROUP BY ALL HAVING count(*) >= {MIN_REFERENCE}),
r AS (SELECT lang, kind, bin, r / sum(r) OVER (PARTITION BY lang, kind) AS r FROM r0),
dist AS (SELECT doc_id, kind, sqrt(greatest(0, sum({div.format("p")} + {div.format("r")}) / 2)) AS d FROM h JOIN r USING (lang, kind, bin) GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(x.d, 6) AS class_distance, round(y.d, 6) AS word_distance,
    NOT base_failed AND coalesce(x.d <= {MAX_CLASS}, true) AND coalesce(y.d <= {MAX_WORDS}, true) AS kept
FROM f LEFT JOIN dist x ON x.doc_id = f.doc_id AND x.kind = 0 LEFT JOIN dist y ON y.doc_id = f.doc_id AND y.kind = 1
"""


OP3_SQL = _sql()
