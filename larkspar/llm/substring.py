"""Substring deduplication with a count-min prefilter (op10).

A window is WINDOW consecutive words. A word goes if a window that covers it also starts in a document with a smaller doc_id. Three passes over the texts:

1. Sketch. Each part of the input builds a count-min sketch of its windows: DEPTH rows of hashed cells.
   The width follows the input (CELLS cells a window), so that the share of false alarms is the same at any size; a part fills few of the cells, so its sketch
   is exchanged sparse, as sorted cell numbers (counts above two say no more than two), packed and compressed to one or two bytes a window. Rows are cut into
   blocks; the sketches of a block are merged by adding up, and each part gets back those of its own cells that the merged sketch counts twice or more.
2. Groups. Each part emits the windows all of whose cells are counted twice or more, once each: a 128-bit key, its least doc_id, and whether the part
   has it in two documents. A merged count is never below the true one, so no repeated window is lost. Keys are grouped by all their bits and each part gets back the
   corpus-wide least doc_id of the keys that do repeat. Windows are told apart by their keys alone, never word by word. Both halves of a key come from 64-bit hashes of the words, so
   two windows are taken for one only if words at the same places have equal hashes, or both halves collide.
3. Removal. Each part marks the words of its windows whose least doc_id is smaller than the document's own.

Parts are ranges of rows that follow from the data, not from how Spark splits the files (see larkspar.llm.parts): each pass may run with other splits, tasks and executors. A task
sends what it has of a part and reads back what the whole part got.

Only packed keys are shuffled, never texts. A window that occurs everywhere is one entry a part, so hot passages make no hot tasks. What goes back to a part is
read by the part's own tasks from the shared folder (any file system pyarrow knows), from one of a bounded number of folders, so nothing that grows with the corpus is broadcast, collected or listed.
An entry of the exchange is what a part has in a block. Blocks grow with the input so that an entry holds about 1,024 windows: entries grow as the input
up to about half a TB (blocks of MOST_BLOCK windows), and parts grow from there (80 windows an entry at 100 TB, where splits of 512 MB save reading a part's rows more than once).

Null text: no words. Null doc_id: larger than every other, so such rows lose what any numbered document has, and nothing to each other. Rows with one doc_id
never remove from each other. Documents under WINDOW words, empty texts and empty tables lose nothing. Other columns are ignored, or passed through by remove().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import groups, map_texts, raw, table
from larkspar.llm.parts import Parts, Side

WINDOW, DEPTH, CELLS = 13, 2, 4
#: Windows a block of the sketch or of the keys is cut for, at least and at most (a block is merged in one task's memory, some 50 bytes a window), and windows after
#: which a task's sketches are sent off (a part may send several).
BLOCK, MOST_BLOCK, FLUSH = 1 << 20, 1 << 24, 1 << 20
NONE = np.iinfo(np.int64).max

#: Odd bases: of the words' hashes, and of the two halves of a window's key; odd multipliers that mix them; and a random number for each byte.
_WORD, _BASES = 0xF1357AEA2E62A9C5, (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4D)
_TURN = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BYTE = np.random.default_rng(13).integers(1, 2**63, 256, np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Bytes hashed at once; words longer than LONG are hashed one by one (sums modulo a power of two are weak for long, regular strings).
CHUNK, LONG = 1 << 19, 32
#: Rows of a batch whose texts are taken out of Arrow at once.
ROWS = 512


@lru_cache(8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below n (a power of two)."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range of values, the sum of value * base ** place in the range, from running sums."""
    up, down = _powers(1 << max(10, len(values).bit_length()), base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    k = (total[ends] - total[starts]) * down[starts]
    return k ^ (k >> np.uint64(32))


def keys_of(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of the keys of all windows over word hashes h."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for i in range(0, n, 1 << 16):
        x = h[i : i + (1 << 16) + window - 1]
        at, y = np.arange(len(x) - window + 1), (x ^ (x >> np.uint64(29))) * _TURN[1]
        for half, values, base, turn in zip(out, (x, y), _BASES, _TURN, strict=True):
            half.append(_sums(values, base, at, at + window) * turn)
    return np.concatenate(out[0]), np.concatenate(out[1])


def _words(buf: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; the buffer ends with white space."""
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    found, lo = [np.zeros(0, np.uint64)], 0
    while lo < len(starts):  # whole words of about a chunk together
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        a, z = int(starts[lo]), int(ends[hi - 1])
        if z - a <= CHUNK:
            found.append(_sums(_BYTE[buf[a:z]], _WORD, starts[lo:hi] - a, ends[lo:hi] - a) * _TURN[0])
        else:
            found.append(np.zeros(1, np.uint64))
        lo = hi
    h = np.concatenate(found)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h, starts, ends


class Piece:
    """Some texts, with their words and windows: of each word its place in the buffer (starts, ends) and, as running number, its text's first word (first); of each
    window that lies in one text its first word (at), text (own) and key halves (a, b)."""

    def __init__(self, texts: list[bytes], window: int):
        self.n, self.window = len(texts), window
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.space = _SPACE[self.buf]
        h, self.starts, self.ends = _words(self.buf, self.space)
        self.offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1)])
        self.first = np.searchsorted(self.starts, self.offsets)
        own = np.repeat(np.arange(self.n), np.diff(self.first))
        a, b = keys_of(h, window)
        self.at = np.flatnonzero(own[: len(a)] == own[window - 1 :]) if len(a) else np.zeros(0, np.int64)
        self.own, self.a, self.b = own[self.at], a[self.at], b[self.at]

    def kept(self, drop: np.ndarray) -> list[bytes]:
        """Each text's words that aren't dropped, joined by single spaces."""
        out = np.where(self.space, np.uint8(32), self.buf)
        show = ~self.space
        show[self.ends] = True  # one space after each word
        if drop.any():
            depth = np.zeros(len(out) + 1, np.int8)
            np.add.at(depth, self.starts[drop], 1)
            np.subtract.at(depth, self.ends[drop] + 1, 1)
            show &= np.cumsum(depth[:-1], dtype=np.int8) == 0
        rows = np.concatenate([[0], np.cumsum(show)])[self.offsets].tolist()
        out = out[show].tobytes()
        return [out[i : max(i, j - 1)] for i, j in zip(rows, rows[1:], strict=False)]


class _Lookup:
    """Membership among sorted numbers: a table of their leading bits settles most, a binary search the rest."""

    def __init__(self, known: np.ndarray, bits: int):
        self.known, self.shift = known, np.uint64(max(0, bits - 22))
        self.table = np.zeros(1 << min(22, bits), bool)
        self.table[known >> self.shift] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x of numbers that are known, and where they stand first among the known."""
        at = np.flatnonzero(self.table[x >> self.shift])
        if not len(self.known) or not len(at):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.known, x[at]), len(self.known) - 1)
        hit = self.known[place] == x[at]
        return at[hit], place[hit]


def _pack(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers, as compressed byte planes of their differences."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    used = 8 if not len(x) else max(1, 8 - next((i for i, c in enumerate(d.any(axis=0)[::-1]) if c), 7))
    return bytes([used]) + pa.compress(np.ascontiguousarray(d[:, :used].T).tobytes(), codec="zstd", asbytes=True)


def _unpack(x: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    used = x[0]
    d = np.zeros((n, 8), np.uint8)
    d[:, :used] = np.frombuffer(pa.decompress(x[1:], decompressed_size=n * used, codec="zstd"), np.uint8).reshape(used, n).T
    return np.cumsum(d.reshape(-1).view("<u8").astype(np.uint64), dtype=np.uint64)


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return a >> np.uint64(64 - bits), b >> np.uint64(64 - bits)


def _parts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, Piece]]:
    """A batch's rows by part, in small groups: part, batch, its rows, and the texts' words and windows."""
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            batch = whole.slice(low, ROWS)
            part, texts = batch.column(batch.schema.get_field_index("__part")).to_numpy(zero_copy_only=False), raw(batch)
            order = np.argsort(part, kind="stable")
            for now, cut in _by_part(part[order]):
                rows = order[cut]
                own = [texts[i] for i in rows.tolist()]
                for i, j in groups(own, CHUNK):
                    yield now, batch, rows[i:j], Piece(own[i:j], window)


def _frame(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"part": pa.int64(), "row": pa.int32(), "blk": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types.get(k, pa.binary())) for i, k in enumerate(names)], names)


def _edges(sorted_numbers: np.ndarray, bits: int, blocks: int) -> list[tuple[int, int, int]]:
    """(block, start, end) of the blocks that sorted numbers of so many bits fall into."""
    places = np.searchsorted(sorted_numbers, np.arange(blocks, dtype=np.uint64) << np.uint64(bits - int(math.log2(blocks)))) if blocks > 1 else np.zeros(1, np.int64)
    ends = [*places[1:].tolist(), len(sorted_numbers)]
    return [(k, i, j) for k, (i, j) in enumerate(zip(places.tolist(), ends, strict=True)) if j > i]


def _sketches(batches: Iterator[pa.RecordBatch], window: int, bits: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Pass 1: (part, row, blk, n, cells) of each part's sketch, and a row -1 that says there is such a part."""
    held: dict[int, tuple[list, list]] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for part, found in held.items():
            out = [(part, -1, part % blocks, 0, b"")]
            for row, several in enumerate(found):
                cells = np.sort(np.concatenate(several))
                if len(cells) > 2:
                    cells = cells[np.concatenate([[True, True], cells[2:] != cells[:-2]])]
                out += [(part, row, k, j - i, _pack(cells[i:j])) for k, i, j in _edges(cells, bits, blocks)]
            yield _frame(out, ["part", "row", "blk", "n", "cells"])
        held.clear()

    for part, _, _, x in _parts(batches, window):
        for several, cells in zip(held.setdefault(part, ([], [])), _cells(x.a, x.b, bits), strict=True):
            several.append(cells)
        size += len(x.a)
        if size > FLUSH:
            yield from send()
            size = 0
    yield from send()


def _numbers(t: pa.Table, k: str) -> np.ndarray:
    """All packed numbers of a column."""
    return np.concatenate([np.zeros(0, np.uint64), *(_unpack(x, m) for x, m in zip(t[k].to_pylist(), t["n"].to_pylist(), strict=True))])


def _joined(t: pa.Table, k: str) -> tuple[np.ndarray, np.ndarray]:
    """The part of each packed number of a block, and the number."""
    return np.repeat(t["part"].to_numpy(), t["n"].to_pylist()), _numbers(t, k)


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
    return ((int(parts[i]), slice(i, j)) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _merged(t: pa.Table) -> pa.Table:
    """Adds up the sketches of one block; for each part, those of its cells with a count of two or more."""
    row, blk = t["row"][0].as_py(), t["blk"][0].as_py()
    names = ["part", "row", "blk", "n", "cells"]
    if row < 0:
        return pa.Table.from_batches([_frame([(p, -1, blk, 0, b"") for p in set(t["part"].to_pylist())], names)])
    parts, cells = _joined(t, "cells")
    order = np.argsort(cells, kind="stable")
    s = cells[order]
    same = s[1:] == s[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    parts, s = parts[order][twice], s[twice]
    order = np.lexsort((s, parts))
    parts, s = parts[order], s[order]
    out = []
    for p, cut in _by_part(parts):
        mine = np.unique(s[cut])
        out.append((p, row, blk, len(mine), _pack(mine)))
    return pa.Table.from_batches([_frame(out, names)])


def _candidates(batches: Iterator[pa.RecordBatch], window: int, bits: int, blocks: int, side: Side) -> Iterator[pa.RecordBatch]:
    """Pass 2: (part, blk, n, keys) of the windows estimated repeated; keys: packed first halves, then second halves, least doc_ids and flags of two documents."""
    held: dict[int, list] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for part, found in held.items():
            a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((d, b, a))
            a, b, d = a[order], b[order], d[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            starts = np.flatnonzero(new)
            lasts = np.concatenate([starts[1:], [len(a)]]) - 1
            many, a, b, d = d[lasts] != d[starts], a[starts], b[starts], d[starts]
            out = [(part, k, j - i, _pack(a[i:j]), b[i:j].tobytes(), pa.compress(d[i:j].tobytes(), codec="zstd", asbytes=True), np.packbits(many[i:j]).tobytes()) for k, i, j in _edges(a, 64, blocks)]
            yield _frame(out, ["part", "blk", "n", "a", "b", "d", "many"])
        held.clear()

    for part, batch, rows, x in _parts(batches, window):
        if not len(x.a):
            continue
        twice = side.of(part)
        at = np.arange(len(x.a))
        for row in range(DEPTH):
            at = at[twice[row].find(_cells(x.a[at], x.b[at], bits)[row])[0]]
        if len(at):
            held.setdefault(part, []).append((x.a[at], x.b[at], _ids(batch)[rows][x.own[at]]))
            size += len(at)
        if size > FLUSH:
            yield from send()
            size = 0
    yield from send()


def _twice(t: pa.Table, bits: int) -> list[_Lookup]:
    rows = t["row"].to_numpy()
    return [_Lookup(np.sort(_numbers(t.filter(pa.array(rows == r)), "cells")), bits) for r in range(DEPTH)]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("__id")).fill_null(NONE).to_numpy(zero_copy_only=False)


def _least(t: pa.Table) -> pa.Table:
    """Groups the keys of one block by all 128 bits; for each part, its keys that repeat, with their least doc_id of all."""
    n = t["n"].to_pylist()
    parts, a = _joined(t, "a")
    b = np.concatenate([np.frombuffer(x, np.uint64) for x in t["b"].to_pylist()])
    d = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=8 * m, codec="zstd"), np.int64) for x, m in zip(t["d"].to_pylist(), n, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(t["many"].to_pylist(), n, strict=True)]).astype(bool)
    order = np.lexsort((b, a))
    parts, a, b, d, many = parts[order], a[order], b[order], d[order], many[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    sizes = np.diff(starts, append=len(a))
    least = np.repeat(np.minimum.reduceat(d, starts), sizes)
    repeats = np.repeat((sizes > 1) | np.logical_or.reduceat(many, starts), sizes)
    parts, a, b, least = parts[repeats], a[repeats], b[repeats], least[repeats]
    order = np.lexsort((b, a, parts))
    parts, a, b, least = parts[order], a[order], b[order], least[order]
    out = [(p, cut.stop - cut.start, _pack(a[cut]), b[cut].tobytes(), pa.compress(least[cut].tobytes(), codec="zstd", asbytes=True)) for p, cut in _by_part(parts)]
    return pa.Table.from_batches([_frame(out, ["part", "n", "a", "b", "d"])])


def _removed(batches: Iterator[pa.RecordBatch], window: int, side: Side, columns: list[str], texts: bool) -> Iterator[pa.RecordBatch]:
    """Pass 3: for each row, its columns, number of words, of removed ones, and the kept words: their SHA-256 or text."""
    for part, batch, at_rows, x in _parts(batches, window):
        drop = np.zeros(len(x.starts), bool)
        if len(x.a):
            look, kb, kd = side.of(part)
            hit, place = look.find(x.a)
            ok = kb[place] == x.b[hit]
            for k in np.flatnonzero(~ok).tolist():  # keys that share their first half
                end = int(np.searchsorted(look.known, x.a[hit[k]], "right"))
                found = np.flatnonzero(kb[place[k] : end] == x.b[hit[k]])
                if len(found):
                    ok[k], place[k] = True, place[k] + found[0]
            gone = x.at[hit[ok & (kd[place] < _ids(batch)[at_rows][x.own[hit]])]]
            if len(gone):
                cover = np.zeros(len(drop) + 1, np.int32)
                np.add.at(cover, gone, 1)
                np.subtract.at(cover, gone + window, 1)
                drop = np.cumsum(cover[:-1]) > 0
        lost = np.concatenate([[0], np.cumsum(drop)])[x.first]
        out = [t.decode("utf-8", "replace") if texts else hashlib.sha256(t).hexdigest() for t in x.kept(drop)]
        rows = batch.take(pa.array(at_rows))
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in columns] + [pa.array(np.diff(x.first)), pa.array(np.diff(lost)), pa.array(out, pa.string())], [*columns, "n_words", "n_removed", "kept_text" if texts else "kept_sha256"])


def _repeats(t: pa.Table) -> tuple[_Lookup, np.ndarray, np.ndarray]:
    n = t["n"].to_pylist()
    a = _numbers(t, "a")
    b = np.concatenate([np.frombuffer(x, np.uint64) for x in t["b"].to_pylist()])
    d = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=8 * m, codec="zstd"), np.int64) if m else np.zeros(0, np.int64) for x, m in zip(t["d"].to_pylist(), n, strict=True)])
    order = np.lexsort((b, a))
    return _Lookup(a[order], 64), b[order], d[order]


def _power(x: float) -> int:
    """The power of two that is x or the next above; 1 at least."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def remove(docs: DataFrame, columns: list[str], window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Of each row of docs (doc_id, text, ...): the named columns, n_words, n_removed, and kept_sha256 (or kept_text, if texts)."""
    parts = Parts(docs)
    docs, part = parts.df, parts.column.alias("__part")
    n = max(1 << 16, parts.total // 6)  # about so many windows
    blocks = _power(n / min(MOST_BLOCK, max(BLOCK, 1024 * 6 * n // parts.bytes)))
    bits = max(math.ceil(math.log2(n * CELLS)), int(math.log2(blocks)) + 1)
    thin = docs.select(part, F.col("doc_id").cast("long").alias("__id"), "text")
    sent = map_texts(thin, lambda x: _sketches(x, window, bits, blocks), "part long, row int, blk long, n long, cells binary")
    merged = sent.groupBy("row", "blk").applyInArrow(_merged, "part long, row int, blk long, n long, cells binary")
    cells = parts.sent_back(merged, "cells")
    side = Side(cells.path, parts.buckets, lambda t: _twice(t, bits))
    found = map_texts(thin, lambda x: _candidates(x, window, bits, blocks, side), "part long, blk long, n long, a binary, b binary, d binary, many binary")
    least = found.groupBy("blk").applyInArrow(_least, "part long, n long, a binary, b binary, d binary")
    # parts without a key that repeats have an empty row too, so that a part that is missing means an error
    all_parts = cells.df.where("row = -1").select("part", F.lit(0).cast("long").alias("n"), *(F.lit(b"").alias(c) for c in "abd"))
    keys = parts.sent_back(least.unionByName(all_parts), "keys")
    last = Side(keys.path, parts.buckets, _repeats)
    cells.drop()
    whole = docs.select(part, F.col("doc_id").cast("long").alias("__id"), "text", *[c for c in columns if c != "text"])
    fields = [f for c in columns for f in docs.schema.fields if f.name == c]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long, n_removed long", "kept_text string" if texts else "kept_sha256 string"])
    return map_texts(whole, lambda x: _removed(x, window, last, columns, texts), schema)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), ["doc_id"])


OP10_SQL = (
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
s AS (SELECT doc_id, i, concat_ws(' ', x, """ + ", ".join(f"lead(x, {k}) OVER o" for k in range(1, WINDOW)) + r""") AS s, lead(x, 12) OVER o IS NOT NULL AS whole FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT s, min(doc_id) AS first FROM s WHERE whole GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM s JOIN m USING (s) WHERE whole AND first < doc_id),
k AS (SELECT doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN x END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
)
