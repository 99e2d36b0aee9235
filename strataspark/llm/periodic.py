"""Periodic runs of words, by tiles of each period octave: solved apart by boundary Z-values, stitched by document and period.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4q) that neither neighbour extends.
Octave k has the periods q with B = 2^k <= q < 2B. Its tiles are [c - B, c + 4B) round each boundary c, a multiple of B.
The first boundary in a run is followed by three of its periods, so the block of B words at c comes again at c + q: a
test of all c and q of an octave is one comparison of an array of block names. Where it holds, the boundary's Z-values
(the common extension of c and c + q onwards, and of both backwards) give the part of the run in the tile, and parts of
one period that share q words are one run. Periods whose root is itself a repetition are left out by the least period of
the root. Names of blocks are 64-bit hashes, which only propose; every extension compares words.

A document of up to SPAN words has all its tiles in one task, which stitches them before anything is shuffled. A longer
one is exploded into pieces of tiles (SPAN boundaries and a border for the small octaves, TILES tiles for each group of
large ones), which are shuffled, solved apart and stitched by windows over (document, period).

Defined results: null or empty text or white space only has no words and no runs. A null doc_id has no checksum, so its
words are never made periodic. Repeated rows get equal results, each its own row. An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, mix, stored

SPAN = 1 << 14
TILES = 4
LEAST, TIMES = 6, 4
#: Words of documents that are solved together.
GROUP = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_MORE = pa.schema([("key", pa.binary()), ("text", pa.binary()), ("words", pa.binary()), *((c, pa.int64()) for c in ("at", "low", "high", "first", "last"))])


def words_of(text: bytes, doc_id: int | None) -> list[bytes]:
    """The words, those from some place on made periodic in documents whose checksum ends in 0."""
    words = text.split()  # bytes split at exactly the six white-space bytes
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return words


def numbered(words: list[bytes], first: int = 0) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64) + first


# --- tiles -----------------------------------------------------------------------------------------------------------


def _ahead(w: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from a and from b on are the same, up to `most`."""
    got, step = 0, 64
    while got < most:
        m = min(step, most - got)
        differ = w[a + got : a + got + m] != w[b + got : b + got + m]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, step = got + m, step * 4
    return most


def _behind(w: np.ndarray, a: int, b: int, most: int) -> int:
    """The same for the words before a and b."""
    got, step = 0, 64
    while got < most:
        m = min(step, most - got)
        differ = (w[a - got - m : a - got] != w[b - got - m : b - got])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, step = got + m, step * 4
    return most


def _primitive(w: np.ndarray, c: int, q: int) -> bool:
    """Whether the q words at c are no repetition of fewer."""
    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            d = q // r
            if _ahead(w, c, c + d, q - d) == q - d:
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def _tile(w: np.ndarray, c: int, b: int, periods: np.ndarray, out: list[tuple[int, int, int]]) -> None:
    """Appends (period, start, stop) of the parts that the tile round c has of runs with these periods."""
    if len(periods) > 1:
        # The block at c comes again at short distances, so it has their least one as a period, as far as z tells.
        p = int(np.diff(periods).min())
        z = p + _ahead(w, c, c + p, min(4 * b, len(w) - c) - p)
        periods = periods[(periods % p != 0) | (periods > z)]
    for q in map(int, periods):
        ahead = _ahead(w, c, c + q, min(4 * b, len(w) - c) - q)
        back = _behind(w, c, c + q, min(b, c))
        if ahead + back >= q and _primitive(w, c - back, q):
            out.append((q, c - back, c + q + ahead))


def fragments(w: np.ndarray, low: int, high: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Rows of period, start, stop: parts of runs of octaves low to high at boundaries from first up to last, joined where they share a period's words."""
    n, out = len(w), []
    last = n if last is None else last
    name = mix(w.astype(np.uint64) + _STEP)
    for k in range(high + 1):
        b = 1 << k
        if k:
            half = b >> 1
            if len(name) <= half:
                break
            name = mix(name[:-half] * _STEP + mix(name[half:] + np.uint64(k)))
        if k < low or len(name) < b + 1:
            continue
        rows = -(-len(name) // b)
        block = np.zeros(rows * b, dtype=np.uint64)
        block[: len(name)] = name
        block = block.reshape(rows, b)
        lo, hi = first // b, min(-(-last // b), rows - 1)
        again = block[lo + 1 : hi + 1] == block[lo:hi, :1]
        if hi == rows - 1 and hi > lo:
            again[-1, len(name) - (rows - 1) * b :] = False
        at = np.flatnonzero(again.any(1))
        for r in at:
            _tile(w, int(lo + r) * b, b, np.flatnonzero(again[r]) + b, out)
    return stitched(np.array(out, dtype=np.int64).reshape(-1, 3))


def stitched(parts: np.ndarray) -> np.ndarray:
    if not len(parts):
        return parts
    parts = parts[np.lexsort((parts[:, 2], parts[:, 1], parts[:, 0]))]
    q, start, stop = parts.T
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + q * wide) - q * wide
    new = np.ones(len(parts), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (start[1:] > reach[:-1] - q[1:])
    at = np.flatnonzero(new)
    return np.stack([q[at], start[at], np.maximum.reduceat(stop, at)], axis=1)


def octaves(n: int) -> int:
    """The highest octave with a period that n words can hold TIMES times."""
    return (n // TIMES).bit_length() - 1


def whole(runs: np.ndarray) -> np.ndarray:
    return runs[runs[:, 2] - runs[:, 1] >= np.maximum(LEAST, TIMES * runs[:, 0])]


# --- documents -------------------------------------------------------------------------------------------------------


def _result(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result row of a document from its runs (start, period, length)."""
    runs = sorted(runs)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()
    top = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    kept = words
    if runs:
        gone = np.zeros(len(words), dtype=bool)
        for s, q, n in runs:
            gone[s + q : s + n] = True
        kept = [words[i] for i in np.flatnonzero(~gone)]
    best = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def pieces(w: np.ndarray, span: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """at, low, high, first, last (boundaries, from `at` on) and words of the pieces that a document's tiles are dealt to."""
    n, top = len(w), octaves(len(w))
    small = min(top, max(0, span.bit_length() - 4))
    border = 1 << small
    for c in range(0, n, span):
        at = max(0, c - border)
        yield at, 0, small, c - at, min(n, c + span) - at, w[at : c + span + 4 * border]
    for k in range(small + 1, top + 1):
        b = 1 << k
        for c in range(0, n - 2 * b, TILES * b):
            at = max(0, c - b)
            yield at, k, k, c - at, min(n, c + TILES * b) - at, w[at : c + (TILES + 4) * b]


def _scan(span: int):
    """Result rows of documents of up to `span` words; the text and the pieces of longer ones."""

    def held(group: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
        starts = np.cumsum([0, *(len(words) for _, words in group)])
        w = np.zeros(starts[-1], dtype=np.int64)
        for i, (_, words) in enumerate(group):  # no two documents have a number in common
            w[starts[i] : starts[i + 1]] = numbered(words, int(starts[i]))
        got = whole(fragments(w, 0, octaves(max((len(words) for _, words in group), default=0))))
        own = np.searchsorted(starts, got[:, 1], side="right") - 1
        runs: dict[int, list] = {}
        for i, (q, s, e) in zip(own, got.tolist()):
            runs.setdefault(int(i), []).append((s - int(starts[i]), q, e - s))
        return [_result(doc_id, words, runs.get(i, [])) for i, (doc_id, words) in enumerate(group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple], more: list[tuple]) -> pa.RecordBatch:
            rows = [*((*r, *(None,) * len(_MORE)) for r in rows), *((m[0], *(None,) * (len(_ARROW) - 1), *m[1:]) for m in more)]
            schema = pa.schema([*_ARROW, *_MORE])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            group, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or b"", doc_id)
                if len(words) > span:
                    key = hashlib.blake2b(text, digest_size=16, key=str(doc_id).encode()).digest()
                    yield out([], [(doc_id, key, text, None, *(None,) * 5)])
                    for at, low, high, first, last, w in pieces(numbered(words), span):
                        yield out([], [(None, key, None, w.astype(np.int32).tobytes(), at, low, high, first, last)])
                    continue
                group.append((doc_id, words))
                size += len(words)
                if size >= GROUP:
                    yield out(held(group), [])
                    group, size = [], 0
            if group:
                yield out(held(group), [])

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, at, low, high, first, last, data in zip(*(c.to_pylist() for c in batch.columns)):
            got = fragments(np.frombuffer(data, np.int32).astype(np.int64), low, high, first, last)
            got[:, 1:] += at
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.binary()), *(pa.array(c, pa.int64()) for c in got.T)], names=["key", "period", "start", "stop"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_result(i, words_of(text, i), [(r["start"], r["period"], r["length"]) for r in runs or []]) for i, text, runs in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def periodic_runs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), and digests of all runs and of the text without their repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = RESULT + ", key binary, text binary, words binary, at long, low long, high long, first long, last long"
    seen = stored(bounded(rows).mapInArrow(_scan(span), schema), "periodic")
    tiles = seen.where("words is not null").dropDuplicates(["key", "at", "low"]).select("key", "at", "low", "high", "first", "last", "words")
    parts = tiles.mapInArrow(_solve, "key binary, period long, start long, stop long")
    w = Window.partitionBy("key", "period").orderBy("start", "stop")
    parts = parts.withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("g", F.sum(F.when(F.col("start") > F.col("reach") - F.col("period"), 1).otherwise(0)).over(w))
    joined = parts.groupBy("key", "period", "g").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    joined = joined.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    of = joined.groupBy("key").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))
    long_ = seen.where("text is not null").select("doc_id", "key", "text").join(of, "key", "left").select("doc_id", "text", "runs")
    short = seen.where("runs_sha256 is not null").select(*(f.name for f in _ARROW))
    return short.union(bounded(long_).mapInArrow(_finish, RESULT))
