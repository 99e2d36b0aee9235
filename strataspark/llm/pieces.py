"""SentencePiece encoding and decoding of a BPE model over a lattice of pieces.

Texts are cut into units that no merge can cross, which is proved offline: every piece of the model must itself be one
unit. Each different unit that a task keeps is encoded once. Its lattice is relational: substrings of at most the longest
piece's length are exploded and equi-joined to the piece table, which gives edges (start, end, score, piece), grouped by
unit. For a BPE model the fold isn't the best-sum (Viterbi) path, which the library doesn't take either, but the
library's own order of merges over the same lattice: each step joins, in every unit, the two neighbours whose edge has
the highest score, the leftmost on ties. Characters without a piece fall back to bytes. Decoding looks ids up in the
piece table and joins them.

Explode, join, group and fold run on column arrays in Arrow batches; the same with Spark's own explode, join,
collect_list and aggregate() took several times the limits (see the README). A task keeps the ids of the units that it
has met, at most KEPT of them and KEPT_CHARS characters, and then starts anew, so that nothing is shuffled or broadcast
but the piece table, and a row's ids, all of them, come out beside the row. They are decoded again and held against the
text.

Defined results: null or empty text has no pieces. Every row is encoded for itself, whatever its doc_id (repeated rows,
copies in a mix, rows without one); only summary() counts rows of one doc_id together. The model must neither change characters nor drop or collapse spaces, or the call fails.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunks, mapped, mix

SPACE = "\u2581"
#: A unit: a run of letters and their marks, or of other characters, with the spaces before it; or spaces alone.
UNIT = rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^\p{{L}}\p{{M}}{SPACE}]+|{SPACE}+"
#: Longer units are folded one by one with a heap.
STEPWISE_CHARS = 128
KEPT, KEPT_CHARS = 100_000, 2_000_000
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_NONE = 0x110000


def normal(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Pieces:
    """The piece table of a model file; its size is the vocabulary's."""

    def __init__(self, model_file: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = " a  b\tﬁ é　Ａ "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("the model normalises texts; only identity normalisation with a dummy prefix is supported")
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [next((i for i in range(n) if sp.is_byte(i) and self.names[i] == f"<0x{b:02X}>"), sp.unk_id()) for b in range(256)]
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if not all(regex.fullmatch(UNIT, self.names[i]) and regex.match(UNIT, self.names[i]).end() == len(self.names[i]) for i in own):
            raise ValueError("a piece spans two units")
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.raw = [byte_of.get(i, b"") for i in range(n)]
        for i in own:
            self.raw[i] = self.names[i].replace(SPACE, " ").encode()
        self.longest = max(len(self.names[i]) for i in own)
        self.codes = np.full((len(own), self.longest), _NONE, dtype=np.uint32)
        for row, i in enumerate(own):
            self.codes[row, : len(self.names[i])] = np.frombuffer(self.names[i].encode("utf-32-le"), np.uint32)
        sums = np.cumsum(np.where(self.codes == _NONE, 0, self.codes.astype(np.uint64) + np.uint64(1)) * _powers(_R, self.longest), axis=1, dtype=np.uint64)[:, -1]
        key = mix(sums + np.array([len(self.names[i]) for i in own], dtype=np.uint64))
        if len(np.unique(key)) < len(key):
            raise ValueError("two pieces share a hash")
        order = np.argsort(key)
        self.key, self.codes, self.ids = key[order], self.codes[order], np.array(own)[order]
        self.cost = np.array([-sp.get_score(int(i)) for i in self.ids])
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.key & np.uint64((1 << 20) - 1)] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, dtype=np.uint64)]), dtype=np.uint64)[:n]


def lattice(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Places of the words' first characters (a word has a place more than characters), their lengths, and the edges: s, e (places), cost, id, word."""
    n = np.array([len(w) for w in words])
    first = np.cumsum(n + 1) - (n + 1)
    codes = np.full(int((n + 1).sum()), _NONE, dtype=np.uint32)
    inside = np.ones(len(codes), dtype=bool)
    inside[first + n] = False
    codes[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), n + 1)
    room = (first + n)[word] - np.arange(len(codes))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(codes)), dtype=np.uint64)])
    back = _powers(_R_INV, len(codes))
    at, found = np.arange(len(codes)), []
    for length in range(1, pieces.longest + 1):
        at = at[room[at] >= length]
        if not len(at):
            break
        key = mix((sums[at + length] - sums[at]) * back[at] + np.uint64(length))
        likely = np.flatnonzero(pieces.maybe[key & np.uint64((1 << 20) - 1)])
        row = np.minimum(np.searchsorted(pieces.key, key[likely]), len(pieces.key) - 1)
        same = pieces.key[row] == key[likely]
        likely, row = at[likely[same]], row[same]
        exact = (codes[likely[:, None] + np.arange(length)] == pieces.codes[row, :length]).all(1)
        found.append((likely[exact], likely[exact] + length, row[exact]))
    s, e, row = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((s, pieces.cost[row], word[s]))
    s, e, row = s[order], e[order], row[order]
    return first, n, {"s": s, "e": e, "cost": pieces.cost[row], "id": pieces.ids[row], "word": word[s]}


def _merged(first: np.ndarray, n: np.ndarray, edges: dict[str, np.ndarray]) -> np.ndarray:
    """The fold: which places are boundaries when no edge joins two neighbours any more."""
    bound = np.ones(int((n + 1).sum()), dtype=bool)
    step = (edges["e"] - edges["s"] >= 2) & (n[edges["word"]] <= STEPWISE_CHARS)
    s, e, word = edges["s"][step], edges["e"][step], edges["word"][step]
    while len(s):
        before = np.cumsum(bound)
        apart = before[e] - before[s]
        live = bound[s] & bound[e] & (apart >= 2)
        s, e, word, apart = s[live], e[live], word[live], apart[live]
        ready = np.flatnonzero(apart == 2)
        if not len(ready):
            break
        w = word[ready]
        best = ready[np.concatenate([[True], w[1:] != w[:-1]])]
        bound[np.searchsorted(before, before[s[best]] + 1)] = False
        # Words in which nothing was ready are done.
        busy = np.zeros(len(n), dtype=bool)
        busy[w] = True
        keep = busy[word]
        s, e, word = s[keep], e[keep], word[keep]
    for w in np.flatnonzero(n > STEPWISE_CHARS):
        own = slice(*np.searchsorted(edges["word"], [w, w + 1]))
        cost = dict(zip(zip((edges["s"][own] - first[w]).tolist(), (edges["e"][own] - first[w]).tolist()), edges["cost"][own].tolist()))
        bound[first[w] : first[w] + n[w]] = _heap_merged(int(n[w]), cost)
    return bound


def _heap_merged(n: int, cost: dict[tuple[int, int], float]) -> list[bool]:
    """The same merges of one long word by a heap."""
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(cost[i, i + 2], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in cost]
    heapq.heapify(heap)
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not (alive[a] and alive[b] and after[a] == b and after[b] == e):
            continue
        alive[b], after[a] = False, e
        if e < n:
            before[e] = a
            if (a, after[e]) in cost:
                heapq.heappush(heap, (cost[a, after[e]], a, e, after[e]))
        if before[a] >= 0 and (before[a], e) in cost:
            heapq.heappush(heap, (cost[before[a], e], before[a], a, e))
    return alive


def encode_words(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words, one word's after another's, and how many each word has."""
    first, n, edges = lattice(words, pieces)
    bound = _merged(first, n, edges)
    bound[first + n] = False
    s = np.flatnonzero(bound)
    word = np.searchsorted(first, s, side="right") - 1
    e = np.minimum(np.append(s[1:], len(bound)), (first + n)[word])
    # Every merged piece is an edge; a single character without one falls back.
    code = edges["s"] * (pieces.longest + 1) + edges["e"] - edges["s"]
    order = np.argsort(code)
    want = s * (pieces.longest + 1) + np.minimum(e - s, pieces.longest + 0)
    at = np.minimum(np.searchsorted(code[order], want), max(len(code) - 1, 0))
    ids = np.where(code[order][at] == want, edges["id"][order][at], -1) if len(code) else np.full(len(s), -1)
    lost = np.flatnonzero(ids < 0)
    raw = [words[w][p].encode() for w, p in zip(word[lost].tolist(), (s - first[word])[lost].tolist())]
    room = np.ones(len(ids), dtype=np.int64)
    room[lost] = [len(b) for b in raw]
    ids = np.repeat(ids, room)
    ids[ids < 0] = [pieces.byte_ids[b] for b in b"".join(raw)]
    return ids.astype(np.int32), np.bincount(np.repeat(word, room), minlength=len(words))


class Encoder:
    """Encodes texts, and keeps the ids of units between calls."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.cut = pieces, regex.compile(UNIT).findall
        self.forget()

    def forget(self) -> None:
        self.number, self.chars = defaultdict(count().__next__), 0
        self.ids, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the texts, one text's after another's; how many ids and how many units each text has."""
        if len(self.number) > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        units = [self.cut(normal(t)) for t in texts]
        n_units = np.array([len(u) for u in units], dtype=np.int64)
        before = len(self.number)
        met = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int64, int(n_units.sum()))
        new = list(islice(self.number, before, None))
        if new:
            got = [encode_words(new[lo : lo + 8192], self.pieces) for lo in range(0, len(new), 8192)]
            self.ids = np.concatenate([self.ids, *(x for x, _ in got)])
            self.n = np.concatenate([self.n, *(x for _, x in got)])
            self.chars += sum(map(len, new))
        n = self.n[met]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat((np.cumsum(self.n) - self.n)[met] - (ends - n), n) + np.arange(n.sum())]
        n_ids = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_units)])])
        return ids, n_ids, n_units


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of whole texts' ids, without the dummy prefix."""
    return b"".join(map(pieces.raw.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


def coded(docs: DataFrame, model_file: str) -> DataFrame:
    """A row for each row: doc_id, n_units, n_pieces, ids, ids_sha256 (of the ids as little-endian 32-bit numbers), lossless (whether the ids decode to the text)."""
    pieces = Pieces(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)  # Spark broadcasts the function with the piece table; its size is the vocabulary's
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                ids, n_ids, n_units = encoder.encode(texts[lo:hi])
                ends = np.cumsum(n_ids)
                own = [ids[b - n : b] for b, n in zip(ends.tolist(), n_ids.tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(n_units), pa.array(n_ids),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own], pa.string()),
                    pa.array([decode_ids(x.tolist(), pieces) == t for x, t in zip(own, texts[lo:hi])], pa.bool_()),
                ], names=["doc_id", "n_units", "n_pieces", "ids", "ids_sha256", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id long, n_units long, n_pieces long, ids array<int>, ids_sha256 string, lossless boolean")


def encoded_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids: whole texts' ids in one array each. Texts without pieces have no row."""
    return coded(docs, model_file).where("n_pieces > 0").select("doc_id", "ids")


def decode_texts(coded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of rows of doc_id and ids."""
    pieces = Pieces(model_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [decode_ids(list(x), pieces) for x in pdf["ids"]]})

    return mapped(coded.select("doc_id", "ids"), run, "doc_id long, text string", "doc_id")


def summary(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, copies (rows of this id), n_units, n_pieces, lossless (whether all ids decode to the texts)."""
    rows = coded(docs, model_file).groupBy("doc_id")
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.sum("n_units").alias("n_units"), F.sum("n_pieces").alias("n_pieces"), F.bool_and("lossless").alias("lossless"))
