"""Shared helpers of the training-data operators: table access, stages in Python, and hashing of words."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, discard, shared_dir, stored

__all__ = ["components", "discard", "shared_dir", "stored"]
#: Words are maximal runs of anything but these bytes (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
#: Texts are hashed in chunks of about this many bytes, so that a worker's arrays (some 80 bytes a byte of text) stay small; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: A batch that Spark hands to a Python stage holds about so many bytes: texts differ too much in length to count rows.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has a column of that name in any case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame) -> DataFrame:
    """The frame, with its session's Arrow batches bounded by bytes, unless they are already smaller."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_BATCH))) == 64 << 20:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def joined(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], share: str) -> DataFrame:
    """rows joined with a table of one row a key, inner; `share` tells which keys hold over a thousandth of all rows.

    There are under a thousand of those, so they are broadcast and their rows don't move; no other key is a hot one.
    """
    hot, few = table.where(share), table.where(f"not ({share})")
    same = " and ".join(f"r.{k} <=> t.{k}" for k in keys)
    more = [c for c in table.columns if c not in keys]
    pick = [F.col(f"r.{c}") for c in rows.columns] + [F.col(f"t.{c}") for c in more]
    return rows.alias("r").join(F.broadcast(hot.alias("t")), F.expr(same)).select(*pick).union(rows.alias("r").join(few.alias("t"), F.expr(same)).select(*pick))


def mapped(df: DataFrame, run: Callable, schema: str, *ids: str) -> DataFrame:
    """mapInPandas with the named long columns carried as text on both sides, for pandas turns longs beside nulls into doubles."""
    held = df.select(*(F.col(c).cast("string").alias(c) if c in ids else F.col(c) for c in df.columns))
    out = bounded(held).mapInPandas(run, re.sub(rf"\b({'|'.join(ids)}) long\b", r"\1 string", schema))
    return out.select(*(F.col(c).cast("long").alias(c) if c in ids else F.col(c) for c in out.columns))


# --- hashing -------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK_BYTES + 4096) - 1, base, dtype=np.uint64)]), dtype=np.uint64)
        if n <= 16 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def chunks(texts: list[bytes]):
    """Index ranges of consecutive texts with about CHUNK_BYTES together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes of all texts, each ended by a space; starts and ends of words; for each text the index of its first word, and one past the last."""
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(raw) and solid[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return raw, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial over its bytes by prefix sums, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LOWER[raw] * _power(_R, len(raw)), dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _power(_R_INV, len(raw))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
