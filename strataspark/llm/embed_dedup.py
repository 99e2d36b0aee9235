"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are brought to unit length; each of several tables hashes them by random projections, shifted and cut to steps of
WIDTH, and vectors with the same cells in a table are candidates, checked by their exact cosine in double precision. Two
unit vectors of cosine 0.95 lie 0.316 apart and share a cell with probability 0.874, orthogonal ones with 0.486: the
number of hashes grows with the logarithm of the number of vectors, so that unrelated vectors rarely meet whatever the
table's size, and the number of tables is what leaves a pair at the threshold unseen with MISS; closer pairs are missed
far more rarely still.

Equal vectors are one class before hashing, so a vector held by a third of all rows costs one row. Buckets of up to
PAIR_LIMIT classes give their pairs as rows. Larger ones give none: their members are dealt to blocks, and a task
compares two blocks by one matrix product and gives a count of links for each vector and the links that join what is not
yet joined, so a dense group costs rows in proportion to its vectors and blocks. A pair that meets in several buckets
counts in the first large one that it shares, or else once among the pairs. No bucket is capped.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0, their
own component, kept. Vectors of different lengths never link. Repeated rows of one id count as vectors of their own and
have one component. A row without id links with nothing and has no component; kept is false. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import bounded, components, discard, joined, mix, stored

WIDTH, SEED = 2.0, 11
#: Chances that two unit vectors share a cell of one hash: at cosine 0.95, and at cosine 0.
NEAR, FAR = 0.8738, 0.486
MISS = 5e-4
PAIR_LIMIT, BLOCK = 32, 512


def plan(n: int) -> tuple[int, int]:
    """Tables and hashes for n vectors: unrelated vectors that share a bucket stay few for each vector."""
    hashes = max(8, math.ceil(math.log(max(n, 2)) / -math.log(FAR) + 3))
    return math.ceil(-math.log(MISS) / NEAR**hashes), hashes


def bucket_keys(classes: DataFrame, tables: int, hashes: int, width: float = WIDTH) -> DataFrame:
    """(key, cid): one row for each class and table; the key holds the vector's length, the table's number and its cells."""

    def lines(dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, dim])
        return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        coef = np.random.default_rng(SEED).integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                held[dim] = held[dim] if dim in held else lines(dim)
                for lo in range(0, len(own), 1024):
                    some = own.iloc[lo : lo + 1024]
                    x = np.stack(some["vec"]).astype(np.float64)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    cells = np.floor((x @ held[dim][0] + held[dim][1]) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, hashes)
                    key = mix((mix(cells) * coef).sum(2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) + np.uint64(tables * dim))
                    yield pd.DataFrame({"cid": np.repeat(some["cid"].to_numpy(), tables), "key": key.astype(np.int64).ravel()})

    return bounded(classes.select("cid", "vec", "dim")).mapInPandas(run, "cid long, key long")


def _cosines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))


def _close(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b, va, vb) of vectors of one length those whose cosine, in double precision, reaches the least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, pdf in batch.groupby(batch["va"].map(len)):
                x, y = np.stack(pdf["va"]).astype(np.float64), np.stack(pdf["vb"]).astype(np.float64)
                nx, ny = _cosines(x, y)
                yield pdf.loc[(x * y).sum(1) / (nx * ny) >= least, ["a", "b"]]

    return bounded(pairs.select("a", "b", "va", "vb")).mapInPandas(run, "a long, b long")


def _holds(column: pd.Series, keys: np.ndarray) -> np.ndarray:
    """(rows, keys) 1 where a row's list of large buckets has the key."""
    out = np.zeros((len(column), len(keys)), dtype=np.float32)
    for i, own in enumerate(column):
        out[i, np.searchsorted(keys, own)] = 1
    return out


def _groups(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The connected groups of a (left, right) link matrix: their left and right members."""
    todo = linked.any(1)
    while todo.any():
        rows, columns = np.zeros(len(linked), dtype=bool), np.zeros(linked.shape[1], dtype=bool)
        new = np.zeros(len(linked), dtype=bool)
        new[todo.argmax()] = True
        while new.any():
            rows |= new
            reached = linked[new].any(0) & ~columns
            columns |= reached
            new = linked[:, reached].any(1) & ~rows
        todo &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def _block_links(least: float):
    """The job of two blocks of a large bucket: counts of links (a, n) and, with n 0, links (a, b) that join what they join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        key, same = pdf["key"].iloc[0], pdf["i"].iloc[0] == pdf["j"].iloc[0]
        # Cells of two lengths never meet: the key holds the length.
        left, right = (pdf[pdf["side"] == s].sort_values("cid") for s in (0, 1))
        right = left if same else right
        if len(left) and len(right):
            x, y = np.stack(left["vec"]).astype(np.float64), np.stack(right["vec"]).astype(np.float64)
            nx, ny = _cosines(x, y)
            a, b = left["cid"].to_numpy(), right["cid"].to_numpy()
            linked = np.zeros((len(a), len(b)), dtype=bool)
            for lo in range(0, len(a), 256):  # products in the order that single pairs have
                z = slice(lo, lo + 256)
                rough = (x[z] @ y.T) / (nx[z, None] * ny)
                linked[z] = rough >= least
                for i, j in np.argwhere(np.abs(rough - least) < 1e-9):
                    linked[lo + i, j] = (x[lo + i] * y[j]).sum() / (nx[lo + i] * ny[j]) >= least
            linked &= a[:, None] != b
            earlier = np.unique(np.concatenate([*left["bigs"], *right["bigs"]]))
            cut = earlier[earlier < key]
            if len(cut):
                first = lambda c: c.map(lambda own: np.asarray(own)[np.asarray(own) < key])
                linked &= (_holds(first(left["bigs"]), cut) @ _holds(first(right["bigs"]), cut).T) == 0
            n = linked @ right["size"].to_numpy()
            out += list(zip(a[n > 0].tolist(), a[n > 0].tolist(), n[n > 0].tolist()))
            if not same:
                n = left["size"].to_numpy() @ linked
                out += list(zip(b[n > 0].tolist(), b[n > 0].tolist(), n[n > 0].tolist()))
            for rows, columns in _groups(linked):
                out += [(int(a[rows[0]]), int(v), 0) for v in np.unique(np.concatenate([a[rows], b[columns]])) if v != a[rows[0]]]
        return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 3), columns=["a", "b", "n"])

    return run


def _large_buckets(members: DataFrame, classes: DataFrame, bigs: DataFrame, least: float) -> DataFrame:
    """a, b, n of all pairs of blocks of the large buckets (key, n, cid)."""
    held = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("at", F.expr("pmod(xxhash64(cid, key), blocks)"))
    held = held.join(classes.select("cid", "vec", "size"), "cid").join(bigs, "cid")
    ways = F.expr("concat(transform(sequence(at, blocks - 1), j -> struct(at as i, j as j, 0 as side)), transform(filter(sequence(0L, blocks - 1), i -> i < at), i -> struct(i as i, at as j, 1 as side)))")
    dealt = held.select("key", "cid", "vec", "size", "bigs", F.explode(ways).alias("w")).select("key", "w.i", "w.j", "w.side", "cid", "vec", "size", "bigs")
    return dealt.groupBy("key", "i", "j").applyInPandas(_block_links(least), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of the table."""
    good = usable(vectors, id_col, vec_col).withColumns({"h1": F.expr("xxhash64(vec)"), "h2": F.expr("xxhash64(1, vec)")})
    good = stored(good, "vectors")
    classes = good.groupBy("h1", "h2", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("vec").alias("vec"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, total = classes.agg(F.count(F.lit(1)), F.sum("size")).first()
    keys = stored(bucket_keys(classes, *plan(n)), "keys")
    counts = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    large = counts.where(F.col("n") > PAIR_LIMIT)
    members = stored(keys.join(large, "key"), "members")
    bigs = stored(members.groupBy("cid").agg(F.array_sort(F.collect_set("key")).alias("bigs")), "bigs")

    small = keys.join(counts.where(F.col("n") <= PAIR_LIMIT).select("key"), "key")
    pairs = small.select("key", F.col("cid").alias("a")).join(small.select("key", F.col("cid").alias("b")), "key").where("a < b").select("a", "b").distinct()
    held = classes.join(bigs, "cid", "left").select("cid", "vec", "bigs")
    side = lambda s: held.select(F.col("cid").alias(s), F.col("vec").alias(f"v{s}"), F.col("bigs").alias(f"g{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("not coalesce(arrays_overlap(ga, gb), false)")
    links = stored(_close(pairs, least), "links")
    blocks = stored(_large_buckets(members, classes, bigs, least), "blocks")
    discard(keys, members, bigs, counts)

    both = links.union(links.select("b", "a"))
    beside = both.join(classes.select(F.col("cid").alias("b"), F.col("size").alias("n")), "b").select("a", "n").union(blocks.where("n > 0").select("a", "n"))
    beside = beside.groupBy("a").agg(F.sum("n").alias("beside"))
    comp = components(links.union(blocks.where("n = 0").select("a", "b")))
    named = classes.join(beside, classes.cid == beside.a, "left").join(comp, classes.cid == comp.node, "left")
    named = named.select("h1", "h2", "dim", "size", "rep", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    named = stored(named, "named")
    labels = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("k"))
    named = joined(named, stored(labels, "labels"), ("component",), f"k * 1000 > {n}")
    # An id that repeats with different vectors has the links of the one of most, and the smallest component.
    rows = joined(good.select("id", "h1", "h2", "dim"), stored(named, "classes"), ("h1", "h2", "dim"), f"size * 1000 > {total or 0}")
    rows = rows.groupBy(F.col("id").alias("vec_id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(rows, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
