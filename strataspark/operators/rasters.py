"""Raster rows: one array of levels a row and channel, in blocks of rows with a border.

A row table has image_id, block, y and an array of values, by x, for each channel. Packing copies a border of `halo` rows
into each block from its neighbours, so that a chain of neighbourhood operators that reaches no further than the halo
needs one shuffle, by image and block: the one that packs the pixels. A task runs the chain on a block's rows as one
array, whatever the image's height, and gives back the rows that are the block's own. Every image is dense from (0, 0).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def packed(pixels: DataFrame, halo: int, *values: str, also: tuple[str, ...] = ("height",), block: int = BLOCK) -> DataFrame:
    """image_id, block, y, the arrays of the values (as doubles), and the image's other columns `also`, its height among them."""
    at = lambda d: F.floor((F.col("y") + d) / block).cast("int")
    held = pixels.select("image_id", F.explode(F.sequence(F.greatest(F.lit(0), at(-halo)), F.least(at(halo), F.floor((F.col("height") - 1) / block).cast("int")))).alias("block"), "y", "x", *(F.col(v).cast("double").alias(v) for v in values), *also)
    cells = F.array_sort(F.collect_list(F.struct("x", *values))).alias("c")
    held = held.repartition("image_id", "block").groupBy("image_id", "block", "y", *also).agg(cells)
    return held.select("image_id", "block", "y", *(F.col("c").getField(v).alias(v) for v in values), *also)


class Block:
    """A block's rows: its arrays by channel, where they lie in their image, and the image's height."""

    def __init__(self, pdf: pd.DataFrame, values: tuple[str, ...]):
        self.first, self.height, self.args = int(pdf["y"].iloc[0]), int(pdf["height"].iloc[0]), pdf.iloc[0]
        self.of = {v: np.stack(pdf[v].to_numpy()) for v in values}

    def _neighbours(self, n: int, d: int, axis: int, replicate: bool) -> np.ndarray:
        """Places d further on; beyond an edge of the image those mirrored at the edge pixel, or the edge."""
        first, size = (self.first, self.height) if axis == 0 else (0, n)
        at = np.arange(first, first + n) + d
        if not replicate:
            at = np.abs(at)
            at = np.where(at > size - 1, 2 * (size - 1) - at, at)
        return np.clip(np.clip(at, 0, size - 1) - first, 0, n - 1)

    def weighted(self, a: np.ndarray, weights: tuple[float, ...], replicate: bool = False) -> np.ndarray:
        """The weighted sums of the neighbours along rows, then down columns."""
        for axis in (1, 0):
            total = np.zeros(a.shape)
            for k, w in enumerate(weights):
                total = total + np.take(a, self._neighbours(a.shape[axis], k - len(weights) // 2, axis, replicate), axis) * w
            a = total
        return a

    def opened(self, on: np.ndarray) -> np.ndarray:
        """3 x 3 erosion, then dilation; beyond the border nothing erodes or dilates."""
        for meet in (np.logical_and, np.logical_or):
            for axis in (1, 0):
                side = [np.take(on, self._neighbours(on.shape[axis], d, axis, True), axis) for d in (-1, 1)]
                on = meet(meet(on, side[0]), side[1])
        return on

    def lines(self, on: np.ndarray, least: int, axis: int) -> np.ndarray:
        """Whether each place lies in a run down columns (axis 0) or along rows that outlives an opening by `least`; beyond a border nothing is taken away."""
        a = on.astype(np.int64) if axis == 0 else on.T.astype(np.int64)
        back, ahead = a.copy(), a.copy()
        for i in range(1, len(a)):
            back[i] += back[i - 1] * a[i]
            ahead[-1 - i] += ahead[-i] * a[-1 - i]
        at = np.arange(len(a))[:, None] + (self.first if axis == 0 else 0)
        size = self.height if axis == 0 else len(a)
        need = np.where(at - back + 1 == 0, least - least // 2, np.where(at + ahead == size, least // 2 + 1, least))
        line = (a > 0) & (back + ahead - 1 >= need)
        return line if axis == 0 else line.T


def halved(a: np.ndarray) -> np.ndarray:
    """Rounded half up, as levels are."""
    return np.floor(a + 0.5)


def blocks(rows: DataFrame, values: tuple[str, ...], run: Callable[[Block], dict[str, np.ndarray]], out: str, also: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """image_id, y, also and the arrays that run(block) gives, named and typed by `out`; rows of borders are left out. Packed rows have a height."""
    names = [c.split()[0] for c in out.split(", ")]
    kinds = dict(rows.dtypes)
    schema = ", ".join(["image_id string", "y int", *(f"{a} {kinds[a]}" for a in also), out])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        got = run(Block(pdf, values))
        own = (pdf["y"] // block == pdf["block"]).to_numpy()
        return pd.DataFrame({"image_id": pdf["image_id"][own], "y": pdf["y"][own], **{a: pdf[a][own] for a in also}, **{n: list(got[n][own]) for n in names}})

    return rows.groupBy("image_id", "block").applyInPandas(task, schema)


def pixels_of(rows: DataFrame, *values: str) -> DataFrame:
    """The pixel table (image_id, y, x, values) of rows of arrays."""
    held = rows.select("image_id", "y", F.posexplode(F.arrays_zip(*values)).alias("x", "c"))
    return held.select("image_id", "y", "x", *(F.col("c").getField(v).alias(v) for v in values))
