"""Rasters and pages of any size, worked on in square tiles with a halo.

A raster is a table of pixels (``row_id, col_id`` and values, and the columns in
``by`` that tell several rasters apart). A pixel goes to its own tile and, if it
lies near an edge, to the tiles that need it there; a task holds one tile. What
takes whole lines, as exact distances do, streams line by line instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A tile's side in pixels.
SIDE = 256

#: ``values`` (name to array, halo included; what isn't there is 0), ``there`` (which pixels there are), the halo. Gives arrays of the tile alone.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray, int], dict[str, np.ndarray]]


def on_tiles(pixels: DataFrame, kernel: Kernel, halo: int, values: list[str], results: str, by: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """``by, row_id, col_id`` and the kernel's ``results`` (a DDL string) of every pixel.

    The halo may be up to a tile wide. Pixels of a raster are told by their place, so each place must occur once.
    """
    if not 0 <= halo <= side:
        raise ValueError("the halo must lie between 0 and a tile's side")
    # The tiles that see a pixel: those of the places a halo before and behind it.
    seen = lambda c: F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
    dealt = pixels.select(*by, "row_id", "col_id", *values).withColumn("_tr", F.explode(seen("row_id"))).withColumn("_tc", F.explode(seen("col_id")))
    out = T.StructType([*[pixels.schema[c] for c in (*by, "row_id", "col_id")], *T._parse_datatype_string(results).fields])
    names = [f.name for f in T._parse_datatype_string(results).fields]
    size = side + 2 * halo

    def one(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[-2]) * side - halo, int(key[-1]) * side - halo
        r, c = tile["row_id"].to_numpy() - r0, tile["col_id"].to_numpy() - c0
        there = np.zeros((size, size), dtype=bool)
        there[r, c] = True
        arrays = {}
        for v in values:
            x = tile[v].to_numpy()
            arrays[v] = np.zeros((size, size), dtype=x.dtype if x.dtype.kind in "fiub" else float)
            arrays[v][r, c] = x
        own = (r >= halo) & (r < halo + side) & (c >= halo) & (c < halo + side)
        made = kernel(arrays, there, halo)
        cols = {b: tile[b].to_numpy()[own] for b in (*by, "row_id", "col_id")}
        return pd.DataFrame(cols | {n: made[n][r[own] - halo, c[own] - halo] for n in names})

    return dealt.groupBy(*by, "_tr", "_tc").applyInPandas(one, out)


def inner(x: np.ndarray, halo: int) -> np.ndarray:
    return x[halo : x.shape[0] - halo, halo : x.shape[1] - halo] if halo else x


def shifted(x: np.ndarray, there: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The value ``dr`` rows and ``dc`` columns on where there is one, else the pixel's own. Beyond the array nothing is there."""
    out = x.copy()
    h, w = x.shape
    to = (slice(max(0, -dr), h - max(0, dr)), slice(max(0, -dc), w - max(0, dc)))
    of = (slice(max(0, dr), h - max(0, -dr)), slice(max(0, dc), w - max(0, -dc)))
    out[to] = np.where(there[of], x[of], x[to])
    return out


def sobel_kernel(values: dict[str, np.ndarray], there: np.ndarray, halo: int) -> dict[str, np.ndarray]:
    """Differences and sums of neighbours, one axis at a time; a neighbour that isn't there is the pixel itself."""
    z = values["z"]
    up, down = shifted(z, there, -1, 0), shifted(z, there, 1, 0)
    s, d = up + 2 * z + down, down - up
    gx = shifted(s, there, 0, 1) - shifted(s, there, 0, -1)
    gy = shifted(d, there, 0, -1) + 2 * d + shifted(d, there, 0, 1)
    return {"gx": inner(gx, halo), "gy": inner(gy, halo)}


# Exact distances, line by line


def _lines(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows, a whole line (rows of one ``key``) at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        k = b.column(key).to_numpy()
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        for i, j in zip([0, *edges], [*edges, len(k)]):
            if i == j:
                continue
            if held and k[i] != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            now = k[i]
    if held:
        yield pa.Table.from_batches(held)


def nearest_along(places: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Distance of each of the ascending ``places`` to the nearest that is ``marked``; -1 if none is."""
    at = np.flatnonzero(marked)
    if not len(at):
        return np.full(len(places), -1, dtype=np.int64)
    marks = places[at]
    after = np.searchsorted(marks, places)
    left, right = marks[np.maximum(after - 1, 0)], marks[np.minimum(after, len(marks) - 1)]
    return np.minimum(np.abs(places - left), np.abs(right - places))


def lower_envelope(places: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """The least of ``(p - q)² + heights[q]²`` over all places q whose height isn't negative, for each of the ascending places p; -1 if none is.

    The parabolas of the places form a lower envelope that one pass builds and another reads.
    """
    q = places[heights >= 0].tolist()
    if not q:
        return np.full(len(places), -1, dtype=np.int64)
    f = (heights[heights >= 0].astype(np.int64) ** 2).tolist()
    hull, ends = [0], []  # places on the envelope, and where each hands over to the next
    for k in range(1, len(q)):
        while True:
            j = hull[-1]
            meet = (f[k] + q[k] ** 2 - f[j] - q[j] ** 2) / (2 * (q[k] - q[j]))
            if not ends or meet > ends[-1]:
                break
            hull.pop()
            ends.pop()
        hull.append(k)
        ends.append(meet)
    owner = np.array(hull)[np.searchsorted(np.array(ends), places)]
    at, height = np.array(q)[owner], np.array(f)[owner]
    return (places - at) ** 2 + height


def squared_distances(grid: DataFrame, points: DataFrame) -> DataFrame:
    """``row_id, col_id, d2``: the squared distance of each pixel to the nearest point that lies on a pixel; null if there is none.

    A column streams by with its points, then a row with what its pixels know of their columns. A task holds one line, and work grows
    with the pixels alone.
    """
    both = grid.select("row_id", "col_id", F.lit(0).alias("mark")).unionByName(points.select("row_id", "col_id", F.lit(1).alias("mark")))
    kinds = [grid.schema["row_id"], grid.schema["col_id"]]

    def table(line: pa.Table, **more: pa.Array) -> list[pa.RecordBatch]:
        return pa.table({"row_id": line["row_id"], "col_id": line["col_id"]} | more).to_batches()

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _lines(batches, "col_id"):
            row, mark = line["row_id"].to_numpy(), line["mark"].to_numpy()
            pixel = mark == 0
            own = row[pixel]
            yield from table(line.filter(pa.array(pixel)), g=pa.array(nearest_along(own.astype(np.int64), np.isin(own, row[~pixel]))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _lines(batches, "row_id"):
            d2 = lower_envelope(line["col_id"].to_numpy().astype(np.int64), line["g"].to_numpy())
            yield from table(line, d2=pa.array(d2, mask=d2 < 0))

    first = both.repartition("col_id").sortWithinPartitions("col_id", "row_id").mapInArrow(columns, T.StructType([*kinds, T.StructField("g", T.LongType())]))
    return first.repartition("row_id").sortWithinPartitions("row_id", "col_id").mapInArrow(rows, T.StructType([*kinds, T.StructField("d2", T.LongType())]))


# Page images


def _reach(x: np.ndarray, there: np.ndarray, least: bool) -> np.ndarray:
    """What isn't there doesn't count in a least or greatest."""
    return np.where(there, x.astype(np.int64), 1 << 40 if least else -(1 << 40))


def eroded(x: np.ndarray, there: np.ndarray, shape: np.ndarray, anchor: tuple[int, int]) -> np.ndarray:
    """The least value under a shape (an array of 0 and 1) with its ``anchor`` on the pixel."""
    return _under(_reach(x, there, True), shape, anchor, np.minimum, 1 << 40)


def dilated(x: np.ndarray, there: np.ndarray, shape: np.ndarray, anchor: tuple[int, int]) -> np.ndarray:
    return _under(_reach(x, there, False), shape, anchor, np.maximum, -(1 << 40))


def _under(x: np.ndarray, shape: np.ndarray, anchor: tuple[int, int], of, outside: int) -> np.ndarray:
    """Runs along a row of the shape are taken by doubling, so a long one costs its logarithm."""
    h, w = x.shape
    reach = max(shape.shape)
    padded = np.pad(x, reach, constant_values=outside)
    out = np.full((h, w), outside, dtype=np.int64)
    for i in range(shape.shape[0]):
        js = np.flatnonzero(shape[i])
        if not len(js):
            continue
        j0, n = int(js[0]), len(js)  # the rows of all shapes used are runs
        run, k = padded, 1
        while 2 * k <= n:
            run = of(run[:, :-k], run[:, k:])
            k *= 2
        if k < n:
            run = of(run[:, : run.shape[1] - (n - k)], run[:, n - k :])
        r, c = reach + i - anchor[0], reach + j0 - anchor[1]
        out = of(out, run[r : r + h, c : c + w])
    return out


#: Shapes: two and three pixels across, as round as they come.
SPOT2, SPOT3 = np.array([[0, 1], [1, 1]]), np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])


def opened(pages: DataFrame, shape: np.ndarray, by: tuple[str, ...] = ("page_id",), column: str = "v", side: int = SIDE) -> DataFrame:
    """Pixels after the least and then the greatest under ``shape``: what is smaller than it goes."""
    return _morphology(pages, shape, (eroded, dilated), by, column, side)


def closed(pages: DataFrame, shape: np.ndarray, by: tuple[str, ...] = ("page_id",), column: str = "v", side: int = SIDE) -> DataFrame:
    """Pixels after the greatest and then the least under ``shape``: holes that are smaller than it fill up."""
    return _morphology(pages, shape, (dilated, eroded), by, column, side)


def _morphology(pages: DataFrame, shape: np.ndarray, steps: tuple, by: tuple[str, ...], column: str, side: int) -> DataFrame:
    anchor = (shape.shape[0] // 2, shape.shape[1] // 2)

    def kernel(values: dict[str, np.ndarray], there: np.ndarray, halo: int) -> dict[str, np.ndarray]:
        x = values[column]
        for step in steps:
            x = step(x, there, shape, anchor)
        return {column: inner(x, halo)}

    return on_tiles(pages, kernel, 2 * max(shape.shape), [column], f"{column} long", by, side)


def gaussian(size: int) -> np.ndarray:
    """Weights of a bell of ``size`` pixels, whose width follows from the size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


def thresholded(pages: DataFrame, size: int = 11, below: float = 2.0, by: tuple[str, ...] = ("page_id",), column: str = "v", side: int = SIDE) -> DataFrame:
    """255 where a pixel (0 to 255) lies above the weighted mean of its surroundings less ``below``, else 0. Pages repeat their edges outwards.

    The mean is that of a bell of ``size`` pixels, rounded. Pages of which more than half would be 255 are inverted
    (``ink`` is 255 on white pages too); how much that is, is one row a page.
    """
    w, half = gaussian(size), size // 2

    def kernel(values: dict[str, np.ndarray], there: np.ndarray, halo: int) -> dict[str, np.ndarray]:
        x = values[column].astype(float)
        rows, cols = np.flatnonzero(there.any(axis=1)), np.flatnonzero(there.any(axis=0))
        r, c = np.clip(np.arange(x.shape[0]), rows[0], rows[-1]), np.clip(np.arange(x.shape[1]), cols[0], cols[-1])
        x = x[np.ix_(r, c)]  # edges outwards; inside a page nothing changes
        for axis in (0, 1):
            x = np.apply_along_axis(np.convolve, axis, x, w, "same")
        mean = np.rint(x)
        return {"ink": inner(np.where(values[column] - mean > -np.ceil(below), 255, 0), halo)}

    d = on_tiles(pages, kernel, half, [column], "ink long", by, side)
    share = d.groupBy(*by).agg(F.avg("ink").alias("_mean"))
    d = d.join(share, list(by)) if by else d.crossJoin(F.broadcast(share))
    return d.withColumn("ink", F.when(F.col("_mean") > 127, 255 - F.col("ink")).otherwise(F.col("ink"))).drop("_mean")
