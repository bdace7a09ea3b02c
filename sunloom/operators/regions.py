"""Connected pixels of masks as relations: each tile is labelled by itself, and only what lies on its rim is joined.

A mask is a relation of set pixels (``by``, row_idx, col_idx). Tiles give local pieces of connected pixels, set and unset;
pieces of neighbouring tiles that touch are linked, and links are settled by ``graphs.components``. So a task holds a tile,
whatever the size of an image, and what is shuffled after the tiles are rims and pieces, not pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs
from .sizes import bounded_batches

PIECES = "tile_row long, tile_col long, set boolean, label long, pixels long, top long, bottom long, first long, last long, edge boolean, rim array<int>"
#: Tiles that a task labels at a time.
AT_ONCE = 64
#: Cells of a crop that one task judges whole; larger crops go by tiles.
WHOLE = 1 << 18


def labelled(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Of each set cell of (tiles, rows, columns) the least number of a cell it is connected to within its tile; -1 elsewhere.

    Labels spread to neighbours and jump along what they point at, in all tiles at once.
    """
    tiles, rows, columns = mask.shape
    cell = np.arange(rows * columns).reshape(1, rows, columns)
    none = rows * columns
    label = np.where(mask, cell, none)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        least = label.copy()
        for dr, dc in steps:
            a = (slice(None), slice(0, rows - dr), slice(max(0, -dc), columns - max(0, dc)))
            b = (slice(None), slice(dr, rows), slice(max(0, dc), columns + min(0, dc)))
            both = mask[a] & mask[b]
            low = np.minimum(least[a], least[b])
            least[a] = np.where(both, low, least[a])
            least[b] = np.where(both, np.minimum(low, least[b]), least[b])
        flat = np.concatenate([least.reshape(tiles, none), np.full((tiles, 1), none)], axis=1)
        jumped = np.take_along_axis(flat, flat, axis=1)[:, :none].reshape(mask.shape)
        least = np.where(mask, jumped, none)
        if (least == label).all():
            return np.where(mask, label, -1)
        label = least


def _tiles(mask: DataFrame, by: list[str], height: int, width: int, tile: int, frames: DataFrame | None) -> DataFrame:
    """``by``, tile_row, tile_col and the numbers of a tile's set cells; every tile of every frame has a row."""
    cell = ((F.col("row_idx") % tile) * tile + F.col("col_idx") % tile).cast("int")
    place = lambda c: F.floor(F.col(c) / tile).cast("long").alias("tile_" + c[:3])
    inside = F.col("row_idx").between(0, height - 1) & F.col("col_idx").between(0, width - 1)
    held = mask.filter(inside).select(*by, place("row_idx"), place("col_idx"), cell.alias("cell"))
    grid = (frames if frames is not None else mask).select(*by).distinct()
    for name, size in (("tile_row", height), ("tile_col", width)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size // tile) - 1).cast("long"))))
    # A frame's tiles without set pixels have a row too: their pixels are unset.
    every = held.unionByName(grid.withColumn("cell", F.lit(None).cast("int")))
    return every.groupBy(*by, "tile_row", "tile_col").agg(F.collect_set("cell").alias("cells"))


def pieces(mask: DataFrame, by: list[str], height: int, width: int, tile: int = 128, diagonal: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """Local pieces of every tile: set and unset ones, numbered by their least cell, with pixels, box, whether they touch the
    edge of the image, and their cells on the tile's rim. Set pixels connect by ``diagonal``, unset ones the other way, so
    that a closed line parts what it surrounds. ``frames`` names frames (``by``) that may have no set pixel."""
    kinds = {f.name: f.dataType for f in mask.schema}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in by) + ", " + PIECES
    names = [*by, *[f.split()[0] for f in PIECES.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(k, AT_ONCE)
                rows, columns = (np.asarray(batch.column(c)) for c in ("tile_row", "tile_col"))
                image = np.zeros((len(rows), tile * tile), dtype=bool)
                for n, cells in enumerate(batch.column("cells")):
                    image[n, cells.values.to_numpy()] = True
                image = image.reshape(-1, tile, tile)
                y, x = np.mgrid[:tile, :tile]
                real = (rows[:, None, None] * tile + y < height) & (columns[:, None, None] * tile + x < width)
                parts = [_described(m, kind, rows, columns, tile, height, width, d) for kind, m, d in ((True, image & real, diagonal), (False, ~image & real, not diagonal))]
                for found in parts:
                    of = pa.array(found.pop("of"))
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(of) for c in [*by, "tile_row", "tile_col"]] + list(found.values()), names=names)

    bounded_batches(mask.sparkSession)
    return _tiles(mask, by, height, width, tile, frames).select(*by, "tile_row", "tile_col", "cells").mapInArrow(run, schema)


def _described(mask: np.ndarray, kind: bool, rows: np.ndarray, columns: np.ndarray, tile: int, height: int, width: int, diagonal: bool) -> dict:
    """The pieces of several tiles, one entry each."""
    label = labelled(mask, diagonal).reshape(len(rows), -1)
    of, cell = np.nonzero(label >= 0)
    key = of * tile * tile + label[of, cell]
    pieces_, first = np.unique(key, return_inverse=True)
    n = len(pieces_)
    y, x = rows[of] * tile + cell // tile, columns[of] * tile + cell % tile
    bounds = [np.full(n, height), np.full(n, -1), np.full(n, width), np.full(n, -1)]
    for at, value, pick in zip(bounds, (y, y, x, x), (np.minimum, np.maximum) * 2, strict=True):
        pick.at(at, first, value)
    on_rim = (cell // tile % (tile - 1 or 1) == 0) | (cell % tile % (tile - 1 or 1) == 0)
    order = np.argsort(first[on_rim], kind="stable")
    ends = np.searchsorted(first[on_rim][order], np.arange(n + 1)).astype(np.int32)
    edge = (bounds[0] == 0) | (bounds[1] == height - 1) | (bounds[2] == 0) | (bounds[3] == width - 1)
    rim = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[on_rim][order].astype(np.int32)))
    return {
        "of": pieces_ // (tile * tile),
        "set": pa.array(np.full(n, kind)),
        "label": pa.array(pieces_ % (tile * tile)),
        "pixels": pa.array(np.bincount(first, minlength=n)),
        **{name: pa.array(b.astype(np.int64)) for name, b in zip(("top", "bottom", "first", "last"), bounds, strict=True)},
        "edge": pa.array(edge),
        "rim": rim,
    }


def _links(found: DataFrame, by: list[str], tile: int, diagonal: bool) -> DataFrame:
    """Pairs (a, b) of pieces of different tiles with neighbouring cells of one kind, by an equality join on the cells."""
    cell = F.col("cell")
    at = found.select(*by, "set", "piece", "tile_row", "tile_col", F.explode("rim").alias("cell"))
    at = at.select(*by, "set", "piece", "tile_row", "tile_col", (F.col("tile_row") * tile + F.floor(cell / tile)).alias("y"), (F.col("tile_col") * tile + cell % tile).alias("x"))
    straight, slanted = [(0, 1), (1, 0)], [(1, 1), (1, -1)]
    steps = lambda these: F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in these])
    slants = F.when(F.col("set") == diagonal, steps(straight + slanted)).otherwise(steps(straight))
    # A cell reaches to those right and below of it; within its own tile labels have seen to that.
    ahead = at.withColumn("step", F.explode(slants)).withColumn("y", F.col("y") + F.col("step.dy")).withColumn("x", F.col("x") + F.col("step.dx"))
    ahead = ahead.filter((F.floor(F.col("y") / tile) != F.col("tile_row")) | (F.floor(F.col("x") / tile) != F.col("tile_col")))
    here = at.select(*by, "set", "y", "x", F.col("piece").alias("b"))
    return ahead.select(*by, "set", "y", "x", F.col("piece").alias("a")).join(here, [*by, "set", "y", "x"]).select("a", "b").distinct()


def regions(mask: DataFrame, by: list[str], height: int, width: int, tile: int = 128, diagonal: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """One row per connected region of every frame: ``by``, set, pixels, top, bottom, first, last (column), edge.

    Regions of set pixels, and of unset ones (``set`` false); an unset region that touches no edge is a hole.
    """
    found = pieces(mask, by, height, width, tile, diagonal, frames)
    found = graphs.written(found.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    roots = graphs.components(_links(found, by, tile, diagonal)).select(F.col("node").alias("piece"), "least")
    joined = found.drop("rim").join(roots, "piece", "left").withColumn("region", F.coalesce("least", "piece"))
    sums = [F.sum("pixels").alias("pixels"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("edge").alias("edge")]
    return joined.groupBy(*by, "set", "region").agg(*sums).drop("region")


def _spread(mask: DataFrame, by: list[str], column: str, reach: int) -> DataFrame:
    """Pixels that have the mask within ``reach`` along one axis."""
    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    return mask.withColumn("__k", F.explode(steps)).withColumn(column, F.col(column) + F.col("__k")).drop("__k")


def closed(mask: DataFrame, by: list[str], height: int, width: int, reach: int = 2) -> DataFrame:
    """The mask grown by ``reach`` on all sides within the image, then shrunk by as much; beyond the edge counts as unset.

    Along one axis after the other, growing is a spread of pixels, shrinking a count of neighbours.
    """
    inside = {"row_idx": F.col("row_idx").between(0, height - 1), "col_idx": F.col("col_idx").between(0, width - 1)}
    now = mask.select(*by, "row_idx", "col_idx")
    for axis in inside:
        now = _spread(now, by, axis, reach).filter(inside[axis]).distinct()
    for axis in inside:
        now = _spread(now, by, axis, reach).groupBy(*by, "row_idx", "col_idx").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == 2 * reach + 1).drop("__n")
    return now


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Greater in Spark's order, where NaN is above all numbers."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def closed_images(mask: np.ndarray, reach: int = 2) -> np.ndarray:
    """``closed`` for (images, rows, columns)."""
    for grow in (True, False):
        for axis in (1, 2):
            pad = [(reach, reach) if k == axis else (0, 0) for k in range(3)]
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(mask, pad), 2 * reach + 1, axis=axis)
            mask = windows.any(axis=-1) if grow else windows.all(axis=-1)
    return mask


def _loud(mask: np.ndarray, least: float, longest: float) -> np.ndarray:
    """Which of (images, rows, columns) have a connected patch of more than ``least`` cells or longer than ``longest``."""
    images, height, width = mask.shape
    label = labelled(mask, True).reshape(images, -1)
    of, cell = np.nonzero(label >= 0)
    key = of * height * width + label[of, cell]
    order = np.argsort(key, kind="stable")
    key, cell = key[order], cell[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    out = np.zeros(images, bool)
    if len(first):
        sides = [np.maximum.reduceat(c, first) - np.minimum.reduceat(c, first) + 1 for c in (cell // width, cell % width)]
        loud = (np.diff(np.append(first, len(key))) > least) | (np.maximum(*sides) > longest)
        out[key[first[loud]] // (height * width)] = True
    return out


def _judged(pixels: DataFrame, by: list[str], height: int, width: int, dark: float, bright: float, areas: tuple[float, float], span: float) -> DataFrame:
    """``quiet_crops`` of crops that are gathered whole, many in one task."""
    total = height * width
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    inside = F.col("row_idx").between(0, height - 1) & F.col("col_idx").between(0, width - 1)
    cell = F.when(inside, F.col("row_idx") * width + F.col("col_idx")).otherwise(-1).cast("int")
    held = pixels.select(*by, F.struct(cell.alias("cell"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).alias("p"))
    held = held.groupBy(*by).agg(F.collect_list("p").alias("p"))
    held = held.select(*by, F.col("p.cell").alias("cells"), F.col("p.value").alias("values"))
    at_once = max(1, AT_ONCE * 1024 // total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, at_once):
                batch = whole.slice(k, at_once)
                n = batch.num_rows
                middle, masks = np.empty(n), [np.zeros((n, total), bool) for _ in range(2)]
                for j, (cells, values) in enumerate(zip(batch.column("cells"), batch.column("values"), strict=True)):
                    cells, values = cells.values.to_numpy(), values.values.to_numpy()
                    every = np.sort(np.append(values, np.zeros(max(0, total - len(values)))))
                    middle[j] = (every[(total - 1) // 2] + every[total // 2]) / 2
                    if not _above(middle[j], np.float64(0)):
                        continue
                    seen = cells >= 0
                    absent = np.ones(total, bool)
                    absent[cells[seen]] = False
                    masks[0][j] = absent
                    masks[0][j][cells[seen & _above(dark * middle[j], values)]] = True
                    masks[1][j][cells[seen & _above(values, bright * middle[j])]] = True
                quiet = _above(middle, np.zeros(n))
                for mask, area in zip(masks, areas, strict=True):
                    mask = mask.reshape(n, height, width)
                    quiet &= ~_loud(mask | closed_images(mask), area * total, span * max(height, width))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(quiet)], names=[*by, "quiet"])

    bounded_batches(pixels.sparkSession)
    return held.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", quiet boolean")


def quiet_crops(pixels: DataFrame, by: list[str], height: int, width: int, dark: float = 0.92, bright: float = 1.12, areas: tuple[float, float] = (0.02, 0.03), span: float = 0.35, tile: int = 128) -> DataFrame:
    """(``by``, quiet) of crops given as pixels (row_idx and col_idx inside the crop, value); missing pixels are 0.

    A crop is quiet if its median is above zero and no patch darker or brighter than a share of it, gaps closed, is larger
    than a share of the crop or longer than a share of its longer side. Crops of at most ``WHOLE`` cells are judged in one
    pass, larger ones by tiles.
    """
    total = height * width
    if total <= WHOLE:
        return _judged(pixels, by, height, width, dark, bright, areas, span)
    # The middle two of a crop's values, missing ones counted as zeros, give the median.
    held = pixels.groupBy(*by).agg(F.collect_list(F.coalesce("value", F.lit(0.0))).alias("v"))
    filled = held.withColumn("v", F.sort_array(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(total) - F.size("v")))))
    medians = filled.select(*by, ((F.get("v", F.lit((total - 1) // 2)) + F.get("v", F.lit(total // 2))) / 2).alias("middle"))
    seen = pixels.join(medians, by)
    patches = None
    for kind, area in (("dark", areas[0]), ("bright", areas[1])):
        if kind == "dark":
            missing = _absent(pixels, by, height, width).join(medians.filter("middle > 0"), by).select(*by, "row_idx", "col_idx")
            raw = seen.filter((F.col("middle") > 0) & (F.coalesce("value", F.lit(0.0)) < dark * F.col("middle"))).select(*by, "row_idx", "col_idx").unionByName(missing)
        else:
            raw = seen.filter((F.col("middle") > 0) & (F.col("value") > bright * F.col("middle"))).select(*by, "row_idx", "col_idx")
        raw = raw.unionByName(closed(raw, by, height, width)).distinct().withColumn("kind", F.lit(kind))
        patches = raw if patches is None else patches.unionByName(raw)
    found = regions(patches, [*by, "kind"], height, width, tile).filter("set")
    limit = F.when(F.col("kind") == "dark", areas[0] * total).otherwise(areas[1] * total)
    longest = F.greatest(F.col("bottom") - F.col("top"), F.col("last") - F.col("first")) + 1
    loud = found.filter((F.col("pixels") > limit) | (longest > span * max(height, width))).select(*by).distinct().withColumn("loud", F.lit(True))
    return medians.join(loud, by, "left").select(*by, ((F.col("middle") > 0) & F.col("loud").isNull()).alias("quiet"))


def _absent(pixels: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """Pixels of a crop that have no row."""
    held = pixels.groupBy(*by).agg(F.array_sort(F.collect_set((F.col("row_idx") * width + F.col("col_idx")).cast("int"))).alias("__h"))
    rest = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(height * width - 1)), "__h")).alias("__c")
    return held.filter(F.size("__h") < height * width).select(*by, rest).select(*by, F.floor(F.col("__c") / width).cast("long").alias("row_idx"), (F.col("__c") % width).cast("long").alias("col_idx"))


def cohesion(values: DataFrame, by: str, height: int, width: int, threshold: float, value: str = "absorption", tile: int = 128) -> DataFrame:
    """(``by``, parts, largest_share, hole_share, p50, p90) of the pixels whose ``value`` is over ``threshold``.

    Parts connect across corners; holes are unset regions that touch no edge, as a share of the mask with its holes filled.
    Frames without such a pixel have no parts, no shares, and null percentiles.
    """
    over = values.filter(F.col(value) > threshold)
    frames = values.select(by).distinct()
    found = regions(over.select(by, "row_idx", "col_idx"), [by], height, width, tile, frames=frames)
    size, is_set = F.col("pixels"), F.col("set")
    hole = ~is_set & ~F.col("edge")
    sums = found.groupBy(by).agg(
        F.count(F.when(is_set, 1)).alias("parts"),
        F.coalesce(F.max(F.when(is_set, size)), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(F.when(is_set, size)), F.lit(0)).alias("mask"),
        F.coalesce(F.sum(F.when(hole, size)), F.lit(0)).alias("holes"),
    )
    levels = over.groupBy(by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.9).alias("p90"))
    share = lambda a, b: (F.col(a) / F.greatest(F.lit(1), b)).alias(f"{'hole' if a == 'holes' else a}_share")
    shares = sums.select(by, "parts", share("largest", F.col("mask")), share("holes", F.col("mask") + F.col("holes")))
    return shares.join(levels, by, "left")
