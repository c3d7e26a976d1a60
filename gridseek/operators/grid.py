"""Tile grids as DataFrames: generation, index algebra and coordinates.

A grid of R x C main tiles, from a width, a height and a tile size, has an overlap layer of
(R-1) x (C-1) tiles half a tile further on, if R and C are at least 2. Flat numbers run through the rows
m o m o ... m, and the last row has main tiles only; all index rules are closed forms of that order, so
that no operator here needs a window or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN, OVERLAP = "main", "overlap"


def _int(x: Column) -> Column:
    return x.cast("int")


def tile_counts(width: Column, height: Column, tile: Column) -> tuple[Column, Column]:
    """Rows and columns of whole tiles; tails are dropped."""
    return _int(F.floor(height / tile)), _int(F.floor(width / tile))


def has_overlap(rows: Column, cols: Column, overlap: bool | Column = True) -> Column:
    return F.lit(overlap) & (rows >= 2) & (cols >= 2)


def grid_length(rows: Column, cols: Column, overlap: Column) -> Column:
    """Number of tiles of both layers."""
    return _int(rows * cols + F.when(overlap, (rows - 1) * (cols - 1)).otherwise(0))


def unified_shape(rows: Column, cols: Column, overlap: Column) -> tuple[Column, Column]:
    return _int(F.when(overlap, 2 * rows - 1).otherwise(rows)), _int(F.when(overlap, 2 * cols - 1).otherwise(cols))


def flat_of_main(row: Column, col: Column, rows: Column, cols: Column, overlap: Column) -> Column:
    """Flat number of a main tile."""
    wide = 2 * cols - 1
    return _int(F.when(~overlap, row * cols + col).when(row < rows - 1, row * wide + 2 * col).otherwise((rows - 1) * wide + col))


def flat_of_overlap(row: Column, col: Column, cols: Column) -> Column:
    """Flat number of an overlap tile."""
    return _int(row * (2 * cols - 1) + 2 * col + 1)


def locate_flat(flat: Column, rows: Column, cols: Column, overlap: Column) -> Column:
    """``struct<kind, row, col>`` of a flat number, null if the grid has no such number."""
    wide = 2 * cols - 1
    body = flat < (rows - 1) * wide
    row = F.when(overlap, F.when(body, F.floor(flat / wide)).otherwise(rows - 1)).otherwise(F.floor(flat / cols))
    at = F.when(overlap, flat - row * wide).otherwise(flat - row * cols)
    between = overlap & body & (F.pmod(at, F.lit(2)) == 1)
    col = F.when(overlap & body, F.floor(at / 2)).otherwise(at)
    inside = (flat >= 0) & (flat < grid_length(rows, cols, overlap))
    kind = F.when(between, OVERLAP).otherwise(MAIN)
    return F.when(inside, F.struct(kind.alias("kind"), _int(row).alias("row"), _int(col).alias("col")))


def unify(kind: Column, row: Column, col: Column, overlap: Column) -> tuple[Column, Column]:
    """Place of a tile in the unified grid: main tiles at even, overlap tiles at odd coordinates."""
    odd = F.when(kind == OVERLAP, 1).otherwise(0)
    return _int(F.when(overlap, 2 * row + odd).otherwise(row)), _int(F.when(overlap, 2 * col + odd).otherwise(col))


def locate_unified(u_row: Column, u_col: Column, rows: Column, cols: Column, overlap: Column) -> Column:
    """``struct<kind, row, col>`` of a place in the unified grid, null if out of bounds or of mixed parity."""
    high, wide = unified_shape(rows, cols, overlap)
    inside = (u_row >= 0) & (u_col >= 0) & (u_row < high) & (u_col < wide)
    even = (F.pmod(u_row, F.lit(2)) == 0) & (F.pmod(u_col, F.lit(2)) == 0)
    odd = (F.pmod(u_row, F.lit(2)) == 1) & (F.pmod(u_col, F.lit(2)) == 1)
    kind = F.when(~overlap | even, MAIN).when(odd, OVERLAP)
    row, col = (_int(F.when(overlap, F.floor(x / 2)).otherwise(x)) for x in (u_row, u_col))
    return F.when(inside & kind.isNotNull(), F.struct(kind.alias("kind"), row.alias("row"), col.alias("col")))


def pixel_to_grid(value: Column, offset: Column, tile: Column, round_up: bool = False) -> Column:
    """Row or column of a pixel; rounds down or up, below 0 too, and doesn't clamp."""
    at = (value - offset) / tile
    return _int(F.ceil(at) if round_up else F.floor(at))


def level0(value: Column, ds: Column) -> Column:
    """A level's pixels in level-0 pixels, cut towards zero."""
    return (value * ds).cast("int")


def patches(grids: DataFrame, overlap: bool | Column = True) -> DataFrame:
    """All tiles of grids ``(width, height, tile[, x_off, y_off, ds, level, ...])``.

    Adds ``kind, row, col, y, x, size_px, flat_idx, u_row, u_col``; grids smaller than a tile give none.
    Other columns pass.
    """
    given = grids
    for name, value in (("x_off", F.lit(0)), ("y_off", F.lit(0)), ("ds", F.lit(1.0)), ("level", F.lit(None).cast("int"))):
        if name not in grids.columns:
            given = given.withColumn(name, value)
    rows, cols = tile_counts(F.col("width"), F.col("height"), F.col("tile"))
    given = given.withColumns({"__rows": rows, "__cols": cols}).where("__rows > 0 AND __cols > 0")
    r, c = F.col("__rows"), F.col("__cols")
    given = given.withColumn("__both", has_overlap(r, c, overlap))
    slots = F.sequence(F.lit(0), grid_length(r, c, F.col("__both")) - 1)
    out = given.withColumn("flat_idx", F.explode(slots)).withColumn("__at", locate_flat(F.col("flat_idx"), r, c, F.col("__both")))
    out = out.select(*[x for x in given.columns], "flat_idx", "__at.*")
    u_row, u_col = unify(F.col("kind"), F.col("row"), F.col("col"), F.col("__both"))
    shift = F.when(F.col("kind") == OVERLAP, F.floor(F.col("tile") / 2)).otherwise(0)
    return out.withColumns(
        {
            "y": _int(F.col("y_off") + F.col("row") * F.col("tile") + shift),
            "x": _int(F.col("x_off") + F.col("col") * F.col("tile") + shift),
            "size_px": _int(F.col("tile")),
            "u_row": u_row,
            "u_col": u_col,
        }
    ).drop("__rows", "__cols", "__both")


def region_patches(regions: DataFrame, tile: int, ds: float, level: int | None = None, overlap: bool = True) -> DataFrame:
    """Tiles of boxes ``(region_index, x, y, w, h)`` of level 0, in the level's pixels.

    Origins and sizes are cut towards zero separately; a region smaller than a tile gives none. For a
    whole slide pass its size as region 0.
    """
    cut = lambda c: (F.col(c) / ds).cast("int")
    given = regions.select(
        "region_index", cut("w").alias("width"), cut("h").alias("height"), cut("x").alias("x_off"), cut("y").alias("y_off"),
        F.lit(tile).alias("tile"), F.lit(float(ds)).alias("ds"), F.lit(level).cast("int").alias("level"),
    )
    return patches(given, overlap)


def layer_summary(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles and covered pixels by the given keys and layer."""
    return tiles.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size_px").cast("long") * F.col("size_px")).alias("pixels"))


def query_size(ratio: Column, megapixels: Column) -> tuple[Column, Column]:
    """Width and height in pixels of an image of a ratio ``'a:b'`` and so many million pixels."""
    a, b = (F.split(ratio, ":")[i].cast("double") for i in (0, 1))
    unit = F.sqrt(megapixels * 1e6 / (a * b))
    return (unit * a).cast("int"), (unit * b).cast("int")


def align_features(grid: DataFrame, features: DataFrame, keys: tuple[str, ...] = ("map_id", "flat_idx")) -> DataFrame:
    """Features joined to their tiles one to one; raises where a map has more or fewer features than tiles."""
    odd = grid.select(*keys).exceptAll(features.select(*keys)).union(features.select(*keys).exceptAll(grid.select(*keys))).take(1)
    if odd:
        raise ValueError(f"features and tiles differ at {odd[0].asDict()}")
    return grid.join(features, list(keys))


def crop_window(
    top: Column, left: Column, bottom: Column, right: Column, pad: Column, rows: Column, cols: Column
) -> dict[str, Column]:
    """Rows and columns ``[r0, r1) x [c0, c1)`` of a crop in grid units after padding, kept inside the grid (X11)."""
    return {
        "r0": _int(F.greatest(F.lit(0), top - pad)),
        "c0": _int(F.greatest(F.lit(0), left - pad)),
        "r1": _int(F.least(rows, bottom + pad)),
        "c1": _int(F.least(cols, right + pad)),
    }


def crop(
    grids: DataFrame, top: Column, left: Column, bottom: Column | None = None, right: Column | None = None, height: Column | None = None,
    width: Column | None = None, unit: str = "grid", pad: Column | int = 0, pad_unit: str | None = None,
) -> DataFrame:
    """Crops of grids ``(width, height, tile[, x_off, y_off, ...])`` as new grids of whole tiles (X11).

    Corners are rows and columns, or with ``unit="pixel"`` the level's global pixels; either the far corner or a
    size is given. A padding in pixels is rounded up to tiles; crops are kept inside the grid. Adds ``r0, c0,
    r1, c1``, the old grid's place ``old_rows, old_cols, layered``, and changes ``width, height, x_off, y_off``. Reading a crop without a tile is an error.
    """
    if (bottom is None) == (height is None) or (right is None) == (width is None):
        raise ValueError("give either the far corner or the size")
    pad_unit = pad_unit or unit
    if unit not in ("grid", "pixel") or pad_unit not in ("grid", "pixel"):
        raise ValueError(f"no unit {unit!r}, {pad_unit!r}")
    bottom, right = (top + height, left + width) if bottom is None else (bottom, right)
    given = grids
    for name in ("x_off", "y_off"):
        given = given if name in grids.columns else given.withColumn(name, F.lit(0))
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    if unit == "pixel":
        top, left = (pixel_to_grid(v, F.col(o), F.col("tile")) for v, o in ((top, "y_off"), (left, "x_off")))
        bottom, right = (pixel_to_grid(v, F.col(o), F.col("tile"), True) for v, o in ((bottom, "y_off"), (right, "x_off")))
    pad = F.ceil(pad / F.col("tile")) if pad_unit == "pixel" else pad
    rows, cols = tile_counts(F.col("width"), F.col("height"), F.col("tile"))
    told = given.withColumns({"old_rows": rows, "old_cols": cols, "layered": has_overlap(rows, cols)} | crop_window(top, left, bottom, right, pad, rows, cols))
    empty = (F.col("r0") >= F.col("r1")) | (F.col("c0") >= F.col("c1"))
    whole = lambda c: F.when(empty, F.raise_error(F.lit("the crop is empty"))).otherwise(_int(c))
    return told.withColumns(
        {
            "height": whole((F.col("r1") - F.col("r0")) * F.col("tile")), "width": whole((F.col("c1") - F.col("c0")) * F.col("tile")),
            "y_off": _int(F.col("y_off") + F.col("r0") * F.col("tile")), "x_off": _int(F.col("x_off") + F.col("c0") * F.col("tile")),
        }
    )


def cropped_patches(crops: DataFrame) -> DataFrame:
    """The tiles of :func:`crop`, of both layers if the old grid has them, and ``old_flat``, their number in the old grid."""
    tiles = patches(crops, F.col("layered"))
    row, col = F.col("row") + F.col("r0"), F.col("col") + F.col("c0")
    main = flat_of_main(row, col, F.col("old_rows"), F.col("old_cols"), F.col("layered"))
    return tiles.withColumn("old_flat", F.when(F.col("kind") == MAIN, main).otherwise(flat_of_overlap(row, col, F.col("old_cols"))))


def layer_features(grid: DataFrame, features: DataFrame, kind: str, keys: tuple[str, ...] = ("map_id", "flat_idx")) -> DataFrame:
    """``(map_id, row, col, feat)`` of one layer of a grid."""
    one = grid.where(F.col("kind") == kind)
    return one.join(features, list(keys)).select(*[k for k in keys if k != "flat_idx"], "row", "col", "feat")


def search_window(local: Column, extent: Column, tile: Column, pad: Column, limit: Column) -> tuple[Column, Column]:
    """Start and end of a crop around a match: whole tiles of the query, padded by tiles, inside the region."""
    whole = F.ceil(extent / tile) * tile
    return _int(F.greatest(F.lit(0), local - pad * tile)), _int(F.least(limit, local + whole + pad * tile))
