"""Masks as sets of true cells ``([slide,] y, x)``, gray histograms and morphology.

``slide`` names a column that tells the masks of several slides apart (whole numbers below 2^21 for components, whose
masks have sides below 2^21). Widths and heights are numbers, or columns of the mask or of the tiles where slides
differ in size.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.operators.components import connected_components
from gridseek.plans.durable import unused


def _keys(slide: str | None) -> list[str]:
    return [slide] if slide else []


def _value(x: int | float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _exact(scale: float | Column) -> Column:
    """A scale, one that is written as a number by its decimal digits: 50 * 2.3 is 115 and not the double below it."""
    return scale if isinstance(scale, Column) else F.lit(Decimal(format(Decimal(str(scale)), "f")))


def to_mask(value: Column, scale: Column, mask_scale: Column) -> Column:
    """A coordinate in mask cells, cut towards zero; scales are downsamples or microns a pixel."""
    return (value * scale / mask_scale).cast("int")


def mask_slice(mask: DataFrame, x: int, y: int, w: int, h: int, scale: float = 1.0, mask_scale: float = 1.0) -> DataFrame:
    """True cells of a rectangle (F1), which may be in another scale: a level's downsample or microns a pixel, and the mask's.

    Origin and size are cut towards zero separately.
    """
    x, y, w, h = (int(v * scale / mask_scale) for v in (x, y, w, h))
    return mask.where((F.col("x") >= max(x, 0)) & (F.col("x") < x + w) & (F.col("y") >= max(y, 0)) & (F.col("y") < y + h))


def mask_fraction(mask: DataFrame, width: int, height: int) -> DataFrame:
    """One row ``(fraction)``."""
    return mask.agg((F.count(F.lit(1)) / F.lit(float(width * height))).alias("fraction"))


def mask_fractions(mask: DataFrame, sizes: DataFrame, slide: str) -> DataFrame:
    """``(slide, fraction)`` of every slide of ``sizes (slide, width, height)``."""
    held = mask.groupBy(slide).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(held, slide, "left").select(slide, (F.coalesce("n", F.lit(0)) / (F.col("width").cast("double") * F.col("height"))).alias("fraction"))


def coverage(tiles: DataFrame, mask: DataFrame, width: int | Column, height: int | Column, cell: int = 32, slide: str | None = None) -> DataFrame:
    """``tiles ([slide,] tile_id, x, y, w, h)`` in mask cells and ``covered``: the share of true cells of the part inside.

    True cells are summed by coarse cells first; a tile meets only the coarse cells that it touches. A
    tile without a part inside has a null share.
    """
    by = _keys(slide)
    coarse = mask.select(*by, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), "x", "y").distinct()
    x0, y0 = F.greatest(F.col("x"), F.lit(0)), F.greatest(F.col("y"), F.lit(0))
    x1, y1 = F.least(F.col("x") + F.col("w"), _value(width)), F.least(F.col("y") + F.col("h"), _value(height))
    clipped = tiles.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1})
    area = F.when((F.col("__x1") > F.col("__x0")) & (F.col("__y1") > F.col("__y0")), (F.col("__x1") - F.col("__x0")) * (F.col("__y1") - F.col("__y0")))
    clipped = clipped.withColumn("__area", area)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    inside = clipped.where("__area IS NOT NULL").select(*by, "tile_id", "__x0", "__y0", "__x1", "__y1", span("__x0", "__x1").alias("cx"))
    inside = inside.withColumn("cy", span("__y0", "__y1"))
    hits = inside.join(coarse, [*by, "cx", "cy"]).where("x >= __x0 AND x < __x1 AND y >= __y0 AND y < __y1").groupBy(*by, "tile_id").agg(F.count(F.lit(1)).alias("__hits"))
    out = clipped.join(hits, [*by, "tile_id"], "left").withColumn("covered", F.coalesce("__hits", F.lit(0)) / F.col("__area"))
    return out.select(*tiles.columns, "covered")


def has_tissue(tiles: DataFrame, mask: DataFrame, width: int | Column, height: int | Column, ratio: float = 0.5, slide: str | None = None) -> DataFrame:
    """``tiles`` and ``ok``: a positive area and a share of at least ``ratio``."""
    got = coverage(tiles, mask, width, height, slide=slide)
    return got.withColumn("ok", (F.col("w") * F.col("h") > 0) & F.coalesce(F.col("covered") >= ratio, F.lit(False))).drop("covered")


def disagreement(a: DataFrame, b: DataFrame, width: int, height: int) -> DataFrame:
    """One row ``(disagreement)``: the share of cells true in one mask only."""
    both = a.select("y", "x", F.lit(1).alias("n")).union(b.select("y", "x", F.lit(1).alias("n")))
    lone = both.groupBy("y", "x").agg(F.sum("n").alias("n")).where("n = 1")
    return lone.agg((F.count(F.lit(1)) / F.lit(float(width * height))).alias("disagreement"))


def _rest(mask: DataFrame, axis: str) -> list[str]:
    """The columns of a mask but one axis."""
    return [c for c in mask.columns if c != axis]


def _stretched(mask: DataFrame, axis: str, size: int | Column, radius: int) -> DataFrame:
    steps = F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) - radius), F.least(_value(size) - 1, F.col(axis) + radius)))
    return mask.select(*_rest(mask, axis), steps.alias(axis)).distinct()


def dilate(mask: DataFrame, width: int | Column, height: int | Column, radius: int = 3) -> DataFrame:
    """Cells within ``radius`` rows and columns of a true cell (W6); one axis after the other.

    Columns besides ``y`` and ``x``, such as a slide's id and size, tell masks apart.
    """
    return _stretched(_stretched(mask, "x", width, radius), "y", height, radius).select(*mask.columns)


def _shrunk(mask: DataFrame, axis: str, size: int | Column, radius: int) -> DataFrame:
    near = Window.partitionBy(*_rest(mask, axis)).orderBy(axis).rangeBetween(-radius, radius)
    inside = F.least(_value(size) - 1, F.col(axis) + radius) - F.greatest(F.lit(0), F.col(axis) - radius) + 1
    return mask.withColumn("__n", F.count(F.lit(1)).over(near)).where(F.col("__n") == inside).drop("__n")


def erode(mask: DataFrame, width: int | Column, height: int | Column, radius: int = 3) -> DataFrame:
    """Cells whose whole neighbourhood inside the image is true."""
    return _shrunk(_shrunk(mask.distinct(), "x", width, radius), "y", height, radius)


def close_open(mask: DataFrame, width: int | Column, height: int | Column, radius: int = 3) -> DataFrame:
    """Closing, then opening."""
    closed = erode(dilate(mask, width, height, radius), width, height, radius)
    return dilate(erode(closed, width, height, radius), width, height, radius)


def hsv_mask(pixels: DataFrame, slide: str | None = None) -> DataFrame:
    """True cells of ``([slide,] y, x, r, g, b)``: saturation above 15, value between 30 and 240 (M6, before morphology)."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(high == 0, 0.0).otherwise(F.round(255.0 * (high - low) / high))
    return pixels.where((saturation > 15) & (high > 30) & (high < 240)).select(*_keys(slide), "y", "x")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of a colour, rounded (M8)."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def otsu(pixels: DataFrame, value: str = "g", black: int = 20, slide: str | None = None) -> DataFrame:
    """One row ``(threshold, variance)``, or one of each slide: the gray value of largest variance between classes.

    Values up to ``black`` don't count. Of equal variances the least value wins; none without values. At
    most 256 counts of a slide reach the window.
    """
    by = _keys(slide)
    held = pixels.where(F.col(value) > black).groupBy(*by, F.col(value).alias("g")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    every = Window.partitionBy(*by)
    upto = every.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("g")
    sums = held.select(*by, "g", F.sum("n").over(upto).alias("w0"), F.sum(mass).over(upto).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(mass).over(every).alias("s"))
    w0, w1 = F.col("w0") / F.col("w"), 1 - F.col("w0") / F.col("w")
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    scored = sums.where("w > w0").select(*by, "g", F.round(w0 * w1 * apart * apart, 6).alias("v"))
    best = scored.groupBy(*by).agg(F.max_by("g", F.struct("v", (-F.col("g")).alias("low"))).alias("threshold"), F.max("v").alias("variance"))
    return best.where("threshold IS NOT NULL")


def otsu_mask(pixels: DataFrame, value: str = "g", black: int = 20, slide: str | None = None) -> DataFrame:
    """Cells darker than the threshold and lighter than black (M7, before morphology)."""
    best = otsu(pixels, value, black, slide)
    both = pixels.join(best, slide) if slide else pixels.join(F.broadcast(best), F.lit(True))
    return both.where((F.col(value) > black) & (F.col(value) < F.col("threshold"))).select(*_keys(slide), "y", "x")


def row_runs(mask: DataFrame, slide: str | None = None) -> DataFrame:
    """Runs ``([slide,] y, x0, x1, run)`` of true cells in rows; ``run`` is unique."""
    by = _keys(slide)
    (island,) = unused([*mask.columns, "x0", "x1"], "island")
    order = Window.partitionBy(*by, "y").orderBy("x")
    found = mask.select(*by, "y", "x").repartition(*by, "y").distinct().withColumn(island, F.col("x") - F.row_number().over(order))
    return _numbered(found.groupBy(*by, "y", island).agg(F.min("x").alias("x0"), F.max("x").alias("x1")), slide)


def _numbered(runs: DataFrame, slide: str | None) -> DataFrame:
    y = F.col("y").cast("long")
    run = F.col(slide).cast("long") * (1 << 42) + y * (1 << 21) if slide else y * (1 << 31)
    return runs.select(*_keys(slide), "y", "x0", "x1", (run + F.col("x0")).alias("run"))


def components(mask: DataFrame, slide: str | None = None) -> DataFrame:
    """``([slide,] y, x0, x1, label)``: runs and their 8-connected component, labelled by its first run."""
    return run_components(row_runs(mask, slide), slide)


def run_components(runs: DataFrame, slide: str | None = None, block: int = 1024) -> DataFrame:
    """:func:`components` of a mask that is given as maximal runs ``([slide,] y, x0, x1)``.

    Runs of adjacent rows meet by blocks of columns, the pair in the block where they begin to touch.
    """
    by, runs = _keys(slide), _numbered(runs, slide)
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block).cast("int"), F.floor(b / block).cast("int")))
    above = runs.select(*by, "y", "run", (F.col("x0") - 1).alias("a0"), (F.col("x1") + 1).alias("a1"))
    above = above.withColumn("block", blocks(F.col("a0"), F.col("a1")))
    below = runs.select(*by, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("below"), blocks(F.col("x0"), F.col("x1")).alias("block"))
    touch = (F.col("b0") <= F.col("a1")) & (F.col("b1") >= F.col("a0")) & (F.floor(F.greatest("a0", "b0") / block) == F.col("block"))
    edges = above.join(below.hint("merge"), [*by, "y", "block"]).where(touch).select(F.col("run").alias("src"), F.col("below").alias("dst"))
    roots = connected_components(edges)
    return runs.join(roots.hint("merge"), runs["run"] == roots["node"], "left").select(*by, "y", "x0", "x1", F.coalesce("component", "run").alias("label"))


def region_boxes(mask: DataFrame, ds_x: float | Column, ds_y: float | Column, min_area: int = 100, slide: str | None = None, scales: DataFrame | None = None) -> DataFrame:
    """``([slide,] index, x, y, w, h, area)``: level-0 boxes of components of at least ``min_area`` cells (A10).

    Components are numbered by their first row and column, those of each slide from 0; coordinates and sizes
    are cut separately. Where slides have their own scales they are columns of ``scales``, one row a slide.
    """
    return run_boxes(row_runs(mask, slide), ds_x, ds_y, min_area, slide, scales)


def run_boxes(runs: DataFrame, ds_x: float | Column, ds_y: float | Column, min_area: int = 100, slide: str | None = None, scales: DataFrame | None = None) -> DataFrame:
    """:func:`region_boxes` of a mask that is given as maximal runs."""
    by = _keys(slide)
    boxes = run_components(runs, slide).groupBy(*by, "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
        F.min("x0").alias("l"), F.min("y").alias("t"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
    ).where(F.col("area") >= min_area)
    boxes = boxes if scales is None else boxes.join(scales, slide)
    index = (F.row_number().over(Window.partitionBy(*by).orderBy("t", "l", "label")) - 1).cast("int")  # the regions of one slide
    cut = lambda c, d: (F.col(c) * _exact(d)).cast("int")
    return boxes.select(*by, index.alias("index"), cut("l", ds_x).alias("x"), cut("t", ds_y).alias("y"), cut("w", ds_x).alias("w"), cut("h", ds_y).alias("h"), "area")


def reconstruction_coverage(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """One row ``(coverage)``: the share of an image's pixels under its tiles ``(x, y, size_px)``.

    Rows of pixels are merged into intervals, so that pixels are never listed.
    """
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top))
    spans = tiles.select(
        clip(F.col("x"), width).alias("a"), clip(F.col("x") + F.col("size_px"), width).alias("b"),
        F.explode(F.sequence(F.greatest(F.col("y"), F.lit(0)), F.col("y") + F.col("size_px") - 1)).alias("y"),
    ).where((F.col("y") < height) & (F.col("b") > F.col("a")))
    before = F.max("b").over(Window.partitionBy("y").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.col("a"))))
    return spans.select(new.alias("n")).agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(width * height))).alias("coverage"))
