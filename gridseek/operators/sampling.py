"""Coverage-constrained tile sampling (X3, W8, F3) and level fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.operators.raster import has_tissue, to_mask
from gridseek.operators.regions import filter_regions, merge_overlapping, patchable

#: Strides and shifts of the candidate stream; any two numbers prime to the usual ranges do.
STRIDE_X, SHIFT_X, STRIDE_Y, SHIFT_Y = 7919, 17, 104729, 31


def candidates(boxes: DataFrame, tries: int, size: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """``([keys,] try, index, x, y, size)``: a fixed stream of tile places, uniform over boxes and places inside.

    Boxes are the regions of one slide, or of one slide and level for each value of ``keys``, and get their
    turn by ``index``; boxes smaller than ``size`` have to be filtered before. Each box lists the tries that are
    its turn, so that nothing is broadcast.
    """
    side = F.lit(size) if isinstance(size, int) else size
    every = Window.partitionBy(*keys)
    numbered = boxes.select(*keys, "index", "x", "y", "w", "h", side.alias("size")).withColumns(
        {"turn": F.row_number().over(every.orderBy("index")) - 1, "boxes": F.count(F.lit(1)).over(every)}
    )
    mine = F.when(F.col("turn") < tries, F.sequence(F.col("turn"), F.lit(tries - 1), F.col("boxes").cast("int")))
    at = numbered.withColumn("try", F.explode(mine)).withColumn("try", F.col("try").cast("int"))
    step = lambda n, stride, shift: F.pmod(F.col("try").cast("long") * stride + shift, (F.col(n) - F.col("size") + 1).cast("long"))
    x, y = F.col("x") + step("w", STRIDE_X, SHIFT_X), F.col("y") + step("h", STRIDE_Y, SHIFT_Y)
    return at.select(*keys, "try", "index", x.alias("x"), y.alias("y"), "size")


def accepted(stream: DataFrame, mask: DataFrame, mask_ds: float, width: int, height: int, ratio: float = 0.5, keys: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Candidates on enough true cells; origin and size are turned into mask cells separately."""
    m = lambda c: to_mask(c, F.lit(1.0), F.lit(mask_ds))
    by = [*([slide] if slide else []), *(k for k in keys if k != slide)]
    named = F.struct(*by, "try").alias("tile_id")
    cells = stream.select(*([slide] if slide else []), named, m(F.col("x")).alias("x"), m(F.col("y")).alias("y"), m(F.col("size")).alias("w"), m(F.col("size")).alias("h"))
    good = has_tissue(cells, mask, width, height, ratio, slide).where("ok").select("tile_id.*")
    return stream.join(good, [*by, "try"])


def first_n(stream: DataFrame, n: int, by: tuple[str, ...] = ("level",)) -> DataFrame:
    """The first ``n`` accepted tries of every level: what a loop that stops at ``n`` keeps."""
    order = Window.partitionBy(*by).orderBy("try")
    return stream.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def sample_tiles(
    boxes: DataFrame, mask: DataFrame, levels: list[tuple[int, float]] | DataFrame, n: int, tile: int, mask_ds: float, width: int, height: int,
    ratio: float = 0.5, min_ratio: float = 0.01, slide: str | None = None,
) -> DataFrame:
    """``([slide,] level, nth, try, index, x, y)``: up to ``n`` tiles for each ``(level, ds)`` out of ``5 n`` tries.

    Regions are filtered and merged first, and for each level those count that hold a tile (X2); ``index`` is
    that of the merged region. ``levels`` are pairs, or rows ``([slide,] level, ds)``. All levels and slides are one job.
    """
    by = [slide] if slide else []
    regions = merge_overlapping(filter_regions(boxes, min_ratio, slide), slide).drop("n")
    if isinstance(levels, list):
        levels = boxes.sparkSession.createDataFrame(levels, "level int, ds double")
    both = regions.join(levels.select(*by, "level", "ds"), slide) if slide else regions.join(F.broadcast(levels.select("level", "ds")), F.lit(True))
    fit = patchable(both, tile, F.col("ds"))
    stream = candidates(fit, 5 * n, (tile * F.col("ds")).cast("int"), (*by, "level"))
    good = accepted(stream, mask, mask_ds, width, height, ratio, (*by, "level"), slide)
    return first_n(good, n, (*by, "level")).select(*by, "level", "nth", "try", "index", "x", "y")


def level_fingerprint(stats: DataFrame, n: int, keys: tuple[str, ...] = ("level",), levels: DataFrame | None = None) -> DataFrame:
    """``(level, stat)``: median of the first ``n`` accepted statistics ``(level, try, deviation, stat)``.

    A tile of deviation below 6 is blank and not accepted. Levels of ``levels`` without any have a NaN; without
    that table they have no row.
    """
    found = first_n(stats.where(F.col("deviation") >= 6), n, keys).groupBy(*keys).agg(F.median("stat").alias("stat"))
    if levels is None:
        return found
    return levels.select(*keys).join(found, list(keys), "left").withColumn("stat", F.coalesce("stat", F.lit(float("nan"))))
