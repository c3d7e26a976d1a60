"""Masks of slides: choice of the level, segmentation of whole images or of parts with a halo, regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.functions.image import decode
from gridseek.operators.levels import best_level
from gridseek.operators.raster import close_open, hsv_mask, otsu_mask, run_boxes
from gridseek.operators.runs import cells, merged
from gridseek.operators.tiling import halo_tiles, tile_plan
from gridseek.plans.durable import materialize
from gridseek.sources.slides import CHUNK, read_regions

#: Pixels of a part that a segmenter sees at once.
PART_PIXELS = 1 << 24


def tissue_cells(pixels: DataFrame, width, height, method: str = "hsv", radius: int = 3, slide: str | None = None) -> DataFrame:
    """True cells of pixel rows ``([slide,] y, x, r, g, b)`` by a threshold, closed and opened (M6, M7).

    ``method`` is ``hsv``, or ``otsu`` of the pixels' gray values. Sizes are numbers or columns of the pixels.
    """
    if method == "hsv":
        mask = hsv_mask(pixels, slide)
    else:
        gray = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int")
        mask = otsu_mask(pixels.withColumn("g", gray), slide=slide)
    return close_open(mask, width, height, radius)


def hsv_segmenter(pixels: np.ndarray, radius: int = 3) -> np.ndarray:
    """The same of one image in a task: the default of the segmenter slot."""
    high, low = pixels.max(axis=2).astype(np.int64), pixels.min(axis=2).astype(np.int64)
    saturation = np.floor(255.0 * (high - low) / np.maximum(high, 1) + 0.5)
    mask = (saturation > 15) & (high > 30) & (high < 240)

    def slid(held: np.ndarray, any_: bool) -> np.ndarray:
        for axis in (0, 1):
            edge = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(held, edge, constant_values=not any_), 2 * radius + 1, axis=axis)
            held = windows.any(axis=2) if any_ else windows.all(axis=2)
        return held

    return slid(slid(slid(slid(mask, True), False), False), True)


def _core_runs(mask: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and ends of the runs of a mask whose first cell is at ``(y, x)``."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step > 0)
    return row + y, first + x, np.nonzero(step < 0)[1] - 1 + x


def segmented_runs(
    chunks: DataFrame, images: DataFrame, method: Callable[[np.ndarray], np.ndarray] = hsv_segmenter, budget: int | None = PART_PIXELS, halo: int = 128, chunk: int = CHUNK
) -> DataFrame:
    """``(slide_id, y, x0, x1)``: maximal runs of true cells of levels ``(slide_id, level, width, height)`` by a segmenter.

    ``method`` maps an image to a mask of its size; of class numbers pass those that are equal to the class. A level
    of more than ``budget`` pixels is cut into parts, each read with a halo that is trimmed again; the last parts
    take what is left over. With None a level is one image in one task, for methods that have to see all of it. A
    part gives its runs; those that parts cut are joined again.
    """
    sized = images.select("slide_id", "level", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    planned = sized.withColumns({"n_h": F.lit(1), "n_w": F.lit(1)}) if budget is None else tile_plan(sized, budget)
    parts = halo_tiles(planned, halo)
    # a slide's level has fewer than 2^16 parts along a side
    parts = parts.withColumn("read_id", F.col("slide_id").cast("long") * (1 << 32) + F.col("i") * (1 << 16) + F.col("j"))
    asked = parts.select(
        "read_id", "slide_id", "level", F.col("wx0").alias("px"), F.col("wy0").alias("py"), (F.col("wx1") - F.col("wx0")).alias("pw"), (F.col("wy1") - F.col("wy0")).alias("ph")
    )

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                p = r["place"]
                mask = np.asarray(method(decode(r["image"])), dtype=bool)
                core = mask[p["y0"] - p["wy0"] : p["y1"] - p["wy0"], p["x0"] - p["wx0"] : p["x1"] - p["wx0"]]
                y, first, last = _core_runs(core, p["y0"], p["x0"])
                yield pd.DataFrame({"slide_id": r["slide_id"], "y": y, "x0": first, "x1": last})

    place = F.struct("y0", "y1", "x0", "x1", "wy0", "wx0")
    both = read_regions(chunks, asked, chunk).join(parts.select("read_id", "slide_id", place.alias("place")), "read_id")
    kind = images.schema["slide_id"].dataType.simpleString()
    return merged(both.select("slide_id", "image", "place").mapInPandas(found, f"slide_id {kind}, y int, x0 int, x1 int"))


def segmented(
    chunks: DataFrame, images: DataFrame, method: Callable[[np.ndarray], np.ndarray] = hsv_segmenter, budget: int | None = PART_PIXELS, halo: int = 128, chunk: int = CHUNK
) -> DataFrame:
    """``(slide_id, y, x)``: the cells of :func:`segmented_runs`, for small masks."""
    return cells(segmented_runs(chunks, images, method, budget, halo, chunk))


def mask_levels(slides: DataFrame, levels: DataFrame, ds: float = 32.0, level: int | None = None) -> DataFrame:
    """``(slide_id, level, width, height, ds_x, ds_y, mask_mpp)``: the level that each slide's mask is made of.

    The level of largest downsample up to ``ds``, or ``level``, negative ones from the end. ``slides`` is ``(slide_id,
    mpp_x, mpp_y)``, missing values count as 0; ``levels`` is ``(slide_id, level, ds, width, height)``.
    """
    if level is None:
        chosen = best_level(slides.withColumn("want_ds", F.lit(float(ds))), levels, ("slide_id",))
    else:
        most = levels.groupBy("slide_id").agg(F.max("level").alias("last"))
        chosen = slides.join(most, "slide_id").withColumn("level", F.lit(level) if level >= 0 else F.col("last") + 1 + level)
    full = levels.where("level = 0").select("slide_id", F.col("width").alias("w0"), F.col("height").alias("h0"))
    told = chosen.select("slide_id", "level", "mpp_x", "mpp_y").join(levels.select("slide_id", "level", "width", "height"), ["slide_id", "level"]).join(full, "slide_id")
    ds_x, ds_y = F.col("w0") / F.col("width"), F.col("h0") / F.col("height")
    mpp = (F.coalesce("mpp_x", F.lit(0.0)) + F.coalesce("mpp_y", F.lit(0.0))) / 2 * (ds_x + ds_y) / 2
    return told.select("slide_id", "level", "width", "height", ds_x.alias("ds_x"), ds_y.alias("ds_y"), mpp.alias("mask_mpp"))


def slide_regions(
    chunks: DataFrame, slides: DataFrame, levels: DataFrame, ds: float = 32.0, level: int | None = None, method: Callable[[np.ndarray], np.ndarray] = hsv_segmenter,
    budget: int | None = PART_PIXELS, halo: int = 128, min_area: int = 100, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Masks, their scales and the regions of all slides: ``(slide_id, y, x)``, :func:`mask_levels` and boxes.

    Regions are made of the masks' runs, which are written once; cells are listed only where they are read.
    """
    runs, scales, boxes = slide_run_regions(chunks, slides, levels, ds, level, method, budget, halo, min_area, chunk)
    return cells(runs), scales, boxes


def slide_run_regions(
    chunks: DataFrame, slides: DataFrame, levels: DataFrame, ds: float = 32.0, level: int | None = None, method: Callable[[np.ndarray], np.ndarray] = hsv_segmenter,
    budget: int | None = PART_PIXELS, halo: int = 128, min_area: int = 100, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with masks as runs ``(slide_id, y, x0, x1)``."""
    scales = mask_levels(slides, levels, ds, level)
    runs = materialize(segmented_runs(chunks, scales, method, budget, halo, chunk))
    return runs, scales, run_boxes(runs, F.col("ds_x"), F.col("ds_y"), min_area, "slide_id", scales.select("slide_id", "ds_x", "ds_y"))
