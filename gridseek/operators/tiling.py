"""Memory-bounded tiling of large rasters with a halo (X4) and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.plans.durable import unused


def tile_plan(images: DataFrame, budget: int) -> DataFrame:
    """``images`` and ``n_h, n_w``: cuts of each side so that ``(h // n_h) * (w // n_w)`` is within ``budget``.

    The longer side of a part is halved first, the height at a tie. A side can be halved once for each of its
    bits until a part of it is empty, so that twice as many steps as a number has bits always end it.
    """
    h, w = F.col("height").cast("long"), F.col("width").cast("long")
    start = F.struct(F.lit(1).cast("long").alias("n_h"), F.lit(1).cast("long").alias("n_w"))

    def cut(state: Column, _: Column) -> Column:
        part_h, part_w = F.floor(h / state["n_h"]), F.floor(w / state["n_w"])
        taller = part_h >= part_w
        halved = F.struct((state["n_h"] * F.when(taller, 2).otherwise(1)).alias("n_h"), (state["n_w"] * F.when(taller, 1).otherwise(2)).alias("n_w"))
        return F.when(part_h * part_w > budget, halved).otherwise(state)

    (plan,) = unused(images.columns, "plan")
    planned = images.withColumn(plan, F.aggregate(F.sequence(F.lit(1), F.lit(2 * 63)), start, cut))
    return planned.select(*images.columns, F.col(f"{plan}.n_h").cast("int").alias("n_h"), F.col(f"{plan}.n_w").cast("int").alias("n_w"))


def halo_tiles(planned: DataFrame, halo: int) -> DataFrame:
    """One row for each part: its core ``[y0, y1) x [x0, x1)`` and the window with a halo inside the image.

    The last row and column take what is left over.
    """
    parts = planned.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_h") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_w") - 1)))
    out = {}
    for c, n, k, size in (("y", "n_h", "i", "height"), ("x", "n_w", "j", "width")):
        step = F.floor(F.col(size) / F.col(n)).cast("int")
        out[f"{c}0"] = (F.col(k) * step).cast("int")
        out[f"{c}1"] = F.when(F.col(k) == F.col(n) - 1, F.col(size)).otherwise((F.col(k) + 1) * step).cast("int")
    parts = parts.withColumns(out)
    return parts.withColumns(
        {
            "wy0": F.greatest(F.lit(0), F.col("y0") - halo), "wx0": F.greatest(F.lit(0), F.col("x0") - halo),
            "wy1": F.least(F.col("height"), F.col("y1") + halo).cast("int"), "wx1": F.least(F.col("width"), F.col("x1") + halo).cast("int"),
        }
    )


def batch_of(flat: Column, size: int) -> Column:
    """Number of the batch of a flat index."""
    return F.floor(flat / size).cast("int")
