"""Masks as runs ``(..., y, x0, x1)`` of true cells, both ends included: set operations, morphology, areas.

Columns besides ``y``, ``x0`` and ``x1``, such as a slide's id and size, tell masks apart. A run is two events in its
row, one where it begins and one after its end; all operators are running sums of events along rows, so that the
work follows the runs and never the cells. One operator is one shuffle by row, closing and opening one by bands of rows. What an operator gives is maximal:
no two runs of a row touch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.plans.durable import unused


#: Rows of a band, whose runs are swept together.
BAND_ROWS = 256


def _value(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _names(runs: DataFrame) -> list[str]:
    return [c for c in runs.columns if c not in ("y", "x0", "x1")]


def swept(weighted: list[tuple[DataFrame, int]], keep: Callable[[Column], Column], dealt: bool = False) -> DataFrame:
    """Runs of the cells for which ``keep`` holds of the sum of weights of the runs above them, but not of 0.

    Every table of ``weighted`` has a weight; ``keep`` may use the other columns and ``y``. A single table may be
    ``dealt`` by some of its columns but ``y`` already.
    """
    names = _names(weighted[0][0])
    x, step, total, after, kept = unused([*names, "y", "x0", "x1"], "x", "step", "total", "after", "kept")
    ends = lambda w: F.inline(F.array(F.struct(F.col("x0").alias(x), F.lit(w).alias(step)), F.struct((F.col("x1") + 1).alias(x), F.lit(-w).alias(step))))
    events = reduce(DataFrame.union, [runs.select(*names, "y", ends(w)) for runs, w in weighted])
    # events of one place are one before rows are sorted
    events = (events if dealt else events.repartition(*names, "y")).groupBy(*names, "y", x).agg(F.sum(step).alias(step))
    row = Window.partitionBy(*names, "y").orderBy(x)
    sums = events.withColumn(total, F.sum(step).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    places = sums.withColumn(kept, (F.col(total) != 0) & keep(F.col(total)))
    changes = places.withColumn(step, F.lag(kept, 1, False).over(row)).where(F.col(step) != F.col(kept))
    runs = changes.withColumn(after, F.lead(x).over(row)).where(kept)
    return runs.select(*names, "y", F.col(x).alias("x0"), (F.col(after) - 1).cast("int").alias("x1")).withColumn("x0", F.col("x0").cast("int"))


def merged(runs: DataFrame, dealt: bool = False) -> DataFrame:
    """Maximal runs of runs that may overlap, touch or repeat."""
    return swept([(runs, 1)], lambda n: n > 0, dealt)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of either mask; runs may overlap."""
    return swept([(a, 1), (b, 1)], lambda n: n > 0)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both masks; each has no two runs that overlap."""
    return swept([(a, 1), (b, 1)], lambda n: n == 2)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the first mask only; each has no two runs that overlap."""
    return swept([(a, 1), (b, 2)], lambda n: n == 1)


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of one mask only; each has no two runs that overlap."""
    return swept([(a, 1), (b, 2)], lambda n: n != 3)


def _near(height: int | Column, radius: int) -> Column:
    y = F.col("y")
    return F.sequence(F.greatest(F.lit(0), y - radius), F.least(_value(height) - 1, y + radius))


def dilate(runs: DataFrame, width: int | Column, height: int | Column, radius: int = 3, dealt: bool = False) -> DataFrame:
    """Cells within ``radius`` rows and columns of a true cell, inside the image."""
    wide = runs.withColumns({"x0": F.greatest(F.lit(0), F.col("x0") - radius), "x1": F.least(_value(width) - 1, F.col("x1") + radius)})
    return merged(wide.withColumn("y", F.explode(_near(height, radius))), dealt).select(*runs.columns)


def erode(runs: DataFrame, width: int | Column, height: int | Column, radius: int = 3, dealt: bool = False) -> DataFrame:
    """Cells whose whole neighbourhood inside the image is true, of maximal runs."""
    first, last = F.col("x0"), F.col("x1")
    narrow = runs.withColumns({"x0": F.when(first > 0, first + radius).otherwise(first), "x1": F.when(last < _value(width) - 1, last - radius).otherwise(last)})
    spread = narrow.where("x0 <= x1").withColumn("y", F.explode(_near(height, radius)))
    return swept([(spread, 1)], lambda n: n == F.size(_near(height, radius)), dealt).select(*runs.columns)


def close_open(runs: DataFrame, width: int | Column, height: int | Column, radius: int = 3, rows: int = BAND_ROWS) -> DataFrame:
    """Closing, then opening; runs may overlap.

    Rows are dealt once, in bands with as many rows beside them as the four steps reach; each step then stays inside its band.
    """
    (band,) = unused(runs.columns, "band")
    reach, of = 4 * radius, lambda y: F.floor(y / rows).cast("int")
    bands = F.explode(F.sequence(of(F.greatest(F.lit(0), F.col("y") - reach)), of(F.least(_value(height) - 1, F.col("y") + reach))))
    held = runs.withColumn(band, bands).repartition(*_names(runs), band)
    closed = erode(dilate(held, width, height, radius, True), width, height, radius, True)
    opened = dilate(erode(closed, width, height, radius, True), width, height, radius, True)
    return opened.where(of(F.col("y")) == F.col(band)).select(*runs.columns)


def areas(runs: DataFrame) -> DataFrame:
    """``(..., area)`` of each mask that has cells, without such columns one row, 0 of no runs; no two runs overlap."""
    return runs.groupBy(*_names(runs)).agg(F.coalesce(F.sum(F.col("x1").cast("long") - F.col("x0") + 1), F.lit(0)).alias("area"))


def cells(runs: DataFrame) -> DataFrame:
    """``(..., y, x)``: the cells of runs that don't overlap, for small masks."""
    return runs.select(*_names(runs), "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def scaled(runs: DataFrame, scale: float | Column, y: float | Column | None = None) -> DataFrame:
    """Runs in a finer scale: each cell becomes the whole cells from its cut place to that of the next."""
    down = scale if y is None else y
    at = lambda c, k: (c * (k if isinstance(k, Column) else F.lit(float(k)))).cast("int")
    rows = F.explode(F.sequence(at(F.col("y"), down), at(F.col("y") + 1, down) - 1))
    return runs.withColumns({"x0": at(F.col("x0"), scale), "x1": at(F.col("x1") + 1, scale) - 1, "y": rows}).select(*runs.columns)
