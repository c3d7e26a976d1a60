"""Bounding-box algebra (F5, F6, J8, J9, A11, X1, X2). Boxes are ``([slide,] index, x, y, w, h)``.

``slide`` names a column that tells the boxes of several slides apart, of whole numbers below 2^31.

Overlaps and containments are found by cells of a pyramid: a box is held in the one cell of its own size where its
corner lies and asks for others in the cells of its own and all larger sizes, so that neither a large box lists many
cells nor does a box meet all others, and a pair meets once. Spark deals the cells into groups of some ``GROUP_ROWS`` rows;
a group's pairs are tested some ``BATCH_PAIRS`` at a time, and only what an operator asks for leaves it: index pairs,
the boxes that lie in others, or a tree of the boxes that hang together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridseek.operators.components import connected_components, local_roots
from gridseek.plans.durable import materialize, unused

#: Rows of a group of cells, and pairs that are tested together.
GROUP_ROWS, BATCH_PAIRS = 200_000, 1_000_000


def _keys(slide: str | None) -> list[str]:
    return [slide] if slide else []


def _met(boxes: DataFrame, slide: str | None, inside: bool) -> DataFrame:
    """Boxes as ``(group, slide, level, cx, cy, asks, own, index, x, y, w, h)``, held once and asking in every cell where a partner may be.

    With ``inside`` only boxes that may hold the one that asks are looked for.
    """
    known = boxes.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*_keys(slide), "index", "x", "y", "w", "h")))
    owner = (F.col(slide) if slide else F.lit(0)).cast("long").alias("slide")
    own = F.ceil(F.log2(F.greatest("w", "h", F.lit(1)).cast("double"))).cast("int").alias("own")
    sized = known.select(owner, own, *[F.col(c).cast("long").alias(c) for c in ("index", "x", "y", "w", "h")])
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    held = sized.withColumn("level", F.col("own")).withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y")), "asks": F.lit(False)})
    used = F.broadcast(sized.select("slide", F.col("own").alias("level")).distinct())  # a few sizes a slide
    asks = sized.join(used, "slide").where("level >= own")
    reach = F.pow(F.lit(2.0), F.col("level"))

    def span(at: str, side: str) -> Column:
        first, last = (F.col(at) + F.col(side) - reach, F.col(at)) if inside else (F.col(at) - reach, F.col(at) + F.col(side))
        return F.explode(F.sequence(cell(first), cell(last)))

    asks = asks.withColumn("cx", span("x", "w")).withColumn("cy", span("y", "h")).withColumn("asks", F.lit(True))
    names = ["slide", "level", "cx", "cy", "asks", "own", "index", "x", "y", "w", "h"]
    # cells where nothing is held give no pairs
    full = held.select("slide", "level", "cx", "cy").distinct()
    rows = materialize(held.select(*names).unionByName(asks.join(full, ["slide", "level", "cx", "cy"], "left_semi").select(*names)))
    return rows.withColumn("group", F.pmod(F.xxhash64("slide", "level", "cx", "cy"), F.lit(max(1, -(-rows.count() // GROUP_ROWS)))))


class _Sides:
    """A group's rows as arrays: those that ask, those that are held by cell, and of each row that asks the first held one and their number."""

    def __init__(self, rows: pd.DataFrame):
        cell = rows.groupby(["slide", "level", "cx", "cy"], sort=False).ngroup().to_numpy()
        asks = rows["asks"].to_numpy(dtype=bool)
        place = cell * 2 + asks
        columns = {c: rows[c].to_numpy() for c in ("slide", "level", "own", "index", "x", "y", "w", "h")}
        # the largest first, which hold most
        order = np.lexsort((-columns["w"] * columns["h"], place))
        asked, held = order[asks[order]], order[~asks[order]]
        self.a, self.b = ({c: v[at] for c, v in columns.items()} for at in (asked, held))
        self.first = np.searchsorted(cell[held], cell[asked], "left")
        self.number = np.searchsorted(cell[held], cell[asked], "right") - self.first

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows that ask and of held ones that share pixels, each pair of boxes once."""
        a, b = self.a, self.b
        for i, j in _expanded(self.first, self.number):
            near = (a["x"][i] < b["x"][j] + b["w"][j]) & (b["x"][j] < a["x"][i] + a["w"][i])
            i, j = i[near], j[near]
            near = (a["y"][i] < b["y"][j] + b["h"][j]) & (b["y"][j] < a["y"][i] + a["h"][i])
            i, j = i[near], j[near]
            once = np.where(a["own"][i] < a["level"][i], a["index"][i] != b["index"][j], a["index"][i] < b["index"][j])
            yield i[once], j[once]

    def partial(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of which neither holds the other."""
        for i, j in self.pairs():
            apart = ~(_holds(self.b, j, self.a, i) | _holds(self.a, i, self.b, j))
            yield i[apart], j[apart]


def _holds(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
    """Whether boxes of ``a`` hold those of ``b``."""
    x = (b["x"][j] >= a["x"][i]) & (b["x"][j] + b["w"][j] <= a["x"][i] + a["w"][i])
    return x & (b["y"][j] >= a["y"][i]) & (b["y"][j] + b["h"][j] <= a["y"][i] + a["h"][i])


def _expanded(first: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every place with each of its ``number`` partners from ``first`` on, some ``BATCH_PAIRS`` at a time."""
    ends = np.cumsum(number)
    at = 0
    while at < len(number):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BATCH_PAIRS, "right")))
        some = number[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[at:to], some)
        yield i, j
        at = to


def _overlaps(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(slide, a, b)``, a < b, of partial overlaps."""
    sides = _Sides(pd.concat(list(groups)))
    for i, j in sides.partial():
        x, y = sides.a["index"][i], sides.b["index"][j]
        yield pd.DataFrame({"slide": sides.a["slide"][i], "a": np.minimum(x, y), "b": np.maximum(x, y)})


def _ties(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(src, dst)``: a tree for each set of boxes that partial overlaps of the group tie; without slides all have the slide 0."""
    sides = _Sides(pd.concat(list(groups)))
    a, b = (side["slide"] * (1 << 32) + side["index"] for side in (sides.a, sides.b))
    src = dst = np.zeros(0, dtype=np.int64)
    for i, j in sides.partial():
        src, dst = local_roots(np.concatenate([src, a[i]]), np.concatenate([dst, b[j]]))
    yield pd.DataFrame({"src": src, "dst": dst})


def _inner(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(slide, index)`` of boxes that lie in another; a box that was found is not asked for again."""
    sides = _Sides(pd.concat(list(groups)))
    a, b = sides.a, sides.b
    open_, tried, step = np.arange(len(sides.first)), 0, 8
    while len(open_ := open_[sides.number[open_] > tried]):
        found = np.zeros(len(sides.first), dtype=bool)
        for i, j in _expanded(sides.first[open_] + tried, np.minimum(sides.number[open_] - tried, step)):
            i = open_[i]
            found[i[_holds(b, j, a, i) & (a["index"][i] != b["index"][j])]] = True
        yield pd.DataFrame({"slide": a["slide"][found], "index": a["index"][found]})
        open_, tried, step = open_[~found[open_]], tried + step, 2 * step


def large_enough(boxes: DataFrame, min_ratio: float, slide: str | None = None) -> DataFrame:
    """Boxes of at least ``min_ratio`` of the largest area of their slide."""
    (name,) = unused(boxes.columns, "most")
    most = boxes.groupBy(*_keys(slide)).agg(F.max(F.col("w") * F.col("h")).alias(name))
    both = boxes.join(most, slide) if slide else boxes.join(F.broadcast(most), F.lit(True))
    return both.where(F.col("w") * F.col("h") >= F.col(name) * min_ratio).select(*boxes.columns)


def not_contained(boxes: DataFrame, slide: str | None = None) -> DataFrame:
    """Boxes that lie in no other box; equal boxes contain each other and both go."""
    inner = _met(boxes, slide, True).groupBy("group").applyInPandas(_inner, "slide long, index long").distinct()
    return boxes.join(inner.select(*[F.col("slide").alias(c) for c in _keys(slide)], "index"), [*_keys(slide), "index"], "left_anti")


def filter_regions(boxes: DataFrame, min_ratio: float, slide: str | None = None) -> DataFrame:
    """Large boxes that lie in no other large box."""
    return not_contained(large_enough(boxes, min_ratio, slide), slide)


def patchable(boxes: DataFrame, tile: int, ds: float | Column) -> DataFrame:
    """Boxes that hold a tile of a level."""
    return boxes.where((F.col("w") >= tile * ds) & (F.col("h") >= tile * ds))


def partial_overlaps(boxes: DataFrame, slide: str | None = None) -> DataFrame:
    """``([slide,] a, b)`` indexes, a < b, of boxes that overlap without one containing the other."""
    kept = _met(boxes, slide, False).groupBy("group").applyInPandas(_overlaps, "slide long, a long, b long")
    of = lambda c, name, as_name: F.col(c).cast(boxes.schema[name].dataType).alias(as_name)
    return kept.select(*[of("slide", c, c) for c in _keys(slide)], of("a", "index", "a"), of("b", "index", "b"))


def merge_overlapping(boxes: DataFrame, slide: str | None = None) -> DataFrame:
    """Boxes tied by partial overlaps become their common box, numbered by their least index.

    With a slide each one's boxes are numbered from 0, in one window a slide. Without one the boxes are those
    of a single slide, and the window holds one row for each merged box of it.
    """
    by = _keys(slide)
    node = lambda c: (F.col(slide).cast("long") * (1 << 32) if slide else F.lit(0)) + F.col(c).cast("long")
    roots = connected_components(_met(boxes, slide, False).groupBy("group").applyInPandas(_ties, "src long, dst long"))
    named = boxes.withColumn("node", node("index")).join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    merged = named.groupBy(*by, "root").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count(F.lit(1)).alias("n")
    )
    number = (F.row_number().over(Window.partitionBy(*by).orderBy("root")) - 1).cast("int")
    return merged.select(*by, number.alias("index"), "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), "n")


class RegionHistory:
    """Versions of a region table: filters and merges push, ``undo`` pops, ``resume`` starts again.

    A merge of fewer than two boxes changes nothing and pushes nothing.
    """

    def __init__(self, boxes: DataFrame):
        self.first, self.now, self.stack = boxes, boxes, []

    def apply(self, change) -> DataFrame:
        self.stack.append(self.now)
        self.now = change(self.now)
        return self.now

    def merge(self) -> DataFrame:
        return self.now if len(self.now.take(2)) < 2 else self.apply(merge_overlapping)

    def undo(self) -> bool:
        if not self.stack:
            return False
        self.now = self.stack.pop()
        return True

    def resume(self) -> DataFrame:
        self.now, self.stack = self.first, []
        return self.now


class RegionLog:
    """Versions of a region table in a folder that outlives the session.

    Every change appends a version and a row ``(step, version, parent, change)`` to the log; nothing is ever rewritten. Undo
    and resume append a step that names an older version, so that reading any version is reading its own files. A version
    whose write failed has no step and is written over by the next one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.folder}/version-{version}"

    def steps(self) -> DataFrame:
        return self.spark.read.schema(self._STEP).parquet(f"{self.folder}/steps")

    def _append(self, version: int, parent: int | None, change: str) -> None:
        try:
            step = self.steps().agg(F.max("step")).first()[0] or 0
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            step = 0  # the first version
        self.spark.createDataFrame([(step + 1, version, parent, change)], self._STEP).coalesce(1).write.mode("append").parquet(f"{self.folder}/steps")

    def start(self, boxes: DataFrame) -> DataFrame:
        """The first version."""
        boxes.write.mode("overwrite").parquet(self._path(0))
        self._append(0, None, "start")
        return self.now()

    def head(self) -> int:
        """The version that counts."""
        return self.steps().agg(F.max_by("version", "step")).first()[0]

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version))

    def now(self) -> DataFrame:
        return self.read(self.head())

    def apply(self, change: Callable[[DataFrame], DataFrame], name: str = "change") -> DataFrame:
        """A new version out of the present one."""
        new = self.steps().agg(F.max("version")).first()[0] + 1
        head = self.head()
        change(self.read(head)).write.mode("overwrite").parquet(self._path(new))
        self._append(new, head, name)
        return self.now()

    def merge(self, slide: str | None = None) -> DataFrame:
        """Merge overlapping boxes; fewer than two change nothing and append nothing."""
        return self.now() if len(self.now().take(2)) < 2 else self.apply(lambda b: merge_overlapping(b, slide), "merge")

    def undo(self) -> bool:
        """Back to the version that the present one was made of."""
        head = self.head()
        parent = self.steps().where((F.col("version") == head) & ~F.col("change").isin("undo", "resume")).agg(F.max("parent")).first()[0]
        if parent is None:
            return False
        self._append(parent, None, "undo")
        return True

    def resume(self) -> DataFrame:
        """Back to the first version."""
        self._append(0, None, "resume")
        return self.now()

    _STEP = "step int, version int, parent int, change string"


def regions_for_level(boxes: DataFrame, tile: int, ds: float | Column, min_ratio: float = 0.01, slide: str | None = None) -> DataFrame:
    """Boxes of a level for sampling: filtered, merged, patchable; nothing has to be restored."""
    return patchable(merge_overlapping(filter_regions(boxes, min_ratio, slide), slide), tile, ds)
