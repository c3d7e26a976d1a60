"""Sliding-window similarity over feature grids.

A feature grid is ``([slide,] region_index, kind, row, col, feat)``, a kernel ``([query,] q_row, q_col, feat)``. Grids
are cut into blocks of windows, each with the halo of cells that its windows reach; blocks are dealt into parts and
kernels into sides, and each part meets each side in one group. There a whole window is scored by matrix products,
for all kernels of one layout at once, so that no votes are summed afterwards and neither kernels nor their keys pass
through the driver. Keys of slides (columns of the grid) and of queries (columns of the kernel) run through all
operators, so that many slides and many kernels are one job.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.operators.vectors import DIGITS, finite
from gridseek.plans.durable import broadcast_if_small, materialize, unused

#: Windows along a side of a block at least; cells of a part and of a side; kernels scored at once.
BLOCK, PART_CELLS, SIDE_CELLS, AT_ONCE = 32, 16_384, 4096, 512
_NONE = float("-inf")


def _layouts(kernels: pd.DataFrame, query: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]]:
    """Kernels of one layout together: their rows and columns of cells, vectors ``(cells, kernels, components)`` and keys."""
    kernels = kernels.sort_values([*query, "q_row", "q_col"], kind="stable").reset_index(drop=True)
    number = kernels.groupby(query, dropna=False, sort=False).ngroup().to_numpy() if query else np.zeros(len(kernels), dtype=np.int64)
    place = kernels[["q_row", "q_col"]].to_numpy(dtype=np.int64)
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    alike: dict[bytes, list[slice]] = {}
    for first, last in zip(starts, [*starts[1:], len(kernels)]):
        alike.setdefault(place[first:last].tobytes(), []).append(slice(first, last))
    out = []
    for held in alike.values():
        vectors = np.stack([np.stack(kernels["feat"].to_numpy()[s]) for s in held], axis=1).astype(np.float64)
        rows, cols = place[held[0]].T
        out.append((rows, cols, vectors, kernels[query].iloc[[s.start for s in held]].reset_index(drop=True)))
    return out


def _block_scores(cells: pd.DataFrame, block: int, kernels: list, best: bool):
    """For each layout and up to ``AT_ONCE`` of its kernels: their keys, which of them, window rows, columns and scores of a block."""
    top, left = int(cells["block_r"].iloc[0]) * block, int(cells["block_c"].iloc[0]) * block
    row, col = cells["row"].to_numpy(dtype=np.int64) - top, cells["col"].to_numpy(dtype=np.int64) - left
    index = np.full((row.max() + block + 1, col.max() + block + 1), -1)
    index[row, col] = np.arange(len(cells))
    x = np.stack(cells["feat"].to_numpy()).astype(np.float64)
    for rows, cols, vectors, keys in kernels:
        high, wide = min(block, row.max() + 1 - rows.max()), min(block, col.max() + 1 - cols.max())
        if high <= 0 or wide <= 0:
            continue
        at = np.stack([index[r : r + high, c : c + wide] for r, c in zip(rows, cols)])
        r, c = np.nonzero((at >= 0).all(axis=0))
        if not len(r):
            continue
        at = at[:, r, c]
        for first in range(0, len(keys), AT_ONCE):
            part = vectors[:, first : first + AT_ONCE]
            score = sum(x[i] @ v.T for i, v in zip(at, part)) / len(rows)
            if best:  # windows are in row order, so that the first of the best is the one that counts
                most = np.round(score, DIGITS).argmax(axis=0)
                yield keys, np.arange(first, first + part.shape[1]), top + r[most], left + c[most], score[most, np.arange(part.shape[1])]
            else:
                which = np.repeat(np.arange(first, first + part.shape[1]), len(r))
                yield keys, which, np.tile(top + r, part.shape[1]), np.tile(left + c, part.shape[1]), score.T.ravel()


def _group_scores(grid: pd.DataFrame, kernels: pd.DataFrame, keys: list[str], query: list[str], names: list[str], block: int, best: bool) -> pd.DataFrame:
    out = []
    layouts = _layouts(kernels, query) if len(grid) and len(kernels) else []
    for _, cells in grid.groupby([*keys, "block_r", "block_c"], dropna=False, sort=False) if layouts else ():
        for told, which, r, c, score in _block_scores(cells, block, layouts, best):
            part = told.iloc[which].reset_index(drop=True)
            for k in keys:
                part[k] = pd.Series([cells[k].iloc[0]] * len(part), dtype=cells[k].dtype)
            out.append(part.assign(out_r=r, out_c=c, score=score)[names])
    return pd.concat(out) if out else pd.DataFrame(columns=names, dtype=object)


def window_similarity(grid: DataFrame, kernel: DataFrame, slide: tuple[str, ...] = (), query: tuple[str, ...] = (), match: tuple[str, ...] = (), best_only: bool = False) -> DataFrame:
    """``([slide, query, match,] region_index, kind, out_r, out_c, score)``: mean inner product over every whole window.

    ``slide`` names key columns of the grid, ``query`` of the kernels, ``match`` columns of both that have to be equal,
    such as a level. Cells and places are unique within a key and start at 0. Cells without a vector of numbers take no
    part: no whole window covers one of a grid, and one of a kernel is left out of the mean. With ``best_only`` a group
    gives its best window for each kernel and region only, which is all that :func:`best_per_region` needs.
    """
    keys = [*slide, *(m for m in match if m not in slide), "region_index", "kind"]
    own = [q for q in query if q not in match]
    cells = grid.where(F.coalesce(finite("feat"), F.lit(False))).select(*keys, "row", "col", "feat")
    # under new names, as kernels may be cut from the grid itself
    asked = kernel.where(F.coalesce(finite("feat"), F.lit(False))).select(*[F.col(c).alias(c) for c in (*match, *own, "q_row", "q_col", "feat")])
    rows, cols = asked.agg(F.coalesce(F.max("q_row"), F.lit(0)), F.coalesce(F.max("q_col"), F.lit(0))).first()
    block = max(BLOCK, rows, cols)
    parts, sides = unused([*keys, *own], "parts", "sides")
    count = lambda df, n, name: df.groupBy(*match).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / n)).cast("int").alias(name))
    sizes = count(cells, PART_CELLS, parts), count(asked, SIDE_CELLS, sides)
    if match:
        told = broadcast_if_small(materialize(sizes[0].join(sizes[1], list(match))))
        cells, asked = cells.join(told, list(match)), asked.join(told, list(match))
    else:
        n_parts, n_sides = sizes[0].first()[0], sizes[1].first()[0]
        cells, asked = (df.withColumns({parts: F.lit(n_parts), sides: F.lit(n_sides)}) for df in (cells, asked))
    near = lambda c, reach: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - reach) / block).cast("int"), F.floor(F.col(c) / block).cast("int")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda names, n: F.pmod(F.xxhash64(*names), F.col(n)).cast("int")
    held = cells.withColumn("block_r", near("row", rows)).withColumn("block_c", near("col", cols))
    held = held.withColumn("part", dealt([*keys, "block_r", "block_c"], parts)).withColumn("side", every(sides)).drop(parts, sides)
    asks = asked.withColumn("side", dealt(own, sides) if own else F.lit(0)).withColumn("part", every(parts)).drop(parts, sides)
    schema = T.StructType([*(kernel.schema[q] for q in own), *(grid.schema[k] for k in keys), T.StructField("out_r", T.IntegerType()), T.StructField("out_c", T.IntegerType()), T.StructField("score", T.DoubleType())])
    made = partial(_group_scores, keys=keys, query=own, names=schema.names, block=block, best=best_only)
    scores = held.groupBy(*match, "part", "side").cogroup(asks.groupBy(*match, "part", "side")).applyInPandas(made, schema)
    return scores.select(*dict.fromkeys([*slide, *query, *match]), "region_index", "kind", "out_r", "out_c", "score")


def best_per_region(scores: DataFrame, digits: int = 9, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best window of every region and kind; of equal scores the first in row order (A2)."""
    best = F.max_by(F.struct("out_r", "out_c"), F.struct(F.round("score", digits).alias("s"), (-F.col("out_r")).alias("r"), (-F.col("out_c")).alias("c")))
    found = scores.groupBy(*keys, "region_index", "kind").agg(best.alias("b"), F.max(F.round("score", digits)).alias("score"))
    return found.select(*keys, "region_index", "kind", "b.out_r", "b.out_c", "score")


def best_of_kind(per_region: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best region's window of a kind, the earliest region at equal scores; zeros and -inf if none (A3).

    Without keys one row; with keys one for each that occurs in ``per_region``.
    """
    of_kind = F.when(F.col("kind") == kind, F.struct("score", (-F.col("region_index")).alias("i")))
    row = per_region.groupBy(*keys).agg(F.max_by(F.struct("region_index", "out_r", "out_c", "score"), of_kind).alias("b"))
    zero = F.lit(0)
    return row.select(
        *keys,
        F.coalesce("b.region_index", zero).alias("region_index"),
        F.coalesce("b.out_r", zero).alias("out_r"),
        F.coalesce("b.out_c", zero).alias("out_c"),
        F.coalesce("b.score", F.lit(_NONE)).alias("score"),
    )


def place(start: Column, cell: Column, kind: Column, tile: Column | int, ds: Column) -> Column:
    """Level pixels of a window: the region's start, whole tiles, and half a tile for the overlap layer."""
    tile = F.lit(tile) if isinstance(tile, int) else tile
    return (start / ds).cast("int") + cell * tile + F.when(kind == "overlap", F.floor(tile / 2).cast("int")).otherwise(0)


def find_best(scores: DataFrame, regions: DataFrame, tile: int, ds: float | str, keys: tuple[str, ...] = (), slide: tuple[str, ...] = ()) -> DataFrame:
    """The best main and overlap windows and the better one, overlap only if strictly better (A4): one row, or one of each key.

    ``regions`` is ``([slide,] region_index, x, y)`` at level 0; ``ds`` is a number, or a column of ``regions`` if
    slides have their own. Level-0 places are the level's times ``ds``, cut.
    """
    per_region = best_per_region(scores, keys=keys)
    scale = F.lit(ds) if not isinstance(ds, str) else F.col("r_ds")
    starts = regions.select(*slide, "region_index", F.col("x").alias("rx"), F.col("y").alias("ry"), *([F.col(ds).alias("r_ds")] if isinstance(ds, str) else []))
    sides = []
    for kind in ("main", "overlap"):
        one = best_of_kind(per_region, kind, keys).join(starts, [*slide, "region_index"], "left")
        found = F.col("score") > _NONE
        at = lambda start, cell, kind=kind: F.when(found, place(F.coalesce(F.col(start), F.lit(0)), F.col(cell), F.lit(kind), tile, scale)).otherwise(0)
        row = F.struct("region_index", at("rx", "out_c").alias("x"), at("ry", "out_r").alias("y"), "score", scale.alias("ds"))
        sides.append(one.select(*keys, row.alias(kind)))
    both = sides[0].join(sides[1], list(keys)) if keys else sides[0].join(sides[1], F.lit(True))  # one row each
    other = F.col("overlap.score") > F.col("main.score")
    best = F.when(other, F.col("overlap")).otherwise(F.col("main"))
    zero = lambda c: (c * best["ds"]).cast("int")
    return both.select(
        *keys,
        F.when(other, "overlap").otherwise("main").alias("kind"),
        best["region_index"].alias("region_index"),
        best["x"].alias("x"), best["y"].alias("y"), zero(best["x"]).alias("x0"), zero(best["y"]).alias("y0"), best["score"].alias("score"),
        F.col("main.x").alias("main_x"), F.col("main.y").alias("main_y"), F.col("main.score").alias("main_score"),
        F.col("overlap.x").alias("overlap_x"), F.col("overlap.y").alias("overlap_y"), F.col("overlap.score").alias("overlap_score"),
    )


def heat_canvas(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``([keys,] u_row, u_col, score)`` of canvases that windows are painted on; the last writer wins.

    Regions paint in order, main windows before overlap windows, each in row order.
    """
    order = F.struct("region_index", F.when(F.col("kind") == "main", 0).otherwise(1).alias("k"), "out_r", "out_c")
    odd = F.when(F.col("kind") == "overlap", 1).otherwise(0)
    cells = scores.withColumns({"u_row": 2 * F.col("out_r") + odd, "u_col": 2 * F.col("out_c") + odd})
    # a window of the unified canvas covers its cell and the half cells right of and below it
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    painted = cells.withColumn("d", spread).select(*keys, (F.col("u_row") + F.col("d.i")).alias("u_row"), (F.col("u_col") + F.col("d.j")).alias("u_col"), "score", order.alias("at"))
    return painted.groupBy(*keys, "u_row", "u_col").agg(F.max_by("score", "at").alias("score"))


def rotated(kernel: DataFrame) -> DataFrame:
    """The kernel turned by 0, 90, 180 and 270 degrees, with a column ``rot``."""
    size = kernel.agg(F.max("q_row").alias("h"), F.max("q_col").alias("w"))
    k = kernel.join(F.broadcast(size), F.lit(True)).withColumn("rot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    r, c, h, w = (F.col(x) for x in ("q_row", "q_col", "h", "w"))
    row = F.when(F.col("rot") == 0, r).when(F.col("rot") == 1, c).when(F.col("rot") == 2, h - r).otherwise(w - c)
    col = F.when(F.col("rot") == 0, c).when(F.col("rot") == 1, h - r).when(F.col("rot") == 2, w - c).otherwise(r)
    return k.select("rot", row.alias("q_row"), col.alias("q_col"), "feat")
