"""Window similarity of many kernels against plain loops, odd cells, blocks and keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseek.operators import retrieval

GRID = "slide_id int, region_index int, kind string, row int, col int, feat array<double>, level int"
KERNEL = "query_id string, q_row int, q_col int, feat array<double>, level int"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(grid, kernels, match=False):
    out = {}
    by: dict = {}
    for q, r, c, v, level in kernels:
        if good(v):
            by.setdefault((q, level), []).append((r, c, v))
    maps: dict = {}
    for s, reg, kind, r, c, v, level in grid:
        if good(v):
            maps.setdefault((s, reg, kind, level), {})[(r, c)] = v
    for (s, reg, kind, level), cells in maps.items():
        for (q, q_level), cells_q in by.items():
            if match and level != q_level:
                continue
            h, w = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
            for r in range(h):
                for c in range(w):
                    if all((r + a, c + b) in cells for a, b, _ in cells_q):
                        out[(s, q, reg, kind, r, c)] = sum(float(np.dot(cells[(r + a, c + b)], v)) for a, b, v in cells_q) / len(cells_q)
    return out


@pytest.fixture(scope="module")
def tables():
    draw = np.random.default_rng(1)
    grid = []
    for s, reg, kind, h, w, level in ((0, 0, "main", 13, 9, 0), (0, 0, "overlap", 12, 8, 0), (0, 1, "main", 2, 2, 1), (1, 0, "main", 7, 40, 1)):
        for r in range(h):
            for c in range(w):
                grid.append((s, reg, kind, r, c, draw.standard_normal(3).tolist(), level))
    grid[5] = (*grid[5][:5], None, 0)
    grid[40] = (*grid[40][:5], [float("nan"), 0.0, 1.0], 0)
    grid[77] = (*grid[77][:5], [None, 0.0, 1.0], 0)
    grid = [g for k, g in enumerate(grid) if k % 50 != 49]  # and cells that aren't there
    kernels = []
    for q, shape, level in (("a", (2, 3), 0), ("b", (2, 3), 1), ("c", (1, 1), 1), ("d", (5, 1), 0), ("e", (20, 20), 0)):
        kernels += [(q, r, c, draw.standard_normal(3).tolist(), level) for r in range(shape[0]) for c in range(shape[1])]
    kernels.append(("d", 5, 0, None, 0))
    kernels.append(("f", 0, 0, [float("inf"), 0.0, 0.0], 0))
    return grid, kernels


@pytest.mark.parametrize("block, part, side", [(32, 16384, 4096), (2, 30, 4)])
@pytest.mark.parametrize("match", [False, True])
def test_many_kernels(spark, tables, monkeypatch, block, part, side, match):
    for name, value in (("BLOCK", block), ("PART_CELLS", part), ("SIDE_CELLS", side), ("AT_ONCE", 2)):
        monkeypatch.setattr(retrieval, name, value)
    grid, kernels = spark.createDataFrame(tables[0], GRID), spark.createDataFrame(tables[1], KERNEL)
    keys = {"slide": ("slide_id",), "query": ("query_id",), "match": ("level",) if match else ()}
    scores = retrieval.window_similarity(grid, kernels, **keys)
    want = plain(*tables, match)
    got = {tuple(r)[:2] + (r["region_index"], r["kind"], r["out_r"], r["out_c"]): r["score"] for r in scores.select("slide_id", "query_id", "region_index", "kind", "out_r", "out_c", "score").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    by = ("slide_id", "query_id")
    best = {tuple(r) for r in retrieval.best_per_region(scores, keys=by).collect()}
    only = retrieval.window_similarity(grid, kernels, **keys, best_only=True)
    assert {tuple(r) for r in retrieval.best_per_region(only, keys=by).collect()} == best and only.count() < scores.count()


def test_nothing_to_find(spark, tables):
    grid, kernels = spark.createDataFrame(tables[0], GRID), spark.createDataFrame(tables[1], KERNEL)
    keys = (("slide_id",), ("query_id",))
    assert retrieval.window_similarity(grid.where("false"), kernels, *keys).count() == 0
    assert retrieval.window_similarity(grid, kernels.where("false"), *keys).count() == 0
    assert retrieval.window_similarity(grid, kernels.where("query_id = 'f'"), *keys).count() == 0
    assert retrieval.window_similarity(grid, kernels.where("query_id = 'e'"), *keys).count() == 0
    assert retrieval.window_similarity(grid.withColumn("feat", F.lit(None).cast("array<double>")), kernels, *keys).count() == 0


def test_a_hundred_thousand_kernels(spark):
    """No kernel and no key passes through the driver: nothing is collected but counts and sizes."""
    cell = lambda seed: F.array(*[F.sin(F.col("id") * (k + 1) + seed).cast("float") for k in range(4)])
    grid = spark.range(40 * 40).select(F.lit(0).alias("region_index"), F.lit("main").alias("kind"), F.floor(F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), cell(0).alias("feat"))
    kernels = spark.range(400_000).select(F.floor(F.col("id") / 4).alias("query_id"), F.floor(F.col("id") % 4 / 2).cast("int").alias("q_row"), (F.col("id") % 2).cast("int").alias("q_col"), cell(1).alias("feat"))
    best = retrieval.best_per_region(retrieval.window_similarity(grid, kernels, query=("query_id",), best_only=True), keys=("query_id",))
    assert best.count() == 100_000
    some = {r["query_id"]: r for r in best.where("query_id % 25000 = 7").collect()}
    x = np.array([r["feat"] for r in grid.orderBy("row", "col").collect()], dtype=float).reshape(40, 40, 4)
    for q, r in some.items():
        v = np.array([k["feat"] for k in kernels.where(F.col("query_id") == q).orderBy("q_row", "q_col").collect()], dtype=float).reshape(2, 2, 4)
        all_scores = np.array([[(x[i : i + 2, j : j + 2] * v).sum() / 4 for j in range(39)] for i in range(39)])
        i, j = np.unravel_index(np.round(all_scores, 9).argmax(), all_scores.shape)
        assert (r["out_r"], r["out_c"]) == (i, j) and abs(r["score"] - all_scores[i, j]) < 1e-8
