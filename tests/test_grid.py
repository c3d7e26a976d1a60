"""Worked examples and round trips of grids."""

import pytest
from pyspark.sql import functions as F

from gridseek.operators import grid, tiling


@pytest.mark.parametrize(
    "width, height, main, over",
    [(512, 512, 16, 9), (384, 256, 6, 2), (256, 256, 4, 1), (128, 128, 1, 0), (127, 128, 0, 0), (0, 0, 0, 0), (384, 128, 3, 0), (128, 384, 3, 0), (129, 257, 2, 0)],
)
def test_counts(spark, width, height, main, over):
    df = grid.patches(spark.createDataFrame([(width, height, 128)], "width int, height int, tile int"))
    got = {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert (got.get("main", 0), got.get("overlap", 0)) == (main, over)


def test_offset_and_flat_numbers(spark):
    df = grid.patches(spark.createDataFrame([(256, 256, 128, 128, 64, 4.0, 2)], "width int, height int, tile int, x_off int, y_off int, ds double, level int"))
    rows = df.orderBy("flat_idx").collect()
    assert [(r["kind"], r["y"], r["x"]) for r in rows] == [("main", 64, 128), ("overlap", 128, 192), ("main", 64, 256), ("main", 192, 128), ("main", 192, 256)]
    assert {r["level"] for r in rows} == {2}


def test_round_trip(spark):
    sizes = [(c * 10, r * 10, 10, i) for i, (r, c) in enumerate((r, c) for r in range(1, 6) for c in range(1, 6))]
    df = grid.patches(spark.createDataFrame(sizes, "width int, height int, tile int, id int"))
    rows, cols = grid.tile_counts(F.col("width"), F.col("height"), F.col("tile"))
    both = grid.has_overlap(rows, cols)
    back = F.when(F.col("kind") == "main", grid.flat_of_main(F.col("row"), F.col("col"), rows, cols, both)).otherwise(grid.flat_of_overlap(F.col("row"), F.col("col"), cols))
    placed = grid.locate_unified(F.col("u_row"), F.col("u_col"), rows, cols, both)
    bad = df.where((back != F.col("flat_idx")) | (placed["kind"] != F.col("kind")) | (placed["row"] != F.col("row")) | (placed["col"] != F.col("col")))
    assert bad.count() == 0
    assert df.groupBy("id").agg((F.max("flat_idx") + 1 - F.count("*")).alias("d")).where("d <> 0").count() == 0


def test_wrong_places_are_null(spark):
    df = spark.createDataFrame([(-1,), (0,), (24,), (25,)], "f int").select(grid.locate_flat(F.col("f"), F.lit(4), F.lit(4), F.lit(True)).alias("p"))
    assert [r["p"] is None for r in df.collect()] == [True, False, False, True]
    mixed = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (8, 0)], "r int, c int").select(grid.locate_unified(F.col("r"), F.col("c"), F.lit(4), F.lit(4), F.lit(True)).alias("p"))
    assert [r["p"] is None for r in mixed.collect()] == [True, True, False, True]


def test_level0(spark):
    rows = [(100, 4.0, 400), (50, 2.0, 100), (64, 1.0, 64), (33, 3.0, 99), (3, 1.3, 3)]
    df = spark.createDataFrame(rows, "v int, ds double, want int").withColumn("got", grid.level0(F.col("v"), F.col("ds")))
    assert df.where("got <> want").count() == 0


def test_query_size(spark):
    w, h = grid.query_size(F.lit("45:32"), F.lit(1.47456))
    assert spark.range(1).select(w.alias("w"), h.alias("h")).first()[:] == (1440, 1024)


def test_tile_plan(spark):
    plan = tiling.tile_plan(spark.createDataFrame([(6000, 12000), (10, 10)], "height int, width int"), 4_000_000)
    assert [tuple(r)[2:] for r in plan.orderBy(F.desc("height")).collect()] == [(4, 8), (1, 1)]


def test_alignment_fails_on_a_gap(spark):
    tiles = spark.createDataFrame([(0, 0), (0, 1)], "map_id int, flat_idx int")
    with pytest.raises(ValueError):
        grid.align_features(tiles, tiles.where("flat_idx = 0").withColumn("feat", F.array(F.lit(1.0))))
    assert grid.align_features(tiles, tiles.withColumn("feat", F.array(F.lit(1.0)))).count() == 2
