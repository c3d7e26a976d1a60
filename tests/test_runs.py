"""Masks as runs against masks as arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.functions import image
from gridseek.operators import raster, runs, tissue
from gridseek.sources import slides


def plain(mask, radius, grow):
    """Dilation or erosion by definition; what is outside the image doesn't count."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    for y in range(h):
        for x in range(w):
            near = mask[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1]
            out[y, x] = near.any() if grow else near.all()
    return out


def of(spark, masks):
    """Runs ``(slide_id, width, height, y, x0, x1)`` of arrays."""
    rows = []
    for k, m in enumerate(masks):
        y, first, last = tissue._core_runs(m, 0, 0)
        rows += [(k, m.shape[1], m.shape[0], *map(int, r)) for r in zip(y, first, last)]
    return spark.createDataFrame(rows, "slide_id int, width int, height int, y int, x0 int, x1 int")


def back(df, masks):
    out = [np.zeros_like(m) for m in masks]
    last = {}
    for r in df.orderBy("slide_id", "y", "x0").collect():
        assert r["x0"] <= r["x1"] and last.get((r["slide_id"], r["y"]), -2) < r["x0"] - 1  # maximal
        last[(r["slide_id"], r["y"])] = r["x1"]
        out[r["slide_id"]][r["y"], r["x0"] : r["x1"] + 1] = True
    return out


@pytest.fixture(scope="module")
def masks():
    draw = np.random.default_rng(3)
    out = [draw.random((h, w)) < p for h, w, p in ((23, 31, 0.5), (9, 40, 0.9), (40, 6, 0.97), (5, 5, 0.0), (7, 8, 1.0), (1, 1, 1.0))]
    out[1][:, 10:30] = True
    return out


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_morphology(spark, masks, radius):
    df = of(spark, masks)
    size = (F.col("width"), F.col("height"), radius)
    for f, grow in ((runs.dilate, True), (runs.erode, False)):
        got = back(f(df, *size), masks)
        assert all(np.array_equal(a, plain(m, radius, grow)) for a, m in zip(got, masks))
    both = back(runs.close_open(df, *size), masks)
    for a, m in zip(both, masks):
        closed = plain(plain(m, radius, True), radius, False)
        assert np.array_equal(a, plain(plain(closed, radius, False), radius, True))


def test_runs_and_cells_agree(spark, masks):
    df = of(spark, masks[:2])
    size = (F.col("width"), F.col("height"))
    cells = runs.cells(df)
    want = {tuple(r) for r in raster.close_open(cells, *size).select("slide_id", "y", "x").collect()}
    assert {tuple(r) for r in runs.cells(runs.close_open(df, *size)).select("slide_id", "y", "x").collect()} == want
    assert {tuple(r) for r in raster.row_runs(cells, "slide_id").select("slide_id", "y", "x0", "x1").collect()} == {tuple(r) for r in df.select("slide_id", "y", "x0", "x1").collect()}


def test_sets(spark, masks):
    draw = np.random.default_rng(8)
    others = [draw.random(m.shape) < 0.5 for m in masks]
    a, b = of(spark, masks), of(spark, others)
    for f, plain_f in ((runs.union, np.logical_or), (runs.intersection, np.logical_and), (runs.disagreement, np.logical_xor), (runs.difference, lambda p, q: p & ~q)):
        got = back(f(a, b), masks)
        assert all(np.array_equal(g, plain_f(p, q)) for g, p, q in zip(got, masks, others))
    assert {r["slide_id"]: r["area"] for r in runs.areas(a).collect()} == {k: int(m.sum()) for k, m in enumerate(masks) if m.any()}


def test_merged_runs_and_clashing_names(spark):
    rows = [(1, 0, 3, 9), (1, 2, 5, 9), (1, 6, 6, 9), (1, 8, 9, 9), (1, 8, 9, 9), (2, 0, 0, 9)]
    df = spark.createDataFrame(rows, "y int, x0 int, x1 int, total int").withColumns({"x": F.lit(1), "kept": F.lit("a"), "step": F.lit(2.0)})
    got = runs.merged(df)
    assert {(r["y"], r["x0"], r["x1"]) for r in got.collect()} == {(1, 0, 6), (1, 8, 9), (2, 0, 0)} and set(got.columns) == set(df.columns)
    assert runs.merged(df.where("false")).count() == 0 and runs.close_open(df.where("false"), 5, 5).count() == 0


def test_scaled(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 0, 0)], "y int, x0 int, x1 int")
    assert {tuple(r) for r in runs.scaled(df, 2.5, 2.0).collect()} == {(0, 2, 6), (1, 2, 6), (2, 0, 1), (3, 0, 1)}


@pytest.mark.parametrize("block", [3, 1024])
def test_components_of_runs(spark, masks, block):
    df = of(spark, masks).drop("width", "height")
    got = raster.run_components(df, "slide_id", block).collect()
    for k, m in enumerate(masks):
        label = np.zeros(m.shape, dtype=np.int64)
        for r in got:
            if r["slide_id"] == k:
                label[r["y"], r["x0"] : r["x1"] + 1] = r["label"] + 1
        assert ((label > 0) == m).all()
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                near = label[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]
                assert not m[y, x] or set(near[near > 0]) == {label[y, x]}
        seen = sum(1 for _ in set(label[label > 0]))
        assert seen == _islands(m)


def _islands(m):
    left, n = {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}, 0
    while left:
        n += 1
        row = [left.pop()]
        for y, x in row:
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            row += near
    return n


def test_a_level_of_a_hundred_million_cells(spark):
    """Large rectangles stay a few runs a row; no cell is ever listed."""
    side = 10_000
    df = spark.range(side).select(F.col("id").cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(k * 2500).alias("x0"), F.lit(k * 2500 + 2400).alias("x1")) for k in range(4)])).alias("r"))
    df = df.where("y % 500 < 480").select("y", "r.*")
    closed = runs.close_open(df, side, side, 3)
    told = closed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1").cast("long") - F.col("x0") + 1).alias("area")).first()
    assert told["n"] == 4 * 9600 and told["area"] == 9600 * 4 * 2401


def test_segmented_runs(spark):
    draw = np.random.default_rng(2)
    pictures = []
    for k in range(2):
        p = np.full((150, 190, 3), 245, np.uint8)
        for _ in range(7):
            y, x = draw.integers(0, 130), draw.integers(0, 170)
            p[y : y + 25, x : x + 30] = draw.integers(40, 200, 3)
        pictures.append(p)
    schema = T.StructType([T.StructField("slide_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("image", image.IMAGE)])
    chunks = slides.chunk_images(spark.createDataFrame([(k, 0, image.encode_row(p)) for k, p in enumerate(pictures)], schema), 64)
    levels = spark.createDataFrame([(k, 0, 190, 150) for k in range(2)], "slide_id long, level int, width int, height int")
    for budget in (None, 4000, 1 << 24):
        got = back(tissue.segmented_runs(chunks, levels, budget=budget, halo=16, chunk=64), [p[:, :, 0] > 300 for p in pictures])
        assert all(np.array_equal(a, tissue.hsv_segmenter(p)) for a, p in zip(got, pictures))
    assert tissue.segmented(chunks, levels, budget=4000, halo=16, chunk=64).count() == sum(int(tissue.hsv_segmenter(p).sum()) for p in pictures)


@pytest.mark.parametrize("rows", [1, 5, 64])
def test_closing_and_opening_in_bands(spark, masks, rows):
    df = of(spark, masks)
    size = (F.col("width"), F.col("height"))
    got = runs.close_open(df, *size, rows=rows)
    for a, m in zip(back(got, masks), masks):
        closed = plain(plain(m, 3, True), 3, False)
        assert np.array_equal(a, plain(plain(closed, 3, False), 3, True))
    # the runs are shuffled once, not for each step
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("name", ["mask_closed", "mask_closed_3", "mask_dilated_3", "mask_runs_closed_opened", "mask_runs_sets"])
def test_masks_beyond_the_rows_of_the_sql(spark, tmp_path, name):
    """The SQL's image has 8192 rows and the query's as many as the users ask for; with as many the SQL gives the same."""
    duckdb = pytest.importorskip("duckdb")
    from gridseek.queries import ORACLE_SQL, QUERIES

    users = F.explode(F.sequence(F.lit(24_540), F.lit(24_602)))  # rows 8180 to 8200
    day = F.timestamp_seconds(1704067200 + 21600 * (F.xxhash64("id", "user_id") % 20 + 60))
    events = spark.range(12).withColumn("user_id", users).select(F.col("user_id").cast("long").alias("user_id"), day.cast("timestamp_ntz").alias("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    rows = sorted(tuple(r) for r in got.collect())
    columns = ", ".join(f'"{c}"' for c in got.columns)
    told = lambda sql: sorted(con.sql(f"SELECT {columns} FROM ({sql})").fetchall())
    sql = ORACLE_SQL[name]
    assert rows == told(sql.replace("8192", "8201").replace("8191", "8200"))
    assert rows != told(sql)  # which leaves users from 24 576 on out


@pytest.mark.parametrize("events", [0, 2])
def test_sets_of_a_mask_without_cells(spark, tmp_path, events):
    """Areas of nothing are 0, as the SQL counts: no events, or none of three in a cell."""
    duckdb = pytest.importorskip("duckdb")
    from gridseek.queries import ORACLE_SQL, QUERIES

    day = F.timestamp_seconds(F.lit(1704067200)).cast("timestamp_ntz")
    spark.range(events).select(F.lit(7).cast("long").alias("user_id"), day.alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["mask_runs_sets"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == con.sql(ORACLE_SQL["mask_runs_sets"]).fetchall() == [(0, 0, 0, 0)]
