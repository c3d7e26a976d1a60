"""Worked examples of boxes and masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseek.operators import raster, regions

BOX = "index int, x int, y int, w int, h int"


def _boxes(df):
    return sorted(tuple(r[c] for c in ("x", "y", "w", "h")) for r in df.collect())


def _cells(spark, mask):
    return spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "y int, x int")


def test_merge(spark):
    df = spark.createDataFrame([(0, 0, 0, 100, 100), (1, 50, 50, 100, 100), (2, 120, 120, 100, 100), (3, 400, 400, 50, 50), (4, 60, 60, 20, 20)], BOX)
    merged = regions.merge_overlapping(df)
    assert _boxes(merged) == [(0, 0, 220, 220), (60, 60, 20, 20), (400, 400, 50, 50)]
    assert sorted(r["index"] for r in merged.collect()) == [0, 1, 2]


def test_equal_boxes_both_go(spark):
    df = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 0, 0, 10, 10), (2, 50, 50, 5, 5)], BOX)
    assert _boxes(regions.not_contained(df)) == [(50, 50, 5, 5)]


def test_history(spark):
    held = regions.RegionHistory(spark.createDataFrame([(0, 0, 0, 10, 10), (1, 5, 5, 10, 10)], BOX))
    held.merge()
    assert _boxes(held.now) == [(0, 0, 15, 15)]
    held.merge()
    assert held.undo() and len(_boxes(held.now)) == 2 and not held.undo()
    held.apply(lambda b: b.where("index = 0"))
    assert len(_boxes(held.resume())) == 2 and not held.undo()


def test_region_search(spark):
    mask = np.zeros((50, 100), bool)
    mask[5:15, 10:30] = mask[30:38, 60:75] = mask[45:50, 90:95] = True
    got = raster.region_boxes(_cells(spark, mask), 4.0, 4.0)
    assert _boxes(got) == [(40, 20, 80, 40), (240, 120, 60, 32)]


def test_coverage(spark):
    mask = np.zeros((20, 20), bool)
    mask[5:15, 5:15] = True
    cells = _cells(spark, mask)
    tiles = spark.createDataFrame([(0, 5, 5, 10, 10), (1, 0, 0, 4, 4), (2, 0, 0, 20, 20), (3, 30, 30, 4, 4), (4, 5, 5, 0, 3)], "tile_id int, x int, y int, w int, h int")
    ok = {r["tile_id"] for r in raster.has_tissue(tiles, cells, 20, 20).where("ok").collect()}
    assert ok == {0}
    assert {r["tile_id"] for r in raster.has_tissue(tiles, cells, 20, 20, 0.25).where("ok").collect()} == {0, 2}
    assert raster.mask_fraction(cells, 20, 20).first()[0] == 0.25


def test_to_mask(spark):
    got = spark.range(1).select(*[raster.to_mask(F.lit(v), F.lit(a), F.lit(b)).alias(str(i)) for i, (v, a, b) in enumerate([(16, 16.0, 8.0), (80, 1.0, 8.0), (40, 2.0, 8.0), (24, 4.0, 8.0)])])
    assert got.first()[:] == (32, 10, 10, 12)


def test_morphology(spark):
    draw = np.random.default_rng(1)
    mask = draw.random((23, 31)) < 0.5

    def slide(m, f, fill):
        p = np.pad(m, 3, constant_values=fill)
        return f([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(7) for j in range(7)], axis=0)

    wide, thin = slide(mask, np.any, False), slide(slide(mask, np.any, False), np.all, True)
    cells = _cells(spark, mask)
    grown = raster.dilate(cells, 31, 23)
    assert {tuple(r) for r in grown.collect()} == {(int(y), int(x)) for y, x in zip(*np.nonzero(wide))}
    shrunk = raster.erode(grown, 31, 23)
    assert {tuple(r) for r in shrunk.collect()} == {(int(y), int(x)) for y, x in zip(*np.nonzero(thin))}
    opened = slide(slide(thin, np.all, True), np.any, False)
    assert {tuple(r) for r in raster.close_open(cells, 31, 23).collect()} == {(int(y), int(x)) for y, x in zip(*np.nonzero(opened))}


def test_components_of_an_empty_mask(spark):
    assert raster.components(spark.createDataFrame([], "y int, x int")).count() == 0
    assert raster.otsu(spark.createDataFrame([], "g int")).count() == 0


def test_masks_hold_late_events_and_many_users(spark, tmp_path):
    from gridseek.queries import QUERIES

    days = spark.range(3).select(F.explode(F.array(F.lit(0), F.lit(40))).alias("day"), F.explode(F.array(F.lit(0), F.lit(30_000))).alias("user_id"), "id")
    ts = F.timestamp_seconds(1704067200 + F.col("day") * 86400)
    days.select(F.col("user_id").cast("long"), ts.alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(tuple(r) for r in QUERIES["mask_components"](spark, str(tmp_path)).select("area").collect()) == [(1,)] * 4
    assert QUERIES["mask_fraction"](spark, str(tmp_path)).first()[0] == round(4 / (161 * 10_001), 9)
    assert {(r["y"], r["x"]) for r in QUERIES["mask_dilated"](spark, str(tmp_path)).collect()} >= {(10_000, 160), (9_999, 159), (0, 0)}


def test_scales_are_decimal(spark):
    # 50 * 2.3 is 115, and a little less in binary
    mask = np.zeros((63, 60), bool)
    mask[50:60, 50:55] = True
    (got,) = _boxes(raster.region_boxes(_cells(spark, mask), 3.7, 2.3, 5))
    assert got == (185, 115, 18, 23)


@pytest.mark.parametrize("group", [40, 200_000])
def test_boxes_of_all_sizes_by_definition(spark, monkeypatch, group):
    monkeypatch.setattr(regions, "GROUP_ROWS", group)
    monkeypatch.setattr(regions, "BATCH_PAIRS", 7)
    draw = np.random.default_rng(3)
    sides = lambda: (2 ** draw.uniform(-1, 9, 150)).astype(int)  # noqa: E731, some of them 0
    x, y, w, h = draw.integers(-300, 300, 150), draw.integers(-300, 300, 150), sides(), sides()
    rows = [(i // 2, i % 2, *map(int, r)) for i, r in enumerate(zip(x, y, w, h))]
    df = spark.createDataFrame(rows, "index int, slide int, x int, y int, w int, h int")
    within = lambda a, b: a[2] >= b[2] and a[3] >= b[3] and a[2] + a[4] <= b[2] + b[4] and a[3] + a[5] <= b[3] + b[5]
    meet = lambda a, b: a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    both = [(a, b) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0]]
    pairs = {(a[1], a[0], b[0]) for a, b in both if a[0] < b[0] and meet(a, b) and not within(a, b) and not within(b, a)}
    got = regions.partial_overlaps(df, "slide")
    assert [f.dataType.simpleString() for f in got.schema] == ["int"] * 3
    assert sorted(tuple(r) for r in got.collect()) == sorted(pairs)
    kept = {a[:2] for a in rows} - {a[:2] for a, b in both if within(a, b)}
    assert {(r["index"], r["slide"]) for r in regions.not_contained(df, "slide").collect()} == kept
    root = {a[1::-1]: a[0] for a in rows}
    for _ in rows:
        for s, a, b in pairs:
            root[s, a] = root[s, b] = min(root[s, a], root[s, b])
    merged = regions.merge_overlapping(df, "slide").collect()
    assert len(merged) == len({(s, r) for (s, _), r in root.items()}) and sum(r["n"] for r in merged) == 150


def test_dense_boxes_send_no_pairs(spark):
    # 3000 boxes that all overlap have 4.5 million pairs; what leaves the groups is a tree
    i = F.col("id")
    df = spark.range(3000).select(i.cast("int").alias("index"), i.alias("x"), (5000 - i).alias("y"), F.lit(5000).alias("w"), F.lit(5000).alias("h"))
    trees = regions._met(df, None, False).groupBy("group").applyInPandas(regions._ties, "src long, dst long")
    assert trees.count() < 4 * 4 * 3000
    assert [r["n"] for r in regions.merge_overlapping(df).collect()] == [3000]
