"""Masks of slides, crops, keypoints and the composed search, from images."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek import locate
from gridseek.functions import image, keypoints
from gridseek.operators import grid, levels, localize, raster, regions, tissue
from gridseek.sources import slides


def _images(spark, arrays):
    rows = [(slide, level, image.encode_row(a)) for slide, level, a in arrays]
    return spark.createDataFrame(rows, T.StructType([T.StructField("slide_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("image", image.IMAGE)]))


def _slide(seed, h, w):
    """White ground with coloured blobs and specks."""
    draw = np.random.default_rng(seed)
    out = np.full((h, w, 3), 245, dtype=np.uint8)
    for _ in range(5):
        y, x, s = draw.integers(0, h - 12), draw.integers(0, w - 12), draw.integers(8, 30)
        out[y : y + s, x : x + s] = draw.integers(40, 200, 3)
    specks = draw.random((h, w)) < 0.03
    out[specks] = (120, 40, 160)
    return out


def _plain(mask, radius=3):
    def slide(m, f, fill):
        p = np.pad(m, radius, constant_values=fill)
        return f([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * radius + 1) for j in range(2 * radius + 1)], axis=0)

    closed = slide(slide(mask, np.any, False), np.all, True)
    return slide(slide(closed, np.all, True), np.any, False)


def test_segmenter_by_definition(spark):
    p = _slide(1, 60, 70)
    high, low = p.max(axis=2).astype(float), p.min(axis=2).astype(float)
    want = _plain((np.floor(255 * (high - low) / np.maximum(high, 1) + 0.5) > 15) & (high > 30) & (high < 240))
    assert want.any() and np.array_equal(tissue.hsv_segmenter(p), want)
    cells = spark.createDataFrame([(int(y), int(x), *map(int, p[y, x])) for y in range(60) for x in range(70)], "y int, x int, r int, g int, b int")
    assert {tuple(r) for r in tissue.tissue_cells(cells, 70, 60).collect()} == {(int(y), int(x)) for y, x in zip(*np.nonzero(want))}


def test_masks_of_slides_in_parts(spark):
    """Cut with a halo and stitched, masks are those of whole images; levels and regions follow."""
    whole = {s: _slide(s, 90 + s, 120 + s) for s in (1, 2)}
    images = _images(spark, [(s, 1, p) for s, p in whole.items()])
    chunks = slides.chunk_images(images, 32)
    lv = spark.createDataFrame([(s, k, 4.0**k, (120 + s) * 4 // 4**k, (90 + s) * 4 // 4**k) for s in (1, 2) for k in (0, 1)], "slide_id long, level int, ds double, width int, height int")
    info = spark.createDataFrame([(1, 0.25, 0.35), (2, None, 0.5)], "slide_id long, mpp_x double, mpp_y double")
    want = {(s, int(y), int(x)) for s, p in whole.items() for y, x in zip(*np.nonzero(tissue.hsv_segmenter(p)))}
    for budget in (None, 3000):
        mask, scales, boxes = tissue.slide_regions(chunks, info, lv, budget=budget, halo=16, min_area=20, chunk=32)
        assert {tuple(r) for r in mask.collect()} == want
    got = {r["slide_id"]: r for r in scales.collect()}
    assert [(got[s]["level"], got[s]["ds_x"], round(got[s]["mask_mpp"], 9)) for s in (1, 2)] == [(1, 4.0, 1.2), (1, 4.0, 1.0)]
    assert tissue.mask_levels(info, lv, level=-1).select("level").distinct().collect() == [(1,)]
    for s, p in whole.items():
        cells = spark.createDataFrame([(y, x) for t, y, x in want if t == s], "y int, x int")
        one = raster.region_boxes(cells, 4.0, 4.0, 20)
        assert [tuple(r) for r in one.orderBy("index").collect()] == [tuple(r)[1:] for r in boxes.where(F.col("slide_id") == s).orderBy("index").collect()]


def test_regions_of_slides_stay_apart(spark):
    rows = [(s, i, 10 * i, 0, 15, 15) for s in (0, 7) for i in range(3)] + [(7, 3, 500, 500, 15, 15)]
    df = spark.createDataFrame(rows, "slide int, index int, x int, y int, w int, h int")
    merged = regions.merge_overlapping(df, "slide").orderBy("slide", "index").collect()
    assert [tuple(r) for r in merged] == [(0, 0, 0, 0, 35, 15, 3), (7, 0, 0, 0, 35, 15, 3), (7, 1, 500, 500, 15, 15, 1)]
    assert regions.regions_for_level(df, 10, 2.0, slide="slide").count() == 0
    assert regions.regions_for_level(df, 7, 2.0, slide="slide").count() == 3


def test_interpolation_of_slides(spark):
    lv = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 4.0), (1, float("nan"), 9.0), (2, 5.0, 8.0)], "slide int, stat double, mpp double")
    asked = spark.createDataFrame([(1, 0.0), (1, 1.5), (1, 3.0), (2, 1.0), (3, 1.0)], "slide int, want double")
    got = [(r["slide"], r["want"], r["mpp"]) for r in levels.interpolate(asked, lv, keys=("slide",)).orderBy("slide", "want").collect()]
    assert got == [(1, 0.0, 1.0), (1, 1.5, pytest.approx(2.0)), (1, 3.0, 4.0), (2, 1.0, 8.0), (3, 1.0, None)]


def test_crops(spark):
    grids = spark.createDataFrame([(512, 384, 128, 10, 20)], "width int, height int, tile int, x_off int, y_off int")
    one = lambda df: tuple(df.select("r0", "c0", "r1", "c1", "width", "height", "x_off", "y_off").first())
    n = F.lit
    assert one(grid.crop(grids, n(0), n(0), n(2), n(2))) == (0, 0, 2, 2, 256, 256, 10, 20)
    assert one(grid.crop(grids, n(1), n(1), height=n(1), width=n(1), pad=1)) == (0, 0, 3, 3, 384, 384, 10, 20)
    assert one(grid.crop(grids, n(149), n(11), height=n(131), width=n(131), unit="pixel")) == (1, 0, 3, 2, 256, 256, 10, 148)
    assert one(grid.crop(grids, n(1), n(1), n(2), n(2), pad=129, pad_unit="pixel"))[:4] == (0, 0, 3, 4)
    for wrong in ({}, {"bottom": n(2), "right": n(2), "height": n(1), "width": n(1)}, {"bottom": n(2), "right": n(2), "unit": "mile"}, {"bottom": n(2), "right": n(2), "pad_unit": "mile"}):
        with pytest.raises(ValueError):
            grid.crop(grids, n(0), n(0), **wrong)
    with pytest.raises(Exception, match="the crop is empty"):
        grid.crop(grids, n(5), n(0), n(6), n(2)).collect()
    tiles = grid.cropped_patches(grid.crop(grids, n(1), n(1), n(3), n(4)))
    old = {(r["kind"], r["y"], r["x"]): r["flat_idx"] for r in grid.patches(grids).collect()}
    assert [r["old_flat"] for r in tiles.collect()] == [old[r["kind"], r["y"], r["x"]] for r in tiles.collect()] and tiles.count() == 8


def test_search_from_images(spark):
    """A query cut out of one of two slides is found by windows and refined by keypoints."""
    draw = np.random.default_rng(5)
    coarse = draw.integers(0, 256, (14, 18, 3)).astype(np.uint8)
    big = {s: image.resample(np.roll(coarse, s, axis=0), 14 * 24, 18 * 24) for s in (1, 2)}
    big = {s: np.clip(p.astype(int) + np.random.default_rng(s).integers(-20, 21, p.shape), 0, 255).astype(np.uint8) for s, p in big.items()}
    y0, x0, tile = 70, 130, 32
    query = big[2][y0 : y0 + 96, x0 : x0 + 128]
    chunks = slides.chunk_images(_images(spark, [(s, 0, p) for s, p in big.items()]), 64)
    parts = spark.createDataFrame([(s, 0, 0, 0, p.shape[1], p.shape[0]) for s, p in big.items()], "slide_id long, region_index int, x int, y int, w int, h int")
    found = locate.find_in_slides(chunks, parts, _images(spark, [(9, 0, query)]).select(F.col("slide_id").alias("query_id"), "image"), tile, 1.0, 0, image.ColorLayout, keypoints.Corners, chunk=64)
    best = {r["slide_id"]: r for r in found.collect()}
    assert best[2]["score"] > best[1]["score"] and abs(best[2]["window_x"] - x0) <= tile and abs(best[2]["window_y"] - y0) <= tile
    assert best[2]["refined"] and abs(best[2]["x"] - x0) <= 1 and abs(best[2]["y"] - y0) <= 1 and not best[1]["refined"]


def test_ratio_rule_of_any_length(spark):
    draw = np.random.default_rng(6)
    held, asked = draw.normal(size=(60, 6)) * draw.uniform(0.2, 5, (60, 1)), draw.normal(size=(25, 6))
    table = lambda x, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{n} long, feat array<double>")
    got = {(r["query_id"], r["ref_id"]) for r in localize.ratio_matches(table(asked, "query_id"), table(held, "ref_id"), 0.8).collect()}
    d = np.linalg.norm(asked[:, None] - held[None], axis=2)
    near = np.argsort(d, axis=1)
    want = {(i, int(n[0])) for i, n in enumerate(near) if d[i, n[0]] < 0.8 * d[i, n[1]]}
    assert want and got == want
    points = lambda x, g: spark.createDataFrame([(g, float(i), 0.0, v.tolist()) for i, v in enumerate(x)], "group_id long, x double, y double, desc array<double>")
    pairs = localize.matched_keypoints(points(asked, 1), points(held, 1).union(points(held[:1], 2)), 0.8)
    assert {(int(r["qx"]), int(r["cx"])) for r in pairs.collect()} == want
