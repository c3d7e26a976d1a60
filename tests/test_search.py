"""Vectors, retrieval, localisation, effects, slides and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridseek import locate
from gridseek.functions import image
from gridseek.operators import fidelity, levels, localize, raster, retrieval, sampling
from gridseek.operators.components import connected_components
from gridseek.operators.vectors import average_ranks, quantiles, top_k, zero_non_finite
from gridseek.sources import slides
from gridseek.streaming.live import answer_stream


def _vectors(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, feat array<float>")


def test_top_k_in_blocks(spark, monkeypatch):
    from gridseek.operators import vectors

    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "BANK_ROWS", 11)
    x = np.random.default_rng(0).normal(size=(60, 8)).astype(np.float32)
    x[5:9] = x[4]  # ties go to the smaller id
    got = top_k(_vectors(spark, x[:20], "query_id"), _vectors(spark, x, "ref_id"), 5).orderBy("query_id", "rank").collect()
    sims = np.round(x[:20].astype(float) @ x.astype(float).T, 9)
    want = [[int(i) for i in np.lexsort((np.arange(60), -row))[:5]] for row in sims]
    assert [[r["ref_id"] for r in got[i * 5 : i * 5 + 5]] for i in range(20)] == want


def test_average_ranks(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (-0.2,), (1.0,)], "v double")
    assert {(r["v"], r["q"]) for r in average_ranks(df, "v", "q").collect()} == {(-0.2, 1.0), (0.1, 2.0), (0.5, 3.5), (1.0, 5.0)}


def test_non_finite(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([1.0, 2.0],), ([None, 1.0],)], "feat array<float>")
    assert [(r["was_bad"], r["feat"]) for r in zero_non_finite(df).collect()] == [(True, [0.0, 0.0]), (False, [1.0, 2.0]), (True, [0.0, 0.0])]


def test_components_broadcast_nothing(spark, capsys):
    mask = spark.range(200).select((F.col("id") % 20).cast("int").alias("y"), (F.col("id") * 7 % 31).cast("int").alias("x"))
    found = raster.components(mask)
    found.collect()
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_statistics_of_some_images_at_once(monkeypatch):
    monkeypatch.setattr(image, "STACK_PIXELS", 100)
    draw, sizes = np.random.default_rng(6), []
    rows = pd.DataFrame([image.encode_row(draw.integers(0, 256, (5, 7, 3))) for _ in range(11)])

    def mean(gray):
        sizes.append(len(gray))
        return gray.mean(axis=(1, 2))

    got = image.statistic_udf(mean).func(rows)
    assert max(sizes) == 2 and sum(sizes) == 11
    assert np.allclose(got, [image.luma(image.decode(r)).mean() for r in rows.to_dict("records")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_planted_kernel(spark):
    x = np.random.default_rng(1).normal(size=(12 * 9, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(0, "main", i // 9, i % 9, v.tolist()) for i, v in enumerate(x)]
    grid = spark.createDataFrame(rows, "region_index int, kind string, row int, col int, feat array<double>")
    kernel = grid.where("row BETWEEN 3 AND 5 AND col BETWEEN 2 AND 4").select((F.col("row") - 3).alias("q_row"), (F.col("col") - 2).alias("q_col"), "feat")
    scores = retrieval.window_similarity(grid, kernel)
    assert scores.count() == 10 * 7
    places = spark.createDataFrame([(0, 400, 800)], "region_index int, x int, y int")
    best = locate.locate(grid, kernel, places, 256, 4.0).first()
    assert (best["kind"], best["x"], best["y"], best["x0"], best["y0"], round(best["score"], 6)) == ("main", 100 + 2 * 256, 200 + 3 * 256, 4 * 612, 4 * 968, 1.0)
    assert (best["overlap_x"], best["overlap_y"], best["overlap_score"]) == (0, 0, float("-inf"))


def test_ransac(spark):
    draw = np.random.default_rng(2)
    h = np.array([[1.1, 0.1, 30], [-0.05, 0.9, 12], [1e-4, 0, 1]])
    src = draw.uniform(0, 500, (80, 2))
    p = np.hstack([src, np.ones((80, 1))]) @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:25] += draw.uniform(50, 200, (25, 2))
    rows = [(1, *map(float, [*a, *b])) for a, b in zip(src, dst)] + [(2, 0.0, 0.0, 1.0, 1.0)]
    fits = localize.ransac(spark.createDataFrame(rows, "group_id long, qx double, qy double, cx double, cy double"))
    got = {r["group_id"]: r for r in fits.collect()}
    assert got[1]["success"] and got[1]["inliers"] == 55 and np.allclose(np.array(got[1]["h"]).reshape(3, 3), h, atol=1e-3)
    assert not got[2]["success"] and got[2]["h"] is None
    found = spark.createDataFrame([(1, 5, 6, 100, 200), (2, 7, 8, 0, 0)], "group_id long, x int, y int, crop_x int, crop_y int")
    placed = {r["group_id"]: r for r in localize.localized(fits, found).collect()}
    assert placed[1]["refined"] and abs(placed[1]["x"] - 130) <= 1 and abs(placed[1]["y"] - 212) <= 1
    assert tuple(placed[2]) == (2, 7, 8, False)


def test_a_fit_of_many_pairs_takes_little_memory():
    import tracemalloc

    draw = np.random.default_rng(2)
    src = draw.random((3000, 2)) * 1000
    dst = src @ np.array([[1.1, -0.05], [0.1, 0.9]]) + (30, 12)
    tracemalloc.start()
    h = localize.solve(src, dst)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(h, [[1.1, 0.1, 30], [-0.05, 0.9, 12], [0, 0, 1]], atol=1e-6)
    assert np.allclose(localize.solve(src[:4], dst[:4]), h, atol=1e-6)
    assert most < 10e6  # the left side of a full decomposition alone would take 288 MB


def test_level_of(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 16.0)], "level int, ds double")
    assert locate.level_of(1.0, rows, 0.25) == 1
    with pytest.raises(ValueError):
        locate.level_of(0.7, rows, 0.25)
    with pytest.raises(ValueError):
        locate.level_of(1.0, rows, 0.0)


def test_exact_neighbour_counts_alone(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 8.0), (2, 1.0, 2.0), (2, 1.0, 8.0)], "id int, dist double, mpp double")
    got = {r["id"]: r["estimate"] for r in levels.weighted_log_mean(df, ["id"]).collect()}
    assert got[1] == 2.0 and abs(got[2] - 4.0) < 1e-9


def test_spread(spark):
    df = spark.createDataFrame([(1, 2, 0.5, 1.0), (1, 0, 0.1, 0.25)], "slide int, level int, stat double, mpp double")
    assert [tuple(x) for x in levels.level_spread(df, ["slide"]).first()["spread"]] == [(0, 0.1, 0.25), (2, 0.5, 1.0)]


def test_candidates_stay_inside(spark):
    boxes = spark.createDataFrame([(0, 10, 20, 100, 60), (1, 500, 500, 40, 40)], "index int, x int, y int, w int, h int")
    got = sampling.candidates(boxes, 200, 32)
    assert got.count() == 200
    assert got.join(boxes.withColumnsRenamed({"x": "bx", "y": "by"}), "index").where("x < bx OR y < by OR x + 32 > bx + w OR y + 32 > by + h").count() == 0


def test_identical_encoders(spark):
    x = np.random.default_rng(3).normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feat array<double>")
    assert fidelity.fidelity_stats(fidelity.row_cosines(df, df)).first()["mean"] == 1.0
    assert {r["overlap"] for r in fidelity.topk_overlap(df, df, (1, 5)).collect()} == {1.0}
    assert fidelity.rank_shift(df, df).first()[:] == (0.0, 0.0)
    assert fidelity.spearman(df, df).first()[:] == (780, 1.0)


PICTURE = np.random.default_rng(4).integers(0, 256, (48, 64, 3), dtype=np.uint8)


def test_effects_without_strength_change_nothing():
    for effect in (
        lambda x: image.adjust_color(x), lambda x: image.add_noise(x, 0), lambda x: image.vignette(x, 0), lambda x: image.stage_shift(x, 0, 0),
        lambda x: image.distort(x, 0), lambda x: image.defocus(x, 0), lambda x: image.chromatic(x, 0), lambda x: image.resize(x, 48, 64),
    ):
        assert np.array_equal(effect(PICTURE), PICTURE)
    moved = image.stage_shift(PICTURE, 2, 3)
    assert np.array_equal(moved[2:, 3:], PICTURE[:-2, :-3])
    assert image.field_mask(PICTURE)[0, 0].tolist() == [255] * 3 and np.array_equal(image.field_mask(PICTURE)[24, 32], PICTURE[24, 32])
    assert image.microscope_photo(PICTURE).shape == PICTURE.shape
    with pytest.raises(ValueError):
        image.as_rgb(np.zeros((2, 2, 7)))
    assert image.as_rgb(np.array([[300.0, -5.0]])).tolist() == [[[255] * 3, [0] * 3]]


def test_statistics():
    y, x = np.indices((64, 64))
    waves = np.stack([128 + 100 * np.sin(2 * np.pi * x / p) for p in (32, 8, 4)])
    centre = image.spectral_centroid(waves)
    assert centre.tolist() == sorted(centre) and abs(centre[1] - 8) < 1
    length = image.autocorr_length(waves).tolist()
    assert length == sorted(length, reverse=True)
    assert image.autocorr_length(np.zeros((1, 16, 16))).tolist() == [0.0]


@pytest.mark.parametrize("h, w", [(16, 16), (17, 24), (24, 17), (15, 15)])
def test_statistics_by_definition(h, w):
    """Discrete Fourier sums and lag products written out."""
    g = np.random.default_rng(h * w).integers(0, 256, (h, w)).astype(float)
    flat = g - g.mean()
    lag = [sum(flat[i, j] * flat[i, (j + d) % w] for i in range(h) for j in range(w)) for d in range((w + 1) // 2)]
    below = [d for d, v in enumerate(lag) if v / lag[0] < 0.5]
    assert image.autocorr_length(g[None]).tolist() == [below[0] if below else len(lag)]
    taper = flat * np.array([[(0.5 - 0.5 * np.cos(2 * np.pi * i / (h - 1))) * (0.5 - 0.5 * np.cos(2 * np.pi * j / (w - 1))) for j in range(w)] for i in range(h)])
    rows, cols = (np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n) for n in (h, w))
    power = np.abs(rows @ taper @ cols.T) ** 2
    held = {}
    for i in range(h):
        for j in range(w):
            r = int(np.hypot((i + h // 2) % h - h // 2, (j + w // 2) % w - w // 2))
            held.setdefault(r, []).append(power[i, j])
    mean = {r: np.mean(v) for r, v in held.items() if r}
    want = sum(r * v for r, v in mean.items()) / (sum(mean.values()) + 1e-9)
    assert np.isclose(image.spectral_centroid(g[None])[0], want)


@pytest.mark.parametrize("h, w", [(9, 12), (12, 9), (7, 7)])
def test_effects_by_definition(h, w):
    p = np.random.default_rng(h * 100 + w).integers(0, 256, (h, w, 3), dtype=np.uint8)
    mirror = lambda i, n: -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i
    shifted = image.stage_shift(p, -2, 3)
    split = image.chromatic(p, 2)
    round_ = image.field_mask(p)
    dark = image.vignette(p, 0.4)
    bent = image.distort(p, 0.3, 0.1)
    hued = image.adjust_color(p, 1.7, 0.8, 12)
    for y in range(h):
        for x in range(w):
            assert shifted[y, x].tolist() == p[mirror(y + 2, h), mirror(x - 3, w)].tolist()
            assert split[y, x].tolist() == [p[y, mirror(x - 2, w), 0], p[y, x, 1], p[y, mirror(x + 2, w), 2]]
            assert round_[y, x].tolist() == (p[y, x].tolist() if (y - h // 2) ** 2 + (x - w // 2) ** 2 <= (min(h, w) // 2) ** 2 else [255] * 3)
            gain = 0.6 + 0.4 * np.exp(-((y - h / 2) ** 2 + (x - w / 2) ** 2) / (2 * (0.8 * min(h, w) / 2) ** 2))
            assert dark[y, x].tolist() == [int(c * gain) for c in p[y, x].tolist()]
            cy, cx = (h - 1) / 2, (w - 1) / 2
            v, u = (y - cy) / (cy + 1e-6), (x - cx) / (cx + 1e-6)
            f = 1 + 0.3 * (u * u + v * v) + 0.1 * (u * u + v * v) ** 2
            sy, sx = v / f * cy + cy, u / f * cx + cx
            i, j = int(np.floor(sy)), int(np.floor(sx))
            near = [(p[min(i + a, h - 1), min(j + b, w - 1)].astype(float), (1 - abs(a - sy + i)) * (1 - abs(b - sx + j))) for a in (0, 1) for b in (0, 1)]
            assert np.abs(bent[y, x] - sum(c * k for c, k in near)).max() <= 0.5 + 1e-6
            high, low = int(p[y, x].max()), int(p[y, x].min())
            s, value = min((high - low) / max(high, 1) * 1.7, 1.0), int(min(high * 0.8 + 12, 255))
            assert np.abs(hued[y, x] - [value * (1 - s * (high - c) / max(high - low, 1)) for c in p[y, x].tolist()]).max() <= 0.5 + 1e-6


def test_defocus_by_definition():
    p = np.random.default_rng(8).integers(0, 256, (9, 11, 3), dtype=np.uint8)
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
    fold = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    got = image.defocus(p, 2)
    for y in range(9):
        for x in range(11):
            want = np.mean([p[fold(y + a, 9), fold(x + b, 11)].astype(float) for a, b in steps], axis=0)
            assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-6


def test_resampling():
    flat = np.full((37, 53, 3), 91, dtype=np.uint8)
    for kernel in image.KERNELS:
        assert (image.resample(flat, 20, 71, kernel) == 91).all() and np.array_equal(image.resample(PICTURE, 48, 64, kernel), PICTURE)
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[None, :, None], 8, axis=0).repeat(3, axis=2) * 3
    assert np.abs(image.resample(ramp, 8, 32)[4, 4:28, 0] - (np.arange(4, 28) * 6 + 1.5)).max() <= 1
    made = image.preprocess(np.full((300, 500, 3), 255, dtype=np.uint8))
    assert made.shape == (224, 224, 3) and np.allclose(made[0, 0], [(1 - m) / d for m, d in zip(image.MEANS, image.DEVIATIONS)])


def _images(spark, arrays):
    rows = [(1, i, image.encode_row(a)) for i, a in enumerate(arrays)]
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T.StructType([T.StructField("slide_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("image", image.IMAGE)]))


def test_region_reads(spark, tmp_path):
    big = np.random.default_rng(5).integers(0, 256, (70, 90, 3), dtype=np.uint8)
    slides.write_chunks(slides.chunk_images(_images(spark, [big, PICTURE]), 32), str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    asked = spark.createDataFrame([(0, 1, 0, 10, 20, 60, 40), (1, 1, 1, 0, 0, 64, 48), (2, 1, 0, 80, 60, 20, 20)], "read_id long, slide_id long, level int, px int, py int, pw int, ph int")
    got = {r["read_id"]: image.decode(r["image"].asDict()) for r in slides.read_regions(chunks, asked, 32).collect()}
    assert np.array_equal(got[0], big[20:60, 10:70]) and np.array_equal(got[1], PICTURE)
    assert np.array_equal(got[2][:10, :10], big[60:, 80:]) and got[2][10:].sum() == 0


def test_tile_lists_and_cache(spark, tmp_path):
    tiles = spark.createDataFrame([(0, 1, 2, 256, 0.25), (1, 3, 4, None, 1.0)], slides.TILES)
    slides.save_tiles(tiles, str(tmp_path / "tiles"))
    assert {r["tile_size"] for r in slides.load_tiles(spark, str(tmp_path / "tiles"), 128).collect()} == {256, 128}
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.withColumn("feat", F.array(F.col("flat_idx").cast("float")))

    for n in (3, 5):
        wanted = spark.range(n).select(F.lit(1).alias("slide_id"), F.lit(0).alias("level"), F.col("id").alias("flat_idx"))
        assert slides.cached_features(wanted, str(tmp_path / "cache"), encode).count() == n
    assert seen == [3, 2]


def test_encoder_and_effects_as_columns(spark):
    df = _images(spark, [PICTURE, PICTURE[::-1]])
    got = image.encode_images(df.withColumn("image", image.image_udf(image.microscope_photo)("image")), image.ColorLayout).collect()
    assert len(got[0]["feat"]) == 64 and got[0]["feat"] != got[1]["feat"]
    assert df.select(image.statistic_udf(image.spectral_centroid)("image").alias("s")).where("s > 0").count() == 2
    assert image.encode_images(df.where("level > 9"), image.ColorLayout).count() == 0


def test_stream(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(30, 4)).astype(np.float32)
    bank = _vectors(spark, x, "ref_id")
    _vectors(spark, x[:5], "query_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, feat array<float>").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = answer_stream(stream, bank, 3, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(out).count() == 15


def test_quantiles_by_key(spark):
    rng = np.random.default_rng(3)
    values = {"a": np.round(rng.normal(size=501), 1), "b": np.full(40, 2.5), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "key string, value double")  # a key named like an internal column would be
    shares = {"p1": 0.01, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r["key"]: r for r in quantiles(df, "value", shares, ("key",), ranges=16).collect()}
    assert got.keys() == {"a", "b", "c"}
    for k, vs in values.items():
        assert [got[k][n] for n in shares] == pytest.approx([np.quantile(vs, p) for p in shares.values()])
    everything = np.concatenate(list(values.values()))
    one = quantiles(df, "value", shares, ranges=16).collect()
    assert [one[0][n] for n in shares] == pytest.approx([np.quantile(everything, p) for p in shares.values()])
    assert quantiles(df.where("false"), "value", {"p": 0.5}).collect()[0]["p"] is None
    assert quantiles(df.where("false"), "value", {"p": 0.5}, ("key",)).count() == 0


def test_top_k_by_key(spark, monkeypatch):
    monkeypatch.setattr("gridseek.operators.vectors.BANK_ROWS", 20)
    x = np.random.default_rng(5).normal(size=(90, 6))
    key = ["p" if i % 3 else "q" for i in range(90)]
    bank = spark.createDataFrame([(key[i], i, x[i].tolist()) for i in range(90)], "side string, ref_id long, feat array<double>")
    asked = spark.createDataFrame([(s, i, x[i].tolist()) for i in range(9) for s in "pqr"], "side string, query_id long, feat array<double>")
    got = {(r["side"], r["query_id"], r["rank"]): r["ref_id"] for r in top_k(asked, bank, 4, skip_self=True, keys=("side",)).collect()}
    want = {}
    for s in "pq":
        mine = [i for i in range(90) if key[i] == s]
        for q in range(9):
            order = sorted((i for i in mine if i != q), key=lambda i: (-round(float(x[i] @ x[q]), 9), i))
            want |= {(s, q, n + 1): order[n] for n in range(4)}
    assert got == want


def test_report_of_encoders(spark):
    x = np.random.default_rng(6).normal(size=(60, 8))
    vectors = lambda rows: spark.createDataFrame(rows, "config string, id long, feat array<double>")
    base = vectors([("", i, v.tolist()) for i, v in enumerate(x)]).select("id", "feat")
    far = np.random.default_rng(7).normal(size=(60, 8))
    others = vectors([("same", i, v.tolist()) for i, v in enumerate(2 * x)] + [("far", i, v.tolist()) for i, v in enumerate(far)])
    got = {r["config"]: r for r in fidelity.fidelity_report(base, others, ks=(1, 5)).collect()}
    same = got["same"]
    assert (same["n"], same["mean"], same["p1"], same["overlap_1"], same["overlap_5"], same["shift_p95"], same["n_pairs"], same["rho"]) == (60, 1.0, 1.0, 1.0, 1.0, 0.0, 1770, 1.0)
    alone = others.where("config = 'far'").select("id", "feat")
    assert got["far"]["rho"] == fidelity.spearman(base, alone).first()["rho"]
    assert (got["far"]["shift_median"], got["far"]["shift_p95"]) == fidelity.rank_shift(base, alone).first()[:]
    assert got["far"]["overlap_5"] == {r["k"]: r["overlap"] for r in fidelity.topk_overlap(base, alone, (1, 5)).collect()}[5]
    cos = [round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) for a, b in zip(x, far)]
    assert got["far"]["p95"] == pytest.approx(np.quantile(cos, 0.95), abs=1e-6)


def test_report_of_many_pairs_writes_none(spark, monkeypatch):
    x = np.random.default_rng(11).normal(size=(40, 6))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feat array<double>")
    others = spark.createDataFrame([(c, i, (s * v).tolist()) for c, s in (("a", 1.0), ("b", -2.0)) for i, v in enumerate(x)], "config string, id long, feat array<double>")
    monkeypatch.setattr(fidelity, "WRITTEN_PAIRS", 0)
    monkeypatch.setattr(fidelity, "pair_similarities", None)
    got = fidelity.fidelity_report(base, others, ks=(1, 5)).select("config", "overlap_5", "n_pairs", "rho").collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, 780, 1.0), ("b", 1.0, 780, 1.0)]


def test_report_seeks_the_baselines_neighbours_once(spark, monkeypatch):
    x = np.random.default_rng(12).normal(size=(40, 6))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feat array<double>")
    others = spark.createDataFrame([("a", i, np.round(v, 1).tolist()) for i, v in enumerate(x)], "config string, id long, feat array<double>")
    sought, top_k = [], fidelity.top_k
    monkeypatch.setattr(fidelity, "top_k", lambda *args, **kept: sought.append(kept.get("keys")) or top_k(*args, **kept))
    got = fidelity.fidelity_report(base, others, ks=(1, 5)).first()
    assert sought == [(), ("config",)]
    alone = others.drop("config")
    assert (got["shift_median"], got["shift_p95"]) == tuple(fidelity.rank_shift(base, alone).first())
    assert {1: got["overlap_1"], 5: got["overlap_5"]} == {r["k"]: r["overlap"] for r in fidelity.topk_overlap(base, alone, (1, 5)).collect()}
