"""The composed search: resolutions from images, queries at levels of their own, stages that are built once."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek import locate
from gridseek.functions import image
from gridseek.operators import sampling
from gridseek.plans import Stages, fingerprint
from gridseek.sources import slides

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests' folder
TILE, BASE = 32, 0.25
LEVELS = ((0, 1.0), (1, 2.0), (2, 4.0))
IMAGES = T.StructType([T.StructField("slide_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("image", image.IMAGE)])


class Encoder:
    """How smooth a tile is, in soft steps, and its colours; a smooth slide looks rougher the coarser the level."""

    def __call__(self, images):
        layout = image.ColorLayout()(images)
        out = []
        for pixels, vector in zip(images, layout):
            gray = image.luma(pixels) - image.luma(pixels).mean()
            rough = math.log((np.diff(gray, axis=1) ** 2).mean() / max((gray**2).mean(), 1e-9) + 1e-6)
            steps = np.exp(-((rough - np.linspace(-8, 2, 21)) ** 2) / 0.5)
            out.append(np.concatenate([2 * steps / np.linalg.norm(steps), vector]))
        return np.array(out, dtype=np.float32)


@pytest.fixture(scope="module")
def pyramids():
    out = {}
    for s in (1, 2):
        coarse = np.random.default_rng(s).integers(0, 256, (40, 52, 3)).astype(np.uint8)
        top = image.resample(coarse, 640, 832)
        out[s] = [top, top[::2, ::2].copy(), top[::4, ::4].copy()]
    return out


@pytest.fixture(scope="module")
def chunks(spark, pyramids, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks"))
    rows = [(s, level, image.encode_row(p)) for s, held in pyramids.items() for level, p in enumerate(held)]
    slides.write_chunks(slides.chunk_images(spark.createDataFrame(rows, IMAGES), 64), path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def tables(spark, pyramids):
    regions = spark.createDataFrame([(s, 0, 0, 0, 832, 640) for s in pyramids], "slide_id long, region_index int, x int, y int, w int, h int")
    levels = spark.createDataFrame([(s, k, ds, BASE * ds, int(832 / ds), int(640 / ds)) for s in pyramids for k, ds in LEVELS], "slide_id long, level int, ds double, mpp double, width int, height int")
    draw = np.random.default_rng(4)
    samples = [(s, k, i, int(draw.integers(0, 832 / ds - TILE) * ds), int(draw.integers(0, 640 / ds - TILE) * ds)) for s in pyramids for k, ds in LEVELS for i in range(30)]
    return regions, levels, spark.createDataFrame(samples, "slide_id long, level int, nth int, x int, y int")


#: Queries: slide, level, rows and columns of the window in whole tiles.
PLANTED = {10: (1, 0, 4, 6, 3, 4), 11: (2, 1, 3, 2, 3, 3), 12: (2, 2, 1, 2, 3, 3)}


@pytest.fixture(scope="module")
def queries(spark, pyramids):
    rows = [(q, image.encode_row(pyramids[s][k][r * TILE : (r + h) * TILE, c * TILE : (c + w) * TILE])) for q, (s, k, r, c, h, w) in PLANTED.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("image", image.IMAGE)]))


def check(found, queries=PLANTED):
    best = {}
    for r in found:
        if r["query_id"] not in best or r["score"] > best[r["query_id"]]["score"]:
            best[r["query_id"]] = r
    assert best.keys() == queries.keys()
    for q, (s, k, row, col, _, _) in queries.items():
        r, ds = best[q], dict(LEVELS)[k]
        assert (r["slide_id"], r["level"], r["window_x"], r["window_y"], r["kind"]) == (s, k, col * TILE, row * TILE, "main")
        assert (r["x0"], r["y0"]) == (int(col * TILE * ds), int(row * TILE * ds))


def test_search_with_estimated_resolutions(spark, chunks, tables, queries, tmp_path):
    regions, levels, samples = tables
    stages = Stages(spark, str(tmp_path / "stages"))
    asked = lambda s: locate.search(chunks, regions, levels, queries, TILE, Encoder, samples=samples, k=7, stages=s, version="1", chunk=64)
    check(asked(stages).collect())
    bank = stages.get("bank", {}, lambda: spark.range(0).selectExpr("0 AS slide_id"))
    assert stages.built == ["bank", "bank"] and bank.count() == 0
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("*.parquet")}
    again = Stages(spark, str(tmp_path / "stages"))
    check(asked(again).collect())
    new = [p for p in (tmp_path / "stages").rglob("*.parquet") if p not in kept]
    assert again.built == [] and sum(spark.read.parquet(str(p)).count() for p in new) == 0  # nothing is encoded again


def test_estimates(spark, chunks, tables, queries):
    regions, levels, samples = tables
    bank = locate.resolution_bank(chunks, samples, levels, TILE, Encoder, 64)
    assert bank.count() == samples.count() and {r["label"] for r in bank.select("label").distinct().collect()} == {0.25, 0.5, 1.0}
    got = locate.query_resolutions(queries, bank, TILE, 7, Encoder).collect()
    assert {(r["slide_id"], r["query_id"]): r["mpp"] for r in got} == {(s, q): BASE * 2 ** PLANTED[q][1] for s in (1, 2) for q in PLANTED}
    assert {r["query_id"]: r["n_tiles"] for r in got} == {10: 12, 11: 9, 12: 9}
    one = locate.estimate_resolution(locate.query_features(queries.where("query_id = 11"), TILE, Encoder).select(F.monotonically_increasing_id().alias("query_id"), "feat"), bank, 7)
    assert tuple(one.first()) == (0.5, 9)


def test_given_resolutions_skip_the_estimate(spark, chunks, tables, queries):
    regions, levels, _ = tables
    given = queries.join(spark.createDataFrame([(q, BASE * 2 ** PLANTED[q][1]) for q in PLANTED], "query_id long, mpp double"), "query_id")
    check(locate.search(chunks, regions, levels, given, TILE, Encoder, chunk=64).collect())
    odd = given.withColumn("mpp", F.when(F.col("query_id") == 10, F.col("mpp")).when(F.col("query_id") == 11, 0.77))
    found = locate.search(chunks, regions, levels, odd, TILE, Encoder, chunk=64)
    check(found.collect(), {10: PLANTED[10]})  # no level of 0.77 microns, and nothing to estimate the third with


def test_mixed_given_and_estimated(spark, chunks, tables, queries):
    regions, levels, samples = tables
    mixed = queries.withColumn("mpp", F.when(F.col("query_id") == 12, 1.0))
    check(locate.search(chunks, regions, levels, mixed, TILE, Encoder, samples=samples, k=7, chunk=64).collect())


def test_only_needed_levels_are_read(spark, chunks, tables):
    regions, levels, _ = tables
    needed = spark.createDataFrame([(1, 2, 4.0)], "slide_id long, level int, ds double")
    features = locate.level_features(chunks, regions, needed, TILE, Encoder, 64)
    assert features.count() == 6 * 5 + 5 * 4
    assert "dynamicpruning" in features._jdf.queryExecution().executedPlan().toString().lower()


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, t string")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("i"))) != fingerprint(a.distinct())
    assert fingerprint(a, "i") != fingerprint(a, "t") and fingerprint(a.where("false")) == fingerprint(a.where("i > 9"))


def test_a_failed_stage_is_built_again(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    broken = spark.range(4).select(F.raise_error(F.lit("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        stages.get("s", {"a": 1}, lambda: broken)
    assert stages.built == []
    assert stages.get("s", {"a": 1}, lambda: spark.range(3)).count() == 3 and stages.get("s", {"a": 1}, lambda: broken).count() == 3
    assert stages.get("s", {"a": 2}, lambda: spark.range(5)).count() == 5 and stages.built == ["s", "s"]


def test_statistics_of_levels(spark, chunks, pyramids, tables, queries):
    """The same tiles as a loop that stops at ``n``, and all three estimates."""
    _, levels, _ = tables
    n, tries = 6, 3
    stats = [image.statistic_udf(image.spectral_centroid), image.statistic_udf(image.autocorr_length)]
    refs = [locate.statistic_fingerprints(chunks, levels, s, TILE, n, tries, least=40.0, chunk=64) for s in stats]
    boxes = levels.select("slide_id", "level", F.lit(0).alias("index"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    stream = sampling.candidates(boxes, n * tries, TILE, ("slide_id", "level")).orderBy("try").collect()
    plain = []
    for stat, got in zip((image.spectral_centroid, image.autocorr_length), refs):
        want = {}
        for s, held in pyramids.items():
            for k, p in enumerate(held):
                kept = []
                for r in stream:
                    if (r["slide_id"], r["level"]) == (s, k) and len(kept) < n:
                        gray = image.luma(p[r["y"] : r["y"] + TILE, r["x"] : r["x"] + TILE])
                        if gray.std() >= 40.0:
                            kept.append(float(stat(gray[None])[0]))
                want[(s, k)] = float(np.median(kept)) if kept else float("nan")
        rows = {(r["slide_id"], r["level"]): r["stat"] for r in got.collect()}
        assert rows.keys() == want.keys(), rows
        assert {i: rows[i] for i in want} == pytest.approx(want, rel=1e-5, nan_ok=True)
        plain.append(want)
    one = queries.select("query_id", F.col("image"))
    got = {(r["slide_id"], r["query_id"]): r for r in locate.estimate_from_statistics(one, refs, stats, k=2).collect()}
    shown = {r["query_id"]: image.luma(image.decode(r["image"].asDict())) for r in queries.collect()}
    for (s, q), r in got.items():
        w = [float(f(shown[q][None])[0]) for f in (image.spectral_centroid, image.autocorr_length)]
        held = [(k, BASE * 2**k, plain[0][(s, k)], plain[1][(s, k)]) for k in range(3) if not math.isnan(plain[0][(s, k)])]
        assert r["level"] == min(held, key=lambda h: (abs(h[2] - w[0]), h[0]))[0]
        m, d = np.mean([h[2:] for h in held], axis=0), np.std([h[2:] for h in held], axis=0) + 1e-9
        near = sorted((float(np.linalg.norm((np.array(w) - h[2:]) / d)), h[0], h[1]) for h in held)[:2]
        weights = np.array([1 / (x[0] + 1e-9) for x in near])
        assert r["weighted_mpp"] == pytest.approx(float(np.exp((weights * np.log([x[2] for x in near])).sum() / weights.sum())))
        by = sorted((h[2], h[1]) for h in held)
        assert by[0][1] <= r["mpp"] <= by[-1][1] or by[-1][1] <= r["mpp"] <= by[0][1]
        assert [x["level"] for x in r["spread"]] == [h[0] for h in held]
    assert len(got) == 6
