"""Table functions, region versions and small sources that SQL rows don't cover."""

import csv
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.functions import image, tables
from gridseek.operators import grid, regions
from gridseek.sources import slides


def test_extract_all(spark):
    draw = np.random.default_rng(1)
    pictures = [draw.integers(0, 256, s, dtype=np.uint8) for s in ((70, 100, 3), (32, 90, 3), (10, 10, 3), (64, 64, 3))]
    rows = [(k, image.encode_row(p)) for k, p in enumerate(pictures)] + [(9, None)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("image", image.IMAGE)]))
    tables.register(spark)
    df.createOrReplaceTempView("pictures_of_a_test")
    for overlap in (True, False):
        got = spark.sql(f"SELECT p.id, t.* FROM pictures_of_a_test p, LATERAL extract_all(p.image, 32, {str(overlap).lower()}) t").collect()
        sizes = df.where("image IS NOT NULL").select("id", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.lit(32).alias("tile"))
        names = ("id", "kind", "row", "col", "y", "x", "size_px", "flat_idx")
        want = grid.patches(sizes, overlap).select(*names).collect()
        assert sorted(tuple(r[n] for n in names) for r in got) == sorted(map(tuple, want))
        assert all(np.array_equal(image.decode(r["image"].asDict()), pictures[r["id"]][r["y"] : r["y"] + 32, r["x"] : r["x"] + 32]) for r in got)
    assert spark.sql("SELECT count(*) AS n FROM pictures_of_a_test p, LATERAL extract_all(p.image, 32) t").first()["n"] > 0
    for wrong in ("extract_all(p.image, p.id)", "extract_all(p.image, 0)", "extract_all(p.id, 32)"):
        with pytest.raises(Exception, match="extract_all needs"):
            spark.sql(f"SELECT * FROM pictures_of_a_test p, LATERAL {wrong} t").collect()


BOXES = "index int, x int, y int, w int, h int"


def test_region_log_survives_its_session(spark, tmp_path):
    boxes = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 5, 5, 10, 10), (2, 50, 50, 3, 3)], BOXES)
    log = regions.RegionLog(spark, str(tmp_path / "log"))
    assert log.start(boxes).count() == 3 and not log.undo()
    assert log.merge().count() == 2
    assert log.apply(lambda b: b.where("w > 5"), "filter").count() == 1
    assert log.merge().count() == 1 and log.head() == 2  # one box: nothing to merge
    later = regions.RegionLog(spark.newSession(), str(tmp_path / "log"))
    assert later.head() == 2 and later.undo() and later.now().count() == 2 and later.undo() and later.head() == 0 and not later.undo()
    assert later.apply(lambda b: b.where("index = 2"), "filter").count() == 1 and later.head() == 3
    assert later.undo() and later.head() == 0 and later.read(2).count() == 1  # no version is ever lost
    assert regions.RegionLog(spark, str(tmp_path / "log")).resume().count() == 3
    with pytest.raises(Exception, match="stop"):
        later.apply(lambda b: b.withColumn("w", F.raise_error(F.lit("stop")).cast("int")))
    assert later.head() == 0 and later.apply(lambda b: b.where("x = 5")).count() == 1
    assert [tuple(r) for r in later.steps().orderBy("step").select("version", "change").collect()] == [
        (0, "start"), (1, "merge"), (2, "filter"), (1, "undo"), (0, "undo"), (3, "filter"), (0, "undo"), (0, "resume"), (4, "change"),
    ]


def test_summaries_and_level0_reads(spark, tmp_path):
    slides.write_summary(spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double").coalesce(1), str(tmp_path / "summary"))
    rows = [r for p in (tmp_path / "summary").glob("*.csv") for r in csv.reader(p.open())]
    assert rows == [["name", "value"], ["a", "1.5"], ["b", ""]]
    levels = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.0)], "slide_id long, level int, ds double")
    asked = spark.createDataFrame([(7, 1, 1, 103, -6, 8, 8)], "read_id long, slide_id long, level int, x0 int, y0 int, pw int, ph int")
    got = slides.level0_reads(asked, levels).first()
    assert (got["px"], got["py"], got["read_id"]) == (25, -1, 7) and "ds" not in got.asDict()


def test_distortion_by_its_formula():
    p = np.random.default_rng(3).integers(0, 256, (9, 12, 3), dtype=np.uint8)
    for k1, k2 in ((0.2, 0.0), (-0.3, 0.1), (-1.0, 0.0)):
        got = image.distort(p, k1, k2)
        for y in range(9):
            for x in range(12):
                v, u = (y - 4) / 4, (x - 5.5) / 5.5
                scale = 1 + k1 * (u * u + v * v) + k2 * (u * u + v * v) ** 2
                if abs(scale) > 1e-3:
                    fy, fx = min(max(v / scale * 4 + 4, 0), 8), min(max(u / scale * 5.5 + 5.5, 0), 11)
                    a, b = int(fy), int(fx)
                    corner = lambda i, j: p[min(a + i, 8), min(b + j, 11)].astype(float)  # noqa: E731, B023
                    want = sum(corner(i, j) * (fy - a if i else 1 - fy + a) * (fx - b if j else 1 - fx + b) for i in (0, 1) for j in (0, 1))
                    assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-6
    assert image.distort(np.zeros((1, 1, 3), np.uint8)).shape == (1, 1, 3)


def _png(path, pixels):
    """A PNG file of gray or RGB bytes."""
    h, w = pixels.shape[:2]
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""))


def test_image_files(spark, tmp_path):
    draw = np.random.default_rng(2)
    made = {"a.png": draw.integers(0, 256, (20, 31, 3), dtype=np.uint8), "b.png": draw.integers(0, 256, (9, 5), dtype=np.uint8)}
    for name, pixels in made.items():
        _png(tmp_path / name, pixels)
    (tmp_path / "c.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: image.decode(r["image"].asDict()) for r in slides.load_images(spark, str(tmp_path)).collect()}
    assert got.keys() == made.keys() and all(np.array_equal(p, image.as_rgb(made[n])) for n, p in got.items())
