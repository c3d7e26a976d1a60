"""Slides in tiled files: what is read, what isn't, and what comes out."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.functions import image
from gridseek.operators import levels as level_operators
from gridseek.sources import slides, tiled


def write_tiff(path, pictures, tile=32, big=False, order="<", packed=8, predictor=1, text=None, broken=()):
    """A tiled pyramid; ``broken`` names tiles ``(level, ty, tx)`` whose bytes are no data."""
    word, out, tables = ("Q" if big else "I"), bytearray(16 if big else 8), []
    for level, p in enumerate(pictures):
        p = p[:, :, None] if p.ndim == 2 else p
        h, w, n = p.shape
        down, across = -(-h // tile), -(-w // tile)
        padded = np.zeros((down * tile, across * tile, n), np.uint8)
        padded[:h, :w] = p
        starts, counts = [], []
        for ty in range(down):
            for tx in range(across):
                part = padded[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=0).astype(np.uint8)
                data = part.tobytes() if packed == 1 else zlib.compress(part.tobytes())
                starts.append(len(out))
                counts.append(len(data))
                out += b"\xff" * len(data) if (level, ty, tx) in broken else data
        told = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * n), (259, 3, [packed]), (262, 3, [2 if n > 1 else 1]), (277, 3, [n]),
                (282, 5, [20000, 1]), (283, 5, [40000, 2]), (296, 3, [3]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]),
                (324, 16 if big else 4, starts), (325, 4, counts)]
        if text and level == 0:
            told.append((270, 2, text.encode() + b"\0"))
        tables.append(sorted(told))
    tables.append([(256, 4, [5]), (257, 4, [5])])  # a label without tiles
    link = 8 if big else 4
    struct.pack_into(f"{order}2sHHH" if big else f"{order}2sH", out, 0, b"II" if order == "<" else b"MM", 43 if big else 42, *((8, 0) if big else ()))
    for told in tables:
        entries = []
        for tag, kind, values in told:
            form = {2: None, 3: "H", 4: "I", 5: "I", 16: "Q"}[kind]
            data = values if form is None else struct.pack(f"{order}{len(values)}{form}", *values)
            n = len(values) // (2 if kind == 5 else 1)
            if len(data) > link:
                place, data = len(out), data
                out += data
                data = struct.pack(f"{order}{word}", place)
            entries.append(struct.pack(f"{order}HH{word}", tag, kind, n) + data.ljust(link, b"\0"))
        struct.pack_into(f"{order}{word}", out, link if link == 4 else 8, len(out)) if told is tables[0] else struct.pack_into(f"{order}{word}", out, after, len(out))  # noqa: F821
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(entries)) + b"".join(entries)
        after = len(out)
        out += bytes(link)
    path.write_bytes(out)


def pictures(seed, h, w, n=3):
    draw = np.random.default_rng(seed)
    top = draw.integers(0, 256, (h, w, n) if n > 1 else (h, w), dtype=np.uint8)
    return [top, top[::2, ::2].copy(), top[::4, ::4].copy()]


FORMS = [{}, {"big": True}, {"order": ">"}, {"packed": 1}, {"predictor": 2}, {"big": True, "order": ">", "predictor": 2}]


@pytest.mark.parametrize("form", FORMS)
def test_files_of_all_forms(tmp_path, form):
    for n in (1, 3, 4):
        made = pictures(1, 70, 90, n)
        write_tiff(tmp_path / "a.tif", made, **form)
        with open(tmp_path / "a.tif", "rb") as file:
            got = tiled.TiledImage(file)
            assert len(got.levels) == 3 and [got.size(k) for k in range(3)] == [(70, 90, 32, 32), (35, 45, 32, 32), (18, 23, 32, 32)]
            for level, p in enumerate(made):
                for ty in range(-(-p.shape[0] // 32)):
                    for tx, pixels in got.tiles(level, ty, np.arange(-(-p.shape[1] // 32))):
                        assert np.array_equal(pixels, image.as_rgb(p)[ty * 32 : (ty + 1) * 32, tx * 32 : (tx + 1) * 32])


@pytest.fixture
def folder(tmp_path):
    for k in range(2):
        write_tiff(tmp_path / f"s{k}.tif", pictures(k, 150 + 40 * k, 200), text="Maker|AppMag = 20|MPP = 0.5" if k else None)
    (tmp_path / "notes.txt").write_text("no slide")
    return tmp_path


def test_levels(spark, folder):
    _, levels = tiled.open_slides(spark, str(folder))
    rows = levels.orderBy("slide_id", "level").collect()
    assert [(r["slide_id"], r["level"], r["width"], r["height"], r["tile"], round(r["ds"], 2)) for r in rows] == [
        (0, 0, 200, 150, 32, 1.0), (0, 1, 100, 75, 32, 2.0), (0, 2, 50, 38, 32, 3.97), (1, 0, 200, 190, 32, 1.0), (1, 1, 100, 95, 32, 2.0), (1, 2, 50, 48, 32, 3.98),
    ]
    assert rows[0]["props"] == {"tiff.XResolution": "20000.0", "tiff.YResolution": "20000.0", "tiff.ResolutionUnit": "3"} and rows[3]["props"]["aperio.AppMag"] == "20"
    mpp = levels.where("level = 0").select("slide_id", level_operators.mpp_of(F.col("props")).alias("m")).orderBy("slide_id").collect()
    assert [(r["m"]["x"], r["m"]["y"]) for r in mpp] == [(0.5, 0.5), (0.5, 0.5)]


@pytest.mark.parametrize("part_bytes", ["1", "20000", "100000000"])
def test_tiles_are_the_chunks_of_whole_images(spark, folder, part_bytes):
    tiles, _ = tiled.open_slides(spark, str(folder), partBytes=part_bytes)
    rows = [(k, level, image.encode_row(p)) for k in range(2) for level, p in enumerate(pictures(k, 150 + 40 * k, 200))]
    whole = spark.createDataFrame(rows, T.StructType([T.StructField("slide_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("image", image.IMAGE)]))
    key = lambda r: (r["slide_id"], r["level"], r["ty"], r["tx"], bytes(r["image"]["data"]))
    assert sorted(map(key, tiles.collect())) == sorted(map(key, slides.chunk_images(whole, 32).collect()))


def test_only_wanted_tiles_are_read(spark, tmp_path):
    """Tiles that a filter excludes hold no data here, so that reading one fails."""
    made = pictures(3, 150, 200)
    all_tiles = [(level, ty, tx) for level, p in enumerate(made) for ty in range(-(-p.shape[0] // 32)) for tx in range(-(-p.shape[1] // 32))]
    keep = lambda level, ty, tx: level == 0 and ty >= 2 and tx in (1, 4)
    write_tiff(tmp_path / "a.tif", made, broken=[t for t in all_tiles if not keep(*t)])
    write_tiff(tmp_path / "b.tif", made, broken=all_tiles)
    tiles, _ = tiled.open_slides(spark, str(tmp_path), partBytes="5000")
    asked = tiles.where("slide_id = 0 AND level = 0 AND ty >= 2 AND tx IN (1, 4) AND length(path) > 3")
    got = {(r["ty"], r["tx"]): image.decode(r["image"].asDict()) for r in asked.collect()}
    assert got.keys() == {(ty, tx) for _, ty, tx in filter(lambda t: keep(*t), all_tiles)}
    assert all(np.array_equal(p, made[0][ty * 32 : ty * 32 + 32, tx * 32 : tx * 32 + 32]) for (ty, tx), p in got.items())
    with pytest.raises(Exception, match="(?i)decompress"):
        tiles.where("level = 1").collect()
    # and by the reader's own count
    reader = tiled.TileReader({"path": str(tmp_path / "a.tif"), "partBytes": "5000"})
    left = list(reader.pushFilters([tiled.D.EqualTo(("level",), 0), tiled.D.GreaterThan(("ty",), 1), tiled.D.In(("tx",), (1, 4)), tiled.D.EqualTo(("path",), "x")]))
    assert [f.attribute for f in left] == [("path",)] and len(reader.partitions()) > 3
    with open(tmp_path / "a.tif", "rb") as file:
        source = tiled.TiledImage(file)
        rows = [r for part in reader.partitions() for r in reader.rows(source, part)]
    assert source.reads == len(rows) == len(got)


def test_regions_of_files(spark, folder):
    tiles, levels = tiled.open_slides(spark, str(folder))
    reads = [(0, 0, 0, 10, 20, 100, 60), (1, 1, 1, 32, 32, 32, 32), (2, 1, 0, 64, 96, 20, 30), (3, 0, 2, 40, 30, 40, 20), (4, 1, 0, 500, 500, 8, 8), (5, 0, 0, -10, -5, 20, 20), (6, 0, 0, 33, 33, 0, 5)]
    asked = spark.createDataFrame(reads, "read_id long, slide_id long, level int, px int, py int, pw int, ph int")
    got = {r["read_id"]: image.decode(r["image"].asDict()) for r in slides.read_regions(tiles, asked, 32).collect()}
    assert len(got) == len(reads)
    for i, slide, level, x, y, w, h in reads:
        p = pictures(slide, 150 + 40 * slide, 200)[level]
        want = np.zeros((h, w, 3), np.uint8)
        for dy in range(h):
            for dx in range(w):
                if 0 <= y + dy < p.shape[0] and 0 <= x + dx < p.shape[1]:
                    want[dy, dx] = p[y + dy, x + dx]
        assert np.array_equal(got[i], want), i
    whole = {(r["slide_id"], r["level"]): image.decode(r["image"].asDict()) for r in slides.whole_levels(tiles, levels.where("level > 0"), 32).collect()}
    assert len(whole) == 4 and all(np.array_equal(p, pictures(k, 150 + 40 * k, 200)[level]) for (k, level), p in whole.items())


def test_aligned_tiles_are_not_shuffled_again(spark, folder):
    """After the join of reads and chunks, only reads of several chunks meet once more."""
    tiles, _ = tiled.open_slides(spark, str(folder))
    reads = spark.range(12).selectExpr("id AS read_id", "0L AS slide_id", "0 AS level", "CAST(32 * (id % 6) AS INT) AS px", "CAST(32 * (id DIV 6) AS INT) AS py", "32 AS pw", "32 AS ph")
    out = slides.read_regions(tiles, reads, 32)
    rows = out.collect()
    assert len(rows) == 12 and all(r["image"]["height"] == 32 for r in rows)
    assert {bytes(r["image"]["data"]) for r in rows} == {pictures(0, 150, 200)[0][32 * j : 32 * j + 32, 32 * i : 32 * i + 32].tobytes() for i in range(6) for j in range(2)}


def test_other_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"not a slide at all, really")
    for name in ("slide_tiles", "slide_levels"):
        with pytest.raises(Exception, match="TIFF"):
            tiled.register(spark)
            spark.read.format(name).load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="no slides"):
        spark.read.format("slide_tiles").load(str(tmp_path / "nowhere")).collect()
    write_tiff(tmp_path / "a.tif", pictures(1, 40, 40), packed=1)
    data = bytearray((tmp_path / "a.tif").read_bytes())
    at = data.index(struct.pack("<HHI", 259, 3, 1))
    data[at + 8 : at + 10] = struct.pack("<H", 7)
    (tmp_path / "a.tif").write_bytes(data)
    with pytest.raises(Exception, match="compression 7"):
        spark.read.format("slide_tiles").load(str(tmp_path)).where("level = 0").collect()


def test_sql(spark, folder):
    tiled.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW own_slides USING slide_levels OPTIONS (path '{folder}')")
    assert spark.sql("SELECT count(*) AS n FROM own_slides WHERE level = 1").first()["n"] == 2
