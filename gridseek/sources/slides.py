"""Slides as chunk tables, tile lists and feature caches (SRC1-SRC4, SRC8, SRC9, SNK1, SNK2, X12, X13, D1).

A slide level is stored as chunks ``(slide_id, level, ty, tx, image)`` of ``CHUNK`` pixels a side,
partitioned by slide and level, so that a region read prunes to one level and to the chunks it touches.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gridseek.functions.image import IMAGE, decode, encode_row

CHUNK = 256
TILES = T.StructType(
    [T.StructField("level", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("tile_size", T.IntegerType()), T.StructField("mpp", T.DoubleType())]
)


def _cut(rows: pd.DataFrame, chunk: int) -> pd.DataFrame:
    out = []
    for r in rows.to_dict("records"):
        pixels = decode(r["image"])
        for ty in range(-(-pixels.shape[0] // chunk)):
            for tx in range(-(-pixels.shape[1] // chunk)):
                part = pixels[ty * chunk : (ty + 1) * chunk, tx * chunk : (tx + 1) * chunk]
                out.append((r["slide_id"], r["level"], ty, tx, encode_row(part)))
    return pd.DataFrame(out, columns=["slide_id", "level", "ty", "tx", "image"])


def chunk_images(images: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of whole images ``(slide_id, level, image)`` of moderate size."""
    schema = T.StructType([T.StructField("slide_id", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("level", "ty", "tx")), T.StructField("image", IMAGE)])
    cut = partial(_cut, chunk=chunk)
    return images.select("slide_id", "level", "image").mapInPandas(lambda batches: (cut(b) for b in batches), schema)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("slide_id", "level").parquet(path)


_PIECE = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("image", IMAGE)])


def _pasted(size: tuple[int, int], pieces: list[dict]) -> np.ndarray:
    """Pieces at their places on a black image."""
    out = np.zeros((*size, 3), np.uint8)
    for p in pieces:
        part = decode(p["image"])
        out[p["y"] : p["y"] + part.shape[0], p["x"] : p["x"] + part.shape[1]] = part
    return out


def _pieces(chunk: int):
    """What a read takes from a chunk, and where it goes; a read of one chunk is whole then, with black around it."""

    @F.pandas_udf(_PIECE)
    def cut(reads: pd.DataFrame, images: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, i in zip(reads.to_dict("records"), images.to_dict("records")):
            top, left, empty = r["ty"] * chunk - r["py"], r["tx"] * chunk - r["px"], i["data"] is None
            pixels = np.zeros((0, 0, 3), np.uint8) if empty else decode(i)
            part = pixels[max(-top, 0) : max(r["ph"] - top, 0), max(-left, 0) : max(r["pw"] - left, 0)]
            place = (max(top, 0), max(left, 0))
            if r["whole"]:
                held = [] if not part.size else [{"y": place[0], "x": place[1], "image": encode_row(part)}]
                part, place = _pasted((r["ph"], r["pw"]), held), (0, 0)
            out.append({"y": place[0], "x": place[1], "image": encode_row(part) if part.size or r["whole"] else None})
        return pd.DataFrame(out, columns=_PIECE.names)

    return cut


def _stitch(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    pieces = [p for p in rows["piece"] if p is not None and p["image"] is not None]
    return pd.DataFrame([{"read_id": first["read_id"], "image": encode_row(_pasted((int(first["ph"]), int(first["pw"])), pieces))}])


def read_regions(chunks: DataFrame, asked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(read_id, image)`` of rectangles ``(read_id, slide_id, level, px, py, pw, ph)`` in the level's pixels (SRC2, X12).

    Pixels outside the slide are black; rectangles without pixels give empty images. Each rectangle meets only
    the chunks that it touches. What it takes is cut where the chunk is, so that a rectangle inside one chunk, such
    as an aligned tile, is ready there and of the others only their own pixels are shuffled.
    """
    low, high = ((lambda a, n, e=e: F.floor((F.col(a) + (F.col(n) - 1) * e) / chunk).cast("int")) for e in (0, 1))
    span = lambda a, n: F.sequence(low(a, n), F.greatest(low(a, n), high(a, n)))
    both = asked.withColumns({"tys": span("py", "ph"), "txs": span("px", "pw")})
    cells = both.withColumn("whole", F.size("tys") * F.size("txs") == 1).withColumn("ty", F.explode("tys")).withColumn("tx", F.explode("txs"))
    parts = cells.join(chunks.select("slide_id", "level", "ty", "tx", "image"), ["slide_id", "level", "ty", "tx"], "left")
    asks = F.struct(*[F.col(c).cast("long").alias(c) for c in ("px", "py", "pw", "ph", "ty", "tx")], "whole")
    cut = parts.select("read_id", "pw", "ph", "whole", _pieces(chunk)(asks, "image").alias("piece"))
    whole = cut.where("whole").select(F.col("read_id").cast("long").alias("read_id"), "piece.image")
    schema = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("image", IMAGE)])
    return whole.union(cut.where("NOT whole").groupBy("read_id").applyInPandas(_stitch, schema))


def whole_levels(chunks: DataFrame, levels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(slide_id, level, image)`` of whole levels of moderate size, ``(slide_id, level, width, height)`` (SRC3)."""
    number = F.col("slide_id").cast("long") * 256 + F.col("level")  # fewer than 256 levels
    asked = levels.select(number.alias("read_id"), "slide_id", "level", F.lit(0).alias("px"), F.lit(0).alias("py"), F.col("width").alias("pw"), F.col("height").alias("ph"))
    read = read_regions(chunks, asked, chunk)
    return read.select(F.floor(F.col("read_id") / 256).alias("slide_id"), (F.col("read_id") % 256).cast("int").alias("level"), "image")


def level0_reads(asked: DataFrame, levels: DataFrame) -> DataFrame:
    """Reads whose origin ``x0, y0`` is in level-0 pixels, as reads of their level (SRC2)."""
    both = asked.join(levels.select("slide_id", "level", "ds"), ["slide_id", "level"])
    return both.withColumns({"px": (F.col("x0") / F.col("ds")).cast("int"), "py": (F.col("y0") / F.col("ds")).cast("int")}).drop("ds")


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files by Spark's own reader: ``(path, image)`` with rows of RGB bytes (SRC4)."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)

    @F.pandas_udf(IMAGE)
    def to_rgb(images: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in images.to_dict("records"):
            pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
            out.append(encode_row(pixels[:, :, 0] if r["nChannels"] == 1 else pixels[:, :, 2::-1]))
        return pd.DataFrame(out, columns=IMAGE.names)

    return raw.select(F.col("image.origin").alias("path"), to_rgb(F.struct("image.height", "image.width", "image.nChannels", "image.data")).alias("image"))


def save_tiles(tiles: DataFrame, path: str) -> None:
    """A tile list as JSON (SRC8)."""
    tiles.select(*TILES.names).write.mode("overwrite").json(path)


def load_tiles(spark: SparkSession, path: str, tile_size: int = 256) -> DataFrame:
    """A tile list from JSON lines or arrays; tiles without a size have ``tile_size``."""
    return spark.read.schema(TILES).json(path).withColumn("tile_size", F.coalesce("tile_size", F.lit(tile_size)))


def cached_features(wanted: DataFrame, path: str, encode, keys: tuple[str, ...] = ("slide_id", "level", "flat_idx")) -> DataFrame:
    """Features of ``wanted`` from a cache, which gets what it lacks (SRC9, SNK1).

    ``encode(df)`` returns the keys and ``feat``. Only rows that are not in the cache are encoded.
    """
    spark = wanted.sparkSession
    schema = T.StructType([*(wanted.schema[k] for k in keys), T.StructField("feat", T.ArrayType(T.FloatType()))])
    try:
        missing = wanted.join(spark.read.schema(schema).parquet(path).select(*keys), list(keys), "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = wanted  # the first use of the cache
    encode(missing).select(*schema.names).write.mode("append").parquet(path)
    return wanted.join(spark.read.schema(schema).parquet(path), list(keys))


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary table as CSV with a header (SNK2)."""
    summary.write.mode("overwrite").option("header", True).csv(path)
