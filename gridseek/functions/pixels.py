"""Effects on pixel rows ``(image_id, height, width, y, x, r, g, b)`` as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RGB = ("r", "g", "b")


def _cut(c: Column) -> Column:
    """A value cut to a byte."""
    return F.least(F.lit(255), F.greatest(F.lit(0), c)).cast("int")


def as_rgb(pixels: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Rows of one gray, three or four channels as RGB bytes: gray is repeated, a fourth channel goes, values are cut."""
    if len(channels) not in (1, 3, 4):
        raise ValueError(f"no image of {len(channels)} channels")
    named = dict(zip(_RGB, channels * 3 if len(channels) == 1 else channels))
    return pixels.select(*[c for c in pixels.columns if c not in (*channels, *_RGB)], *[_cut(F.col(c)).alias(n) for n, c in named.items()])


def field_mask(pixels: DataFrame, fill: int = 255) -> DataFrame:
    """Pixels outside the largest circle around the middle one are filled."""
    half = lambda c: F.floor(F.col(c) / 2)
    inside = F.pow(F.col("y") - half("height"), 2) + F.pow(F.col("x") - half("width"), 2) <= F.pow(F.least(half("height"), half("width")), 2)
    return pixels.withColumns({c: F.when(inside, F.col(c)).otherwise(fill).cast("int") for c in _RGB})


def vignette(pixels: DataFrame, strength: float = 0.4) -> DataFrame:
    """Gain that falls off from the centre; values are cut to whole numbers."""
    h, w = F.col("height") / 2, F.col("width") / 2
    far = F.pow(F.col("y") - h, 2) + F.pow(F.col("x") - w, 2)
    gain = F.lit(1 - strength) + strength * F.exp(-far / (2 * F.pow(0.8 * F.least(h, w), 2)))
    return pixels.withColumns({c: _cut(F.col(c) * gain) for c in _RGB})


def chromatic(pixels: DataFrame, shift: int = 2) -> DataFrame:
    """Red and blue moved apart sideways; borders are mirrored with the edge repeated."""
    if not shift:
        return pixels
    w = F.col("width")
    mirrored = lambda at: F.when(at < 0, -at - 1).when(at >= w, 2 * w - 1 - at).otherwise(at).cast("int")
    key = ["image_id", "y"]
    side = lambda c: pixels.select(*key, F.col("x").alias(f"{c}_x"), F.col(c).alias(f"{c}_moved"))
    asks = pixels.withColumns({"r_x": mirrored(F.col("x") - shift), "b_x": mirrored(F.col("x") + shift)})
    both = asks.join(side("r"), [*key, "r_x"]).join(side("b"), [*key, "b_x"])
    return both.select(*[F.col(f"{c}_moved").alias(c) if c in ("r", "b") else F.col(c) for c in pixels.columns])
