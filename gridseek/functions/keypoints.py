"""Keypoint extractors as a slot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.functions.image import decode, luma

_POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("desc", T.ArrayType(T.FloatType()))]))


class Corners:
    """A deterministic extractor without weights: the strongest corners, described by the gray values around them."""

    def __init__(self, points: int = 400, reach: int = 5):
        self.points, self.reach = points, reach

    def __call__(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gray, k = luma(pixels), self.reach
        if min(gray.shape) <= 2 * k + 2:
            return np.zeros((0, 2)), np.zeros((0, (2 * k + 1) ** 2))
        dy, dx = np.gradient(gray)
        sums = [np.lib.stride_tricks.sliding_window_view(np.pad(m, 2), (5, 5)).sum(axis=(2, 3)) for m in (dx * dx, dy * dy, dx * dy)]
        strength = sums[0] * sums[1] - sums[2] ** 2 - 0.05 * (sums[0] + sums[1]) ** 2
        top = np.lib.stride_tricks.sliding_window_view(np.pad(strength, 2, constant_values=-np.inf), (5, 5)).max(axis=(2, 3))
        inside = np.zeros(gray.shape, dtype=bool)
        inside[k:-k, k:-k] = True
        y, x = np.nonzero((strength == top) & (strength > 0) & inside)
        best = np.lexsort((x, y, -strength[y, x]))[: self.points]
        y, x = y[best], x[best]
        around = np.lib.stride_tricks.sliding_window_view(gray, (2 * k + 1, 2 * k + 1))[y - k, x - k].reshape(len(y), -1)
        return np.stack([x, y], axis=1).astype(np.float64), around - around.mean(axis=1, keepdims=True)


def extract(images: DataFrame, make: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]] = Corners, image: str = "image") -> DataFrame:
    """``images`` without the image and ``(x, y, desc)``, a row for each keypoint; ``make`` builds the extractor once in a task."""

    @F.pandas_udf(_POINTS)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        extractor = make()
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                places, descriptors = extractor(decode(row))
                out.append([{"x": float(x), "y": float(y), "desc": d.tolist()} for (x, y), d in zip(places, descriptors)])
            yield pd.Series(out, dtype="object")

    return images.withColumn("point", F.explode(run(F.col(image)))).select(*[c for c in images.columns if c != image], "point.*")
