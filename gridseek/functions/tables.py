"""Table functions for SQL (the function slots of the survey's §2.9)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gridseek.functions.image import IMAGE, decode, encode_row

_PATCH = [("kind", T.StringType()), *((n, T.IntegerType()) for n in ("row", "col", "y", "x", "size_px", "flat_idx")), ("image", IMAGE)]


class ExtractAll:
    """``extract_all(image, tile[, overlap])``: the patches of both layers of an image, in the order of flat indexes.

    ``tile`` is a constant; tails that don't fill a tile are dropped, and the overlap layer, half a tile further,
    exists where both sides have two tiles. A null image has no patches.
    """

    @staticmethod
    def analyze(image: AnalyzeArgument, tile: AnalyzeArgument, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        fields = getattr(image.dataType, "names", [])
        if not isinstance(image.dataType, T.NullType) and not set(IMAGE.names) <= set(fields):
            raise Exception("extract_all needs an image with height, width and data")
        if not tile.isConstantExpression or not isinstance(tile.value, int) or tile.value < 1:
            raise Exception("extract_all needs a constant positive tile")
        return AnalyzeResult(T.StructType([T.StructField(n, t) for n, t in _PATCH]))

    def eval(self, image, tile: int, overlap: bool = True) -> Iterator[tuple]:
        if image is None or image["data"] is None:
            return
        pixels = decode(image)
        rows, cols = pixels.shape[0] // tile, pixels.shape[1] // tile
        layers = [("main", rows, cols, 0)]
        if overlap and rows > 1 and cols > 1:
            layers.append(("overlap", rows - 1, cols - 1, tile // 2))
        wide = 2 * cols - 1 if len(layers) > 1 else cols
        for r in range(rows):
            slots = [(2 * c + k, kind, c, shift) for k, (kind, high, n, shift) in enumerate(layers) if r < high for c in range(n)]
            full = len(layers) > 1 and r < rows - 1  # the last row has main tiles only
            for slot, kind, c, shift in sorted(slots):
                y, x = r * tile + shift, c * tile + shift
                patch = encode_row(pixels[y : y + tile, x : x + tile])
                yield kind, r, c, y, x, tile, r * wide + (slot if full else c), patch


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("extract_all", F.udtf(ExtractAll))
