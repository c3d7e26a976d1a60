"""Functions on small images inside tasks: tile statistics, optical effects and encoders.

Images travel as ``struct<height int, width int, data binary>``, rows of RGB bytes. Effects are numpy
functions of one image and a few numbers; :func:`image_udf` turns one into a vectorised column function.
Statistics take a stack of gray images of one size; :func:`statistic_udf` hands them a batch's images by size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])

#: Pixels of the images that a statistic gets at once, unless one has more; spectra take some hundred bytes a pixel.
STACK_PIXELS = 1 << 18


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Any gray, RGB or RGBA raster as RGB bytes; values are clipped."""
    if pixels.ndim == 2:
        pixels = np.repeat(pixels[:, :, None], 3, axis=2)
    if pixels.ndim != 3 or pixels.shape[2] not in (3, 4):
        raise ValueError(f"no image of shape {pixels.shape}")
    return np.clip(pixels[:, :, :3], 0, 255).astype(np.uint8)


def decode(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(int(row["height"]), int(row["width"]), 3)


def encode_row(pixels: np.ndarray) -> dict:
    rgb = as_rgb(pixels)
    return {"height": rgb.shape[0], "width": rgb.shape[1], "data": rgb.tobytes()}


def luma(pixels: np.ndarray) -> np.ndarray:
    """Brightness as whole numbers (M8)."""
    return np.floor(pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5)


@lru_cache(maxsize=16)
def _taper(shape: tuple[int, int]) -> np.ndarray:
    """Hann window over both axes (M3)."""
    return np.outer(*(np.hanning(n) for n in shape))


@lru_cache(maxsize=16)
def _rings(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole radius of each bin of an unshifted spectrum, and the bins of each radius."""
    f = [np.fft.fftfreq(n, 1 / n) for n in shape]
    radius = np.hypot(f[0][:, None], f[1][None, :]).astype(np.int64)
    return radius.ravel(), np.bincount(radius.ravel())


def spectral_centroid(gray: np.ndarray) -> np.ndarray:
    """Mean radius of the tapered images' spectra, weighted by the mean power of each radius but 0."""
    n, shape = len(gray), gray.shape[1:]
    flat = gray - gray.mean(axis=(1, 2), keepdims=True)
    power = np.abs(np.fft.fft2(flat * _taper(shape))) ** 2
    radius, bins = _rings(shape)
    slot = radius[None, :] + np.arange(n)[:, None] * len(bins)
    profile = np.bincount(slot.ravel(), power.ravel(), minlength=n * len(bins)).reshape(n, -1) / bins
    profile[:, 0] = 0
    return profile @ np.arange(len(bins)) / (profile.sum(axis=1) + 1e-9)


def autocorr_length(gray: np.ndarray) -> np.ndarray:
    """First lag along the rows at which the autocorrelation is below half; all lags if none, 0 if flat."""
    flat = gray - gray.mean(axis=(1, 2), keepdims=True)
    lags = np.fft.ifft2(np.abs(np.fft.fft2(flat)) ** 2).real
    most = lags.max(axis=(1, 2))
    line = lags[:, 0, : -(-gray.shape[2] // 2)] / np.where(most > 0, most, 1)[:, None]
    below = line < 0.5
    first = np.where(below.any(axis=1), below.argmax(axis=1), line.shape[1])
    return np.where(most > 0, first, 0).astype(np.float64)


def adjust_color(pixels: np.ndarray, saturation: float = 1.0, contrast: float = 1.0, brightness: float = 0.0) -> np.ndarray:
    """Saturation times a factor, value times contrast plus brightness, both cut to their range; the hue stays."""
    x = pixels.astype(np.float64)
    high = x.max(axis=2, keepdims=True)
    spread = high - x.min(axis=2, keepdims=True)
    share = np.clip(spread / np.maximum(high, 1) * saturation, 0, 1)
    value = np.floor(np.clip(high * contrast + brightness, 0, 255))
    return as_rgb(np.round(value * (1 - share * (high - x) / np.maximum(spread, 1))))


def add_noise(pixels: np.ndarray, sigma: float, seed: int = 0) -> np.ndarray:
    """Gaussian noise, cut to whole numbers; none for a sigma of 0 or less."""
    if sigma <= 0:
        return pixels
    return as_rgb((pixels + np.random.default_rng(seed).normal(0, sigma, pixels.shape)))


def quantize(pixels: np.ndarray, step: int = 8) -> np.ndarray:
    """A stand-in for a lossy codec: block means are kept and differences are rounded to ``step``."""
    h, w = pixels.shape[0] // 8 * 8, pixels.shape[1] // 8 * 8
    out = pixels.astype(np.float64).copy()
    blocks = out[:h, :w].reshape(h // 8, 8, w // 8, 8, 3)
    mean = blocks.mean(axis=(1, 3), keepdims=True)
    out[:h, :w] = (mean + np.round((blocks - mean) / step) * step).reshape(h, w, 3)
    return as_rgb(np.round(out))


def field_mask(pixels: np.ndarray, fill: int = 255) -> np.ndarray:
    """Everything outside the largest circle around the middle pixel is filled."""
    h, w = pixels.shape[:2]
    y, x = np.ogrid[:h, :w]
    inside = (y - h // 2) ** 2 + (x - w // 2) ** 2 <= (min(h, w) // 2) ** 2
    return np.where(inside[:, :, None], pixels, np.uint8(fill))


def vignette(pixels: np.ndarray, strength: float = 0.4) -> np.ndarray:
    """Gain that falls off from the centre; values are cut to whole numbers."""
    h, w = pixels.shape[:2]
    y, x = np.ogrid[:h, :w]
    fall = np.exp(-((y - h / 2) ** 2 + (x - w / 2) ** 2) / (2 * (0.8 * min(h / 2, w / 2)) ** 2))
    return as_rgb(pixels * (1 - strength + strength * fall)[:, :, None])


def stage_shift(pixels: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """A shift by whole pixels; the border is mirrored with its edge repeated."""
    n = max(abs(dy), abs(dx), 1)
    padded = np.pad(pixels, ((n, n), (n, n), (0, 0)), mode="symmetric")
    return padded[n - dy : n - dy + pixels.shape[0], n - dx : n - dx + pixels.shape[1]]


def _sampled(pixels: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.clip(y, 0, pixels.shape[0] - 1), np.clip(x, 0, pixels.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, pixels.shape[0] - 1), np.minimum(x0 + 1, pixels.shape[1] - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    return (pixels[y0, x0] * (1 - fx) + pixels[y0, x1] * fx) * (1 - fy) + (pixels[y1, x0] * (1 - fx) + pixels[y1, x1] * fx) * fy


#: What is added to half a side before lengths are measured in it. Fixed value.
_SIDE = 1e-6


def distort(pixels: np.ndarray, k1: float = 0.2, k2: float = 0.0) -> np.ndarray:
    """Lens distortion, bilinear: a pixel is read at its place over ``1 + k1 r^2 + k2 r^4``.

    Radii are in half widths and heights from the centre; a positive ``k1`` gives a barrel.
    """
    (high, middle_y), (wide, middle_x) = ((n, 0.5 * n - 0.5) for n in pixels.shape[:2])
    down, across = np.arange(high) - middle_y, np.arange(wide) - middle_x
    part = lambda d: np.square(d / (d.max() + _SIDE))  # noqa: E731  one side's share of the squared radius
    with np.errstate(divide="ignore", invalid="ignore"):  # where the polynomial is zero a place is infinitely far, beyond the border
        gain = np.reciprocal(np.polyval((k2, k1, 1.0), np.add.outer(part(down), part(across))))
        places = np.nan_to_num(middle_y + down[:, None] * gain), np.nan_to_num(middle_x + across * gain)
    return as_rgb(np.round(_sampled(pixels, *places)))


def defocus(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a disk; the border is mirrored at its edge."""
    if radius <= 0:
        return pixels
    padded = np.pad(pixels.astype(np.float64), ((radius, radius), (radius, radius), (0, 0)), mode="reflect")
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    parts = (padded[radius + i : radius + i + pixels.shape[0], radius + j : radius + j + pixels.shape[1]] for i, j in steps)
    return as_rgb(np.round(sum(parts) / len(steps)))


def chromatic(pixels: np.ndarray, shift: int) -> np.ndarray:
    """Red and blue moved apart sideways."""
    if not shift:
        return pixels
    return np.dstack([stage_shift(pixels, 0, shift)[:, :, 0], pixels[:, :, 1], stage_shift(pixels, 0, -shift)[:, :, 2]])


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = (np.arange(height) + 0.5) * pixels.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * pixels.shape[1] / width - 0.5
    return as_rgb(np.round(_sampled(pixels, *np.meshgrid(y, x, indexing="ij"))))


def _cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom."""
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels by name, with their reach in pixels.
KERNELS = {"bicubic": (_cubic, 2), "lanczos": (_lanczos, 3)}


def _weights(old: int, new: int, kernel: str) -> np.ndarray:
    """Rows of weights of the old pixels for each new one; kernels widen with the step where an image shrinks."""
    shape, reach = KERNELS[kernel]
    wide = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new
    apart = np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) / wide
    held = np.where(apart < reach, shape(apart), 0.0)
    return held / held.sum(axis=1, keepdims=True)


def resample(pixels: np.ndarray, height: int, width: int, kernel: str = "lanczos") -> np.ndarray:
    """Separable resampling by a kernel."""
    rows, cols = _weights(pixels.shape[0], height, kernel), _weights(pixels.shape[1], width, kernel)
    return as_rgb(np.round(np.einsum("ij,jkc,lk->ilc", rows, pixels.astype(np.float64), cols, optimize=True)))


#: Means and deviations that encoders expect. Fixed values.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def preprocess(pixels: np.ndarray, size: int = 256, crop: int = 224) -> np.ndarray:
    """An encoder's input: the shorter side resized, the centre cut out, values standardised (M9)."""
    h, w = pixels.shape[:2]
    scaled = resample(pixels, *((size, max(1, size * w // h)) if h <= w else (max(1, size * h // w), size)), "bicubic")
    top, left = ((n - crop + 1) // 2 for n in scaled.shape[:2])
    part = scaled[max(top, 0) : max(top, 0) + crop, max(left, 0) : max(left, 0) + crop]
    return ((part / 255.0 - MEANS) / DEVIATIONS).astype(np.float32)


def microscope_photo(pixels: np.ndarray, seed: int = 0) -> np.ndarray:
    """All effects in their fixed order and usual strength."""
    dy, dx = np.random.default_rng(seed).integers(-3, 4, 2).tolist()
    x = quantize(add_noise(adjust_color(pixels), 4.0, seed))
    x = stage_shift(vignette(x), dy, dx)
    return chromatic(defocus(distort(x), 2), 2)


def image_udf(effect: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column | str], Column]:
    """A column function that applies ``effect`` to images."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([encode_row(effect(decode(r))) for r in images.to_dict("records")], columns=IMAGE.names)

    return run


def statistic_udf(stat: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column | str], Column]:
    """A column function for a number of each image; ``stat`` gets stacks of gray images of one size."""

    @F.pandas_udf(T.DoubleType())
    def run(images: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(images))
        for (h, w), at in images.groupby(["height", "width"]).indices.items():
            h, w = int(h), int(w)
            step = max(1, STACK_PIXELS // max(h * w, 1))
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                stack = np.stack([np.frombuffer(d, np.uint8) for d in images["data"].to_numpy()[some]])
                out[some] = stat(luma(stack.reshape(len(some), h, w, 3)))
        return pd.Series(out)

    return run


class ColorLayout:
    """A deterministic encoder without weights: mean colours of a grid and edge strengths, of unit length."""

    def __init__(self, cells: int = 4):
        self.cells = cells

    def __call__(self, images: list[np.ndarray]) -> np.ndarray:
        out = []
        for pixels in images:
            small = resize(pixels, 8 * self.cells, 8 * self.cells).astype(np.float64)
            gray = luma(small)
            edges = np.abs(np.diff(gray, axis=0, append=gray[-1:])) + np.abs(np.diff(gray, axis=1, append=gray[:, -1:]))
            layers = np.dstack([small, edges]).reshape(self.cells, 8, self.cells, 8, 4).mean(axis=(1, 3)).ravel()
            layers = layers - layers.mean()
            out.append(layers / max(np.linalg.norm(layers), 1e-12))
        return np.array(out, dtype=np.float32).reshape(len(out), -1)


def encode_images(df: DataFrame, make: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], image: str = "image", batch: int = 64) -> DataFrame:
    """``df`` and ``feat``: vectors by an encoder that ``make`` builds once in each task.

    A batch of one and empty input are handled like any other.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        encoder = make()
        for frame in frames:
            images = [decode(r) for r in frame.to_dict("records")]
            parts = [np.asarray(encoder(images[i : i + batch])) for i in range(0, len(images), batch)]
            yield pd.Series([v.tolist() for p in parts for v in p], dtype="object")

    return df.withColumn("feat", run(F.col(image)))
