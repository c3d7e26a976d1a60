"""Keypoint matching and robust homographies."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions.keypoints import extract
from gridseek.operators.vectors import top_k

RATIO, THRESHOLD, LEAST_MATCHES = 0.75, 5.0, 4


def ratio_matches(queries: DataFrame, bank: DataFrame, ratio: float = RATIO, digits: int = 9) -> DataFrame:
    """``(query_id, ref_id, d1, d2)``: nearest descriptor by Euclidean distance, if it is well below the second.

    Descriptors may have any length. A bank of one descriptor gives no match.
    """
    near = top_k(queries, bank, 2, digits=digits, metric="l2")
    order = Window.partitionBy("query_id").orderBy("rank")
    both = near.withColumn("d1", -F.col("sim")).withColumn("d2", F.lead("d1").over(order)).where("rank = 1")
    return both.where(F.col("d1") < ratio * F.col("d2")).select("query_id", "ref_id", "d1", "d2")


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 transform given row by row as ``array<double>``."""
    at = lambda i: F.get(h, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return (at(0) * x + at(1) * y + at(2)) / w, (at(3) * x + at(4) * y + at(5)) / w


def decompose_homography(h: Column) -> dict[str, Column]:
    """Scales, rotation in degrees, shift and perspective."""
    at = lambda i: F.get(h, F.lit(i))
    return {
        "sx": F.sqrt(at(0) * at(0) + at(3) * at(3)),
        "sy": F.sqrt(at(1) * at(1) + at(4) * at(4)),
        "theta": F.degrees(F.atan2(at(3), at(0))),
        "dx": at(2),
        "dy": at(5),
        "persp": F.sqrt(at(6) * at(6) + at(7) * at(7)),
    }


def solve(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares homography of point pairs, scaled to ``h[8] = 1``; None if they don't fix one."""
    mean = np.concatenate([src, dst]).mean(axis=0)
    size = max(np.abs(np.concatenate([src, dst]) - mean).max(), 1e-9)
    p, q = (src - mean) / size, (dst - mean) / size
    x, y, u, v = p[:, 0], p[:, 1], q[:, 0], q[:, 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    # four pairs are eight rows, whose null vector only the full form has; of more rows its left side would be square
    h = np.linalg.svd(rows, full_matrices=len(rows) < 9)[2][-1].reshape(3, 3)
    unit = np.array([[1 / size, 0, -mean[0] / size], [0, 1 / size, -mean[1] / size], [0, 0, 1]])
    h = np.linalg.inv(unit) @ h @ unit
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and np.isfinite(h).all() else None


def _apart(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.hstack([src, np.ones((len(src), 1))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.hypot(*(p[:, :2] / p[:, 2:] - dst).T)
    return np.where(np.isfinite(d), d, np.inf)


_PAIR = "group_id long, qx double, qy double, cx double, cy double"


def _matched(asked: pd.DataFrame, held: pd.DataFrame, ratio: float) -> pd.DataFrame:
    if not len(asked) or len(held) < 2:
        return pd.DataFrame([], columns=["group_id", "qx", "qy", "cx", "cy"])
    x, out = np.stack(held["desc"].to_numpy()).astype(np.float64), []
    square = np.einsum("ij,ij->i", x, x)
    for at in range(0, len(asked), 512):
        part = asked.iloc[at : at + 512]
        q = np.stack(part["desc"].to_numpy()).astype(np.float64)
        near = np.argsort(square - 2 * q @ x.T, axis=1, kind="stable")[:, :2]
        d1, d2 = (np.sqrt(((q - x[near[:, i]]) ** 2).sum(axis=1)) for i in (0, 1))
        good = d1 < ratio * d2
        found = held.iloc[near[good, 0]]
        out.append(pd.DataFrame({"group_id": part["group_id"].to_numpy()[good], "qx": part["x"].to_numpy()[good], "qy": part["y"].to_numpy()[good], "cx": found["x"].to_numpy(), "cy": found["y"].to_numpy()}))
    return pd.concat(out)


def matched_keypoints(queries: DataFrame, crops: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(group_id, qx, qy, cx, cy)``: keypoints of each query matched with those of its own crop by the ratio rule.

    Both sides are ``(group_id, x, y, desc)``. The keypoints of one query and its crop are one task's work, as a crop is
    a few tiles; banks of any size go through :func:`ratio_matches`.
    """
    one = lambda df: df.select("group_id", "x", "y", "desc").groupBy("group_id")
    return one(queries).cogroup(one(crops)).applyInPandas(partial(_matched, ratio=ratio), _PAIR)


def refine(queries: DataFrame, crops: DataFrame, found: DataFrame, make, least: int = 10, trials: int = 500) -> DataFrame:
    """``(group_id, x, y, refined)`` from images: keypoints, matches, transforms and the place they give.

    ``queries`` and ``crops`` are ``(group_id, image)``, ``found`` as in :func:`localized`; ``make`` builds the extractor,
    see :func:`gridseek.functions.keypoints.extract`.
    """
    pairs = matched_keypoints(extract(queries, make), extract(crops, make))
    return localized(ransac(pairs, least=least, trials=trials), found)


_FIT = "group_id long, success boolean, h array<double>, inliers long, matches long"


def _fit_group(rows: pd.DataFrame, least: int, threshold: float, trials: int, seed: int) -> pd.DataFrame:
    rows = rows.sort_values(["qx", "qy", "cx", "cy"])
    src, dst = rows[["qx", "qy"]].to_numpy(np.float64), rows[["cx", "cy"]].to_numpy(np.float64)
    best, held = None, np.zeros(len(rows), dtype=bool)
    draw = np.random.default_rng(seed)
    for _ in range(trials if len(rows) >= LEAST_MATCHES else 0):
        some = draw.choice(len(rows), LEAST_MATCHES, replace=False)
        h = solve(src[some], dst[some])
        inside = _apart(h, src, dst) <= threshold if h is not None else held
        if h is not None and inside.sum() > held.sum():
            best, held = h, inside
            if held.all():
                break
    if best is not None and held.sum() >= LEAST_MATCHES and (better := solve(src[held], dst[held])) is not None:
        if (inside := _apart(better, src, dst) <= threshold).sum() >= held.sum():
            best, held = better, inside
    count = int(held.sum())
    return pd.DataFrame({"group_id": [rows["group_id"].iloc[0]], "success": [best is not None and count >= least], "h": [None if best is None else best.ravel().tolist()], "inliers": [count], "matches": [len(rows)]})


def ransac(matches: DataFrame, least: int = 10, threshold: float = THRESHOLD, trials: int = 500, seed: int = 0) -> DataFrame:
    """``(group_id, success, h, inliers, matches)`` of point pairs ``(group_id, qx, qy, cx, cy)``, one group a query.

    Fewer than four matches give no transform; a transform with fewer than ``least`` inliers is told but
    counts as a failure. Deterministic by ``seed``.
    """
    fit = partial(_fit_group, least=least, threshold=threshold, trials=trials, seed=seed)
    return matches.select("group_id", "qx", "qy", "cx", "cy").groupBy("group_id").applyInPandas(fit, _FIT)


def localized(fits: DataFrame, found: DataFrame) -> DataFrame:
    """``(group_id, x, y, refined)``: the origin under the transform if it succeeded, else the retrieved place.

    ``found`` is ``(group_id, x, y, crop_x, crop_y)``.
    """
    both = found.join(fits, "group_id", "left")
    hx, hy = apply_homography(F.col("h"), F.lit(0.0), F.lit(0.0))
    ok = F.coalesce("success", F.lit(False))
    return both.select(
        "group_id",
        F.when(ok, (F.col("crop_x") + hx).cast("int")).otherwise(F.col("x")).alias("x"),
        F.when(ok, (F.col("crop_y") + hy).cast("int")).otherwise(F.col("y")).alias("y"),
        ok.alias("refined"),
    )
