"""Resolution levels: tables, choice and interpolation (SRC5-SRC7, F8-F12, J11, J12, A8, A9, A24, X20).

``keys`` are columns that both sides have, such as a slide's id: a row meets the levels of its slide. Without keys
the levels are those of one slide. The levels of a slide are a few rows, which travel as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of resolution properties, in the order in which they are tried. Fixed values.
MPP_X, MPP_Y = "openslide.mpp-x", "openslide.mpp-y"
VENDOR_SINGLE = "aperio.MPP"
VENDOR_X, VENDOR_Y = "hamamatsu.XResolution", "hamamatsu.YResolution"
TIFF_X, TIFF_Y, TIFF_UNIT = "tiff.XResolution", "tiff.YResolution", "tiff.ResolutionUnit"


def _meeting(asked: DataFrame, held: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``asked`` and the one row of ``held`` for its keys; without keys ``held`` has one row in all."""
    return asked.join(held, list(keys), "left") if keys else asked.join(F.broadcast(held), F.lit(True))


def level_table(levels: DataFrame) -> DataFrame:
    """Adds ``mpp = base_mpp * ds``; a missing base gives 0."""
    return levels.withColumn("mpp", F.coalesce(F.col("base_mpp"), F.lit(0.0)) * F.col("ds"))


def _given(props: Column, name: str) -> Column:
    value = F.get(F.filter(F.map_entries(props), lambda e: e["key"] == name), 0)["value"]
    return F.when(value != "", value)


def mpp_of(props: Column) -> Column:
    """``struct<x, y>``: microns a pixel of a property map by the first rule that applies, else zeros.

    Both standard values; a vendor's single value; a vendor's pair; standard x with y or x; TIFF
    resolution by its unit. Empty values count as missing.
    """
    v = {n: _given(props, n) for n in (MPP_X, MPP_Y, VENDOR_SINGLE, VENDOR_X, VENDOR_Y, TIFF_X, TIFF_Y, TIFF_UNIT)}
    d = {n: x.cast("double") for n, x in v.items()}
    unit = F.when(v[TIFF_UNIT] == "2", 25400.0).otherwise(10000.0)
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return (
        F.when(v[MPP_X].isNotNull() & v[MPP_Y].isNotNull(), pair(d[MPP_X], d[MPP_Y]))
        .when(v[VENDOR_SINGLE].isNotNull(), pair(d[VENDOR_SINGLE], d[VENDOR_SINGLE]))
        .when(v[VENDOR_X].isNotNull() & v[VENDOR_Y].isNotNull(), pair(d[VENDOR_X], d[VENDOR_Y]))
        .when(v[MPP_X].isNotNull(), pair(d[MPP_X], F.coalesce(d[MPP_Y], d[MPP_X])))
        .when(v[TIFF_X].isNotNull() & v[TIFF_Y].isNotNull(), pair(unit / d[TIFF_X], unit / d[TIFF_Y]))
        .otherwise(pair(F.lit(0.0), F.lit(0.0)))
    )


def matching_level(asked: DataFrame, levels: DataFrame, tol: float = 1e-3, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and the first ``level`` whose downsample is within ``tol`` of ``want_ds``, or null."""
    found = matching_levels(asked, levels, tol, keys)
    return found.withColumn("level", F.get("__all", F.lit(0))).drop("__all")


def wrong_levels(asked: DataFrame, levels: DataFrame, tol: float = 1e-3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose own ``level`` isn't that of ``want_ds`` though another level is (F10); none matching is accepted."""
    found = matching_levels(asked, levels, tol, keys)
    return found.where((F.size("__all") > 0) & ~F.array_contains("__all", F.col("level"))).drop("__all")


def matching_levels(asked: DataFrame, levels: DataFrame, tol: float = 1e-3, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and ``__all``: every level whose downsample is within ``tol`` of ``want_ds``."""
    held = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "ds"))).alias("__levels"))
    near = lambda x: F.abs(x["ds"] - F.col("want_ds")) / F.greatest(F.col("want_ds"), F.lit(1e-9)) < tol
    every = F.transform(F.filter("__levels", near), lambda x: x["level"])
    return _meeting(asked, held, keys).withColumn("__all", every).drop("__levels")


def best_level(asked: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and the level of largest downsample up to ``want_ds``, else level 0."""
    held = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ds", "level"))).alias("__levels"))
    fit = F.filter("__levels", lambda x: x["ds"] <= F.col("want_ds"))
    return _meeting(asked, held, keys).withColumn("level", F.coalesce(F.try_element_at(fit, F.lit(-1))["level"], F.lit(0))).drop("__levels")


def query_level(asked: DataFrame, levels: DataFrame, share: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and the level to read a query of ``want_mpp`` from.

    Levels are tried in order: one within ``share`` is taken; the first coarser one gives the level
    before it (null for level 0); else null.
    """
    held = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "mpp"))).alias("__levels"))
    near = lambda x: F.abs(x["mpp"] - F.col("want_mpp")) <= share * F.col("want_mpp")
    hit = F.get(F.filter("__levels", lambda x: near(x) | (x["mpp"] > F.col("want_mpp"))), 0)
    level = F.when(near(hit), hit["level"]).when(hit["level"] > 0, hit["level"] - 1)
    return _meeting(asked, held, keys).withColumn("level", level).drop("__levels")


def interpolate(asked: DataFrame, levels: DataFrame, stat: str = "stat", want: str = "want", keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and ``mpp`` log-interpolated between the levels whose ``stat`` bracket ``want``.

    Outside the range the end level counts; the first bracket wins. Levels without a statistic don't count.
    """
    step = F.struct(F.col(stat).cast("double").alias("s"), F.col("mpp").cast("double").alias("m"))
    held = levels.where(F.col(stat).isNotNull() & ~F.isnan(stat)).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("__all"))
    pair = lambda a, b: F.struct(a["s"].alias("s0"), a["m"].alias("m0"), b["s"].alias("s1"), b["m"].alias("m1"))
    held = held.select(*keys, F.zip_with("__all", F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(0))), pair).alias("__steps"))
    w = F.col(want)
    hit = F.get(F.filter("__steps", lambda x: (x["s0"] <= w) & (w <= x["s1"])), 0)
    first, last = F.get("__steps", F.lit(0)), F.try_element_at("__steps", F.lit(-1))
    part = F.when(hit["s1"] == hit["s0"], 0.0).otherwise((w - hit["s0"]) / (hit["s1"] - hit["s0"]))
    inside = F.exp(F.log(hit["m0"]) + part * (F.log(hit["m1"]) - F.log(hit["m0"])))
    mpp = F.when(w <= first["s0"], first["m0"]).when(w >= last["s0"], last["m0"]).otherwise(inside)
    return _meeting(asked, held, keys).withColumn("mpp", mpp).drop("__steps")


def nearest_level(asked: DataFrame, levels: DataFrame, stat: str = "stat", want: str = "want", keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and the ``level`` whose ``stat`` is nearest; ties to the lower level."""
    held = levels.groupBy(*keys).agg(F.collect_list(F.struct(F.col(stat).alias("s"), "level")).alias("__levels"))
    best = F.array_min(F.transform("__levels", lambda x: F.struct(F.abs(x["s"] - F.col(want)).alias("d"), x["level"].alias("level"))))
    return _meeting(asked, held, keys).withColumn("level", best["level"]).drop("__levels")


def standardized(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns less their mean, over their population deviation and 1e-9."""
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = _meeting(df, stats, keys)
    out = out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-9) for c in columns})
    return out.drop(*[c for c in stats.columns if c not in keys])


def weighted_log_mean(neighbours: DataFrame, keys: list[str], dist: str = "dist", value: str = "mpp") -> DataFrame:
    """Mean of ``value`` in logarithms, weighted by inverse distance; an exact hit counts alone."""
    w = 1 / (F.col(dist) + 1e-9)
    exact = F.min_by(value, F.struct(dist, value))
    mean = F.exp(F.sum(w * F.log(value)) / F.sum(w))
    return neighbours.groupBy(*keys).agg(F.when(F.min(dist) < 1e-9, exact).otherwise(mean).alias("estimate"))


def level_spread(stats: DataFrame, keys: list[str]) -> DataFrame:
    """``(level, stat, mpp)`` of each key as one sorted list."""
    return stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "stat", "mpp"))).alias("spread"))
