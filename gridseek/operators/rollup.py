"""Benchmark analytics: best rows, speed-ups, pivots, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_config(runs: DataFrame, keys: list[str], config: str, metric: str, digits: int = 6) -> DataFrame:
    """The config of largest mean metric of every key; of equal means the least config."""
    means = runs.groupBy(*keys, config).agg(F.round(F.avg(metric), digits).alias("mean"))
    order = F.struct(F.col("mean"), (-F.col(config)).alias("first"))
    return means.groupBy(*keys).agg(F.max_by(config, order).alias("best"), F.max("mean").alias("best_mean"), F.min("mean").alias("worst_mean"))


def speedups(runs: DataFrame, baseline: Column, key: str, config: str, metric: str, digits: int = 6) -> DataFrame:
    """``(config, key, metric, ratio)``: metric over the baseline's at the same key, null where that is missing."""
    base = runs.where(baseline).groupBy(F.col(key).alias("__key")).agg(F.max(metric).alias("__base"))
    joined = runs.join(base, F.col(key) == F.col("__key"), "left")
    return joined.select(config, key, F.round(metric, digits).alias("value"), F.round(F.col(metric) / F.col("__base"), digits).alias("ratio"))


def speedup_matrix(ratios: DataFrame, key: str, config: str, keys: list) -> DataFrame:
    """One row for each config and one column for each of the given keys."""
    return ratios.groupBy(config).pivot(key, keys).agg(F.max("ratio"))


def bottleneck(ratio: Column) -> Column:
    """Which part of a run limits it, by the share of the first."""
    return F.when(ratio > 0.8, "first").when(ratio < 0.3, "second").otherwise("balanced")


def verdict(parts: dict[str, Column]) -> Column:
    """The name of the largest part; of equal parts the first."""
    most = F.greatest(*parts.values())
    out = None
    for name, value in parts.items():
        out = F.when(value == most, name) if out is None else out.when(value == most, name)
    return out


def missing_configs(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Configs that have no result yet, once each (S5, SRC9)."""
    return wanted.dropDuplicates([key]).join(done.select(key), key, "left_anti")
