"""Label estimates from nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.operators.vectors import top_k


def label_votes(queries: DataFrame, bank: DataFrame, k: int, skip_self: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``([keys,] query_id, label)``: the exact median label of the ``k`` most similar bank rows ``(ref_id, feat, label)``.

    With ``skip_self`` a query doesn't meet the bank row of its own id, with ``keys`` only bank rows of equal keys.
    """
    found = top_k(queries, bank, k, carry="label", skip_self=skip_self, keys=keys)
    return found.groupBy(*keys, "query_id").agg(F.median("label").alias("label"))


def label_estimate(queries: DataFrame, bank: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """One row ``(estimate, n_queries)``: the median of the queries' labels; null without queries."""
    return label_votes(queries, bank, k, skip_self).agg(F.median("label").alias("estimate"), F.count(F.lit(1)).alias("n_queries"))


def vote_distribution(votes: DataFrame) -> DataFrame:
    return votes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
