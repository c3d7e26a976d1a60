"""Stage tables that are built once: a stage's name and the fingerprint of its inputs say where it is kept.

A stage that was written whole is read again, by the same session or by a later one; what a failed run left unfinished is
built anew, so that a run that failed goes on behind its last whole stage.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A number of some columns' rows that doesn't depend on their order, by one aggregate row.

    For tables whose other columns are large, such as pixels, name the columns that tell rows apart, and give
    :meth:`Stages.get` a version of the contents besides.
    """
    names = columns or tuple(df.columns)
    row = F.xxhash64(*names), F.xxhash64(F.lit(7), *names)
    told = df.agg(F.count(F.lit(1)), *[f(r) for r in row for f in (lambda h: F.bit_xor(h), lambda h: F.sum(h.cast("decimal(20,0)")))]).first()
    return "-".join(str(v) for v in told)


class Stages:
    """Stage tables below one folder, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.built = spark, folder.rstrip("/"), []

    def path(self, name: str, key: dict) -> str:
        mark = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return f"{self.folder}/{name}-{mark}"

    def get(self, name: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, built and written if there is no whole one; ``built`` names those that were."""
        path = self.path(name, key)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            build().write.mode("overwrite").parquet(path)
            self.built.append(name)
        return self.spark.read.parquet(path)
