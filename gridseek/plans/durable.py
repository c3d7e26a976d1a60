"""Durable intermediate results and broadcasts behind a size check.

Iterative operators cut their lineage by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it again after another one was lost.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the callers' rows are a few machine words each.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Where none is set a session on one machine gets a new folder of its own; on a cluster that is an
    error, as executors would not see each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read back.

    The table stays until :func:`discard` or :func:`release`.
    """
    path = f"{_session_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no result reads any more."""
    _delete(table.sparkSession, table._durable_path)


def release(spark: SparkSession) -> None:
    """Delete all tables of this session, once the results that read them are written."""
    _delete(spark, _session_dir(spark))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, held: int | None = None) -> DataFrame:
    """``broadcast(df)`` if a written table has at most ``rows`` rows, else ``df`` for a shuffle join.

    ``df`` should come from :func:`materialize`, so that counting it reads Parquet footers only. Where rows
    hold lists, ``held`` gives the number of their elements, which counts instead.
    """
    return F.broadcast(df) if (df.count() if held is None else held) <= rows else df


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` as internal columns that none of ``columns`` equals in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
