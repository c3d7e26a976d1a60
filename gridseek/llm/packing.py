"""Conflict-constrained best-fit packing (operator 4).

Documents go into bins of ``capacity`` words. Two documents of one source, or of one duplicate cluster,
never share a bin. Bins are ordered by what is left in them; the search starts at the least residual that
holds the piece and goes on to the next until a bin without a conflict is found, else a new bin opens.
A document longer than a bin is cut: whole pieces fill bins of their own, the rest is packed like others.

Documents are dealt into shards of about ``SHARD`` rows by a hash, each packed in one task from lengths
and labels alone. In a shard every bin carries a bitmap of its sources and clusters. Labels of many
documents are hot: for each of them a bitmap of residuals tells where a bin without it exists, so that a
source with a third of all rows doesn't make the search long.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.llm import simhash
from gridseek.plans.durable import materialize

CAPACITY, SHARD = 2048, 20_000
_NO_LABEL = 0


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, hot: int):
        self.capacity, self.hot = capacity, hot
        self.left: list[int] = []
        self.labels: list[int] = []
        self.by_residual: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]
        self.some = 0  # residuals that some bin has
        self.free = [0] * hot  # for each hot label, residuals that some bin without it has
        self.without = [[0] * (capacity + 1) for _ in range(hot)]

    def _list(self, number: int, change: int) -> None:
        residual, held = self.left[number], self.labels[number] & ((1 << self.hot) - 1)
        groups, bit = self.by_residual[residual], 1 << residual
        if change > 0:
            groups.setdefault(held, {})[number] = None
        else:
            del groups[held][number]
            if not groups[held]:
                del groups[held]
        self.some = self.some | bit if groups else self.some & ~bit
        for k in range(self.hot):
            if not held >> k & 1:
                self.without[k][residual] += change
                self.free[k] = self.free[k] | bit if self.without[k][residual] else self.free[k] & ~bit

    def place(self, need: int, labels: int) -> int:
        """The tightest bin that can take ``need`` words and has none of ``labels``, or a new one."""
        held, where = labels & ((1 << self.hot) - 1), self.some
        for k in range(self.hot):
            if held >> k & 1:
                where &= self.free[k]
        where >>= need
        residual = need
        while where:
            step = (where & -where).bit_length() - 1  # the successor
            residual += step
            for group, bins in self.by_residual[residual].items():
                if not group & held:
                    for number in bins:
                        if not self.labels[number] & labels:
                            self._list(number, -1)
                            return self._fill(number, need, labels)
            where >>= step + 1
            residual += 1
        self.left.append(self.capacity)
        self.labels.append(0)
        return self._fill(len(self.left) - 1, need, labels)

    def _fill(self, number: int, need: int, labels: int) -> int:
        self.left[number] -= need
        self.labels[number] |= labels
        if self.left[number]:
            self._list(number, 1)
        return number


def best_fit(rows: list[tuple], capacity: int) -> list[tuple]:
    """Pieces ``(row, piece, start, size, bin, offset)`` of ``(size, source, cluster)`` rows, the longest rest first."""
    seen = Counter(("s", s) for _, s, _ in rows if s is not None)
    seen.update(("c", c) for _, _, c in rows if c is not None)
    shared = [label for label, n in seen.most_common() if n > 1]
    number = {label: i for i, label in enumerate(shared)}
    limit = max(16, int(len(rows) ** 0.5))
    bins = Bins(capacity, min(sum(seen[x] > limit for x in shared), limit))
    out, rest = [], []
    for i, (size, source, cluster) in enumerate(rows):
        labels = 0
        for label in (("s", source), ("c", cluster)):
            if label in number:
                labels |= 1 << number[label]
        whole = size // capacity if size > capacity else 0
        out += [(i, k, k * capacity, capacity, bins.place(capacity, labels), 0) for k in range(whole)]
        if size - whole * capacity or not size:
            rest.append((size - whole * capacity, i, whole, labels))
    for size, i, piece, labels in sorted(rest, key=lambda x: (-x[0], x[1])):
        at = bins.place(size, labels)
        out.append((i, piece, piece * capacity, size, at, capacity - bins.left[at] - size))
    return out


_PIECES = "id long, piece long, start_word long, n_words long, bin_id long, bin_offset long"


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["id", "n", "cluster"], na_position="first", kind="stable").reset_index(drop=True)
    given = [(int(n), None if pd.isna(s) else s, None if pd.isna(c) else c) for n, s, c in zip(rows["n"], rows["source"], rows["cluster"])]
    first = int(rows["shard"].iloc[0]) << 32
    pieces = best_fit(given, capacity)
    ids = rows["id"].astype("Int64")
    made = pd.DataFrame(pieces, columns=["row", "piece", "start_word", "n_words", "bin_id", "bin_offset"])
    made["bin_id"] += first
    made.insert(0, "id", ids.iloc[made["row"]].reset_index(drop=True))
    return made.drop(columns="row")


def text_cluster(text: str = "text") -> Column:
    """Texts that differ in case and white space only are of one cluster; wordless texts of none."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def near_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, n, source, cluster)`` of every row: near-duplicates, as operator 7 links them, are of one cluster; wordless texts of none."""
    rows = docs.select(F.col(id_col).alias("id"), word_count(text_col).alias("n"), F.col(source_col).alias("source"), simhash.fingerprint(F.col(text_col)).alias("fp"))
    rows = materialize(rows)
    named = rows.join(simhash.fingerprint_roots(rows), F.col("fp") == F.col("node"), "left")
    return named.select("id", "n", "source", F.when(F.col("n") > 0, F.coalesce("component", "fp")).alias("cluster"))


def pack_rows(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces of rows ``(id, n, source, cluster)``, see :func:`pack_documents`."""
    rows = rows.select(F.col("id").cast("long"), "n", F.col("source").cast("string"), F.col("cluster").cast("long"))
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", F.lit(4)), F.lit(shards)).cast("int"))
    # pandas would turn long integers with gaps into doubles: clusters go as text
    rows = rows.withColumn("cluster", F.col("cluster").cast("string"))
    return rows.groupBy("shard").applyInPandas(partial(_pack, capacity=capacity), _PIECES)


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cluster: Column | None = None, shard: int = SHARD,
) -> DataFrame:
    """``(id, piece, start_word, n_words, bin_id, bin_offset)``: one row for each piece of every row of ``docs``.

    ``cluster`` is a column of long integers; without one equal texts are a cluster. Null and empty texts
    make a piece of no words. A null source conflicts with nothing. Rows that repeat are of one cluster and
    so in different bins; if both their texts are wordless they may share one. Null ids are packed too. An
    empty table gives no rows; other columns are ignored.
    """
    label = text_cluster(text_col) if cluster is None else cluster
    rows = docs.select(F.col(id_col).alias("id"), word_count(text_col).alias("n"), F.col(source_col).alias("source"), label.alias("cluster"))
    return pack_rows(rows, capacity, shard).withColumnRenamed("id", id_col)
