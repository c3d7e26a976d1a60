"""Approximate nearest neighbours by collision-counting hashing (operator 3).

The largest inner product is turned into the smallest distance by one more component, which lifts every
vector to the largest norm. A block of vectors keeps one sorted array for each of ``PROJECTIONS`` directions
(random rotations, so that directions of one rotation don't repeat each other) and every vector's place in
it, in 256ths. Around a query's own projections windows open; virtual rehashing widens them step by step,
and a vector that falls into the windows of at least ``THRESHOLD`` of the projections is a candidate, whose
inner product is computed exactly. Widening ends once a block has ``TIMES`` times ``k`` and ``SHARE`` of its
vectors as candidates; the candidates of the last window are all verified, however many they are.

Equal vectors are one class with its least ids, so that a vector held by a third of all rows is indexed and
searched once. Classes lie in blocks of ``BLOCK_ROWS``. Each block is built once, in one task, and the queries
stream through it: only queries are copied to the blocks, and a block returns its best ``k`` for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.plans.durable import broadcast_if_small, materialize

PROJECTIONS, SEED = 128, 17
#: Share of the projections that have to collide, first half-width of the windows in usual distances, and the
#: candidates that end the widening: so many times ``k`` and this share of a block.
THRESHOLD, FIRST, TIMES, SHARE = 0.76, 0.93, 8, 0.015
BLOCK_ROWS = 16_384
#: Queries that meet a block at once, and queries of one vector that are answered in one group.
CHUNK, SPLIT_ROWS = 256, 10_000
#: Sorted arrays whose windows are counted at once.
TOGETHER = 32


def directions(dim: int) -> np.ndarray:
    """``PROJECTIONS`` unit vectors as columns, in random rotations one after another."""
    draw = np.random.default_rng(SEED)
    turns = [np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.hstack(turns)[:, :PROJECTIONS]


class Block:
    """Sorted projections of some vectors and the collision counts of queries."""

    def __init__(self, data: np.ndarray, norm: float):
        self.data, self.norm, self.n = data, norm, len(data)
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", data, data), 0.0))
        self.lines = directions(data.shape[1] + 1)
        spread = np.ascontiguousarray((np.hstack([data, rest[:, None]]) @ self.lines).T)
        order = np.argsort(spread, axis=1, kind="stable")
        self.sorted = np.take_along_axis(spread, order, axis=1)
        self.step = -(-self.n // 256)
        self.code = np.empty((PROJECTIONS, self.n), dtype=np.uint8)  # of each vector in each sorted array
        np.put_along_axis(self.code, order, (np.arange(self.n) // self.step).astype(np.uint8)[None, :], axis=1)

    def _count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many windows, in codes from ``low`` to ``high``, hold each vector; some arrays at a time."""
        count, first, wide = np.zeros(self.n, dtype=np.uint8), low.astype(np.uint8)[:, None], (high - low).astype(np.uint8)[:, None]
        for k in range(0, PROJECTIONS, TOGETHER):
            part = slice(k, k + TOGETHER)
            inside = (self.code[part] - first[part]) <= wide[part]  # wraps below the window
            count += inside.view(np.uint8).sum(axis=0, dtype=np.uint8)
        return count

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the positions of the vectors that collide often enough."""
        need, enough = int(np.ceil(THRESHOLD * PROJECTIONS)), min(self.n, TIMES * k + int(SHARE * self.n))
        centre = queries @ self.lines[:-1]
        # a component of the difference of two vectors that are far apart is usually this long
        width = FIRST * np.sqrt((self.norm**2 + np.einsum("ij,ij->i", queries, queries)) / len(self.lines))
        found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queries)
        live = np.arange(len(queries))
        while len(live):
            c, w = centre[live].T, width[live]
            low = np.stack([np.searchsorted(s, x - w) for s, x in zip(self.sorted, c)], axis=1)
            high = np.stack([np.searchsorted(s, x + w, side="right") for s, x in zip(self.sorted, c)], axis=1) - 1
            low = np.minimum(low, self.n - 1)
            high = np.maximum(high, low)
            missing = np.zeros(len(live), dtype=np.int64)
            for i, (q, first, last) in enumerate(zip(live, low // self.step, high // self.step)):
                count = self._count(first, last)
                held = np.bincount(count, minlength=PROJECTIONS + 1)[::-1].cumsum()[::-1]  # vectors of so many collisions or more
                if held[need] < enough:  # collisions that the last one of the missing candidates lacks
                    missing[i] = need - np.flatnonzero(held >= enough)[-1]
                else:
                    found[q] = np.flatnonzero(count >= need)
            # a window wider by one part in a hundred gets about half a collision in a hundred projections more
            width[live] *= np.exp(np.maximum(missing, 1) / (0.5 * PROJECTIONS))
            live = live[missing > 0]
        return found

    def nearest(self, queries: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and products of its best ``k``, ties to smaller ``ids``."""
        for query, found in zip(queries, self.candidates(queries, k)):
            score = (self.data[found] * query).sum(axis=1)
            best = np.lexsort((ids[found], -score))[:k]
            yield found[best], score[best]


_BEST = "q1 long, q2 long, k1 long, k2 long, first long, score double"
_COLUMNS = ["q1", "q2", "k1", "k2", "first", "score"]


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.pad(np.asarray(v, dtype=np.float64), (0, dim - len(v))) for v in vectors])


def _answers(block: Block, keys: pd.DataFrame, asked: pd.DataFrame, k: int, dim: int) -> pd.DataFrame:
    ids, out = keys["first"].to_numpy(), []
    for (q1, q2), (at, score) in zip(asked[["k1", "k2"]].to_numpy(), block.nearest(_matrix(asked["vec"], dim), ids, k)):
        out.append(pd.DataFrame({"q1": q1, "q2": q2, "k1": keys["k1"].to_numpy()[at], "k2": keys["k2"].to_numpy()[at], "first": ids[at], "score": score}))
    return pd.concat(out)[_COLUMNS]


def _stream(batches: Iterator[pd.DataFrame], k: int, norm: float, dim: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, a block's vectors before the queries: build the block once, then answer batch by batch."""
    held: list[pd.DataFrame] = []
    part, block, keys = None, None, None
    for batch in batches:
        for now, rows in batch.groupby("part", sort=True):
            if now != part:
                part, block, held = now, None, []
            held.append(rows[~rows["asks"]])
            asked = rows[rows["asks"]]
            if len(asked) and block is None:
                keys = pd.concat(held).sort_values(["k1", "k2"])
                held = []
                if not len(keys):
                    continue
                block = Block(_matrix(keys["vec"], dim), norm)
            for at in range(0, len(asked), CHUNK):
                yield _answers(block, keys, asked.iloc[at : at + CHUNK], k, dim)


def usable(vec: str):
    """Vectors that take part: not null, not zero, all components finite."""
    ok = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ok & F.exists(F.col(vec), lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` vectors of largest inner product found for each query row.

    ``is_query`` is a condition on the id. A query's own row is no candidate, its equals are. Ties go to
    the smaller id. Null, zero and non-finite vectors and null ids take no part; shorter vectors count as
    padded by zeros; repeated rows of one id count once for each; fewer candidates give fewer rows; an
    empty table gives none; other columns are ignored.
    """
    # adding a zero turns -0.0 into 0.0, so that equal vectors have equal keys
    plain = F.transform(F.col(vec_col), lambda x: x + F.lit(0.0).cast("float"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), plain.alias("vec")).where(usable("vec") & F.col("id").isNotNull())
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64("vec", F.lit(2))})  # a class's name, by row alone
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = materialize(few.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.array_sort(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec")))
    asking = rows.where(is_query(F.col("id"))).select("id", "k1", "k2")
    asked = materialize(asking.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")))

    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, norm, dim = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(square)), F.max(F.size("vec"))).first()
    parts = max(1, -(-n // block_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    data = classes.select("k1", "k2", "first", "vec", F.lit(False).alias("asks"), F.pmod("k1", F.lit(parts)).cast("int").alias("part"))
    queries = classes.join(asked, ["k1", "k2"]).select("k1", "k2", "first", "vec", F.lit(True).alias("asks"), every.alias("part"))
    dealt = data.union(queries).repartitionById(parts, "part").sortWithinPartitions("part", "asks")
    best = dealt.mapInPandas(partial(_stream, k=k + 1, norm=norm or 1.0, dim=dim or 0), _BEST)

    top = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first")
    best = best.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1)
    members = best.join(classes.select("k1", "k2", "ids"), ["k1", "k2"]).select("q1", "q2", "score", F.explode("ids").alias("near"))
    top = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "near")
    members = members.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).select("q1", "q2", "score", "near")

    # a vector that very many query rows have is answered in several groups
    hot = materialize(asked.where(F.col("n") > SPLIT_ROWS).select("k1", "k2", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("salts")))
    hot = broadcast_if_small(hot)
    salts = F.coalesce("salts", F.lit(1))
    asking = asking.join(hot, ["k1", "k2"], "left").select("id", "k1", "k2", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    members = members.withColumnsRenamed({"q1": "k1", "q2": "k2"}).join(hot, ["k1", "k2"], "left")
    members = members.select("k1", "k2", "score", "near", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    pairs = asking.withColumnRenamed("id", "query_id").join(members, ["k1", "k2", "salt"]).where("near <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", F.col("near").alias(id_col), "score")
