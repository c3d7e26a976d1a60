"""Vector functions and exact top-k similarity joins."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.operators import blocks
from gridseek.plans.durable import broadcast_if_small, discard, materialize, unused

QUERY_ROWS, BANK_ROWS, PAIR_ROWS = 16384, 65536, 1024
#: Blocks of queries up to which they keep ``QUERY_ROWS``; of more queries blocks grow up to ``BANK_ROWS``, so that the bank is copied less often.
SIDES = 16
#: Pairs of blocks up to which each is a task.
PAIRS_IN_TURN = 4096
#: Similarities that a task has at once, 32 MB of them.
MATRIX_CELLS = 1 << 22
#: Places to which similarities are rounded before they are ranked, so that equal vectors tie.
DIGITS = 9


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str) -> Column:
    """The vector over its length; a zero vector stays."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def finite(a: Column | str) -> Column:
    """Whether all components are numbers."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def zero_non_finite(df: DataFrame, vec: str = "feat") -> DataFrame:
    """Vectors that hold a component that is no number become zero; ``was_bad`` tells which."""
    ok = F.coalesce(finite(vec), F.lit(False))
    return df.withColumn("was_bad", ~ok).withColumn(vec, F.when(ok, F.col(vec)).otherwise(F.transform(vec, lambda x: F.lit(0.0).cast("float"))))


def _rows_at_once(held: int) -> int:
    """Queries of a block that meet ``held`` bank rows together, so that their similarities take a few MB."""
    return max(1, MATRIX_CELLS // max(held, 1))


def _block_best(rows: pd.DataFrame, k: int, digits: int, skip_self: bool, metric: str, carry: bool, keys: tuple[str, ...]) -> pd.DataFrame:
    names = ["query_id", "ref_id", "sim", *["carried"] * carry]
    bank, asked, x, q = _sides(rows)
    if not len(bank) or not len(asked):
        return pd.DataFrame(columns=[*names, *keys], dtype=object)
    ids, askers = bank["id"].to_numpy(), asked["id"].to_numpy()
    carried = [bank["carried"].to_numpy()] if carry else []
    found, left = [], np.arange(len(q))
    if blocks.worth(len(ids), k):
        *some, left = blocks.Block(q, x, askers, ids, digits, metric).best(k, skip_self)
        found.append(some)
    if len(left):
        row, col, score = _best_of_all(q[left], x, askers[left], ids, k, digits, skip_self, metric)
        found.append((left[row], col, score))
    row, col, score = (np.concatenate(v) for v in zip(*found))
    return _keyed(pd.DataFrame(dict(zip(names, (askers[row], ids[col], score, *(c[col] for c in carried))))), rows, keys)


def _best_of_all(q: np.ndarray, x: np.ndarray, askers: np.ndarray, ids: np.ndarray, k: int, digits: int, skip_self: bool, metric: str) -> tuple[np.ndarray, ...]:
    """:meth:`~gridseek.operators.blocks.Block.best` with all similarities in double precision."""
    out = []
    most, square = min(k, len(ids)), np.einsum("ij,ij->i", x, x)
    step = _rows_at_once(len(ids))
    for at in range(0, len(q), step):
        part, own = q[at : at + step], askers[at : at + step]
        sims = part @ x.T
        if metric == "l2":
            sims -= square / 2  # the nearer the larger
        else:
            np.round(sims, digits, out=sims)
        if skip_self:
            sims[ids[None, :] == own[:, None]] = -np.inf
        edge = np.partition(sims, len(ids) - most, axis=1)[:, len(ids) - most]
        # ties at the edge too, and of distances what rounding may have put behind it
        row, col = np.nonzero((sims >= edge[:, None] - (1e-9 * (1 + np.abs(edge[:, None])) if metric == "l2" else 0)) & np.isfinite(sims))
        score = np.round(blocks.similarities(part, x, row, col, metric), digits) if metric == "l2" else sims[row, col]
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((at + row[keep], col[keep], score[keep]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _keyed(out: pd.DataFrame, rows: pd.DataFrame, keys: tuple[str, ...]) -> pd.DataFrame:
    """``out`` with the keys of the group that ``rows`` are."""
    return out.assign(**{c: pd.Series([rows[held].iloc[0]] * len(out), index=out.index, dtype=object) for c, held in zip(keys, _inner(keys))})


def _inner(keys: tuple[str, ...]) -> list[str]:
    """Names of the keys inside blocks."""
    return [f"key{i}" for i in range(len(keys))]


def _key_schema(df: DataFrame, keys: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def _taking_part(df: DataFrame, vec: str, id_col: str) -> DataFrame:
    """Rows with an id and a vector of numbers."""
    return df.where(F.col(id_col).isNotNull() & F.coalesce(finite(vec), F.lit(False)))


def _numbered(queries: DataFrame, bank: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, Column, Column, Column, int]:
    """Both sides, the numbers of blocks that they are cut into, for each key by its own rows, the first pair of blocks of a key, and the number of all."""
    if not keys:
        n_asked, n_held = (r[0] for r in queries.agg(F.count(F.lit(1))).union(bank.agg(F.count(F.lit(1)))).collect())
        sides, parts = max(1, min(-(-n_asked // QUERY_ROWS), SIDES), -(-n_asked // BANK_ROWS)), max(1, -(-n_held // BANK_ROWS))
        return queries, bank, F.lit(sides), F.lit(parts), F.lit(0), min(sides * parts, PAIRS_IN_TURN)
    sides, parts, first = unused([*queries.columns, *bank.columns], "sides", "parts", "first")
    n = F.count(F.lit(1))
    asked = F.greatest(F.least(F.ceil(n / QUERY_ROWS), F.lit(SIDES)), F.ceil(n / BANK_ROWS)).cast("int")
    sizes = queries.groupBy(*keys).agg(asked.alias(sides)).join(bank.groupBy(*keys).agg(F.ceil(n / BANK_ROWS).cast("int").alias(parts)), list(keys))
    sizes = materialize(sizes)
    pairs = sizes.agg(F.sum(F.col(sides).cast("long") * F.col(parts))).first()[0] or 1
    # pairs of blocks of few keys follow each other, so that each is a task; many keys are spread
    upto = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    follow = F.coalesce(F.sum(F.col(sides) * F.col(parts)).over(upto), F.lit(0))
    number = follow if pairs <= PAIRS_IN_TURN else F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    sizes = broadcast_if_small(materialize(sizes.withColumn(first, number.cast("int"))))
    return queries.join(sizes, list(keys)), bank.join(sizes, list(keys)), F.col(sides), F.col(parts), F.col(first), min(pairs, PAIRS_IN_TURN)


def _dealt(queries: DataFrame, bank: DataFrame, vec: str, extra: list[str], carry: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both sides in blocks, each pair of blocks one group ``(*_inner(keys), at)``, in tasks of their own.

    ``extra`` columns are the queries', ``carry`` the bank's; ``part`` and ``side`` tell the blocks.
    """
    queries, bank, sides, parts, first, pairs = _numbered(_taking_part(queries, vec, "query_id"), _taking_part(bank, vec, "ref_id"), keys)
    named = [F.col(c).alias(held) for c, held in zip(keys, _inner(keys))]
    block = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    none = [F.lit(None).cast("double").alias("carried")] * (carry is not None)
    asked = queries.select(
        F.col("query_id").cast("long").alias("id"), F.col(vec).alias("vec"), F.lit(True).alias("asks"), *extra, *none,
        every(parts).alias("part"), block("query_id", sides).alias("side"), sides.alias("sides"), first.alias("first"), *named,
    )
    empty = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra]
    carried = [F.col(carry).cast("double").alias("carried")] if carry else []
    held = bank.select(
        F.col("ref_id").cast("long").alias("id"), F.col(vec).alias("vec"), F.lit(False).alias("asks"), *empty, *carried,
        block("ref_id", parts).alias("part"), every(sides).alias("side"), sides.alias("sides"), first.alias("first"), *named,
    )
    both = asked.union(held).withColumn("at", F.col("first") + F.col("part") * F.col("sides") + F.col("side")).drop("first", "sides")
    return both.repartitionById(pairs, "at")


def top_k(
    queries: DataFrame, bank: DataFrame, k: int, vec: str = "feat", skip_self: bool = False, digits: int = DIGITS,
    metric: str = "dot", carry: str | None = None, keys: tuple[str, ...] = (),
) -> DataFrame:
    """``(query_id, rank, ref_id, sim[, carry][, *keys])``: the exact ``k`` most similar bank vectors of each query.

    ``queries`` has ``query_id``, ``bank`` has ``ref_id``, both the vector ``vec``. ``sim`` is the inner product,
    or with ``metric="l2"`` the negative Euclidean distance. Ties go to the smaller ``ref_id``. ``carry`` names a
    number of the bank's rows that comes along. With ``keys`` queries only meet bank rows of equal keys, none of them null.

    Rows without an id and vectors that are null or hold a null, NaN or infinite component take no part on either
    side: such a query has no rows, such a bank row is nobody's neighbour (:func:`zero_non_finite` makes them zero
    vectors that do). Of vectors of different lengths the shorter counts as padded by zeros.

    Both sides are cut into blocks; each pair of blocks is one matrix product that returns ``k`` rows for a query,
    so that neither side is broadcast and no pair is shuffled.
    """
    best = partial(_block_best, k=k, digits=digits, skip_self=skip_self, metric=metric, carry=carry is not None, keys=keys)
    schema = "query_id long, ref_id long, sim double" + ", carried double" * (carry is not None) + _key_schema(bank, keys)
    found = _dealt(queries, bank, vec, [], carry, keys).groupBy(*_inner(keys), "at").applyInPandas(best, schema)
    rank = Window.partitionBy(*keys, "query_id").orderBy(F.desc("sim"), "ref_id")
    found = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "ref_id", "sim", *([F.col("carried").alias(carry)] if carry else []), *keys)


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    asks = rows["asks"].to_numpy(dtype=bool)
    bank, asked = rows[~asks], rows[asks]
    dim = rows["vec"].map(len).max() if len(rows) else 0
    return bank, asked, _matrix(bank["vec"], dim), _matrix(asked["vec"], dim)


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` components, the missing ones zero."""
    sizes = vectors.map(len).to_numpy(dtype=np.int64)
    if not len(sizes):
        return np.zeros((0, dim))
    flat = np.concatenate(vectors.to_numpy()).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _block_ahead(rows: pd.DataFrame, digits: int, keys: tuple[str, ...]) -> pd.DataFrame:
    bank, asked, x, q = _sides(rows)
    if not len(bank) or not len(asked):
        return pd.DataFrame(columns=["query_id", "ahead", *keys], dtype=object)
    ids, own = bank["id"].to_numpy(), asked["id"].to_numpy()
    target, sim = asked["target_id"].to_numpy(), asked["target_sim"].to_numpy(dtype=np.float64)
    ahead, left = np.zeros(len(own), dtype=np.int64), np.arange(len(own))
    if blocks.worth(len(ids)):
        ahead, left = blocks.Block(q, x, own, ids, digits).ahead(target, sim)
    if len(left):
        ahead[left] = _ahead_of_all(q[left], x, own[left], ids, target[left], sim[left], digits)
    return _keyed(pd.DataFrame({"query_id": own, "ahead": ahead}), rows, keys)


def _ahead_of_all(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, target: np.ndarray, sim: np.ndarray, digits: int) -> np.ndarray:
    """:meth:`~gridseek.operators.blocks.Block.ahead` with all similarities in double precision."""
    ahead, step = np.zeros(len(own), dtype=np.int64), _rows_at_once(len(ids))
    order = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        sims, edge = q[part] @ x.T, sim[part, None]
        # what is farther from the target's than rounding can move it needs no rounding
        near = 10.0**-digits + 1e-12 * np.abs(edge)
        far = sims > edge + near
        ahead[part] += far.sum(axis=1)
        row, col = np.nonzero((sims >= edge - near) & ~far)
        close, asker = np.round(sims[row, col], digits), at + row
        better = (close > sim[asker]) | ((close == sim[asker]) & (ids[col] < target[asker]))
        np.add.at(ahead, asker[better & (ids[col] != own[asker]) & (ids[col] != target[asker])], 1)
        asker = np.arange(at, at + len(sims))
        for again in range(int((last - first)[asker].max(initial=0))):  # a row that asks is nobody ahead of itself
            mine = asker[first[asker] + again < last[asker]]
            ahead[mine] -= far[mine - at, order[first[mine] + again]]
    return ahead


def places_of(queries: DataFrame, bank: DataFrame, digits: int = DIGITS, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, query_id, place)``: how many bank rows come before ``target_id`` in each query's ranking.

    ``queries`` is ``(query_id, feat, target_id, target_sim)``, with the target's similarity rounded to
    ``digits``. Blocks return one count for a query; no ranking is ever written out. Rows take part as in :func:`top_k`.
    """
    dealt = _dealt(queries, bank, "feat", ["target_id", "target_sim"], keys=keys).groupBy(*_inner(keys), "at")
    counts = dealt.applyInPandas(partial(_block_ahead, digits=digits, keys=keys), "query_id long, ahead long" + _key_schema(bank, keys))
    return counts.groupBy(*keys, "query_id").agg(F.sum("ahead").alias("place"))


def _block_pairs(rows: pd.DataFrame, digits: int, n: int, keys: tuple[str, ...]) -> pd.DataFrame:
    """Similarities of the pairs of a block with itself, or of the first block of a group with the second."""
    one, two = rows[~rows["second"].to_numpy(dtype=bool)], rows[rows["second"].to_numpy(dtype=bool)]
    a = one["id"].to_numpy()
    b = two["id"].to_numpy() if len(two) else a
    both = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
    keep = np.nonzero(a[:, None] < b[None, :]) if not len(two) else np.nonzero(a[:, None] != b[None, :])
    out = {"a": both[0][keep], "b": both[1][keep]}
    for k in range(n):
        dim = rows[f"vec{k}"].map(len).max()
        x = _matrix(one[f"vec{k}"], dim)
        y = _matrix(two[f"vec{k}"], dim) if len(two) else x
        out[f"sim{k}"] = np.round(x @ y.T, digits)[keep]
    return _keyed(pd.DataFrame(out), rows, keys)


def pair_similarities(df: DataFrame, vecs: dict[str, str] | None = None, digits: int = DIGITS, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(a, b, *similarities[, *keys])`` of all pairs a < b of rows ``(id, ...)``; quadratic by its meaning.

    ``vecs`` names a column of vectors for each similarity, ``{"sim": "feat"}`` by default: several are computed
    in one go, as the same pairs are wanted. Ids are numbers that don't repeat within a key. Rows take part as in
    :func:`top_k`, if all their vectors do. A key's rows are cut into blocks of some ``PAIR_ROWS`` and each two of
    them meet in one group, so that tasks are alike however the keys' sizes differ.
    """
    vecs = vecs or {"sim": "feat"}
    for vec in vecs.values():
        df = _taking_part(df, vec, "id")
    parts, at, every = unused(df.columns, "parts", "at", "every")
    if keys:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAIR_ROWS).cast("int").alias(parts))
        df = df.join(broadcast_if_small(materialize(sizes)), list(keys))
    else:
        df = df.withColumn(parts, F.lit(max(1, -(-df.count() // PAIR_ROWS))))
    df = df.withColumn(at, F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))
    met = df.withColumn(every, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    rows = met.select(
        F.col("id").cast("long").alias("id"), *[F.col(c).alias(f"vec{k}") for k, c in enumerate(vecs.values())],
        F.least(at, every).alias("part"), F.greatest(at, every).alias("side"), (F.col(at) > F.col(every)).alias("second"),
        *[F.col(c).alias(held) for c, held in zip(keys, _inner(keys))],
    )
    schema = "a long, b long" + "".join(f", sim{k} double" for k in range(len(vecs))) + _key_schema(df, keys)
    made = rows.groupBy(*_inner(keys), "part", "side").applyInPandas(partial(_block_pairs, digits=digits, n=len(vecs), keys=keys), schema)
    return made.withColumnsRenamed({f"sim{k}": name for k, name in enumerate(vecs)})


class _Ranges:
    """The values of some columns of a table of :func:`materialize`, which is used up, cut into ranges for each key.

    The cuts are approximate quantiles. A value that is a cut is a range of its own, so that one that very many rows
    have takes no sorting; what lies between two cuts is a small share of a key's rows whatever the values are.
    """

    def __init__(self, table: DataFrame, values: list[str], keys: tuple[str, ...], ranges: int):
        self.values, self.keys = values, keys
        names = unused([*table.columns, *keys], *[f"{what}{i}" for i in range(len(values)) for what in ("cuts", "range", "told", "before", "upto", "total")], "n", "sizes", "salt")
        cuts, self.at, self.told, self._before, self._upto, self._total = (names[i:-3:6] for i in range(6))
        self.salt = names[-1]
        shares = F.expr(f"array({', '.join(f'{i / ranges}D' for i in range(1, ranges))})")
        wanted = [F.array_sort(F.array_distinct(F.percentile_approx(v, shares, 10 * ranges))).alias(c) for v, c in zip(values, cuts)]
        edges = materialize(table.groupBy(*keys).agg(*wanted))  # one row a key
        spread = F.pmod(F.xxhash64(*values, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(ranges))
        rows = self._with(table, edges, ranges).withColumn(self.salt, spread).withColumns({r: F.lit(0) for r in self.at})
        for step in (1 << i for i in reversed(range((ranges - 1).bit_length()))):
            # by halves: how many cuts are less; plain columns, which are compiled where a fold over an array isn't
            further = lambda v, c, r, step=step: F.when(F.get(F.col(c), F.col(r) + step - 1) < F.col(v), step).otherwise(0)
            rows = rows.withColumns({r: F.col(r) + further(v, c, r) for v, c, r in zip(values, cuts, self.at)})
        own = lambda v, c, r: F.when(F.get(F.col(c), F.col(r)) == F.col(v), 1).otherwise(0)
        rows = rows.withColumns({r: 2 * F.col(r) + own(v, c, r) for v, c, r in zip(values, cuts, self.at)})
        rows = materialize(rows.drop(*cuts))  # in the place of the table, so that ranges are looked up once
        discard(table)
        told, (n, held) = None, names[-3:-1]
        for r, t in zip(self.at, self.told):
            sizes = rows.groupBy(*keys, r).agg(F.count(F.lit(1)).alias(n))  # at most twice the ranges a key
            placed = F.map_from_entries(F.collect_list(F.struct(F.col(r), F.col(n))))
            counts = F.transform(F.sequence(F.lit(0), F.lit(2 * ranges)), lambda i: F.coalesce(F.try_element_at(F.col(held), i), F.lit(0).cast("long")))
            sums = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda s, more: F.concat(s, F.array(F.element_at(s, -1) + more)))
            one = sizes.groupBy(*keys).agg(placed.alias(held)).select(*keys, sums.alias(t))
            told = one if told is None else (told.join(one, list(keys)) if keys else told.join(F.broadcast(one), F.lit(True)))
        rows = self._with(rows, materialize(told), ranges)
        for at, t, before, upto, total in zip(self.at, self.told, self._before, self._upto, self._total):
            sums = F.col(t)
            rows = rows.withColumns({before: F.get(sums, F.col(at)), upto: F.get(sums, F.col(at) + 1), total: F.element_at(sums, -1)})
        self.rows = rows.drop(*self.told)  # before rows are shuffled

    def _with(self, rows: DataFrame, told: DataFrame, ranges: int) -> DataFrame:
        """``rows`` and what is told of their key, with arrays of ``ranges`` elements for each value."""
        if not self.keys:
            return rows.join(F.broadcast(told), F.lit(True))  # one row
        return rows.join(broadcast_if_small(told, held=told.count() * ranges * len(self.values)), list(self.keys))

    def before(self, i: int) -> Column:
        """Rows of lower ranges than a row's."""
        return F.col(self._before[i])

    def upto(self, i: int) -> Column:
        return F.col(self._upto[i])

    def total(self, i: int) -> Column:
        return F.col(self._total[i])

    def placed(self, rows: DataFrame, i: int, less: str, same: str) -> DataFrame:
        """``rows`` with the number of rows whose value ``i`` is less, and of those that share it. Only ranges between cuts are sorted."""
        cut = F.col(self.at[i]) % 2 == 1
        group = [*self.keys, F.col(self.at[i]), F.when(cut, F.col(self.salt)).otherwise(0)]
        value = F.col(self.values[i])
        order = F.rank().over(Window.partitionBy(*group).orderBy(value))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
        lower = F.when(cut, self.before(i)).otherwise(self.before(i) + order - 1)
        return rows.withColumns({less: lower, same: F.when(cut, self.upto(i) - self.before(i)).otherwise(ties)})

    def drop(self, rows: DataFrame) -> DataFrame:
        return rows.drop(*self.at, *self._before, *self._upto, *self._total, self.salt)


def average_ranks(df: DataFrame, value: str, out: str, ranges: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and the rank of ``value`` over all rows of equal ``keys``, ties at their mean, without a global window."""
    return ranks_of(df, {value: out}, ranges, keys)


def ranks_of(df: DataFrame, values: dict[str, str], ranges: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and, for each of ``values`` (column: name of its rank), what :func:`average_ranks` gives.

    Rows with a null value or key go. The input is written once; then each column costs one shuffle, and no window
    spans more than a range of values.
    """
    less, same = unused([*df.columns, *values.values()], "less", "same")
    told = [F.col(c).isNotNull() for c in (*values, *keys)]
    cut = _Ranges(materialize(df.where(reduce(lambda a, b: a & b, told))), list(values), keys, ranges)
    rows = cut.rows
    for i, out in enumerate(values.values()):
        rows = cut.placed(rows, i, less, same).withColumn(out, F.col(less) + (F.col(same) + 1) / 2).drop(less, same)
    return cut.drop(rows)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], keys: tuple[str, ...] = (), ranges: int = 256) -> DataFrame:
    """``(*keys, *shares)``: exact quantiles of the values that are not null, linear between two rows; none gives nulls.

    Only the ranges of values that hold a wanted place are sorted, and no task holds all values of a key.
    """
    less, same = unused([value, *keys], "less", "same")
    cut = _Ranges(materialize(df.where(F.col(value).isNotNull()).select(*keys, value)), [value], keys, ranges)
    places = {name: F.lit(float(share)) * (cut.total(0) - 1) for name, share in shares.items()}
    ends = [f(p) for p in places.values() for f in (F.floor, F.ceil)]
    near = F.exists(F.array(*ends), lambda p: (cut.before(0) <= p) & (p < cut.upto(0)))
    rows = cut.placed(cut.rows.where(near), 0, less, same)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col(less) <= place) & (place < F.col(less) + F.col(same)), F.col(value)))

    found = []
    for name, place in places.items():
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return rows.groupBy(*keys).agg(*found)
