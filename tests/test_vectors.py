"""Similarity joins, pairs and ranks on odd vectors, ties and keys of very different sizes, against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridseek.operators import fidelity, localize, vectors
from gridseek.operators.vectors import average_ranks, pair_similarities, places_of, quantiles, ranks_of, top_k

NAN, INF = float("nan"), float("inf")
ODD = [(1, [1.0, 0.0]), (2, None), (3, [NAN, 1.0]), (4, [0.0, 1.0]), (5, [None, 1.0]), (6, [1.0, INF]), (7, [0.5, 0.5]), (8, []), (None, [9.0, 9.0]), (9, [2.0])]


def frame(spark, rows, name="ref_id"):
    return spark.createDataFrame(rows, f"{name} long, feat array<double>")


def plain_top_k(queries, bank, k, distance=False):
    good = lambda rows: [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good(queries):
        pad = lambda w, v=v: (np.pad(v, (0, max(len(w) - len(v), 0))), np.pad(w, (0, max(len(v) - len(w), 0))))
        score = lambda w: -float(np.linalg.norm(np.subtract(*pad(w)))) if distance else float(np.dot(*pad(w)))
        out[q] = [i for _, i in sorted((-round(score(w), 9), i) for i, w in good(bank))[:k]]
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 10])
@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_top_k_of_odd_vectors(spark, k, metric):
    got: dict = {}
    for r in sorted(top_k(frame(spark, ODD, "query_id"), frame(spark, ODD), k, metric=metric).collect()):
        got.setdefault(r["query_id"], []).append(r["ref_id"])
    assert got == plain_top_k(ODD, ODD, k, metric == "l2")


def test_nothing_but_odd_vectors(spark):
    bad = [r for r in ODD if r[0] in (2, 3, 5, 6)]
    assert top_k(frame(spark, ODD, "query_id"), frame(spark, bad), 2).count() == 0
    assert top_k(frame(spark, bad, "query_id"), frame(spark, ODD), 2).count() == 0
    assert top_k(frame(spark, [], "query_id"), frame(spark, []), 2).count() == 0
    assert localize.ratio_matches(frame(spark, ODD, "query_id"), frame(spark, bad)).count() == 0
    assert pair_similarities(frame(spark, bad, "id")).count() == 0
    asked = frame(spark, ODD, "query_id").withColumns({"target_id": F.lit(1).cast("long"), "target_sim": F.lit(0.25)})
    places = {r["query_id"]: r["place"] for r in places_of(asked, frame(spark, ODD)).collect()}
    # of 1, 4, 7, 8 and 9: those above a quarter, or equal with a smaller id
    assert places == {1: 2, 4: 1, 7: 3, 8: 0, 9: 2}


def test_keys_have_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 8)
    monkeypatch.setattr(vectors, "BANK_ROWS", 16)
    draw = np.random.default_rng(4)
    rows = [(k, i, draw.standard_normal(3).tolist()) for k, n in (("large", 90), ("small", 5), ("one", 1)) for i in range(n)]
    both = spark.createDataFrame(rows, "key string, id long, feat array<double>")
    asked, bank = both.withColumnRenamed("id", "query_id"), both.withColumnRenamed("id", "ref_id")
    dealt = vectors._dealt(asked, bank, "feat", [], keys=("key",)).groupBy("key0").agg(F.count_distinct("part", "side").alias("n"), F.count("id").alias("rows"))
    assert {(r["key0"], r["n"], r["rows"]) for r in dealt.collect()} == {("large", 72, 90 * 6 + 90 * 12), ("small", 1, 10), ("one", 1, 2)}
    got = top_k(asked, bank, 4, keys=("key",)).toPandas()
    for key in ("large", "small", "one"):
        mine = [(i, v) for k, i, v in rows if k == key]
        found = got[got["key"] == key].sort_values("rank").groupby("query_id")["ref_id"].apply(list).to_dict()
        assert found == plain_top_k(mine, mine, 4)


@pytest.mark.parametrize("block", [7, 1024])
def test_pairs_of_several_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "PAIR_ROWS", block)
    draw = np.random.default_rng(5)
    rows = [(k, i, draw.standard_normal(3).tolist(), draw.standard_normal(2).tolist()) for k, n in (("a", 30), ("b", 2), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, id long, u array<double>, v array<double>")
    got = {(r["key"], r["a"], r["b"]): (r["su"], r["sv"]) for r in pair_similarities(df, {"su": "u", "sv": "v"}, keys=("key",)).collect()}
    want = {(k, i, j): (round(float(np.dot(u, x)), 9), round(float(np.dot(v, y)), 9)) for k, i, u, v in rows for m, j, x, y in rows if k == m and i < j}
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p], atol=1e-9) for p in want)


def test_ranks_where_most_rows_share_a_value(spark):
    draw = np.random.default_rng(6)
    told = pd.DataFrame({"key": draw.integers(0, 3, 4000), "v": np.where(draw.random(4000) < 0.6, 0.0, draw.standard_normal(4000).round(2)), "w": draw.standard_normal(4000), "less": 1})
    told.loc[told["key"] == 2, "v"] = 7.0
    df = spark.createDataFrame(told)
    got = ranks_of(df, {"v": "qv", "w": "qw"}, ranges=16, keys=("key",)).toPandas()
    assert list(got.columns) == ["key", "v", "w", "less", "qv", "qw"] and len(got) == len(told)
    for c in "vw":
        assert (got.groupby("key")[c].rank() == got[f"q{c}"]).all()
    one = average_ranks(df, "v", "q", ranges=7).toPandas()
    assert (one["v"].rank() == one["q"]).all()
    # rows that share one value are not one group: they are dealt by a number of their own
    cut = vectors._Ranges(vectors.materialize(df), ["v"], (), 16)
    sizes = cut.rows.groupBy(cut.at[0], F.when(F.col(cut.at[0]) % 2 == 1, F.col(cut.salt)).otherwise(0)).count().toPandas()
    assert sizes["count"].max() < len(told) / 4


def test_quantiles_where_most_rows_share_a_value(spark):
    values = [0.0] * 500 + [float(i) for i in range(1, 60)] + [None]
    shares = {"a": 0.0, "b": 0.3, "c": 0.893, "d": 0.95, "e": 1.0}
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", shares, ranges=8).collect()[0]
    want = np.quantile([v for v in values if v is not None], list(shares.values()))
    assert np.allclose([got[n] for n in shares], want)


def test_spearman_of_odd_vectors(spark):
    draw = np.random.default_rng(7)
    base = [(i, draw.standard_normal(4).tolist()) for i in range(40)]
    other = [(i, None if i == 3 else (np.array(v) + 0.3 * draw.standard_normal(4)).tolist()) for i, v in base if i != 9]
    got = fidelity.spearman(frame(spark, base, "id"), frame(spark, other, "id")).collect()[0]
    kept = [i for i, v in other if v is not None]
    a, b = (np.array([dict(side)[i] for i in kept]) for side in (base, other))
    upper = np.triu_indices(len(kept), 1)
    want = pd.Series((a @ a.T)[upper]).rank().corr(pd.Series((b @ b.T)[upper]).rank())
    assert got["n_pairs"] == len(upper[0]) and abs(got["rho"] - want) < 1e-6


def test_spearman_computes_each_pair_once(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(20)]
    others = spark.createDataFrame([(c, i, v) for c in ("x", "y") for i, v in rows], "config string, id long, feat array<double>")
    told = fidelity.spearman(frame(spark, rows, "id"), others, keys=("config",))
    told.collect()
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan  # ranks are taken of the written pairs


def test_places_in_blocks_by_definition(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MATRIX_CELLS", 1)
    draw = np.random.default_rng(8)
    x = draw.integers(-2, 3, (60, 3)) / 2  # many equal similarities
    sims = np.round(x @ x.T, 9)
    target = draw.integers(0, 60, 60)
    asked = spark.createDataFrame([(i, x[i].tolist(), int(t), float(sims[i, t])) for i, t in enumerate(target)], "query_id long, feat array<double>, target_id long, target_sim double")
    got = {r["query_id"]: r["place"] for r in places_of(asked, frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    ahead = lambda i, t, j: j != i and (sims[i, j] > sims[i, t] or sims[i, j] == sims[i, t] and j < t)
    assert got == {i: sum(ahead(i, t, j) for j in range(60)) for i, t in enumerate(target)}


def test_blocks_are_dealt_seldom():
    # copies of the vectors and rows of the best go with the number of blocks
    assert vectors.QUERY_ROWS >= 16384 and vectors.BANK_ROWS >= 65536
    most = vectors._rows_at_once(vectors.BANK_ROWS) * vectors.BANK_ROWS * 8
    assert most <= 32 << 20


@pytest.mark.parametrize("small", [False, True])
def test_spearman_without_written_pairs(spark, monkeypatch, small):
    from gridseek.operators import pairs

    draw = np.random.default_rng(9)
    a = draw.standard_normal((90, 5))
    a[7] *= 1e6  # the others' similarities are close to each other
    b = {"copy": 2 * a, "far": a + draw.standard_normal(a.shape), "ties": np.round(a / 2)}
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(a)], "id")
    others = spark.createDataFrame([(c, i, v.tolist()) for c, x in b.items() for i, v in enumerate(x) if c != "far" or i < 50], "config string, id long, feat array<double>")
    if small:
        monkeypatch.setattr(pairs, "BLOCK_ROWS", 20)
        monkeypatch.setattr(pairs, "LEAST_ROWS", 20)
        monkeypatch.setattr(pairs, "TILE", 7)
        monkeypatch.setattr(pairs, "KEYS_AT_ONCE", 2)
    want = {r["config"]: r[1:] for r in fidelity.spearman(base, others, keys=("config",)).select("config", "n_pairs", "rho").collect()}
    monkeypatch.setattr(fidelity, "WRITTEN_PAIRS", 0)
    monkeypatch.setattr(fidelity, "pair_similarities", None)  # pairs are not written
    got = fidelity.spearman(base, others, keys=("config",))
    assert {r["config"]: r[1:] for r in got.select("config", "n_pairs", "rho").collect()} == want
    alone = others.where("config = 'far'").select("id", "feat")
    assert tuple(fidelity.spearman(base, alone).select("n_pairs", "rho").first()) == want["far"]


def test_passes_over_pairs_shuffle_no_rows(spark, monkeypatch):
    from gridseek.operators import pairs

    plans, passed = [], pairs._passed

    def told(*args):
        plans.append(passed(*args))
        return plans[-1]

    x = np.random.default_rng(4).standard_normal((60, 4))
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id")
    monkeypatch.setattr(pairs, "LEAST_ROWS", 10)
    monkeypatch.setattr(pairs, "_passed", told)
    monkeypatch.setattr(fidelity, "WRITTEN_PAIRS", 0)
    assert tuple(fidelity.spearman(base, base).first()) == (1770, 1.0)
    assert plans and not any("Exchange" in df._jdf.queryExecution().toString() for df in plans)


def test_counts_tell_single_values():
    from types import SimpleNamespace

    from gridseek.operators.pairs import Bins, _counted

    x = np.array([[-1.0], [0.0], [1e-7], [1.0], [1.0]])
    met = {"key": ["a"], "at": [0], "at_": [1], "ids": [np.arange(5).tobytes()], "ids_": [np.arange(5, 10).tobytes()]}
    rows = pd.DataFrame(met | {c: [x.tobytes()] for c in ("vec0", "vec0_")})
    bins = Bins(2.0)
    counts, value = np.zeros(len(bins.counts), dtype=np.int64), np.zeros(len(bins.counts))
    # the pairs twice, as two pairs of blocks of a task
    for out in _counted(iter([rows, rows]), SimpleNamespace(value={"a": {0: bins}}), 9):
        for chunk, n, v in zip(out["chunk"], out["counts"], out["value"]):
            at = slice(chunk << 14, (chunk << 14) + len(n) // 8)
            counts[at], value[at] = np.frombuffer(n, dtype=np.int64), np.frombuffer(v)
    sims = np.repeat(np.round(x @ x.T, 9).ravel(), 2)
    places = bins.of(sims)
    assert (counts == np.bincount(places, minlength=len(counts))).all()
    for at in np.unique(places):
        held = set(sims[places == at])
        assert value[at] == held.pop() if len(held) == 1 else np.isnan(value[at])


def test_blocks_of_other_widths_and_repeated_ids(spark, monkeypatch):
    from gridseek.operators import pairs

    draw = np.random.default_rng(6)
    rows = [(i % 40, draw.standard_normal(1 + i % 5).tolist(), draw.standard_normal(i % 3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, one array<double>, two array<double>")
    got = []
    for least in (1000, 6):
        monkeypatch.setattr(pairs, "LEAST_ROWS", least)
        got.append(tuple(pairs.pair_rank_correlation(df, "one", "two").first()))
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 9)
    met = [(dot(a[1], b[1]), dot(a[2], b[2])) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] != b[0]]
    ranks = pd.DataFrame(met).rank()
    assert [n for n, _ in got] == [len(met)] * 2
    assert [rho for _, rho in got] == pytest.approx([np.corrcoef(ranks[0], ranks[1])[0, 1]] * 2, abs=1e-9)


def test_bins_tell_single_values():
    from gridseek.operators.pairs import Bins

    values = np.sort(np.repeat([-3.0, 1.0, 1.0 + 1e-9, 1.0 + 2e-9, 4e5], [5, 7, 100, 9, 1]))
    bins = Bins(1e6)
    for _ in range(12):
        at = bins.of(values)
        assert (np.diff(at) >= 0).all()
        bins.counts = np.bincount(at, minlength=len(bins.counts))
        bins.value = np.array([np.nan] * len(bins.counts))
        for i in np.unique(at):
            bins.value[i] = values[at == i][0] if len(set(values[at == i])) == 1 else np.nan
        if bins.even():
            break
        bins.cut()
    assert np.allclose(bins.ranks()[bins.of(values)] + (len(values) + 1) / 2, pd.Series(values).rank())


def _block(draw, kind):
    """Queries, bank rows, ids of both; more bank rows than are searched in double precision only."""
    from gridseek.operators import blocks

    n = 2 * blocks.TILE + 37
    x = {
        "plain": draw.standard_normal((n, 24)),
        "ties": draw.integers(-2, 3, (n, 4)) / 2,
        "one vector": np.concatenate([draw.standard_normal((n - 900, 6)), np.ones((900, 6))]),
        "far off": 1e4 + draw.standard_normal((n, 5)),
        "sizes": draw.standard_normal((n, 8)) * 10.0 ** draw.uniform(-9, 4, (n, 1)),
        "rising": np.sort(np.abs(draw.standard_normal((n, 1))), axis=0) * np.ones((1, 3)),
        "near zero": 1e-170 * draw.standard_normal((n, 3)),
    }[kind]
    ids = draw.permutation(2 * n)[:n].astype(np.int64)
    ids[-3:] = ids[0]  # ids that repeat
    asks = np.concatenate([np.arange(40), np.arange(n - 40, n)])
    return x[asks], x, np.where(np.arange(80) % 9 == 0, -1 - np.arange(80), ids[asks]), ids


@pytest.mark.parametrize("kind", ["plain", "ties", "one vector", "far off", "sizes", "rising", "near zero"])
def test_blocks_by_tiles(kind):
    from gridseek.operators import blocks

    q, x, own, ids = _block(np.random.default_rng(3), kind)
    pick = lambda n, row, col, score: {(int(r), int(ids[c]), float(f"{s:.9g}")) for r, c, s in zip(row, col, score) if r not in n}
    for metric, k, skip in (("dot", 1, True), ("dot", 50, True), ("dot", 3, False), ("l2", 2, False), ("l2", 7, True)):
        *some, left = blocks.Block(q, x, own, ids, 9, metric).best(k, skip)
        assert pick(left, *some) == pick(left, *vectors._best_of_all(q, x, own, ids, k, 9, skip, metric))
    for step in (1, 30):
        at = (np.arange(80) * step) % len(x)
        sim = np.round((q * x[at]).sum(axis=1), 9)
        got, left = blocks.Block(q, x, own, ids, 9).ahead(ids[at], sim)
        rest = np.setdiff1d(np.arange(80), left)
        assert (got[rest] == vectors._ahead_of_all(q, x, own, ids, ids[at], sim, 9)[rest]).all()
    if kind == "plain":
        assert not len(left)


@pytest.mark.parametrize("kind", ["plain", "ties"])
def test_few_similarities_are_rounded(monkeypatch, kind):
    """All were computed and rounded in double precision, which took most of the time of nearest rows and places."""
    q, x, own, ids = _block(np.random.default_rng(5), kind)
    x = x + np.arange(x.shape[1]) * (kind == "ties")
    side = lambda rows, i, asks: pd.DataFrame({"id": i, "vec": list(rows), "asks": asks})
    asked, bank = side(x[:80], ids[:80], True), side(x, ids, False)
    rounded, old = [], np.round

    def counted(a, *args, **kept):
        rounded.append(np.size(a))
        return old(a, *args, **kept)

    want = vectors._best_of_all(x[:80], x, ids[:80], ids, 3, 9, True, "dot")
    places = vectors._ahead_of_all(x[:80], x, ids[:80], ids, ids[80:160], old((x[:80] * x[80:160]).sum(axis=1), 9), 9)
    monkeypatch.setattr(np, "round", counted)
    got = vectors._block_best(pd.concat([asked, bank]), 3, 9, True, "dot", False, ())
    asked = asked.assign(target_id=ids[80:160], target_sim=old((x[:80] * x[80:160]).sum(axis=1), 9))
    ahead = vectors._block_ahead(pd.concat([asked, bank]), 9, ())
    pairs = lambda i, j: sorted(zip(i.tolist(), j.tolist()))
    assert pairs(got["query_id"], got["ref_id"]) == pairs(ids[:80][want[0]], ids[want[1]])
    assert ahead["ahead"].tolist() == places.tolist()
    if kind == "plain":
        assert sum(rounded) < 0.05 * len(q) * len(x)


@pytest.mark.parametrize("most", [2, 4096])
def test_each_pair_of_blocks_is_a_task(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 8)
    monkeypatch.setattr(vectors, "BANK_ROWS", 16)
    monkeypatch.setattr(vectors, "SIDES", 3)
    monkeypatch.setattr(vectors, "PAIRS_IN_TURN", most)
    draw = np.random.default_rng(4)
    for keys in ((), ("key",)):
        rows = [(k, i, draw.standard_normal(3).tolist()) for k, n in (("large", 90), ("small", 5)) for i in range(n if keys or k == "large" else 0)]
        both = spark.createDataFrame(rows, "key string, id long, feat array<double>")
        asked, bank = both.withColumnRenamed("id", "query_id"), both.withColumnRenamed("id", "ref_id")
        dealt = vectors._dealt(asked, bank, "feat", [], keys=keys)
        tasks = dealt.select("part", "side", F.spark_partition_id().alias("task"), *vectors._inner(keys)).distinct().collect()
        # blocks of queries grow beyond three, to sixteen rows: six by six of the large key
        assert len(tasks) == 36 + len(keys)
        assert dealt.rdd.getNumPartitions() == min(most, 36 + len(keys))
        if most > 100:
            assert len({r["task"] for r in tasks}) == len(tasks)
        found = top_k(asked, bank, 2, skip_self=True, keys=keys)
        x = {k: np.array([v for name, _, v in rows if name == k]) for k in ("large", "small")}
        for r in found.where("rank = 1").collect():
            mine = x[r["key"] if keys else "large"]
            sims = np.round(mine @ mine[r["query_id"]], 9)
            sims[r["query_id"]] = -INF
            assert r["ref_id"] == sims.argmax()


def test_evenly_spread_vectors_are_counted_once(spark, monkeypatch):
    from gridseek.operators import pairs

    passes, passed = [], pairs._passed
    monkeypatch.setattr(pairs, "_passed", lambda *args: passes.append(args) or passed(*args))
    monkeypatch.setattr(fidelity, "WRITTEN_PAIRS", 0)
    x = np.random.default_rng(2).standard_normal((2500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x * (np.arange(64) % 3 > 0)
    side = lambda m: spark.createDataFrame(pd.DataFrame({"id": np.arange(len(m)), "feat": m.tolist()}))
    n, rho = fidelity.spearman(side(x), side(y)).first()
    one, two = (pd.Series(np.round(m @ m.T, 9)[np.triu_indices(len(m), 1)]).rank() for m in (x, y))
    assert (n, rho) == (len(one), pytest.approx(np.corrcoef(one, two)[0, 1], abs=1e-6))
    assert len(passes) == 2  # one that counts, one that multiplies ranks


@pytest.mark.parametrize("kind", ["even", "ties", "far off", "wide"])
def test_first_count_in_single_precision(spark, monkeypatch, kind):
    """It stands where no value is shared by many pairs; else pairs are counted in double precision."""
    from gridseek.operators import pairs

    draw = np.random.default_rng(8)
    x = draw.standard_normal((900, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "ties":
        x = np.round(draw.uniform(-1, 1, (900, 3))) / 3
    if kind == "far off":
        x = 1.0 + 1e-5 * x  # single precision doesn't tell the pairs apart
    y = x + 0.3 * x.std() * draw.standard_normal(x.shape) if kind != "ties" else np.abs(x)
    if kind == "wide":
        monkeypatch.setattr(pairs, "ROUGH_WIDTH", 31)
    rough, passed = [], pairs._passed
    monkeypatch.setattr(pairs, "_passed", lambda blocks, cuts, *rest: rough.append([b.rough for b in cuts[""].values()]) or passed(blocks, cuts, *rest))
    monkeypatch.setattr(fidelity, "WRITTEN_PAIRS", 0)
    side = lambda m: spark.createDataFrame(pd.DataFrame({"id": np.arange(len(m)), "feat": m.tolist()}))
    n, rho = fidelity.spearman(side(x), side(y), digits=12).first()
    one, two = (pd.Series(np.round(m @ m.T, 9)[np.triu_indices(len(m), 1)]).rank() for m in (x, y))
    assert (n, rho) == (len(one), pytest.approx(np.corrcoef(one, two)[0, 1], abs=3e-8))
    assert rough[0] == [kind != "wide"] * 2 and rough[-1] == [kind == "even"] * 2


def test_rank_shift_seeks_nearest_rows_once(spark, monkeypatch):
    asked, places_of = [], fidelity.places_of
    monkeypatch.setattr(fidelity, "places_of", lambda queries, *args, **kept: asked.append(queries) or places_of(queries, *args, **kept))
    x = np.random.default_rng(1).standard_normal((30, 4))
    base, other = (frame(spark, [(i, v.tolist()) for i, v in enumerate(m)], "id") for m in (x, np.round(x)))
    told = tuple(fidelity.rank_shift(base, other).first())
    sims, others = np.round(x @ x.T, 9), np.round(np.round(x) @ np.round(x).T, 9)
    np.fill_diagonal(sims, -INF)
    shift = [sum(j != i and (others[i, j], -j) > (others[i, t], -t) for j in range(30)) for i, t in enumerate(sims.argmax(axis=1))]
    assert told == (np.median(shift), pytest.approx(np.quantile(shift, 0.95), abs=1e-6))
    # the search isn't run again to count the rows that ask
    assert len(asked) == 1 and "FlatMapGroups" not in asked[0]._jdf.queryExecution().toString()
