"""Operators 11 to 13 against brute force, and their defined results on odd input."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from test_operators import ODD, ODD_IDS, docs

from gridseek.llm import fim, pieces, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 fill in the middle


def plain_fim(key, text):
    """The rule, step by step: ``(n, form, prefix, middle, output)``."""
    h = [int(sha(f"1:{key}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fim_by_definition(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab \né☃\U0001f600<>PSM") for _ in range(draw.randint(0, 40))) for _ in range(400)] + ["x<P>", "<M", "<S>", "<<P", "́e\r\n"]
    rows = {r["doc_id"]: r for r in fim.fim_digests(docs(spark, texts)).collect()}
    forms = set()
    for i, text in enumerate(texts):
        n, form, prefix, middle, output = plain_fim(i, text)
        r = rows[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(output), sha(text))
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}
    changed = {r["doc_id"]: r["text"] for r in fim.transform(docs(spark, texts)).collect()}
    assert all(changed[i] == plain_fim(i, t)[4] for i, t in enumerate(texts))


@pytest.mark.parametrize("unit", [r"\w+\s*", r"[^\n]*\n", r"x*", r"zzz", r"\X"])
def test_fim_units(unit):
    plan = fim.Plan(unit=unit, changed=100)
    pattern = regex.compile(unit)
    for k, text in enumerate(["one two\nthree, é", "\n\n", "xxyxx", "no end"]):
        ends = fim.unit_ends(pattern, text).tolist()
        assert ends == sorted(set(ends)) and ends[-1] == len(text) and ends[0] > 0
        n, form, prefix, middle, output = fim.arrange(plan, pattern, str(k), text)
        assert n == len(ends) and {prefix, prefix + middle} <= {0, *ends} and fim.restore(plan, form, output) == text
    assert fim.unit_ends(pattern, "").tolist() == []


def test_fim_marks_have_to_be_apart():
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aba", "c", "d"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.Plan(marks=marks)
    fim.Plan(marks=("<|prefix|>", "<|suffix|>", "<|middle|>"))


def test_fim_odd(spark):
    odd = docs(spark, ODD, ODD_IDS)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["output_sha256"], r["restored_sha256"]) for r in fim.fim_digests(odd).collect())
    want = []
    for i, t in zip(ODD_IDS, ODD):
        n, form, _, _, output = plain_fim("" if i is None else i, t or "")
        want.append((str(i), n, form, sha(output), sha(t or "")))
    assert got == sorted(want)
    assert fim.transform(odd).columns == odd.columns and fim.transform(odd).where("text IS NULL").count() == 0
    assert fim.fim_digests(docs(spark, [])).count() == 0
    named = docs(spark, ["ab", "cd"]).withColumns({"made": F.lit(1), "output": F.lit(2), "form": F.lit(3), "n": F.lit(4)})
    assert fim.transform(named).columns == named.columns and fim.fim_digests(named).count() == 2


# 12 whitening


def plain_whitening(vectors, k):
    """Exact deviations and moments; eigenvectors by a dense solver."""
    dim = max(map(len, vectors))
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in [*v, *[0.0] * (dim - len(v))]] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    return n, dev, centred @ vecs / np.sqrt(values), values / float(Fraction(sum(dev), n**3))


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("dim", [3, 8, 40, 150])
def test_whitening(spark, dim):
    draw = np.random.default_rng(dim)
    data = (draw.standard_normal((500, dim)) * np.linspace(2, 0.2, dim) + draw.standard_normal(dim) * 3).astype(np.float32)
    got = whitening.whitening_report(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(data)]).repartition(7)).toPandas()
    k = min(8, dim)
    n, dev, want, shares = plain_whitening(data.tolist(), k)
    assert len(got) == n * k and (got["n"] == n).all() and got["identity_error"].max() < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-8
    assert got.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == dev
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], shares, rtol=1e-10)


def test_whitening_sf(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whitening_report(rows).toPandas()
    known = rows.toPandas()
    n, dev, want, shares = plain_whitening(known["embedding"].tolist(), 8)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[known["vec_id"]].to_numpy()
    assert np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-8
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[known["vec_id"]].tolist() == dev


@pytest.mark.parametrize("dim, span, values", [(300, 48, "steep"), (120, 60, "flat"), (60, 512, "equal"), (200, 48, "few")])
def test_subspace_restarts(dim, span, values):
    draw = np.random.default_rng(1)
    turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    wanted = {
        "steep": 0.9 ** np.arange(dim) * 100, "flat": np.linspace(10, 1, dim),
        "equal": np.full(dim, 4.0), "few": np.r_[5.0, 3.0, np.zeros(dim - 2)],
    }[values]
    matrix = turn * wanted @ turn.T
    passes = []
    found, vectors = whitening.subspace(lambda q: passes.append(q) or matrix @ q, dim, span=span, tolerance=1e-12)
    assert np.allclose(found, wanted[:8], atol=1e-10 * wanted[0]) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-10)
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() <= 1e-11 * wanted[0]
    assert all(q.shape[1] <= 16 and np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-8) for q in passes)


def test_whitening_odd(spark):
    good = [[0.5, 1.0, -2.0], [0.25, -1.0], [], [3.0, 0.0, 1.0], [0.5, 1.0, -2.0]]
    bad = [None, [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [3e38, 0.0, 0.0]]
    ids = [1, 2, 2, None, 5]
    rows = table(spark, [(i, v, 0) for i, v in zip(ids, good)] + [(9, v, 0) for v in bad])
    got = whitening.whitening_report(rows.withColumns({"n": F.lit(1), "x": F.lit(2), "component": F.lit(3)})).toPandas()
    n, dev, want, shares = plain_whitening(good, 3)
    assert len(got) == 15 and n == 5 and sorted(set(got["deviation"])) == sorted(set(dev)) and np.allclose(got.groupby("component")["explained"].first(), shares)
    assert np.allclose(sorted(np.abs(got["whitened"])), sorted(np.abs(want).ravel()), atol=1e-9)
    assert whitening.whitening_report(table(spark, [])).count() == 0
    assert whitening.whitening_report(table(spark, [(1, [1.0, 2.0], 0)])).count() == 0  # no variance
    assert whitening.whitening_report(table(spark, [(1, [], 0)])).count() == 0
    line = whitening.whitening_report(table(spark, [(i, [float(i), 2.0 * i], 0) for i in range(9)])).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1.0)


def test_whitening_of_very_large_entries_is_exact(spark):
    data = [[2.0**40, 1.0], [-(2.0**40), 2.0], [3.0, 2.0**41], [5.0, 7.0]]
    n, dev, want, _ = plain_whitening(data, 2)
    rows = whitening.whole_rows(table(spark, [(i, v, 0) for i, v in enumerate(data)]))
    got = sorted(whitening.whiten(rows, whitening.fit_whitening(rows)).collect())
    assert [int(r["deviation"]) for r in got] == dev
    assert np.allclose(np.abs([r["whitened"] for r in got]), np.abs(want), atol=1e-9)


# 13 sentencepiece


@pytest.fixture(scope="module")
def coder():
    with open(MODEL, "rb") as file:
        model = file.read()
    return pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_pieces_as_the_library(coder):
    mine, library = coder
    draw, known = random.Random(5), [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    signs = ["ab de ", "a ▁ ", "ab\n\t 12", "éèà☃\U0001f600x ", "the ing and of to ", "漢字かな漢語 日本", "\0<0x41></s> ", " ", "int main(){}  \n\t", "aA"]
    for k in range(4000):
        sign = draw.choice(signs)
        text = "".join(draw.choice(sign) for _ in range(draw.randint(0, 60))) if k % 2 else "".join(draw.choice(known) for _ in range(draw.randint(1, 8))).replace("▁", draw.choice([" ", "▁", ""]))
        assert mine.encode(text) == library.encode(text), repr(text)
    for text in ("a" * 50_000, " " * 50_001, "ab" * 30_000, "\U0001f9ff" * 20_000, "x" * 30 + "\n" + "y" * 30):
        assert mine.encode(text) == library.encode(text)


def test_pieces_cuts(coder):
    mine, _ = coder
    side_by_side = {p[i : i + 2] for p in mine.ids for i in range(len(p) - 1)}
    draw = random.Random(8)
    for _ in range(2000):
        text = "".join(draw.choice("▁▁▁abZé9.\n☃\U0001f600字語ж") for _ in range(30))
        parts = mine.parts(text)
        assert "".join(parts) == text and all(a[-1] + b[0] not in side_by_side for a, b in zip(parts, parts[1:]))
        assert len(parts) > 1


def test_pieces_compatible_is_the_merge(coder):
    mine, _ = coder
    draw = random.Random(6)
    tokens = [i for i, p in enumerate(mine.pieces) if p]
    for _ in range(5000):
        a, b = draw.choice(tokens), draw.choice(tokens)
        if mine.merges(mine.pieces[a])[0] == [mine.pieces[a]]:
            assert mine.compatible(a, b) == (mine.merges(mine.pieces[a] + mine.pieces[b])[0] == [mine.pieces[a], mine.pieces[b]])


def test_pieces_documents(spark, sf, coder):
    _, library = coder
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in pieces.piece_digests(rows, MODEL).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_forget(spark, monkeypatch, coder):
    _, library = coder
    monkeypatch.setattr(pieces, "PARTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    with open(MODEL, "rb") as file:
        mine = pieces.Encoder(file.read())
    text = "a long text of several words, which are forgotten at once " * 3
    assert mine.encode(text) == library.encode(text) and len(mine.known) <= 3 and len(mine.pairs) <= 3


def test_pieces_odd(spark, coder):
    _, library = coder
    odd = docs(spark, ODD, ODD_IDS).withColumns({"ids": F.lit(1), "made": F.lit(2)})
    out = pieces.encode_documents(odd, MODEL)
    assert out.columns == [*odd.columns, "ids_", "decoded"]
    assert sorted(map(repr, ((r["ids_"], r["decoded"]) for r in out.collect()))) == sorted(repr((library.encode(t or ""), library.decode(library.encode(t or "")) if t else "")) for t in ODD)
    assert pieces.piece_digests(docs(spark, []), MODEL).count() == 0


def test_pieces_models_of_other_kinds(tmp_path, spark):
    from sentencepiece import sentencepiece_model_pb2

    with open(MODEL, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.encode_documents(docs(spark, ["a"]), str(tmp_path / "other.model"))
