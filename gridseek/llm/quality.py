"""Quality classifier: a factorisation machine (operator 1).

Features are hashed words (term frequencies of unit length), structure statistics cut into ranges, and
the declared length as metadata. A document's score is the logistic of the bias, the linear weights and
the pairwise interactions of low rank, summed in linear time: half of ``(sum v x)^2 - sum (v x)^2`` over
the factors. The machine is fitted by Adam on at most ``SAMPLE`` labelled rows, the least by a hash of the
id; scoring runs over every whole text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.plans.durable import unused

#: Labelled rows that the machine is fitted on at most.
SAMPLE = 6000
WORD_SLOTS, RANK = 1 << 14, 6
#: Steps of the fit, whatever the sample's size, rows of a step, and its rates.
STEPS, BATCH, RATE, DECAY, SEED = 600, 64, 0.02, 1e-4, 5
CUTOFF = 0.3
#: Upper ends of the ranges that each statistic is cut into.
RANGES = {
    "symbols": (0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.25),
    "upper": (0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8),
    "digits": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeats": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.8),
    "top": (0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.4),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 9, 12),
    "marks": (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "lines": (0.1, 0.2, 0.4, 0.6, 0.8, 0.95),
    "stops": (0.02, 0.05, 0.08, 0.12, 0.2, 0.4),
    "words": (1, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 20000),
    "declared": (-1, 1, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 50000),
}
_OFFSET = dict(zip(RANGES, WORD_SLOTS + np.cumsum([0, *(len(r) + 1 for r in RANGES.values())])[:-1]))
SLOTS = WORD_SLOTS + sum(len(r) + 1 for r in RANGES.values())
_MARKS = b"!#$%&*|~^@_=+<>/\\"
_ODD = bytes(b for b in range(128) if not chr(b).isalnum() and chr(b) not in " \t\n\r.,;:!?'\"()-")


def _slots_of(known: dict[bytes, int], words: list[bytes]) -> list[int]:
    """Hash slots of words; ``known`` keeps those of the task up to a bound."""
    if len(known) > 500_000:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = zlib.crc32(word.lower()) % WORD_SLOTS
    return [known[w] for w in words]


def statistics(text: str, raw: bytes, words: list[bytes], distinct: int, most: int, declared: float | None) -> tuple[float, ...]:
    """Structure of a whole text, in the order of ``RANGES``; all shares are 0 for an empty one."""
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = text.split("\n")
    ends = Counter(w[-1] for w in words)
    return (
        (size - len(raw.translate(None, _ODD))) / size if raw else 0.0,
        (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / size,
        distinct / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        most / n,
        sum(map(len, words)) / n,
        sum(c for e, c in ends.items() if e in _MARKS) / n,
        len(set(lines)) / len(lines),
        (ends[ord(".")] + ends[ord("?")]) / n,
        len(words),
        -2 if declared is None or declared != declared else float(declared),
    )


def features(text: str | None, declared: float | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    place = np.array(_slots_of(known, list(counts)), dtype=np.int64)
    slots, at = np.unique(place, return_inverse=True)
    values = np.bincount(at, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=len(slots)) if len(place) else np.zeros(0)
    values /= max(np.sqrt((values**2).sum()), 1.0)
    told = statistics(text, raw, words, len(counts), max(counts.values(), default=0), declared)
    ranges = [offset + bisect_left(ends, v) for offset, ends, v in zip(_OFFSET.values(), RANGES.values(), told)]
    return np.concatenate([slots, ranges]).astype(np.int32), np.concatenate([values, np.full(len(ranges), 0.5)])


@dataclass
class Machine:
    """Bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores before the logistic of documents whose features start at ``rows``; no document is without any."""
        inner = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(inner, rows, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", inner, inner), rows)
        return self.bias + np.add.reduceat(self.linear[slots] * values, rows) + 0.5 * ((sums**2).sum(axis=1) - squares)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Fit by Adam on logistic loss; no rows give a machine that scores the share of label 1, or one half."""
    draw = np.random.default_rng(SEED)
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(SLOTS), draw.normal(0, 0.02, (SLOTS, RANK)))
    first = [np.zeros((SLOTS, RANK + 1)), np.zeros((SLOTS, RANK + 1))]
    step = 0
    while rows and step < STEPS:
        order = draw.permutation(len(rows))
        for at in range(0, min(len(order), (STEPS - step) * BATCH), BATCH):
            chosen = order[at : at + BATCH]
            slots, values = (np.concatenate([rows[i][k] for i in chosen]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in chosen])
            begin, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chosen)), sizes)
            error = _logistic(machine.margin(slots, values, begin)) - labels[chosen]
            inner = machine.factors[slots] * values[:, None]
            sums = np.add.reduceat(inner, begin, axis=0)
            pull = (error[owner] * values / len(chosen))[:, None] * np.hstack([np.ones((len(slots), 1)), sums[owner] - inner])
            used, place = np.unique(slots, return_inverse=True)
            slope = np.stack([np.bincount(place, weights=pull[:, k], minlength=len(used)) for k in range(RANK + 1)], axis=1)
            slope[:, 0] += DECAY * machine.linear[used]
            slope[:, 1:] += DECAY * machine.factors[used]
            step += 1
            mean, square = first
            mean[used] = 0.9 * mean[used] + 0.1 * slope
            square[used] = 0.99 * square[used] + 0.01 * slope**2
            move = RATE * (mean[used] / (1 - 0.9**step)) / (np.sqrt(square[used] / (1 - 0.99**step)) + 1e-8)
            machine.linear[used] -= move[:, 0]
            machine.factors[used] -= move[:, 1:]
            machine.bias -= RATE * error.mean()
    return machine


def held_out(id_col: str = "doc_id"):
    """Rows of which no label is learnt: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


_FEATURES = T.StructType([T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType())])


@F.pandas_udf(_FEATURES)
def _features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    memo: dict[bytes, int] = {}
    for texts, declared in batches:
        made = [features(t, d, memo) for t, d in zip(texts, declared)]
        yield pd.DataFrame({"slots": [s.tobytes() for s, _ in made], "values": [v.tobytes() for _, v in made]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out fifth; the bound also bounds what is broadcast and collected.

    An id with several labels has that of their majority, 0 at a tie; of rows that repeat an id the one of
    the least hash of its text counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.avg("quality") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _length(docs, length_col).alias("declared"))
    row = F.struct(F.xxhash64("text").alias("mark"), "text", "declared")
    one = told.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min(row).alias("row"))
    rows = one.select("id", "label", _features("row.text", "row.declared").alias("f")).select("id", "label", "f.*").toPandas().sort_values("id")
    made = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float64)) for s, v in zip(rows["slots"], rows["values"])]
    return fit(made, rows["label"].to_numpy(dtype=np.float64))


def _length(docs: DataFrame, length_col: str) -> Column:
    return (F.col(length_col) if length_col in docs.columns else F.lit(None)).cast("double")


def with_score(docs: DataFrame, machine: Machine, name: str, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` and a column ``name`` that none of theirs has."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[bytes, int] = {}
        machine = shared.value
        for texts, declared in batches:
            out, held, size = [], [], 0
            for text, length in zip(texts, declared):
                held.append(features(text, length, memo))
                size += len(held[-1][0])
                if size > 200_000:
                    out.append(_scored(machine, held))
                    held, size = [], 0
            if held:
                out.append(_scored(machine, held))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score(F.col(text_col), _length(docs, length_col)))


def _scored(machine: Machine, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    sizes = np.array([len(s) for s, _ in rows])
    slots, values = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    return _logistic(machine.margin(slots, values, np.cumsum(sizes) - sizes))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row.

    Null and empty texts are scored like any other; a null id is not held out; documents that repeat are
    scored each; without labels every document scores about one half; other columns are ignored.
    """
    rows = docs.select(id_col, text_col, *[c for c in ("n_chars",) if c in docs.columns])
    (name,) = unused(rows.columns, "score")
    scored = with_score(rows, train(docs, labels, sample, id_col, text_col), name, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= CUTOFF).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns.

    Null and empty texts, null ids and repeated rows are judged like any other; an empty table stays one.
    """
    (name,) = unused(docs.columns, "score")
    return with_score(docs, train(docs, labels, id_col=id_col, text_col=text_col), name, text_col).where(F.col(name) >= CUTOFF).drop(name)
