"""Running sums and cuts inside a row, in time linear in all but very long arrays; DataFrame functions only.

An array that grows by one element in each step of a fold is copied each time. Both functions work in blocks of
``BLOCK`` elements, so that a row of a million elements copies about a hundred for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def _blocks(sizes: Column) -> Column:
    n = F.size(sizes)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, BLOCK))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<array<bigint>>"))


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)


def _plain_starts(sizes: Column, first: Column) -> Column:
    state = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(sizes, state, step, lambda s: s["out"])


def starts_of(sizes: Column) -> Column:
    """Where each of adjacent parts of the given sizes (``array<bigint>``) begins, from 0."""
    blocks = _blocks(sizes)
    offsets = _plain_starts(F.transform(blocks, _sum), F.lit(0))
    return F.flatten(F.zip_with(blocks, offsets, _plain_starts))


def cut(text: Column, sizes: Column) -> Column:
    """Adjacent parts of ``text`` of the given numbers of code points."""
    blocks = _blocks(sizes)
    offsets = _plain_starts(F.transform(blocks, _sum), F.lit(0))
    held = F.zip_with(blocks, offsets, lambda b, o: F.struct(b.alias("sizes"), _plain_starts(b, F.lit(0)).alias("starts"), F.substring(text, (o + 1).cast("int"), _sum(b).cast("int")).alias("text")))
    inner = lambda h: F.zip_with(h["sizes"], h["starts"], lambda n, at: F.substring(h["text"], (at + 1).cast("int"), n.cast("int")))
    return F.flatten(F.transform(held, inner))
