"""Fill-in-the-middle transformation (operator 11).

A text is cut into units by a pattern; ``regex`` finds them and a compact array keeps where each of them ends,
so that the ends of prefix and middle are two lookups, whatever the units are. Where the cuts lie, whether a
text stays plain and in which order its parts stand follow from a digest of the seed and the row's id alone:
a row gets the same result in any partition, order or retry.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import methodcaller

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.plans.durable import unused

#: One unit for each code point.
CODE_POINTS = r"(?s:.)"
PSM, SPM, PLAIN = "psm", "spm", "plain"
_END = methodcaller("end")


@dataclass(frozen=True)
class Plan:
    """How texts are rearranged: unit pattern, marks of prefix, suffix and middle, seed, and shares in hundredths."""

    unit: str = CODE_POINTS
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    seed: int = 1
    changed: int = 90
    suffix_first: int = 20

    def __post_init__(self):
        # a mark that starts inside another, or reaches over its end, would make reading back ambiguous
        for i, a in enumerate(self.marks):
            for j, b in enumerate(self.marks):
                tails = [a[k:] for k in range(i == j, len(a))]
                if not a or any(b.startswith(t) or t.startswith(b) for t in tails):
                    raise ValueError("marks have to differ, and none may overlap another")


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """Where each unit ends; what no unit covers belongs to the next one, or to the last."""
    ends = array("q" if len(text) > 0x7FFFFFFF else "i")
    ends.extend(map(_END, pattern.finditer(text)))
    full = np.diff(np.frombuffer(ends, ends.typecode), prepend=0) > 0  # an empty match is no unit
    if not full.all():
        ends = array(ends.typecode, np.frombuffer(ends, ends.typecode)[full].tobytes())
    if text and (not ends or ends[-1] < len(text)):
        ends[-1:] = array(ends.typecode, [len(text)])
    return ends


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the digest of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))  # type: ignore[return-value]


def arrange(plan: Plan, pattern: regex.Pattern, key: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, code points of the prefix, of the middle, output)``; a plain text has no parts."""
    ends = unit_ends(pattern, text)
    n = len(ends)
    first, second, third, fourth = draws(plan.seed, key)
    if not text or third % 100 >= plan.changed or any(m in text for m in plan.marks):
        return n, PLAIN, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    begin, end = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    p, s, m = plan.marks
    if fourth % 100 < plan.suffix_first:
        return n, SPM, begin, end - begin, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, PSM, begin, end - begin, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(plan: Plan, form: str, output: str) -> str:
    """The text that an output of this form was made of."""
    if form == PLAIN:
        return output
    p, s, m = plan.marks
    head, inner = (s, p) if form == SPM else (p, s)
    rest, middle = output[len(head) :].split(m)
    one, two = rest.split(inner)
    return two + middle + one if form == SPM else one + middle + two


_MADE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
    ]
)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(key: Column, text: Column, plan: Plan = Plan(), with_text: bool = True) -> Column:
    """A struct of units, form, sizes, output and digests; ``output`` is null without ``with_text``.

    The digest of the text is taken of what is read back from output and form. A null text counts as empty
    and a null key as an empty one; an empty text is plain, with no units.
    """

    @F.pandas_udf(_MADE)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(plan.unit)
        for keys, texts in batches:
            rows = []
            for k, t in zip(keys, texts):
                n, form, prefix, middle, output = arrange(plan, pattern, k, t)
                rows.append((n, form, prefix, middle, output if with_text else None, _digest(output), _digest(restore(plan, form, output))))
            out = pd.DataFrame(rows, columns=_MADE.names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return made(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def transform(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rearranged; all columns and rows stay.

    Null and empty texts become empty ones and stay plain; rows of one id are cut at the same draws; an empty
    table stays one.
    """
    (made,) = unused(docs.columns, "made")
    out = docs.withColumn(made, fill_in_middle(F.col(id_col), F.col(text_col), plan))
    return out.withColumn(text_col, F.col(made)["output"]).drop(made)


def fim_digests(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` of every row; other columns are ignored."""
    made = docs.select(F.col(id_col), fill_in_middle(F.col(id_col), F.col(text_col), plan, with_text=False).alias("made"))
    return made.select(id_col, *[F.col("made")[c].alias(c) for c in _MADE.names if c != "output"])


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
e AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e
),
g AS (SELECT *, t[1:a] AS pre, t[a + 1:b] AS mid, t[b + 1:] AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
