"""License scans by sparse TF-IDF cosine and inheritance along paths (operator 8), DataFrame functions only.

Three kinds of units are compared with templates by one join: every line with ``TEMPLATES`` and ``NAMES``,
every block of several lines with ``HEADERS`` and the whole texts, and every text of several lines
with the whole texts, which are the files of ``license_texts``. A term weighs its count times
``ln((1 + N) / (1 + n)) + 1``, with n of the N documents holding it; terms of no template weigh as one that
no document holds. By the weights at hand a line without any of the heaviest terms of the templates cannot
reach ``LEAST``, so that only lines with one are cut into terms. Blocks and whole texts are taken of
documents that hold one of ``ANCHORS``, as every header and whole text does. Lines of copyright holders
don't count there. Of near templates those whose version numbers the unit lacks, or that differ from it in
a variant's term, are out. A line with an SPDX tag declares what the tag says.

A document that is a licence's whole text, that is named like a licence file and has a notice, or whose
notices are at least half of its lines is a licence file of its directory. A document without a notice of
its own inherits from the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.plans.durable import broadcast_if_small, materialize

#: Sentences by which licences are declared. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)
_GNU = (("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("LGPL", "Library General", ("2",)), ("AGPL", "Affero General", ("3",)))
_CC = tuple((f"CC-BY{x}-{v}", f"CC BY{x} {v}", full, v) for x, full in (
    ("", "Attribution"), ("-SA", "Attribution-ShareAlike"), ("-ND", "Attribution-NoDerivatives"), ("-NC", "Attribution-NonCommercial"),
    ("-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
) for v in ("3.0", "4.0"))
_dotted = lambda v: v if "." in v else f"{v}.0"
#: Further names and sentences, one line each.
NAMES = (
    ("MIT", "MIT License"), ("MIT", "Licensed under the MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "BSD 2-Clause Simplified License"), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "BSD 3-Clause New or Revised License"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("ISC", "ISC License"), ("ISC", "Licensed under the ISC License"), ("Zlib", "zlib License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."), ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *((f"{n}-{_dotted(v)}", f"GNU {full} Public License{sep} {form}") for n, full, vs in _GNU for v in vs for sep, form in ((",", f"version {v}"), ("", f"version {_dotted(v)}"), ("", f"v{v}"))),
    *((f"{n}-{_dotted(v)}", f"This work is licensed under the GNU {full} Public License, version {v}.") for n, full, vs in _GNU for v in vs),
    *((f"{n}-{_dotted(v)}", f"GNU {n} version {v}") for n, _, vs in _GNU for v in vs),
    *((f"{n}-{_dotted(v)}", f"Licensed under the {n}{tag}{v}") for n, _, vs in _GNU for v in vs for tag in ("v", " v", " version ")),
    *((n, f"{start}{short}") for n, short, _, _ in _CC for start in ("", "Licensed under ")),
    *((n, f"{start}Creative Commons {full} {v} International License") for n, _, full, v in _CC for start in ("", "This work is licensed under a ")),
)
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: Blocks of lines that stand at the head of files.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"{n}-{_dotted(v)}", f"This program {_FREE.format(full, v)}") for n, full, vs in _GNU for v in vs),
)
#: Every header and whole text holds one; so does its like.
ANCHORS = ("licen", "copyright", "permission", "warranty", "redistribut", "public domain")
#: Terms that tell variants of a licence apart. A template's digits are its version.
VARIANTS = ("lesser", "library", "affero", "nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike")
#: Terms without which a short name is a word like any other ("mit" in German).
NAMING = ("license", "licensed", "cc", "creative")
LEAST, WHOLE, HALF, DIGITS = 0.75, 0.85, 0.5, 6
#: Kinds of units, the wider ones later, and templates' kinds.
COPYRIGHT, LINE, BLOCK, FILE = -1, 0, 1, 2
_TERM = r"[a-z0-9]+"
_HOLDER = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|\u00a9|:|[12][0-9]{3})|\(c\)|\u00a9)[^\n]*$"
_GAP = r"\n(?:[^\p{L}\p{N}\n]*(?:\n|\z))+"
_RIGHTS = r"(?i)^.*copyright.*(?=all rights reserved)"
_SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)"
_NAMED = r"(?i)(?:^|/)(?:[^/]*[-_.])?(?:(?:un)?licen[sc]e|copying)(?:[-_.][^/]*)?$"


def template_terms(templates: tuple[tuple[str, str], ...] = TEMPLATES, first: int = 0) -> list[tuple[int, str, str, int]]:
    """``(template, licence, term, count)`` of fixed sentences, numbered from ``first``."""
    out = []
    for i, (name, text) in enumerate(templates, first):
        words = re.findall(_TERM, text.lower())
        out += [(i, name, w, words.count(w)) for w in sorted(set(words))]
    return out


def whole_texts() -> tuple[tuple[str, str], ...]:
    """Whole licences by name, without the lines of their copyright holders."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    holder = re.compile(r"^[\W_]*(?:copyright[ \t]*(?:\(c\)|\u00a9|:|[12][0-9]{3})|\(c\)|\u00a9).*$", re.I | re.M)
    texts = {f.name.removesuffix(".txt"): holder.sub("", f.read_text(encoding="utf-8")) for f in files}
    # of the Affero licence only its terms count here, which are those of the GPL under its name
    texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
    return tuple(texts.items())


def all_terms() -> list[tuple[int, str, str, int, int]]:
    """``(template, licence, term, count, kind)`` of all templates, ``TEMPLATES`` first."""
    out: list[tuple[int, str, str, int, int]] = []
    n = 0
    for kind, templates in ((LINE, TEMPLATES + NAMES), (BLOCK, HEADERS), (FILE, whole_texts())):
        out += [(*t, kind) for t in template_terms(templates, n)]
        n += len(templates)
    return out


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))


def _weights(docs: DataFrame, words: list[str]) -> tuple[dict[str, float], int]:
    """The weights of the templates' terms over all documents, and the number of documents."""
    held = F.filter(F.array_distinct(terms(F.col("text"))), lambda t: t.isin(words))
    # one count for each of a fixed list of terms; the empty one stands for all documents
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = dict(tuple(r) for r in counts.collect())
    n = total.get("", 0)
    return {w: math.log((1.0 + n) / (1.0 + total.get(w, 0))) + 1.0 for w in words}, n


def _marks(idf: dict[str, float], made: list[tuple[int, str, str, int, int]]) -> list[str]:
    """Terms of which every line that can reach ``LEAST`` of a template for lines holds one.

    Of each template the heaviest terms are taken until the others' share of its length is below ``LEAST``.
    """
    weights: dict[int, list[tuple[float, str]]] = {}
    for i, _, term, count, kind in made:
        if kind == LINE:
            weights.setdefault(i, []).append(((count * idf[term]) ** 2, term))
    out = set()
    for held in weights.values():
        whole = rest = sum(w for w, _ in held)
        for w, term in sorted(held, reverse=True):
            if rest < 0.99 * LEAST**2 * whole:
                break
            rest -= w
            out.add(term)
    return sorted(out)


def _units(docs: DataFrame) -> DataFrame:
    """``(id, mark, kind, line, raw)``: blocks of several lines by number, and texts of several lines, where they may be notices."""
    low = F.lower("text")
    may = F.lit(False)
    for anchor in ANCHORS:
        may = may | F.contains(low, F.lit(anchor))
    texts = docs.where(may & F.contains("text", F.lit("\n"))).select("id", "mark", F.regexp_replace("text", _HOLDER, "").alias("text"))
    whole = texts.select("id", "mark", F.lit(FILE).alias("kind"), F.lit(0).alias("line"), F.col("text").alias("raw"))
    blocks = texts.select("id", "mark", F.lit(BLOCK).alias("kind"), F.posexplode(F.split("text", _GAP, -1)).alias("line", "raw"))
    return whole.union(blocks.where(F.contains("raw", F.lit("\n"))))


def notices(docs: DataFrame) -> DataFrame:
    """``(id, mark, kind, line, license, score)``: the best template of every line, block and text that reaches ``LEAST``, or ``WHOLE`` of a whole licence.

    Ties go to the earlier template.
    """
    spark = docs.sparkSession
    known = all_terms()
    weights, n = _weights(docs, sorted({t for _, _, t, _, _ in known}))
    idf = F.broadcast(spark.createDataFrame(sorted(weights.items()), "term string, idf double"))  # as long as the fixed templates
    norms: dict[int, float] = {}
    needs: dict[int, set[str]] = {}
    for i, _, term, count, kind in known:
        norms[i] = norms.get(i, 0.0) + (count * weights[term]) ** 2
        if kind != FILE and (term in VARIANTS or re.fullmatch("[a-z]*[1-9]", term) or kind == LINE and i >= len(TEMPLATES) and term in NAMING):
            needs.setdefault(i, set()).add(term)
    parts = [(i, name, term, kind, count * weights[term] / math.sqrt(norms[i]), term in needs.get(i, ()), len(needs.get(i, ()))) for i, name, term, count, kind in known]
    made = F.broadcast(spark.createDataFrame(parts, "template int, license string, term string, made int, tw double, need boolean, needs int"))
    lines = docs.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    rights = F.col("raw").rlike(_RIGHTS)
    marked = F.col("raw").rlike(r"(?i)(?<![a-z0-9])(" + "|".join(_marks(weights, known)) + r")(?![a-z0-9])")
    tag = F.when(F.contains("raw", F.lit("SPDX-License-Identifier:")), F.regexp_extract("raw", _SPDX, 1))
    lines = lines.where(marked | F.contains("raw", F.lit("SPDX-License-Identifier:"))).withColumn("tag", F.coalesce(tag, F.lit("")))
    tags = lines.where("tag <> ''").select("id", "mark", F.lit(LINE).alias("kind"), "line", F.regexp_replace("tag", r"^([^ ]+?)(-only|-or-later|\+)$", "$1").alias("license"), F.lit(1.0).alias("score"))
    lines = lines.where("tag = ''").select("id", "mark", F.when(rights, COPYRIGHT).otherwise(LINE).alias("kind"), "line", F.when(rights, F.regexp_replace("raw", _RIGHTS, "")).otherwise(F.col("raw")).alias("raw"))
    unit = ["id", "mark", "kind", "line"]
    counts = lines.union(_units(docs)).select(*unit, F.explode(terms(F.col("raw"))).alias("term")).groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = materialize(counts)
    unknown = F.log(F.lit(1.0 + n)) + 1.0
    sizes = counts.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown))
    sizes = sizes.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count_if(F.col("term").isin(*VARIANTS)).alias("variants"))
    # lines meet sentences, blocks headers and whole texts, and texts whole texts
    meets = F.when(F.col("kind") == BLOCK, F.col("made") >= BLOCK).otherwise(F.col("made") == F.greatest("kind", F.lit(LINE)))
    dots = counts.join(idf, "term").join(made, "term").where(meets).groupBy(*unit, "template", "license", "made", "needs").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("tw")).alias("dot"), F.count_if("need").alias("has"), F.count_if(F.col("need") & F.col("term").isin(*VARIANTS)).alias("same")
    )
    told = sizes.select(*[F.col(c).alias(f"{c}2") for c in unit], "norm", "variants")
    same = dots["id"].eqNullSafe(told["id2"]) & (dots["mark"] == told["mark2"]) & (dots["kind"] == told["kind2"]) & (dots["line"] == told["line2"])
    score = F.round(F.col("dot") / F.col("norm"), DIGITS)
    fits = (F.col("made") == FILE) | ((F.col("has") == F.col("needs")) & (F.col("same") == F.col("variants")))
    scored = dots.join(told, same).where(fits).select(*unit, "template", "license", "made", score.alias("score")).where(F.col("score") >= F.when(F.col("made") == FILE, WHOLE).otherwise(LEAST))
    best = scored.groupBy(*unit).agg(F.max_by(F.struct("license", "score"), F.struct("score", (-F.col("template")).alias("first"))).alias("best"))
    return best.select(*unit, "best.license", "best.score").union(tags.distinct())


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ``''`` first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(id, path, license, evidence, score, n_notices)`` for every row.

    ``license`` is that of the best notice of the text (whole text before block before line before rights
    that are reserved to a copyright holder, ties to the earlier line), else that of the nearest directory
    above ``path`` whose licence file - whole texts and names first, then the one of most notices, ties to
    the least id - declares one, else null. ``evidence`` is ``notice``, ``inherited`` or null. Null and empty texts have
    no notice but inherit; a null path inherits from nowhere; rows that repeat an id and a text share
    their notices; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = files.select(F.col(id_col).alias("id"), F.xxhash64(text, F.col(path_col)).alias("mark"), F.col(path_col).alias("path"), text.alias("text"))
    # notices may repeat where rows do, so their rows are told apart by kind and line
    found = materialize(notices(rows))
    own = found.groupBy("id", "mark").agg(
        F.max_by(F.struct("license", "score"), F.struct("kind", "score", (-F.col("line")).alias("first"))).alias("own"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") <= LINE).alias("n_lines"), F.max(F.col("kind") == FILE).alias("whole"),
    )
    plain = rows.select("id", "mark", "path", F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).alias("lines"))
    told = plain.join(own.withColumnsRenamed({"id": "id2", "mark": "mark2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    told = materialize(told.select("id", "mark", "path", "own", F.coalesce("n", F.lit(0)).alias("n"), "n_lines", "whole", "lines"))
    folder = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    sure = F.col("whole") | F.col("path").rlike(_NAMED)
    least = F.min_by("own", F.struct((~sure).alias("unsure"), (-F.col("n")).alias("most"), "id", "mark"))
    homes = told.where((F.col("n") > 0) & (sure | (F.col("n_lines") >= HALF * F.col("lines"))) & F.col("path").isNotNull())
    homes = homes.groupBy(folder.alias("folder")).agg(least.alias("given"))
    above = told.where(F.col("own").isNull() & F.col("path").isNotNull()).select("path").distinct()
    above = above.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder"))
    near = above.join(broadcast_if_small(materialize(homes)), "folder").groupBy("path").agg(F.max_by("given", "depth").alias("given"))
    out = told.join(near.withColumnRenamed("path", "path2"), F.col("path") == F.col("path2"), "left")
    chosen = F.coalesce("own", "given")
    evidence = F.when(F.col("own").isNotNull(), "notice").when(F.col("given").isNotNull(), "inherited")
    return out.select(
        F.col("id").alias(id_col), "path", chosen["license"].alias("license"), evidence.alias("evidence"), chosen["score"].alias("score"), F.col("n").alias("n_notices")
    )


def document_path() -> Column:
    """Documents as files: the source is a directory, the language one below it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return F.concat_ws("/", part("source"), part("lang"), part("doc_id"))


def oracle_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL, for lines and ``TEMPLATES`` only."""
    rows = ", ".join(f"({i}, '{n}', '{t}', {c})" for i, n, t, c in template_terms())
    return rf"""WITH tt(template, license, term, tf) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') AS folder, coalesce(source, '_') AS top, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM d),
held AS (SELECT term, count(*) AS held FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT t.term, ln((1.0 + n) / (1.0 + coalesce(held, 0))) + 1.0 AS idf FROM (SELECT DISTINCT term FROM tt) t CROSS JOIN total LEFT JOIN held USING (term)),
tw AS (SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tw FROM tt JOIN idf USING (term)),
lines AS (SELECT doc_id, i - 1 AS line, l[i] AS raw FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d))),
c AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(
  translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM lines) GROUP BY ALL),
norm AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM (SELECT doc_id, line, tf * coalesce(idf, ln(1.0 + n) + 1.0) AS w FROM c CROSS JOIN total LEFT JOIN idf USING (term)) GROUP BY ALL),
dot AS (SELECT doc_id, line, template, license, sum(tf * idf * tw) AS dot FROM c JOIN idf USING (term) JOIN tw USING (term) GROUP BY ALL),
hit AS (SELECT doc_id, line, template, license, round(dot / norm, {DIGITS}) AS score FROM dot JOIN norm USING (doc_id, line)),
best AS (SELECT * FROM hit WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, template) = 1),
own AS (SELECT doc_id, license, score, count(*) OVER (PARTITION BY doc_id) AS n FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1),
size AS (SELECT doc_id, count(*) FILTER (trim(raw) <> '') AS lines FROM lines GROUP BY doc_id),
home AS (SELECT folder, license, score FROM d JOIN own USING (doc_id) JOIN size USING (doc_id) WHERE n >= {HALF} * lines
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, doc_id) = 1)
SELECT d.doc_id, d.folder || '/' || d.doc_id AS path, coalesce(own.license, home.license) AS license,
  CASE WHEN own.license IS NOT NULL THEN 'notice' WHEN home.license IS NOT NULL THEN 'inherited' END AS evidence,
  coalesce(own.score, home.score) AS score, coalesce(own.n, 0) AS n_notices
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN home ON home.folder = d.folder"""
