"""Line dedup by a log-template tree (operator 2), DataFrame functions only.

A line's tokens that hold a digit are variable fields. The tree has a fixed depth: lines go to a leaf by
their number of tokens and their first ``LEAD`` tokens. In a leaf, a token that stands at its position in
at least ``MIN_DOCS`` documents is constant and any other is a field, so that lines which differ in fields
only share a template. A template that recurs in ``MIN_DOCS`` documents and is constant in at least
``SHARE`` of its tokens is dropped everywhere but where it stands first, so that of copied documents one
keeps its text. A line that recurs in ``MIN_DOCS`` documents as it stands is a template of its own where its
masked form is none, whatever digits it holds.

Lines travel as 128-bit keys with their counts; only lines of leaves that are full enough, once each, are
cut into tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.plans.durable import broadcast_if_small, materialize, unused

MIN_DOCS, LEAD, SHARE = 5, 3, 0.6
FIELD = "<*>"
#: The fields that name a line's document: its id and a hash of its text.
_DOC = ("id", "mark")
_KEY = ("k1", "k2")


def spaced(line: Column) -> Column:
    """The line with single spaces; blank lines are empty."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """The line with single spaces and its tokens that hold a digit as fields; blank lines are empty."""
    plain = spaced(line)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, parts)``: documents and their lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("parts"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, line, k1, k2, leaf, v1, v2)`` of every line that isn't blank; ``v1`` and ``v2`` are null without a digit."""
    rows = _rows(docs, id_col, text_col).select(*_DOC, F.posexplode("parts").alias("line", "raw"))
    rows = rows.where(F.col("raw").rlike(r"[^ \t\r]")).select(*_DOC, "line", masked(F.col("raw")).alias("template"), spaced(F.col("raw")).alias("plain"))
    tokens = F.length("template") - F.length(F.replace("template", F.lit(" "))) + 1
    leaf = F.xxhash64(tokens, F.substring_index("template", " ", LEAD))
    digits = F.col("template") != F.col("plain")
    verbatim = [F.when(digits, F.xxhash64("plain")).alias("v1"), F.when(digits, F.xxhash64("plain", F.lit(2))).alias("v2")]
    return rows.select(*_DOC, "line", F.xxhash64("template").alias("k1"), F.xxhash64("template", F.lit(2)).alias("k2"), leaf.alias("leaf"), *verbatim)


def _templates(docs: DataFrame, occurrences: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """``(k1, k2, tree, first)`` of lines whose template recurs; ``first`` is its first place."""
    place = F.struct(*_DOC, "line").alias("first")
    once = occurrences.groupBy(*_KEY, "leaf", *_DOC).agg(F.min("line").alias("line"))
    lines = materialize(once.groupBy(*_KEY, "leaf").agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first")))
    leaves = lines.groupBy("leaf").agg(F.sum("docs").alias("held")).where(F.col("held") >= min_docs).select("leaf")
    lines = materialize(lines.join(leaves, "leaf"))

    # one text for each line that is left: documents that hold a first place give the lines there
    pick = F.struct(F.col("first.line").alias("line"), *_KEY, "leaf", "docs")
    heads = lines.groupBy(F.col("first.id").alias("id2"), F.col("first.mark").alias("mark2")).agg(F.collect_list(pick).alias("picks"))
    heads = materialize(heads)
    heads = broadcast_if_small(heads, held=heads.agg(F.sum(F.size("picks"))).first()[0] or 0)
    held = _rows(docs, id_col, text_col).join(heads, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")))
    told = F.transform("picks", lambda p: F.struct(*[p[c].alias(c) for c in (*_KEY, "leaf", "docs")], F.get("parts", p["line"]).alias("raw")))
    cut = held.select(F.explode(told).alias("p")).select("p.*").withColumn("template", masked(F.col("raw"))).dropDuplicates([*_KEY])
    tokens = cut.select(*_KEY, "leaf", "docs", F.posexplode(F.split("template", " ")).alias("at", "token"))
    tokens = materialize(tokens)
    # the first tokens are those of the whole leaf, which is full enough; only further ones are counted
    further = tokens.where((F.col("token") != FIELD) & (F.col("at") >= LEAD)).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("held"))
    common = materialize(further.where(F.col("held") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("seen")))
    first = F.when((F.col("at") < LEAD) & (F.col("token") != FIELD), True)
    told = tokens.join(broadcast_if_small(common), ["leaf", "at", "token"], "left").withColumn("constant", F.coalesce(first, "seen"))
    told = told.withColumn("token", F.when(F.col("constant"), F.col("token")).otherwise(FIELD))
    trees = told.groupBy(*_KEY, "leaf").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda t: t["token"]), " ").alias("tree"),
        (F.count("constant") / F.count(F.lit(1))).alias("share"),
    )
    trees = materialize(trees.where(F.col("share") >= SHARE).select(*_KEY, F.sha2("tree", 256).alias("tree")))

    known = once.join(broadcast_if_small(trees), [*_KEY]).groupBy("tree", *_DOC).agg(F.min("line").alias("line"))
    recurring = known.groupBy("tree").agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs)
    return materialize(trees.join(recurring.select("tree", "first"), "tree").select(*_KEY, "first"))


def _verbatim(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """``(v1, v2, first)`` of lines with digits that recur as they stand."""
    once = occurrences.where("v1 IS NOT NULL").groupBy("v1", "v2", *_DOC).agg(F.min("line").alias("line"))
    found = once.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*_DOC, "line")).alias("first"))
    return materialize(found.where(F.col("docs") >= min_docs).select("v1", "v2", "first"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``(id, mark, gone)``: numbers from 0 of the lines to drop, for documents that have some."""
    occurrences = materialize(_lines(docs, id_col, text_col))
    templates = broadcast_if_small(_templates(docs, occurrences, id_col, text_col, min_docs))
    place = F.struct(*_DOC, "line")
    gone = occurrences.join(templates, [*_KEY]).where(~place.eqNullSafe(F.col("first"))).select(*_DOC, "line")
    # of lines that a template covers its first place stays, so these don't count again
    others = occurrences.where("v1 IS NOT NULL").join(templates.select(*_KEY), [*_KEY], "left_anti")
    verbatim = broadcast_if_small(_verbatim(others, min_docs))
    gone = gone.union(others.join(verbatim, ["v1", "v2"]).where(~place.eqNullSafe(F.col("first"))).select(*_DOC, "line"))
    return gone.groupBy(*_DOC).agg(F.collect_set("line").alias("gone"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``text`` free of recurring lines; ``counts`` names two more columns, how many lines there were and went.

    Every row stays, if with an empty text. Null texts stay null. Blank lines are never dropped. Rows
    that repeat an id and a text lose the same lines and count as one document towards ``min_docs``; null
    ids come first. An empty table stays one; other columns pass.
    """
    name = dict(zip(("id", "mark", "lost", "own", "null", "parts"), unused([*docs.columns, *(counts or ())], "id", "mark", "lost", "own", "null", "parts")))
    gone = recurring_lines(docs, id_col, text_col, min_docs).withColumnsRenamed({"id": name["id"], "mark": name["mark"], "gone": name["lost"]})
    # the lines are cut before the join, so that reading one by its number doesn't cut the text again
    whole = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({name["own"]: F.xxhash64(whole), name["null"]: F.col(text_col).isNull(), name["parts"]: F.split(whole, "\n", -1)}).drop(text_col)
    joined = marked.join(gone, F.col(id_col).eqNullSafe(F.col(name["id"])) & (F.col(name["own"]) == F.col(name["mark"])), "left")
    parts, lost = F.col(name["parts"]), F.coalesce(F.col(name["lost"]), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost)
    cleaned = F.when(F.size(lost) == 0, F.array_join(parts, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    text = F.when(~F.col(name["null"]), cleaned).alias(text_col)
    ordered = [text if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    told = [F.size(x).cast("long").alias(c) for x, c in zip((parts, lost), counts or ())]
    return joined.select(*ordered, *told)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_lines, n_removed, kept_sha256, kept_chars)`` of every row."""
    lines, gone = unused([id_col, text_col], "n_lines", "n_removed")
    rows = drop_recurring_lines(docs.select(id_col, text_col), id_col, text_col, counts=(lines, gone))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(
        id_col,
        F.col(lines).alias("n_lines"),
        F.col(gone).alias("n_removed"),
        F.sha2(text, 256).alias("kept_sha256"),
        F.length(text).cast("long").alias("kept_chars"),
    )


ORACLE_SQL = rf"""WITH l AS (
  SELECT doc_id, i - 1 AS line, lines[i] AS raw,
    regexp_replace(trim(regexp_replace(lines[i], '[ \t\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS tpl
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
o AS (SELECT doc_id, line, tpl, string_split(tpl, ' ') AS w FROM l WHERE tpl <> ''),
one AS (SELECT tpl, any_value(w) AS w, len(any_value(w)) AS nt, array_to_string(any_value(w)[1:{LEAD}], ' ') AS lead, count(DISTINCT doc_id) AS docs FROM o GROUP BY tpl),
hot AS (SELECT * FROM one JOIN (SELECT nt, lead FROM one GROUP BY nt, lead HAVING sum(docs) >= {MIN_DOCS}) USING (nt, lead)),
tok AS (SELECT tpl, nt, lead, docs, unnest(range(1, nt + 1)) AS pos, unnest(w) AS token FROM hot),
com AS (SELECT nt, lead, pos, token, true AS con FROM tok WHERE token <> '{FIELD}' GROUP BY nt, lead, pos, token HAVING sum(docs) >= {MIN_DOCS}),
tree AS (SELECT tpl, string_agg(CASE WHEN con THEN token ELSE '{FIELD}' END, ' ' ORDER BY pos) AS tree
  FROM tok LEFT JOIN com USING (nt, lead, pos, token) GROUP BY tpl HAVING count(con) / count(*) >= {SHARE}),
seen AS (SELECT o.doc_id, o.line, tree.tree FROM o JOIN tree USING (tpl)),
rec AS (SELECT tree, min((doc_id, line)) AS first FROM seen GROUP BY tree HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT doc_id, line FROM seen JOIN rec USING (tree) WHERE (doc_id, line) <> first),
res AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256, length(kept) AS kept_chars FROM res"""
