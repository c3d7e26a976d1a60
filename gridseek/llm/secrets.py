"""Secret scans with multipart credential linking (operator 5), DataFrame functions only.

Strong spans (assignments, access keys, long hexadecimal runs) are reported as they are. Weak parts - a
short assigned value, a shortened access key, a user name, an endpoint - are reported only where their
complement stands within ``SCOPE`` code points of the same text: an identifier needs a secret, a weak
secret an identifier, an endpoint both. Parts are joined by interval: places are cut into buckets as wide
as the scope, each bucket keeps the first and last place of every role, and a weak part meets its own and
the two next buckets, so that no pairs of parts are ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.llm.folds import starts_of
from gridseek.plans.durable import materialize

#: Fixed by the contract.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Of the method: parts that count only together. The SQL has their lower case only.
_SQL_USER = r"""(user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})"""
_SQL_ENDPOINT = r"(https?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9_.:/@?=&%-]{4,}"


def _either(words: str) -> str:
    """A pattern of words with its letters in either case, as classes."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


USER = "(" + _either("user|username|login|client_?id|account") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})"""
ENDPOINT = "(" + _either("https?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ftp") + r")://[A-Za-z0-9_.:/@?=&%-]{4,}"
MIN_ASSIGN, MIN_ACCESS, MIN_WEAK = 12, 18, 6
SCOPE = 200
#: In the order of spans that start together.
KINDS = ("assign", "access", "hex", "short", "key", "user", "endpoint")
#: Role of each kind: a part of an identifier, of a secret, or an endpoint.
ROLES = {"assign": "secret", "hex": "secret", "short": "secret", "access": "identifier", "key": "identifier", "user": "identifier", "endpoint": "endpoint"}
STRONG = ("assign", "access", "hex")
_SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``(start, end, match)`` in code points, in order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), m.alias("m")))
    starts = starts_of(F.transform(steps, lambda x: x["gap"] + F.length(x["m"])))

    def span(x: Column, at: Column) -> Column:
        first = at + x["gap"]
        return F.struct(first.alias("start"), (first + F.length(x["m"])).alias("end"), x["m"].alias("m"))

    return F.when(text.rlike(pattern), F.zip_with(steps, starts, span)).otherwise(none)


def _as_spans(matches: Column, kind: str, keep) -> Column:
    kept = F.filter(matches, keep)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"))).cast(_SPANS)


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, strong, weak)``: the spans of every row; ``mark`` tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")).select(
        "id", "mark", *(_matches(F.col("text"), p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("user", USER), ("endpoint", ENDPOINT)))
    )
    size = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2))
    length = lambda x: x["end"] - x["start"]
    strong = F.concat(
        _as_spans(F.col("assign"), "assign", lambda x: size(x) >= MIN_ASSIGN),
        _as_spans(F.col("access"), "access", lambda x: length(x) >= MIN_ACCESS),
        _as_spans(F.col("hex"), "hex", lambda x: F.lit(True)),
    )
    weak = F.concat(
        _as_spans(F.col("assign"), "short", lambda x: (size(x) < MIN_ASSIGN) & (size(x) >= MIN_WEAK)),
        _as_spans(F.col("access"), "key", lambda x: length(x) < MIN_ACCESS),
        _as_spans(F.col("user"), "user", lambda x: F.lit(True)),
        _as_spans(F.col("endpoint"), "endpoint", lambda x: F.lit(True)),
    )
    return rows.select("id", "mark", strong.alias("strong"), weak.alias("weak"))


def _linked(scanned: DataFrame) -> DataFrame:
    """``(id, mark, linked)``: the weak spans whose complement is in scope."""
    parts = scanned.where(F.size("weak") > 0).select("id", "mark", F.explode(F.concat("strong", "weak")).alias("span")).distinct()
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("span.rank") + 1)
    parts = parts.select("id", "mark", "span", role.alias("role"), F.floor(F.col("span.start") / SCOPE).alias("bucket"))
    edges = [
        f(F.when(F.col("role") == r, F.col("span.start"))).alias(f"{r}_{n}") for r in ("identifier", "secret") for n, f in (("first", F.min), ("last", F.max))
    ]
    held = parts.groupBy("id", "mark", "bucket").agg(*edges).withColumnsRenamed({"id": "id2", "mark": "mark2", "bucket": "bucket2"})
    near = parts.where(F.col("span.rank") >= len(STRONG)).withColumn("look", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")) & (F.col("look") == F.col("bucket2"))

    def seen(role: str) -> Column:
        first, last, at = F.col(f"{role}_first"), F.col(f"{role}_last"), F.col("span.start")
        inside = F.when(F.col("look") == F.col("bucket"), first.isNotNull())
        return F.coalesce(inside.when(F.col("look") > F.col("bucket"), first - at <= SCOPE).otherwise(at - last <= SCOPE), F.lit(False))

    met = near.join(held, same).groupBy("id", "mark", "span", "role").agg(
        F.max(seen("identifier")).alias("identifier"), F.max(seen("secret")).alias("secret")
    )
    wanted = (
        F.when(F.col("role") == "secret", F.col("identifier")).when(F.col("role") == "identifier", F.col("secret")).otherwise(F.col("identifier") & F.col("secret"))
    )
    return met.where(wanted).groupBy("id", "mark").agg(F.collect_list("span").cast(_SPANS).alias("linked"))


def _written(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row.

    ``spans`` lists strong and linked weak spans as ``kind:start:end`` by start and kind; ``base_sha256``
    is the digest of the strong ones written alike. Null and empty texts have no spans. Repeated rows
    come out as often as they come in; null ids keep their row; other columns are ignored.
    """
    scanned = materialize(_scanned(docs, id_col, text_col))
    linked = _linked(scanned).withColumnsRenamed({"id": "id2", "mark": "mark2"})
    rows = scanned.join(linked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    count = lambda k: F.size(F.filter("strong", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        *(count(k).alias(f"n_{k}") for k in STRONG),
        F.sha2(_written(F.col("strong")), 256).alias("base_sha256"),
        _written(F.concat("strong", F.coalesce("linked", F.array().cast(_SPANS)))).alias("spans"),
    )


def _sql_kind(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name}_m AS (SELECT rid, regexp_extract_all(t, '{quoted}') m, regexp_split_to_array(t, '{quoted}') g FROM d),
{name}_e AS (SELECT rid, m, g, unnest(range(1, len(m) + 1)) i FROM {name}_m),
{name} AS (SELECT rid, list_sum(list_transform(g[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) s, s + length(m[i]) e, m[i] v FROM {name}_e)"""


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    kinds = ",\n".join(_sql_kind(n, p) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("usr", _SQL_USER), ("endpt", _SQL_ENDPOINT)))
    assign = ASSIGN.replace("'", "''")
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
{kinds},
parts AS (
  SELECT rid, CAST(s AS BIGINT) s, CAST(e AS BIGINT) e, CASE WHEN length(regexp_extract(v, '{assign}', 2)) >= {MIN_ASSIGN} THEN 0 ELSE 3 END k
    FROM assign WHERE length(regexp_extract(v, '{assign}', 2)) >= {MIN_WEAK}
  UNION ALL SELECT rid, s, e, CASE WHEN length(v) >= {MIN_ACCESS} THEN 1 ELSE 4 END FROM access
  UNION ALL SELECT rid, s, e, 2 FROM hex UNION ALL SELECT rid, s, e, 5 FROM usr UNION ALL SELECT rid, s, e, 6 FROM endpt),
kept AS (
  SELECT * FROM parts p WHERE k < 3
    OR ((k NOT IN (3, 6) OR EXISTS (SELECT 1 FROM parts q WHERE q.rid = p.rid AND q.k IN (1, 4, 5) AND abs(q.s - p.s) <= {SCOPE}))
    AND (k NOT IN (4, 5, 6) OR EXISTS (SELECT 1 FROM parts q WHERE q.rid = p.rid AND q.k IN (0, 2, 3) AND abs(q.s - p.s) <= {SCOPE})))),
named AS (SELECT rid, s, k, ['{"','".join(KINDS)}'][k + 1] || ':' || s || ':' || e w FROM kept),
told AS (SELECT rid, count(*) FILTER (k = 0) a, count(*) FILTER (k = 1) c, count(*) FILTER (k = 2) h,
  string_agg(w, ',' ORDER BY s, k) FILTER (k < 3) base, string_agg(w, ',' ORDER BY s, k) spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0) n_assign, coalesce(c, 0) n_access, coalesce(h, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN told USING (rid)"""
