"""Registered queries of masks as runs, at the operators' own radius and black level, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseek.operators import areas, raster, runs
from gridseek.queries import _SQL_GRAY, _SQL_MASK, _SQL_RGB, HEIGHT, WIDTH, _gray, _mask, _query, _rgb, _size, _t

_SQL_STEPS = "st(k) AS (SELECT unnest(range(-3, 4)))"


def _sql_grown(name: str, src: str, width: str, height: str) -> str:
    """Dilation, one axis after the other."""
    return f"""{name}_x AS (SELECT DISTINCT y, x + k AS x FROM {src}, st WHERE x + k BETWEEN 0 AND {width} - 1),
{name} AS (SELECT DISTINCT y + k AS y, x FROM {name}_x, st WHERE y + k BETWEEN 0 AND {height} - 1)"""


def _sql_shrunk(name: str, src: str, width: str, height: str) -> str:
    """Erosion, one axis after the other: as many true cells as the neighbourhood has inside."""
    inside = lambda c, top: f"{c} BETWEEN 0 AND {top} - 1 AND count(*) = least({top} - 1, {c} + 3) - greatest(0, {c} - 3) + 1"
    return f"""{name}_x AS (SELECT y, x FROM (SELECT y, x + k AS x FROM {src}, st) GROUP BY y, x HAVING {inside("x", width)}),
{name} AS (SELECT y, x FROM (SELECT y + k AS y, x FROM {name}_x, st) GROUP BY y, x HAVING {inside("y", height)})"""


def _sql_runs(src: str) -> str:
    return f"""SELECT CAST(y AS INT) AS y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1
FROM (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS i FROM {src}) GROUP BY y, i"""


_SIDES = (str(WIDTH), str(HEIGHT))
_SQL_CLOSED = f"WITH {_SQL_MASK}, {_SQL_STEPS}, {_sql_grown('di', 'm', *_SIDES)}, {_sql_shrunk('cl', 'di', *_SIDES)}"


def _mask_runs(spark, sf_dir, least: int = 3):
    return raster.row_runs(_mask(spark, sf_dir, least)).drop("run")


@_query(f"WITH {_SQL_MASK}, {_SQL_STEPS}, {_sql_grown('di', 'm', *_SIDES)} SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM di")
def mask_dilated_3(spark, sf_dir):
    """Cells, at the usual radius."""
    return raster.dilate(_mask(spark, sf_dir), *_size(spark, sf_dir))


@_query(f"{_SQL_CLOSED} SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM cl")
def mask_closed_3(spark, sf_dir):
    """Closing of cells."""
    size = _size(spark, sf_dir)
    return raster.erode(raster.dilate(_mask(spark, sf_dir), *size), *size)


@_query(f"{_SQL_CLOSED}, {_sql_shrunk('er', 'cl', *_SIDES)}, {_sql_grown('op', 'er', *_SIDES)} {_sql_runs('op')}")
def mask_runs_closed_opened(spark, sf_dir):
    """Closing and opening of runs."""
    return runs.close_open(_mask_runs(spark, sf_dir), *_size(spark, sf_dir))


@_query(
    f"""WITH {_SQL_MASK}, m4 AS (SELECT CAST(floor(user_id / 3.0) AS INT) AS y, CAST(floor((epoch(ts) - 1704067200) / 21600) AS INT) AS x FROM events GROUP BY ALL HAVING count(*) >= 4),
{_SQL_STEPS}, {_sql_grown('di', 'm', *_SIDES)}, a AS (SELECT y, x, 1 AS w FROM di UNION ALL SELECT y + 1, x + 2, 2 FROM di),
s AS (SELECT y, x, sum(w) AS w FROM a GROUP BY y, x)
SELECT count(*) FILTER (w = 3) AS both, count(*) FILTER (w = 1) AS first_only, count(*) FILTER (w < 3) AS one_only, count(*) AS any FROM s"""
)
def mask_runs_sets(spark, sf_dir):
    """Set operations of a mask and itself moved by a row and two columns."""
    a = runs.dilate(_mask_runs(spark, sf_dir), *_size(spark, sf_dir))
    b = a.select((F.col("y") + 1).alias("y"), (F.col("x0") + 2).alias("x0"), (F.col("x1") + 2).alias("x1"))
    made = {"both": runs.intersection(a, b), "first_only": runs.difference(a, b), "one_only": runs.disagreement(a, b), "any": runs.union(a, b)}
    out = None
    for name, mask in made.items():
        one = runs.areas(mask).select(F.col("area").alias(name))
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))  # one row each
    return out


_SQL_HIGH = "(SELECT max(y) + 1 FROM px)"
_SQL_TISSUE = f"""WITH {_SQL_RGB}, m AS (SELECT y, x FROM px WHERE CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) END > 15 AND greatest(r, g, b) > 30 AND greatest(r, g, b) < 240),
{_SQL_STEPS}, {_sql_grown('di', 'm', '8', _SQL_HIGH)}, {_sql_shrunk('cl', 'di', '8', _SQL_HIGH)}, {_sql_shrunk('er', 'cl', '8', _SQL_HIGH)}, {_sql_grown('op', 'er', '8', _SQL_HIGH)}"""


@_query(f"{_SQL_TISSUE} {_sql_runs('op')}")
def hsv_tissue_runs(spark, sf_dir):
    """An image of all line items, eight columns wide."""
    pixels = _rgb(spark, sf_dir)
    high = (pixels.agg(F.max("y")).first()[0] or 0) + 1
    mask = raster.row_runs(raster.hsv_mask(pixels)).select(F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    return runs.close_open(mask, 8, high)


_SQL_OTSU_20 = f"""WITH {_SQL_GRAY}, h AS (SELECT g, CAST(count(*) AS DOUBLE) AS n FROM px WHERE g > 20 GROUP BY g),
c AS (SELECT g, sum(n) OVER o AS w0, sum(n * g) OVER o AS s0, sum(n) OVER () AS w, sum(n * g) OVER () AS s FROM h WINDOW o AS (ORDER BY g)),
v AS (SELECT g, round(w0 / w * (1 - w0 / w) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS v FROM c WHERE w > w0), best AS (SELECT g AS threshold, v AS variance FROM v ORDER BY v DESC, g LIMIT 1)"""


@_query(f"{_SQL_OTSU_20} SELECT threshold, round(variance, 3) AS variance FROM best")
def otsu_threshold_20(spark, sf_dir):
    """At the usual black level."""
    return raster.otsu(_gray(spark, sf_dir)).select("threshold", F.round("variance", 3).alias("variance"))


@_query(f"{_SQL_OTSU_20} SELECT event_id AS y, 0 AS x FROM px, best WHERE g > 20 AND g < threshold")
def otsu_mask_20(spark, sf_dir):
    """M7: at the usual black level."""
    return raster.otsu_mask(_gray(spark, sf_dir).withColumns({"y": F.col("event_id"), "x": F.lit(0)}))


@_query(
    f"""WITH {_SQL_MASK}, t AS (SELECT p_partkey AS tile_id, p_partkey % 130 - 5 AS x, p_partkey * 7 % 6000 - 5 AS y, 1 + p_size % 120 AS w, 1 + p_partkey % 1500 AS h FROM part),
c AS (SELECT tile_id, (least(x + w, {WIDTH}) - greatest(x, 0)) * (least(y + h, {HEIGHT}) - greatest(y, 0)) AS a, least(x + w, {WIDTH}) > greatest(x, 0) AND least(y + h, {HEIGHT}) > greatest(y, 0) AS ok FROM t)
SELECT t.tile_id, CASE WHEN any_value(ok) THEN round(count(m.x) / CAST(any_value(a) AS DOUBLE), 9) END AS covered
FROM t JOIN c USING (tile_id) LEFT JOIN m ON m.x >= t.x AND m.x < t.x + t.w AND m.y >= t.y AND m.y < t.y + t.h GROUP BY t.tile_id"""
)
def large_tile_coverage(spark, sf_dir):
    """By summed areas, tiles up to 120 by 1500 cells."""
    key = F.col("p_partkey")
    tiles = _t(spark, sf_dir, "part").select(key.alias("tile_id"), (key % 130 - 5).alias("x"), (key * 7 % 6000 - 5).alias("y"), (1 + F.col("p_size") % 120).alias("w"), (1 + key % 1500).alias("h"))
    return areas.coverage(tiles, _mask_runs(spark, sf_dir), *_size(spark, sf_dir)).select("tile_id", F.round("covered", 9).alias("covered"))
