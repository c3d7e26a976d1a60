"""Registered queries over several slides at once, and those of pixel rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.functions import pixels
from gridseek.operators import fidelity, grid, levels, raster, regions, retrieval, tissue
from gridseek.operators.vectors import zero_non_finite
from gridseek.queries import _A_IN_B, _B_IN_A, _SQL_LEVELS, _levels, _query, _sql_images, _images, _t

# Pixels: an image of 22 x 17 for each nation.

_H, _W = 17, 22
_SQL_PX = f"""px AS (SELECT n_nationkey AS image_id, {_H} AS height, {_W} AS width, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
  CAST((y * 37 + x * 11 + n_nationkey * 5) % 256 AS INT) AS r, CAST((y * x * 3 + n_nationkey * 7) % 256 AS INT) AS g, CAST((x * 29 + y) % 256 AS INT) AS b
  FROM nation, LATERAL (SELECT unnest(range({_H})) AS y), LATERAL (SELECT unnest(range({_W})) AS x))"""


def _pixels(spark, sf_dir) -> DataFrame:
    n, y, x = F.col("n_nationkey"), F.col("y"), F.col("x")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cells = _t(spark, sf_dir, "nation").select("n_nationkey", each(_H).alias("y")).withColumn("x", each(_W))
    byte = lambda c: (c % 256).cast("int")
    return cells.select(
        n.alias("image_id"), F.lit(_H).alias("height"), F.lit(_W).alias("width"), "y", "x",
        byte(y * 37 + x * 11 + n * 5).alias("r"), byte(y * x * 3 + n * 7).alias("g"), byte(x * 29 + y).alias("b"),
    )


_RGB = ("r", "g", "b")
_SQL_INSIDE = f"pow(y - {_H // 2}, 2) + pow(x - {_W // 2}, 2) <= {(min(_H, _W) // 2) ** 2}"
_SQL_GAIN = f"(0.6::DOUBLE + 0.4::DOUBLE * exp(-(pow(y - {_H / 2}::DOUBLE, 2) + pow(x - {_W / 2}::DOUBLE, 2)) / (2 * pow(0.8::DOUBLE * {min(_H, _W) / 2}::DOUBLE, 2))))"


@_query(f"WITH {_SQL_PX} SELECT image_id, height, width, y, x, " + ", ".join(f"CASE WHEN {_SQL_INSIDE} THEN {c} ELSE 255 END AS {c}" for c in _RGB) + " FROM px")
def pixel_field_mask(spark, sf_dir):
    """M14."""
    return pixels.field_mask(_pixels(spark, sf_dir))


@_query(f"WITH {_SQL_PX} SELECT image_id, height, width, y, x, " + ", ".join(f"CAST(trunc({c} * {_SQL_GAIN}) AS INT) AS {c}" for c in _RGB) + " FROM px")
def pixel_vignette(spark, sf_dir):
    """M15."""
    return pixels.vignette(_pixels(spark, sf_dir))


_SQL_MIRROR = f"CASE WHEN {{0}} < 0 THEN -({{0}}) - 1 WHEN {{0}} >= {_W} THEN 2 * {_W} - 1 - ({{0}}) ELSE {{0}} END"


@_query(f"""WITH {_SQL_PX} SELECT p.image_id, p.height, p.width, p.y, p.x, a.r, p.g, c.b FROM px p
JOIN px a ON a.image_id = p.image_id AND a.y = p.y AND a.x = {_SQL_MIRROR.format("p.x - 2")} JOIN px c ON c.image_id = p.image_id AND c.y = p.y AND c.x = {_SQL_MIRROR.format("p.x + 2")}""")
def pixel_chromatic(spark, sf_dir):
    """M19."""
    return pixels.chromatic(_pixels(spark, sf_dir))


@_query("""SELECT o_orderkey AS id, CAST(least(255, greatest(0, trunc(v))) AS INT) AS r, CAST(least(255, greatest(0, trunc(v))) AS INT) AS g, CAST(least(255, greatest(0, trunc(v))) AS INT) AS b
FROM (SELECT o_orderkey, o_totalprice / 300 - 100 AS v FROM orders)""")
def pixel_rgb(spark, sf_dir):
    """Gray values beyond a byte."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 300 - 100).alias("v"))
    return pixels.as_rgb(o, ("v",))


_SQL_STEPS = "d(k) AS (SELECT unnest(range(-2, 3)))"


def _sql_dilate(name: str, src: str) -> str:
    return f"{name} AS (SELECT DISTINCT image_id, y + a.k AS y, x + b.k AS x FROM {src}, d a, d b WHERE y + a.k BETWEEN 0 AND {_H - 1} AND x + b.k BETWEEN 0 AND {_W - 1})"


def _sql_erode(name: str, src: str) -> str:
    return f"""{name} AS (SELECT s.image_id, s.y, s.x FROM {src} s, d a, d b LEFT JOIN {src} n ON n.image_id = s.image_id AND n.y = s.y + a.k AND n.x = s.x + b.k
  WHERE s.y + a.k BETWEEN 0 AND {_H - 1} AND s.x + b.k BETWEEN 0 AND {_W - 1} GROUP BY ALL HAVING count(*) = count(n.x))"""


_SQL_MORPH = ", ".join([_SQL_STEPS, _sql_dilate("m1", "mk"), _sql_erode("m2", "m1"), _sql_erode("m3", "m2"), _sql_dilate("m4", "m3")])
_SQL_HSV = "greatest(r, g, b) > 30 AND greatest(r, g, b) < 240 AND CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) END > 15"
_SQL_END = "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM m4"


@_query(f"WITH {_SQL_PX}, mk AS (SELECT image_id, y, x FROM px WHERE {_SQL_HSV}), {_SQL_MORPH} {_SQL_END}")
def hsv_tissue(spark, sf_dir):
    """Thresholds, closing and opening of many images in one job."""
    return tissue.tissue_cells(_pixels(spark, sf_dir), _W, _H, radius=2, slide="image_id")


@_query(f"""WITH {_SQL_PX}, gy AS (SELECT image_id, y, x, CAST(round(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) AS INT) AS v FROM px),
h AS (SELECT image_id, v, CAST(count(*) AS DOUBLE) AS n FROM gy WHERE v > 20 GROUP BY ALL),
c AS (SELECT image_id, v, sum(n) OVER o AS w0, sum(n * v) OVER o AS s0, sum(n) OVER e AS w, sum(n * v) OVER e AS s FROM h WINDOW o AS (PARTITION BY image_id ORDER BY v), e AS (PARTITION BY image_id)),
t AS (SELECT image_id, v AS threshold FROM c WHERE w > w0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(w0 / w * (1 - w0 / w) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) DESC, v) = 1),
mk AS (SELECT image_id, y, x FROM gy JOIN t USING (image_id) WHERE v > 20 AND v < threshold), {_SQL_MORPH} {_SQL_END}""")
def otsu_tissue(spark, sf_dir):
    """A threshold of its own for each image."""
    return tissue.tissue_cells(_pixels(spark, sf_dir), _W, _H, "otsu", radius=2, slide="image_id")


# Several slides in one job. Slides are remainders of keys.


@_query("""WITH s AS (SELECT slide_id, unnest([0, 1, 2, 3]) AS level FROM (SELECT DISTINCT CAST(n_nationkey % 4 AS INT) AS slide_id FROM nation)),
lv AS (SELECT slide_id, level, pow(2.0 + slide_id, level) AS ds, (0.2 + 0.1 * slide_id) * pow(2.0 + slide_id, level) AS mpp FROM s),
q AS (SELECT c_custkey AS id, CAST(c_custkey % 5 AS INT) AS slide_id, pow(2.0 + c_custkey % 5, c_custkey % 6) AS want FROM customer)
SELECT id, slide_id, (SELECT min(level) FROM lv WHERE lv.slide_id = q.slide_id AND abs(ds - want) / greatest(want, 1e-9) < 1e-3) AS exact_level,
coalesce((SELECT arg_max(level, ds) FROM lv WHERE lv.slide_id = q.slide_id AND ds <= want), 0) AS best_level FROM q""")
def slide_levels(spark, sf_dir):
    """F8, F9, F11 of several slides, one of which has no levels."""
    n = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).cast("int").alias("slide_id")).distinct()
    lv = n.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("ds", F.pow(2.0 + F.col("slide_id"), F.col("level")))
    k = F.col("c_custkey")
    asked = _t(spark, sf_dir, "customer").select(k.alias("id"), (k % 5).cast("int").alias("slide_id"), F.pow(2.0 + k % 5, k % 6).alias("want_ds"))
    exact = levels.matching_level(asked, lv, keys=("slide_id",)).withColumnRenamed("level", "exact_level")
    return levels.best_level(exact, lv, keys=("slide_id",)).select("id", "slide_id", "exact_level", F.col("level").alias("best_level"))


_SQL_BX = "bx AS (SELECT p_partkey % 3 AS slide_id, CAST(p_partkey // 3 AS INT) AS index, p_partkey * p_partkey * 37 % 4001 AS x, (p_partkey * p_partkey * 91 + p_partkey * 13) % 3989 AS y, 3 * (p_partkey % 9 + 1) * (p_partkey % 9 + 1) AS w, 2 * (p_partkey % 9 + 1) * (p_partkey % 9 + 1) AS h FROM part)"


@_query(f"""WITH RECURSIVE {_SQL_BX}, kp AS (SELECT * FROM bx a WHERE w * h >= (SELECT max(w * h) FROM bx b WHERE b.slide_id = a.slide_id) * 0.01),
f AS (SELECT * FROM kp a WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE a.slide_id = b.slide_id AND a.index <> b.index AND {_A_IN_B})),
pr AS (SELECT a.slide_id, a.index AS a, b.index AS b FROM f a JOIN f b ON a.slide_id = b.slide_id AND a.index < b.index AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
  WHERE NOT ({_A_IN_B}) AND NOT ({_B_IN_A})), ed AS (SELECT slide_id, a, b FROM pr UNION ALL SELECT slide_id, b, a FROM pr),
r AS (SELECT slide_id, index AS n, index AS s FROM f UNION SELECT ed.slide_id, ed.b, r.s FROM r JOIN ed ON ed.slide_id = r.slide_id AND ed.a = r.n), c AS (SELECT slide_id, n, min(s) AS root FROM r GROUP BY ALL),
g AS (SELECT f.slide_id, root, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1, count(*) AS n FROM f JOIN c ON c.slide_id = f.slide_id AND c.n = f.index GROUP BY ALL)
SELECT slide_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY root) - 1 AS INT) AS index, x, y, x1 - x AS w, y1 - y AS h, n FROM g""")
def slide_regions_merged(spark, sf_dir):
    """F5, A11, X7 of several slides."""
    k = F.col("p_partkey")
    s = k % 9 + 1
    boxes = _t(spark, sf_dir, "part").select(
        (k % 3).alias("slide_id"), F.floor(k / 3).cast("int").alias("index"), (k * k * 37 % 4001).alias("x"), ((k * k * 91 + k * 13) % 3989).alias("y"), (3 * s * s).alias("w"), (2 * s * s).alias("h")
    )
    return regions.merge_overlapping(regions.filter_regions(boxes, 0.01, "slide_id"), "slide_id")


@_query("""WITH RECURSIVE m AS (SELECT user_id % 2 AS slide_id, CAST(user_id // 6 AS INT) AS y, CAST(floor((epoch(ts) - 1704067200) / 21600) AS INT) AS x FROM events WHERE epoch(ts) >= 1704067200 GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT slide_id, y, x, y AS sy, x AS sx FROM m UNION SELECT m.slide_id, m.y, m.x, r.sy, r.sx FROM r JOIN m ON m.slide_id = r.slide_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
c AS (SELECT slide_id, y, x, min(CAST(sy AS BIGINT) * 2097152 + sx) AS label FROM r GROUP BY ALL),
b AS (SELECT slide_id, label, count(*) AS area, min(x) AS l, min(y) AS t, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM c GROUP BY ALL HAVING count(*) >= 3)
SELECT slide_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY t, l, label) - 1 AS INT) AS index, CAST(trunc(l * 3.7) AS INT) AS x, CAST(trunc(t * 2.3) AS INT) AS y, CAST(trunc(w * 3.7) AS INT) AS w, CAST(trunc(h * 2.3) AS INT) AS h, area FROM b""")
def slide_region_boxes(spark, sf_dir):
    """X6, A10 of several masks."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    cells = _t(spark, sf_dir, "events").where(seconds >= 0).select((F.col("user_id") % 2).alias("slide_id"), F.floor(F.col("user_id") / 6).cast("int").alias("y"), F.floor(seconds / 21600).cast("int").alias("x"))
    mask = cells.groupBy("slide_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("slide_id", "y", "x")
    return raster.region_boxes(mask, 3.7, 2.3, 3, "slide_id")


_SQL_SLIDES = """g AS (SELECT label AS slide_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS i, CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
gc AS (SELECT slide_id, i // 5 AS r, i % 5 AS c, f FROM g), ke AS (SELECT slide_id AS query_id, r - 1 AS qr, c - 1 AS qc, f AS qf FROM gc WHERE r BETWEEN 1 AND 2 AND c BETWEEN 1 AND 2 AND slide_id < 3),
w AS (SELECT slide_id, query_id, r - qr AS out_r, c - qc AS out_c, round(avg(list_inner_product(f, qf)), 9) AS score FROM gc, ke WHERE r >= qr AND c >= qc GROUP BY ALL HAVING count(*) = 4)"""


@_query(f"WITH {_SQL_SLIDES} SELECT slide_id, query_id, CAST(out_r AS INT) AS out_r, CAST(out_c AS INT) AS out_c, score FROM w QUALIFY row_number() OVER (PARTITION BY slide_id, query_id ORDER BY score DESC, out_r, out_c) = 1")
def slide_windows(spark, sf_dir):
    """Three kernels over ten slides in one job."""
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "embeddings").withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    g = e.select(F.col("label").alias("slide_id"), F.lit(0).alias("region_index"), F.lit("main").alias("kind"), F.floor(F.col("i") / 5).cast("int").alias("row"), (F.col("i") % 5).alias("col"), F.col("embedding").alias("feat"))
    cut = g.where("row BETWEEN 1 AND 2 AND col BETWEEN 1 AND 2 AND slide_id < 3")
    kernels = cut.select(F.col("slide_id").alias("query_id"), (F.col("row") - 1).alias("q_row"), (F.col("col") - 1).alias("q_col"), "feat")
    scores = retrieval.window_similarity(g, kernels, ("slide_id",), ("query_id",))
    return retrieval.best_per_region(scores, keys=("slide_id", "query_id")).select("slide_id", "query_id", "out_r", "out_c", "score")


# Features, coordinates and crops.


@_query("""WITH e AS (SELECT vec_id, [CASE WHEN vec_id % 7 = 0 AND i = 3 THEN 'nan'::DOUBLE WHEN vec_id % 11 = 0 AND i = 5 THEN 'inf'::DOUBLE ELSE CAST(embedding[i + 1] AS DOUBLE) END FOR i IN range(64)] AS f FROM embeddings)
SELECT vec_id, vec_id % 7 = 0 OR vec_id % 11 = 0 AS was_bad, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 0.0 ELSE round(list_sum(f), 6) END AS total FROM e""")
def non_finite_rows(spark, sf_dir):
    """F14."""
    bad = lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 3), float("nan")).when((F.col("vec_id") % 11 == 0) & (i == 5), float("inf")).otherwise(x.cast("double"))
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", bad).alias("feat"))
    total = F.aggregate("feat", F.lit(0.0), lambda s, x: s + x)
    return zero_non_finite(e).select("vec_id", "was_bad", F.round(total, 6).alias("total"))


@_query(f"""WITH {_SQL_LEVELS} SELECT o_orderkey AS id, CAST(trunc((o_orderkey % 5003) * ds / 37.5) AS INT) AS by_level, CAST(trunc((o_orderkey % 5003 - 2500) * mpp / 9.3) AS INT) AS by_mpp
FROM orders JOIN lv ON level = o_custkey % 5""")
def mask_coords(spark, sf_dir):
    """Mask cells of places at a level and at a resolution, negative ones too."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("level")).join(_levels(spark, sf_dir), "level")
    v = F.col("o_orderkey") % 5003
    return o.select(F.col("o_orderkey").alias("id"), raster.to_mask(v, F.col("ds"), F.lit(37.5)).alias("by_level"), raster.to_mask(v - 2500, F.col("mpp"), F.lit(9.3)).alias("by_mpp"))


@_query("""WITH m AS (SELECT CAST(floor(user_id / 3.0) AS INT) AS y, CAST(floor((epoch(ts) - 1704067200) / 21600) AS INT) AS x FROM events WHERE epoch(ts) >= 1704067200 GROUP BY ALL HAVING count(*) >= 3)
SELECT y, x FROM m WHERE x >= 6 AND x < 6 + 22 AND y >= 3 AND y < 3 + 13""")
def mask_slice_scaled(spark, sf_dir):
    """a rectangle of level pixels."""
    from gridseek.queries import _mask

    return raster.mask_slice(_mask(spark, sf_dir), 25, 13, 90, 55, 2.0, 8.0)


_SQL_MAIN = "SELECT id, r, c, CASE WHEN NOT layered THEN r * n_cols + c WHEN r < n_rows - 1 THEN r * (2 * n_cols - 1) + 2 * c ELSE (n_rows - 1) * (2 * n_cols - 1) + c END AS flat FROM gr, LATERAL (SELECT unnest(range(n_rows)) AS r), LATERAL (SELECT unnest(range(n_cols)) AS c)"


@_query(f"WITH {_sql_images(256)}, m AS ({_SQL_MAIN}) SELECT id AS map_id, CAST(r AS INT) AS \"row\", CAST(c AS INT) AS col, id * 100 + flat AS feat FROM m")
def layer_features(spark, sf_dir):
    """Features aligned with their tiles, and those of the main layer."""
    tiles = grid.patches(_images(spark, sf_dir, 256)).withColumnRenamed("id", "map_id")
    features = tiles.select("map_id", "flat_idx", (F.col("map_id") * 100 + F.col("flat_idx")).alias("feat"))
    aligned = grid.align_features(tiles, features)
    return grid.layer_features(tiles, aligned.select("map_id", "flat_idx", "feat"), "main")


@_query(f"""WITH {_sql_images(64)}, b AS (SELECT *, id % 3 * 10 + 5 AS pad, id % 200 AS top, id % 170 AS lft, 30 + id % 90 AS hh, 40 + id % 110 AS ww FROM gr WHERE n_rows > 4 AND n_cols > 4),
k AS (SELECT *, greatest(0, top // 64 - 1) AS r0, greatest(0, lft // 64 - 1) AS c0, least(n_rows, CAST(ceil((top + hh) / 64.0) AS INT) + 1) AS r1, least(n_cols, CAST(ceil((lft + ww) / 64.0) AS INT) + 1) AS c1 FROM b),
o AS (SELECT id, 'main' AS kind, r * 64 AS y, c * 64 AS x, CASE WHEN r < n_rows - 1 THEN r * (2 * n_cols - 1) + 2 * c ELSE (n_rows - 1) * (2 * n_cols - 1) + c END AS old_flat
  FROM k, LATERAL (SELECT unnest(range(n_rows)) AS r), LATERAL (SELECT unnest(range(n_cols)) AS c)
  UNION ALL SELECT id, 'overlap', r * 64 + 32, c * 64 + 32, r * (2 * n_cols - 1) + 2 * c + 1 FROM k, LATERAL (SELECT unnest(range(n_rows - 1)) AS r), LATERAL (SELECT unnest(range(n_cols - 1)) AS c)),
n AS (SELECT id, 'main' AS kind, r AS "row", c AS col, (r0 + r) * 64 AS y, (c0 + c) * 64 AS x FROM k, LATERAL (SELECT unnest(range(r1 - r0)) AS r), LATERAL (SELECT unnest(range(c1 - c0)) AS c)
  UNION ALL SELECT id, 'overlap', r, c, (r0 + r) * 64 + 32, (c0 + c) * 64 + 32 FROM k, LATERAL (SELECT unnest(range(r1 - r0 - 1)) AS r), LATERAL (SELECT unnest(range(c1 - c0 - 1)) AS c) WHERE r1 - r0 > 1 AND c1 - c0 > 1)
SELECT id, kind, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(n.y AS INT) AS y, CAST(n.x AS INT) AS x, CAST(old_flat AS INT) AS old_flat FROM n JOIN o USING (id, kind, y, x)""")
def crop_patches(spark, sf_dir):
    """Crops in pixels with a padding in pixels, tiles of both layers and their old numbers."""
    k = F.col("id")
    images = _images(spark, sf_dir, 64).where("floor(height / 64) > 4 AND floor(width / 64) > 4")
    crops = grid.crop(images, k % 200, k % 170, height=30 + k % 90, width=40 + k % 110, unit="pixel", pad=k % 3 * 10 + 5)
    return grid.cropped_patches(crops).select("id", "kind", "row", "col", "y", "x", "old_flat")


@_query("""WITH p AS (SELECT o_orderkey AS id, o_custkey % 900 AS x0, o_custkey % 700 AS y0, o_custkey % 900 + o_orderkey % 60 AS true_x0, o_custkey % 700 - o_orderkey % 80 AS true_y0, 0.25::DOUBLE AS base_mpp, 1.0 + o_orderkey % 3 AS ds FROM orders),
e AS (SELECT id, round(sqrt(pow(x0 - true_x0, 2) + pow(y0 - true_y0, 2)) * base_mpp, 6) AS error_um, round(40 * ds * base_mpp, 6) AS tolerance_um FROM p)
SELECT id, error_um, tolerance_um, CASE WHEN error_um <= tolerance_um THEN 'PASS' ELSE 'WARN' END AS verdict FROM e""")
def place_errors(spark, sf_dir):
    """A21."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pairs = _t(spark, sf_dir, "orders").select(
        k.alias("id"), (c % 900).alias("x0"), (c % 700).alias("y0"), (c % 900 + k % 60).alias("true_x0"), (c % 700 - k % 80).alias("true_y0"), F.lit(0.25).alias("base_mpp"), (1.0 + k % 3).alias("ds")
    )
    return fidelity.place_errors(pairs, 40).select("id", "error_um", "tolerance_um", "verdict")


# Accuracy of several encoders at once: one loses every eighth component, the other every third.

_SQL_CONFIGS = """ba AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), cf(config, step) AS (VALUES ('every 8th', 8), ('every 3rd', 3)),
ot AS (SELECT config, vec_id AS id, [CASE WHEN i % step = 0 THEN 0.0 ELSE CAST(embedding[i + 1] AS DOUBLE) END FOR i IN range(64)] AS f FROM embeddings, cf),
co AS (SELECT config, round(list_inner_product(ba.f, ot.f) / (sqrt(list_inner_product(ba.f, ba.f)) * sqrt(list_inner_product(ot.f, ot.f))), 9) AS cos FROM ba JOIN ot USING (id)),
st AS (SELECT config, count(*) AS n, round(avg(cos), 6) AS mean, round(stddev_pop(cos), 6) AS std, {cuts} FROM co GROUP BY config),
xs AS (SELECT a.id AS q, b.id AS r, round(list_inner_product(a.f, b.f), 9) AS sim FROM ba a JOIN ba b ON a.id <> b.id),
x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS k FROM xs),
ys AS (SELECT a.config, a.id AS q, b.id AS r, round(list_inner_product(a.f, b.f), 9) AS sim FROM ot a JOIN ot b ON a.config = b.config AND a.id <> b.id),
y AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY sim DESC, r) AS k FROM ys),
ov AS (SELECT config, {overlaps} FROM y JOIN x USING (q, r) GROUP BY config),
sh AS (SELECT config, round(median(CAST(y.k - 1 AS DOUBLE)), 6) AS shift_median, round(quantile_cont(CAST(y.k - 1 AS DOUBLE), 0.95), 6) AS shift_p95 FROM y JOIN x USING (q, r) WHERE x.k = 1 GROUP BY config),
pr AS (SELECT ys.config, xs.sim AS a, ys.sim AS b FROM ys JOIN xs USING (q, r) WHERE q < r),
rk AS (SELECT config, rank() OVER (PARTITION BY config ORDER BY a) + (count(*) OVER (PARTITION BY config, a) - 1) / 2.0 AS p, rank() OVER (PARTITION BY config ORDER BY b) + (count(*) OVER (PARTITION BY config, b) - 1) / 2.0 AS q FROM pr),
sp AS (SELECT config, count(*) AS n_pairs, round(corr(p, q), 6) AS rho FROM rk GROUP BY config)""".format(
    cuts=", ".join(f"round(quantile_cont(cos, {p / 100}), 6) AS p{p}" for p in fidelity.PERCENTILES),
    overlaps=", ".join(f"round(count(*) FILTER (x.k <= {k} AND y.k <= {k}) / CAST((SELECT count(*) FROM ba) * {k} AS DOUBLE), 6) AS overlap_{k}" for k in (1, 5, 10, 50)),
)


@_query(f"WITH {_SQL_CONFIGS} SELECT * FROM st JOIN ov USING (config) JOIN sh USING (config) JOIN sp USING (config)")
def encoder_report(spark, sf_dir):
    """A13-A16 of all encoders in one job."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"))
    configs = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(n).alias("step")) for c, n in (("every 8th", 8), ("every 3rd", 3))]))
    coarse = F.transform("feat", lambda x, i: F.when(i % F.col("c.step") == 0, F.lit(0.0)).otherwise(x))
    others = e.withColumn("c", configs).select("c.config", "id", coarse.alias("feat"))
    return fidelity.fidelity_report(e, others)
