"""Registered queries over the driver's tables and their SQL, one pair for each operator that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseek.functions import image
from gridseek.functions.image import IMAGE, encode_row
from gridseek.functions.parsing import pixel_count
from gridseek.operators import fidelity, grid, knn, levels, localize, raster, regions, retrieval, rollup, sampling, tiling
from gridseek.operators.vectors import dot, normalized, top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Grids and coordinates. Images are as large as orders' keys say.


def _images(spark, sf_dir, tile: int) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    size = lambda c: (F.lit(64) + F.col(c) % 1000).cast("int")
    return o.select(F.col("o_orderkey").alias("id"), size("o_orderkey").alias("width"), size("o_custkey").alias("height"), F.lit(tile).alias("tile"))


def _sql_images(tile: int) -> str:
    return f"""im AS (SELECT o_orderkey AS id, CAST(64 + o_orderkey % 1000 AS INT) AS width, CAST(64 + o_custkey % 1000 AS INT) AS height, {tile} AS tile FROM orders),
gr AS (SELECT *, height // tile AS n_rows, width // tile AS n_cols, height // tile >= 2 AND width // tile >= 2 AS layered FROM im)"""


def _shape(df: DataFrame) -> DataFrame:
    rows, cols = grid.tile_counts(F.col("width"), F.col("height"), F.col("tile"))
    df = df.withColumns({"n_rows": rows, "n_cols": cols})
    return df.withColumn("layered", grid.has_overlap(F.col("n_rows"), F.col("n_cols")))


@_query(
    f"""WITH {_sql_images(64)} SELECT id, n_rows, n_cols, layered,
n_rows * n_cols + CASE WHEN layered THEN (n_rows - 1) * (n_cols - 1) ELSE 0 END AS n_tiles,
CASE WHEN layered THEN 2 * n_rows - 1 ELSE n_rows END AS u_rows, CASE WHEN layered THEN 2 * n_cols - 1 ELSE n_cols END AS u_cols FROM gr"""
)
def grid_counts(spark, sf_dir):
    """G1, G3, G4, G14."""
    r, c, b = F.col("n_rows"), F.col("n_cols"), F.col("layered")
    u_rows, u_cols = grid.unified_shape(r, c, b)
    return _shape(_images(spark, sf_dir, 64)).select("id", "n_rows", "n_cols", "layered", grid.grid_length(r, c, b).alias("n_tiles"), u_rows.alias("u_rows"), u_cols.alias("u_cols"))


@_query(
    f"""WITH {_sql_images(256)},
m AS (SELECT id, 'main' AS kind, r, c, 256 * r AS y, 256 * c AS x, CASE WHEN NOT layered THEN r * n_cols + c WHEN r < n_rows - 1 THEN r * (2 * n_cols - 1) + 2 * c ELSE (n_rows - 1) * (2 * n_cols - 1) + c END AS flat_idx,
  CASE WHEN layered THEN 2 * r ELSE r END AS u_row, CASE WHEN layered THEN 2 * c ELSE c END AS u_col FROM gr, LATERAL (SELECT unnest(range(n_rows)) AS r), LATERAL (SELECT unnest(range(n_cols)) AS c)),
o AS (SELECT id, 'overlap' AS kind, r, c, 256 * r + 128 AS y, 256 * c + 128 AS x, r * (2 * n_cols - 1) + 2 * c + 1 AS flat_idx, 2 * r + 1 AS u_row, 2 * c + 1 AS u_col
  FROM gr, LATERAL (SELECT unnest(range(n_rows - 1)) AS r), LATERAL (SELECT unnest(range(n_cols - 1)) AS c) WHERE layered)
SELECT id, kind, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 256 AS size_px, CAST(flat_idx AS INT) AS flat_idx, CAST(u_row AS INT) AS u_row, CAST(u_col AS INT) AS u_col
FROM (SELECT * FROM m UNION ALL SELECT * FROM o)"""
)
def grid_patches(spark, sf_dir):
    """G2, G9, S1."""
    return grid.patches(_images(spark, sf_dir, 256)).select("id", "kind", "row", "col", "y", "x", "size_px", "flat_idx", "u_row", "u_col")


@_query(
    f"""WITH {_sql_images(128)}, f AS (SELECT *, CAST(id % 40 AS INT) AS flat, 2 * n_cols - 1 AS wide FROM gr),
g AS (SELECT *, flat < n_rows * n_cols + CASE WHEN layered THEN (n_rows - 1) * (n_cols - 1) ELSE 0 END AS inside, flat < (n_rows - 1) * wide AS body FROM f),
h AS (SELECT *, CASE WHEN NOT inside THEN NULL WHEN NOT layered THEN flat // n_cols WHEN body THEN flat // wide ELSE n_rows - 1 END AS r FROM g),
k AS (SELECT *, CASE WHEN NOT inside THEN NULL WHEN NOT layered THEN flat - r * n_cols ELSE flat - r * wide END AS slot FROM h)
SELECT id, flat, CASE WHEN inside THEN CASE WHEN layered AND body AND slot % 2 = 1 THEN 'overlap' ELSE 'main' END END AS kind,
CAST(r AS INT) AS "row", CAST(CASE WHEN layered AND body THEN slot // 2 ELSE slot END AS INT) AS col FROM k"""
)
def flat_to_unified(spark, sf_dir):
    """Places of flat numbers, null outside the grid."""
    df = _shape(_images(spark, sf_dir, 128)).withColumn("flat", (F.col("id") % 40).cast("int"))
    at = grid.locate_flat(F.col("flat"), F.col("n_rows"), F.col("n_cols"), F.col("layered"))
    return df.withColumn("at", at).select("id", "flat", "at.kind", "at.row", "at.col")


@_query(
    f"""WITH {_sql_images(128)}, u AS (SELECT *, CAST(id % 9 AS INT) AS ur, CAST(id // 9 % 9 AS INT) AS uc FROM gr),
v AS (SELECT *, ur < CASE WHEN layered THEN 2 * n_rows - 1 ELSE n_rows END AND uc < CASE WHEN layered THEN 2 * n_cols - 1 ELSE n_cols END AS inside FROM u),
k AS (SELECT *, CASE WHEN NOT inside THEN NULL WHEN NOT layered OR (ur % 2 = 0 AND uc % 2 = 0) THEN 'main' WHEN ur % 2 = 1 AND uc % 2 = 1 THEN 'overlap' END AS kind FROM v),
p AS (SELECT *, CASE WHEN layered THEN ur // 2 ELSE ur END AS r, CASE WHEN layered THEN uc // 2 ELSE uc END AS c FROM k)
SELECT id, ur, uc, kind, CAST(CASE WHEN kind IS NULL THEN NULL WHEN kind = 'overlap' THEN r * (2 * n_cols - 1) + 2 * c + 1
 WHEN NOT layered THEN r * n_cols + c WHEN r < n_rows - 1 THEN r * (2 * n_cols - 1) + 2 * c ELSE (n_rows - 1) * (2 * n_cols - 1) + c END AS INT) AS flat FROM p"""
)
def unified_to_flat(spark, sf_dir):
    """Flat numbers of unified places, null out of bounds or at mixed parity."""
    df = _shape(_images(spark, sf_dir, 128)).withColumns({"ur": (F.col("id") % 9).cast("int"), "uc": (F.floor(F.col("id") / 9) % 9).cast("int")})
    df = df.withColumn("at", grid.locate_unified(F.col("ur"), F.col("uc"), F.col("n_rows"), F.col("n_cols"), F.col("layered")))
    row, col = F.col("at.row"), F.col("at.col")
    main = grid.flat_of_main(row, col, F.col("n_rows"), F.col("n_cols"), F.col("layered"))
    flat = F.when(F.col("at.kind") == "overlap", grid.flat_of_overlap(row, col, F.col("n_cols"))).when(F.col("at.kind") == "main", main)
    return df.select("id", "ur", "uc", "at.kind", flat.alias("flat"))


@_query("SELECT o_orderkey AS id, CAST(trunc((o_orderkey % 10007) * (1 + o_custkey % 7 * 0.5)) AS INT) AS x0, CAST(floor(((o_orderkey % 997) - 500) / 64.0) AS INT) AS down, CAST(ceil(((o_orderkey % 997) - 500) / 64.0) AS INT) AS up FROM orders")
def level0_coords(spark, sf_dir):
    """Level-0 pixels, and grid places below 0 too."""
    o = _t(spark, sf_dir, "orders")
    ds, p = F.lit(1) + F.col("o_custkey") % 7 * F.lit(0.5), F.col("o_orderkey") % 997
    at = lambda up: grid.pixel_to_grid(p, F.lit(500), F.lit(64), up)
    return o.select(F.col("o_orderkey").alias("id"), grid.level0(F.col("o_orderkey") % 10007, ds).alias("x0"), at(False).alias("down"), at(True).alias("up"))


@_query("""WITH q AS (SELECT o_orderkey AS id, 1 + o_orderkey % 16 AS a, 1 + o_custkey % 9 AS b, 0.5 + o_orderkey % 20 AS mp FROM orders)
SELECT id, CAST(trunc(sqrt(mp * 1e6 / (CAST(a AS DOUBLE) * b)) * a) AS INT) AS width, CAST(trunc(sqrt(mp * 1e6 / (CAST(a AS DOUBLE) * b)) * b) AS INT) AS height FROM q""")
def query_dims(spark, sf_dir):
    """G16."""
    o = _t(spark, sf_dir, "orders")
    ratio = F.concat_ws(":", (F.col("o_orderkey") % 16 + 1).cast("string"), (F.col("o_custkey") % 9 + 1).cast("string"))
    w, h = grid.query_size(ratio, F.lit(0.5) + F.col("o_orderkey") % 20)
    return o.select(F.col("o_orderkey").alias("id"), w.alias("width"), h.alias("height"))


@_query("""WITH q AS (SELECT c_custkey AS id, unnest(['16M','4K','1500','bad', '2k'])  AS t FROM customer)
SELECT id, t, CASE upper(regexp_extract(t, '^([0-9]+)([MmKk]?)$', 2)) WHEN 'M' THEN 1000000 WHEN 'K' THEN 1000 ELSE 1 END * TRY_CAST(nullif(regexp_extract(t, '^([0-9]+)([MmKk]?)$', 1), '') AS BIGINT) AS n FROM q""")
def pixel_counts(spark, sf_dir):
    """Numbers of pixels written like 16M or 4K."""
    t = F.explode(F.array(*map(F.lit, ("16M", "4K", "1500", "bad", "2k"))))
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), t.alias("t")).withColumn("n", pixel_count(F.col("t")))


@_query(f"""WITH {_sql_images(64)}, p AS (SELECT *, id % 3 AS pad, id % 5 AS top, id % 4 AS lft FROM gr)
SELECT id, CAST(greatest(0, top - pad) AS INT) AS r0, CAST(greatest(0, lft - pad) AS INT) AS c0, CAST(least(n_rows, top + 3 + pad) AS INT) AS r1, CAST(least(n_cols, lft + 2 + pad) AS INT) AS c1,
CAST(greatest(0, width // 3 - pad * 64) AS INT) AS w0, CAST(least(width, width // 3 + CAST(ceil(100 / 64.0) AS INT) * 64 + pad * 64) AS INT) AS w1 FROM p""")
def crop_windows(spark, sf_dir):
    """Crops in grid units and search windows in pixels, kept inside."""
    df = _shape(_images(spark, sf_dir, 64)).withColumns({"pad": F.col("id") % 3, "top": F.col("id") % 5, "lft": F.col("id") % 4})
    crop = grid.crop_window(F.col("top"), F.col("lft"), F.col("top") + 3, F.col("lft") + 2, F.col("pad"), F.col("n_rows"), F.col("n_cols"))
    w0, w1 = grid.search_window(F.floor(F.col("width") / 3), F.lit(100), F.lit(64), F.col("pad"), F.col("width"))
    return df.select("id", *[c.alias(n) for n, c in crop.items()], w0.alias("w0"), w1.alias("w1"))


@_query(f"""WITH {_sql_images(256)},
t AS (SELECT id, unnest(range(n_rows)) AS r, n_cols FROM gr WHERE n_cols > 0), u AS (SELECT id, r, unnest(range(n_cols)) AS c FROM t)
SELECT id, CAST(r AS INT) AS old_row, CAST(c AS INT) AS old_col, CAST(r - 1 AS INT) AS new_row, CAST(c AS INT) AS new_col FROM u WHERE r >= 1""")
def crop_remap(spark, sf_dir):
    """Main tiles of a crop without the first row, matched to the old grid by their place."""
    old = grid.patches(_images(spark, sf_dir, 256), overlap=False)
    smaller = _images(spark, sf_dir, 256).where("height >= 512").withColumns({"height": F.col("height") - 256, "y_off": F.lit(256)})
    new = grid.patches(smaller, overlap=False).select("id", "x", "y", "kind", F.col("row").alias("new_row"), F.col("col").alias("new_col"))
    return old.select("id", "x", "y", "kind", F.col("row").alias("old_row"), F.col("col").alias("old_col")).join(new, ["id", "x", "y", "kind"]).drop("x", "y", "kind")


@_query("""WITH RECURSIVE s AS (SELECT o_orderkey AS id, 3000 + o_orderkey % 9000 AS h, 3000 + o_custkey % 9000 AS w, 1 AS n_h, 1 AS n_w FROM orders
UNION ALL SELECT id, h, w, CASE WHEN h // n_h >= w // n_w THEN 2 * n_h ELSE n_h END, CASE WHEN h // n_h >= w // n_w THEN n_w ELSE 2 * n_w END FROM s WHERE (h // n_h) * (w // n_w) > 4000000)
SELECT id, CAST(max(n_h) AS INT) AS n_h, CAST(max(n_w) AS INT) AS n_w FROM s GROUP BY id""")
def tile_plan(spark, sf_dir):
    """Cuts of large rasters under a budget of pixels."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (3000 + F.col("o_orderkey") % 9000).alias("height"), (3000 + F.col("o_custkey") % 9000).alias("width"))
    return tiling.tile_plan(o, 4_000_000).select("id", "n_h", "n_w")


@_query("""WITH p AS (SELECT p_partkey AS id, 100 + p_partkey % 900 AS h, 100 + p_size * 7 AS w FROM part),
i AS (SELECT *, unnest(range(3)) AS i FROM p), j AS (SELECT *, unnest(range(2)) AS j FROM i),
e AS (SELECT *, i * (h // 3) AS y0, CASE WHEN i = 2 THEN h ELSE (i + 1) * (h // 3) END AS y1, j * (w // 2) AS x0, CASE WHEN j = 1 THEN w ELSE (j + 1) * (w // 2) END AS x1 FROM j)
SELECT id, i, j, y0, y1, x0, x1, greatest(0, y0 - 16) AS wy0, least(h, y1 + 16) AS wy1, greatest(0, x0 - 16) AS wx0, least(w, x1 + 16) AS wx1 FROM e""")
def halo_tiles(spark, sf_dir):
    """Parts with a halo."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (100 + F.col("p_partkey") % 900).cast("int").alias("height"), (100 + F.col("p_size") * 7).cast("int").alias("width"))
    out = tiling.halo_tiles(p.withColumns({"n_h": F.lit(3), "n_w": F.lit(2)}), 16)
    return out.select("id", "i", "j", "y0", "y1", "x0", "x1", "wy0", "wy1", "wx0", "wx1")


_SQL_REGIONS = """rg AS (SELECT p_partkey AS region_index, p_partkey * 37 % 4001 AS x, p_partkey * 91 % 3989 AS y, p_size * 40 AS w, (p_partkey % 50 + 1) * 30 AS h FROM part),
rs AS (SELECT region_index, CAST(trunc(x / 2.5) AS INT) AS x0, CAST(trunc(y / 2.5) AS INT) AS y0, CAST(trunc(w / 2.5) AS INT) // 128 AS n_cols, CAST(trunc(h / 2.5) AS INT) // 128 AS n_rows FROM rg),
rp AS (SELECT region_index, 'main' AS kind, x0 + 128 * c AS x, y0 + 128 * r AS y FROM rs, LATERAL (SELECT unnest(range(n_rows)) AS r), LATERAL (SELECT unnest(range(n_cols)) AS c)
UNION ALL SELECT region_index, 'overlap', x0 + 128 * c + 64, y0 + 128 * r + 64 FROM rs, LATERAL (SELECT unnest(range(n_rows - 1)) AS r), LATERAL (SELECT unnest(range(n_cols - 1)) AS c) WHERE n_rows > 1 AND n_cols > 1)"""


def _regions(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part")
    return p.select(k.alias("region_index"), (k * 37 % 4001).alias("x"), (k * 91 % 3989).alias("y"), (F.col("p_size") * 40).alias("w"), ((k % 50 + 1) * 30).alias("h"))


@_query(f"WITH {_SQL_REGIONS} SELECT region_index, kind, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM rp")
def region_patches(spark, sf_dir):
    """Tiles of regions at a level."""
    return grid.region_patches(_regions(spark, sf_dir), 128, 2.5, 1).select("region_index", "kind", "x", "y")


@_query(f"WITH {_SQL_REGIONS} SELECT region_index, kind, count(*) AS n, count(*) * 16384 AS pixels FROM rp GROUP BY ALL")
def layer_summary(spark, sf_dir):
    """G14."""
    return grid.layer_summary(grid.region_patches(_regions(spark, sf_dir), 128, 2.5, 1), "region_index")


@_query(f"WITH {_sql_images(256)}, n AS (SELECT id, n_rows * n_cols + CASE WHEN layered THEN (n_rows - 1) * (n_cols - 1) ELSE 0 END AS n FROM gr), f AS (SELECT id, unnest(range(n)) AS i FROM n) SELECT id, CAST(i // 4 AS INT) AS batch, count(*) AS n FROM f GROUP BY ALL")
def patch_batches(spark, sf_dir):
    """W11."""
    tiles = grid.patches(_images(spark, sf_dir, 256))
    return tiles.groupBy("id", tiling.batch_of(F.col("flat_idx"), 4).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


# Levels. A level is a region of the tables.

_SQL_LEVELS = "lv AS (SELECT r_regionkey AS level, pow(4.0, r_regionkey) AS ds, 0.25 * pow(4.0, r_regionkey) AS mpp FROM region)"


def _levels(spark, sf_dir) -> DataFrame:
    r = _t(spark, sf_dir, "region")
    return levels.level_table(r.select(F.col("r_regionkey").alias("level"), F.pow(F.lit(4.0), F.col("r_regionkey")).alias("ds"), F.lit(0.25).alias("base_mpp")))


@_query(f"WITH {_SQL_LEVELS} SELECT level, ds, 0.25 AS base_mpp, mpp FROM lv")
def level_table(spark, sf_dir):
    """SRC5, SRC7."""
    return _levels(spark, sf_dir).withColumn("base_mpp", F.col("base_mpp").cast("decimal(3,2)"))


@_query(f"""WITH {_SQL_LEVELS}, q AS (SELECT n_nationkey AS id, pow(2.0, n_nationkey % 11) * (1 + 0.0005 * (n_nationkey % 3)) AS want FROM nation)
SELECT id, (SELECT min(level) FROM lv WHERE abs(ds - want) / greatest(want, 1e-9) < 1e-3) AS exact_level,
coalesce((SELECT arg_max(level, ds) FROM lv WHERE ds <= want), 0) AS best_level FROM q""")
def level_for_downsample(spark, sf_dir):
    """F8, F9, F11."""
    n = F.col("n_nationkey")
    asked = _t(spark, sf_dir, "nation").select(n.alias("id"), (F.pow(F.lit(2.0), n % 11) * (1 + 0.0005 * (n % 3))).alias("want_ds"))
    exact = levels.matching_level(asked, _levels(spark, sf_dir)).withColumnRenamed("level", "exact_level")
    return levels.best_level(exact, _levels(spark, sf_dir)).select("id", "exact_level", F.col("level").alias("best_level"))


@_query(f"""WITH {_SQL_LEVELS}, q AS (SELECT n_nationkey AS id, CAST(n_nationkey % 6 AS INT) AS level, pow(4.0, n_nationkey % 7) AS want FROM nation)
SELECT id, level FROM q WHERE EXISTS (SELECT 1 FROM lv WHERE abs(ds - want) / greatest(want, 1e-9) < 1e-3) AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.level = q.level AND abs(ds - want) / greatest(want, 1e-9) < 1e-3)""")
def wrong_levels(spark, sf_dir):
    """F10."""
    n = F.col("n_nationkey")
    asked = _t(spark, sf_dir, "nation").select(n.alias("id"), (n % 6).alias("level"), F.pow(F.lit(4.0), n % 7).alias("want_ds"))
    return levels.wrong_levels(asked, _levels(spark, sf_dir)).select("id", "level")


@_query(f"""WITH {_SQL_LEVELS}, q AS (SELECT n_nationkey AS id, 0.1 * pow(1.6, n_nationkey) AS want FROM nation),
c AS (SELECT id, want, level, mpp, abs(mpp - want) <= 0.05 * want AS near FROM q, lv WHERE abs(mpp - want) <= 0.05 * want OR mpp > want),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY level) = 1)
SELECT id, CASE WHEN near THEN level WHEN level > 0 THEN level - 1 END AS level FROM q LEFT JOIN f USING (id)""")
def query_read_level(spark, sf_dir):
    """F12."""
    n = F.col("n_nationkey")
    asked = _t(spark, sf_dir, "nation").select(n.alias("id"), (0.1 * F.pow(F.lit(1.6), n)).alias("want_mpp"))
    return levels.query_level(asked, _levels(spark, sf_dir)).select("id", "level")


@_query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 WHEN 3 THEN 0.3 WHEN 4 THEN 12.7 WHEN 5 THEN 5.0 ELSE 0.0 END::DOUBLE AS x,
CASE k WHEN 0 THEN 0.26 WHEN 1 THEN 0.5 WHEN 2 THEN 0.21 WHEN 3 THEN 0.3 WHEN 4 THEN 12.7 WHEN 5 THEN 5.0 ELSE 0.0 END::DOUBLE AS y FROM p""")
def props_mpp(spark, sf_dir):
    """SRC6: each rule of the resolution properties."""
    k = F.col("c_custkey") % 7
    maps = [
        {levels.MPP_X: "0.25", levels.MPP_Y: "0.26", levels.VENDOR_SINGLE: "9"},
        {levels.MPP_X: "", levels.VENDOR_SINGLE: "0.5"},
        {levels.VENDOR_X: "0.2", levels.VENDOR_Y: "0.21"},
        {levels.MPP_X: "0.3", levels.TIFF_X: "7"},
        {levels.TIFF_X: "2000", levels.TIFF_Y: "2000", levels.TIFF_UNIT: "2"},
        {levels.TIFF_X: "2000", levels.TIFF_Y: "2000"},
        {"other": "1"},
    ]
    props = F.create_map()
    for i, m in enumerate(maps):
        made = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
        props = F.when(k == i, made) if i == 0 else props.when(k == i, made)
    out = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), levels.mpp_of(props).alias("mpp"))
    return out.select("id", "mpp.x", "mpp.y")


_SQL_STATS = "st AS (SELECT label AS level, round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS stat, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS stat2, 0.25 * pow(2.0, label) AS mpp FROM embeddings GROUP BY label)"


def _stats(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    mean = lambda i: F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 9)
    return e.groupBy(F.col("label").alias("level")).agg(mean(0).alias("stat"), mean(1).alias("stat2")).withColumn("mpp", 0.25 * F.pow(F.lit(2.0), F.col("level")))


@_query(f"""WITH {_SQL_STATS}, q AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) / 4 AS want FROM embeddings),
d AS (SELECT id, level, row_number() OVER (PARTITION BY id ORDER BY abs(stat - want), level) AS n FROM q, st)
SELECT id, level FROM d WHERE n = 1""")
def nearest_level(spark, sf_dir):
    """J12."""
    asked = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") / 4).alias("want"))
    return levels.nearest_level(asked, _stats(spark, sf_dir)).select("id", "level")


@_query(f"""WITH {_SQL_STATS}, q AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) / 4 AS want FROM embeddings),
s AS (SELECT row_number() OVER o AS i, stat AS s0, mpp AS m0, lead(stat) OVER o AS s1, lead(mpp) OVER o AS m1 FROM st WINDOW o AS (ORDER BY stat, mpp)),
ends AS (SELECT min(s0) AS lo, max(s0) AS hi, arg_min(m0, s0) AS mlo, arg_max(m0, s0) AS mhi FROM s),
b AS (SELECT id, exp(ln(m0) + (want - s0) / (s1 - s0) * (ln(m1) - ln(m0))) AS m, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM q JOIN s ON s0 <= want AND want <= s1)
SELECT q.id, round(CASE WHEN want <= lo THEN mlo WHEN want >= hi THEN mhi ELSE m END, 6) AS mpp FROM q CROSS JOIN ends LEFT JOIN b ON b.id = q.id AND n = 1""")
def interp_level(spark, sf_dir):
    """J11, W5."""
    asked = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") / 4).alias("want"))
    return levels.interpolate(asked, _stats(spark, sf_dir)).select("id", F.round("mpp", 6).alias("mpp"))


@_query(f"""WITH {_SQL_STATS}, z AS (SELECT level, mpp, (stat - avg(stat) OVER ()) / (stddev_pop(stat) OVER () + 1e-9) AS a, (stat2 - avg(stat2) OVER ()) / (stddev_pop(stat2) OVER () + 1e-9) AS b FROM st),
q AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 4 AS a, CAST(embedding[2] AS DOUBLE) * 4 AS b FROM embeddings),
d AS (SELECT id, mpp, round(sqrt(pow(q.a - z.a, 2) + pow(q.b - z.b, 2)), 9) AS dist, level FROM q, z),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, level) <= 3)
SELECT id, round(CASE WHEN min(dist) < 1e-9 THEN arg_min(mpp, dist) ELSE exp(sum(ln(mpp) / (dist + 1e-9)) / sum(1 / (dist + 1e-9))) END, 6) AS estimate FROM k GROUP BY id""")
def weighted_knn_level(spark, sf_dir):
    """A8, A9, W4, X20."""
    z = levels.standardized(_stats(spark, sf_dir), ["stat", "stat2"]).select("level", "mpp", F.col("stat").alias("za"), F.col("stat2").alias("zb"))
    part = lambda i: F.get("embedding", F.lit(i)).cast("double") * 4
    asked = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), part(0).alias("a"), part(1).alias("b"))
    dist = F.round(F.sqrt(F.pow(F.col("a") - F.col("za"), 2) + F.pow(F.col("b") - F.col("zb"), 2)), 9)
    # the levels of one slide: a handful of rows
    near = asked.join(F.broadcast(z), F.lit(True)).withColumn("dist", dist)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("dist", "level"))).where("n <= 3")
    return levels.weighted_log_mean(near, ["id"]).select("id", F.round("estimate", 6).alias("estimate"))


@_query("SELECT l_returnflag AS flag, array_to_string(list(l_linenumber || ':' || n ORDER BY l_linenumber), ',') AS spread FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY flag")
def level_spread(spark, sf_dir):
    """A24."""
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("level")).agg(F.count(F.lit(1)).alias("stat"))
    spread = levels.level_spread(n.withColumn("mpp", F.lit(0.0)), ["flag"])
    return spread.select("flag", F.array_join(F.transform("spread", lambda x: F.concat_ws(":", x["level"].cast("string"), x["stat"].cast("string"))), ",").alias("spread"))


# Nearest neighbours. Queries are the vectors that 20 divides, the bank is every row but the query's own.


def _asked_and_bank(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("feat"), "label")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "feat"), e.withColumnRenamed("vec_id", "ref_id")


_SQL_KNN = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS ref_id, b.label, round(list_inner_product(q.f, b.f), 9) AS sim FROM e q, e b WHERE q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM s QUALIFY rank <= 11),
v AS (SELECT query_id, median(CAST(label AS DOUBLE)) AS label FROM k GROUP BY query_id)"""


@_query(f"WITH {_SQL_KNN} SELECT query_id, CAST(rank AS INT) AS rank, ref_id, sim FROM k")
def knn_topk(spark, sf_dir):
    """J6, W1, W2."""
    return top_k(*_asked_and_bank(spark, sf_dir), 11, skip_self=True)


_SQL_ODD = """e AS (SELECT vec_id, CASE WHEN vec_id % 11 = 5 THEN NULL WHEN vec_id % 7 = 3 THEN list_concat([CAST('nan' AS DOUBLE)], CAST(embedding[2:] AS DOUBLE[]))
  WHEN vec_id % 13 = 8 THEN list_concat([NULL], CAST(embedding[2:] AS DOUBLE[])) WHEN vec_id % 17 = 2 THEN list_concat([CAST('-inf' AS DOUBLE)], CAST(embedding[2:] AS DOUBLE[]))
  ELSE CAST(embedding AS DOUBLE[]) END AS f FROM embeddings),
ok AS (SELECT * FROM e WHERE f IS NOT NULL AND f[1] IS NOT NULL AND isfinite(f[1]))"""


def _odd_vectors(spark, sf_dir) -> DataFrame:
    e, first = _t(spark, sf_dir, "embeddings"), F.transform("embedding", lambda x: x.cast("double"))
    starts = lambda x: F.concat(F.array(x), F.slice(first, 2, 63))
    i = F.col("vec_id")
    feat = F.when(i % 11 == 5, F.lit(None)).when(i % 7 == 3, starts(F.lit(float("nan")))).when(i % 13 == 8, starts(F.lit(None).cast("double")))
    return e.select("vec_id", feat.when(i % 17 == 2, starts(F.lit(float("-inf")))).otherwise(first).alias("feat"))


@_query(f"""WITH {_SQL_ODD}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS ref_id, round(list_inner_product(q.f, b.f), 9) AS sim FROM ok q, ok b WHERE q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS INT) AS rank, ref_id, sim FROM s QUALIFY rank <= 5""")
def knn_odd_vectors(spark, sf_dir):
    """Vectors that are null or hold a null, NaN or infinite component take no part."""
    e = _odd_vectors(spark, sf_dir)
    return top_k(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "ref_id"), 5, skip_self=True)


@_query(f"""WITH {_SQL_ODD}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS ref_id, round(list_distance(q.f, b.f), 9) AS d1 FROM ok q, ok b WHERE q.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
k AS (SELECT *, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY query_id ORDER BY d1, ref_id) QUALIFY n <= 2),
t AS (SELECT *, lead(d1) OVER (PARTITION BY query_id ORDER BY n) AS d2 FROM k) SELECT query_id, ref_id, d1, d2 FROM t WHERE n = 1 AND d1 < 0.97 * d2""")
def ratio_odd_vectors(spark, sf_dir):
    """J14 over the same vectors."""
    e = _odd_vectors(spark, sf_dir)
    return localize.ratio_matches(e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "ref_id"), ratio=0.97)


@_query(f"WITH {_SQL_KNN} SELECT * FROM v")
def knn_label_votes(spark, sf_dir):
    """A5 per query."""
    return knn.label_votes(*_asked_and_bank(spark, sf_dir), 11, True)


@_query(f"WITH {_SQL_KNN} SELECT median(label) AS estimate, count(*) AS n_queries FROM v")
def knn_label_estimate(spark, sf_dir):
    """A5, X17."""
    return knn.label_estimate(*_asked_and_bank(spark, sf_dir), 11, True)


@_query(f"WITH {_SQL_KNN} SELECT label, count(*) AS n FROM v GROUP BY label")
def knn_vote_distribution(spark, sf_dir):
    """A6."""
    return knn.vote_distribution(knn.label_votes(*_asked_and_bank(spark, sf_dir), 11, True))


@_query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)
SELECT vec_id, round(sqrt(list_inner_product(f, f)), 6) AS norm, round(f[1] / sqrt(list_inner_product(f, f)), 6) AS first FROM e""")
def vector_norms(spark, sf_dir):
    """M1, M2."""
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(dot("embedding", "embedding")), 6).alias("norm"), F.round(F.get(normalized("embedding"), F.lit(0)), 6).alias("first"))


@_query("""WITH e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 3)) AS f FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS ref_id, round(list_distance(q.f, b.f), 9) AS d1 FROM e q, e b WHERE q.label < 5 AND b.label >= 5),
k AS (SELECT *, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY query_id ORDER BY d1, ref_id) QUALIFY n <= 2),
t AS (SELECT *, lead(d1) OVER (PARTITION BY query_id ORDER BY n) AS d2 FROM k)
SELECT query_id, ref_id, d1, d2 FROM t WHERE n = 1 AND d1 < 0.95 * d2""")
def ratio_matches(spark, sf_dir):
    """Descriptors of three lengths."""
    longer = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    e = _t(spark, sf_dir, "embeddings").select("vec_id", longer.alias("feat"), "label")
    q, b = e.where("label < 5").select(F.col("vec_id").alias("query_id"), "feat"), e.where("label >= 5").select(F.col("vec_id").alias("ref_id"), "feat")
    return localize.ratio_matches(q, b, ratio=0.95)


# Retrieval. Vectors lie row by row on grids 25 wide; the kernel is cut from rows 7-8, columns 4-6.


def _grid(spark, sf_dir, overlap: bool = False, region_rows: int | None = None) -> DataFrame:
    n = F.floor(F.col("vec_id") / 2) if overlap else F.col("vec_id")
    kind = F.when(F.col("vec_id") % 2 == 1, "overlap").otherwise("main") if overlap else F.lit("main")
    row = F.floor(n / 25).cast("int")
    region = F.floor(row / region_rows).cast("int") if region_rows else F.lit(0)
    at = (row - region * region_rows).cast("int") if region_rows else row
    return _t(spark, sf_dir, "embeddings").select(region.alias("region_index"), kind.alias("kind"), at.alias("row"), (n % 25).cast("int").alias("col"), F.col("embedding").alias("feat"))


def _kernel(g: DataFrame) -> DataFrame:
    cut = g.where("region_index = 0 AND kind = 'main' AND row BETWEEN 7 AND 8 AND col BETWEEN 4 AND 6")
    return cut.select((F.col("row") - 7).alias("q_row"), (F.col("col") - 4).alias("q_col"), "feat")


def _sql_windows(overlap: bool, region_rows: int | None = None) -> str:
    n, kind = ("vec_id // 2", "CASE WHEN vec_id % 2 = 1 THEN 'overlap' ELSE 'main' END") if overlap else ("vec_id", "'main'")
    region = f"{n} // 25 // {region_rows}" if region_rows else "0"
    row = f"{n} // 25 % {region_rows}" if region_rows else f"{n} // 25"
    return f"""g AS (SELECT CAST({region} AS INT) AS region_index, {kind} AS kind, CAST({row} AS INT) AS r, CAST({n} % 25 AS INT) AS c, CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
ke AS (SELECT r - 7 AS qr, c - 4 AS qc, f AS qf FROM g WHERE region_index = 0 AND kind = 'main' AND r BETWEEN 7 AND 8 AND c BETWEEN 4 AND 6),
w AS (SELECT region_index, kind, r - qr AS out_r, c - qc AS out_c, round(avg(list_inner_product(f, qf)), 9) AS score FROM g, ke WHERE r >= qr AND c >= qc GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM ke)),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY region_index, kind ORDER BY score DESC, out_r, out_c) = 1)"""


@_query(f"WITH {_sql_windows(False)} SELECT * FROM w")
def window_similarity(spark, sf_dir):
    """J3, A1."""
    g = _grid(spark, sf_dir)
    return retrieval.window_similarity(g, _kernel(g)).withColumn("score", F.round("score", 9))


@_query(f"WITH {_sql_windows(False, 10)} SELECT * FROM b")
def best_window_per_region(spark, sf_dir):
    """Regions of ten rows."""
    g = _grid(spark, sf_dir, region_rows=10)
    return retrieval.best_per_region(retrieval.window_similarity(g, _kernel(g)))


@_query(f"WITH {_sql_windows(False)} SELECT region_index, out_r, out_c, score FROM b ORDER BY score DESC, region_index LIMIT 1")
def best_window(spark, sf_dir):
    """A3: the planted kernel is found at (7, 4) with a score of 1."""
    g = _grid(spark, sf_dir)
    return retrieval.best_of_kind(retrieval.best_per_region(retrieval.window_similarity(g, _kernel(g))), "main")


@_query(f"""WITH {_sql_windows(True, 10)},
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, region_index) = 1),
p AS (SELECT kind, region_index, CAST(trunc(region_index * 1000 / 4.0) AS INT) + out_c * 64 + CASE WHEN kind = 'overlap' THEN 32 ELSE 0 END AS x,
  CAST(trunc(region_index * 500 / 4.0) AS INT) + out_r * 64 + CASE WHEN kind = 'overlap' THEN 32 ELSE 0 END AS y, score FROM f)
SELECT CASE WHEN o.score > m.score THEN 'overlap' ELSE 'main' END AS kind, CASE WHEN o.score > m.score THEN o.region_index ELSE m.region_index END AS region_index,
CASE WHEN o.score > m.score THEN o.x ELSE m.x END AS x, CASE WHEN o.score > m.score THEN o.y ELSE m.y END AS y,
CAST(CASE WHEN o.score > m.score THEN o.x ELSE m.x END * 4 AS INT) AS x0, CAST(CASE WHEN o.score > m.score THEN o.y ELSE m.y END * 4 AS INT) AS y0, greatest(o.score, m.score) AS score,
m.x AS main_x, m.y AS main_y, m.score AS main_score, o.x AS overlap_x, o.y AS overlap_y, o.score AS overlap_score
FROM (SELECT * FROM p WHERE kind = 'main') m, (SELECT * FROM p WHERE kind = 'overlap') o""")
def best_of_two_grids(spark, sf_dir):
    """J4, A4, X18."""
    g = _grid(spark, sf_dir, overlap=True, region_rows=10)
    places = g.select("region_index").distinct().withColumns({"x": F.col("region_index") * 1000, "y": F.col("region_index") * 500})
    return retrieval.find_best(retrieval.window_similarity(g, _kernel(g)), places, 64, 4.0)


@_query(f"""WITH {_sql_windows(True, 10)},
c AS (SELECT region_index, CASE WHEN kind = 'main' THEN 0 ELSE 1 END AS k, out_r, out_c, 2 * out_r + CASE WHEN kind = 'main' THEN 0 ELSE 1 END + i AS u_row, 2 * out_c + CASE WHEN kind = 'main' THEN 0 ELSE 1 END + j AS u_col, score
  FROM w, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b2(j))
SELECT u_row, u_col, score FROM c QUALIFY row_number() OVER (PARTITION BY u_row, u_col ORDER BY region_index DESC, k DESC, out_r DESC, out_c DESC) = 1""")
def heat_canvas(spark, sf_dir):
    """W10."""
    g = _grid(spark, sf_dir, overlap=True, region_rows=10)
    return retrieval.heat_canvas(retrieval.window_similarity(g, _kernel(g))).withColumn("score", F.round("score", 9))


@_query(f"""WITH {_sql_windows(False)},
rk AS (SELECT 0 AS rot, qr, qc, qf FROM ke UNION ALL SELECT 1, qc, 1 - qr, qf FROM ke UNION ALL SELECT 2, 1 - qr, 2 - qc, qf FROM ke UNION ALL SELECT 3, 2 - qc, qr, qf FROM ke),
rw AS (SELECT rot, r - qr AS out_r, c - qc AS out_c, round(avg(list_inner_product(f, qf)), 9) AS score FROM g, rk WHERE r >= qr AND c >= qc GROUP BY ALL HAVING count(*) = 6)
SELECT CAST(rot AS INT) AS rot, out_r, out_c, score FROM rw QUALIFY row_number() OVER (PARTITION BY rot ORDER BY score DESC, out_r, out_c) = 1""")
def rotated_best(spark, sf_dir):
    """The best window of each turn of the kernel."""
    g = _grid(spark, sf_dir)
    scores = retrieval.window_similarity(g, retrieval.rotated(_kernel(g)), query=("rot",))
    return retrieval.best_per_region(scores, keys=("rot",)).select("rot", "out_r", "out_c", "score")


# Masks. Events by quarter of a day and by three users are cells. An image is at least as large as the SQL's,
# and grows with the cells of the table, which the SQL cuts.

WIDTH, HEIGHT = 120, 8192
_SQL_MASK = f"""mk AS (SELECT CAST(floor(user_id / 3.0) AS INT) AS y, CAST(floor((epoch(ts) - 1704067200) / 21600) AS INT) AS x FROM events GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT * FROM mk WHERE x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1})"""


def _event_cells(spark, sf_dir) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return _t(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 3).cast("int").alias("y"), F.floor(seconds / 21600).cast("int").alias("x"))


def _mask(spark, sf_dir, least: int = 3) -> DataFrame:
    cells = _event_cells(spark, sf_dir).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    return cells.where((F.col("n") >= least) & (F.col("x") >= 0) & (F.col("y") >= 0)).select("y", "x")


def _size(spark, sf_dir) -> tuple[int, int]:
    """Width and height of the mask's image, by one aggregate row."""
    x, y = _event_cells(spark, sf_dir).agg(F.max("x"), F.max("y")).first()
    return max(WIDTH, (x or 0) + 1), max(HEIGHT, (y or 0) + 1)


@_query(f"WITH {_SQL_MASK} SELECT round(count(*) / {float(WIDTH * HEIGHT)}, 9) AS fraction FROM m")
def mask_fraction(spark, sf_dir):
    """F4."""
    return raster.mask_fraction(_mask(spark, sf_dir), *_size(spark, sf_dir)).select(F.round("fraction", 9).alias("fraction"))


@_query(f"WITH {_SQL_MASK} SELECT y, x FROM m WHERE x BETWEEN 10 AND 69 AND y < 25")
def mask_slice(spark, sf_dir):
    """F1."""
    return raster.mask_slice(_mask(spark, sf_dir), 10, -5, 60, 30)


@_query(f"""WITH {_SQL_MASK}, t AS (SELECT p_partkey AS tile_id, p_partkey % 130 - 5 AS x, p_partkey * 7 % 60 - 5 AS y, 1 + p_size % 20 AS w, 1 + p_partkey % 15 AS h FROM part),
c AS (SELECT tile_id, (least(x + w, {WIDTH}) - greatest(x, 0)) * (least(y + h, {HEIGHT}) - greatest(y, 0)) AS a, least(x + w, {WIDTH}) > greatest(x, 0) AND least(y + h, {HEIGHT}) > greatest(y, 0) AS ok FROM t)
SELECT t.tile_id, CASE WHEN any_value(ok) THEN round(count(m.x) / CAST(any_value(a) AS DOUBLE), 9) END AS covered
FROM t JOIN c USING (tile_id) LEFT JOIN m ON m.x >= t.x AND m.x < t.x + t.w AND m.y >= t.y AND m.y < t.y + t.h GROUP BY t.tile_id""")
def tile_coverage(spark, sf_dir):
    """F2, J10."""
    p = _t(spark, sf_dir, "part")
    tiles = p.select(
        F.col("p_partkey").alias("tile_id"), (F.col("p_partkey") % 130 - 5).alias("x"), (F.col("p_partkey") * 7 % 60 - 5).alias("y"), (1 + F.col("p_size") % 20).alias("w"), (1 + F.col("p_partkey") % 15).alias("h")
    )
    return raster.coverage(tiles, _mask(spark, sf_dir), *_size(spark, sf_dir)).select("tile_id", F.round("covered", 9).alias("covered"))


@_query(f"""WITH {_SQL_MASK}, m4 AS (SELECT CAST(floor(user_id / 3.0) AS INT) AS y, CAST(floor((epoch(ts) - 1704067200) / 21600) AS INT) AS x FROM events GROUP BY ALL HAVING count(*) >= 4),
u AS (SELECT y, x FROM m UNION ALL SELECT y, x FROM m4 WHERE x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1})
SELECT round(count(*) / {float(WIDTH * HEIGHT)}, 9) AS disagreement FROM (SELECT y, x FROM u GROUP BY ALL HAVING count(*) = 1)""")
def mask_xor(spark, sf_dir):
    """A23, S4."""
    return raster.disagreement(_mask(spark, sf_dir), _mask(spark, sf_dir, 4), *_size(spark, sf_dir)).select(F.round("disagreement", 9).alias("disagreement"))


_SQL_STEPS = "d(k) AS (SELECT unnest(range(-1, 2)))"
_SQL_DILATE = f"di AS (SELECT DISTINCT y + a.k AS y, x + b.k AS x FROM m, d a, d b WHERE y + a.k BETWEEN 0 AND {HEIGHT - 1} AND x + b.k BETWEEN 0 AND {WIDTH - 1})"


def _sql_erode(name: str, src: str) -> str:
    return f"""{name} AS (SELECT s.y, s.x FROM {src} s, d a, d b LEFT JOIN {src} n ON n.y = s.y + a.k AND n.x = s.x + b.k
  WHERE s.y + a.k BETWEEN 0 AND {HEIGHT - 1} AND s.x + b.k BETWEEN 0 AND {WIDTH - 1} GROUP BY ALL HAVING count(*) = count(n.x))"""


@_query(f"WITH {_SQL_MASK}, {_SQL_STEPS}, {_SQL_DILATE} SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM di")
def mask_dilated(spark, sf_dir):
    """W6."""
    return raster.dilate(_mask(spark, sf_dir), *_size(spark, sf_dir), 1)


@_query(f"WITH {_SQL_MASK}, {_SQL_STEPS}, {_SQL_DILATE}, {_sql_erode('er', 'di')} SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM er")
def mask_closed(spark, sf_dir):
    """Closing."""
    size = _size(spark, sf_dir)
    return raster.erode(raster.dilate(_mask(spark, sf_dir), *size, 1), *size, 1)


_SQL_COMPONENTS = f"""WITH RECURSIVE {_SQL_MASK}, l AS (SELECT y, x, CAST(y AS BIGINT) * 2147483648 + x AS lab FROM m),
r AS (SELECT y, x, y AS sy, x AS sx FROM m UNION SELECT m.y, m.x, r.sy, r.sx FROM r JOIN m ON abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
c AS (SELECT y, x, min(CAST(sy AS BIGINT) * 2147483648 + sx) AS label FROM r GROUP BY y, x)"""


@_query(f"{_SQL_COMPONENTS} SELECT label, count(*) AS area FROM c GROUP BY label")
def mask_components(spark, sf_dir):
    """8-connected components."""
    return raster.components(_mask(spark, sf_dir)).groupBy("label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


@_query(f"""{_SQL_COMPONENTS}, b AS (SELECT label, count(*) AS area, min(x) AS l, min(y) AS t, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM c GROUP BY label HAVING count(*) >= 5)
SELECT CAST(row_number() OVER (ORDER BY t, l, label) - 1 AS INT) AS index, CAST(trunc(l * 3.7) AS INT) AS x, CAST(trunc(t * 2.3) AS INT) AS y, CAST(trunc(w * 3.7) AS INT) AS w, CAST(trunc(h * 2.3) AS INT) AS h, area FROM b""")
def region_boxes(spark, sf_dir):
    """A10."""
    return raster.region_boxes(_mask(spark, sf_dir), 3.7, 2.3, 5)


_SQL_GRAY = "px AS (SELECT event_id, CAST(least(255, floor(value)) AS INT) AS g FROM events)"
_SQL_OTSU = f"""WITH {_SQL_GRAY}, h AS (SELECT g, CAST(count(*) AS DOUBLE) AS n FROM px WHERE g > 5 GROUP BY g),
c AS (SELECT g, sum(n) OVER o AS w0, sum(n * g) OVER o AS s0, sum(n) OVER () AS w, sum(n * g) OVER () AS s FROM h WINDOW o AS (ORDER BY g)),
v AS (SELECT g, round(w0 / w * (1 - w0 / w) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS v FROM c WHERE w > w0), best AS (SELECT g AS threshold, v AS variance FROM v ORDER BY v DESC, g LIMIT 1)"""


def _gray(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.least(F.lit(255), F.floor("value")).cast("int").alias("g"))


@_query(f"{_SQL_OTSU} SELECT threshold, round(variance, 3) AS variance FROM best")
def otsu_threshold(spark, sf_dir):
    """A17, W7."""
    return raster.otsu(_gray(spark, sf_dir), black=5).select("threshold", F.round("variance", 3).alias("variance"))


@_query(f"{_SQL_OTSU} SELECT event_id AS y, 0 AS x FROM px, best WHERE g > 5 AND g < threshold")
def otsu_mask(spark, sf_dir):
    """M7."""
    return raster.otsu_mask(_gray(spark, sf_dir).withColumns({"y": F.col("event_id"), "x": F.lit(0)}), black=5)


_SQL_RGB = "px AS (SELECT l_orderkey AS y, l_linenumber AS x, CAST(l_orderkey * 7 % 256 AS INT) AS r, CAST(l_partkey * 11 % 256 AS INT) AS g, CAST(l_suppkey * 13 % 256 AS INT) AS b FROM lineitem)"


def _rgb(spark, sf_dir) -> DataFrame:
    c = lambda n, k: (F.col(n) * k % 256).cast("int")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), c("l_orderkey", 7).alias("r"), c("l_partkey", 11).alias("g"), c("l_suppkey", 13).alias("b"))


@_query(f"WITH {_SQL_RGB} SELECT y, x FROM px WHERE CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) END > 15 AND greatest(r, g, b) > 30 AND greatest(r, g, b) < 240")
def hsv_mask(spark, sf_dir):
    """M6."""
    return raster.hsv_mask(_rgb(spark, sf_dir))


@_query(f"WITH {_SQL_RGB} SELECT CAST(round(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) AS INT) AS gray, count(*) AS n FROM px GROUP BY gray")
def gray_levels(spark, sf_dir):
    """M8."""
    return _rgb(spark, sf_dir).groupBy(raster.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray")).agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH t AS (SELECT p_partkey % 500 AS x, p_partkey * 31 % 300 AS y, p_size AS s FROM part),
r AS (SELECT x, s, unnest(range(y, y + s)) AS y FROM t), c AS (SELECT y, unnest(range(x, x + s)) AS x FROM r)
SELECT round(count(*) / 150000.0, 9) AS coverage FROM (SELECT DISTINCT x, y FROM c WHERE x < 500 AND y < 300)""")
def reconstruction_coverage(spark, sf_dir):
    """A22."""
    t = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("x"), (F.col("p_partkey") * 31 % 300).alias("y"), F.col("p_size").alias("size_px"))
    return raster.reconstruction_coverage(t, 500, 300).select(F.round("coverage", 9).alias("coverage"))


# Boxes from parts.

_SQL_BOXES = "bx AS (SELECT CAST(p_partkey AS INT) AS index, p_partkey * p_partkey * 37 % 8009 AS x, (p_partkey * p_partkey * 91 + p_partkey * 13) % 7993 AS y, 3 * (p_partkey % 9 + 1) * (p_partkey % 9 + 1) AS w, 2 * (p_partkey % 9 + 1) * (p_partkey % 9 + 1) AS h FROM part)"
_SQL_IN = "{0}.x >= {1}.x AND {0}.y >= {1}.y AND {0}.x + {0}.w <= {1}.x + {1}.w AND {0}.y + {0}.h <= {1}.y + {1}.h"
_A_IN_B, _B_IN_A = _SQL_IN.format("a", "b"), _SQL_IN.format("b", "a")
_SQL_PAIRS = f"pr AS (SELECT a.index AS a, b.index AS b FROM bx a JOIN bx b ON a.index < b.index AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h WHERE NOT ({_A_IN_B}) AND NOT ({_B_IN_A}))"


def _boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    s = k % 9 + 1
    return _t(spark, sf_dir, "part").select(k.cast("int").alias("index"), (k * k * 37 % 8009).alias("x"), ((k * k * 91 + k * 13) % 7993).alias("y"), (3 * s * s).alias("w"), (2 * s * s).alias("h"))


@_query(f"WITH {_SQL_BOXES} SELECT * FROM bx WHERE w * h >= (SELECT max(w * h) FROM bx) * 0.05")
def regions_min_area(spark, sf_dir):
    """F5, first half."""
    return regions.large_enough(_boxes(spark, sf_dir), 0.05)


@_query(f"WITH {_SQL_BOXES} SELECT * FROM bx a WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE a.index <> b.index AND {_A_IN_B})")
def regions_not_contained(spark, sf_dir):
    """J9."""
    return regions.not_contained(_boxes(spark, sf_dir))


@_query(f"WITH {_SQL_BOXES}, k AS (SELECT * FROM bx WHERE w * h >= (SELECT max(w * h) FROM bx) * 0.05) SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.index <> b.index AND {_A_IN_B})")
def regions_filtered(spark, sf_dir):
    """F5."""
    return regions.filter_regions(_boxes(spark, sf_dir), 0.05)


@_query(f"WITH {_SQL_BOXES} SELECT * FROM bx WHERE w >= 64 AND h >= 64")
def regions_patchable(spark, sf_dir):
    """F6."""
    return regions.patchable(_boxes(spark, sf_dir), 32, 2.0)


@_query(f"WITH {_SQL_BOXES}, {_SQL_PAIRS} SELECT * FROM pr")
def overlap_pairs(spark, sf_dir):
    """J8."""
    return regions.partial_overlaps(_boxes(spark, sf_dir))


@_query(f"""WITH RECURSIVE {_SQL_BOXES}, {_SQL_PAIRS}, ed AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
r AS (SELECT index AS n, index AS s FROM bx UNION SELECT ed.b, r.s FROM r JOIN ed ON ed.a = r.n), c AS (SELECT n, min(s) AS root FROM r GROUP BY n),
g AS (SELECT root, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1, count(*) AS n FROM bx JOIN c ON c.n = bx.index GROUP BY root)
SELECT CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS index, x, y, x1 - x AS w, y1 - y AS h, n FROM g""")
def regions_merged(spark, sf_dir):
    """A11, X7."""
    return regions.merge_overlapping(_boxes(spark, sf_dir))


# Sampling.

_SAMPLE_N, _SAMPLE_TILE, _SAMPLE_DS = 20, 40, 50.0


#: Regions of the sample: large ones that overlap in parts, some inside others, some too small.
_SQL_PLACES = """bx0 AS (SELECT CAST(n_nationkey AS INT) AS index, 1100 * (n_nationkey % 5) + 13 * n_nationkey AS x, 150 * (n_nationkey // 5) AS y,
  CASE WHEN n_nationkey % 6 = 5 THEN 30 ELSE 700 + 90 * (n_nationkey % 7) END AS w, CASE WHEN n_nationkey % 6 = 5 THEN 20 ELSE 300 + 40 * (n_nationkey % 4) END AS h FROM nation)"""
_SQL_FILTER = f"kp AS (SELECT * FROM bx0 WHERE w * h >= (SELECT max(w * h) FROM bx0) * 0.01), bx AS (SELECT * FROM kp a WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE a.index <> b.index AND {_A_IN_B}))"
_SQL_MERGE = """ed AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), r AS (SELECT index AS n, index AS s FROM bx UNION SELECT ed.b, r.s FROM r JOIN ed ON ed.a = r.n),
c AS (SELECT n, min(s) AS root FROM r GROUP BY n), g AS (SELECT root, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1 FROM bx JOIN c ON c.n = bx.index GROUP BY root),
mg AS (SELECT CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS index, x, y, x1 - x AS w, y1 - y AS h FROM g)"""


def _places(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    small = k % 6 == 5
    return _t(spark, sf_dir, "nation").select(
        k.cast("int").alias("index"), (1100 * (k % 5) + 13 * k).alias("x"), (150 * F.floor(k / 5)).cast("int").alias("y"),
        F.when(small, 30).otherwise(700 + 90 * (k % 7)).alias("w"), F.when(small, 20).otherwise(300 + 40 * (k % 4)).alias("h"),
    )


@_query(f"WITH RECURSIVE {_SQL_PLACES}, {_SQL_FILTER}, {_SQL_PAIRS}, {_SQL_MERGE} SELECT * FROM mg WHERE w >= 800 AND h >= 800")
def regions_for_level(spark, sf_dir):
    """Regions of a level, filtered, merged and large enough."""
    return regions.regions_for_level(_places(spark, sf_dir), 200, 4.0).drop("n")


@_query(f"""WITH RECURSIVE {_SQL_MASK}, {_SQL_PLACES}, {_SQL_FILTER}, {_SQL_PAIRS}, {_SQL_MERGE},
lv(level, size) AS (VALUES (0, {_SAMPLE_TILE}), (1, {_SAMPLE_TILE * 4})),
ft AS (SELECT level, size, index, x, y, w, h, row_number() OVER (PARTITION BY level ORDER BY index) - 1 AS turn, count(*) OVER (PARTITION BY level) AS boxes FROM mg, lv WHERE w >= size AND h >= size),
t AS (SELECT level, CAST(unnest(range({5 * _SAMPLE_N})) AS INT) AS try FROM lv),
cd AS (SELECT level, size, try, index, x + (try * 7919 + 17) % (w - size + 1) AS px, y + (CAST(try AS BIGINT) * 104729 + 31) % (h - size + 1) AS py FROM t JOIN ft USING (level) WHERE turn = try % boxes),
k AS (SELECT *, CAST(trunc(px / {_SAMPLE_DS}) AS INT) AS mx, CAST(trunc(py / {_SAMPLE_DS}) AS INT) AS my, CAST(trunc(size / {_SAMPLE_DS}) AS INT) AS ms FROM cd),
a AS (SELECT level, try, index, px, py FROM k WHERE ms > 0 AND (SELECT count(*) FROM m WHERE m.x >= mx AND m.x < mx + ms AND m.y >= my AND m.y < my + ms)
 >= 0.2 * greatest(0, least(mx + ms, {WIDTH}) - mx) * greatest(0, least(my + ms, {HEIGHT}) - my) AND mx < {WIDTH} AND my < {HEIGHT})
SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY try) AS INT) AS nth, try, index, px AS x, py AS y FROM a QUALIFY nth <= {_SAMPLE_N}""")
def sampled_tiles(spark, sf_dir):
    """X3, W8, F3, F7."""
    return sampling.sample_tiles(_places(spark, sf_dir), _mask(spark, sf_dir), [(0, 1.0), (1, 4.0)], _SAMPLE_N, _SAMPLE_TILE, _SAMPLE_DS, *_size(spark, sf_dir), 0.2)


@_query("""WITH s AS (SELECT l_linenumber AS level, l_orderkey AS try, max(l_quantity) AS deviation, max(l_extendedprice) AS stat FROM lineitem GROUP BY ALL),
f AS (SELECT * FROM s WHERE deviation >= 6 QUALIFY row_number() OVER (PARTITION BY level ORDER BY try) <= 15)
SELECT level, median(stat) AS stat FROM f GROUP BY level""")
def level_fingerprint(spark, sf_dir):
    """Order of tries is made unique by their key."""
    s = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("level"), F.col("l_orderkey").alias("try")).agg(F.max("l_quantity").alias("deviation"), F.max("l_extendedprice").alias("stat"))
    return sampling.level_fingerprint(s, 15)


# Fidelity of a coarser encoder: components rounded to two places, every eighth dropped.

_SQL_TWO = "ba AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), ot AS (SELECT vec_id AS id, [CASE WHEN i % 8 = 0 THEN 0.0 ELSE round(CAST(embedding[i + 1] AS DOUBLE), 2) END FOR i IN range(64)] AS f FROM embeddings)"


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "embeddings")
    coarse = F.transform("embedding", lambda x, i: F.when(i % 8 == 0, F.lit(0.0)).otherwise(F.round(x.cast("double"), 2)))
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("feat")), e.select(F.col("vec_id").alias("id"), coarse.alias("feat"))


@_query(f"""WITH {_SQL_TWO}, c AS (SELECT round(list_inner_product(ba.f, ot.f) / (sqrt(list_inner_product(ba.f, ba.f)) * sqrt(list_inner_product(ot.f, ot.f))), 9) AS cos FROM ba JOIN ot USING (id))
SELECT count(*) AS n, round(avg(cos), 6) AS mean, round(stddev_pop(cos), 6) AS std, {", ".join(f"round(quantile_cont(cos, {p / 100}), 6) AS p{p}" for p in (1, 5, 50, 95, 99))} FROM c""")
def fidelity_stats(spark, sf_dir):
    """A13, J15."""
    return fidelity.fidelity_stats(fidelity.row_cosines(*_two(spark, sf_dir)))


def _sql_ranked(name: str, src: str) -> str:
    return f"{name} AS (SELECT a.id AS q, b.id AS r, round(list_inner_product(a.f, b.f), 9) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.f, b.f), 9) DESC, b.id) AS k FROM {src} a JOIN {src} b ON a.id <> b.id)"


@_query(f"""WITH {_SQL_TWO}, {_sql_ranked('x', 'ba')}, {_sql_ranked('y', 'ot')}, n AS (SELECT count(*) AS n FROM ba), ks(k) AS (VALUES (1), (5), (10), (50))
SELECT CAST(ks.k AS INT) AS k, round(count(*) FILTER (x.k <= ks.k AND y.k <= ks.k) / CAST(any_value(n) * ks.k AS DOUBLE), 6) AS overlap FROM x JOIN y ON x.q = y.q AND x.r = y.r CROSS JOIN ks CROSS JOIN n GROUP BY ks.k""")
def topk_overlap(spark, sf_dir):
    """A14, S3."""
    return fidelity.topk_overlap(*_two(spark, sf_dir))


@_query(f"""WITH {_SQL_TWO}, {_sql_ranked('x', 'ba')}, {_sql_ranked('y', 'ot')}, s AS (SELECT CAST(y.k - 1 AS DOUBLE) AS shift FROM x JOIN y ON x.q = y.q AND x.r = y.r WHERE x.k = 1)
SELECT round(median(shift), 6) AS median, round(quantile_cont(shift, 0.95), 6) AS p95 FROM s""")
def rank_shift(spark, sf_dir):
    """A16, W3."""
    return fidelity.rank_shift(*_two(spark, sf_dir))


@_query(f"""WITH {_SQL_TWO}, x AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.f, b.f), 9) AS s FROM ba a JOIN ba b ON a.id < b.id), y AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.f, b.f), 9) AS s FROM ot a JOIN ot b ON a.id < b.id),
r AS (SELECT rank() OVER (ORDER BY x.s) + (count(*) OVER (PARTITION BY x.s) - 1) / 2.0 AS p, rank() OVER (ORDER BY y.s) + (count(*) OVER (PARTITION BY y.s) - 1) / 2.0 AS q FROM x JOIN y ON x.a = y.a AND x.b = y.b)
SELECT count(*) AS n_pairs, round(corr(p, q), 6) AS rho FROM r""")
def spearman_pairs(spark, sf_dir):
    """A15, J7."""
    return fidelity.spearman(*_two(spark, sf_dir))


@_query("""WITH p AS (SELECT l_extendedprice AS truth, l_extendedprice * (1 + l_tax - l_discount) AS estimate FROM lineitem), e AS (SELECT round(abs(estimate - truth) / truth * 100, 6) AS e FROM p)
SELECT round(avg(e), 6) AS mean_pct, round(max(e), 6) AS max_pct, round(avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END), 6) AS ok_share FROM e""")
def error_metrics(spark, sf_dir):
    """A21."""
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("truth"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("estimate"))
    return fidelity.error_metrics(p)


# Benchmark runs from line items.

_SQL_RUNS = "ru AS (SELECT l_returnflag AS flag, l_linestatus AS stat, l_linenumber AS bs, sum(l_extendedprice) / sum(l_quantity) AS pps FROM lineitem GROUP BY ALL)"


def _runs(spark, sf_dir) -> DataFrame:
    keys = [F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("stat"), F.col("l_linenumber").alias("bs")]
    return _t(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("pps"))


@_query(f"WITH {_SQL_RUNS}, m AS (SELECT flag, bs, round(avg(pps), 4) AS mean FROM ru GROUP BY ALL) SELECT flag, (SELECT bs FROM m i WHERE i.flag = m.flag ORDER BY mean DESC, bs LIMIT 1) AS best, max(mean) AS best_mean, min(mean) AS worst_mean FROM m GROUP BY flag")
def best_config(spark, sf_dir):
    """A18."""
    return rollup.best_config(_runs(spark, sf_dir), ["flag"], "bs", "pps", 4)


@_query(f"""WITH {_SQL_RUNS}, b AS (SELECT bs, max(pps) AS base FROM ru WHERE flag = 'A' GROUP BY bs), x AS (SELECT flag || '-' || stat AS config, ru.bs, round(pps / base, 4) AS ratio FROM ru LEFT JOIN b USING (bs))
SELECT config, {", ".join(f'max(ratio) FILTER (bs = {i}) AS "{i}"' for i in range(1, 8))} FROM x GROUP BY config""")
def speedup_matrix(spark, sf_dir):
    """A19."""
    runs = _runs(spark, sf_dir).withColumn("config", F.concat_ws("-", "flag", "stat"))
    ratios = rollup.speedups(runs, F.col("flag") == "A", "bs", "config", "pps", 4)
    return rollup.speedup_matrix(ratios, "bs", "config", list(range(1, 8)))


@_query("""WITH r AS (SELECT l_linenumber AS bs, count(*) FILTER (l_tax > 0.04) / CAST(count(*) AS DOUBLE) * (l_linenumber / 4.0) AS share, sum(l_quantity) AS a, sum(l_discount * 500) AS b FROM lineitem GROUP BY l_linenumber)
SELECT bs, CASE WHEN share > 0.8 THEN 'first' WHEN share < 0.3 THEN 'second' ELSE 'balanced' END AS bound, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS largest FROM r""")
def bottleneck(spark, sf_dir):
    """A20, A18."""
    share = F.count_if(F.col("l_tax") > 0.04) / F.count(F.lit(1)) * (F.col("l_linenumber") / 4.0)
    r = _t(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(share.alias("share"), F.sum("l_quantity").alias("a"), F.sum(F.col("l_discount") * 500).alias("b"))
    return r.select(F.col("l_linenumber").alias("bs"), rollup.bottleneck(F.col("share")).alias("bound"), rollup.verdict({"a": F.col("a"), "b": F.col("b")}).alias("largest"))


@_query("SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)")
def missing_configs(spark, sf_dir):
    """S5, SRC9."""
    p = _t(spark, sf_dir, "part").select("p_brand", "p_size")
    return rollup.missing_configs(p.select("p_brand"), p.where("p_size = 7"), "p_brand")


# Homographies from orders' keys.

_SQL_H = "hm AS (SELECT o_orderkey AS id, 1 + o_orderkey % 7 * 0.1 AS h0, o_orderkey % 5 * 0.05 AS h1, CAST(o_orderkey % 100 AS DOUBLE) AS h2, o_custkey % 5 * 0.04 AS h3, 1 + o_custkey % 3 * 0.2 AS h4, CAST(o_custkey % 90 AS DOUBLE) AS h5, 0.0001 * (o_orderkey % 3) AS h6, 0.0002 * (o_custkey % 2) AS h7 FROM orders)"


def _homographies(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    h = F.array(1 + k % 7 * 0.1, k % 5 * 0.05, (k % 100).cast("double"), c % 5 * 0.04, 1 + c % 3 * 0.2, (c % 90).cast("double"), 0.0001 * (k % 3), 0.0002 * (c % 2), F.lit(1.0))
    return _t(spark, sf_dir, "orders").select(k.alias("id"), h.alias("h"))


@_query(f"WITH {_SQL_H} SELECT id, round((h0 * 10 + h1 * 20 + h2) / (h6 * 10 + h7 * 20 + 1), 6) AS x, round((h3 * 10 + h4 * 20 + h5) / (h6 * 10 + h7 * 20 + 1), 6) AS y FROM hm")
def apply_homography(spark, sf_dir):
    """M22."""
    x, y = localize.apply_homography(F.col("h"), F.lit(10.0), F.lit(20.0))
    return _homographies(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@_query(f"WITH {_SQL_H} SELECT id, round(sqrt(h0 * h0 + h3 * h3), 6) AS sx, round(sqrt(h1 * h1 + h4 * h4), 6) AS sy, round(degrees(atan2(h3, h0)), 6) AS theta, round(h2, 6) AS dx, round(h5, 6) AS dy, round(sqrt(h6 * h6 + h7 * h7), 6) AS persp FROM hm")
def decompose_homography(spark, sf_dir):
    """M23."""
    return _homographies(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for n, c in localize.decompose_homography(F.col("h")).items()])


# Rows without SQL: images made of vectors, and point pairs of orders.


def _pictures(spark, sf_dir) -> DataFrame:
    @F.pandas_udf(IMAGE)
    def picture(vectors: pd.Series) -> pd.DataFrame:
        out = []
        for v in vectors:
            tile = np.kron(np.asarray(v, dtype=float).reshape(8, 8), np.ones((4, 4)))
            out.append(encode_row(np.clip(np.dstack([tile, tile.T, -tile]) * 300 + 128, 0, 255)))
        return pd.DataFrame(out, columns=IMAGE.names)

    return _t(spark, sf_dir, "embeddings").select("vec_id", picture("embedding").alias("image"))


@_query()
def spectral_stats(spark, sf_dir):
    """M3-M5, A12, W9."""
    both = [image.statistic_udf(f)("image").alias(n) for n, f in (("centroid", image.spectral_centroid), ("autocorr", image.autocorr_length))]
    return _pictures(spark, sf_dir).select("vec_id", *both)


@_query()
def microscope_effects(spark, sf_dir):
    """M11-M20."""
    out = image.image_udf(image.microscope_photo)("image")
    return _pictures(spark, sf_dir).select("vec_id", F.sha2(out["data"], 256).alias("digest"))


@_query()
def encoded_pictures(spark, sf_dir):
    """X14, X15, D20."""
    return image.encode_images(_pictures(spark, sf_dir), image.ColorLayout).select("vec_id", "feat")


@_query()
def ransac_fit(spark, sf_dir):
    """Groups of orders whose points follow one transform but for every fifth."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    qx, qy = (k * 37 % 1000).cast("double"), (k * k * 91 % 997).cast("double")
    off = F.when(k % 5 == 0, (k % 300 + 40).cast("double")).otherwise(0.0)
    pairs = _t(spark, sf_dir, "orders").select((c % 50).alias("group_id"), qx.alias("qx"), qy.alias("qy"), (1.1 * qx + 0.1 * qy + 30 + off).alias("cx"), (0.9 * qy - 0.05 * qx + 12 + off).alias("cy"))
    return localize.ransac(pairs).select("group_id", "success", "inliers", "matches")


from gridseek import mask_queries, slide_queries  # noqa: E402, F401  add their own
