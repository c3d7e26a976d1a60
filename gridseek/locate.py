"""The whole search: resolution, window, refinement."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.functions.image import IMAGE, decode, encode_images, encode_row, luma
from gridseek.operators import grid, knn, levels, localize, retrieval, sampling
from gridseek.plans.durable import broadcast_if_small, materialize
from gridseek.plans.stages import Stages, fingerprint
from gridseek.sources.slides import CHUNK, cached_features, level0_reads, read_regions


def estimate_resolution(query_main: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """One row ``(estimate, n_queries)`` from the query's main tiles ``(query_id, feat)``."""
    return knn.label_estimate(query_main, bank, k)


def level_of(estimate: float, level_rows: DataFrame, base_mpp: float) -> int:
    """The level of a resolution; raises where none matches or metadata are missing."""
    if not base_mpp or estimate is None:
        raise ValueError("the resolution of the slide or of the query is unknown")
    asked = level_rows.sparkSession.createDataFrame([(estimate / base_mpp,)], "want_ds double")
    level = levels.matching_level(asked, level_rows).first()["level"]
    if level is None:
        raise ValueError(f"no level of {estimate} microns a pixel")
    return level


def locate(grid: DataFrame, kernel: DataFrame, regions: DataFrame, tile: int, ds: float, refined: DataFrame | None = None) -> DataFrame:
    """One row: the best window, at its refined place ``(x, y, success)`` if refinement succeeded."""
    best = retrieval.find_best(retrieval.window_similarity(grid, kernel, best_only=True), regions, tile, ds)
    if refined is None:
        return best.withColumn("refined", F.lit(False))
    one = refined.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("success").alias("__ok")).limit(1)
    both = best.join(F.broadcast(one), F.lit(True), "left")
    ok = F.coalesce("__ok", F.lit(False))
    return both.withColumns({"x": F.when(ok, F.col("__x")).otherwise(F.col("x")), "y": F.when(ok, F.col("__y")).otherwise(F.col("y")), "refined": ok}).drop("__x", "__y", "__ok")


def slide_features(chunks: DataFrame, regions: DataFrame, tile: int, ds: float, level: int, make, chunk: int = CHUNK) -> DataFrame:
    """``(slide_id, region_index, kind, row, col, x, y, feat)``: :func:`level_features` of one level of all slides."""
    needed = regions.select("slide_id").distinct().select("slide_id", F.lit(level).alias("level"), F.lit(float(ds)).alias("ds"))
    return level_features(chunks, regions, needed, tile, make, chunk).drop("level")


def level_features(chunks: DataFrame, regions: DataFrame, needed: DataFrame, tile: int, make, chunk: int = CHUNK, cache: str | None = None) -> DataFrame:
    """``(slide_id, level, region_index, kind, row, col, x, y, feat)``: encoded tiles of both layers of all regions.

    ``regions`` is ``(slide_id, region_index, x, y, w, h)`` at level 0, ``needed`` the levels ``(slide_id, level, ds)`` that are
    wanted, ``make`` builds the encoder once in a task. Chunks of other levels are pruned at run time where the chunk table is
    partitioned by slide and level. ``cache`` names a feature table that gets what it lacks, so that a tile is encoded once.
    """
    both = regions.join(needed, "slide_id")
    cut = lambda c: (F.col(c) / F.col("ds")).cast("int")
    grids = both.select(
        "slide_id", "region_index", cut("w").alias("width"), cut("h").alias("height"), cut("x").alias("x_off"), cut("y").alias("y_off"),
        F.lit(tile).alias("tile"), "ds", "level",
    )
    # fewer than 2^4 levels and 2^14 regions of a slide, and 2^26 tiles of a region
    number = ((F.col("slide_id").cast("long") * 16 + F.col("level")) * (1 << 14) + F.col("region_index")) * (1 << 26) + F.col("flat_idx")
    tiles = grid.patches(grids).withColumn("read_id", number)
    wanted = broadcast_if_small(materialize(needed.select("slide_id", "level").distinct())).where("level >= 0")

    def encode(missing: DataFrame) -> DataFrame:
        asked = missing.select("read_id", "slide_id", "level", F.col("x").alias("px"), F.col("y").alias("py"), F.col("size_px").alias("pw"), F.col("size_px").alias("ph"))
        return encode_images(read_regions(chunks.join(wanted, ["slide_id", "level"]), asked, chunk), make).select("read_id", "feat")

    encoded = encode(tiles) if cache is None else cached_features(tiles, cache, encode, ("read_id",)).select("read_id", "feat")
    return tiles.join(encoded, "read_id").select("slide_id", "level", "region_index", "kind", "row", "col", "x", "y", "feat")


def query_features(queries: DataFrame, tile: int, make) -> DataFrame:
    """``(query_id, q_row, q_col, feat)``: encoded main tiles of query images ``(query_id, image)``."""
    cells = T.ArrayType(T.StructType([T.StructField("q_row", T.IntegerType()), T.StructField("q_col", T.IntegerType()), T.StructField("image", IMAGE)]))

    @F.pandas_udf(cells)
    def cut(images: pd.DataFrame) -> pd.Series:
        out = []
        for row in images.to_dict("records"):
            p = decode(row)
            places = [(r, c) for r in range(p.shape[0] // tile) for c in range(p.shape[1] // tile)]
            out.append([{"q_row": r, "q_col": c, "image": encode_row(p[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile])} for r, c in places])
        return pd.Series(out, dtype="object")

    tiles = queries.select("query_id", F.explode(cut("image")).alias("tile")).select("query_id", "tile.*")
    return encode_images(tiles, make).select("query_id", "q_row", "q_col", "feat")


def resolution_bank(chunks: DataFrame, tiles: DataFrame, levels: DataFrame, tile: int, make, chunk: int = CHUNK) -> DataFrame:
    """``(slide_id, ref_id, label, feat)``: sampled tiles encoded and labelled with their level's resolution.

    ``tiles`` is ``(slide_id, level, nth, x, y)`` with places at level 0, as :func:`gridseek.operators.sampling.sample_tiles` gives
    them; ``levels`` is ``(slide_id, level, ds, mpp)``.
    """
    number = (F.col("slide_id").cast("long") * 16 + F.col("level")) * (1 << 32) + F.col("nth")
    named = tiles.select(number.alias("read_id"), "slide_id", "level", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(tile).alias("pw"), F.lit(tile).alias("ph"))
    encoded = encode_images(read_regions(chunks, level0_reads(named, levels), chunk), make)
    labels = named.join(levels.select("slide_id", "level", F.col("mpp").alias("label")), ["slide_id", "level"])
    return labels.join(encoded.select("read_id", "feat"), "read_id").select("slide_id", F.col("read_id").alias("ref_id"), "label", "feat")


def query_resolutions(queries: DataFrame, bank: DataFrame, tile: int, k: int, make) -> DataFrame:
    """``(slide_id, query_id, mpp, n_tiles)``: the median over a query's tiles of their medians over ``k`` neighbours."""
    # fewer than 2^10 tiles along a side of a query
    number = (F.col("query_id").cast("long") * (1 << 10) + F.col("q_row")) * (1 << 10) + F.col("q_col")
    cells = query_features(queries, tile, make).select(number.alias("query_id"), "feat")
    slides = broadcast_if_small(materialize(bank.select("slide_id").distinct()))
    votes = knn.label_votes(cells.join(slides, F.lit(True)), bank, k, keys=("slide_id",))
    return votes.groupBy("slide_id", F.floor(F.col("query_id") / (1 << 20)).alias("query_id")).agg(F.median("label").alias("mpp"), F.count(F.lit(1)).alias("n_tiles"))


def chosen_levels(resolutions: DataFrame, level_rows: DataFrame, tol: float = 1e-3) -> DataFrame:
    """``(slide_id, query_id, level)``: each query's level in each slide, null where none has its resolution.

    ``resolutions`` is ``(slide_id, query_id, mpp)``, ``level_rows`` ``(slide_id, level, ds, mpp)``.
    """
    base = level_rows.where("level = 0").select("slide_id", F.col("mpp").alias("base_mpp"))
    asked = resolutions.join(base, "slide_id").select("slide_id", "query_id", F.when(F.col("base_mpp") > 0, F.col("mpp") / F.col("base_mpp")).alias("want_ds"))
    return levels.matching_level(asked, level_rows.select("slide_id", "level", "ds"), tol, ("slide_id",)).select("slide_id", "query_id", "level")


def search(
    chunks: DataFrame, regions: DataFrame, level_rows: DataFrame, queries: DataFrame, tile: int, make_encoder, make_extractor=None, samples: DataFrame | None = None,
    k: int = 15, stages: Stages | None = None, version: str = "", pad: int = 1, least: int = 10, chunk: int = CHUNK,
) -> DataFrame:
    """From chunks and query images of any resolutions to places, each query at its own level of each slide.

    ``queries`` is ``(query_id, image[, mpp])``: a given resolution skips the estimate, which is otherwise made from the bank of
    ``samples (slide_id, level, nth, x, y)``. With ``stages`` the bank and the features are kept: the bank by the fingerprint
    of samples, levels and chunks' places and by ``version``, which tells the contents and the encoder; features by ``version``.
    Pairs of a slide and a query without a level of that resolution have no row. Columns as of :func:`find_at_levels`.
    """
    given = queries.where("mpp IS NOT NULL") if "mpp" in queries.columns else queries.where("false")
    slides = level_rows.select("slide_id").distinct()
    told = given.select("query_id", F.col("mpp") if "mpp" in queries.columns else F.lit(None).cast("double").alias("mpp")).join(slides, F.lit(True)).select("slide_id", "query_id", "mpp")
    unknown = queries.join(given.select("query_id"), "query_id", "left_anti")
    if samples is not None:
        build = lambda: resolution_bank(chunks, samples, level_rows, tile, make_encoder, chunk)
        if stages is None:
            bank = materialize(build())
        else:
            places = fingerprint(chunks, "slide_id", "level", "ty", "tx")
            bank = stages.get("bank", {"samples": fingerprint(samples), "levels": fingerprint(level_rows), "chunks": places, "tile": tile, "version": version}, build)
        estimated = query_resolutions(unknown.select("query_id", "image"), bank, tile, k, make_encoder)
        told = told.unionByName(estimated.select("slide_id", "query_id", "mpp"))
    chosen = chosen_levels(told, level_rows)
    cache = None if stages is None else stages.path("features", {"tile": tile, "version": version, "regions": fingerprint(regions)})
    return find_at_levels(chunks, regions, level_rows, queries.select("query_id", "image"), chosen, tile, make_encoder, make_extractor, pad, least, chunk, cache)


def find_in_slides(
    chunks: DataFrame, regions: DataFrame, queries: DataFrame, tile: int, ds: float, level: int, make_encoder, make_extractor=None,
    pad: int = 1, least: int = 10, chunk: int = CHUNK,
) -> DataFrame:
    """Every query's place in every slide at one level of all slides: :func:`find_at_levels` without its column ``level``."""
    slides = regions.select("slide_id").distinct()
    rows = slides.select("slide_id", F.lit(level).alias("level"), F.lit(float(ds)).alias("ds"))
    chosen = slides.join(queries.select("query_id"), F.lit(True)).withColumn("level", F.lit(level))  # a row of the result each
    return find_at_levels(chunks, regions, rows, queries, chosen, tile, make_encoder, make_extractor, pad, least, chunk).drop("level")


def find_at_levels(
    chunks: DataFrame, regions: DataFrame, level_rows: DataFrame, queries: DataFrame, chosen: DataFrame, tile: int, make_encoder, make_extractor=None,
    pad: int = 1, least: int = 10, chunk: int = CHUNK, cache: str | None = None,
) -> DataFrame:
    """Every query's place in every slide, from images: best window, and its refinement if it succeeds.

    ``chosen`` is ``(slide_id, query_id, level)``: the level at which a query is looked for, with its ``ds`` in ``level_rows``; rows
    without a level give nothing. ``(slide_id, query_id, level, kind, region_index, window_x, window_y, score, x, y, x0, y0,
    refined)``, one row for each of ``chosen``; the best slide of a query is the one of the largest score.
    """
    keys = ("slide_id", "query_id", "level")
    chosen = materialize(chosen.where("level IS NOT NULL").select(*keys).join(level_rows.select("slide_id", "level", "ds"), ["slide_id", "level"]))
    needed = chosen.select("slide_id", "level", "ds").distinct()
    features = level_features(chunks, regions, needed, tile, make_encoder, chunk, cache)
    kernels = query_features(queries, tile, make_encoder).join(chosen.select(*keys), "query_id")
    at = ("slide_id", "level")
    scores = retrieval.window_similarity(features, kernels, at, ("query_id",), match=at, best_only=True)
    best = retrieval.find_best(scores, regions.join(needed, "slide_id"), tile, "ds", keys, at)
    best = best.select(*keys, "kind", "region_index", F.col("x").alias("window_x"), F.col("y").alias("window_y"), "score")
    best = materialize(best.join(chosen, list(keys)))
    if make_extractor is None:
        placed = best.withColumns({"x": F.col("window_x"), "y": F.col("window_y"), "refined": F.lit(False)})
    else:
        # crops around the windows: whole tiles of the query, padded by tiles, inside the region
        local = {c: (F.col(f"r{c}") / F.col("ds")).cast("int") for c in "xywh"}
        where = best.join(regions.select("slide_id", "region_index", *[F.col(c).alias(f"r{c}") for c in "xywh"]), ["slide_id", "region_index"])
        where = where.join(queries.select("query_id", F.col("image.height").alias("qh"), F.col("image.width").alias("qw")), "query_id")
        x = grid.search_window(F.col("window_x") - local["x"], F.col("qw"), F.lit(tile), F.lit(pad), local["w"])
        y = grid.search_window(F.col("window_y") - local["y"], F.col("qh"), F.lit(tile), F.lit(pad), local["h"])
        group = F.col("slide_id").cast("long") * (1 << 32) + F.col("query_id")  # both below 2^31
        crops = where.select(
            group.alias("group_id"), *keys, F.col("window_x").alias("x"), F.col("window_y").alias("y"), (local["x"] + x[0]).alias("crop_x"), (local["y"] + y[0]).alias("crop_y"),
            (x[1] - x[0]).alias("pw"), (y[1] - y[0]).alias("ph"),
        )
        asked = crops.select(F.col("group_id").alias("read_id"), "slide_id", "level", F.col("crop_x").alias("px"), F.col("crop_y").alias("py"), "pw", "ph")
        pictures = read_regions(chunks, asked, chunk).withColumnRenamed("read_id", "group_id")
        asks = crops.select("group_id", "query_id").join(queries.select("query_id", "image"), "query_id").select("group_id", "image")
        refined = localize.refine(asks, pictures, crops.select("group_id", "x", "y", "crop_x", "crop_y"), make_extractor, least)
        placed = best.join(crops.select("group_id", *keys).join(refined, "group_id").drop("group_id"), list(keys))
    zero = lambda c: (F.col(c) * F.col("ds")).cast("int")
    return placed.select(*keys, "kind", "region_index", "window_x", "window_y", "score", "x", "y", zero("x").alias("x0"), zero("y").alias("y0"), "refined")


def statistic_fingerprints(chunks: DataFrame, level_rows: DataFrame, statistic, tile: int, n: int = 40, tries: int = 6, least: float = 6.0, chunk: int = CHUNK) -> DataFrame:
    """``(slide_id, level, stat, mpp)``: the median of a statistic over ``n`` tiles of each level that aren't blank.

    Places come from the fixed stream of :func:`gridseek.operators.sampling.candidates`, ``tries * n`` at most for a level. They are
    drawn in rounds of ``n``, and a round reads only levels that still lack tiles, at most as many as they may still need.
    ``level_rows`` is ``(slide_id, level, ds, mpp, width, height)``; levels not larger than a tile have none, as have
    levels of blank tiles only: their statistic is NaN. ``statistic`` is a column function of images.
    """
    by = ("slide_id", "level")
    boxes = level_rows.where((F.col("width") > tile) & (F.col("height") > tile))
    boxes = boxes.select(*by, F.lit(0).alias("index"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))
    stream = materialize(sampling.candidates(boxes, tries * n, tile, by))
    tones = F.pandas_udf(lambda images: pd.Series([float(luma(decode(r)).std()) for r in images.to_dict("records")], dtype="float64"), T.DoubleType())
    found, lacking = None, stream.select(*by).distinct().withColumn("n", F.lit(0).cast("long"))
    for k in range(tries):
        now = stream.where((F.col("try") >= k * n) & (F.col("try") < (k + 1) * n)).join(lacking.where(F.col("n") < n).select(*by), list(by))
        # fewer than 2^4 levels of a slide and 2^28 tries
        number = (F.col("slide_id").cast("long") * 16 + F.col("level")) * (1 << 28) + F.col("try")
        asked = now.select(number.alias("read_id"), *by, F.col("x").alias("px"), F.col("y").alias("py"), F.col("size").alias("pw"), F.col("size").alias("ph"))
        seen = read_regions(chunks, asked, chunk).select("read_id", tones("image").alias("deviation"), statistic("image").alias("stat"))
        part = seen.where(F.col("deviation") >= least).select(
            F.floor(F.col("read_id") / (1 << 32)).alias("slide_id"), (F.floor(F.col("read_id") / (1 << 28)) % 16).cast("int").alias("level"), (F.col("read_id") % (1 << 28)).alias("try"), "deviation", "stat"
        )
        found = materialize(part if found is None else found.union(part))
        held = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        lacking = materialize(stream.select(*by).distinct().join(held, list(by), "left").select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("n")))
        if not lacking.where(F.col("n") < n).take(1):
            break
    told = sampling.level_fingerprint(found, n, by, level_rows)
    return told.join(level_rows.select(*by, "mpp"), list(by)).select(*by, "stat", "mpp")


def estimate_from_statistics(queries: DataFrame, references: list[DataFrame], statistics: list, k: int = 3) -> DataFrame:
    """``(slide_id, query_id, level, mpp, weighted_mpp, spread)`` of query images ``(query_id, image)`` by one statistic or several.

    ``references`` are :func:`statistic_fingerprints` of the same levels, one for each of ``statistics``. ``level`` is the nearest by
    the first, ``mpp`` interpolated by it, and ``weighted_mpp`` the mean in logarithms over the ``k`` levels that are nearest in
    all statistics, standardised over a slide's levels (A8, A9, W4). ``spread`` lists the first statistic by level (A24).
    """
    names = [f"stat{i}" for i in range(len(references))]
    both = references[0].select("slide_id", "level", "mpp", F.col("stat").alias("stat0"))
    for name, other in zip(names[1:], references[1:]):
        both = both.join(other.select("slide_id", "level", F.col("stat").alias(name)), ["slide_id", "level"])
    ok = both.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) for n in names]))
    both = materialize(ok)
    seen = queries.select("query_id", *[s("image").alias(n) for n, s in zip(names, statistics)])
    asked = materialize(seen.join(both.select("slide_id").distinct(), F.lit(True)))  # a row of the result each
    one = both.withColumnRenamed("stat0", "stat")
    near = levels.nearest_level(asked, one, want="stat0", keys=("slide_id",)).select("slide_id", "query_id", "level")
    between = levels.interpolate(asked, one, want="stat0", keys=("slide_id",)).select("slide_id", "query_id", "mpp")
    moments = both.groupBy("slide_id").agg(*[f(n).alias(f"{c}_{n}") for n in names for c, f in (("m", F.avg), ("s", F.stddev_pop))])
    met = asked.join(both.select("slide_id", "level", F.col("mpp"), *[F.col(n).alias(f"r_{n}") for n in names]), "slide_id").join(moments, "slide_id")
    apart = [F.pow((F.col(n) - F.col(f"r_{n}")) / (F.col(f"s_{n}") + 1e-9), 2) for n in names]
    pairs = met.select("slide_id", "query_id", "level", "mpp", F.sqrt(reduce(lambda a, b: a + b, apart)).alias("dist"))
    order = Window.partitionBy("slide_id", "query_id").orderBy("dist", "level")  # the levels of a slide
    nearest = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    mean = levels.weighted_log_mean(nearest, ["slide_id", "query_id"]).withColumnRenamed("estimate", "weighted_mpp")
    spread = levels.level_spread(one.select("slide_id", "level", "stat", "mpp"), ["slide_id"])
    by = ["slide_id", "query_id"]
    return near.join(between, by).join(mean, by).join(spread, "slide_id").select(*by, "level", "mpp", "weighted_mpp", "spread")
