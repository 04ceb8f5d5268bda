"""Mean vegetation index per plot from a long pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcheck.functions import rings as R
from parcelcheck.operators import cells as C
from parcelcheck.params import CLOUD_LIMIT_PCT, NDVI_LOOKBACK_DAYS, NDVI_SCENES
from parcelcheck.session import stage


def usable_pixels(pixels: DataFrame, as_of: str, cloud_limit: int = CLOUD_LIMIT_PCT, days: int = NDVI_LOOKBACK_DAYS) -> DataFrame:
    """Low-cloud pixels of the look-back window; both filters reach the scan."""
    end = f"timestamp_ntz'{as_of}'"
    return pixels.where(F.col("cloud_pct") <= cloud_limit).where(
        F.expr(f"ts >= {end} - interval {days} days AND ts < {end}")
    )


def pixels_in_plots(pixels: DataFrame, plots: DataFrame, cell: float) -> DataFrame:
    """Pixel rows with the plot they lie in: cell equi-join, then crossing parity."""
    shapes = C.place(
        plots.where(F.size("geom") > 0).select(
            "plot_id", R.edges(F.col("geom")).alias("edges"), R.bbox(F.col("geom")).alias("box")
        ),
        "box",
        cell,
    )
    placed = pixels.withColumn("cx", F.floor(F.col("x") / cell)).withColumn(
        "cy", F.floor(F.col("y") / cell)
    )
    b = F.col("box")
    return (
        placed.join(shapes, ["cx", "cy"])
        .where(F.col("x").between(b["minx"], b["maxx"]) & F.col("y").between(b["miny"], b["maxy"]))
        .where(R.inside(F.col("edges"), F.col("x"), F.col("y")))
        .drop("edges", "box", "cx", "cy")
    )


def latest_scenes(hits: DataFrame, n: int = NDVI_SCENES) -> DataFrame:
    """The newest ``n`` scenes of each plot.

    Scenes are made distinct first; the rank filter is applied on the map
    side as well, so a plot with many scenes sends few rows.
    """
    scenes = hits.select("plot_id", "scene_id", "ts").distinct()
    newest = Window.partitionBy("plot_id").orderBy(F.col("ts").desc(), F.col("scene_id"))
    return scenes.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def ndvi(b8: Column, b4: Column) -> Column:
    return F.try_divide(b8 - b4, b8 + b4)


def mean_ndvi(plots: DataFrame, pixels: DataFrame, as_of: str, cell: float = 0.01, n: int = NDVI_SCENES) -> DataFrame:
    """``plot_id, mean_ndvi, image_dates``; plots without a scene get NULL and no dates.

    Mean over scenes per pixel first, then over the pixels of the plot. Pixels
    are read and joined once; scenes, dates and values come from the staged hits.
    """
    found = pixels_in_plots(usable_pixels(pixels, as_of), plots, cell)
    hits = stage(found.select("plot_id", "scene_id", "ts", "x", "y", "b4", "b8"), "pixel-hits")
    chosen = latest_scenes(hits, n)
    dates = chosen.groupBy("plot_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list("ts"), asc=False),
                lambda t: F.date_format(t, "yyyy-MM-dd"),
            ),
            ",",
        ).alias("image_dates")
    )
    values = (
        hits.join(chosen.select("plot_id", "scene_id"), ["plot_id", "scene_id"], "left_semi")
        .groupBy("plot_id", "x", "y")
        .agg(F.avg(ndvi(F.col("b8"), F.col("b4"))).alias("v"))
        .groupBy("plot_id")
        .agg(F.avg("v").alias("mean_ndvi"))
    )
    return (
        plots.select("plot_id")
        .join(values, "plot_id", "left")
        .join(dates, "plot_id", "left")
        .withColumn("image_dates", F.coalesce("image_dates", F.lit("")))
    )
