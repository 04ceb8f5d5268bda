"""Writers for checked layers and their reload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelcheck.functions.text import feature_count
from parcelcheck.sources.forms import attach_attributes

# Fixed value: columns of an exported layer.
EXPORT_COLUMNS = [
    "plot_id",
    "subplot_id",
    "enumerator_id",
    "enumerator",
    "collection_date",
    "device",
    "geom",
    "ecoregion",
    "length_width_ratio",
    "length_width_ratio_too_big",
    "mrr_ratio",
    "protruding_ratio_too_big",
    "overlapping_countries",
    "in_country",
    "duplicate_id",
    "area_m2",
    "nr_vertices",
    "nr_vertices_too_small",
    "in_radius",
    "overlap_ids",
    "percentage_overlap",
    "reasons",
    "valid",
    "geojson",
]
SELECTED_COLUMNS = ["plot_id", "area_ha", "geom", "enumerator", "collection_date"]


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns a table has, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def exportable(df: DataFrame, name: str = "export") -> tuple[DataFrame, Observation]:
    """Rows whose feature text reads and has a feature, and the count of the rest.

    The observation fills while the rows are written; no extra pass.
    """
    watch = Observation(name)
    good = feature_count(F.col("geojson")) > 0
    return (
        df.observe(
            watch,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~good).alias("bad_shapes"),
        ).where(good),
        watch,
    )


def feature_line(df: DataFrame) -> Column:
    """One GeoJSON feature per row, all columns but the shapes as properties."""
    properties = [c for c in df.columns if c not in ("geom", "geojson", "valid")]
    geometry = F.get_json_object("geojson", "$.features[0].geometry")
    return F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
        F.lit(',"geometry":'),
        geometry,
        F.lit("}"),
    )


def write_layer(df: DataFrame, path: str) -> None:
    """Full table split by validity, and newline GeoJSON of the good shapes."""
    out = present(df, EXPORT_COLUMNS)
    out.write.mode("overwrite").partitionBy("valid").parquet(f"{path}/table")
    good, _ = exportable(out)
    good.select(feature_line(good).alias("value"), "valid").write.mode("overwrite").partitionBy(
        "valid"
    ).text(f"{path}/features")


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """Reload a written layer; ``valid`` comes from the partition."""
    return spark.read.parquet(f"{path}/table").withColumn("valid", F.col("valid").cast("boolean"))


def reload_sampled(spark: SparkSession, path: str, attributes: DataFrame | None) -> DataFrame:
    """Sampled plots as written, with vegetation index and slope if they lack them."""
    plots = spark.read.parquet(path)
    return plots if attributes is None else attach_attributes(plots, attributes)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sampled(df: DataFrame, path: str) -> None:
    present(df, SELECTED_COLUMNS).write.mode("overwrite").parquet(path)


def write_lookup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
