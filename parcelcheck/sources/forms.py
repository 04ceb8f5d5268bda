"""Readers for survey forms, reference layers and attribute tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelcheck.functions import rings as R
from parcelcheck.functions.text import from_text
from parcelcheck.operators.reshape import SUBPLOTS_PER_PLOT

S, D, TS, L = T.StringType(), T.DoubleType(), T.TimestampNTZType(), T.LongType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# The columns of the third form, and of the attribute file.
FORM_V3 = _schema(
    k=L,
    starttime=TS,
    enumerator=S,
    enumerator_id=S,
    device_info=S,
    gt_plot=S,
    **{f"gt_subplot_{i}": S for i in range(1, SUBPLOTS_PER_PLOT + 1)},
)
NDVI_SLOPE = _schema(plot_id=S, mean_ndvi=D, mean_slope=D)

# Keys of the five linked levels, as (read name, name in the joins).
LEVEL_KEYS = {
    "plots": {"KEY": "PLOT_KEY"},
    "subplots": {"PARENT_KEY": "PLOT_KEY", "KEY": "SUBPLOT_KEY"},
    "vegetation": {"PARENT_KEY": "SUBPLOT_KEY", "KEY": "VEGETATION_KEY"},
    "measurement": {"PARENT_KEY": "VEGETATION_KEY", "KEY": "MEASUREMENT_KEY"},
    "circumference": {"PARENT_KEY": "MEASUREMENT_KEY", "KEY": "CIRCUMFERENCE_KEY"},
}


def read_table(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None, pattern: str | None = None
) -> DataFrame:
    """CSV, JSON or Parquet with an explicit schema; ``pattern`` picks files."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_forms(
    spark: SparkSession,
    versions: Mapping[str, tuple[str, T.StructType, Callable[[DataFrame], DataFrame] | None]],
    root: str,
    pattern: str | None = None,
) -> DataFrame:
    """Stack the form versions under ``root`` by column name.

    ``versions`` maps a folder to its format, schema and an optional step that
    brings it to the common columns. Each row keeps the file it came from.
    """
    parts = []
    for folder, (fmt, schema, step) in versions.items():
        df = read_table(spark, f"{root}/{folder}", fmt, schema, pattern)
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
        parts.append(step(df) if step else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_levels(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", schemas: Mapping[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """The five linked levels with their keys renamed for the joins."""
    schemas = schemas or {}
    return {
        level: rename_keys(read_table(spark, paths[level], fmt, schemas.get(level)), level)
        for level in LEVEL_KEYS
        if level in paths
    }


def rename_keys(df: DataFrame, level: str) -> DataFrame:
    return df.withColumnsRenamed(LEVEL_KEYS[level])


def polygon_layer(df: DataFrame, rename: Mapping[str, str], text: str = "geometry") -> DataFrame:
    """Keep and rename the named columns and parse the geometry text."""
    return R.settle(df, geom=from_text(F.col(text))).select(
        *[F.col(old).alias(new) for old, new in rename.items()], "geom"
    )


def country_layer(df: DataFrame, iso3: str | None = None) -> DataFrame:
    """Country polygons; the filter on the code sits below the parsing."""
    rows = df if iso3 is None else df.where(F.col("iso3") == iso3)
    return polygon_layer(rows, {"iso3": "iso3", "name": "name"})


def ecoregion_layer(df: DataFrame) -> DataFrame:
    return polygon_layer(df, {"ECO_NAME": "ecoregion"})


def sampled_plots(df: DataFrame, text: str = "geometry") -> DataFrame:
    """Parse sampled plots: WKT, else GeoJSON, else NULL for the quarantine."""
    return R.settle(df, geom=from_text(F.col(text)))


def ndvi_slope(spark: SparkSession, path: str) -> DataFrame:
    """Remote-sensing attributes; only the three columns needed are read."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in NDVI_SLOPE.fields}
    full = T.StructType([T.StructField(c, known.get(c, S)) for c in header])
    return read_table(spark, path, "csv", full).select(*NDVI_SLOPE.names)


def attach_attributes(plots: DataFrame, attributes: DataFrame, key: str = "plot_id") -> DataFrame:
    """Left lookup of the attributes a table does not have yet.

    No broadcast hint: AQE broadcasts when the measured size allows and
    splits a skewed side otherwise.
    """
    missing = [c for c in attributes.columns if c != key and c not in plots.columns]
    if not missing:
        return plots
    return plots.join(attributes.select(key, *missing), key, "left")


def country_lookup(df: DataFrame) -> DataFrame:
    """Distinct (iso3, name) pairs without nulls, by name."""
    return (
        df.select("iso3", "name").dropna().dropDuplicates(["iso3", "name"]).orderBy("name", "iso3")
    )


