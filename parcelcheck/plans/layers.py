"""A whole layer: repair, measure, joins, overlap, verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions.rings import settle
from parcelcheck.functions.trace import named_trace_polygon
from parcelcheck.operators.lookup import country_codes, ecoregion_per_id, with_country_flag
from parcelcheck.operators.measure import measure
from parcelcheck.operators.overlap import partners_per_id
from parcelcheck.operators.repair import repair
from parcelcheck.operators.skew import HOT_ROWS, join_per_key
from parcelcheck.params import GPS_ACCURACY_M, RAW_GPS_ACCURACY_M, LayerSpec
from parcelcheck.plans.rules import add_verdict, eligible
from parcelcheck.session import stage


def repeated_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids that occur more than once; counts combine on the map side."""
    return (
        df.groupBy(id_column)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
        .select(id_column, F.lit(True).alias("duplicate_id"))
    )


def flag_duplicate_ids(
    df: DataFrame, id_column: str, spread_by, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """True on every copy of an id that occurs more than once."""
    repeated = repeated_ids(df, id_column)
    return join_per_key(df, repeated, [id_column], spread_by, hot_rows).withColumn(
        "duplicate_id", F.coalesce("duplicate_id", F.lit(False))
    )


def build_layer(
    shapes: DataFrame,
    spec: LayerSpec,
    countries: DataFrame | None = None,
    ecoregions: DataFrame | None = None,
    geojson: bool = True,
) -> DataFrame:
    """Check one layer of polygons (column ``geom``) against its rules.

    Repair and measures are row work in one pass; the result is staged once
    because the joins after it read the table several times. Generation 2
    takes every shape as in the country and no id as a duplicate.
    """
    id_column = spec.id_column
    measured = stage(
        measure(repair(shapes, generation=spec.generation), spec).withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "measured",
    )
    # Everything below reads the staged table; no join result is computed twice.
    if spec.generation == 1:
        codes = stage(
            country_codes(measured.select(F.col("_row").alias("shape"), "geom"), countries, spec.country)
            .withColumnRenamed("shape", "_row"),
            "countries",
        )
        placed = with_country_flag(measured.join(codes, "_row", "left"), spec.country)
        per_id = [repeated_ids(measured, id_column)]
        if ecoregions is not None:
            per_id.append(ecoregion_per_id(measured, ecoregions, id_column))
    else:
        placed = measured.withColumn("in_country", F.lit(True)).withColumn(
            "duplicate_id", F.lit(False)
        )
        per_id = []
    per_id.append(
        partners_per_id(
            placed,
            id_column,
            spec.min_overlap,
            spec.overlap_buffer_m,
            eligible(spec),
            cell_m=2 * spec.radius_m,
        )
    )
    # All are grouped by id already, so these joins need no further shuffle.
    results = reduce(lambda x, y: x.join(y, id_column, "full_outer"), per_id)
    out = join_per_key(placed, results, [id_column], ["_row"]).withColumn(
        "overlap_ids", F.coalesce("overlap_ids", F.lit(""))
    )
    if spec.generation == 1:
        out = out.withColumn("duplicate_id", F.coalesce("duplicate_id", F.lit(False)))
    else:
        out = out.withColumn("percentage_overlap_float", F.col("percentage_overlap"))
    return add_verdict(out.drop("_row"), spec, geojson)


def checked_and_raw(rows: DataFrame, trace: str, spec: LayerSpec) -> tuple[DataFrame, DataFrame]:
    """Generation 2: the checked layer and, beside it, the raw one.

    The raw layer keeps every vertex measured within a kilometre, accuracy
    zero included, and is neither repaired nor checked. A layer without any
    shape is returned unchecked.
    """
    strict = settle(rows, geom=named_trace_polygon(trace, GPS_ACCURACY_M, False))
    raw = settle(rows, geom=named_trace_polygon(trace, RAW_GPS_ACCURACY_M, True))
    if strict.where(F.size("geom") > 0).isEmpty():
        return strict, raw
    return build_layer(strict, spec), raw


def join_plots_subplots(plots: DataFrame, subplots: DataFrame) -> DataFrame:
    """Full outer join on ``KEY = PARENT_KEY``; plot keys must be unique."""
    repeated = plots.groupBy("KEY").count().where(F.col("count") > 1)
    guard = repeated.agg(
        F.when(
            F.count(F.lit(1)) > 0, F.raise_error(F.lit("plot keys repeat: join is not 1:m"))
        ).cast("string").alias("g")
    )
    joined = plots.withColumnRenamed("KEY", "_key").join(
        subplots, F.col("_key") == F.col("PARENT_KEY"), "full_outer"
    )
    return joined.withColumn("_guard", guard.scalar()).where(F.col("_guard").isNull()).drop("_guard", "_key", "PARENT_KEY")


def split_by_validity(df: DataFrame, flag: str = "valid") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(flag)), df.where(~F.col(flag))


def stack_by_validity(valid: DataFrame, invalid: DataFrame) -> DataFrame:
    return valid.withColumn("valid", F.lit(True)).unionByName(
        invalid.withColumn("valid", F.lit(False)), allowMissingColumns=True
    )
