"""Quality rules: eligibility, reasons, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions.text import to_geojson
from parcelcheck.operators.long_rings import is_valid
from parcelcheck.operators.measure import over
from parcelcheck.params import LayerSpec

# Texts of the rules, in the order they are reported.
MISSING = "Geometry missing"
EMPTY = "Empty geometry"
INVALID = "Invalid geometry"
OVERLAPPING = "Overlapping polygons"
DUPLICATE = "Duplicate plot id"
OUTSIDE_COUNTRY = "Boundary not in country"
OUTSIDE_RADIUS = "Plot outside of radius"
TOO_SMALL = "Plot too small"
TOO_BIG = "Plot too big"
FEW_VERTICES = "Nr vertices <= 3"
PROTRUDING = "Plot is protruding"


def eligible(spec: LayerSpec) -> Column:
    """Rows that take part in the overlap test; limits are strict."""
    area = F.col("area_m2")
    return F.coalesce(
        F.col("in_country")
        & F.col("in_radius")
        & (area > spec.min_area)
        & (area < spec.max_area)
        & ~F.col("protruding_ratio_too_big")
        & ~F.col("nr_vertices_too_small"),
        F.lit(False),
    )


def reason_list(spec: LayerSpec, valid: Column | None = None, has: set[str] | None = None) -> Column:
    """Failed rules as an array of texts.

    A missing, empty or invalid geometry is reported alone. ``valid`` is the
    validity of the geometry (all true after repair). ``has`` limits the
    rules to the columns at hand.
    """
    area = F.col("area_m2")
    ladder = [
        ("overlap_ids", F.length("overlap_ids") > 0, OVERLAPPING),
        ("duplicate_id", F.col("duplicate_id"), DUPLICATE),
        ("in_country", ~F.coalesce(F.col("in_country"), F.lit(False)), OUTSIDE_COUNTRY),
        ("in_radius", ~F.coalesce(F.col("in_radius"), F.lit(False)), OUTSIDE_RADIUS),
        ("area_m2", area < spec.min_area, TOO_SMALL),
        ("area_m2", over(area, spec.max_area), TOO_BIG),
        ("nr_vertices_too_small", F.col("nr_vertices_too_small"), FEW_VERTICES),
        ("protruding_ratio_too_big", F.col("protruding_ratio_too_big"), PROTRUDING),
    ]
    failed = F.array_compact(
        F.array(*[F.when(test, text) for column, test, text in ladder if has is None or column in has])
    )
    geom = F.col("geom")
    out = F.when(geom.isNull(), F.array(F.lit(MISSING))).when(
        F.size(geom) == 0, F.array(F.lit(EMPTY))
    )
    if valid is not None:
        out = out.when(~valid, F.array(F.lit(INVALID)))
    return out.otherwise(failed)


def add_verdict(df: DataFrame, spec: LayerSpec, geojson: bool = True) -> DataFrame:
    """Add ``reasons``, the validity flag and the feature text."""
    flag = "geom_valid" if spec.generation == 2 else "valid"
    out = df.withColumn("_reasons", reason_list(spec))
    out = out.withColumn("reasons", F.array_join("_reasons", ";")).withColumn(
        flag, F.size("_reasons") == 0
    )
    if geojson:
        out = out.withColumn("geojson", to_geojson(F.col("geom"), F.col(spec.id_column)))
    return out.drop("_reasons")


def quarantine(df: DataFrame, geom: str = "geom", text: str = "geometry", row: str = "row_ix", id_column: str = "plot_id"):
    """Split rows into usable ones and problems; no row is lost.

    Problem rows carry the position, the id and what is wrong.
    """
    g = F.col(geom)
    marked = df.withColumn(
        "error",
        F.when(F.col(text).isNull(), "Geometry is None or NaN")
        .when(g.isNull(), "Geometry conversion error")
        .when(F.size(g) == 0, "Empty geometry")
        .when(~is_valid(g), "Invalid geometry"),
    )
    good = marked.where(F.col("error").isNull()).drop("error")
    bad = marked.where(F.col("error").isNotNull()).select(
        F.col(row).alias("index"),
        F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("Row "), F.col(row))).alias("id"),
        "error",
    )
    return good, bad
