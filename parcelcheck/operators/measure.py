"""Measures and flags of single polygons, as column expressions."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.operators.long_rings import min_rectangle, moments, plane_measures, to_utm, within_circle
from parcelcheck.params import LayerSpec

# Fixed value: width standing in for a zero-width rectangle.
TINY_WIDTH = 1e-11
CIRCLE_HALF_STEP = math.pi / 64


def with_centroid(df: DataFrame, geom: str = "geom", out: str = "centroid") -> DataFrame:
    """Area-weighted centre in lon/lat as ``struct<area, cx, cy>``; NULL when empty."""
    return R.settle(df, **{out: _moments(geom)})


@cache
def _moments(geom: str) -> Column:
    return moments(F.col(geom))


def with_own_plane(df: DataFrame, geom: str = "geom", out: str = "utm") -> DataFrame:
    """Project every polygon into the zone of its own centroid.

    A centroid outside the UTM domain gives the empty polygon.
    """
    df = with_centroid(df, geom) if "centroid" not in df.columns else df
    return R.settle(df, **{out: _projected(geom)})


# Building a long expression costs the driver more than sending it, so each is
# built once per process and reused by name.


@cache
def _projected(geom: str) -> Column:
    c = F.col("centroid")
    zone, south = P.utm_zone(c["cx"], c["cy"]), c["cy"] < 0
    return (
        F.when(F.size(geom) == 0, F.col(geom))
        .when(~P.in_utm_domain(c["cx"], c["cy"]), R.empty_geom())
        .otherwise(to_utm(F.col(geom), zone, south))
    )


@cache
def area_column(spec_generation: int, geom: str = "geom", utm: str = "utm") -> Column:
    """Square metres. Generation 1 measures in UTM, generation 2 on the ellipsoid."""
    if spec_generation == 1:
        return R.area(F.col(utm))
    return F.coalesce(P.geodesic_area(F.col(geom)), F.lit(0.0))


def sides_ratio(rect: Column) -> Column:
    return F.try_divide(F.greatest(rect["w"], rect["h"]), F.least(rect["w"], rect["h"]))


def geodesic_sides_ratio(rect: Column) -> Column:
    """Ratio of the side lengths of a rectangle in degrees, measured on the ellipsoid."""

    def ratio(q: Column) -> Column:
        def side(i: int) -> Column:
            a, b = F.get(q, F.lit(i)), F.get(q, F.lit(i + 1))
            return P.short_distance(a["x"], a["y"], b["x"], b["y"])

        return R.let(
            F.struct(side(0).alias("a"), side(1).alias("b")),
            lambda s: F.greatest(s["a"], s["b"])
            / F.when(F.least(s["a"], s["b"]) == 0, F.lit(TINY_WIDTH)).otherwise(
                F.least(s["a"], s["b"])
            ),
        )

    return F.when(rect.isNotNull(), R.let(R.rectangle_ring(rect), ratio))


def within_radius(utm: Column, radius_m: float) -> Column:
    """All vertices inside the 64-sided circle around the centroid."""

    reach = radius_m * math.cos(CIRCLE_HALF_STEP)
    return F.when(F.size(utm) == 0, F.lit(False)).when(
        F.size(utm) > 0, within_circle(utm, reach, CIRCLE_HALF_STEP)
    )


def over(value: Column, limit: float) -> Column:
    """``value > limit``; a missing value is not over."""
    return F.coalesce(value > limit, F.lit(False))


def add_area(df: DataFrame, generation: int = 1) -> DataFrame:
    if generation == 1 and "utm" not in df.columns:
        df = with_own_plane(df)
    return R.settle(df, area_m2=area_column(generation))


def add_length_width_ratio(df: DataFrame, spec: LayerSpec) -> DataFrame:
    known = "_plane" in df.columns
    return R.settle(df, length_width_ratio=_known_sides(spec.geodesic) if known else _sides(spec.geodesic)).withColumn(
        "length_width_ratio_too_big", over(F.col("length_width_ratio"), spec.length_width_limit)
    )


@cache
def _sides(geodesic: bool) -> Column:
    rect = F.col("rect")
    return geodesic_sides_ratio(rect) if geodesic else sides_ratio(rect)


def _known_sides(geodesic: bool) -> Column:
    long, short = F.col("_plane.long"), F.col("_plane.short")
    if geodesic:
        return long / F.when(short == 0, F.lit(TINY_WIDTH)).otherwise(short)
    return F.try_divide(long, short)


def add_rectangle(df: DataFrame, geodesic: bool) -> DataFrame:
    """Smallest rotated rectangle: in UTM (generation 1) or in degrees (generation 2)."""
    source = "geom" if geodesic else "utm"
    return R.settle(df, rect=_rectangle(source))


@cache
def _rectangle(source: str) -> Column:
    return F.when(F.size(source) > 0, min_rectangle(R.vertices(F.col(source))))


def add_protruding_ratio(df: DataFrame, spec: LayerSpec) -> DataFrame:
    box = F.col("_plane.box") if "_plane" in df.columns else _box(spec.geodesic)
    return df.withColumn("mrr_ratio", F.try_divide(box, F.col("area_m2"))).withColumn(
        "protruding_ratio_too_big", over(F.col("mrr_ratio"), spec.protruding_limit)
    )


@cache
def _box(geodesic: bool) -> Column:
    if geodesic:
        return F.abs(P.geodesic_ring_area(R.rectangle_ring(F.col("rect"))))
    return F.col("rect")["area"]


def add_vertex_count(df: DataFrame, spec: LayerSpec) -> DataFrame:
    out = df.withColumn("nr_vertices", R.coordinate_count(F.col("geom")))
    if spec.generation == 2:
        n, before = F.col("nr_vertices"), F.col("original_vertices")
        out = out.withColumn("vertices_dropped", before - n).withColumn(
            "vertices_valid_percentage", F.try_divide(100 * n, before)
        )
    return out.withColumn(
        "nr_vertices_too_small",
        F.coalesce(F.col("nr_vertices") <= spec.max_vertices, F.lit(False)),
    )


def add_in_radius(df: DataFrame, spec: LayerSpec) -> DataFrame:
    return R.settle(df, in_radius=_in_radius(spec.generation, spec.radius_m))


@cache
def _in_radius(generation: int, radius_m: float) -> Column:
    # Generation 1 looks at the first part only.
    shape = F.slice("utm", 1, 1) if generation == 1 else F.col("utm")
    return within_radius(shape, radius_m)


def measure(df: DataFrame, spec: LayerSpec) -> DataFrame:
    """All measures of a layer. Those of the plane come from one pass over a batch."""
    out = add_plane_measures(df, spec)
    if spec.length_width:
        out = add_length_width_ratio(out, spec)
    out = add_protruding_ratio(out, spec)
    out = add_vertex_count(out, spec)
    rest = [c for c in out.columns if c not in ("rect", "_plane", "in_radius")]
    return out.select(*rest, "in_radius")


def add_plane_measures(df: DataFrame, spec: LayerSpec) -> DataFrame:
    """:func:`add_area`, :func:`add_rectangle` and :func:`add_in_radius` together, without the projected shape.

    ``_plane`` keeps the area and the sides of the rectangle for the ratios.
    """
    out = R.settle(df, _plane=_plane_measures(spec.generation, spec.radius_m))
    area = F.col("_plane.area")
    return (
        out.withColumn("area_m2", area if spec.generation == 1 else F.coalesce(area, F.lit(0.0)))
        .withColumn("rect", F.col("_plane.rect"))
        .withColumn("in_radius", F.col("_plane.in_circle"))
    )


@cache
def _plane_measures(generation: int, radius_m: float) -> Column:
    return plane_measures(F.col("geom"), generation, radius_m * math.cos(CIRCLE_HALF_STEP), CIRCLE_HALF_STEP)


def table_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row: bounds, their centre, the EPSG code of the table-wide zone."""
    span = df.select(R.bbox(F.col(geom)).alias("b")).agg(
        F.min("b.minx").alias("min_lon"),
        F.min("b.miny").alias("min_lat"),
        F.max("b.maxx").alias("max_lon"),
        F.max("b.maxy").alias("max_lat"),
    )
    lon = (F.col("min_lon") + F.col("max_lon")) / 2
    lat = (F.col("min_lat") + F.col("max_lat")) / 2
    return span.withColumn("epsg", F.when(lon.between(-180, 180) & lat.between(-90, 90), P.epsg_code(lon, lat)))
