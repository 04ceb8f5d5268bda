"""Repair ladder: make polygons valid or replace them by the empty polygon."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions import rings as R
from parcelcheck.operators.long_rings import examined, is_valid, simplified

# Accepted change of area by the zero-width buffer, domain of
# the coordinates, radius in degrees of the stand-in disc.
RATIO_LOW, RATIO_HIGH = 0.995, 1.005
WEST, EAST, SOUTH, NORTH = -180, 180, -80, 84
DISC_DEGREES = 0.00005


def state(geom: Column, valid: Column | None = None) -> Column:
    """``missing``, ``empty``, ``invalid`` or ``valid``; ``valid`` is the validity where it is known."""
    return (
        F.when(geom.isNull(), "missing")
        .when(F.size(geom) == 0, "empty")
        .when(is_valid(geom) if valid is None else valid, "valid")
        .otherwise("invalid")
    )


def remove_duplicate_vertices(geom: Column, enabled: bool = False) -> Column:
    """Drop repeated vertices; off by default because the original guard never fires."""
    if not enabled:
        return geom
    return F.transform(geom, lambda part: F.transform(part, R.drop_repeated))


def is_square_candidate(geom: Column) -> Column:
    """One ring of exactly five coordinates."""
    return (F.size(R.vertices(geom)) == 5) & (F.size(F.flatten(geom)) == 1)


def hull_geom(geom: Column) -> Column:
    return R.let(
        R.convex_hull(R.vertices(geom)),
        lambda h: F.when(F.size(h) < 4, R.empty_geom()).otherwise(R.polygon(h)),
    )


def accepts_zero_buffer(before: Column, after: Column) -> Column:
    """Area kept within half a percent; a geometry without area is refused."""
    ratio = F.try_divide(R.area(after), R.area(before))
    return F.coalesce((ratio >= RATIO_LOW) & (ratio < RATIO_HIGH), F.lit(False))


def out_of_bounds(geom: Column) -> Column:
    """Any coordinate on or beyond the edge of the UTM domain."""
    return F.exists(
        R.vertices(geom),
        lambda v: (v["x"] <= WEST) | (v["x"] >= EAST) | (v["y"] <= SOUTH) | (v["y"] >= NORTH),
    )


def beyond_bounds(box: Column) -> Column:
    """:func:`out_of_bounds` by the bounds of a shape."""
    return (box["minx"] <= WEST) | (box["maxx"] >= EAST) | (box["miny"] <= SOUTH) | (box["maxy"] >= NORTH)


def disc(geom: Column) -> Column:
    """Small 64-sided disc at the mean vertex."""
    v = R.vertices(geom)
    n = F.size(v)

    def ring(c: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(64)),
            lambda i: R.vertex(
                c["x"] + DISC_DEGREES * F.cos((i % 64) * (-math.pi / 32)),
                c["y"] + DISC_DEGREES * F.sin((i % 64) * (-math.pi / 32)),
            ),
        )

    centre = R.vertex(
        F.aggregate(v, F.lit(0.0), lambda a, p: a + p["x"]) / n,
        F.aggregate(v, F.lit(0.0), lambda a, p: a + p["y"]) / n,
    )
    return R.polygon(R.let(centre, ring))


def simplify_geometry(df: DataFrame, tolerance_m: float | None = None, geom: str = "geom") -> DataFrame:
    """Drop vertices that lie within ``tolerance_m`` metres of the line without them.

    Off by default: the original computes a simplified shape and always
    discards it. Distances are measured in the shape's own UTM zone; of the
    vertices kept, the longitudes and latitudes stay untouched. A shape that
    would become invalid, and one outside the UTM domain, stays as it is.
    """
    if tolerance_m is None:
        return df
    return R.settle(df, _fewer=simplified(F.col(geom), tolerance_m)).withColumn(geom, F.col("_fewer")).drop("_fewer")


def repair(
    df: DataFrame,
    geom: str = "geom",
    generation: int = 1,
    remove_duplicates: bool = False,
) -> DataFrame:
    """Run the ladder on one column.

    Adds ``repair_rung`` (what was done to the row) and ``original_vertices``.
    Reorienting or rewinding a ring never changes whether it is valid, so
    those two rungs cannot be what repairs a row and are not run.
    """
    g = F.col(geom)
    made = _ladder(geom, generation)
    out = df.withColumn(
        "original_vertices", F.when(F.size(g) == 1, R.coordinate_count(g)).otherwise(F.lit(0))
    )
    out = out.withColumn(geom, remove_duplicate_vertices(g, remove_duplicates))
    out = R.settle(out, _seen=examined(g))
    out = out.withColumn("_state", made["state"]).withColumn("_zero", F.col("_seen.zero"))
    bad = F.col("_state") == "invalid"
    out = out.withColumn("_square", bad & is_square_candidate(g))
    out = R.settle(out, _taken=F.col("_zero").isNotNull() & made["accepts"])
    out = R.settle(out, _fixed=made["fixed"])
    out = R.settle(out, _facts=made["facts"])
    out = R.settle(out, **{"repair_rung": made["rung"], geom: made["final"]})
    return out.drop("_seen", "_state", "_square", "_zero", "_taken", "_fixed", "_facts")


@cache
def _ladder(geom: str, generation: int) -> dict[str, Column]:
    """The expressions of the ladder by name, built once per process."""
    g, f = F.col(geom), F.col("_fixed")
    bad = F.col("_state") == "invalid"
    fixed = (
        F.when(F.col("_square"), hull_geom(g))
        .when(F.col("_taken"), F.col("_zero"))
        .otherwise(g)
    )
    if generation == 2:
        # a single ring with an area is its own largest part
        plain = (F.size(g) == 1) & (F.size(g[0]) == 1) & (R.coordinate_count(g) >= 4) & (F.col("_seen.area") != 0)
        whole = R.largest_part(R.to_area_parts(fixed))
        fixed = F.when(~F.col("_square") & ~F.col("_taken") & plain, g).otherwise(whole)
    # a shape that stays as it was has been measured already
    box = R.bbox(f)
    facts = F.when(f == g, F.col("_seen").dropFields("valid", "zero")).when(
        f.isNotNull(), F.struct(R.area(f).alias("area"), *[box[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    )
    broken = bad & ~F.col("_square") & ~F.col("_taken")
    outside = F.coalesce(beyond_bounds(F.col("_facts")), F.lit(False))
    empty = R.empty_geom()
    known = F.when(F.col("_state") == "missing", "missing").when(
        F.col("_state") == "empty", "empty"
    )
    if generation == 1:
        flat = (F.size(f) > 0) & (F.col("_facts.area") == 0)
        rung = (
            known.when(flat | (F.size(f) == 0), "emptied: no area")
            .when(outside, "emptied: out of bounds")
            .when(broken, "emptied: invalid")
        )
    else:
        lost = F.col("_zero").isNotNull() & (F.size("_zero") == 0)
        rung = (
            known.when(outside, "emptied: out of bounds")
            .when(broken & lost, "disc")
            .when(broken, "emptied: invalid")
            .when(F.size(f) == 0, "emptied: no area")
        )
    done = F.when(F.col("_square"), "hull").when(F.col("_taken"), "zero buffer").otherwise("none")
    final = F.when(rung.isNull(), f).otherwise(empty)
    if generation == 2:
        final = F.when(rung == "disc", disc(g)).otherwise(final)
    return {
        "state": state(g, F.col("_seen.valid")),
        "facts": facts,
        "accepts": accepts_zero_buffer(g, F.col("_zero")),
        "fixed": fixed,
        "rung": F.coalesce(rung, done),
        "final": final,
    }


def repair_audit(repaired: DataFrame) -> DataFrame:
    """Rows per rung, with the vertices they had before."""
    return repaired.groupBy("repair_rung").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("original_vertices").cast("long")).alias("original_vertices"),
    )
