"""WGS84: transverse Mercator zones, geodesic area and distance.

Transverse Mercator is the Krueger series (Karney 2011), the geodesic area
uses authalic latitudes, long distances follow Vincenty (1975).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelcheck.functions.rings import let, ring_edges, vertex

A = 6378137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)
N3 = FLAT / (2 - FLAT)
K0 = 0.9996
RECTIFYING = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
SERIES = (
    N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16 + 41 * N3**4 / 180,
    13 * N3**2 / 48 - 3 * N3**3 / 5 + 557 * N3**4 / 1440,
    61 * N3**3 / 240 - 103 * N3**4 / 140,
    49561 * N3**4 / 161280,
)
Q_POLE = 1 + (1 - E2) * math.atanh(ECC) / ECC
AUTHALIC_R2 = A * A * Q_POLE / 2


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone number with the Norway and Svalbard exceptions."""
    plain = (F.floor((lon + 180) / 6) % 60 + 1).cast("int")
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
        .when(svalbard & (lon < 9), F.lit(31))
        .when(svalbard & (lon < 21), F.lit(33))
        .when(svalbard & (lon < 33), F.lit(35))
        .when(svalbard, F.lit(37))
        .otherwise(plain)
    )


def plain_zone(lon: Column) -> Column:
    """Zone number without exceptions, used for whole tables."""
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def epsg_code(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + plain_zone(lon)


def in_utm_domain(lon: Column, lat: Column) -> Column:
    return lat.between(-80, 84) & lon.between(-180, 180)


def utm_vertex(v: Column, zone: Column, south: Column) -> Column:
    """Easting and northing of a lon/lat vertex."""

    def conformal(p: Column) -> Column:
        return F.struct(
            F.atan2(p["t"], F.cos(p["dl"])).alias("xi"),
            F.asinh(F.sin(p["dl"]) / F.sqrt(p["t"] * p["t"] + F.cos(p["dl"]) * F.cos(p["dl"]))).alias(
                "eta"
            ),
        )

    def series(q: Column) -> Column:
        xi, eta = q["xi"], q["eta"]
        north, east = xi, eta
        for j, coefficient in enumerate(SERIES, start=1):
            north = north + coefficient * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east + coefficient * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return vertex(
            500000 + K0 * RECTIFYING * east,
            F.when(south, F.lit(1e7)).otherwise(F.lit(0.0)) + K0 * RECTIFYING * north,
        )

    sin_lat = F.sin(F.radians(v["y"]))
    start = F.struct(
        F.sinh(F.atanh(sin_lat) - ECC * F.atanh(ECC * sin_lat)).alias("t"),
        F.radians(v["x"] - (zone * 6 - 183)).alias("dl"),
    )
    return let(start, lambda p: let(conformal(p), series))


def to_utm(geom: Column, zone: Column, south: Column) -> Column:
    """Project every vertex of a geometry."""
    return F.transform(
        geom,
        lambda part: F.transform(
            part, lambda ring: F.transform(ring, lambda v: utm_vertex(v, zone, south))
        ),
    )


def _half_authalic_tan(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(ECC * s) / ECC)
    return F.tan(F.asin(F.greatest(F.least(q / Q_POLE, F.lit(1.0)), F.lit(-1.0))) / 2)


def geodesic_ring_area(ring: Column) -> Column:
    """Signed area in square metres of a lon/lat ring."""
    with_tan = F.transform(
        ring, lambda v: vertex(F.radians(v["x"]), _half_authalic_tan(v["y"]))
    )
    # Area between an edge and the equator on the authalic sphere; summed with
    # the sign of the edge this leaves the ring, negative when counter-clockwise.
    return F.aggregate(
        ring_edges(with_tan),
        F.lit(0.0),
        lambda acc, e: acc
        + 2
        * F.atan2(
            F.tan((e["x2"] - e["x1"]) / 2) * (e["y1"] + e["y2"]), 1 + e["y1"] * e["y2"]
        ),
        lambda acc: -acc * AUTHALIC_R2,
    )


def geodesic_area(geom: Column) -> Column:
    """Area in square metres, shells minus holes; 0 for the empty polygon."""
    return F.aggregate(
        geom,
        F.lit(0.0),
        lambda acc, part: acc
        + 2 * F.abs(geodesic_ring_area(F.get(part, F.lit(0))))
        - F.aggregate(part, F.lit(0.0), lambda a, r: a + F.abs(geodesic_ring_area(r))),
    )


def short_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between close points, by the radii of curvature at mid-latitude."""
    mid = F.radians((lat1 + lat2) / 2)
    w2 = 1 - E2 * F.sin(mid) * F.sin(mid)
    north = F.radians(lat2 - lat1) * A * (1 - E2) / (w2 * F.sqrt(w2))
    east = F.radians(lon2 - lon1) * A / F.sqrt(w2) * F.cos(mid)
    return F.sqrt(north * north + east * east)


def geodesic_distance(
    lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12
) -> Column:
    """Metres along the ellipsoid, Vincenty's inverse.

    NULL where the rounds don't converge, as between nearly antipodal points.
    """

    def reduced(lat: Column) -> Column:
        return F.atan((1 - FLAT) * F.tan(F.radians(lat)))

    def angles(s: Column, lam: Column) -> Column:
        su1, cu1, su2, cu2 = s["su1"], s["cu1"], s["su2"], s["cu2"]
        a = cu2 * F.sin(lam)
        b = cu1 * su2 - su1 * cu2 * F.cos(lam)
        return F.struct(
            F.sqrt(a * a + b * b).alias("sin"),
            (su1 * su2 + cu1 * cu2 * F.cos(lam)).alias("cos"),
            (cu1 * cu2 * F.sin(lam)).alias("t"),
        )

    def bend(s: Column, g: Column) -> Column:
        sin_alpha = F.coalesce(F.try_divide(g["t"], g["sin"]), F.lit(0.0))
        cos2 = 1 - sin_alpha * sin_alpha
        return F.struct(
            g["sin"].alias("sin"),
            g["cos"].alias("cos"),
            F.atan2(g["sin"], g["cos"]).alias("sigma"),
            sin_alpha.alias("sa"),
            cos2.alias("c2"),
            F.coalesce(g["cos"] - F.try_divide(2 * s["su1"] * s["su2"], cos2), F.lit(0.0)).alias("cm"),
        )

    def solve(s: Column, lam: Column, body) -> Column:
        return let(angles(s, lam), lambda g: let(bend(s, g), body))

    def next_lambda(s: Column, lam: Column) -> Column:
        def update(h: Column) -> Column:
            c = FLAT / 16 * h["c2"] * (4 + FLAT * (4 - 3 * h["c2"]))
            return s["l"] + (1 - c) * FLAT * h["sa"] * (
                h["sigma"]
                + c * h["sin"] * (h["cm"] + c * h["cos"] * (2 * h["cm"] * h["cm"] - 1))
            )

        return solve(s, lam, update)

    def length(h: Column) -> Column:
        u2 = h["c2"] * ((A * A - B * B) / (B * B))
        ca = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
        cb = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
        cm = h["cm"]
        delta = cb * h["sin"] * (
            cm
            + cb
            / 4
            * (
                h["cos"] * (2 * cm * cm - 1)
                - cb / 6 * cm * (4 * h["sin"] * h["sin"] - 3) * (4 * cm * cm - 3)
            )
        )
        return B * ca * (h["sigma"] - delta)

    start = F.struct(
        F.sin(reduced(lat1)).alias("su1"),
        F.cos(reduced(lat1)).alias("cu1"),
        F.sin(reduced(lat2)).alias("su2"),
        F.cos(reduced(lat2)).alias("cu2"),
        F.radians(lon2 - lon1).alias("l"),
    )
    return let(
        start,
        lambda s: let(
            F.aggregate(
                F.sequence(F.lit(1), F.lit(rounds)), s["l"], lambda lam, _: next_lambda(s, lam)
            ),
            lambda lam: F.when(F.abs(next_lambda(s, lam) - lam) < 1e-10, solve(s, lam, length)),
        ),
    )
