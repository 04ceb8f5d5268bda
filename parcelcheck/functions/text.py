"""Geometry text: WKT and GeoJSON in, GeoJSON out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelcheck.functions.rings import GEOM_DDL, close_ring, empty_geom, let, vertex

# Fixed value: digits kept in exported coordinates.
COORDINATE_DIGITS = 7

_POLYGON_JSON = "type string, coordinates array<array<array<double>>>"
_MULTI_JSON = "type string, coordinates array<array<array<array<double>>>>"


def _clean(geom: Column) -> Column:
    """NULL unless every coordinate was read and every ring has three vertices."""
    ok = F.forall(
        geom,
        lambda p: (F.size(p) > 0)
        & F.forall(
            p,
            lambda r: (F.size(r) >= 3)
            & F.forall(r, lambda v: v["x"].isNotNull() & v["y"].isNotNull()),
        ),
    )
    return F.when(
        ok, F.transform(geom, lambda p: F.transform(p, close_ring))
    )


def _ring_from_text(text: Column) -> Column:
    def pair(token: Column) -> Column:
        return let(
            F.split(F.trim(token), "\\s+"),
            lambda p: vertex(
                F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
            ),
        )

    return F.transform(F.split(text, ","), pair)


def from_wkt(text: Column) -> Column:
    """POLYGON or MULTIPOLYGON text; anything else gives NULL."""
    t = F.upper(F.trim(text))
    body = F.regexp_replace(t, "^(MULTI)?POLYGON\\s*Z?\\s*", "")
    # Unwrap to "x y, x y" rings: parts are split at ")) , ((", rings at "), (".
    inner = F.when(t.startswith("MULTI"), F.regexp_extract(body, "^\\(\\s*\\(\\s*\\((.*)\\)\\s*\\)\\s*\\)$", 1)).otherwise(
        F.regexp_extract(body, "^\\(\\s*\\((.*)\\)\\s*\\)$", 1)
    )
    parts = F.transform(
        F.split(inner, "\\)\\s*\\)\\s*,\\s*\\(\\s*\\("),
        lambda p: F.transform(F.split(p, "\\)\\s*,\\s*\\("), _ring_from_text),
    )
    return (
        F.when(t.rlike("^(MULTI)?POLYGON\\s*Z?\\s*EMPTY$"), empty_geom())
        .when(t.rlike("^(MULTI)?POLYGON\\s*Z?\\s*\\(") & (inner != ""), _clean(parts))
    )


def _vertices(ring: Column) -> Column:
    return F.transform(ring, lambda c: vertex(F.get(c, F.lit(0)), F.get(c, F.lit(1))))


def from_geojson(text: Column) -> Column:
    """Polygon or MultiPolygon geometry object; anything else gives NULL."""
    kind = F.get_json_object(text, "$.type")
    one = F.from_json(text, _POLYGON_JSON)
    many = F.from_json(text, _MULTI_JSON)
    return F.when(
        kind == "Polygon",
        let(
            one,
            lambda g: F.when(F.size(g["coordinates"]) == 0, empty_geom()).otherwise(
                _clean(F.array(F.transform(g["coordinates"], _vertices)))
            ),
        ),
    ).when(
        kind == "MultiPolygon",
        let(
            many,
            lambda g: _clean(
                F.transform(g["coordinates"], lambda p: F.transform(p, _vertices))
            ),
        ),
    )


def from_text(text: Column) -> Column:
    """WKT first, then GeoJSON; NULL when neither reads."""
    return F.coalesce(
        from_wkt(text), F.when(F.trim(text).startswith("{"), from_geojson(text))
    ).cast(GEOM_DDL)


def to_geojson(geom: Column, id_column: Column) -> Column:
    """FeatureCollection text with one feature; NULL for a missing geometry."""
    ring = lambda r: F.transform(
        r, lambda v: F.array(F.round(v["x"], COORDINATE_DIGITS), F.round(v["y"], COORDINATE_DIGITS))
    )
    parts = F.transform(geom, lambda p: F.transform(p, ring))

    def collection(shape: Column) -> Column:
        feature = F.struct(
            F.lit("Feature").alias("type"),
            F.struct(id_column.alias("id")).alias("properties"),
            shape.alias("geometry"),
        )
        return F.to_json(
            F.struct(
                F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")
            )
        )

    single = F.struct(
        F.lit("Polygon").alias("type"),
        F.coalesce(F.get(parts, F.lit(0)), F.array().cast("array<array<array<double>>>")).alias(
            "coordinates"
        ),
    )
    multi = F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))
    return F.when(F.size(geom) <= 1, collection(single)).when(geom.isNotNull(), collection(multi))


def feature_count(geojson: Column) -> Column:
    """Features in a FeatureCollection text; 0 when it does not read."""
    features = F.from_json(geojson, "features array<string>")["features"]
    return F.coalesce(F.size(features), F.lit(0))
