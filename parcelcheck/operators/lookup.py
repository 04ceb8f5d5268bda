"""Joins with reference polygon layers (countries, ecoregions).

A layer polygon is cut along a coarse grid first. Shapes then meet only the
pieces in their own cells, by equi-join, so neither the layer nor the shapes
need to be broadcast; AQE does so by itself when the measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.operators import cells as C
from parcelcheck.operators.skew import join_per_key
from parcelcheck.params import COUNTRY_BUFFER_M

TILE_DEG = 0.5


def _clip_ring(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """Cut a ring at a vertical or horizontal line."""
    sign = 1.0 if keep_above else -1.0
    other = "y" if axis == "x" else "x"

    def piece(e: Column) -> Column:
        pa, pb = e[f"{axis}1"], e[f"{axis}2"]
        da, db = sign * (pa - bound), sign * (pb - bound)
        t = F.try_divide(da, da - db)
        cross = e[f"{other}1"] + t * (e[f"{other}2"] - e[f"{other}1"])
        hit = R.vertex(bound, cross) if axis == "x" else R.vertex(cross, bound)
        none = F.array().cast(R.RING_DDL)
        return F.concat(
            F.when((da < 0) != (db < 0), F.array(hit)).otherwise(none),
            F.when(db >= 0, F.array(R.vertex(e["x2"], e["y2"]))).otherwise(none),
        )

    return R.let(
        F.flatten(F.transform(R.ring_edges(ring), piece)),
        lambda v: F.when(F.size(v) < 3, F.array().cast(R.RING_DDL)).otherwise(R.close_ring(v)),
    )


def _clip(geom: Column, axis: str, low: Column, high: Column) -> Column:
    cut = F.transform(
        geom,
        lambda part: F.filter(
            F.transform(
                part, lambda r: _clip_ring(_clip_ring(r, axis, low, True), axis, high, False)
            ),
            lambda r: F.size(r) >= 4,
        ),
    )
    return F.filter(cut, lambda p: F.size(p) > 0)


def tile_layer(layer: DataFrame, geom: str = "geom", tile: float = TILE_DEG) -> DataFrame:
    """Cut every polygon of a layer along the grid: first columns, then rows.

    Adds ``cx``, ``cy`` and ``piece`` (directed edges); a cell wholly inside
    keeps four edges whatever the size of the polygon.
    """
    box = R.bbox(F.col(geom))
    keep = [c for c in layer.columns if c != geom]
    columns = (
        layer.withColumn("_box", box)
        .withColumn("cx", F.explode(C.covering(F.col("_box.minx"), F.col("_box.maxx"), tile)))
        .select(
            *keep,
            "cx",
            _clip(R.orient(F.col(geom)), "x", F.col("cx") * tile, (F.col("cx") + 1) * tile).alias("_strip"),
        )
        .where(F.size("_strip") > 0)
    )
    cells = (
        columns.withColumn("_box", R.bbox(F.col("_strip")))
        .withColumn("cy", F.explode(C.covering(F.col("_box.miny"), F.col("_box.maxy"), tile)))
        .select(
            *keep,
            "cx",
            "cy",
            _clip(F.col("_strip"), "y", F.col("cy") * tile, (F.col("cy") + 1) * tile).alias("_cell"),
        )
        .where(F.size("_cell") > 0)
    )
    rings = F.flatten(F.col("_cell"))
    return cells.select(*keep, "cx", "cy", F.flatten(F.transform(rings, R.ring_edges)).alias("piece"))


def ecoregion_per_id(
    df: DataFrame,
    layer: DataFrame,
    id_column: str,
    geom: str = "geom",
    name: str = "ecoregion",
    tile: float = TILE_DEG,
) -> DataFrame:
    """(id, name) of the layer row sharing the largest area with a shape of the id.

    Layer rows of the same name are not added up.
    """
    shapes = df.where(F.size(geom) > 0).select(id_column, F.col(geom).alias("_g"))
    # Copies of one shape under one id count once.
    shapes = R.settle(
        shapes.dropDuplicates([id_column, "_g"]),
        box=R.bbox(F.col("_g")),
        edges=R.edges(F.col("_g")),
    )
    region = layer.withColumn("_region", F.xxhash64(name, geom))
    pieces = tile_layer(region.select("_region", name, geom), geom, tile)
    shared = C.place(shapes, "box", tile).join(pieces, ["cx", "cy"])
    per_cell = shared.select(
        id_column,
        F.xxhash64("_g").alias("_shape"),
        "_region",
        name,
        C.overlap_area(F.col("edges"), F.col("piece"), F.col("box"), F.col("box")).alias("a"),
    )
    return (
        per_cell.groupBy(id_column, "_shape", "_region", name)
        .agg(F.sum("a").alias("a"))
        .where(F.col("a") > 0)
        .groupBy(id_column)
        .agg(F.max_by(name, F.struct("a", name)).alias(name))
    )


def add_ecoregion(
    df: DataFrame,
    layer: DataFrame,
    id_column: str,
    geom: str = "geom",
    name: str = "ecoregion",
    tile: float = TILE_DEG,
) -> DataFrame:
    """Add the name of the layer row with the largest shared area.

    All rows of an id take the same name; shapes without a match get NULL.
    """
    best = ecoregion_per_id(df, layer, id_column, geom, name, tile)
    others = [c for c in df.columns if c != id_column]
    return join_per_key(df, best, [id_column], others)


def _local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    phi = F.radians(lat0)
    w2 = 1 - P.E2 * F.sin(phi) * F.sin(phi)
    return (
        F.radians(lon - lon0) * P.A / F.sqrt(w2) * F.cos(phi),
        F.radians(lat - lat0) * P.A * (1 - P.E2) / (w2 * F.sqrt(w2)),
    )


def _point_to_edge(px: Column, py: Column, e: Column) -> Column:
    """Distance of a point to an edge, in the plane."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.coalesce(
        F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0)
    )
    return R.let(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)),
        lambda u: F.sqrt(
            F.pow(px - e["x1"] - u * dx, F.lit(2)) + F.pow(py - e["y1"] - u * dy, F.lit(2))
        ),
    )


def edge_distance(e: Column, f: Column) -> Column:
    """Distance between two edges in the plane."""
    return F.when(R.edges_cross(e, f), F.lit(0.0)).otherwise(
        F.least(
            _point_to_edge(e["x1"], e["y1"], f),
            _point_to_edge(e["x2"], e["y2"], f),
            _point_to_edge(f["x1"], f["y1"], e),
            _point_to_edge(f["x2"], f["y2"], e),
        )
    )


def _localise(e: Column, lon0: Column, lat0: Column) -> Column:
    x1, y1 = _local_metres(e["x1"], e["y1"], lon0, lat0)
    x2, y2 = _local_metres(e["x2"], e["y2"], lon0, lat0)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def country_hits(
    shapes: DataFrame,
    countries: DataFrame,
    reach_m: float = COUNTRY_BUFFER_M,
    tile: float = TILE_DEG,
) -> DataFrame:
    """(shape, iso3, region) rows whose country lies within ``reach_m`` metres.

    ``shapes`` has ``shape``, ``box`` and ``edges``. A shape farther than that
    from every border edge is wholly inside or wholly outside, so one vertex
    decides; near a border the distance is measured in metres around the shape.
    """
    region = countries.withColumn("_region", F.xxhash64("iso3", "geom"))
    first = F.get("edges", F.lit(0))
    # The one cell of the first vertex is enough for the inside test.
    inside = (
        shapes.withColumn("cx", F.floor(first["x1"] / tile))
        .withColumn("cy", F.floor(first["y1"] / tile))
        .join(tile_layer(region.select("_region", "iso3", "geom"), tile=tile), ["cx", "cy"])
        .where(R.inside(F.col("piece"), first["x1"], first["y1"]))
        .select("shape", "iso3", "_region")
    )
    border = region.select(
        "_region", "iso3", F.explode(R.edges(F.col("geom"))).alias("edge")
    ).withColumn(
        "box",
        F.struct(
            F.least("edge.x1", "edge.x2").alias("minx"),
            F.least("edge.y1", "edge.y2").alias("miny"),
            F.greatest("edge.x1", "edge.x2").alias("maxx"),
            F.greatest("edge.y1", "edge.y2").alias("maxy"),
        ),
    )
    lat_reach = reach_m / 110000.0
    widest = F.cos(F.radians(F.least(F.greatest(F.abs("box.miny"), F.abs("box.maxy")) + lat_reach, F.lit(89.0))))
    b = F.col("box")
    grown = F.struct(
        (b["minx"] - lat_reach / widest).alias("minx"),
        (b["miny"] - lat_reach).alias("miny"),
        (b["maxx"] + lat_reach / widest).alias("maxx"),
        (b["maxy"] + lat_reach).alias("maxy"),
    )
    border = C.place(border.withColumn("reach", grown), "reach", tile).drop("box")
    own = F.col("edges")
    near = (
        C.place(shapes, "box", tile)
        .join(border, ["cx", "cy"])
        .where(C.boxes_meet(F.col("box"), F.col("reach")))
        .where(
            R.let(
                F.struct(
                    _localise(F.col("edge"), first["x1"], first["y1"]).alias("far"),
                    F.transform(own, lambda e: _localise(e, first["x1"], first["y1"])).alias("es"),
                ),
                lambda s: F.exists(s["es"], lambda e: edge_distance(e, s["far"]) <= reach_m),
            )
        )
        .select("shape", "iso3", "_region")
    )
    return inside.unionByName(near)


def country_codes(
    shapes: DataFrame,
    countries: DataFrame,
    country: str,
    reach_m: float = COUNTRY_BUFFER_M,
    repeat_codes: bool = False,
    tile: float = TILE_DEG,
) -> DataFrame:
    """``overlapping_countries`` for every ``shape`` (a unique key) with ``geom`` that has a hit."""
    ready = R.settle(
        shapes.where(F.size("geom") > 0), box=R.bbox(F.col("geom")), edges=R.edges(F.col("geom"))
    ).drop("geom")
    hits = country_hits(ready, countries.where(F.col("iso3") == country), reach_m, tile)
    codes = (
        hits.dropDuplicates(["shape", "_region"])
        if repeat_codes
        else hits.select("shape", "iso3").distinct()
    )
    return codes.groupBy("shape").agg(
        F.array_join(F.array_sort(F.collect_list("iso3")), ";").alias("overlapping_countries")
    )


def with_country_flag(df: DataFrame, country: str) -> DataFrame:
    """No hit gives the text ``nan``; the flag compares the text with the code."""
    return df.withColumn(
        "overlapping_countries", F.coalesce("overlapping_countries", F.lit("nan"))
    ).withColumn("in_country", F.col("overlapping_countries") == country)


def validate_country(
    df: DataFrame,
    countries: DataFrame,
    country: str,
    geom: str = "geom",
    reach_m: float = COUNTRY_BUFFER_M,
    repeat_codes: bool = False,
    tile: float = TILE_DEG,
) -> DataFrame:
    """Add ``overlapping_countries`` (codes joined by ``;``) and ``in_country``.

    By default a code is listed once; ``repeat_codes`` lists it per layer
    row. Every distinct geometry is looked up once.
    """
    shapes = df.select(F.col(geom).alias("shape")).distinct().withColumn("geom", F.col("shape"))
    codes = country_codes(shapes, countries, country, reach_m, repeat_codes, tile)
    others = [c for c in df.columns if c != geom]
    joined = join_per_key(df, codes.withColumnRenamed("shape", geom), [geom], others)
    return with_country_flag(joined.select(*df.columns, "overlapping_countries"), country)
