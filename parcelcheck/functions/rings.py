"""Column functions over polygons held as nested arrays.

A geometry is ``parts -> rings -> vertices``; ring 0 of a part is its shell,
the others are holes, every ring is closed. An empty array is the empty
polygon, NULL is a missing one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERTEX_DDL = "struct<x:double,y:double>"
RING_DDL = f"array<{VERTEX_DDL}>"
GEOM_DDL = f"array<array<{RING_DDL}>>"
EDGES_DDL = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row and never again.

    A one-element explode keeps the optimizer from copying an expensive
    expression into every filter and projection above it.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("_settled", F.explode(F.array(made))).select(
        *[c for c in df.columns if c not in columns],
        *[F.col("_settled")[n].alias(n) for n in columns],
    )


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def empty_geom() -> Column:
    return F.array().cast(GEOM_DDL)


def polygon(ring: Column) -> Column:
    """A geometry of one part with one ring."""
    return F.array(F.array(ring))


def is_empty(geom: Column) -> Column:
    return F.size(geom) == 0


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex at the end unless it is there already."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(first == last, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ring_edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for a counter-clockwise ring."""
    return let(
        F.get(ring, F.lit(0)),
        lambda o: F.aggregate(
            ring_edges(ring),
            F.lit(0.0),
            lambda acc, e: acc
            + (e["x1"] - o["x"]) * (e["y2"] - o["y"])
            - (e["x2"] - o["x"]) * (e["y1"] - o["y"]),
            lambda acc: acc / 2,
        ),
    )


def orient(geom: Column) -> Column:
    """Shells counter-clockwise, holes clockwise."""
    return F.transform(
        geom,
        lambda part: F.transform(
            part,
            lambda ring, i: F.when((signed_area(ring) < 0) == (i == 0), F.reverse(ring)).otherwise(
                ring
            ),
        ),
    )


def rewind(geom: Column) -> Column:
    """The opposite winding: shells clockwise, holes counter-clockwise."""
    return F.transform(orient(geom), lambda part: F.transform(part, F.reverse))


def edges(geom: Column) -> Column:
    """All edges of all rings, directed so that the inside is on the left."""
    return F.flatten(F.transform(F.flatten(orient(geom)), ring_edges))


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def moments(edge_list: Column) -> Column:
    """Area and area-weighted centre of directed edges; NULL when there are none."""
    o = F.get(edge_list, F.lit(0))

    def step(acc: Column, e: Column) -> Column:
        ax, ay = e["x1"] - acc["ox"], e["y1"] - acc["oy"]
        bx, by = e["x2"] - acc["ox"], e["y2"] - acc["oy"]
        cross = ax * by - bx * ay
        return F.struct(
            acc["ox"].alias("ox"),
            acc["oy"].alias("oy"),
            (acc["s"] + cross).alias("s"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
            (acc["px"] + ax).alias("px"),
            (acc["py"] + ay).alias("py"),
            (acc["n"] + 1).alias("n"),
        )

    def done(acc: Column) -> Column:
        flat = acc["s"] == 0
        return F.struct(
            (acc["s"] / 2).alias("area"),
            (
                acc["ox"]
                + F.when(flat, acc["px"] / acc["n"]).otherwise(F.try_divide(acc["mx"], 3 * acc["s"]))
            ).alias("cx"),
            (
                acc["oy"]
                + F.when(flat, acc["py"] / acc["n"]).otherwise(F.try_divide(acc["my"], 3 * acc["s"]))
            ).alias("cy"),
        )

    zero = F.lit(0.0)
    start = F.struct(
        o["x1"].alias("ox"),
        o["y1"].alias("oy"),
        zero.alias("s"),
        zero.alias("mx"),
        zero.alias("my"),
        zero.alias("px"),
        zero.alias("py"),
        zero.alias("n"),
    )
    return F.when(F.size(edge_list) > 0, F.aggregate(edge_list, start, step, done))


def area(geom: Column) -> Column:
    """Planar area in the units of the coordinates; 0 for the empty polygon."""
    return F.aggregate(
        geom,
        F.lit(0.0),
        lambda acc, part: acc
        + 2 * F.abs(signed_area(F.get(part, F.lit(0))))
        - F.aggregate(part, F.lit(0.0), lambda a, r: a + F.abs(signed_area(r))),
    )


def bbox(geom: Column) -> Column:
    """Bounds as a struct; NULL for missing or empty."""
    return F.when(
        F.size(geom) > 0,
        let(
            vertices(geom),
            lambda v: F.struct(
                F.array_min(F.transform(v, lambda p: p["x"])).alias("minx"),
                F.array_min(F.transform(v, lambda p: p["y"])).alias("miny"),
                F.array_max(F.transform(v, lambda p: p["x"])).alias("maxx"),
                F.array_max(F.transform(v, lambda p: p["y"])).alias("maxy"),
            ),
        ),
    )


def coordinate_count(geom: Column) -> Column:
    """Coordinates of the shell with its closing point; 0 for empty, NULL for several parts."""
    return F.when(F.size(geom) == 0, F.lit(0)).when(
        F.size(geom) == 1, F.size(F.get(F.get(geom, F.lit(0)), F.lit(0)))
    )


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _half_hull(points: Column) -> Column:
    # On a convex chain the left turns towards a new point form a prefix, so
    # dropping every vertex without one is the same as popping from the end.
    return F.aggregate(
        points,
        F.array().cast(RING_DDL),
        lambda chain, p: F.concat(
            F.filter(
                chain, lambda v, i: (i == 0) | (_turn(F.get(chain, i - 1), v, p) > 0)
            ),
            F.array(p),
        ),
    )


def convex_hull(points: Column) -> Column:
    """Closed counter-clockwise hull ring of an array of vertices."""
    return let(
        F.array_sort(F.array_distinct(points)),
        lambda s: F.when(F.size(s) < 3, F.array().cast(RING_DDL)).otherwise(
            let(
                _half_hull(s),
                lambda low: F.concat(
                    low,
                    let(
                        _half_hull(F.reverse(s)),
                        lambda up: F.slice(up, F.lit(2), F.size(up) - 1),
                    ),
                ),
            )
        ),
    )


def min_rectangle(points: Column) -> Column:
    """Smallest rotated rectangle around an array of vertices.

    Struct of area, sides and the frame needed for its corners. One side of
    the smallest rectangle lies on a hull edge, so hull edges are the only
    directions to try.
    """

    def frame(hull: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        norm = F.sqrt(dx * dx + dy * dy)
        return let(
            F.struct((dx / norm).alias("ux"), (dy / norm).alias("uy")),
            lambda d: let(
                F.transform(
                    hull,
                    lambda p: F.struct(
                        ((p["x"] - e["x1"]) * d["ux"] + (p["y"] - e["y1"]) * d["uy"]).alias("u"),
                        ((p["y"] - e["y1"]) * d["ux"] - (p["x"] - e["x1"]) * d["uy"]).alias("v"),
                    ),
                ),
                lambda q: let(
                    F.struct(
                        F.array_min(F.transform(q, lambda p: p["u"])).alias("u0"),
                        F.array_max(F.transform(q, lambda p: p["u"])).alias("u1"),
                        F.array_max(F.transform(q, lambda p: p["v"])).alias("v1"),
                    ),
                    lambda b: F.struct(
                        ((b["u1"] - b["u0"]) * b["v1"]).alias("area"),
                        (b["u1"] - b["u0"]).alias("w"),
                        b["v1"].alias("h"),
                        (e["x1"] + b["u0"] * d["ux"]).alias("x0"),
                        (e["y1"] + b["u0"] * d["uy"]).alias("y0"),
                        d["ux"].alias("ux"),
                        d["uy"].alias("uy"),
                    ),
                ),
            ),
        )

    return let(
        convex_hull(points),
        lambda hull: F.array_min(F.transform(ring_edges(hull), lambda e: frame(hull, e))),
    )


def rectangle_ring(rect: Column) -> Column:
    """Closed ring of the rectangle returned by :func:`min_rectangle`."""
    ax, ay = rect["w"] * rect["ux"], rect["w"] * rect["uy"]
    bx, by = -rect["h"] * rect["uy"], rect["h"] * rect["ux"]
    x, y = rect["x0"], rect["y0"]
    return F.array(
        vertex(x, y),
        vertex(x + ax, y + ay),
        vertex(x + ax + bx, y + ay + by),
        vertex(x + bx, y + by),
        vertex(x, y),
    )


def is_convex(ring: Column) -> Column:
    """No right turn anywhere along a counter-clockwise ring."""
    n = F.size(ring) - 1
    return F.forall(
        F.transform(
            F.slice(ring, F.lit(1), n),
            lambda v, i: _turn(
                v, F.get(ring, i + 1), F.get(F.concat(ring, F.slice(ring, 2, 1)), i + 2)
            ),
        ),
        lambda t: t >= 0,
    )


def _side(e: Column, x: Column, y: Column) -> Column:
    return F.signum(
        (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    )


def _within_box(e: Column, x: Column, y: Column) -> Column:
    return (
        (x >= F.least(e["x1"], e["x2"]))
        & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"]))
        & (y <= F.greatest(e["y1"], e["y2"]))
    )


def edges_cross(e: Column, f: Column) -> Column:
    """Do two closed edges share a point?"""
    return let(
        F.struct(
            _side(e, f["x1"], f["y1"]).alias("a"),
            _side(e, f["x2"], f["y2"]).alias("b"),
            _side(f, e["x1"], e["y1"]).alias("c"),
            _side(f, e["x2"], e["y2"]).alias("d"),
        ),
        lambda s: ((s["a"] * s["b"] < 0) & (s["c"] * s["d"] < 0))
        | ((s["a"] == 0) & _within_box(e, f["x1"], f["y1"]))
        | ((s["b"] == 0) & _within_box(e, f["x2"], f["y2"]))
        | ((s["c"] == 0) & _within_box(f, e["x1"], e["y1"]))
        | ((s["d"] == 0) & _within_box(f, e["x2"], e["y2"])),
    )


def _proper_cross(e: Column, f: Column) -> Column:
    return (_side(e, f["x1"], f["y1"]) * _side(e, f["x2"], f["y2"]) < 0) & (
        _side(f, e["x1"], e["y1"]) * _side(f, e["x2"], e["y2"]) < 0
    )


def _folds_back(e: Column, f: Column) -> Column:
    return (_side(e, f["x2"], f["y2"]) == 0) & (
        (e["x2"] - e["x1"]) * (f["x2"] - f["x1"]) + (e["y2"] - e["y1"]) * (f["y2"] - f["y1"]) < 0
    )


def ring_is_simple(ring: Column) -> Column:
    """Closed, at least four coordinates, no self-crossing, touch or spike."""

    def clean(es: Column) -> Column:
        n = F.size(es)

        def bad(e: Column, i: Column) -> Column:
            following = F.get(es, (i + 1) % n)
            # The edge after next up to the last one; the first and the last
            # edge are neighbours as well.
            later = F.slice(
                es, i + 3, F.greatest(n - i - 2 - F.when(i == 0, 1).otherwise(0), F.lit(0))
            )
            return _folds_back(e, following) | F.exists(later, lambda f: edges_cross(e, f))

        return (n >= 3) & ~F.exists(F.transform(es, bad), lambda b: b)

    return (
        (F.size(ring) >= 4)
        & (F.get(ring, F.lit(0)) == F.element_at(ring, -1))
        & let(
            F.filter(ring_edges(ring), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"])),
            clean,
        )
    )


def inside(edge_list: Column, x: Column, y: Column) -> Column:
    """Crossing parity of a ray to the right; correct for parts with holes."""
    return (
        F.aggregate(
            edge_list,
            F.lit(0),
            lambda acc, e: acc
            + F.when(
                ((e["y1"] > y) != (e["y2"] > y))
                & (
                    (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"] > x
                ),
                F.lit(1),
            ).otherwise(F.lit(0)),
        )
        % 2
        == 1
    )


def is_valid(geom: Column) -> Column:
    """Simple rings that do not cross each other, holes inside their shells.

    The empty polygon is valid; NULL stays NULL.
    """
    rings = F.flatten(geom)
    simple = F.forall(rings, ring_is_simple)
    multi = F.size(rings) > 1
    crossing = F.exists(
        F.transform(
            rings,
            lambda r, i: F.exists(
                F.flatten(
                    F.transform(
                        F.slice(rings, i + 2, F.greatest(F.size(rings) - i - 1, F.lit(0))),
                        ring_edges,
                    )
                ),
                lambda f: F.exists(ring_edges(r), lambda e: _proper_cross(e, f)),
            ),
        ),
        lambda b: b,
    )
    holes_in = F.forall(
        geom,
        lambda part: F.forall(
            F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))),
            lambda hole: F.exists(
                hole, lambda v: inside(ring_edges(F.get(part, F.lit(0))), v["x"], v["y"])
            ),
        ),
    )
    return simple & (~multi | (~crossing & holes_in))


def drop_repeated(ring: Column) -> Column:
    """Remove vertices equal to the one before; the order is kept."""
    return F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))


def to_area_parts(geom: Column) -> Column:
    """Drop parts whose shell has no area or fewer than four coordinates."""
    return F.filter(
        geom,
        lambda p: (F.size(F.get(p, F.lit(0))) >= 4) & (signed_area(F.get(p, F.lit(0))) != 0),
    )


def largest_part(geom: Column, share: float = 0.9) -> Column:
    """The biggest part alone when it holds more than ``share`` of the area."""
    parts = F.transform(
        geom, lambda p: F.struct(area(F.array(p)).alias("a"), p.alias("p"))
    )
    return F.when(F.size(geom) <= 1, geom).otherwise(
        let(
            parts,
            lambda ps: F.when(
                share * F.aggregate(ps, F.lit(0.0), lambda acc, s: acc + s["a"])
                < F.array_max(F.transform(ps, lambda s: s["a"])),
                F.array(
                    F.get(
                        F.filter(
                            ps,
                            lambda s: s["a"]
                            == F.array_max(F.transform(ps, lambda t: t["a"])),
                        ),
                        F.lit(0),
                    )["p"]
                ),
            ).otherwise(geom),
        )
    )
