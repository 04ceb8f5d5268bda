"""Golden polygons and properties of the geometry functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcheck import params as C
from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.functions.text import feature_count, from_text, to_geojson
from parcelcheck.operators import cells, measure, outline, repair
from parcelcheck.operators.lookup import edge_distance


def geom(*parts):
    """Parts given as lists of rings, rings as lists of (x, y), closed here."""
    return [
        [[{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]] for ring in part]
        for part in parts
    ]


SQUARE = [(0, 0), (20, 0), (20, 20), (0, 20)]
ELL = [(0, 0), (40, 0), (40, 15), (15, 15), (15, 40), (0, 40)]
BOW = [(0, 0), (10, 10), (10, 0), (0, 10)]
HOLE = [(5, 5), (5, 10), (10, 10), (10, 5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"id string, geom {R.GEOM_DDL}")


def values(df, expr):
    return {r["id"]: r["v"] for r in df.select("id", expr.alias("v")).collect()}


@pytest.fixture(scope="module")
def golden(spark):
    return frame(
        spark,
        [
            ("square", geom([SQUARE])),
            ("reversed", geom([SQUARE[::-1]])),
            ("ell", geom([ELL])),
            ("bow", geom([BOW])),
            ("triangle", geom([[(0, 0), (10, 0), (0, 10)]])),
            ("holed", geom([SQUARE, HOLE])),
            ("two", geom([SQUARE], [[(30, 0), (40, 0), (40, 10), (30, 10)]])),
            ("spike", geom([[(0, 0), (10, 0), (10, 10), (10, 20), (10, 10), (0, 10)]])),
            ("touch", geom([[(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5)]])),
            ("bad hole", geom([SQUARE, [(30, 30), (31, 30), (31, 31)]])),
            ("empty", []),
            ("missing", None),
        ],
    )


def test_state(golden):
    got = values(golden, repair.state(F.col("geom")))
    assert got == {
        "square": "valid",
        "reversed": "valid",
        "ell": "valid",
        "bow": "invalid",
        "triangle": "valid",
        "holed": "valid",
        "two": "valid",
        "spike": "invalid",
        "touch": "invalid",
        "bad hole": "invalid",
        "empty": "empty",
        "missing": "missing",
    }


def test_area_and_centroid(golden):
    area = values(golden, R.area(F.col("geom")))
    assert area["square"] == area["reversed"] == 400
    assert area["ell"] == 975 and area["holed"] == 375 and area["two"] == 500
    assert area["empty"] == 0 and area["missing"] is None
    m = values(golden, R.moments(R.edges(F.col("geom"))))
    assert (m["square"]["cx"], m["square"]["cy"]) == (10, 10)
    assert m["holed"]["cx"] == pytest.approx((400 * 10 - 25 * 7.5) / 375)
    assert m["two"]["cx"] == pytest.approx((400 * 10 + 100 * 35) / 500)
    assert m["empty"] is None


def test_rectangle(golden):
    rect = values(golden, R.min_rectangle(R.vertices(F.col("geom"))))
    assert rect["square"]["area"] == pytest.approx(400)
    assert rect["ell"]["area"] == pytest.approx(1600)
    assert rect["triangle"]["area"] == pytest.approx(100)


def star(rng, n, low, high):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    radii = [rng.uniform(low, high) for _ in range(n)]
    return [(r * math.cos(a), r * math.sin(a)) for a, r in zip(angles, radii)]


def grid_masks(ring, xs, ys):
    """Inside mask and distance to the ring for a grid of points."""
    x, y = np.meshgrid(xs, ys)
    inside, dist = np.zeros(x.shape, bool), np.full(x.shape, np.inf)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        dx, dy = x2 - x1, y2 - y1
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0, 1)
        dist = np.minimum(dist, np.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return inside, dist


def test_rectangle_not_smaller_than_shape_and_turns_with_it(spark):
    rng = random.Random(5)
    rings = [star(rng, 12, 5, 20) for _ in range(20)]
    turned = [[(0.6 * x - 0.8 * y, 0.8 * x + 0.6 * y) for x, y in r][3:] for r in rings]
    turned = [t + [(0.6 * x - 0.8 * y, 0.8 * x + 0.6 * y) for x, y in r[:3]] for t, r in zip(turned, rings)]
    df = frame(spark, [(f"a{i}", geom([r])) for i, r in enumerate(rings)] + [(f"b{i}", geom([r[::-1]])) for i, r in enumerate(turned)])
    rect = values(df, R.min_rectangle(R.vertices(F.col("geom")))["area"])
    area = values(df, R.area(F.col("geom")))
    for i in range(20):
        assert rect[f"a{i}"] >= area[f"a{i}"]
        assert rect[f"a{i}"] == pytest.approx(rect[f"b{i}"], rel=1e-9)


@pytest.mark.parametrize("metres", [-4.0, -1.0, 3.0])
def test_buffer_against_grid(spark, metres):
    rng = random.Random(11)
    rings = {f"s{i}": star(rng, 10 + i, 8, 25) for i in range(8)}
    rings |= {"ell": ELL, "square": SQUARE}
    df = outline.add_buffer(frame(spark, [(k, geom([r])) for k, r in rings.items()]), "geom", "out", metres)
    got = values(df, R.area(F.col("out")))
    assert all(values(df.where(F.size("out") > 0), R.is_valid(F.col("out"))).values())
    for name, ring in rings.items():
        xs = np.linspace(-30, 45, 900)
        inside, dist = grid_masks(ring, xs, xs)
        kept = inside & (dist > -metres) if metres < 0 else inside | (dist < metres)
        assert got[name] == pytest.approx(kept.sum() * (xs[1] - xs[0]) ** 2, rel=0.02, abs=2)


def test_erosion_can_split_a_shape(spark):
    bell = [(0, 0), (20, 0), (20, 8), (30, 8), (30, 0), (50, 0), (50, 20), (30, 20), (30, 12), (20, 12), (20, 20), (0, 20)]
    df = outline.add_buffer(frame(spark, [("bell", geom([bell]))]), "geom", "out", -5.0)
    assert values(df, F.size("out"))["bell"] == 2


def test_overlap_area_against_grid(spark):
    rng = random.Random(3)
    a = [star(rng, 9, 5, 20) for _ in range(6)]
    b = [[(x + 6, y - 4) for x, y in star(rng, 11, 5, 20)] for _ in range(6)]
    rows = [(str(i), geom([p]), geom([q[::-1]])) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, f"id string, g {R.GEOM_DDL}, h {R.GEOM_DDL}")
    df = R.settle(
        df, e=R.edges(F.col("g")), f=R.edges(F.col("h")), bg=R.bbox(F.col("g")), bh=R.bbox(F.col("h"))
    )
    shared = values(df, cells.overlap_area(F.col("e"), F.col("f"), F.col("bg"), F.col("bh")))
    swapped = values(df, cells.overlap_area(F.col("f"), F.col("e"), F.col("bh"), F.col("bg")))
    own = values(df, cells.overlap_area(F.col("e"), F.col("e"), F.col("bg"), F.col("bg")))
    area = values(df, R.area(F.col("g")))
    xs = np.linspace(-30, 40, 1200)
    for i, (p, q) in enumerate(zip(a, b)):
        both = grid_masks(p, xs, xs)[0] & grid_masks(q, xs, xs)[0]
        assert shared[str(i)] == pytest.approx(both.sum() * (xs[1] - xs[0]) ** 2, rel=0.01, abs=0.5)
        assert shared[str(i)] == pytest.approx(swapped[str(i)])
        assert own[str(i)] == pytest.approx(area[str(i)])


def test_repair_rungs(spark):
    tiny = [(0, 0), (10, 0), (10, 10), (4.9, 10), (5.2, 10.05), (5.2, 9.95), (4.8, 10), (0, 10)]
    rows = frame(
        spark,
        [
            ("bow", geom([BOW])),
            ("tiny loop", geom([tiny])),
            ("big loop", geom([[(0, 0), (10, 0), (10, 5), (20, 15), (20, 5), (10, 15), (0, 15)]])),
            ("fine", geom([SQUARE])),
            ("outside", geom([[(175, 0), (180, 0), (180, 5)]])),
            ("flat", geom([[(0, 0), (1, 1), (2, 2)]])),
            ("empty", []),
            ("missing", None),
        ],
    )
    done = repair.repair(rows).cache()
    assert values(done, F.col("repair_rung")) == {
        "bow": "hull",
        "tiny loop": "zero buffer",
        "big loop": "emptied: invalid",
        "fine": "none",
        "outside": "emptied: out of bounds",
        "flat": "emptied: no area",
        "empty": "empty",
        "missing": "missing",
    }
    assert set(values(done, repair.state(F.col("geom"))).values()) == {"valid", "empty"}
    assert values(done, R.area(F.col("geom")))["bow"] == 100


def test_known_utm_and_zones(spark):
    df = spark.createDataFrame(
        [("toronto", -79.387139, 43.642567), ("bergen", 5.3, 60.4), ("svalbard", 15.0, 78.0), ("sydney", 151.2, -33.87)],
        "id string, lon double, lat double",
    )
    zone = values(df, P.utm_zone(F.col("lon"), F.col("lat")))
    assert zone == {"toronto": 17, "bergen": 32, "svalbard": 33, "sydney": 56}
    at = values(df, P.utm_vertex(R.vertex(F.col("lon"), F.col("lat")), P.utm_zone(F.col("lon"), F.col("lat")), F.col("lat") < 0))
    # Published position of the CN Tower: 17N 630084 4833438.
    assert at["toronto"]["x"] == pytest.approx(630084, abs=1)
    assert at["toronto"]["y"] == pytest.approx(4833438, abs=1)


def test_geodesic_area_and_distance(spark):
    octant = geom([[(0, 0), (90, 0), (90, 90)]])
    df = frame(spark, [("octant", octant)])
    # An eighth of the WGS84 ellipsoid.
    assert values(df, P.geodesic_area(F.col("geom")))["octant"] == pytest.approx(510065621724088.4 / 8, rel=1e-9)
    pairs = spark.createDataFrame(
        [("flinders", 144.42486788888888, -37.95103341666667, 143.92649552777777, -37.65282113888889), ("same", 1.0, 2.0, 1.0, 2.0), ("equator", 0.0, 0.0, 1.0, 0.0)],
        "id string, a double, b double, c double, d double",
    )
    d = values(pairs, P.geodesic_distance(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    # Vincenty's published example; one degree of the equator.
    assert d["flinders"] == pytest.approx(54972.271, abs=0.02)
    assert d["same"] == 0
    assert d["equator"] == pytest.approx(111319.4908, abs=0.001)


def test_radius_is_a_64_gon(spark):
    edge = 40 * math.cos(math.pi / 64)
    far = [(0, 0)]
    rows = []
    for name, r, angle in (("corner", 39.999, 0), ("side in", edge - 0.001, math.pi / 64), ("side out", edge + 0.01, math.pi / 64)):
        x, y = r * math.cos(angle), r * math.sin(angle)
        rows.append((name, geom([[(x, y), (-y, x), (-x, -y), (y, -x)]])))
    del far
    got = values(frame(spark, rows), measure.within_radius(F.col("geom"), 40.0))
    assert got == {"corner": True, "side in": True, "side out": False}


def test_text_round_trip(spark):
    df = spark.createDataFrame(
        [
            ("wkt", "POLYGON ((0 0, 1 0, 1 1, 0 0))"),
            ("hole", "polygon((0 0,9 0,9 9,0 0),(5 1, 6 1, 6 2, 5 1))"),
            ("multi", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"),
            ("json", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'),
            ("words", "POLYGON ((a b, c d, e f))"),
            ("point", "POINT (1 2)"),
            ("broken", '{"type":"Polygon"'),
        ],
        "id string, t string",
    )
    parsed = R.settle(df, geom=from_text(F.col("t")))
    assert values(parsed, F.size("geom")) == {"wkt": 1, "hole": 1, "multi": 2, "json": 1, "words": None, "point": None, "broken": None}
    assert values(parsed, F.size(F.get("geom", F.lit(0))))["hole"] == 2
    text = values(parsed, feature_count(to_geojson(F.col("geom"), F.col("id"))))
    assert text["multi"] == 1 and text["words"] == 0


def test_edge_distance(spark):
    e = lambda x1, y1, x2, y2: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])
    row = spark.range(1).select(
        edge_distance(e(0, 0, 10, 0), e(3, 4, 3, 9)).alias("a"),
        edge_distance(e(0, 0, 10, 0), e(5, -1, 5, 1)).alias("b"),
        edge_distance(e(0, 0, 10, 0), e(13, 4, 20, 4)).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (4, 0, 5)


def test_v2_measures_keep_percentages(spark):
    rows = frame(spark, [("a", geom([[(75.0, 10.0), (75.000225, 10.0), (75.000225, 10.000225), (75.0, 10.000225)]]))])
    out = measure.measure(repair.repair(rows, generation=2), C.SUBPLOTS_V2).first()
    assert out["vertices_dropped"] == 0 and out["vertices_valid_percentage"] == 100
    assert out["length_width_ratio"] == pytest.approx(1.0, abs=0.02)
