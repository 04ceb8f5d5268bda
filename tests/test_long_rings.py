"""Sweep, hull and rectangle of long rings against the column expressions and brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcheck.functions import rings as R
from parcelcheck.operators import long_rings as L
from parcelcheck.operators.repair import simplify_geometry


def star(n, seed, dent=0.3):
    rng = random.Random(seed)
    ring = [(math.cos(6.283185 * i / n) * r, math.sin(6.283185 * i / n) * r) for i in range(n) for r in [1 - dent * rng.random()]]
    return ring + ring[:1]


def shapes():
    rng = random.Random(1)
    out = [[[star(12, s)]] for s in range(4)]
    for s in range(12):  # crossed, touched, spiked and repeated corners
        ring = star(14, s)[:-1]
        i, j = rng.sample(range(14), 2)
        kind = s % 4
        if kind == 0:
            ring[i], ring[j] = ring[j], ring[i]
        elif kind == 1:
            ring[i] = ring[j]
        elif kind == 2:
            ring[i:i] = [ring[i]]
        else:
            a, b = ring[i], ring[i - 1]
            ring[i:i] = [(2 * a[0] - b[0], 2 * a[1] - b[1])]
        out.append([[ring + ring[:1]]])
    small = lambda s, x: [(x + 0.2 * a, 0.2 * b) for a, b in star(10, s)]
    out += [[[star(16, 5), small(1, x)]] for x in (0.0, 0.75, 3.0)] + [[[star(16, 6)], [small(2, x)]] for x in (2.0, 0.9)]
    out += [[[star(9, 2)[:-1]]], [[[(0, 0), (1, 1), (0, 0)]]], []]
    return out


def test_sweep_equals_expressions(spark):
    rows = [(k, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in g]) for k, g in enumerate(shapes())]
    frame = spark.createDataFrame(rows, f"k int, geom {R.GEOM_DDL}")
    want = {r.k: r.v for r in frame.select("k", R.is_valid(F.col("geom")).alias("v")).collect()}
    got = {k: L.shape_is_valid(L._arrays(g)) for k, g in rows}
    assert got == want and 5 < sum(want.values()) < len(want) - 5
    ready = {r.k: r.v for r in frame.select("k", L.is_valid(F.col("geom")).alias("v")).collect()}
    assert ready == want


@pytest.mark.parametrize("n", [3, 4, 7, 50, 400])
def test_rectangle_equals_every_direction(n):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        p = rng.normal(size=(n, 2)) if seed % 2 else rng.integers(0, 4, (n, 2)).astype(float)
        hull = L.hull_points(p)
        if len(hull) < 3:
            assert L.smallest_rectangle(p) is None
            continue
        best = math.inf
        for a, b in zip(hull, np.roll(hull, -1, axis=0)):
            d = (b - a) / np.hypot(*(b - a))
            u, v = (p - a) @ d, (p - a) @ np.array([-d[1], d[0]])
            assert v.min() > -1e-9  # every point lies left of every hull edge
            best = min(best, (u.max() - u.min()) * v.max())
        assert abs(L.smallest_rectangle(p)[0] - best) < 1e-9 * max(1, best)


def test_long_rectangle_joins_the_short_one(spark):
    ring = [{"x": x, "y": y} for x, y in star(200, 3)]
    frame = spark.createDataFrame([(1, ring), (2, ring[:30]), (3, None), (4, ring[:2])], f"k int, r {R.RING_DDL}")
    got = {r.k: (r.a, r.b) for r in frame.select("k", L.min_rectangle(F.col("r")).area.alias("a"), R.min_rectangle(F.col("r")).area.alias("b")).collect()}
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in got.values())


def test_nine_hundred_corners_take_milliseconds():
    ring = np.array(star(900, 4))
    began = time.perf_counter()
    for _ in range(10):
        assert L.shape_is_valid([[ring]]) and L.smallest_rectangle(ring)
    assert (time.perf_counter() - began) / 10 < 0.02


def test_simplification_keeps_the_line_within_its_tolerance():
    """Every dropped vertex is near the kept line; a straight line keeps its ends, a zero tolerance every corner."""
    for seed in range(30):
        ring = np.array(star(40, seed, 0.1 + seed / 60))
        for tolerance in (0.0, 0.02, 0.1, 5.0):
            keep = L.kept_corners(ring, tolerance)
            at = np.flatnonzero(keep)
            assert keep[0] and keep[-1]
            for n in np.flatnonzero(~keep):
                a, b = ring[at[at < n][-1]], ring[at[at > n][0]]
                d = b - a
                t = np.clip((ring[n] - a) @ d / max(d @ d, 1e-30), 0, 1)
                assert np.hypot(*(ring[n] - a - t * d)) <= tolerance + 1e-12
    line = np.stack([np.arange(20.0), np.zeros(20)], axis=1)
    assert L.kept_corners(line, 0.0).sum() == 2


def test_simplified_shapes_stay_valid(spark):
    rows = [(k, [[[{"x": 73 + x / 1000, "y": 9 + y / 1000} for x, y in star(80, k)]]]) for k in range(6)] + [(7, []), (8, None)]
    frame = spark.createDataFrame(rows, f"k int, geom {R.GEOM_DDL}")
    assert simplify_geometry(frame) is frame
    small = simplify_geometry(frame, 20.0)
    assert small.columns == ["k", "geom"]
    got = {r.k: r.geom for r in small.collect()}
    assert got[7] == [] and got[8] is None
    for k, geom in rows[:6]:
        assert 4 <= len(got[k][0][0]) < 81 and L.shape_is_valid(L._arrays(got[k]))
        corners = {(v["x"], v["y"]) for v in geom[0][0]}
        assert all((v["x"], v["y"]) in corners for v in got[k][0][0])
    whole = {r.k: r.geom for r in simplify_geometry(frame, 1e6).collect()}
    assert all(len(whole[k][0][0]) == 81 for k in range(6))  # nothing would be left of them
