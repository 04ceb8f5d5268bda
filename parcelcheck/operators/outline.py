"""Arrow helpers for the two shapes column expressions cannot state.

Both the zero-width buffer of a self-crossing ring and the buffer of a
non-convex one cut a set of directed segments at their intersections, keep
the pieces that bound the wanted region and link them to rings. Spark hands
over only the rows that need this; all others pass as NULL.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions import rings as R
from parcelcheck.operators import ring_batches as B

# Workers need these few functions only, not the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUARTER_SEGMENTS = 16
#: Degrees within which the zero-width buffer takes points as one.
ZERO_TOLERANCE = 1e-11
_GEOM_ARROW = pa.list_(
    pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
)


#: Segments that are compared with each other at once.
_TOGETHER = 128


def _cut(seg: np.ndarray, tol: float) -> np.ndarray:
    """Split directed segments wherever another one meets them."""
    p, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    out = []
    for at in range(0, len(seg), _TOGETHER):
        some = slice(at, at + _TOGETHER)
        q, e, own = p[some, None], d[some, None], length[some, None]
        w, far = p - q, seg[:, 2:] - q
        den = e[..., 0] * d[:, 1] - e[..., 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[..., 0] * d[:, 1] - w[..., 1] * d[:, 0]) / den
            u = (w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0]) / den
            slack = tol / length
        ends = np.concatenate((w, far), axis=1)
        along = (ends[..., 0] * e[..., 0] + ends[..., 1] * e[..., 1]) / own**2
        off = np.abs(ends[..., 0] * e[..., 1] - ends[..., 1] * e[..., 0]) / own
        cuts = np.concatenate((t, along), axis=1)
        met = np.concatenate(((np.abs(den) > 0) & (u >= -slack) & (u <= 1 + slack), off <= tol), axis=1)
        met &= (cuts >= 0) & (cuts <= 1)
        for i in range(len(cuts)):
            x, y = p[at + i].tolist()
            dx, dy = d[at + i].tolist()
            size = float(length[at + i])
            places = sorted({0.0, 1.0, *cuts[i, met[i]].tolist()})
            places = [places[0], *(c for b, c in zip(places, places[1:]) if (c - b) * size > tol)]
            corners = [(x + c * dx, y + c * dy) for c in places]
            out += [(*b, *c) for b, c in zip(corners, corners[1:])]
    return np.array(out, dtype=float).reshape(-1, 4)


def _winding(points: np.ndarray, ring_segments: np.ndarray) -> np.ndarray:
    x, y = points[:, :1], points[:, 1:]
    x1, y1, x2, y2 = ring_segments.T
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    up = (y1 <= y) & (y2 > y) & (side > 0)
    down = (y1 > y) & (y2 <= y) & (side < 0)
    return up.sum(axis=1) - down.sum(axis=1)


def _link(seg: np.ndarray, tol: float) -> list[list[dict]]:
    """Directed boundary pieces (inside on the left) to parts with holes."""
    keys = np.round(seg / (tol * 8)).astype(np.int64).tolist()
    first: dict[tuple, int] = {}
    for i, k in enumerate(keys):
        first.setdefault(tuple(k), i)
    keep = list(first.values())
    seg, keys = seg[keep], [keys[i] for i in keep]
    rows = seg.tolist()
    leaving: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        leaving.setdefault((k[0], k[1]), []).append(i)
    used, loops = set(), []
    for begin in range(len(rows)):
        if begin in used:
            continue
        chain, i = [], begin
        while i is not None and i not in used:
            used.add(i)
            chain.append(i)
            dx, dy = rows[i][2] - rows[i][0], rows[i][3] - rows[i][1]
            best, i_next = None, None
            for j in leaving.get((keys[i][2], keys[i][3]), ()):
                ex, ey = rows[j][2] - rows[j][0], rows[j][3] - rows[j][1]
                turn = math.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
                if j not in used and (best is None or turn > best):
                    best, i_next = turn, j
            i = i_next
        loop = seg[chain][:, :2]
        if len(loop) >= 3:
            loops.append(loop)

    def area(v: np.ndarray) -> float:
        w, q = v - v[0], np.roll(v - v[0], -1, axis=0)
        return float((w[:, 0] * q[:, 1] - q[:, 0] * w[:, 1]).sum() / 2)

    sized = [(area(v), v) for v in loops]
    shells = sorted(((a, v, []) for a, v in sized if a > tol * tol), key=lambda s: s[0])
    for a, v in sized:
        if a < -tol * tol:
            for _, shell, holes in shells:
                ring = np.hstack([shell, np.roll(shell, -1, axis=0)])
                if _winding(v.mean(axis=0, keepdims=True), ring)[0] or _winding(v[:1], ring)[0]:
                    holes.append(v)
                    break

    def closed(v: np.ndarray) -> list[dict]:
        return [{"x": float(x), "y": float(y)} for x, y in np.vstack([v, v[:1]])]

    return [[closed(shell)] + [closed(h) for h in holes] for _, shell, holes in reversed(shells)]


def _segments(geom: list) -> np.ndarray:
    rows = [
        (a["x"], a["y"], b["x"], b["y"])
        for part in geom
        for ring in part
        for a, b in zip(ring[:-1], ring[1:])
        if (a["x"], a["y"]) != (b["x"], b["y"])
    ]
    return np.array(rows, dtype=float).reshape(-1, 4)


def resolve_crossings(geom: list, tol: float) -> list:
    """Region of positive winding, as a zero-width buffer leaves it."""
    seg = _segments(geom)
    if not len(seg):
        return []
    origin = seg[0, :2].copy()
    seg = seg - np.tile(origin, 2)
    if (seg[:, 0] * seg[:, 3] - seg[:, 2] * seg[:, 1]).sum() < 0:
        seg = seg[:, [2, 3, 0, 1]]
    pieces = _cut(seg, tol)
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    d = pieces[:, 2:] - pieces[:, :2]
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / np.hypot(d[:, 0], d[:, 1])[:, None]
    left = _winding(mid + normal * tol * 4, seg) > 0
    right = _winding(mid - normal * tol * 4, seg) > 0
    return _shift(_link(pieces[left & ~right], tol), origin)


def offset(geom: list, metres: float, tol: float = 1e-6) -> list:
    """Buffer of an oriented geometry in metres; negative shrinks it."""
    seg = _segments(geom)
    if not len(seg) or metres == 0:
        return geom
    grow, r = metres > 0, abs(metres)
    origin = seg[0, :2].copy()
    seg = seg - np.tile(origin, 2)
    walls = seg[:, [2, 3, 0, 1]] if grow else seg
    d = walls[:, 2:] - walls[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / length[:, None]
    shifted = walls + np.tile(normal * r, 2)
    # Round joins where the wall turns away from the wanted side.
    starts = {tuple(w[:2]): i for i, w in enumerate(walls)}
    arcs, fans = [], []
    for i, w in enumerate(walls):
        j = starts.get(tuple(w[2:]))
        if j is None:
            continue
        turn = math.atan2(d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0], d[i] @ d[j])
        if turn >= 0:
            continue
        steps = max(int(-turn / (math.pi / 2 / QUARTER_SEGMENTS) + 0.5), 1)
        angle = math.atan2(normal[i, 1], normal[i, 0]) + turn * np.arange(steps + 1) / steps
        arc = w[2:] + r * np.column_stack([np.cos(angle), np.sin(angle)])
        arc[0], arc[-1] = shifted[i, 2:], shifted[j, :2]
        arcs.append(np.hstack([arc[:-1], arc[1:]]))
        fans.append(np.hstack([np.tile(w[2:], (steps, 1)), arc[1:], arc[:-1]]))
    lines = np.vstack([shifted, *arcs])
    lines = lines[np.hypot(lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]) > tol]
    pieces = _cut(lines, tol)
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    keep = (_winding(mid, seg) > 0) != grow
    w = mid[:, None, :] - walls[None, :, :2]
    along = (w * d).sum(axis=2) / length
    away = (w * normal).sum(axis=2)
    slack = tol * 4
    keep &= ~(
        (along > slack) & (along < length - slack) & (away > -slack) & (away < r - slack)
    ).any(axis=1)
    if fans:
        tri = np.vstack(fans)
        within = np.ones((len(mid), len(tri)), dtype=bool)
        for a, b in ((0, 2), (2, 4), (4, 0)):
            ex, ey = tri[:, b] - tri[:, a], tri[:, b + 1] - tri[:, a + 1]
            side = ex * (mid[:, 1:] - tri[:, a + 1]) - ey * (mid[:, :1] - tri[:, a])
            within &= side > slack * np.hypot(ex, ey)
        keep &= ~within.any(axis=1)
    kept = pieces[keep]
    return _shift(_link(kept[:, [2, 3, 0, 1]] if grow else kept, tol), origin)


def _shift(parts: list, origin: np.ndarray) -> list:
    for part in parts:
        for ring in part:
            for v in ring:
                v["x"] += float(origin[0])
                v["y"] += float(origin[1])
    return parts


def _per_geometry(fn) -> object:
    def run(values: pa.Array) -> pa.Array:
        return pa.array(
            [None if g is None else fn(g) for g in values.to_pylist()], type=_GEOM_ARROW
        )

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, R.GEOM_DDL)


def zero_buffer(geom: Column, where: Column) -> Column:
    """Zero-width buffer of the geometries (in degrees) that match ``where``, else NULL."""
    return _per_geometry(lambda g: resolve_crossings(g, ZERO_TOLERANCE))(F.when(where, geom))


def shrink_convex(ring: Column, metres: float) -> Column:
    """Move every side of a convex ring inwards and clip; exact, stays in the JVM."""

    def clip(open_ring: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        norm = F.sqrt(dx * dx + dy * dy)

        def depth(v: Column) -> Column:
            return (dx * (v["y"] - e["y1"]) - dy * (v["x"] - e["x1"])) / norm - metres

        marked = F.transform(
            open_ring, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), depth(v).alias("d"))
        )

        def emit(ms: Column) -> Column:
            def corner(a: Column, i: Column) -> Column:
                b = F.get(ms, (i + 1) % F.size(ms))
                t = F.try_divide(a["d"], a["d"] - b["d"])
                own = F.array(R.vertex(a["x"], a["y"]))
                hit = F.array(
                    R.vertex(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))
                )
                none = F.array().cast(R.RING_DDL)
                cut = F.when((a["d"] < 0) != (b["d"] < 0), hit).otherwise(none)
                return F.concat(F.when(a["d"] >= 0, own).otherwise(none), cut)

            return F.flatten(F.transform(ms, corner))

        return R.let(marked, emit)

    return F.aggregate(
        R.ring_edges(ring),
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        clip,
        lambda v: F.when(F.size(v) < 3, R.empty_geom()).otherwise(
            R.polygon(F.concat(v, F.slice(v, 1, 1)))
        ),
    )


def add_buffer(df: DataFrame, geom: str, out: str, metres: float) -> DataFrame:
    """Buffer of a geometry column in metres.

    Single convex rings are shrunk many at a time; every other shape is cut on
    its own.
    """
    g = F.col(geom)
    if metres == 0:
        return df.withColumn(out, g)
    ready = R.settle(df, _made=_buffered(metres)(g))
    return R.settle(ready, **{out: F.coalesce("_made.plain", "_made.other")}).drop("_made")


def _buffered(metres: float) -> object:
    """Arrow function to ``struct<plain, other>``: the buffers of convex rings and of other shapes."""
    names = ["plain", "other"]

    def some(values: pa.Array) -> pa.Array:
        xy, part_at, ring_at, at = B.shapes(values)
        null = values.is_null().to_numpy(zero_copy_only=False)
        xy = B.oriented(xy, ring_at, at)
        first, last = ring_at[part_at[:-1]], ring_at[part_at[1:]]
        parts = np.diff(part_at)
        one = (parts == 1) & (last - first == 1)
        if metres > 0:
            one[:] = False
        rows = np.flatnonzero(one)
        begin, size = at[first[rows]], np.diff(at)[first[rows]]
        inner, corners = [np.zeros((0, 2))] * len(rows), np.zeros(len(values), dtype=np.int64)
        plain = parts == 0
        for n in np.unique(size):
            same = np.flatnonzero(size == n)
            ring = xy[begin[same][:, None] + np.arange(n)]
            convex = B.convex_rings(ring)
            plain[rows[same[convex]]] = True
            kept, count = B.shrunk_rings(ring[convex], -metres)
            for k, v, m in zip(same[convex], kept, count):
                if m >= 3:
                    inner[k], corners[rows[k]] = v[np.append(np.arange(m), 0)], m + 1
        made = np.concatenate([np.zeros((0, 2)), *inner])
        vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        lists = pa.StructArray.from_arrays([pa.array(c) for c in made.T], fields=list(vertex))
        full = corners > 0
        for place in (B.starts(corners[full]), np.arange(full.sum() + 1)):
            lists = pa.ListArray.from_arrays(pa.array(place, pa.int32()), lists)
        lists = pa.ListArray.from_arrays(pa.array(B.starts(full), pa.int32()), lists, mask=pa.array(~plain))
        rest = ~plain & ~null
        other = [None] * len(values)
        for row in np.flatnonzero(rest):
            other[row] = offset(
                [
                    [[{"x": x, "y": y} for x, y in xy[at[r] : at[r + 1]].tolist()] for r in range(ring_at[p], ring_at[p + 1])]
                    for p in range(part_at[row], part_at[row + 1])
                ],
                metres,
            )
        return pa.StructArray.from_arrays(
            [lists.cast(_GEOM_ARROW), pa.array(other, _GEOM_ARROW)], names, mask=pa.array(null)
        )

    def run(values: pa.Array) -> pa.Array:
        done = [some(part) for part in B.slices(values, 3)]
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([(n, _GEOM_ARROW) for n in names]))

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<plain:{R.GEOM_DDL},other:{R.GEOM_DDL}>")
