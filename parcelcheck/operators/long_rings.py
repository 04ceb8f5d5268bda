"""Validity and smallest rectangles of shapes of any number of vertices.

Shapes go through Arrow batches. Single rings of up to ``LONG`` vertices, the
few corners of a usual trace, are compared edge by edge for the whole batch at
once (``ring_batches``). In longer shapes edges are sorted and swept, hulls are
built from sorted points with a stack, and the rectangle's sides are walked
round the hull by the angles of its edges, shape by shape. No vertex becomes a
Python object.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelcheck.functions import rings as R
from parcelcheck.functions.project import A, AUTHALIC_R2, E2, ECC, K0, Q_POLE, RECTIFYING, SERIES
from parcelcheck.operators import ring_batches as B
from parcelcheck.operators.outline import ZERO_TOLERANCE, resolve_crossings

# Workers need these few functions only, not the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vertices up to which shapes are worked on many at a time.
LONG = 64
#: Pairs of edges that are compared at once.
_PAIRS = 1 << 19
_FIELDS = ("area", "w", "h", "x0", "y0", "ux", "uy")


def is_valid(geom: Column) -> Column:
    """``rings.is_valid`` for shapes of any length."""
    return _by_slices(_valid_slice, 3, pa.bool_(), T.BooleanType())(geom)


def min_rectangle(points: Column) -> Column:
    """``rings.min_rectangle`` for any number of points."""
    kind = pa.struct([(f, pa.float64()) for f in _FIELDS])
    returns = T.StructType([T.StructField(f, T.DoubleType()) for f in _FIELDS])
    return _by_slices(_rectangle_slice, 1, kind, returns)(points)


def _by_slices(make, depth: int, kind: pa.DataType, returns: T.DataType):
    """An Arrow function that works through a batch of nested lists in bounded slices."""

    def run(values: pa.Array) -> pa.Array:
        done = [make(part) for part in B.slices(values, depth)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def _valid_slice(values: pa.Array) -> pa.Array:
    return pa.array(_valid_rows(*B.shapes(values)), pa.bool_(), mask=_nulls(values))


def _valid_rows(xy: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    first, last = ring_at[part_at[:-1]], ring_at[part_at[1:]]
    size = at[last] - at[first]
    out = np.ones(len(size), dtype=bool)
    one = np.flatnonzero((last - first == 1) & (size <= LONG))
    ends = B.starts(size[one])
    picked = np.repeat(at[first[one]] - ends[:-1], size[one]) + np.arange(ends[-1])
    out[one] = B.simple_rings(xy[picked], ends)
    rest = np.ones(len(size), dtype=bool)
    rest[one] = False
    for row in np.flatnonzero(rest & (last > first)):
        parts = [
            [xy[at[ring] : at[ring + 1]] for ring in range(ring_at[part], ring_at[part + 1])]
            for part in range(part_at[row], part_at[row + 1])
        ]
        out[row] = shape_is_valid(parts)
    return out


def _rectangle_slice(values: pa.Array) -> pa.Array:
    return _rectangles(B.coordinates(values.flatten()), B.starts(B.lengths(values)))


def _rectangles(xy: np.ndarray, at: np.ndarray) -> pa.Array:
    """Smallest rectangles of lists of points."""
    size = np.diff(at)
    few = np.flatnonzero(size <= LONG)
    ends = B.starts(size[few])
    picked = np.repeat(at[few] - ends[:-1], size[few]) + np.arange(ends[-1])
    made, has = np.zeros((len(size), len(_FIELDS))), np.zeros(len(size), dtype=bool)
    made[few], has[few] = B.smallest_rectangles(xy[picked], ends)
    for row in np.flatnonzero(size > LONG):
        found = smallest_rectangle(xy[at[row] : at[row + 1]])
        if found is not None:
            made[row], has[row] = found, True
    return pa.StructArray.from_arrays(
        [pa.array(column) for column in made.T], list(_FIELDS), mask=pa.array(~has)
    )


def moments(geom: Column) -> Column:
    """``rings.moments`` of all edges of a shape."""
    kind = pa.struct([(f, pa.float64()) for f in ("area", "cx", "cy")])

    def made(values: pa.Array) -> pa.Array:
        found, has = B.moments(*B.shapes(values))
        return pa.StructArray.from_arrays([pa.array(c) for c in found.T], ["area", "cx", "cy"], mask=pa.array(~has))

    return _by_slices(made, 3, kind, T.StructType([T.StructField(f, T.DoubleType()) for f in ("area", "cx", "cy")]))(geom)


_FACTS = ("area", "minx", "miny", "maxx", "maxy")


def area_and_reach(geom: Column) -> Column:
    """``rings.area`` and the bounds of a shape in one pass: ``struct<area, minx, miny, maxx, maxy>``."""

    def made(values: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_facts(*B.shapes(values)), list(_FACTS), mask=pa.array(_nulls(values)))

    kind = pa.struct([(f, pa.float64()) for f in _FACTS])
    return _by_slices(made, 3, kind, T.StructType([T.StructField(f, T.DoubleType()) for f in _FACTS]))(geom)


def _facts(xy: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    rows = len(part_at) - 1
    row = B.rows_of_vertices(part_at, ring_at, at)
    first = np.searchsorted(row, np.arange(rows))
    some = np.bincount(row, minlength=rows) > 0
    found = np.full((5, rows), np.nan)
    found[0] = B.areas(xy, part_at, ring_at, at)
    for n, (least, axis) in enumerate(((np.minimum, 0), (np.minimum, 1), (np.maximum, 0), (np.maximum, 1)), 1):
        if some.any():
            found[n, some] = least.reduceat(xy[:, axis], first[some])
    return [pa.array(c, mask=None if not n else ~some) for n, c in enumerate(found)]


def examined(geom: Column) -> Column:
    """What the repair asks of a shape, in one pass: ``struct<valid, area, minx, miny, maxx, maxy, zero>``.

    ``zero`` is the zero-width buffer of an invalid shape; NULL for a valid one
    and for a single ring of five coordinates, which becomes its hull.
    """
    vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    zero_kind = pa.list_(pa.list_(pa.list_(vertex)))
    names = ["valid", *_FACTS, "zero"]

    def made(values: pa.Array) -> pa.Array:
        xy, part_at, ring_at, at = B.shapes(values)
        valid, null = _valid_rows(xy, part_at, ring_at, at), _nulls(values)
        first, last = ring_at[part_at[:-1]], ring_at[part_at[1:]]
        bowtie = (last - first == 1) & (at[last] - at[first] == 5)
        crossed = ~valid & ~null & ~bowtie
        buffers = iter(values.filter(pa.array(crossed)).to_pylist())
        zero = pa.array(
            [resolve_crossings(next(buffers), ZERO_TOLERANCE) if c else None for c in crossed.tolist()], zero_kind
        )
        return pa.StructArray.from_arrays(
            [pa.array(valid), *_facts(xy, part_at, ring_at, at), zero], names, mask=pa.array(null)
        )

    kind = pa.struct([("valid", pa.bool_()), *[(f, pa.float64()) for f in _FACTS], ("zero", zero_kind)])
    returns = f"struct<valid:boolean,{','.join(f + ':double' for f in _FACTS)},zero:{R.GEOM_DDL}>"
    return _by_slices(made, 3, kind, returns)(geom)


def plane_measures(geom: Column, generation: int, reach: float, half_step: float) -> Column:
    """All measures of a shape in the zone of its own centre, in one pass.

    ``struct<area, rect, in_circle, box, long, short>``. Generation 1 takes the
    area and the rectangle in the plane and the circle of the first part,
    generation 2 the geodesic area, the rectangle in degrees and the circle of
    all parts. ``box`` is the rectangle's area, ``long`` and ``short`` are its
    sides. A centre outside the UTM domain gives the measures of the empty polygon.
    """
    rect_kind = pa.struct([(f, pa.float64()) for f in _FIELDS])
    names = ["area", "rect", "in_circle", "box", "long", "short"]

    def made(values: pa.Array) -> pa.Array:
        xy, *places = B.shapes(values)
        part_at, ring_at, at = places
        null, parts = _nulls(values), np.diff(part_at)
        centre, has = B.moments(xy, *places)
        lon, lat = centre[:, 1], centre[:, 2]
        inside = ~has | ((lat >= -80) & (lat <= 84) & (lon >= -180) & (lon <= 180))
        zone = np.where(has, _zones(lon, lat), np.nan)
        row = B.rows_of_vertices(*places)
        plane = np.column_stack(_project(xy, zone[row], np.where(has & (lat < 0), 1e7, 0.0)[row]))
        corners = at[ring_at[part_at]]
        if generation == 1:
            area, rect = B.areas(plane, *places), _rectangles(plane, corners)
            area[~inside] = 0.0
            boxless = ~inside
        else:
            area, rect = B.signed_parts(np.abs(_geodesic_ring_areas(xy, at)), part_at, ring_at), _rectangles(xy, corners)
            boxless = np.zeros(len(values), dtype=bool)
        # a part without a ring leaves the area unknown
        hollow = np.bincount(np.repeat(np.arange(len(values)), parts), np.diff(ring_at) == 0, minlength=len(values)) > 0
        unknown = null | (hollow & (inside if generation == 1 else True))
        around = B.first_parts(plane, *places) if generation == 1 else (plane, *places)
        circle, edged = _circle(*around, reach, half_step)
        blank = (parts == 0) | ~inside
        boxless |= rect.is_null().to_numpy(False)
        frame = [rect.field(f).to_numpy(False) for f in _FIELDS]
        size = [pa.array(v, mask=boxless) for v in (_plane_box(*frame) if generation == 1 else _geodesic_box(*frame))]
        rect = pa.StructArray.from_arrays([rect.field(f) for f in _FIELDS], list(_FIELDS), mask=pa.array(boxless))
        around = pa.array(circle & ~blank, mask=null | (~edged & ~blank))
        return pa.StructArray.from_arrays([pa.array(area, mask=unknown), rect, around, *size], names)

    ends = [(f, pa.float64()) for f in names[3:]]
    kind = pa.struct([("area", pa.float64()), ("rect", rect_kind), ("in_circle", pa.bool_()), *ends])
    returns = (
        f"struct<area:double,rect:struct<{','.join(f + ':double' for f in _FIELDS)}>,in_circle:boolean,"
        "box:double,long:double,short:double>"
    )
    return _by_slices(made, 3, kind, returns)(geom)


def _plane_box(area, w, h, x0, y0, ux, uy) -> tuple[np.ndarray, ...]:
    return area, np.maximum(w, h), np.minimum(w, h)


def _geodesic_box(area, w, h, x0, y0, ux, uy) -> tuple[np.ndarray, ...]:
    """Area and sides in metres of rectangles in degrees, as ``rings.rectangle_ring`` draws them."""
    ax, ay, bx, by = w * ux, w * uy, -h * uy, h * ux
    x = np.column_stack((x0, x0 + ax, x0 + ax + bx, x0 + bx, x0))
    y = np.column_stack((y0, y0 + ay, y0 + ay + by, y0 + by, y0))
    ring = np.column_stack((x.ravel(), y.ravel()))
    size = np.abs(_geodesic_ring_areas(ring, np.arange(len(x) + 1) * 5))
    a, b = (_short_distance(x[:, i], y[:, i], x[:, i + 1], y[:, i + 1]) for i in (0, 1))
    return size, np.maximum(a, b), np.minimum(a, b)


def _short_distance(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """``project.short_distance`` for a whole batch."""
    mid = np.radians((lat1 + lat2) / 2)
    w2 = 1 - E2 * np.sin(mid) * np.sin(mid)
    north = np.radians(lat2 - lat1) * A * (1 - E2) / (w2 * np.sqrt(w2))
    east = np.radians(lon2 - lon1) * A / np.sqrt(w2) * np.cos(mid)
    return np.sqrt(north * north + east * east)


def _zones(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """``project.utm_zone`` for a whole batch."""
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    north = [svalbard & (lon < 9), svalbard & (lon < 21), svalbard & (lon < 33), svalbard]
    return np.select([norway, *north], [32, 31, 33, 35, 37], np.fmod(np.floor((lon + 180) / 6), 60) + 1)


def _geodesic_ring_areas(xy: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signed area in square metres of every ring; the steps are those of ``project.geodesic_ring_area``."""
    with np.errstate(all="ignore"):
        s = np.sin(np.radians(xy[:, 1]))
        q = (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(ECC * s) / ECC)
        half = np.tan(np.arcsin(np.fmax(np.fmin(q / Q_POLE, 1.0), -1.0)) / 2)
        ring = np.repeat(np.arange(len(at) - 1), np.diff(at))
        inner = np.flatnonzero(ring[1:] == ring[:-1])
        x, a, b = np.radians(xy[:, 0]), half[inner], half[inner + 1]
        terms = 2 * np.arctan2(np.tan((x[inner + 1] - x[inner]) / 2) * (a + b), 1 + a * b)
    return -np.bincount(ring[inner], terms, minlength=len(at) - 1) * AUTHALIC_R2


def within_circle(geom: Column, reach: float, half_step: float) -> Column:
    """Do all vertices lie in a regular polygon around the shape's centre whose sides are ``reach`` away?

    ``half_step`` is half the angle of a side. NULL without an edge.
    """

    def made(values: pa.Array) -> pa.Array:
        inside, has = _circle(*B.shapes(values), reach, half_step)
        return pa.array(inside, mask=~has)

    return _by_slices(made, 3, pa.bool_(), T.BooleanType())(geom)


def _circle(
    xy: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray, reach: float, half_step: float
) -> tuple[np.ndarray, np.ndarray]:
    """``within_circle`` of every shape, and which shapes have an edge."""
    found, has = B.moments(xy, part_at, ring_at, at)
    row = B.rows_of_vertices(part_at, ring_at, at)
    d = xy - found[row, 1:]
    turn = np.fmod(np.arctan2(d[:, 1], d[:, 0]), 2 * half_step)
    turn = np.where(turn < 0, turn + 2 * half_step, turn) - half_step
    out = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) * np.cos(turn) <= reach
    return np.bincount(row, ~out, minlength=len(has)) == 0, has


def to_utm(geom: Column, zone: Column, south: Column) -> Column:
    """``project.to_utm`` for a whole batch."""
    vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.list_(pa.list_(pa.list_(vertex)))

    def run(values: pa.Array, zones: pa.Array, souths: pa.Array) -> pa.Array:
        zone = zones.to_numpy(zero_copy_only=False).astype(float)
        false_north = np.where(souths.fill_null(False).to_numpy(zero_copy_only=False), 1e7, 0.0)
        done, begin = [], 0
        for some in B.slices(values, 3):
            xy, part_at, ring_at, at = B.shapes(some)
            row = begin + B.rows_of_vertices(part_at, ring_at, at)
            plane = _project(xy, zone[row], false_north[row])
            rings = pa.StructArray.from_arrays([pa.array(c) for c in plane], fields=list(vertex))
            for place in (at, ring_at):
                rings = pa.ListArray.from_arrays(pa.array(place, pa.int32()), rings)
            done.append(pa.ListArray.from_arrays(pa.array(part_at, pa.int32()), rings, mask=pa.array(_nulls(some))).cast(kind))
            begin += len(some)
        return pa.concat_arrays(done) if done else pa.array([], kind)

    run.__annotations__ = {"values": pa.Array, "zones": pa.Array, "souths": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, R.GEOM_DDL)(geom, zone, south)


def _project(xy: np.ndarray, zone: np.ndarray, false_north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing; the steps are those of ``project.utm_vertex``."""
    with np.errstate(all="ignore"):
        sin_lat = np.sin(np.radians(xy[:, 1]))
        t = np.sinh(np.arctanh(sin_lat) - ECC * np.arctanh(ECC * sin_lat))
        dl = np.radians(xy[:, 0] - (zone * 6 - 183))
        cos_dl = np.cos(dl)
        xi, eta = np.arctan2(t, cos_dl), np.arcsinh(np.sin(dl) / np.sqrt(t * t + cos_dl * cos_dl))
        north, east = xi, eta
        for j, coefficient in enumerate(SERIES, start=1):
            north = north + coefficient * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            east = east + coefficient * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        return 500000 + K0 * RECTIFYING * east, false_north + K0 * RECTIFYING * north


def _nulls(values: pa.Array) -> np.ndarray:
    return values.is_null().to_numpy(zero_copy_only=False)


def _points(ring: list) -> np.ndarray:
    return np.array([(v["x"], v["y"]) for v in ring], dtype=float).reshape(-1, 2)


def _arrays(geom: list) -> list[list[np.ndarray]]:
    return [[_points(ring) for ring in part] for part in geom]


def shape_is_valid(parts: list[list[np.ndarray]]) -> bool:
    """Closed rings without touch, crossing or spike, rings that don't cross each other, holes in their shells."""
    rings = [ring for part in parts for ring in part]
    edges, owner, place, count = [], [], [], []
    for n, ring in enumerate(rings):
        if len(ring) < 4 or (ring[0] != ring[-1]).any():
            return False
        own = np.hstack((ring[:-1], ring[1:]))
        own = own[(own[:, :2] != own[:, 2:]).any(axis=1)]
        if len(own) < 3 or _spikes(own):
            return False
        edges.append(own)
        owner.append(np.full(len(own), n))
        place.append(np.arange(len(own)))
        count.append(np.full(len(own), len(own)))
    if not edges:
        return True
    e, owner, place, count = np.vstack(edges), np.concatenate(owner), np.concatenate(place), np.concatenate(count)
    for i, j in _meeting(e):
        same = owner[i] == owner[j]
        gap = np.abs(place[i] - place[j])
        apart = same & (gap > 1) & (gap < count[i] - 1)
        if _touch(e[i[apart]], e[j[apart]]).any() or _cross(e[i[~same]], e[j[~same]]).any():
            return False
    return all(_has_inside(hole, part[0]) for part in parts for hole in part[1:])


def _side(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sign((e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0]))


def _spikes(e: np.ndarray) -> bool:
    f = np.roll(e, -1, axis=0)
    back = (e[:, 2] - e[:, 0]) * (f[:, 2] - f[:, 0]) + (e[:, 3] - e[:, 1]) * (f[:, 3] - f[:, 1]) < 0
    return bool((back & (_side(e, f[:, 2], f[:, 3]) == 0)).any())


def _meeting(e: np.ndarray):
    """Pairs of edges whose boxes share a point, by a sweep along the longer side of the shape."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    axis = int(np.argmax(high.max(axis=0) - low.min(axis=0)))
    order = np.argsort(low[:, axis], kind="stable")
    first = low[order, axis]
    ends = np.searchsorted(first, high[order, axis], side="right")
    many = ends - np.arange(len(order)) - 1
    upto = np.cumsum(many)
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS)))
        own = np.repeat(np.arange(at, stop), many[at:stop])
        later = own + 1 + np.arange(len(own)) - np.repeat(np.cumsum(many[at:stop]) - many[at:stop], many[at:stop])
        i, j = order[own], order[later]
        other = 1 - axis
        meet = (low[i, other] <= high[j, other]) & (low[j, other] <= high[i, other])
        yield i[meet], j[meet]
        at = stop


def _sides(e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    return _side(e, f[:, 0], f[:, 1]), _side(e, f[:, 2], f[:, 3]), _side(f, e[:, 0], e[:, 1]), _side(f, e[:, 2], e[:, 3])


def _cross(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    a, b, c, d = _sides(e, f)
    return (a * b < 0) & (c * d < 0)


def _touch(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    def within(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.minimum(g[:, :2], g[:, 2:]), np.maximum(g[:, :2], g[:, 2:])
        return (x >= low[:, 0]) & (x <= high[:, 0]) & (y >= low[:, 1]) & (y <= high[:, 1])

    a, b, c, d = _sides(e, f)
    return (
        ((a * b < 0) & (c * d < 0))
        | ((a == 0) & within(e, f[:, 0], f[:, 1]))
        | ((b == 0) & within(e, f[:, 2], f[:, 3]))
        | ((c == 0) & within(f, e[:, 0], e[:, 1]))
        | ((d == 0) & within(f, e[:, 2], e[:, 3]))
    )


def _has_inside(hole: np.ndarray, shell: np.ndarray) -> bool:
    """Does a vertex of the hole lie inside the shell? A few are tried at a time."""
    x1, y1, x2, y2 = shell[:-1, 0], shell[:-1, 1], shell[1:, 0], shell[1:, 1]
    step = max(1, _PAIRS // len(shell))
    for at in range(0, len(hole), step):
        x, y = hole[at : at + step, :1], hole[at : at + step, 1:]
        spans = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            right = (x2 - x1) * ((y - y1) / (y2 - y1)) + x1 > x
        if ((spans & right).sum(axis=1) % 2 == 1).any():
            return True
    return False


def kept_corners(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a line a simplification within ``tolerance`` keeps.

    A stretch is split at its vertex farthest from the segment between its
    ends (the first of several) as long as that is farther than the tolerance.
    """
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, -1]] = True
    open_stretches = [(0, len(ring) - 1)]
    while open_stretches:
        low, high = open_stretches.pop()
        if high - low < 2:
            continue
        a, d = ring[low], ring[high] - ring[low]
        p = ring[low + 1 : high] - a
        square = d @ d
        along = np.clip(p @ d / square, 0, 1) if square else np.zeros(len(p))
        off = p - along[:, None] * d
        far = np.hypot(off[:, 0], off[:, 1])
        n = int(np.argmax(far))
        if far[n] > tolerance:
            keep[low + 1 + n] = True
            open_stretches += [(low, low + 1 + n), (low + 1 + n, high)]
    return keep


def simplified(geom: Column, tolerance: float) -> Column:
    """A shape without the vertices that simplification within ``tolerance`` metres drops.

    Distances are those of the zone of its own centre. A shape that would
    become invalid and one outside the UTM domain stay as they are.
    """
    vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.list_(pa.list_(pa.list_(vertex)))

    def made(values: pa.Array) -> pa.Array:
        xy, part_at, ring_at, at = B.shapes(values)
        centre, has = B.moments(xy, part_at, ring_at, at)
        lon, lat = centre[:, 1], centre[:, 2]
        inside = has & (lat >= -80) & (lat <= 84) & (lon >= -180) & (lon <= 180)
        row = B.rows_of_vertices(part_at, ring_at, at)
        plane = np.column_stack(_project(xy, _zones(lon, lat)[row], np.where(lat < 0, 1e7, 0.0)[row]))
        kept = np.ones(len(xy), dtype=bool)
        for a, b in zip(at[:-1], at[1:]):
            if b > a and inside[row[a]]:
                kept[a:b] = kept_corners(plane[a:b], tolerance)
        left = B.starts(kept)[at]
        fine = _valid_rows(xy[kept], part_at, ring_at, left)
        kept |= ~fine[row]
        left = B.starts(kept)[at]
        rings = pa.StructArray.from_arrays([pa.array(c) for c in xy[kept].T], fields=list(vertex))
        for place in (left, ring_at):
            rings = pa.ListArray.from_arrays(pa.array(place, pa.int32()), rings)
        return pa.ListArray.from_arrays(pa.array(part_at, pa.int32()), rings, mask=pa.array(_nulls(values))).cast(kind)

    return _by_slices(made, 3, kind, R.GEOM_DDL)(geom)


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost; fewer than three if there is no area."""
    p = np.unique(points, axis=0).tolist()
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)

    def half(run: list) -> list:
        out: list = []
        for c in run:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(c)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def smallest_rectangle(points: np.ndarray) -> tuple[float, ...] | None:
    """``(area, w, h, x0, y0, ux, uy)``; one side lies on a hull edge.

    Turning with the edges, the farthest corners to the right, ahead and to the
    left are those where the hull's own edges pass a quarter, a half and three
    quarters of a turn.
    """
    hull = hull_points(points)
    if len(hull) < 3:
        return None
    step = np.roll(hull, -1, axis=0) - hull
    length = np.hypot(step[:, 0], step[:, 1])
    ux, uy = step[:, 0] / length, step[:, 1] / length
    angle = np.arctan2(step[:, 1], step[:, 0])
    turn = np.mod(angle - angle[0], 2 * np.pi)
    turn = np.maximum.accumulate(turn)
    twice = np.concatenate((turn, turn + 2 * np.pi))

    def extreme(quarter: int, value) -> np.ndarray:
        near = np.searchsorted(twice, turn + quarter * np.pi / 2)
        # rounding can miss a corner by one
        return np.stack([value(hull[(near + k) % len(hull)] - hull) for k in (-1, 0, 1)])

    along = lambda d: d[:, 0] * ux + d[:, 1] * uy
    across = lambda d: d[:, 1] * ux - d[:, 0] * uy
    u1, v1, u0 = extreme(1, along).max(axis=0), extreme(2, across).max(axis=0), extreme(3, along).min(axis=0)
    w = u1 - u0
    x0, y0 = hull[:, 0] + u0 * ux, hull[:, 1] + u0 * uy
    best = min(zip(w * v1, w, v1, x0, y0, ux, uy))
    return tuple(float(x) for x in best)
