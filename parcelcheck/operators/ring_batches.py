"""Rings of a whole Arrow batch at once, in NumPy.

Shapes arrive as nested lists. Their vertices are taken as flat arrays, without
a Python object for each, and a batch is worked through in slices of bounded
size. Rings of the same number of corners make one array each.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers need these few functions only, not the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vertices of a slice, and pairs of edges compared at once, about.
SLICE_VERTICES = 1 << 16
PAIRS = 1 << 18


def coordinates(vertices: pa.Array) -> np.ndarray:
    """``(n, 2)`` array of a struct array of vertices."""
    x, y = vertices.flatten()
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in (x, y)]).reshape(-1, 2).astype(float, copy=False)


def lengths(lists: pa.Array) -> np.ndarray:
    """Length of every list, 0 for NULL."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(counts: np.ndarray) -> np.ndarray:
    """First position of every list, and the end of the last."""
    return np.concatenate(([0], np.cumsum(counts)))


def slices(values: pa.Array, depth: int):
    """The batch in slices of about ``SLICE_VERTICES`` vertices, one row at least."""
    counts = lengths(values)
    inner, ends = values, np.cumsum(counts)
    for _ in range(depth - 1):
        inner = inner.flatten()
        ends = starts(lengths(inner))[starts(counts)][1:]
        counts = np.diff(ends, prepend=0)
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_VERTICES, side="right")))
        yield values.slice(at, stop - at)
        at = stop


def shapes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices and the first part of each row, ring of each part, vertex of each ring."""
    parts = values.flatten()
    rings = parts.flatten()
    return (
        coordinates(rings.flatten()),
        starts(lengths(values)),
        starts(lengths(parts)),
        starts(lengths(rings)),
    )


def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal vertices; NaN equals NaN."""
    return ((a == b) | (np.isnan(a) & np.isnan(b))).all(axis=-1)


def _side(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sign((e[..., 2] - e[..., 0]) * (y - e[..., 1]) - (e[..., 3] - e[..., 1]) * (x - e[..., 0]))


def touch(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Do two closed edges share a point?"""

    def within(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.minimum(g[..., :2], g[..., 2:]), np.maximum(g[..., :2], g[..., 2:])
        return (x >= low[..., 0]) & (x <= high[..., 0]) & (y >= low[..., 1]) & (y <= high[..., 1])

    a, b = _side(e, f[..., 0], f[..., 1]), _side(e, f[..., 2], f[..., 3])
    c, d = _side(f, e[..., 0], e[..., 1]), _side(f, e[..., 2], e[..., 3])
    out = (a * b < 0) & (c * d < 0)
    for zero, g, h, k in ((a, e, f, 0), (b, e, f, 2), (c, f, e, 0), (d, f, e, 2)):
        on = zero == 0
        if on.any():
            out[on] |= within(g[on], h[on][:, k], h[on][:, k + 1])
    return out


def simple_rings(xy: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each ring: closed, four coordinates or more, no crossing, touch or spike."""
    n = np.diff(first)
    fine = n >= 4
    fine[fine] = same(xy[first[:-1][fine]], xy[first[1:][fine] - 1])
    owner = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(xy), dtype=bool)
    keep[1:] = ~(same(xy[1:], xy[:-1]) & (owner[1:] == owner[:-1]))
    corners = np.bincount(owner[keep], minlength=len(n))
    at = starts(corners)
    kept = xy[keep]
    fine &= corners >= 4
    for m in np.unique(corners[fine]):
        rows = np.flatnonzero(fine & (corners == m))
        i, j = np.triu_indices(m - 1, 2)
        apart = (i > 0) | (j < m - 2)
        i, j = i[apart], j[apart]
        step = max(1, PAIRS // max(1, len(i)))
        for begin in range(0, len(rows), step):
            some = rows[begin : begin + step]
            v = kept[at[some][:, None] + np.arange(m)]
            e = np.concatenate((v[:, :-1], v[:, 1:]), axis=2)
            f = np.roll(e, -1, axis=1)
            dot = (e[..., 2] - e[..., 0]) * (f[..., 2] - f[..., 0]) + (e[..., 3] - e[..., 1]) * (f[..., 3] - f[..., 1])
            spike = ((dot < 0) & (_side(e, f[..., 2], f[..., 3]) == 0)).any(axis=1)
            fine[some] = ~spike & ~touch(e[:, i], e[:, j]).any(axis=1)
    return fine


def _half_hulls(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left-turning chains through sorted points of every row: positions and their number."""
    rows, n = p.shape[:2]
    chain = np.zeros((rows, n), dtype=np.int64)
    top = np.zeros(rows, dtype=np.int64)
    every = np.arange(rows)
    for k in range(n):
        left = every
        while True:
            left = left[top[left] > 1]
            if not len(left):
                break
            a, b, c = p[left, chain[left, top[left] - 2]], p[left, chain[left, top[left] - 1]], p[left, k]
            turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
            left = left[~(turn > 0)]
            top[left] -= 1
        chain[every, top] = k
        top += 1
    return chain, top


def _frames(p: np.ndarray) -> np.ndarray:
    """Smallest rectangle of every row of sorted distinct points: area, w, h, x0, y0, ux, uy."""
    rows, n = p.shape[:2]
    low, n_low = _half_hulls(p)
    up, n_up = _half_hulls(p[:, ::-1])
    up = n - 1 - up
    total = n_low + n_up - 1  # closed: the last corner is the first
    width = int(total.max())
    place = np.arange(width)
    from_up = np.clip(place - n_low[:, None] + 1, 0, n - 1)
    corner = np.where(
        place < n_low[:, None],
        np.take_along_axis(low, np.minimum(place, n - 1)[None, :].repeat(rows, 0), 1),
        np.take_along_axis(up, from_up, 1),
    )
    there = place < total[:, None]
    hull = np.take_along_axis(p, np.where(there, corner, corner[:, :1])[:, :, None], 1)
    step = np.diff(hull, axis=1)
    edge = there[:, 1:]
    norm = np.where(edge, np.sqrt(step[..., 0] * step[..., 0] + step[..., 1] * step[..., 1]), 1.0)
    ux, uy = step[..., 0] / norm, step[..., 1] / norm
    start = hull[:, :-1]
    dx = hull[:, None, :, 0] - start[:, :, None, 0]
    dy = hull[:, None, :, 1] - start[:, :, None, 1]
    u = dx * ux[:, :, None] + dy * uy[:, :, None]
    v = dy * ux[:, :, None] - dx * uy[:, :, None]
    u0, u1, v1 = u.min(axis=2), u.max(axis=2), v.max(axis=2)
    w = u1 - u0
    made = np.stack([w * v1, w, v1, start[..., 0] + u0 * ux, start[..., 1] + u0 * uy, ux, uy], axis=2)
    owner = np.repeat(np.arange(rows), edge.sum(axis=1))
    flat = made[edge]
    order = np.lexsort((*flat.T[::-1], owner))
    best = order[np.searchsorted(owner[order], np.arange(rows))]
    return flat[best]


def smallest_rectangles(xy: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectangles of lists of points, and which lists have one (three distinct points)."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((xy[:, 1], xy[:, 0], owner))
    p, owner = xy[order], owner[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | ~same(p[1:], p[:-1])
    p, owner = p[new], owner[new]
    distinct = np.bincount(owner, minlength=len(n))
    at = starts(distinct)
    out = np.zeros((len(n), 7))
    for m in np.unique(distinct[distinct > 2]):
        rows = np.flatnonzero(distinct == m)
        size = max(1, PAIRS // int(m * m))
        for begin in range(0, len(rows), size):
            some = rows[begin : begin + size]
            out[some] = _frames(p[at[some][:, None] + np.arange(m)])
    return out, distinct > 2


def _ring_areas(xy: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shoelace area of every ring about its first vertex; sums run in the order of the edges."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    ring = owner[inner]
    o = xy[at[ring]]
    a, b = xy[inner] - o, xy[inner + 1] - o
    terms = np.column_stack((a[:, 0] * b[:, 1], -(b[:, 0] * a[:, 1]))).ravel()
    return np.bincount(np.repeat(ring, 2), terms, minlength=len(n)) / 2


def areas(xy: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Area of every shape: twice the shell less all rings, part by part."""
    return signed_parts(np.abs(_ring_areas(xy, at)), part_at, ring_at)


def signed_parts(ring: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray) -> np.ndarray:
    """Shells less holes for every shape, from the areas of all rings."""
    rings = np.diff(ring_at)
    parts = np.repeat(np.arange(len(rings)), rings)
    total = np.bincount(parts, ring, minlength=len(rings))
    shell = np.zeros(len(rings))
    shell[rings > 0] = ring[ring_at[:-1][rings > 0]]
    # a part without a ring has no area
    shell[rings == 0] = np.nan
    row = np.repeat(np.arange(len(part_at) - 1), np.diff(part_at))
    return np.bincount(np.repeat(row, 2), np.column_stack((2 * shell, -total)).ravel(), minlength=len(part_at) - 1)


def first_parts(
    xy: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same shapes with their first part alone."""
    parts = np.diff(part_at)
    if not (parts > 1).any():
        return xy, part_at, ring_at, at
    part = np.zeros(len(ring_at) - 1, dtype=bool)
    part[part_at[:-1][parts > 0]] = True
    ring = np.repeat(part, np.diff(ring_at))
    return (
        xy[np.repeat(ring, np.diff(at))],
        starts(np.minimum(parts, 1)),
        starts(np.diff(ring_at)[part]),
        starts(np.diff(at)[ring]),
    )


def moments(xy: np.ndarray, part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area and area-weighted centre of every shape, and which shapes have an edge."""
    n = np.diff(at)
    ring = np.repeat(np.arange(len(n)), n)
    shell = np.zeros(len(n), dtype=bool)
    shell[ring_at[:-1][np.diff(ring_at) > 0]] = True
    back = (_ring_areas(xy, at) < 0) == shell
    place = np.arange(len(xy))
    way = xy[np.where(back[ring], at[ring] + at[ring + 1] - 1 - place, place)]
    inner = np.flatnonzero(ring[1:] == ring[:-1])
    rows = len(part_at) - 1
    row_of_part = np.repeat(np.arange(rows), np.diff(part_at))
    row = row_of_part[np.repeat(np.arange(len(ring_at) - 1), np.diff(ring_at))[ring[inner]]]
    count = np.bincount(row, minlength=rows)
    has = count > 0
    o = np.zeros((rows, 2))
    o[has] = way[inner[np.searchsorted(row, np.flatnonzero(has))]]
    a, b = way[inner] - o[row], way[inner + 1] - o[row]
    cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    total = lambda v: np.bincount(row, v, minlength=rows)
    s = total(cross)
    out = [s / 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        for axis in (0, 1):
            flat, full = total(a[:, axis]) / count, total((a[:, axis] + b[:, axis]) * cross) / (3 * s)
            out.append(o[:, axis] + np.where(s == 0, flat, full))
    return np.column_stack(out), has


def rows_of_vertices(part_at: np.ndarray, ring_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(part_at) - 1), np.diff(at[ring_at[part_at]]))


def oriented(xy: np.ndarray, ring_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The vertices with shells counter-clockwise and holes clockwise."""
    shell = np.zeros(len(at) - 1, dtype=bool)
    shell[ring_at[:-1][np.diff(ring_at) > 0]] = True
    back = (_ring_areas(xy, at) < 0) == shell
    ring = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return xy[np.where(back[ring], at[ring] + at[ring + 1] - 1 - np.arange(len(xy)), np.arange(len(xy)))]


def convex_rings(v: np.ndarray) -> np.ndarray:
    """Which closed counter-clockwise rings of the same length turn right nowhere."""
    n = v.shape[1] - 1
    if n < 1:
        return np.ones(len(v), dtype=bool)
    a, b, c = v[:, :-1], v[:, 1:], v[:, np.append(np.arange(2, n + 1), 1)]
    turn = (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    return ~(turn < 0).any(axis=1)


def shrunk_rings(v: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Closed convex rings with every side moved inwards: open rings and their numbers of corners."""
    rows, n = v.shape[0], max(v.shape[1] - 1, 0)
    open_ring, count = v[:, :n], np.full(rows, n)
    for k in range(n):
        if not open_ring.shape[1]:
            break
        x1, y1 = v[:, k, :1], v[:, k, 1:]
        dx, dy = v[:, k + 1, :1] - x1, v[:, k + 1, 1:] - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            d = (dx * (open_ring[..., 1] - y1) - dy * (open_ring[..., 0] - x1)) / np.sqrt(dx * dx + dy * dy) - metres
        place = np.arange(open_ring.shape[1])
        there = place < count[:, None]
        after = np.where(place + 1 < count[:, None], place + 1, 0)
        e, q = np.take_along_axis(d, after, 1), np.take_along_axis(open_ring, after[..., None], 1)
        own, hit = there & ~(d < 0), there & ((d < 0) != (e < 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = open_ring + (d / (d - e))[..., None] * (q - open_ring)
        # each corner gives itself, the cut behind it, both or neither
        both = np.stack((own, hit), axis=2).reshape(rows, 2 * len(place))
        points = np.stack((open_ring, cut), axis=2).reshape(rows, 2 * len(place), 2)
        count = both.sum(axis=1)
        open_ring = np.zeros((rows, int(count.max(initial=0)), 2))
        row, at = np.nonzero(both)
        open_ring[row, (np.cumsum(both, axis=1) - 1)[row, at]] = points[row, at]
    return open_ring, count
