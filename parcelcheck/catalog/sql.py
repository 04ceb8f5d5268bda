"""DuckDB side of the queries: shared CTEs over the same SELECTs."""

from __future__ import annotations

from parcelcheck.catalog import frames as X
from parcelcheck.functions import project as P

DIV = "//"


def scaled(expr: str, factor: int = 1000) -> str:
    """Half-up scaled integer, the form in which doubles are compared."""
    return f"cast(floor(({expr}) * {factor} + 0.5) AS BIGINT)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


def tokens(scale: int = 1) -> str:
    return f"""
    src AS ({X.shapes_sql(DIV, scale)}),
    tok AS (SELECT k, unnest(string_split(trace, ';')) AS t,
                   generate_subscripts(string_split(trace, ';'), 1) AS p
            FROM src WHERE trace IS NOT NULL)"""


def parsed(accuracy: int = 10, zero_valid: bool = True) -> str:
    zero = "" if zero_valid else "AND abs(acc) >= 1e-9"
    return f"""
    pt AS (SELECT k, p, try_cast(split_part(trim(t), ' ', 1) AS DOUBLE) AS y,
                  try_cast(split_part(trim(t), ' ', 2) AS DOUBLE) AS x,
                  try_cast(split_part(trim(t), ' ', 4) AS DOUBLE) AS acc FROM tok),
    chk AS (SELECT k, p, x, y,
                   coalesce(acc <= {accuracy} {zero} AND x IS NOT NULL AND y IS NOT NULL, false) AS ok FROM pt),
    cnt AS (SELECT k, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS skipped
            FROM chk GROUP BY k),
    raw AS (SELECT c.k, row_number() OVER (PARTITION BY c.k ORDER BY c.p) AS i, c.x, c.y, cnt.kept AS n
            FROM chk c JOIN cnt ON c.k = cnt.k
            WHERE c.ok AND cnt.kept >= 3 AND cnt.kept >= 4 * cnt.skipped)"""


# Bow-ties of four corners become their hull: corners by angle round the mean.
REPAIRED = """
    quad AS (SELECT k, max(CASE WHEN i = 1 THEN x END) AS x1, max(CASE WHEN i = 1 THEN y END) AS y1,
                    max(CASE WHEN i = 2 THEN x END) AS x2, max(CASE WHEN i = 2 THEN y END) AS y2,
                    max(CASE WHEN i = 3 THEN x END) AS x3, max(CASE WHEN i = 3 THEN y END) AS y3,
                    max(CASE WHEN i = 4 THEN x END) AS x4, max(CASE WHEN i = 4 THEN y END) AS y4,
                    avg(x) AS mx, avg(y) AS my
             FROM raw WHERE n = 4 GROUP BY k),
    turns AS (SELECT k, mx, my,
                sign((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1)) AS a123, sign((x2-x1)*(y4-y1)-(y2-y1)*(x4-x1)) AS a124,
                sign((x4-x3)*(y1-y3)-(y4-y3)*(x1-x3)) AS a341, sign((x4-x3)*(y2-y3)-(y4-y3)*(x2-x3)) AS a342,
                sign((x3-x2)*(y4-y2)-(y3-y2)*(x4-x2)) AS a234, sign((x3-x2)*(y1-y2)-(y3-y2)*(x1-x2)) AS a231,
                sign((x1-x4)*(y2-y4)-(y1-y4)*(x2-x4)) AS a412, sign((x1-x4)*(y3-y4)-(y1-y4)*(x3-x4)) AS a413
              FROM quad),
    bow AS (SELECT k, mx, my FROM turns
            WHERE (a123 * a124 < 0 AND a341 * a342 < 0) OR (a234 * a231 < 0 AND a412 * a413 < 0)),
    ring AS (SELECT r.k, r.n, r.x, r.y, bow.k IS NOT NULL AS was_bow,
                    row_number() OVER (PARTITION BY r.k ORDER BY
                      CASE WHEN bow.k IS NOT NULL THEN atan2(r.y - bow.my, r.x - bow.mx) ELSE r.i END) AS i
             FROM raw r LEFT JOIN bow ON r.k = bow.k)"""

UNREPAIRED = """
    ring AS (SELECT k, n, x, y, i, false AS was_bow FROM raw)"""


def project(lon: str, lat: str, zone: str) -> tuple[str, str, str]:
    """SQL steps of the transverse Mercator series: (first, second, final) select lists."""
    sin_lat = f"sin(radians({lat}))"
    first = (
        f"sinh(atanh({sin_lat}) - {P.ECC!r} * atanh({P.ECC!r} * {sin_lat})) AS tt, "
        f"radians({lon} - ({zone} * 6 - 183)) AS dl, {lat} < 0 AS south"
    )
    second = "atan2(tt, cos(dl)) AS xi, asinh(sin(dl) / sqrt(tt * tt + cos(dl) * cos(dl))) AS eta"
    north = "xi" + "".join(
        f" + {c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(P.SERIES, 1)
    )
    east = "eta" + "".join(
        f" + {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(P.SERIES, 1)
    )
    m = P.K0 * P.RECTIFYING
    final = (
        f"500000 + {m!r} * ({east}) AS e, CASE WHEN south THEN 1e7 ELSE 0 END + {m!r} * ({north}) AS nn"
    )
    return first, second, final


def utm(name: str = "up", source: str = "ring", zone: str | None = None) -> str:
    """Vertices in metres: own zone by the mean vertex, or one given zone."""
    own = zone or "cast((floor((avg(x) OVER (PARTITION BY k) + 180) / 6) % 60 + 1) AS INT)"
    a, b, c = project("x", "y", "zone")
    return f"""
    {name}_z AS (SELECT k, i, n, x, y, {own} AS zone FROM {source}),
    {name}_1 AS (SELECT k, i, n, {a} FROM {name}_z),
    {name}_2 AS (SELECT k, i, n, south, {b} FROM {name}_1),
    {name} AS (SELECT k, i, n, {c} FROM {name}_2)"""


def edges(name: str, source: str, x: str, y: str) -> str:
    """Directed edges with the origin of their ring."""
    over = "OVER (PARTITION BY k ORDER BY i)"
    first = "OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""
    {name} AS (SELECT k, i, n, {x} AS x1, {y} AS y1,
                  coalesce(lead({x}) {over}, first_value({x}) {first}) AS x2,
                  coalesce(lead({y}) {over}, first_value({y}) {first}) AS y2,
                  first_value({x}) {first} AS ox, first_value({y}) {first} AS oy FROM {source})"""


def areas(name: str, source: str) -> str:
    """Signed area and centroid per ring."""
    cr = "((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy))"
    return f"""
    {name} AS (SELECT k, any_value(n) AS n, sum({cr}) / 2 AS area,
                  any_value(ox) + sum(((x1-ox)+(x2-ox)) * {cr}) / (3 * sum({cr})) AS cx,
                  any_value(oy) + sum(((y1-oy)+(y2-oy)) * {cr}) / (3 * sum({cr})) AS cy
           FROM {source} GROUP BY k)"""


def rectangles(name: str, source: str, x: str, y: str) -> str:
    """Smallest rotated rectangle by trying every pair of vertices as a direction."""
    return f"""
    {name}_d AS (SELECT a.k, a.i AS i, b.i AS j, a.{x} AS ox, a.{y} AS oy,
                   (b.{x}-a.{x}) / sqrt((b.{x}-a.{x})**2+(b.{y}-a.{y})**2) AS ux,
                   (b.{y}-a.{y}) / sqrt((b.{x}-a.{x})**2+(b.{y}-a.{y})**2) AS uy
                 FROM {source} a JOIN {source} b ON a.k = b.k AND a.i < b.i),
    {name}_e AS (SELECT d.k, d.i, d.j, any_value(d.ux) AS ux, any_value(d.uy) AS uy,
                   any_value(d.ox) AS ox, any_value(d.oy) AS oy,
                   min((v.{x}-d.ox)*d.ux+(v.{y}-d.oy)*d.uy) AS u0, max((v.{x}-d.ox)*d.ux+(v.{y}-d.oy)*d.uy) AS u1,
                   min((v.{y}-d.oy)*d.ux-(v.{x}-d.ox)*d.uy) AS v0, max((v.{y}-d.oy)*d.ux-(v.{x}-d.ox)*d.uy) AS v1
                 FROM {name}_d d JOIN {source} v ON d.k = v.k GROUP BY d.k, d.i, d.j),
    {name} AS (SELECT k, min((u1-u0)*(v1-v0)) AS area, arg_min(u1-u0, (u1-u0)*(v1-v0)) AS w,
                 arg_min(v1-v0, (u1-u0)*(v1-v0)) AS h, arg_min({{'ux': ux, 'uy': uy, 'ox': ox, 'oy': oy,
                 'u0': u0, 'u1': u1, 'v0': v0, 'v1': v1}}, (u1-u0)*(v1-v0)) AS fr
               FROM {name}_e GROUP BY k)"""


def geodesic_areas(name: str, source: str) -> str:
    """Ellipsoidal ring areas from directed lon/lat edges."""

    def half_tan(lat: str) -> str:
        s = f"sin(radians({lat}))"
        q = f"({1 - P.E2!r} * ({s} / (1 - {P.E2!r} * {s} * {s}) + atanh({P.ECC!r} * {s}) / {P.ECC!r}))"
        return f"tan(asin({q} / {P.Q_POLE!r}) / 2)"

    return f"""
    {name}_t AS (SELECT k, radians(x2 - x1) AS dl, {half_tan("y1")} AS t1, {half_tan("y2")} AS t2 FROM {source}),
    {name} AS (SELECT k, abs(sum(2 * atan2(tan(dl / 2) * (t1 + t2), 1 + t1 * t2))) * {P.AUTHALIC_R2!r} AS area
               FROM {name}_t GROUP BY k)"""


def radius_test(name: str, source: str, centre: str, radius: float) -> str:
    import math

    half = math.pi / 64
    return f"""
    {name} AS (SELECT v.k, bool_and(sqrt((v.e-c.cx)**2+(v.nn-c.cy)**2)
                 * cos(fmod(atan2(v.nn-c.cy, v.e-c.cx) + {2 * math.pi!r}, {2 * half!r}) - {half!r})
                 <= {radius * math.cos(half)!r}) AS inside
               FROM {source} v JOIN {centre} c ON v.k = c.k GROUP BY v.k)"""


def base(scale: int = 1, repaired: bool = True, accuracy: int = 10, zero_valid: bool = True) -> list[str]:
    return [tokens(scale), parsed(accuracy, zero_valid), REPAIRED if repaired else UNREPAIRED]


def measured(scale: int = 1, radius: float = 40.0) -> list[str]:
    """Everything the first generation of rules needs."""
    return [
        *base(scale),
        utm(),
        edges("ue", "up", "e", "nn"),
        areas("ua", "ue"),
        rectangles("rc", "up", "e", "nn"),
        radius_test("rd", "up", "ua", radius),
        """
    m AS (SELECT s.k, ua.k IS NULL AS empty, coalesce(abs(ua.area), 0) AS area, rc.area / abs(ua.area) AS mrr,
                 greatest(rc.w, rc.h) / least(rc.w, rc.h) AS lw, coalesce(ua.n + 1, 0) AS nv,
                 coalesce(rd.inside, false) AS in_radius
          FROM src s LEFT JOIN ua ON s.k = ua.k LEFT JOIN rc ON s.k = rc.k LEFT JOIN rd ON s.k = rd.k)""",
    ]


def in_country() -> str:
    """Distance to the union of the two IND rectangles, measured at the first vertex."""
    w2 = f"(1 - {P.E2!r} * sin(radians(y0)) * sin(radians(y0)))"
    return f"""
    lay AS ({X.COUNTRIES_SQL}),
    box AS (SELECT min(w) / 10000 AS w, min(s) / 10000 AS s, max(e) / 10000 AS e, max(n) / 10000 AS n
            FROM lay WHERE iso3 = 'IND'),
    ext AS (SELECT k, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax,
                   max(CASE WHEN i = 1 THEN y END) AS y0 FROM ring GROUP BY k),
    ctry AS (SELECT ext.k,
               radians(greatest(0, xmin - box.e, box.w - xmax)) * {P.A!r} / sqrt({w2}) * cos(radians(y0)) <= 10000
               AND ymin <= box.n AND ymax >= box.s AS hit
             FROM ext, box)"""


def overlaps(limit: float, erode: float, zone_source: str = "ring", eligible: str = "elig", geodesic: bool = False) -> list[str]:
    """Brute-force overlap of eroded convex rings of the eligible keys.

    Expects ``ring`` and a CTE ``elig(k)``.
    """
    zone = (
        f"(SELECT cast((floor(((min(x) + max(x)) / 2 + 180) / 6) % 60 + 1) AS INT) FROM {zone_source})"
    )
    r = abs(erode)
    shrink = (
        f"""
    dir AS (SELECT k, i, n, x1, y1, (x2-x1)/sqrt((x2-x1)**2+(y2-y1)**2) AS dx,
                   (y2-y1)/sqrt((x2-x1)**2+(y2-y1)**2) AS dy FROM te),
    cor AS (SELECT k, i, n, x1, y1, dx, dy,
                   coalesce(lag(dx) OVER (PARTITION BY k ORDER BY i), last_value(dx) OVER (PARTITION BY k ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px,
                   coalesce(lag(dy) OVER (PARTITION BY k ORDER BY i), last_value(dy) OVER (PARTITION BY k ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS py FROM dir),
    shr AS (SELECT k, i, n, x1 + {r} * (-dy - py) / (1 + dx*px + dy*py) AS e,
                   y1 + {r} * (dx + px) / (1 + dx*px + dy*py) AS nn FROM cor)"""
        if erode
        else """
    shr AS (SELECT k, i, n, x1 AS e, y1 AS nn FROM te)"""
    )
    return [
        f"er AS (SELECT r.* FROM ring r JOIN {eligible} el ON r.k = el.k)",
        utm("tp", "er", zone),
        edges("te", "tp", "e", "nn"),
        shrink,
        edges("se", "shr", "e", "nn"),
        areas("sa", "se"),
        """
    bx AS (SELECT k, min(e) AS x0, max(e) AS x1, min(nn) AS y0, max(nn) AS y1 FROM shr GROUP BY k),
    cand AS (SELECT a.k AS ka, b.k AS kb, least(a.x0, b.x0) AS ox, least(a.y0, b.y0) AS oy
             FROM bx a JOIN bx b ON a.k < b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1
               AND a.y0 <= b.y1 AND b.y0 <= a.y1),
    ln AS (SELECT k, least(x1, x2) AS a, greatest(x1, x2) AS b, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS y,
                  (y2 - y1) / (x2 - x1) AS sl, CASE WHEN x2 < x1 THEN 1 ELSE -1 END AS s
           FROM se WHERE x1 <> x2),
    pr AS (SELECT c.ka, c.kb, p.s * q.s AS s, greatest(p.a, q.a) AS lo, least(p.b, q.b) AS hi,
                  p.y - c.oy AS py, p.sl AS psl, p.a AS pa, q.y - c.oy AS qy, q.sl AS qsl, q.a AS qa
           FROM cand c JOIN ln p ON p.k = c.ka JOIN ln q ON q.k = c.kb
           WHERE least(p.b, q.b) > greatest(p.a, q.a)),
    hgt AS (SELECT ka, kb, s, hi - lo AS w, py + psl * (lo - pa) AS p0, py + psl * (hi - pa) AS p1,
                  qy + qsl * (lo - qa) AS q0, qy + qsl * (hi - qa) AS q1 FROM pr),
    itg AS (SELECT ka, kb, sum(s * w * CASE
                 WHEN p0 <= q0 AND p1 <= q1 THEN (p0 + p1) / 2
                 WHEN p0 >= q0 AND p1 >= q1 THEN (q0 + q1) / 2
                 ELSE (q0 + q1) / 2 - least(p0 - q0, p1 - q1)**2 / (2 * abs((p0 - q0) - (p1 - q1))) END) AS a
            FROM hgt GROUP BY ka, kb)""",
        f"""
    rat AS (SELECT ka, kb, itg.a / least(abs(sx.area), abs(sy.area)) AS ratio
            FROM itg JOIN sa sx ON sx.k = ka JOIN sa sy ON sy.k = kb),
    dirp AS (SELECT ka AS k, kb AS other, ratio FROM rat WHERE ratio > {limit}
             UNION ALL SELECT kb, ka, ratio FROM rat WHERE ratio > {limit}),
    ovl AS (SELECT k, string_agg(cast(other AS VARCHAR), ';' ORDER BY cast(other AS VARCHAR)) AS overlap_ids,
                   max(ratio) AS ratio FROM dirp GROUP BY k)""",
    ]
