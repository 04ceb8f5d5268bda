"""Queries on traces, polygons, spatial joins and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelcheck import params as C
from parcelcheck.catalog import frames as X
from parcelcheck.catalog import sql as Q
from parcelcheck.catalog.registry import query, scaled
from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.functions.text import to_geojson
from parcelcheck.functions.trace import parse_trace
from parcelcheck.operators import long_rings as L
from parcelcheck.operators import lookup as J
from parcelcheck.operators import measure as M
from parcelcheck.operators import outline as O
from parcelcheck.operators import overlap as V
from parcelcheck.operators import repair as E
from parcelcheck.plans import layers, reports, rules
from parcelcheck.session import spread, stage


def repaired(spark: SparkSession, sf: str, scale: int = 1, generation: int = 1) -> DataFrame:
    strict = generation == 2
    return E.repair(X.shapes(spark, sf, scale, zero_valid=not strict), generation=generation)


def measured(spark: SparkSession, sf: str, spec: C.LayerSpec = C.SUBPLOTS_V1, scale: int = 1) -> DataFrame:
    return M.measure(repaired(spark, sf, scale, spec.generation), spec)


# --- traces ---------------------------------------------------------------

P1_SQL = (
    Q.ctes(Q.tokens(), Q.parsed())
    + """
SELECT k, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS skipped,
       cast(coalesce(sum(round(x * 1e6)) FILTER (WHERE ok), 0) AS BIGINT) AS x_sum,
       cast(coalesce(sum(round(y * 1e6)) FILTER (WHERE ok), 0) AS BIGINT) AS y_sum
FROM chk GROUP BY k"""
)


@query("p1_trace_parse", P1_SQL)
def p1(spark, sf):
    t = F.col("t")
    total = lambda axis: F.aggregate(
        t["kept"], F.lit(0).cast("long"), lambda a, v: a + F.round(v[axis] * 1e6).cast("long")
    )
    rows = R.settle(
        X.traces(spark, sf).where(F.col("trace").isNotNull()).select("k", "trace"),
        t=parse_trace(F.col("trace")),
    )
    return rows.select(
        "k",
        F.size(t["kept"]).cast("long").alias("kept"),
        t["skipped"].cast("long").alias("skipped"),
        total("x").alias("x_sum"),
        total("y").alias("y_sum"),
    )


@query(
    "p1_trace_parse_strict",
    Q.ctes(Q.tokens(), Q.parsed(zero_valid=False))
    + "SELECT k, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS skipped FROM chk GROUP BY k",
)
def p1_strict(spark, sf):
    t = F.col("t")
    rows = X.traces(spark, sf).where(F.col("trace").isNotNull()).select("k", "trace")
    return R.settle(rows, t=parse_trace(F.col("trace"), accuracy_zero_valid=False)).select(
        "k", F.size(t["kept"]).cast("long").alias("kept"), t["skipped"].cast("long").alias("skipped")
    )


@query(
    "p2_trace_reject",
    Q.ctes(Q.tokens(), Q.parsed())
    + """
SELECT s.k, coalesce(any_value(r.n) + 1, 0) AS coordinates, count(r.k) = 0 AS empty
FROM src s LEFT JOIN raw r ON s.k = r.k GROUP BY s.k""",
)
def p2(spark, sf):
    g = F.col("geom")
    return X.shapes(spark, sf).select(
        "k", R.coordinate_count(g).cast("long").alias("coordinates"), R.is_empty(g).alias("empty")
    )


# --- repair ---------------------------------------------------------------


@query(
    "g1_validity",
    Q.ctes(*Q.base())
    + """
SELECT s.k, CASE WHEN any_value(r.k) IS NULL THEN 'empty' WHEN bool_or(r.was_bow) THEN 'invalid' ELSE 'valid' END AS state
FROM src s LEFT JOIN ring r ON s.k = r.k GROUP BY s.k""",
)
def g1(spark, sf):
    return X.shapes(spark, sf).select("k", E.state(F.col("geom")).alias("state"))


LONG_EDGES = f"""WITH pt AS MATERIALIZED ({X.long_rings_sql('//')}),
ed AS MATERIALIZED (SELECT k, ring, i, n, x AS x1, y AS y1, lead(x, 1, fx) OVER w AS x2, lead(y, 1, fy) OVER w AS y2 FROM
  (SELECT *, first_value(x) OVER w0 AS fx, first_value(y) OVER w0 AS fy FROM pt WINDOW w0 AS (PARTITION BY k, ring ORDER BY i)) p
  WINDOW w AS (PARTITION BY k, ring ORDER BY i))
"""
# differences of nano-degrees are exact in 64 bits
_LONG_SIDE = "sign(({0}.x2 - {0}.x1) * ({1}.y{2} - {0}.y1) - ({0}.y2 - {0}.y1) * ({1}.x{2} - {0}.x1))"
_LONG_CROSS = " AND ".join(
    f"{_LONG_SIDE.format(a, b, 1)} * {_LONG_SIDE.format(a, b, 2)} < 0" for a, b in (("a", "b"), ("b", "a"))
)


@query(
    "g1_long_rings",
    LONG_EDGES
    + f"""SELECT k, CASE WHEN k IN (SELECT a.k FROM ed a JOIN ed b ON a.k = b.k AND (a.ring < b.ring OR (a.ring = b.ring AND a.i < b.i))
   WHERE least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
     AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) AND {_LONG_CROSS})
 THEN 'invalid' ELSE 'valid' END AS state FROM (SELECT DISTINCT k FROM pt) s""",
)
def g1_long(spark, sf):
    """Rings of 200 and 900 vertices with holes and parts, crossed or not."""
    return X.long_rings(spark, sf).select("k", E.state(F.col("geom")).alias("state"))


@query(
    "g13_long_rings",
    LONG_EDGES
    + f"""SELECT k, {Q.scaled('min((u1 - u0) * v1)', 1)} AS area FROM (
  SELECT e.k, e.i, max(u) AS u1, min(u) AS u0, max(v) AS v1 FROM (
    SELECT a.k, a.i, ((p.x - a.x1) * a.dx + (p.y - a.y1) * a.dy) / a.l AS u, ((p.y - a.y1) * a.dx - (p.x - a.x1) * a.dy) / a.l AS v
    FROM (SELECT *, sqrt(dx * dx + dy * dy) AS l FROM (SELECT p.k, p.i, p.x * 1e-3 AS x1, p.y * 1e-3 AS y1, (q.x - p.x) * 1e-3 AS dx, (q.y - p.y) * 1e-3 AS dy
      FROM pt p JOIN pt q ON p.k = q.k AND p.ring = 0 AND q.ring = 0 AND p.i % 2 = 0 AND q.i = (p.i + 2) % p.n) d) a
    JOIN (SELECT k, x * 1e-3 AS x, y * 1e-3 AS y FROM pt WHERE ring = 0 AND i % 2 = 0) p ON a.k = p.k) e GROUP BY e.k, e.i) b GROUP BY k""",
)
def g13_long(spark, sf):
    """Rectangles of the shells, in square micro-degrees."""
    shell = F.col("geom")[0][0]
    rows = R.settle(X.long_rings(spark, sf), rect=L.min_rectangle(shell))
    return rows.select("k", scaled(F.col("rect.area") * 1e12, 1).alias("area"))


@query(
    "g2_duplicate_vertices",
    Q.ctes(Q.tokens(), Q.parsed())
    + """
SELECT s.k, CASE WHEN s.k % 3 = 0 AND count(r.k) > 0 THEN count(r.k) + 2 WHEN count(r.k) > 0 THEN count(r.k) + 1 ELSE 0 END AS shipped,
       CASE WHEN count(r.k) > 0 THEN count(r.k) + 1 ELSE 0 END AS repaired
FROM src s LEFT JOIN raw r ON s.k = r.k GROUP BY s.k""",
)
def g2(spark, sf):
    # Every third trace repeats its first vertex.
    double = lambda ring: F.concat(F.slice(ring, 1, 1), ring)
    g = F.when(
        F.col("k") % 3 == 0,
        F.transform(F.col("geom"), lambda p: F.transform(p, double)),
    ).otherwise(F.col("geom"))
    rows = R.settle(X.shapes(spark, sf), geom=g)
    count = lambda c: R.coordinate_count(c).cast("long")
    return rows.select(
        "k",
        count(E.remove_duplicate_vertices(F.col("geom"))).alias("shipped"),
        count(E.remove_duplicate_vertices(F.col("geom"), enabled=True)).alias("repaired"),
    )


@query(
    "g3_bowtie_hull",
    Q.ctes(*Q.base(), Q.edges("le", "ring", "x", "y"), Q.areas("la", "le"))
    + f"SELECT k, {Q.scaled('abs(area) * 1e9', 100)} AS hull_area, n + 1 AS coordinates FROM la WHERE k IN (SELECT k FROM bow)",
)
def g3(spark, sf):
    g = F.col("geom")
    bad = X.shapes(spark, sf).where((E.state(g) == "invalid") & E.is_square_candidate(g))
    hull = R.settle(bad, hull=E.hull_geom(g))
    return hull.select(
        "k",
        scaled(R.area(F.col("hull")) * 1e9, 100).alias("hull_area"),
        R.coordinate_count(F.col("hull")).cast("long").alias("coordinates"),
    )


@query(
    "g4_orientation",
    Q.ctes(*Q.base(repaired=False), Q.edges("le", "ring", "x", "y"), Q.areas("la", "le"))
    + f"""SELECT k, {Q.scaled('abs(area) * 1e9', 100)} AS oriented, -{Q.scaled('abs(area) * 1e9', 100)} AS rewound
FROM la WHERE abs(area) > 1e-12""",
)
def g4(spark, sf):
    g = F.col("geom")
    first = lambda c: R.signed_area(F.get(F.get(c, F.lit(0)), F.lit(0)))
    rows = X.shapes(spark, sf).where((F.size(g) > 0) & (R.area(g) > 1e-12))
    return rows.select(
        "k",
        scaled(first(R.orient(g)) * 1e9, 100).alias("oriented"),
        (-scaled(-first(R.rewind(g)) * 1e9, 100)).alias("rewound"),
    )


# A square with a tiny loop of reversed winding on its east side: the
# zero-width buffer drops the loop and changes the area by less than 0.5 %.
# Keys not divisible by 4 get a large loop instead and are refused.
LOOPED = """
    SELECT k, 72.5 + 0.001e0 * (k % 2500) AS x0, 5.0 + 0.001e0 * (k {div} 2500) AS y0,
           CASE WHEN k % 4 = 0 THEN 0.000004e0 ELSE 0.0001e0 END AS d
    FROM (SELECT o_orderkey AS k FROM orders) s"""


@query(
    "g5_zero_buffer",
    f"""WITH f AS ({LOOPED.format(div='//')})
SELECT k, k % 4 = 0 AS accepted,
  {Q.scaled('CASE WHEN k % 4 = 0 THEN (0.0004e0*0.0004e0 + d*d/4) * 1e11 ELSE 0 END', 10)} AS area
FROM f""",
)
def g5(spark, sf):
    rows = X._views(spark, sf, LOOPED.format(div="div"), ("orders",))
    x0, y0, d = F.col("x0"), F.col("y0"), F.col("d")
    s = 0.0004
    # East side goes up, crosses over itself and comes back above the start.
    corner = lambda dx, dy: R.vertex(x0 + dx, y0 + dy)
    ring = F.array(
        corner(F.lit(0.0), F.lit(0.0)),
        corner(F.lit(s), F.lit(0.0)),
        corner(F.lit(s), F.lit(s / 2)),
        corner(s + d, s / 2 + d),
        corner(s + d, F.lit(s / 2)),
        corner(F.lit(s), s / 2 + d),
        corner(F.lit(s), F.lit(s)),
        corner(F.lit(0.0), F.lit(s)),
        corner(F.lit(0.0), F.lit(0.0)),
    )
    shapes = R.settle(spread(rows), geom=R.polygon(ring))
    g = F.col("geom")
    zero = R.settle(shapes, bad=E.state(g) == "invalid").withColumn("zero", O.zero_buffer(g, F.col("bad")))
    taken = R.settle(zero, accepted=E.accepts_zero_buffer(g, F.col("zero")))
    return taken.select(
        "k",
        "accepted",
        scaled(F.when(F.col("accepted"), R.area(F.col("zero"))).otherwise(0.0) * 1e11, 10).alias("area"),
    )


@query(
    "g6_simplify",
    Q.ctes(Q.tokens(), Q.parsed())
    + "SELECT s.k, CASE WHEN count(r.k) > 0 THEN count(r.k) + 1 ELSE 0 END AS coordinates FROM src s LEFT JOIN raw r ON s.k = r.k GROUP BY s.k",
)
def g6(spark, sf):
    """As shipped: off, every vertex stays."""
    rows = E.simplify_geometry(X.shapes(spark, sf))
    return rows.select("k", R.coordinate_count(F.col("geom")).cast("long").alias("coordinates"))


#: Metres; a dent of the fixture is 22 to 35 metres deep.
G6_TOLERANCE = 26.0
_G6_POINTS = """pts AS (SELECT k, i, e, nn FROM up UNION ALL SELECT k, n AS i, e, nn FROM up WHERE i = 0)"""
_G6_ALONG = "greatest(0, least(1, ((p.e - a.e) * (b.e - a.e) + (p.nn - a.nn) * (b.nn - a.nn)) / nullif((b.e - a.e)**2 + (b.nn - a.nn)**2, 0)))"
_G6_OFF = f"sqrt((p.e - a.e - coalesce({_G6_ALONG}, 0) * (b.e - a.e))**2 + (p.nn - a.nn - coalesce({_G6_ALONG}, 0) * (b.nn - a.nn))**2)"


@query(
    "g6_simplify_option",
    Q.ctes(
        f"lr AS MATERIALIZED ({X.long_rings_sql('//')})",
        "ring AS (SELECT k, i, n, x / 1e9 AS x, y / 1e9 AS y FROM lr WHERE ring = 0)",
        Q.edges("le", "ring", "x", "y"),
        Q.areas("la", "le"),
        "zones AS (SELECT k, cast((floor((cx + 180) / 6) % 60 + 1) AS INT) AS z FROM la)",
        Q.utm("up", "ring", "(SELECT z FROM zones WHERE zones.k = ring.k)"),
        _G6_POINTS.replace("pts AS (", "pts AS MATERIALIZED ("),
        f"""cuts AS (SELECT DISTINCT k, 0 AS low, n AS high, 0 AS depth FROM up
      UNION ALL
      SELECT k, CASE WHEN half = 0 THEN low ELSE far END, CASE WHEN half = 0 THEN far ELSE high END, depth + 1 FROM (
        SELECT c.k, c.low, c.high, c.depth, arg_max(p.i, {{'d': {_G6_OFF}, 'i': -p.i}}) AS far, max({_G6_OFF}) AS d
        FROM cuts c JOIN pts p ON p.k = c.k AND p.i > c.low AND p.i < c.high
        JOIN pts a ON a.k = c.k AND a.i = c.low JOIN pts b ON b.k = c.k AND b.i = c.high GROUP BY c.k, c.low, c.high, c.depth) s,
        (SELECT unnest([0, 1]) AS half) h WHERE d > {G6_TOLERANCE})""",
        """kp AS (SELECT c.k, c.i, coalesce(lead(c.i) OVER (PARTITION BY c.k ORDER BY c.i), m.n) % m.n AS j
      FROM (SELECT DISTINCT k, low AS i FROM cuts) c JOIN (SELECT DISTINCT k, n FROM lr) m ON c.k = m.k)""",
        """sg AS MATERIALIZED (SELECT kp.k, kp.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM kp
      JOIN lr a ON a.k = kp.k AND a.ring = 0 AND a.i = kp.i JOIN lr b ON b.k = kp.k AND b.ring = 0 AND b.i = kp.j)""",
        f"bad AS (SELECT DISTINCT a.k FROM sg a JOIN sg b ON a.k = b.k AND a.i < b.i WHERE {_LONG_CROSS})",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    # a shell that is crossed afterwards stays whole
    + "SELECT k, CASE WHEN k IN (SELECT k FROM bad) THEN max(high) + 1 ELSE count(DISTINCT low) + 1 END AS coordinates FROM cuts GROUP BY k",
)
def g6_option(spark, sf):
    """With a tolerance: shells of 200 and 900 vertices lose the dents within it."""
    rows = X.long_rings(spark, sf).select("k", F.array(F.array(F.col("geom")[0][0])).alias("geom"))
    out = E.simplify_geometry(rows, G6_TOLERANCE)
    return out.select("k", R.coordinate_count(F.col("geom")).cast("long").alias("coordinates"))


@query(
    "g7_normalise_parts",
    f"""
SELECT k, CASE WHEN greatest(big, 100) > 0.9 * (big + 100) THEN 1 ELSE 2 END AS parts FROM (
  SELECT o_orderkey AS k, (1 + o_orderkey % 40) * (1 + o_orderkey % 40) AS big FROM orders) s""",
)
def g7(spark, sf):
    # Two squares of sides 1..40 and 10 units, and a degenerate third part.
    k = F.col("o_orderkey")
    side = (1 + k % 40).cast("double")

    def square(x: float, a) -> object:
        v = lambda dx, dy: R.vertex(F.lit(x) + dx * a, dy * a)
        return F.array(F.array(v(0, 0), v(1, 0), v(1, 1), v(0, 1), v(0, 0)))

    line = F.array(F.array(*[R.vertex(F.lit(float(i)), F.lit(90.0)) for i in (0, 1, 2, 0)]))
    rows = X.table(spark, sf, "orders").select(k.alias("k"), F.array(square(0.0, side), square(100.0, F.lit(10.0)), line).alias("geom"))
    parts = R.settle(rows, geom=R.largest_part(R.to_area_parts(F.col("geom"))))
    return parts.select("k", F.size("geom").cast("int").alias("parts"))


@query(
    "g8_replacements",
    """
SELECT k, CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'emptied: out of bounds' WHEN 2 THEN 'emptied: no area' ELSE 'missing' END AS v1,
       CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'emptied: out of bounds' WHEN 2 THEN 'disc' ELSE 'missing' END AS v2
FROM (SELECT o_orderkey AS k FROM orders) s""",
)
def g8(spark, sf):
    k = F.col("o_orderkey")
    v = lambda x, y: R.vertex(F.lit(float(x)), F.lit(float(y)))
    ring = lambda *xy: F.array(F.array(F.array(*[v(x, y) for x, y in xy])))
    geom = (
        F.when(k % 4 == 0, ring((1, 1), (2, 1), (2, 2), (1, 1)))
        .when(k % 4 == 1, ring((179, 1), (180, 1), (180, 2), (179, 1)))
        .when(k % 4 == 2, ring((1, 1), (1, 1), (1, 1), (1, 1)))
    )
    rows = spread(X.table(spark, sf, "orders").select(k.alias("k"), geom.alias("geom")))
    one = E.repair(rows).select("k", F.col("repair_rung").alias("v1"))
    two = E.repair(rows, generation=2).select("k", F.col("repair_rung").alias("v2"))
    return one.join(two, "k")


@query(
    "g9_repair_audit",
    Q.ctes(*Q.base())
    + """
SELECT CASE WHEN n IS NULL THEN 'empty' WHEN was_bow THEN 'hull' ELSE 'none' END AS repair_rung,
       count(*) AS rows, cast(sum(coalesce(n + 1, 0)) AS BIGINT) AS original_vertices
FROM (SELECT s.k, any_value(r.n) AS n, bool_or(r.was_bow) AS was_bow FROM src s LEFT JOIN ring r ON s.k = r.k GROUP BY s.k) t
GROUP BY 1""",
)
def g9(spark, sf):
    return E.repair_audit(repaired(spark, sf))


# --- measures -------------------------------------------------------------


@query("g10_area_utm", Q.ctes(*Q.measured()) + f"SELECT k, {Q.scaled('area')} AS area_mm FROM m")
def g10(spark, sf):
    return M.add_area(repaired(spark, sf)).select("k", scaled(F.col("area_m2")).alias("area_mm"))


@query(
    "g11_area_geodesic",
    Q.ctes(*Q.base(), Q.edges("le", "ring", "x", "y"), Q.geodesic_areas("ga", "le"))
    + f"SELECT s.k, {Q.scaled('coalesce(ga.area, 0)', 100)} AS area_cm FROM src s LEFT JOIN ga ON s.k = ga.k",
)
def g11(spark, sf):
    return M.add_area(repaired(spark, sf), generation=2).select(
        "k", scaled(F.col("area_m2"), 100).alias("area_cm")
    )


@query(
    "g12_table_projection",
    Q.ctes(
        *Q.base(),
        Q.utm("tp", "ring", "(SELECT cast((floor(((min(x) + max(x)) / 2 + 180) / 6) % 60 + 1) AS INT) FROM ring)"),
    )
    + f"""SELECT k, {Q.scaled('min(e)')} AS west_mm, {Q.scaled('max(nn)')} AS north_mm,
  (SELECT 32600 + cast((floor(((min(x) + max(x)) / 2 + 180) / 6) % 60 + 1) AS INT) FROM ring) AS epsg FROM tp GROUP BY k""",
)
def g12(spark, sf):
    rows = stage(repaired(spark, sf).select("k", "geom"), "repaired")
    plane = V.table_plane(rows, "geom", "plane").where(F.size("geom") > 0)
    box = R.settle(plane, b=R.bbox(F.col("plane")))
    return box.select(
        "k",
        scaled(F.col("b.minx")).alias("west_mm"),
        scaled(F.col("b.maxy")).alias("north_mm"),
    ).withColumn("epsg", M.table_bounds(rows).select("epsg").scalar())


@query(
    "g13_min_rectangle",
    Q.ctes(*Q.measured()) + f"SELECT k, {Q.scaled('area', 100)} AS rect_cm FROM rc",
)
def g13(spark, sf):
    rows = M.add_rectangle(M.with_own_plane(repaired(spark, sf).where(F.size("geom") > 0)), False)
    return rows.select("k", scaled(F.col("rect.area"), 100).alias("rect_cm"))


@query(
    "g14_protruding",
    Q.ctes(*Q.measured())
    + f"SELECT k, {Q.scaled('mrr')} AS mrr_ratio, coalesce(mrr > 1.55, false) AS protruding_ratio_too_big FROM m",
)
def g14(spark, sf):
    rows = M.add_plane_measures(repaired(spark, sf), C.SUBPLOTS_V1)
    return M.add_protruding_ratio(rows, C.SUBPLOTS_V1).select(
        "k", scaled(F.col("mrr_ratio")).alias("mrr_ratio"), "protruding_ratio_too_big"
    )


V2_RECT = (
    "struct_extract(fr, '{}')"
)


def _v2_rect_sql() -> str:
    g = V2_RECT.format
    corner = lambda u, v: (
        f"{g('ox')} + {u} * {g('ux')} - {v} * {g('uy')}",
        f"{g('oy')} + {u} * {g('uy')} + {v} * {g('ux')}",
    )
    pts = [
        corner(g("u0"), g("v0")),
        corner(g("u1"), g("v0")),
        corner(g("u1"), g("v1")),
        corner(g("u0"), g("v1")),
    ]
    union = " UNION ALL ".join(
        f"SELECT k, {i} AS i, 4 AS n, {x} AS x, {y} AS y FROM rg" for i, (x, y) in enumerate(pts, 1)
    )
    return f"rr AS ({union})"


def _short(a: str, b: str) -> str:
    mid = f"radians(({a}.y + {b}.y) / 2)"
    w2 = f"(1 - {P.E2!r} * sin({mid}) * sin({mid}))"
    return (
        f"sqrt((radians({b}.y - {a}.y) * {P.A * (1 - P.E2)!r} / ({w2} * sqrt({w2})))**2"
        f" + (radians({b}.x - {a}.x) * {P.A!r} / sqrt({w2}) * cos({mid}))**2)"
    )


V2_MEASURES = [
    *Q.base(zero_valid=False),
    Q.edges("le", "ring", "x", "y"),
    Q.geodesic_areas("ga", "le"),
    Q.rectangles("rg", "ring", "x", "y"),
    _v2_rect_sql(),
    Q.edges("rre", "rr", "x", "y"),
    Q.geodesic_areas("gr", "rre"),
]


@query(
    "g14_protruding_geodesic",
    Q.ctes(*V2_MEASURES)
    + f"""SELECT ga.k, {Q.scaled('gr.area / ga.area')} AS mrr_ratio, gr.area / ga.area > 1.55 AS protruding_ratio_too_big
FROM ga JOIN gr ON ga.k = gr.k""",
)
def g14_v2(spark, sf):
    rows = repaired(spark, sf, generation=2).where(F.size("geom") > 0)
    rows = M.add_rectangle(M.add_area(rows, 2), True)
    return M.add_protruding_ratio(rows, C.SUBPLOTS_V2).select(
        "k", scaled(F.col("mrr_ratio")).alias("mrr_ratio"), "protruding_ratio_too_big"
    )


def _unique_ratio():
    # All three rectangles of a triangle have the same area, so rounding
    # decides which one is taken; its ratio is not compared.
    return F.when(R.coordinate_count(F.col("geom")) > 4, scaled(F.col("length_width_ratio")))


@query(
    "g15_length_width",
    Q.ctes(*Q.measured())
    + f"SELECT k, CASE WHEN nv > 4 THEN {Q.scaled('lw')} END AS lw, coalesce(lw > 2, false) AS length_width_ratio_too_big FROM m",
)
def g15(spark, sf):
    rows = M.add_rectangle(M.with_own_plane(repaired(spark, sf)), False)
    return M.add_length_width_ratio(rows, C.SUBPLOTS_V1).select(
        "k", _unique_ratio().alias("lw"), "length_width_ratio_too_big"
    )


@query(
    "g15_length_width_geodesic",
    Q.ctes(*V2_MEASURES)
    + f"""SELECT a.k, CASE WHEN r.n > 3 THEN {Q.scaled(f"greatest({_short('a', 'b')}, {_short('b', 'c')}) / least({_short('a', 'b')}, {_short('b', 'c')})")} END AS lw
FROM rr a JOIN rr b ON a.k = b.k AND b.i = 2 JOIN rr c ON a.k = c.k AND c.i = 3
JOIN (SELECT DISTINCT k, n FROM ring) r ON a.k = r.k WHERE a.i = 1""",
)
def g15_v2(spark, sf):
    rows = M.add_rectangle(repaired(spark, sf, generation=2).where(F.size("geom") > 0), True)
    return M.add_length_width_ratio(rows, C.SUBPLOTS_V2).select("k", _unique_ratio().alias("lw"))


@query(
    "g16_vertex_count",
    Q.ctes(*Q.base(zero_valid=False))
    + """SELECT s.k, coalesce(any_value(r.n) + 1, 0) AS nr_vertices, 0 AS vertices_dropped,
 coalesce(any_value(r.n) + 1, 0) <= 4 AS nr_vertices_too_small FROM src s LEFT JOIN ring r ON s.k = r.k GROUP BY s.k""",
)
def g16(spark, sf):
    return M.add_vertex_count(repaired(spark, sf, generation=2), C.SUBPLOTS_V2).select(
        "k", F.col("nr_vertices").cast("long").alias("nr_vertices"), "vertices_dropped", "nr_vertices_too_small"
    )


@query(
    "g17_within_radius",
    Q.ctes(*Q.measured(radius=20.0)) + "SELECT k, in_radius FROM m",
)
def g17(spark, sf):
    rows = M.with_own_plane(repaired(spark, sf))
    return R.settle(rows, in_radius=M.within_radius(F.slice("utm", 1, 1), 20.0)).select("k", "in_radius")


G18_SQL = Q.ctes(
    *Q.measured(),
    "elig AS (SELECT k FROM m WHERE NOT empty AND mrr < 1.1)",
    *Q.overlaps(0.1, -5),
) + f"SELECT s.k, {Q.scaled('abs(sa.area)', 100)} AS eroded_cm FROM src s LEFT JOIN sa ON s.k = sa.k"


@query("g18_erode", G18_SQL)
def g18(spark, sf):
    rows = stage(measured(spark, sf).select("k", "geom", "mrr_ratio"), "measured")
    # every shape has a row; only those that the overlap check takes are eroded
    compact = F.when(F.col("mrr_ratio") < 1.1, F.col("plane"))
    plane = V.table_plane(rows, "geom", "plane").withColumn("plane", compact)
    shrunk = O.add_buffer(plane, "plane", "eroded", -5.0)
    return shrunk.select("k", scaled(R.area(F.col("eroded")), 100).alias("eroded_cm"))


@query("g18_erode_nonconvex")
def g18_nonconvex(spark, sf):
    rows = repaired(spark, sf)  # every shape; add_buffer picks the branch
    plane = R.settle(rows, plane=P.to_utm(F.col("geom"), F.lit(43), F.lit(False)))
    shrunk = O.add_buffer(plane, "plane", "eroded", -4.0)
    return shrunk.select("k", F.size("eroded").alias("parts"), scaled(R.area(F.col("eroded")), 100).alias("eroded_cm"))


@query(
    "g19_total_vertices",
    Q.ctes(*Q.base()) + "SELECT cast(count(*) + count(DISTINCT k) AS BIGINT) AS vertices FROM ring",
)
def g19(spark, sf):
    return repaired(spark, sf).agg(
        F.sum(R.coordinate_count(F.col("geom"))).cast("long").alias("vertices")
    )


@query(
    "g20_centroids_bounds",
    Q.ctes(*Q.base(), Q.edges("le", "ring", "x", "y"), Q.areas("la", "le"))
    + f"""SELECT {Q.scaled('avg(cx)', 1000000)} AS lon, {Q.scaled('avg(cy)', 1000000)} AS lat,
 (SELECT {Q.scaled('min(x)', 1000000)} FROM ring) AS w, (SELECT {Q.scaled('max(y)', 1000000)} FROM ring) AS n FROM la""",
)
def g20(spark, sf):
    rows = M.with_centroid(R.settle(repaired(spark, sf), b=R.bbox(F.col("geom"))))
    return rows.agg(
        scaled(F.avg("centroid.cx"), 1000000).alias("lon"),
        scaled(F.avg("centroid.cy"), 1000000).alias("lat"),
        scaled(F.min("b.minx"), 1000000).alias("w"),
        scaled(F.max("b.maxy"), 1000000).alias("n"),
    )


@query("p11_hectares", Q.ctes(*Q.measured()) + f"SELECT k, {Q.scaled('area / 10000', 1000000)} AS area_ha FROM m")
def p11(spark, sf):
    return M.add_area(repaired(spark, sf)).select(
        "k", scaled(F.col("area_m2") / 10000, 1000000).alias("area_ha")
    )


@query(
    "a9_measure_range",
    Q.ctes(*Q.measured()) + f"SELECT {Q.scaled('min(area)', 100)} AS min_area, {Q.scaled('max(area)', 100)} AS max_area FROM m",
)
def a9(spark, sf):
    r = reports.measure_range(M.add_area(repaired(spark, sf)), "area_m2")
    return r.select(scaled(F.col("min_area_m2"), 100).alias("min_area"), scaled(F.col("max_area_m2"), 100).alias("max_area"))


# --- spatial joins --------------------------------------------------------

REGION_CUT = """
    lay AS ({layer}),
    cut AS (SELECT e.k, l.name, l.id, sum(CASE WHEN x2 < x1 THEN 1 ELSE -1 END
              * (least(greatest(x1, x2), l.e / 10000) - greatest(least(x1, x2), l.w / 10000))
              * ((y1 + (y2 - y1) / (x2 - x1) * (greatest(least(x1, x2), l.w / 10000) - x1)
                + y1 + (y2 - y1) / (x2 - x1) * (least(greatest(x1, x2), l.e / 10000) - x1)) / 2 - e.oy)) AS a
            FROM le e JOIN lay l ON greatest(x1, x2) > l.w / 10000 AND least(x1, x2) < l.e / 10000
            WHERE x1 <> x2 GROUP BY e.k, l.name, l.id)"""

J1_SQL = (
    Q.ctes(*Q.base(), Q.edges("le", "ring", "x", "y"), REGION_CUT.format(layer=X.ECOREGIONS_SQL))
    + """SELECT s.k, max_by(cut.name, abs(cut.a)) AS ecoregion FROM src s LEFT JOIN cut ON s.k = cut.k AND abs(cut.a) > 1e-14 GROUP BY s.k"""
)


@query("j1_ecoregion", J1_SQL)
def j1(spark, sf):
    rows = stage(repaired(spark, sf).select("k", "subplot_id", "geom"), "repaired")
    return J.add_ecoregion(rows, X.ecoregions(spark, sf), "subplot_id").select("k", "ecoregion")


@query(
    "w3_largest_per_id",
    Q.ctes(*Q.base(), Q.edges("le", "ring", "x", "y"), REGION_CUT.format(layer=X.ECOREGIONS_SQL))
    + "SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY abs(a) DESC) AS r FROM cut WHERE abs(a) > 1e-14) t WHERE r = 1",
)
def w3(spark, sf):
    rows = stage(repaired(spark, sf).select("k", "subplot_id", "geom"), "repaired")
    out = J.add_ecoregion(rows, X.ecoregions(spark, sf), "subplot_id", name="ecoregion")
    return out.where(F.col("ecoregion").isNotNull()).select("k", F.col("ecoregion").alias("name"))


J2_SQL = (
    Q.ctes(*Q.base(), Q.in_country())
    + """SELECT s.k, CASE WHEN c.hit THEN 'IND' ELSE 'nan' END AS overlapping_countries, coalesce(c.hit, false) AS in_country
FROM src s LEFT JOIN ctry c ON s.k = c.k"""
)


@query("j2_country", J2_SQL)
def j2(spark, sf):
    rows = stage(repaired(spark, sf).select("k", "geom"), "repaired")
    return J.validate_country(rows, X.countries(spark, sf), X.COUNTRY).select(
        "k", "overlapping_countries", "in_country"
    )


@query(
    "a10_country_hits",
    Q.ctes(*Q.base(), Q.in_country(), f"l2 AS ({X.COUNTRIES_SQL})")
    + f"""SELECT ext.k, string_agg(l2.iso3, ';' ORDER BY l2.iso3) AS codes FROM ext JOIN l2 ON l2.iso3 = 'IND'
 AND radians(greatest(0, xmin - l2.e / 10000, l2.w / 10000 - xmax)) * {P.A!r} / sqrt(1 - {P.E2!r} * sin(radians(y0)) * sin(radians(y0))) * cos(radians(y0)) <= 10000
 GROUP BY ext.k""",
)
def a10(spark, sf):
    rows = stage(repaired(spark, sf).select("k", "geom"), "repaired")
    hits = J.validate_country(rows, X.countries(spark, sf), X.COUNTRY, repeat_codes=True)
    return hits.where(F.col("overlapping_countries") != "nan").select(
        "k", F.col("overlapping_countries").alias("codes")
    )


ELIGIBLE = """elig AS (SELECT k FROM m WHERE NOT empty AND in_radius AND area > {lo} AND area < {hi}
   AND NOT mrr > 1.55 AND nv > 4)"""

@query(
    "j3_overlap",
    Q.ctes(*Q.measured(), ELIGIBLE.format(lo=450, hi=750), *Q.overlaps(0.1, -5))
    + f"""SELECT s.k, coalesce(o.overlap_ids, '') AS overlap_ids, {Q.scaled('o.ratio', 100)} AS ratio_pct
FROM src s LEFT JOIN ovl o ON s.k = o.k""",
)
def j3(spark, sf):
    rows = stage(measured(spark, sf).withColumn("in_country", F.lit(True)), "measured")
    out = V.validate_overlap(
        rows, "subplot_id", 0.1, -5.0, rules.eligible(C.SUBPLOTS_V1), cell_m=80.0
    )
    return out.select("k", "overlap_ids", F.round(F.col("percentage_overlap") * 100).cast("long").alias("ratio_pct"))


@query(
    "a6_partners",
    Q.ctes(*Q.measured(), ELIGIBLE.format(lo=0, hi=5000), *Q.overlaps(0.05, 0))
    + f"SELECT cast(k AS VARCHAR) AS subplot_id, overlap_ids, {Q.scaled('ratio', 100)} AS ratio_pct FROM ovl",
)
def a6(spark, sf):
    rows = stage(
        measured(spark, sf)
        .where(F.col("in_radius") & (F.col("area_m2") > 0) & (F.col("area_m2") < 5000))
        .where(~F.col("protruding_ratio_too_big") & ~F.col("nr_vertices_too_small"))
        .select("subplot_id", "geom"),
        "measured",
    )
    plane = V.table_plane(rows, "geom", "plane")
    return V.overlap_partners(plane, "subplot_id", "plane", 0.05, 80.0).select(
        "subplot_id", "overlap_ids", F.round(F.col("percentage_overlap") * 100).cast("long").alias("ratio_pct")
    )


# --- rules ----------------------------------------------------------------


def reasons_sql(lo: float, hi: float) -> str:
    return f"""
    CASE WHEN m.empty THEN 'Empty geometry' ELSE concat_ws(';',
      CASE WHEN o.k IS NOT NULL THEN 'Overlapping polygons' END,
      CASE WHEN NOT coalesce(c.hit, false) THEN 'Boundary not in country' END,
      CASE WHEN NOT m.in_radius THEN 'Plot outside of radius' END,
      CASE WHEN m.area < {lo} THEN 'Plot too small' END,
      CASE WHEN m.area > {hi} THEN 'Plot too big' END,
      CASE WHEN m.nv <= 4 THEN 'Nr vertices <= 3' END,
      CASE WHEN m.mrr > 1.55 THEN 'Plot is protruding' END) END"""


def layer_sql(scale: int, radius: float, lo: float, hi: float, erode: float, limit: float = 0.1) -> list[str]:
    return [
        *Q.measured(scale, radius),
        Q.in_country(),
        f"""elig AS (SELECT m.k FROM m JOIN ctry c ON m.k = c.k AND c.hit WHERE NOT empty AND in_radius
          AND area > {lo} AND area < {hi} AND NOT mrr > 1.55 AND nv > 4)""",
        *Q.overlaps(limit, erode),
        f"""
    verdict AS (SELECT m.k, m.area, m.mrr, m.nv, m.in_radius, coalesce(c.hit, false) AS in_country,
         coalesce(o.overlap_ids, '') AS overlap_ids, {reasons_sql(lo, hi)} AS reasons
       FROM m LEFT JOIN ctry c ON m.k = c.k LEFT JOIN ovl o ON m.k = o.k)""",
    ]


SUBPLOT_LAYER = layer_sql(1, 40, 450, 750, -5)
PLOT_LAYER = layer_sql(4, 200, 2000, 20000, 0)


def subplot_layer(spark, sf, geojson: bool = False) -> DataFrame:
    return layers.build_layer(
        X.shapes(spark, sf), C.SUBPLOTS_V1, X.countries(spark, sf), X.ecoregions(spark, sf), geojson
    )


def plot_layer(spark, sf) -> DataFrame:
    plots = X.shapes(spark, sf, 4).withColumnRenamed("subplot_id", "plot_id")
    return layers.build_layer(
        plots, C.PLOTS_V1, X.countries(spark, sf), X.ecoregions(spark, sf), geojson=False
    )


LAYER_OUT = f"SELECT k, {Q.scaled('area', 100)} AS area_cm, overlap_ids, in_country, reasons, reasons = '' AS valid FROM verdict"


@query("v5_subplot_layer", Q.ctes(*SUBPLOT_LAYER) + LAYER_OUT)
def v5_subplots(spark, sf):
    return subplot_layer(spark, sf).select(
        "k", scaled(F.col("area_m2"), 100).alias("area_cm"), "overlap_ids", "in_country", "reasons", "valid"
    )


@query("v5_plot_layer", Q.ctes(*PLOT_LAYER) + LAYER_OUT)
def v5_plots(spark, sf):
    return plot_layer(spark, sf).select(
        "k", scaled(F.col("area_m2"), 100).alias("area_cm"), "overlap_ids", "in_country", "reasons", "valid"
    )


V6_SQL = Q.ctes(
    *V2_MEASURES,
    Q.utm(),
    Q.edges("ue", "up", "e", "nn"),
    Q.areas("ua", "ue"),
    Q.radius_test("rd", "up", "ua", 40),
    """m AS (SELECT s.k, ga.k IS NULL AS empty, coalesce(ga.area, 0) AS area, gr.area / ga.area AS mrr,
         coalesce(ua.n + 1, 0) AS nv, coalesce(rd.inside, false) AS in_radius
       FROM src s LEFT JOIN ga ON s.k = ga.k LEFT JOIN gr ON s.k = gr.k LEFT JOIN ua ON s.k = ua.k LEFT JOIN rd ON s.k = rd.k)""",
    ELIGIBLE.format(lo=450, hi=750),
    *Q.overlaps(0.5, -5),
) + f"""
SELECT m.k, {Q.scaled('m.area', 100)} AS area_cm, {reasons_sql(450, 750).replace('NOT coalesce(c.hit, false)', 'false')} AS reasons
FROM m LEFT JOIN ovl o ON m.k = o.k"""


@query("v6_generation_two", V6_SQL)
def v6(spark, sf):
    rows = X.traces(spark, sf).select("k", F.col("k").cast("string").alias("subplot_id"), "trace")
    checked, _ = layers.checked_and_raw(rows, "trace", C.SUBPLOTS_V2)
    return checked.select("k", scaled(F.col("area_m2"), 100).alias("area_cm"), "reasons")


@query(
    "v6_raw_layer",
    Q.ctes(Q.tokens(), Q.parsed(1000))
    + "SELECT s.k, coalesce(any_value(r.n) + 1, 0) AS coordinates FROM src s LEFT JOIN raw r ON s.k = r.k GROUP BY s.k",
)
def v6_raw(spark, sf):
    return X.shapes(spark, sf, accuracy=C.RAW_GPS_ACCURACY_M).select(
        "k", R.coordinate_count(F.col("geom")).cast("long").alias("coordinates")
    )


MEASURE_ONLY = f"""
SELECT s.k, CASE WHEN m.empty THEN 'Empty geometry' ELSE concat_ws(';',
  CASE WHEN NOT m.in_radius THEN 'Plot outside of radius' END, CASE WHEN m.area < {{lo}} THEN 'Plot too small' END,
  CASE WHEN m.area > {{hi}} THEN 'Plot too big' END, CASE WHEN m.nv <= 4 THEN 'Nr vertices <= 3' END,
  CASE WHEN m.mrr > 1.55 THEN 'Plot is protruding' END) END AS reasons FROM src s JOIN m ON s.k = m.k"""


def measured_reasons(spark, sf, spec: C.LayerSpec, scale: int) -> DataFrame:
    has = {"in_radius", "area_m2", "nr_vertices_too_small", "protruding_ratio_too_big"}
    rows = measured(spark, sf, spec, scale)
    return rows.select("k", F.array_join(rules.reason_list(spec, has=has), ";").alias("reasons"))


@query("v1_subplot_reasons", Q.ctes(*Q.measured()) + MEASURE_ONLY.format(lo=450, hi=750))
def v1(spark, sf):
    return measured_reasons(spark, sf, C.SUBPLOTS_V1, 1)


@query("v2_plot_reasons", Q.ctes(*Q.measured(4, 200.0)) + MEASURE_ONLY.format(lo=2000, hi=20000))
def v2(spark, sf):
    return measured_reasons(spark, sf, C.PLOTS_V1, 4)


@query("v3_eligibility", Q.ctes(*Q.measured(), ELIGIBLE.format(lo=450, hi=750)) + "SELECT k FROM elig")
def v3(spark, sf):
    return measured(spark, sf).withColumn("in_country", F.lit(True)).where(rules.eligible(C.SUBPLOTS_V1)).select("k")


@query(
    "v4_valid",
    Q.ctes(*Q.measured())
    + f"SELECT k, reasons = '' AS valid FROM ({MEASURE_ONLY.format(lo=450, hi=750)}) t",
)
def v4(spark, sf):
    return measured_reasons(spark, sf, C.SUBPLOTS_V1, 1).select("k", (F.length("reasons") == 0).alias("valid"))


A2_SQL = (
    Q.ctes(*Q.measured())
    + f"""SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, reason) AS place FROM (SELECT trim(unnest(string_split(reasons, ';'))) AS reason
FROM ({MEASURE_ONLY.format(lo=450, hi=750)}) t) u WHERE reason <> '' GROUP BY reason"""
)


@query("a2_reason_counts", A2_SQL)
def a2(spark, sf):
    counts = reports.reason_counts(measured_reasons(spark, sf, C.SUBPLOTS_V1, 1))
    # one row for each rule
    order = Window.orderBy(F.col("n").desc(), "reason")
    return counts.withColumn("place", F.row_number().over(order).cast("long"))


@query(
    "a3_validity_totals",
    Q.ctes(*Q.measured())
    + f"""SELECT count(*) AS total, count(*) FILTER (WHERE reasons = '') AS valid, count(*) FILTER (WHERE reasons <> '') AS invalid,
 {Q.scaled("100.0 * count(*) FILTER (WHERE reasons = '') / count(*)")} AS valid_pct,
 {Q.scaled("100.0 * count(*) FILTER (WHERE reasons <> '') / count(*)")} AS invalid_pct
 FROM ({MEASURE_ONLY.format(lo=450, hi=750)}) t""",
)
def a3(spark, sf):
    rows = measured_reasons(spark, sf, C.SUBPLOTS_V1, 1).withColumn("valid", F.length("reasons") == 0)
    return reports.validity_totals(rows).withColumn("valid_pct", scaled(F.col("valid_pct"))).withColumn(
        "invalid_pct", scaled(F.col("invalid_pct"))
    )


@query(
    "s7_geojson",
    Q.ctes(*Q.base(repaired=False))
    + """SELECT s.k, 'FeatureCollection' AS kind, cast(s.k AS VARCHAR) AS id, coalesce(any_value(r.n) + 1, 0) AS coordinates,
 cast(coalesce(round(sum(r.x) * 1e6), 0) AS BIGINT) AS x_sum FROM src s LEFT JOIN ring r ON s.k = r.k GROUP BY s.k""",
)
def s7(spark, sf):
    rows = X.shapes(spark, sf).select("k", to_geojson(F.col("geom"), F.col("subplot_id")).alias("j"))
    read = F.from_json(
        "j",
        "type string, features array<struct<properties: struct<id: string>, geometry: struct<coordinates: array<array<array<double>>>>>>",
    )
    rows = R.settle(rows, f=read)
    ring = F.get(F.col("f.features")[0]["geometry"]["coordinates"], F.lit(0))
    n = F.coalesce(F.size(ring), F.lit(0))
    return rows.select(
        "k",
        F.col("f.type").alias("kind"),
        F.col("f.features")[0]["properties"]["id"].alias("id"),
        F.when(F.col("f.features")[0]["geometry"]["coordinates"] == F.array(), F.lit(0)).otherwise(n).cast("long").alias("coordinates"),
        F.coalesce(
            F.round(
                F.aggregate(
                    F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
                    F.lit(0.0),
                    lambda a, c: a + F.get(c, F.lit(0)),
                )
                * 1e6
            ),
            F.lit(0),
        )
        .cast("long")
        .alias("x_sum"),
    )
