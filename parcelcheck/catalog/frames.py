"""Survey-shaped inputs derived from the driver tables.

Every frame is a deterministic SELECT over a parquet table. The same text,
with the other dialect's integer division, feeds the DuckDB side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcheck.functions.rings import GEOM_DDL, settle
from parcelcheck.functions.text import from_wkt
from parcelcheck.functions.trace import named_trace_polygon
from parcelcheck.session import spread

COUNTRY = "IND"
PARTNER = "Partner Co"

# Vertices of the twelve trace classes: (lat, lon, accuracy) in micro-degrees
# from the corner of the shape.
S = 225
SQUARE = [(0, 0, 5), (0, S, 5), (S, S, 5), (S, 0, 5)]
CLASSES = {
    0: SQUARE,
    1: [(0, 0, 5), (0, 135, 5), (135, 135, 5), (135, 0, 5)],
    2: [(0, 0, 5), (0, 360, 5), (360, 360, 5), (360, 0, 5)],
    3: [(0, 0, 5), (0, 450, 5), (108, 450, 5), (108, 0, 5)],
    4: [(0, 0, 5), (S, S, 5), (0, S, 5), (S, 0, 5)],
    5: [(0, 0, 5), (0, 310, 5), (315, 155, 5)],
    6: [(0, 0, 5), (0, S, 25), (S, S, 5), (S, 0, 25)],
    8: SQUARE,
    9: [(0, 0, 5), (0, 340, 5), (90, 340, 5), (90, 90, 5), (340, 90, 5), (340, 0, 5)],
    10: SQUARE,
    11: [(0, 0, 0), (0, S, 5), (S - 60, S, 5), (S, S - 60, 5), (S, 0, 5)],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _degrees(expr: str, div: str) -> str:
    return (
        f"cast(({expr}) {div} 1000000 as string) || '.' || "
        f"lpad(cast(({expr}) % 1000000 as string), 6, '0')"
    )


def trace_text(points, lat: str, lon: str, div: str, scale: int = 1) -> str:
    return " || ';' || ".join(
        f"{_degrees(f'{lat} + {dlat * scale}', div)} || ' ' || "
        f"{_degrees(f'{lon} + {dlon * scale}', div)} || ' 100 {acc}'"
        for dlat, dlon, acc in points
    )


def class_trace(key: str, div: str, scale: int = 1) -> str:
    """Trace of a key: class = key % 12, see FIXTURES.md."""
    whens = []
    for cls, points in CLASSES.items():
        text = trace_text(points, "lat_u", "lon_u", div, scale)
        if cls == 11:
            text += " || ';'"
        whens.append(f"WHEN {key} % 12 = {cls} THEN {text}")
    return f"CASE {' '.join(whens)} END"


def centre_columns(key: str, div: str) -> str:
    """Corner of a key's shape in micro-degrees; class 8 sits on its neighbour."""
    home = f"(CASE WHEN {key} % 24 = 8 THEN {key} - 8 ELSE {key} END)"
    return f"""
      5000000 + 2000 * (({home} {div} 2500) % 20000) AS lat_u,
      CASE WHEN {key} % 12 = 10 THEN 80000000 + 1000 * ({key} % 2500)
           ELSE 72500000 + 2000 * ({home} % 2500) + CASE WHEN {key} % 24 = 8 THEN 75 ELSE 0 END
      END AS lon_u"""


def shapes_sql(div: str, scale: int = 1) -> str:
    """One trace per order."""
    return f"""
    SELECT k, starttime, enumerator, enumerator_id, device_info, lat_u, lon_u,
           {class_trace("k", div, scale)} AS trace
    FROM (SELECT o_orderkey AS k, o_orderdate AS starttime,
                 'Enum ' || cast(o_custkey % 40 as string) AS enumerator,
                 cast(o_custkey % 40 as string) AS enumerator_id,
                 o_orderpriority || 'SurveyCTO Collect' AS device_info,
                 {centre_columns("o_orderkey", div)}
          FROM orders) s"""


def form_sql(div: str) -> str:
    """Wide form: a plot trace and sixteen subplot traces per order."""
    subs = ",\n".join(
        f"CASE WHEN (k + {i}) % 5 = 0 THEN NULL ELSE "
        + trace_text(
            SQUARE[: 4 if i % 4 else 3],
            f"lat_u + {(i - 1) // 4 * 450}",
            f"lon_u + {(i - 1) % 4 * 450}",
            div,
        )
        + f" END AS gt_subplot_{i}"
        for i in range(1, 17)
    )
    return f"""
    SELECT k, starttime, enumerator, enumerator_id, device_info,
           CASE WHEN k % 7 = 0 THEN NULL ELSE {trace_text(SQUARE, "lat_u", "lon_u", div, 4)} END AS gt_plot,
           {subs}
    FROM ({shapes_sql(div)}) f"""


# Rings of 200 and 900 vertices, one shape per supplier, in nano-degrees. Every
# second vertex lies a fifth nearer to the centre, so the others are the hull.
# By the key's remainder by 5: a plain ring, a vertex thrown across, a hole, a
# hole that leaves its shell, a second part.
def long_rings_sql(div: str) -> str:
    angle = "(6.283185307179586e0 * i / n)"
    reach = """CASE WHEN k % 5 = 1 AND ring = 0 AND i = n - 7 THEN -0.9e0 WHEN i % 2 = 0 THEN 1e0 ELSE 0.8e0 END
      * (1000000 + 100000 * (k % 7)) * CASE WHEN ring = 0 THEN 1e0 WHEN k % 5 = 4 THEN 0.9e0 ELSE 0.5e0 END"""
    shift = "CASE WHEN ring = 0 THEN 0 WHEN k % 5 = 3 THEN 700000 WHEN k % 5 = 4 THEN 4000000 ELSE 0 END"
    series = (
        "LATERAL VIEW explode(sequence(0, 899)) v AS i LATERAL VIEW explode(sequence(0, 1)) w AS ring"
        if div == "div"
        else ", unnest(range(0, 900)) AS v(i), unnest(range(0, 2)) AS w(ring)"
    )
    return f"""
    SELECT k, ring, i, n, 73000000000 + 10000000 * (k % 1000) + {shift} + cast(floor({reach} * cos({angle}) + 0.5) AS bigint) AS x,
           9000000000 + 10000000 * (k {div} 1000) + cast(floor({reach} * sin({angle}) + 0.5) AS bigint) AS y
    FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 200 ELSE 900 END AS n, i, ring FROM supplier {series}) r
    WHERE i < n AND (ring = 0 OR k % 5 > 1)"""


# Reference layers as rectangles (id, name, west, south, east, north in 0.0001
# degrees), tied to the rows of region and nation.
COUNTRIES_SQL = """
    SELECT r_regionkey AS id,
           CASE WHEN r_regionkey < 2 THEN 'IND' ELSE 'C' || cast(r_regionkey as string) END AS iso3,
           r_name AS name,
           CASE r_regionkey WHEN 0 THEN 724000 WHEN 1 THEN 750000 ELSE 774000 + 10000 * r_regionkey END AS w,
           49000 AS s,
           CASE r_regionkey WHEN 0 THEN 750000 WHEN 1 THEN 774000 ELSE 784000 + 10000 * r_regionkey END AS e,
           451000 AS n
    FROM region"""

ECOREGIONS_SQL = """
    SELECT n_nationkey AS id, 'ECO_' || cast(n_nationkey % 20 as string) AS name,
           724001 + 2100 * n_nationkey AS w, 49000 AS s,
           724001 + 2100 * (n_nationkey + 1) AS e, 451000 AS n
    FROM nation"""


def _views(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...], deal=lambda rows: rows) -> DataFrame:
    """Run a shared SELECT over parquet tables, passed as arguments; ``deal`` may repartition them."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: deal(table(spark, sf_dir, t)) for t in tables})


def traces(spark: SparkSession, sf_dir: str, scale: int = 1) -> DataFrame:
    return _views(spark, sf_dir, shapes_sql("div", scale), ("orders",), spread)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, form_sql("div"), ("orders",))


def shapes(
    spark: SparkSession, sf_dir: str, scale: int = 1, zero_valid: bool = True, accuracy: float = 10
) -> DataFrame:
    """Parsed, unrepaired polygons: ``k``, ``subplot_id``, ``geom``."""
    rows = traces(spark, sf_dir, scale).select(
        "k", F.col("k").cast("string").alias("subplot_id"), "trace"
    )
    return settle(rows, geom=named_trace_polygon("trace", accuracy, zero_valid)).drop("trace")


def long_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of many vertices: ``k``, ``geom``."""
    # a key gives up to 1800 vertices
    rows = _views(spark, sf_dir, long_rings_sql("div"), ("supplier",), lambda keys: spread(keys, 5000))
    at = F.struct((F.col("x") / 1e9).alias("x"), (F.col("y") / 1e9).alias("y"))
    # one ring of 900 vertices at most
    rings = rows.groupBy("k", "ring").agg(F.sort_array(F.collect_list(F.struct("i", at.alias("v")))).alias("vs"))
    closed = rings.select("k", "ring", F.expr("transform(concat(vs, slice(vs, 1, 1)), z -> z.v)").alias("r"))
    both = closed.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("ring", "r"))).alias("rs"))
    split = F.expr("if(k % 5 = 4, transform(rs, z -> array(z.r)), array(transform(rs, z -> z.r)))")
    return settle(both, geom=split.cast(GEOM_DDL)).select("k", "geom")


def _rectangles(layer: DataFrame) -> DataFrame:
    corner = lambda x, y: F.concat_ws(
        " ", (F.col(x) / 10000).cast("string"), (F.col(y) / 10000).cast("string")
    )
    wkt = F.concat(
        F.lit("POLYGON (("),
        F.concat_ws(",", corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s")),
        F.lit("))"),
    )
    return layer.withColumn("geom", from_wkt(wkt).cast(GEOM_DDL)).drop("w", "s", "e", "n")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rectangles(_views(spark, sf_dir, COUNTRIES_SQL, ("region",)))


def ecoregions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rectangles(_views(spark, sf_dir, ECOREGIONS_SQL, ("nation",))).withColumnRenamed(
        "name", "ecoregion"
    )
