"""Grid cells: the equi-join keys of every spatial join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions import rings as R


def covering(low: Column, high: Column, size: float) -> Column:
    """Indices of the cells a closed range touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def place(df: DataFrame, box: str, size: float, margin: float = 0.0) -> DataFrame:
    """One copy of each row per cell its box (a bbox struct column) touches."""
    b = F.col(box)
    return df.withColumn("cx", F.explode(covering(b["minx"] - margin, b["maxx"] + margin, size))).withColumn(
        "cy", F.explode(covering(b["miny"] - margin, b["maxy"] + margin, size))
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (
        (a["minx"] <= b["maxx"])
        & (b["minx"] <= a["maxx"])
        & (a["miny"] <= b["maxy"])
        & (b["miny"] <= a["maxy"])
    )


def reference_cell(a: Column, b: Column, size: float) -> Column:
    """True in exactly one of the cells two meeting boxes share."""
    return (F.col("cx") == F.floor(F.greatest(a["minx"], b["minx"]) / size)) & (
        F.col("cy") == F.floor(F.greatest(a["miny"], b["miny"]) / size)
    )


def slabs(edge_list: Column, ox: Column, oy: Column) -> Column:
    """Directed edges as signed lines over x, without the vertical ones."""
    return F.transform(
        F.filter(edge_list, lambda e: e["x1"] != e["x2"]),
        lambda e: F.struct(
            (F.least(e["x1"], e["x2"]) - ox).alias("a"),
            (F.greatest(e["x1"], e["x2"]) - ox).alias("b"),
            (F.when(e["x1"] < e["x2"], e["y1"]).otherwise(e["y2"]) - oy).alias("y"),
            ((e["y2"] - e["y1"]) / (e["x2"] - e["x1"])).alias("k"),
            F.when(e["x2"] < e["x1"], F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"),
        ),
    )


def _below_both(p: Column, q: Column) -> Column:
    """Signed integral of the lower of two lines over their shared x-range."""
    lo, hi = F.greatest(p["a"], q["a"]), F.least(p["b"], q["b"])

    def area(g: Column) -> Column:
        w = g["hi"] - g["lo"]
        qa = q["y"] + q["k"] * (g["lo"] - q["a"])
        qb = q["y"] + q["k"] * (g["hi"] - q["a"])
        da = p["y"] + p["k"] * (g["lo"] - p["a"]) - qa
        db = p["y"] + p["k"] * (g["hi"] - p["a"]) - qb
        low, high = F.least(da, db), F.greatest(da, db)
        under = (
            F.when(low >= 0, F.lit(0.0))
            .when(high <= 0, (low + high) / 2)
            .otherwise(-low * low / (2 * (high - low)))
        )
        return p["s"] * q["s"] * w * ((qa + qb) / 2 + under)

    return F.when(hi > lo, R.let(F.struct(lo.alias("lo"), hi.alias("hi")), area)).otherwise(
        F.lit(0.0)
    )


def overlap_area(edges_a: Column, edges_b: Column, box_a: Column, box_b: Column) -> Column:
    """Exact area shared by two regions given as directed edges.

    Each region is the signed sum of the areas below its edges, so the shared
    area is the signed sum over edge pairs of the area below both.
    """
    ox = F.least(box_a["minx"], box_b["minx"])
    oy = F.least(box_a["miny"], box_b["miny"])
    return R.let(
        F.struct(slabs(edges_a, ox, oy).alias("p"), slabs(edges_b, ox, oy).alias("q")),
        lambda s: F.greatest(
            F.aggregate(
                s["p"],
                F.lit(0.0),
                lambda acc, p: acc
                + F.aggregate(s["q"], F.lit(0.0), lambda inner, q: inner + _below_both(p, q)),
            ),
            F.lit(0.0),
        ),
    )
