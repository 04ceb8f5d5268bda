"""Overlap between the shapes of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.operators import cells as C
from parcelcheck.operators.long_rings import to_utm
from parcelcheck.operators.outline import add_buffer
from parcelcheck.operators.skew import join_per_key
from parcelcheck.session import stage

BLOCK = 2000


def table_plane(df: DataFrame, geom: str, out: str, keep: Column | None = None) -> DataFrame:
    """Project a table into the zone of the centre of its bounds.

    Only rows matching ``keep`` are projected and returned; the bounds are
    those of all rows.
    """
    box = R.bbox(F.col(geom))
    span = df.select(box.alias("b")).agg(
        ((F.min("b.minx") + F.max("b.maxx")) / 2).alias("lon"),
        ((F.min("b.miny") + F.max("b.maxy")) / 2).alias("lat"),
    )
    frame = span.select(
        F.struct(P.plain_zone(F.col("lon")).alias("zone"), (F.col("lat") < 0).alias("south"))
    ).scalar()
    rows = df if keep is None else df.where(keep)
    rows = rows.withColumn("_frame", frame)
    plane = to_utm(F.col(geom), F.col("_frame.zone"), F.col("_frame.south"))
    return R.settle(rows, **{out: plane}).drop("_frame")


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Number of blocks each crowded cell is cut into."""
    return (
        placed.groupBy("cx", "cy")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block)
        .select("cx", "cy", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    )


def overlap_pairs(
    shapes: DataFrame, min_overlap: float, cell_m: float, block: int = BLOCK
) -> DataFrame:
    """Pairs of distinct shapes sharing more than ``min_overlap`` of the smaller one.

    ``shapes`` has ``ids`` and ``geom`` in metres, each geometry once. A
    crowded cell is cut into blocks and every pair of blocks becomes a join
    key of its own, so no task gets all pairs of a cell.
    """
    sized = R.settle(shapes, edges=R.edges(F.col("geom")), box=R.bbox(F.col("geom")))
    sized = (
        R.settle(sized, area=R.moments(F.col("edges"))["area"])
        .where(F.col("area") > 0)
        .withColumn("tag", F.xxhash64("geom"))
        .drop("geom")
    )
    # read by the count of the cells and by both sides of the join
    sized = stage(sized, "sized")
    placed = C.place(sized, "box", cell_m)
    placed = (
        placed.join(_blocks(placed, block), ["cx", "cy"], "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("_own", F.pmod("tag", "_blocks").cast("int"))
    )
    rename = {c: c for c in ("ids", "edges", "box", "area", "tag")}
    left = placed.withColumn("hi", F.explode(F.sequence("_own", F.col("_blocks") - 1))).select(
        "cx", "cy", F.col("_own").alias("lo"), "hi", F.struct(*rename).alias("a")
    )
    right = placed.withColumn("lo", F.explode(F.sequence(F.lit(0), "_own"))).select(
        "cx", "cy", "lo", F.col("_own").alias("hi"), F.struct(*rename).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    # Equal tags can only be a hash clash here; the edges then give the order.
    ordered = (a["tag"] < b["tag"]) | ((a["tag"] == b["tag"]) & (a["edges"] < b["edges"]))
    met = (
        left.join(right, ["cx", "cy", "lo", "hi"])
        .where((F.col("lo") < F.col("hi")) | ordered)
        .where(C.boxes_meet(a["box"], b["box"]) & C.reference_cell(a["box"], b["box"], cell_m))
    )
    shared = C.overlap_area(a["edges"], b["edges"], a["box"], b["box"])
    return (
        R.settle(met, ratio=shared / F.least(a["area"], b["area"]))
        .where(F.col("ratio") > min_overlap)
        .select(a["ids"].alias("ids_a"), b["ids"].alias("ids_b"), "ratio")
    )


def overlap_partners(
    shapes: DataFrame, id_column: str, geom: str, min_overlap: float, cell_m: float
) -> DataFrame:
    """Sorted partner ids and the largest ratio per id, ``;``-joined.

    Copies of one shape are folded before the join and share one partner list.
    """
    distinct = stage(
        shapes.where(F.size(geom) > 0)
        .groupBy(F.col(geom).alias("geom"))
        .agg(F.collect_set(id_column).alias("ids")),
        "distinct",
    )
    pairs = overlap_pairs(distinct, min_overlap, cell_m)
    both_ways = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("ids_a").alias("ids"), F.col("ids_b").alias("partners")),
                F.struct(F.col("ids_b").alias("ids"), F.col("ids_a").alias("partners")),
            )
        ).alias("p"),
        "ratio",
    ).select("p.ids", "p.partners", "ratio")
    copies = distinct.where((F.size("ids") > 1) & (F.lit(1.0) > min_overlap)).select(
        "ids", F.col("ids").alias("partners"), F.lit(1.0).alias("ratio")
    )
    hits = (
        both_ways.unionByName(copies)
        .select(F.explode("ids").alias(id_column), "partners", "ratio")
        .withColumn("partners", F.array_remove("partners", F.col(id_column)))
        .where(F.size("partners") > 0)
    )
    return hits.groupBy(id_column).agg(
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("partners")))), ";"
        ).alias("overlap_ids"),
        F.bround(F.max("ratio"), 2).alias("percentage_overlap"),
    )


def partners_per_id(
    df: DataFrame,
    id_column: str,
    min_overlap: float = 0.1,
    buffer_m: float = -5.0,
    eligible: Column | None = None,
    geom: str = "geom",
    cell_m: float = 80.0,
) -> DataFrame:
    """Overlap result per id.

    ``eligible`` is a predicate on the unbuffered rows; it runs below the
    self-join. The zone of the plane comes from the bounds of all rows.
    """
    test = F.lit(True) if eligible is None else eligible
    plane = table_plane(df.select(id_column, geom, test.alias("_ok")), geom, "_plane", F.col("_ok"))
    shrunk = add_buffer(plane.select(id_column, "_plane"), "_plane", "_plane", buffer_m)
    return overlap_partners(shrunk, id_column, "_plane", min_overlap, cell_m)


def validate_overlap(
    df: DataFrame,
    id_column: str,
    min_overlap: float = 0.1,
    buffer_m: float = -5.0,
    eligible: Column | None = None,
    geom: str = "geom",
    cell_m: float = 80.0,
) -> DataFrame:
    """Add ``overlap_ids`` and ``percentage_overlap`` (a ratio) to every row."""
    partners = partners_per_id(df, id_column, min_overlap, buffer_m, eligible, geom, cell_m)
    others = [c for c in df.columns if c != id_column]
    return join_per_key(df, partners, [id_column], others).withColumn(
        "overlap_ids", F.coalesce("overlap_ids", F.lit(""))
    )
