"""Distances from one point to plots: straight and along roads."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelcheck.functions import project as P
from parcelcheck.operators.measure import with_centroid
from parcelcheck.operators.skew import join_per_key
from parcelcheck.session import drop_shuffles, remove_staged, staging_path

REACH_M = 10_000.0
#: Nodes of a leaf of the node tree, and its depth; a leaf of the last level holds one place.
LEAF_NODES, DEPTH = 64, 24
#: Links of a block of the road graph, about.
BLOCK_LINKS = 100_000
#: Cells of so many levels are few enough to broadcast: 4 to this power.
_FEW_LEVELS = 7
#: Points are grouped by cells so many levels below the leaves of the node tree.
_GROUP_LEVELS = 2
#: Nodes in a list of the nodes near a group of points, about.
_LISTED = 512


def crow_distance(plots: DataFrame, lon: float, lat: float) -> DataFrame:
    """Kilometres from a point to every centroid; NULL for empty shapes."""
    c = F.col("centroid")
    return (
        with_centroid(plots)
        .withColumn(
            "distance_km",
            F.when(
                c.isNotNull(),
                P.geodesic_distance(F.lit(lon), F.lit(lat), c["cx"], c["cy"]) / 1000,
            ),
        )
        .drop("centroid")
    )


def working_area(plots: DataFrame, lon: float, lat: float) -> DataFrame:
    """One row: mean of all plot centroids and the point."""
    c = F.col("centroid")
    return with_centroid(plots).agg(
        ((F.coalesce(F.sum(c["cx"]), F.lit(0.0)) + lon) / (F.count(c["cx"]) + 1)).alias("lon"),
        ((F.coalesce(F.sum(c["cy"]), F.lit(0.0)) + lat) / (F.count(c["cy"]) + 1)).alias("lat"),
    )


def network_near(
    nodes: DataFrame, edges: DataFrame, area: DataFrame, reach_m: float = REACH_M
) -> tuple[DataFrame, DataFrame]:
    """Nodes within reach of the area centre and the edges between them."""
    lon, lat = area.select("lon").scalar(), area.select("lat").scalar()
    kept = (
        nodes.withColumn("_lon", lon)
        .withColumn("_lat", lat)
        .where(P.short_distance(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) <= reach_m)
        .drop("_lon", "_lat")
    )
    ids = kept.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    )
    return kept, inside


def _staged(rows: DataFrame, label: str) -> tuple[str, DataFrame]:
    path = staging_path(rows.sparkSession, label)
    with drop_shuffles(rows.sparkSession):
        rows.write.parquet(path)
    return path, rows.sparkSession.read.schema(rows.schema).parquet(path)


def _cell(level: Column, lon: str = "nlon", lat: str = "nlat") -> Column:
    """Number of the cell of a place at a level; a cell's parent is its number shifted right by two.

    Longitude and latitude are cut into 2^level columns and rows of the globe,
    and their bits are interleaved behind a leading one.
    """

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0xFFFF0000FFFF), (8, 0xFF00FF00FF00FF), (4, 0xF0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    steps = float(1 << DEPTH)
    last = F.lit((1 << DEPTH) - 1)
    column = F.least(F.floor((F.col(lon) + 360) / 720 * steps), last)
    row = F.least(F.floor((F.col(lat) + 90) / 180 * steps), last)
    deepest = spread(column).bitwiseOR(F.shiftleft(spread(row), 1)).bitwiseOR(F.lit(1 << 2 * DEPTH))
    return F.call_function("shiftright", deepest, (2 * (F.lit(DEPTH) - level)).cast("int"))


def node_tree(nodes: DataFrame, leaf: int = LEAF_NODES) -> DataFrame:
    """``(cell, parent, level, n, box)`` of all cells of a quadtree but the root.

    Counts of all levels come from one grouping that combines on the map side.
    A cell of more than ``leaf`` nodes is split unless it is on the last level.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")
    placed = nodes.select("nlon", "nlat", level).withColumn("cell", _cell(F.col("level")))
    cells = placed.groupBy("cell", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("nlon").alias("w"),
        F.min("nlat").alias("s"),
        F.max("nlon").alias("e"),
        F.max("nlat").alias("t"),
    )
    split = cells.where(F.col("n") > leaf).select(F.col("cell").alias("parent"))
    inner = cells.where("level > 0").withColumn("parent", F.shiftright("cell", 2)).join(split, "parent", "left_semi")
    # a tree of few nodes has its first level as leaves
    first = cells.where("level = 1").withColumn("parent", F.shiftright("cell", 2))
    tree = inner.where("level > 1").unionByName(first)
    return tree.withColumn("leaf", (F.col("n") <= leaf) | (F.col("level") == DEPTH))


def _box_distance(far: bool) -> Column:
    """No less than (or no more than) this lie the points of a group from the nodes of a cell, in the plane.

    Both are boxes; longitudes are shrunk by the least (or greatest) cosine among the group's latitudes.
    """
    ends = F.cos(F.radians("gs")), F.cos(F.radians("gt"))
    if far:
        dx = F.greatest(F.col("e") - F.col("gw"), F.col("ge") - F.col("w"))
        dy = F.greatest(F.col("t") - F.col("gs"), F.col("gt") - F.col("s"))
        shrink = F.when((F.col("gs") <= 0) & (F.col("gt") >= 0), F.lit(1.0)).otherwise(F.greatest(*ends))
    else:
        dx = F.greatest(F.col("w") - F.col("ge"), F.col("gw") - F.col("e"), F.lit(0.0))
        dy = F.greatest(F.col("s") - F.col("gt"), F.col("gs") - F.col("t"), F.lit(0.0))
        shrink = F.least(*ends)
    dx = dx * shrink
    return F.sqrt(dx * dx + dy * dy)


def _within_reach(front: DataFrame) -> DataFrame:
    """Rows of a group that begin no farther than the least far end of its rows."""
    # a margin, because corners and nodes are computed apart
    reach = F.min("high").over(Window.partitionBy("group")) * (1 + 1e-9) + 1e-12
    return front.withColumn("_reach", reach).where("low <= _reach").drop("_reach")


def nearest_nodes(points: DataFrame, nodes: DataFrame, leaf: int = LEAF_NODES) -> DataFrame:
    """Nearest road node of every point (``point_id, lon, lat``), ties by node id.

    Points without a place on the globe have no row, and none has one if there
    are no nodes; every other point gets its node however far it is. Distances
    are planar, with longitudes shrunk at the latitude of the point.

    Points are grouped by small cells, and the groups go down a quadtree of the
    nodes level by level. The nearest node of a point is no farther than the
    far corner of the box of any cell left to its group, so only cells whose
    box begins within the least such distance are split further, and of the
    nodes of the leaves only those that begin within it are kept. Points are
    then dealt once, to the nodes left to their group.
    """
    spark = nodes.sparkSession
    known = nodes.select("node_id", F.col("lon").alias("nlon"), F.col("lat").alias("nlat")).where(
        (F.abs("lat") <= 90) & (F.abs("lon") <= 360)
    )
    asked = points.select("point_id", "lon", "lat").where((F.abs("lat") <= 90) & (F.abs("lon") <= 360))
    tree_path, tree = _staged(node_tree(known, leaf), "node-tree")
    leaves = tree.where("leaf")
    # leaves of crowded spots lie deeper than most others
    deepest, usual = tree.agg(F.max("level"), F.percentile_approx(F.when(F.col("leaf"), F.col("level")), 0.9)).first()
    if deepest is None:
        return spark.createDataFrame([], T.StructType([points.schema["point_id"], nodes.schema["node_id"]]))
    place = ["point_id", "lon", "lat"]
    level = F.lit(min(DEPTH, usual + _GROUP_LEVELS))
    points_path, placed = _staged(asked.withColumn("group", _cell(level, "lon", "lat")), "points")
    box = ["gw", "gs", "ge", "gt"]
    groups = placed.groupBy("group").agg(
        F.min("lon").alias("gw"), F.min("lat").alias("gs"), F.max("lon").alias("ge"), F.max("lat").alias("gt")
    )
    root = F.lit(1).cast("long").alias("cell")
    front = groups.select("group", *box, root, F.lit(False).alias("leaf"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    for level in range(1, deepest + 1):
        below = tree.where(F.col("level") == level).select("parent", F.col("cell").alias("below"), F.col("leaf").alias("last"), "w", "s", "e", "t")
        if level <= _FEW_LEVELS:
            below = F.broadcast(below)  # 4 ** level cells at most
        met = front.join(below, (F.col("cell") == F.col("parent")) & ~F.col("leaf"), "left")
        is_new = F.col("below").isNotNull()
        front = met.select(
            "group",
            *box,
            F.coalesce("below", "cell").alias("cell"),
            F.coalesce("last", "leaf").alias("leaf"),
            F.when(is_new, _box_distance(False)).otherwise(F.col("low")).alias("low"),
            F.when(is_new, _box_distance(True)).otherwise(F.col("high")).alias("high"),
        )
        front = _within_reach(front)
    # of the nodes at one place the first by id is the nearest
    homes = (
        known.groupBy("nlon", "nlat")
        .agg(F.min(F.struct("node_id")).alias("first"))
        .select("first.node_id", "nlon", "nlat", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("level"))
        .withColumn("cell", _cell(F.col("level")))
        .join(leaves.select("cell"), "cell")
        .select("cell", "node_id", "nlon", "nlat")
    )
    met = front.select("group", *box, "cell").join(homes, "cell")
    met = met.withColumns({"w": F.col("nlon"), "s": F.col("nlat"), "e": F.col("nlon"), "t": F.col("nlat")})
    near = _within_reach(met.withColumn("low", _box_distance(False)).withColumn("high", _box_distance(True)))
    # lists of about _LISTED nodes: many nodes may lie equally far from a far group
    lists = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("group")) / _LISTED)
    left = (
        near.withColumn("_list", F.pmod(F.xxhash64("nlon", "nlat"), lists))
        .groupBy("group", "_list")
        .agg(F.collect_list(F.struct("node_id", "nlon", "nlat")).alias("near"))
        .drop("_list")
    )
    left_path, left = _staged(left, "near-nodes")
    shrink = F.cos(F.radians("lat"))

    def hit(n: Column) -> Column:
        d = F.sqrt(F.pow((n["nlon"] - F.col("lon")) * shrink, F.lit(2)) + F.pow(n["nlat"] - F.col("lat"), F.lit(2)))
        return F.struct(d.alias("d"), n["node_id"].alias("node_id"))

    best = (
        join_per_key(placed, left, ["group"], place)
        .select(*place, F.array_min(F.transform("near", hit)).alias("hit"))
        .groupBy(*place)
        .agg(F.min("hit").alias("hit"))
        .select("point_id", F.col("hit.node_id").alias("node_id"))
    )
    _, found = _staged(best, "nearest-nodes")
    for path in (tree_path, points_path, left_path):
        remove_staged(spark, path)
    return found


def link_blocks(edges: DataFrame, places: DataFrame | None = None, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Shortest link of every pair of nodes, with the block that holds it.

    Blocks are ranges of about ``block_links`` links along the cells of their
    source (``places``: node_id, lon, lat), so that neighbours mostly share
    one; without places, along the ids. The links of a hub go to several blocks.
    """
    shortest = (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("length_m").isNotNull())
        .groupBy("src", "dst")
        .agg(F.min("length_m").alias("length_m"))
    )
    if places is not None:
        at = places.select(F.col("node_id").alias("src"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat"))
        at = at.select("src", _cell(F.lit(DEPTH)).alias("place")).dropDuplicates(["src"])
        shortest = shortest.join(at, "src", "left")
    else:
        shortest = shortest.withColumn("place", F.lit(0))
    parts = max(1, -(-shortest.count() // block_links))
    dealt = shortest.repartitionByRange(parts, "place", "src", "dst")
    return dealt.select("src", "dst", "length_m", F.spark_partition_id().alias("block"))


def _walk_block(state: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Shortest paths inside one block from its fresh nodes on.

    ``state`` holds the known lengths of the block's nodes; returned are the
    nodes, here or in other blocks, that got shorter.
    """
    block = int(state["block"].iloc[0])
    links = links.sort_values("src", kind="stable")
    sources = links["src"].to_numpy()
    firsts = np.flatnonzero(np.concatenate(([True], sources[1:] != sources[:-1]))) if len(sources) else []
    ends = [*list(firsts[1:]), len(sources)]
    span = {sources[a]: (a, b) for a, b in zip(firsts, ends)}
    to, step = links["dst"].tolist(), links["length_m"].tolist()
    length = dict(zip(state["node_id"].tolist(), state["length_m"].tolist()))
    heap = [(length[n], n) for n, fresh in zip(state["node_id"].tolist(), state["fresh"].tolist()) if fresh]
    heapq.heapify(heap)
    shorter = {}
    while heap:
        so_far, node = heapq.heappop(heap)
        if so_far > length[node]:
            continue
        a, b = span.get(node, (0, 0))
        for k in range(a, b):
            new = so_far + step[k]
            old = length.get(to[k])
            if old is None or new < old:
                length[to[k]] = shorter[to[k]] = new
                heapq.heappush(heap, (new, to[k]))
    return pd.DataFrame({"node_id": list(shorter), "length_m": list(shorter.values()), "block": block})


def shortest_paths(
    edges: DataFrame, source: DataFrame, places: DataFrame | None = None, block_links: int = BLOCK_LINKS
) -> DataFrame:
    """Length of the shortest directed path from the source node to every node reached.

    ``source`` holds one ``node_id``; lengths must not be negative. The graph
    lies in blocks in the shared folder. A round takes the blocks with fresh
    nodes, whose length has changed elsewhere, and walks each of them to its end
    (one block is one task), so the number of rounds follows the blocks along a
    path, not its links. It stops when no block has a fresh node.
    """
    spark = edges.sparkSession
    kind = edges.schema["length_m"].dataType
    number = "long" if isinstance(kind, T.IntegralType) else "double"
    node = edges.schema["src"].dataType.simpleString()
    typed = edges.withColumn("length_m", F.col("length_m").cast(number))
    links_path = staging_path(spark, "road-links")
    links_schema = T.StructType.fromDDL(f"src {node}, dst {node}, length_m {number}, block int")
    # each task of the range shuffle is one block and writes one folder
    link_blocks(typed, places, block_links).write.partitionBy("block").parquet(links_path)
    links = spark.read.schema(links_schema).parquet(links_path)
    homes_path, homes = _staged(links.select(F.col("src").alias("node_id"), "block").distinct(), "road-homes")
    start = source.select("node_id", F.lit(0).cast(number).alias("length_m"))
    known_path, known = _staged(start.withColumn("origin", F.lit(-1)).withColumn("changed", F.lit(True)), "road-lengths")
    result = f"node_id {node}, length_m {number}, block int"
    while True:
        at_home = known.join(homes, "node_id")
        # a block that found a length itself has followed it already
        fresh = F.col("changed") & (F.col("origin") != F.col("block"))
        state = at_home.select("block", "node_id", "length_m", fresh.alias("fresh"))
        active = state.where("fresh").select("block").distinct()
        blocks = [r.block for r in active.collect()]  # one number for each BLOCK_LINKS links at most
        if not blocks:
            break
        chosen = F.col("block").isin(blocks)  # prunes the folders of other blocks
        walked = (
            state.where(chosen)
            .groupBy("block")
            .cogroup(links.where(chosen).groupBy("block"))
            .applyInPandas(_walk_block, result)
        )
        offers = walked.groupBy("node_id").agg(F.min(F.struct("length_m", "block")).alias("o"))
        merged = known.select("node_id", F.col("length_m").alias("old")).join(offers, "node_id", "full")
        better = F.col("o").isNotNull() & (F.col("old").isNull() | (F.col("o.length_m") < F.col("old")))
        now = merged.select(
            "node_id",
            F.when(better, F.col("o.length_m")).otherwise(F.col("old")).alias("length_m"),
            F.when(better, F.col("o.block")).otherwise(-1).alias("origin"),
            better.alias("changed"),
        )
        before = known_path
        known_path, known = _staged(now, "road-lengths")
        remove_staged(spark, before)
    remove_staged(spark, links_path)
    remove_staged(spark, homes_path)
    return known.select("node_id", F.col("length_m").cast(kind).alias("length_m"))


def road_distance(
    plots: DataFrame, nodes: DataFrame, edges: DataFrame, lon: float, lat: float, reach_m: float | None = REACH_M
) -> DataFrame:
    """Kilometres along roads between the nodes nearest the point and each plot.

    The network is that of the working area: nodes within ``reach_m`` of the
    mean of all plots and the point, and the links between them; the whole
    network where ``reach_m`` is None. Unreachable plots and empty shapes get
    NULL.
    """
    spark = plots.sparkSession
    kept, inside = nodes, edges
    if reach_m is not None:
        area_path, area = _staged(working_area(plots, lon, lat), "working-area")
        kept, inside = network_near(nodes, edges, area, reach_m)
    kept_path, kept = _staged(kept, "road-nodes")
    origin = spark.range(1).select(F.lit("origin").alias("point_id"), F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))
    start = nearest_nodes(origin, kept).select("node_id")
    c = F.col("centroid")
    centres = (
        with_centroid(plots)
        .where(c.isNotNull())
        .select(F.col("plot_id").alias("point_id"), c["cx"].alias("lon"), c["cy"].alias("lat"))
    )
    ends = nearest_nodes(centres, kept).withColumnRenamed("point_id", "plot_id")
    lengths = shortest_paths(inside, start, kept)
    remove_staged(spark, kept_path)
    return plots.join(
        ends.join(lengths, "node_id", "left").select(
            "plot_id", "node_id", (F.col("length_m") / 1000).alias("road_distance_km")
        ),
        "plot_id",
        "left",
    )
