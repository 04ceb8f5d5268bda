"""Whole batches of rings against the column expressions, row by row."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelcheck import params as C
from parcelcheck.catalog import polygons as G
from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.operators import long_rings as L
from parcelcheck.operators import measure as M
from parcelcheck.operators import outline as O
from parcelcheck.operators import overlap as V
from parcelcheck.operators import repair as E
from parcelcheck.operators import ring_batches as B
from parcelcheck.plans import roads
from parcelcheck.session import spread


def odd_shapes(count=600):
    random.seed(3)
    rows = []
    for k in range(count):
        n, m = random.choice([0, 1, 2, 3, 4, 5, 6, 8, 10]), random.choice([3, 5, 50, 1000])
        ring = [(random.randint(0, m) / 7, random.randint(0, m) / 7) for _ in range(n)]
        if k % 3 == 0:
            ring = [(math.cos(6.28 * i / n) * random.choice([1, 1, 0.5]), math.sin(6.28 * i / n)) for i in range(n)]
        if ring and k % 10:
            ring.append(ring[0])
        if ring and k % 5 == 0:
            ring.insert(1, ring[0])
        geom = None if k % 50 == 1 else [[ring]] if ring else []
        if geom and k % 11 == 0:
            geom = [[ring, [(x * 0.3, y * 0.3) for x, y in ring]]]
        if geom and k % 13 == 0:
            geom = geom + [[[(x + 5, y) for x, y in ring]]]
        rows.append((k, geom))
    return rows


def test_batches_agree_with_the_column_expressions(spark):
    df = spark.createDataFrame(odd_shapes(), f"k int, geom {R.GEOM_DDL}")
    g = F.col("geom")
    both = df.select(
        "k",
        F.struct(R.is_valid(g), R.min_rectangle(R.vertices(g)), R.moments(R.edges(g)), R.area(g)).alias("old"),
        F.struct(L.is_valid(g), L.min_rectangle(R.vertices(g)), L.moments(g), L.area_and_reach(g)["area"]).alias("new"),
        E.out_of_bounds(g).alias("out"),
        E.beyond_bounds(L.area_and_reach(g)).alias("beyond"),
        F.flatten(F.flatten(P.to_utm(g, F.lit(31), F.lit(False)))).alias("plane"),
        F.flatten(F.flatten(L.to_utm(g, F.lit(31), F.lit(False)))).alias("batch"),
    ).collect()
    assert [r.k for r in both if tuple(r.old) != tuple(r.new) or bool(r.out) != bool(r.beyond)] == []
    for r in both:
        assert (r.plane is None) == (r.batch is None)
        for p, q in zip(r.plane or [], r.batch or [], strict=True):
            assert math.hypot(p.x - q.x, p.y - q.y) < 1e-6


def test_a_batch_is_taken_in_bounded_slices_without_python_objects():
    ring = pa.array([[{"x": float(i), "y": float(i * i)} for i in range(900)]] * 2)
    many = pa.ListArray.from_arrays(pa.array(range(0, 2001), pa.int32()), pa.chunked_array([ring] * 1000).combine_chunks())
    values = pa.ListArray.from_arrays(pa.array(range(2001), pa.int32()), many)
    sizes = [len(B.shapes(part)[0]) for part in B.slices(values, 3)]
    assert sum(sizes) == 900 * 2000 and max(sizes) <= B.SLICE_VERTICES and len(sizes) > 1


def test_slices_keep_nulls_and_single_large_rows(monkeypatch):
    monkeypatch.setattr(B, "SLICE_VERTICES", 3)
    rows = [[[[{"x": 0.0, "y": 0.0}] * 5]], None, [], [[[{"x": 1.0, "y": 0.0}] * 2]], [[[{"x": 2.0, "y": 0.0}]]]]
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    parts = list(B.slices(pa.array(rows, kind), 3))
    assert sum((p.to_pylist() for p in parts), []) == rows


def test_many_segments_cut_each_other_across_blocks(monkeypatch):
    points = np.array([(math.cos(2.4 * i), math.sin(2.4 * i)) for i in range(40)])
    seg = np.hstack((points, np.roll(points, -1, axis=0)))
    whole = O._cut(seg, 1e-9)
    monkeypatch.setattr(O, "_TOGETHER", 7)
    assert len(whole) > 40 and np.array_equal(O._cut(seg, 1e-9), whole)


def test_road_distance_over_the_whole_network(spark):
    """A chain that leaves the working area and ends far from it."""
    square = lambda x: [[[(x, 5.0), (x + 0.001, 5.0), (x + 0.001, 5.001), (x, 5.001), (x, 5.0)]]]
    plots = spark.createDataFrame([("near", square(73.0)), ("far", square(79.0))], f"plot_id string, geom {R.GEOM_DDL}")
    nodes = spark.createDataFrame([(i, 73.0 + i, 5.0) for i in range(7)], "node_id long, lon double, lat double")
    links = spark.createDataFrame([(i, i + 1, 1000) for i in range(6)], "src long, dst long, length_m long")
    out = roads.road_distance(plots, nodes, links, 73.0, 5.0, reach_m=None)
    assert {r.plot_id: (r.node_id, r.road_distance_km) for r in out.collect()} == {"near": (0, 0.0), "far": (6, 6.0)}


def near(a, b):
    if a is None or b is None or isinstance(a, bool):
        return a == b
    if isinstance(a, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-6 * max(1.0, abs(b))
    return len(a) == len(b) and all(map(near, a, b))


def test_measures_of_one_pass_are_those_of_the_single_steps(spark):
    rows = odd_shapes()
    ring = [(0.0, 0.0), (0.002, 0.0), (0.002, 0.001), (0.0, 0.001), (0.0, 0.0)]
    at = lambda x, y, n=1: [[[(x + n * a, y + n * b) for a, b in ring]]]
    places = [(4.0, 60.0), (8.0, 75.0), (15.0, 75.0), (25.0, 75.0), (40.0, 75.0), (73.0, -9.0), (200.0, 5.0), (5.0, 86.0), (-179.999, 0.0)]
    rows += [(1000 + k, at(x, y)) for k, (x, y) in enumerate(places)]
    rows += [(2000, at(73.0, 9.0) + at(73.01, 9.0, 3)), (2001, [[]]), (2002, [[ring, []]]), (2003, [[[(1.0, 1.0)]]]), (2004, at(1.0, 1.0, 0))]
    df = spark.createDataFrame(rows, f"k int, geom {R.GEOM_DDL}").withColumn("original_vertices", F.lit(0))
    for spec in (C.SUBPLOTS_V1, C.SUBPLOTS_V2):
        steps = M.add_rectangle(M.add_area(M.with_own_plane(df), spec.generation), spec.geodesic)
        steps = M.add_in_radius(M.add_protruding_ratio(M.add_length_width_ratio(steps, spec), spec), spec)
        kept = ["k", "area_m2", "length_width_ratio", "mrr_ratio", "in_radius", "protruding_ratio_too_big"]
        old = {r.k: tuple(r)[1:] for r in steps.select(*kept).collect()}
        new = {r.k: tuple(r)[1:] for r in M.measure(df, spec).select(*kept).collect()}
        # of equal rectangles rounding picks one; its sides are not compared
        loose = [k for k in old if not near(old[k][:1] + old[k][2:], new[k][:1] + new[k][2:])]
        assert loose == [] and old.keys() == new.keys()


def test_repair_and_measures_take_two_passes(spark, tmp_path):
    """Each pass is a Python process beside every running task."""
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, date'2024-01-01' AS o_orderdate, 'x' AS o_orderpriority FROM range(100)").write.parquet(f"{tmp_path}/orders.parquet")
    for spec in (C.SUBPLOTS_V1, C.SUBPLOTS_V2):
        plan = G.measured(spark, str(tmp_path), spec)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2


def test_simplification_takes_one_pass_and_keeps_odd_shapes(spark):
    df = spark.createDataFrame(odd_shapes(), f"k int, geom {R.GEOM_DDL}")
    out = E.simplify_geometry(df, 1.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    before, after = ({r.k: r.geom for r in d.collect()} for d in (df, out))
    assert all((g is None) == (after[k] is None) and len(g or []) == len(after[k] or []) for k, g in before.items())


def test_large_tables_are_dealt_to_tasks_of_bounded_size(spark):
    """However few slots there are, a task's share stays the same."""
    slots = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 100 * slots, 1, slots)
    assert spread(rows, 1000).rdd.getNumPartitions() == slots
    dealt = spread(rows, 10)
    assert dealt.rdd.getNumPartitions() == 10 * slots and dealt.count() == 100 * slots


def test_rings_shrunk_together_are_those_shrunk_one_by_one(spark):
    random.seed(5)
    rows = odd_shapes(300)
    for k in range(300):
        n, r = random.choice([3, 4, 5, 8, 12]), random.choice([4, 6, 30])
        turns = sorted(random.random() for _ in range(n))
        ring = [(r * math.cos(6.28 * a), r * math.sin(6.28 * a)) for a in turns[:: 1 if k % 2 else -1]]
        rows.append((1000 + k, [[ring + ring[:1]]]))
    df = spark.createDataFrame(rows, f"k int, geom {R.GEOM_DDL}")
    # a crossed ring has no inside to keep: only valid shapes are buffered
    df = df.where(L.is_valid(F.col("geom")) & (R.area(F.col("geom")) > 0))
    # a side of no length stopped the column expression; it moves nothing
    points = R.vertices(F.col("geom"))
    df = df.where(F.size(F.array_distinct(points)) == F.size(points) - F.size(F.flatten("geom")))
    alone = F.when((F.size("geom") == 1) & (F.size(F.col("geom")[0]) == 1), R.orient(F.col("geom"))[0][0])
    old = O.shrink_convex(alone, 2.0)
    out = O.add_buffer(df, "geom", "new", -2.0).select("k", "new", R.is_convex(alone).alias("convex"), old.alias("old")).collect()
    convex = [r for r in out if r.convex]
    assert len(convex) > 300 and [r.k for r in convex if r.old != r.new] == []
    assert [r.k for r in out if r.new is None] == []


def test_a_side_without_length_shrinks_nothing(spark):
    square = [(0.0, 0.0), (20.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, [[square]])], f"k int, geom {R.GEOM_DDL}")
    out = O.add_buffer(df, "geom", "new", -5.0).select(R.area(F.col("new")).alias("a")).first()
    assert out.a == 100.0


def test_shapes_of_the_overlap_test_are_made_once(spark):
    """The join reads them several times; none of them comes from the table it was given."""
    square = lambda x: [[[(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0), (x, 0.0)]]]
    made = spark.sparkContext.accumulator(0)

    def seen(k):
        made.add(1)
        return k

    rows = spark.createDataFrame([("a", square(0.0)), ("b", square(5.0)), ("c", square(50.0))], f"id string, geom {R.GEOM_DDL}")
    counted = rows.withColumn("id", F.udf(seen, "string")("id"))
    out = V.overlap_partners(counted, "id", "geom", 0.1, 80.0).collect()
    assert {r.id: r.overlap_ids for r in out} == {"a": "b", "b": "a"} and made.value == 3
