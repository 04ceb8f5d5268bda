"""Skewed keys, numbering, joins and rules on small fixtures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from parcelcheck import params as C
from parcelcheck.functions import project, trace
from parcelcheck.functions import rings as R
from parcelcheck.operators import overlap, skew
from parcelcheck.operators.steps import StepLog
from parcelcheck.plans import layers, reports, roads, rules, vegetation


def test_group_median_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([None, rng.uniform(-5, 50)])) for _ in range(3000)]
    rows += [(f"k{i % 400}", rng.uniform(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in skew.group_median(df, ["k"], "v", "m").collect()}
    for key in {k for k, _ in rows}:
        assert got[key] == pytest.approx(statistics.median(v for k, v in rows if k == key and v is not None))


def test_hot_keys_get_parts_by_their_counts(spark):
    """One key of half the rows, a thousand middle keys, a null key."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, -1).when(F.col("id") % 19 == 1, None).otherwise(F.col("id") % 1999).alias("k"), "id"
    )
    hot = {r["k"]: r["_salts"] for r in skew.hot_keys(rows, ["k"], 100).collect()}
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert hot == {k: -(-n // 100) for k, n in counts.items() if n > 100} and hot[-1] == 100
    names = rows.where("k is not null").select("k").distinct().withColumn("name", F.col("k") * 2)
    out = skew.join_per_key(rows, names, ["k"], ["id"], hot_rows=100)
    assert out.count() == 20_000 and out.columns == ["k", "id", "name"]
    assert out.where("not (name <=> k * 2)").count() == 0


def test_parts_grow_where_keys_would_be_too_many(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    assert skew.hot_keys(rows, ["k"], 10).count() == 0
    assert skew.hot_keys(rows.where("k < 3"), ["k"], 10).count() == 3


@pytest.mark.parametrize("files", [3, 900])
def test_numbers_follow_source_and_position(spark, files):
    rows = [(f"f{i % files}", i) for i in range(1800)] + [(None, 5), ("f1", None)]
    df = spark.createDataFrame(rows, "src string, ix long").repartition(7)
    numbered = skew.number_rows(df, "src", "ix", "n")
    got = {(r["src"], r["ix"]): r["n"] for r in numbered.collect()}
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    assert got == {key: n for n, key in enumerate(sorted(rows, key=order), 1)}


def squares(spark, rows):
    def ring(x, y, a):
        return [[[{"x": px, "y": py} for px, py in ((x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y))]]]

    return spark.createDataFrame([(i, ring(x, y, a)) for i, x, y, a in rows], f"id string, geom {R.GEOM_DDL}")


def test_overlaps_equal_brute_force_in_a_crowded_cell(spark):
    rng = random.Random(4)
    rows = [(f"s{i}", rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 9)) for i in range(150)]
    rows += [("copy1", 5.0, 5.0, 4.0), ("copy2", 5.0, 5.0, 4.0)]
    df = squares(spark, rows)
    shapes = df.groupBy("geom").agg(F.collect_set("id").alias("ids"))
    pairs = overlap.overlap_pairs(shapes, 0.2, 25.0, block=10).collect()
    got = {frozenset((a, b)) for r in pairs for a in r["ids_a"] for b in r["ids_b"]}
    assert len(pairs) == len({(tuple(r["ids_a"]), tuple(r["ids_b"])) for r in pairs})
    want = set()
    for n, (i, x, y, a) in enumerate(rows):
        for j, u, v, b in rows[:n]:
            w, h = min(x + a, u + b) - max(x, u), min(y + a, v + b) - max(y, v)
            if w > 0 and h > 0 and w * h / min(a, b) ** 2 > 0.2 and {i, j} != {"copy1", "copy2"}:
                want.add(frozenset((i, j)))
    assert got == want
    partners = {r["id"]: r["overlap_ids"].split(";") for r in overlap.overlap_partners(df, "id", "geom", 0.2, 25.0).collect()}
    assert "copy2" in partners["copy1"] and "copy1" not in partners["copy1"]
    for pair in want:
        i, j = sorted(pair)
        assert j in partners[i] and i in partners[j]


def test_shortest_paths_with_a_hub(spark):
    import heapq

    rng = random.Random(9)
    links = [(0, i, rng.randint(1, 90)) for i in range(1, 80)]
    links += [(rng.randint(0, 120), rng.randint(0, 120), rng.randint(1, 40)) for _ in range(300)]
    best, queue = {7: 0}, [(0, 7)]
    while queue:
        d, n = heapq.heappop(queue)
        for a, b, w in links:
            if a == n and d + w < best.get(b, 10**9):
                best[b] = d + w
                heapq.heappush(queue, (d + w, b))
    edges = spark.createDataFrame(links, "src long, dst long, length_m long")
    source = spark.createDataFrame([(7,)], "node_id long")
    got = roads.shortest_paths(edges, source, block_links=10)
    assert {r["node_id"]: r["length_m"] for r in got.collect()} == best


def test_paths_from_a_hub_nothing_leads_to(spark):
    edges = spark.createDataFrame([(0, i, i) for i in range(1, 60)], "src long, dst long, length_m long")
    source = spark.createDataFrame([(0,)], "node_id long")
    got = roads.shortest_paths(edges, source, block_links=7)
    assert {r["node_id"]: r["length_m"] for r in got.collect()} == {i: i for i in range(60)}


def test_nearest_node_equals_brute_force(spark):
    rng = random.Random(2)
    nodes = [(i, rng.uniform(70, 75), rng.uniform(10, 30)) for i in range(60)]
    points = [(i, rng.uniform(70, 75), rng.uniform(10, 30)) for i in range(80)]
    got = roads.nearest_nodes(
        spark.createDataFrame(points, "point_id long, lon double, lat double"),
        spark.createDataFrame(nodes, "node_id long, lon double, lat double"),
        leaf=4,
    )
    import math

    for r in got.collect():
        _, x, y = points[r["point_id"]]
        best = min(nodes, key=lambda n: ((n[1] - x) * math.cos(math.radians(y))) ** 2 + (n[2] - y) ** 2)
        assert r["node_id"] == best[0]
    assert got.count() == 80


def test_join_refuses_repeated_plot_keys(spark):
    plots = spark.createDataFrame([("a", 1), ("a", 2)], "KEY string, v int")
    subplots = spark.createDataFrame([("a", "s")], "PARENT_KEY string, subplot_id string")
    with pytest.raises(Exception, match="not 1:m"):
        layers.join_plots_subplots(plots, subplots).collect()


def test_null_keys_match_only_on_request(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 3), ("a", 4)], "k string, y int")
    assert vegetation.inner(left, right, "k").count() == 1
    assert vegetation.inner(left, right, "k", nulls_match=True).count() == 2


def test_reason_ladder(spark):
    df = squares(spark, [("a", 0.0, 0.0, 1.0)]).select(
        "geom",
        F.lit("b").alias("overlap_ids"),
        F.lit(True).alias("duplicate_id"),
        F.lit(False).alias("in_country"),
        F.lit(None).cast("boolean").alias("in_radius"),
        F.lit(800.0).alias("area_m2"),
        F.lit(True).alias("nr_vertices_too_small"),
        F.lit(True).alias("protruding_ratio_too_big"),
    )
    row = df.select(rules.reason_list(C.SUBPLOTS_V1).alias("r")).first()["r"]
    assert row == [
        "Overlapping polygons",
        "Duplicate plot id",
        "Boundary not in country",
        "Plot outside of radius",
        "Plot too big",
        "Nr vertices <= 3",
        "Plot is protruding",
    ]
    empty = df.withColumn("geom", R.empty_geom()).select(rules.reason_list(C.SUBPLOTS_V1).alias("r"))
    assert empty.first()["r"] == ["Empty geometry"]
    invalid = df.select(rules.reason_list(C.SUBPLOTS_V1, valid=F.lit(False)).alias("r"))
    assert invalid.first()["r"] == ["Invalid geometry"]


def test_totals_of_an_empty_layer(spark):
    row = reports.validity_totals(spark.createDataFrame([], "valid boolean")).first()
    assert (row["total"], row["valid_pct"], row["invalid_pct"]) == (0, 0.0, 0.0)


def test_nearest_nodes_of_far_points_and_without_nodes(spark):
    points = spark.createDataFrame(
        [("near", 0.001, 0.001), ("far", 120.0, -60.0), ("none", None, 1.0), ("off", 1.0, 95.0)],
        "point_id string, lon double, lat double",
    )
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.5)], "node_id long, lon double, lat double")
    got = {r.point_id: r.node_id for r in roads.nearest_nodes(points, nodes).collect()}
    assert got == {"near": 1, "far": 1}
    assert roads.nearest_nodes(points, nodes.limit(0)).count() == 0


def test_far_points_meet_the_edge_of_a_town_only(spark):
    """A dense town, a twin node, many nodes on one spot; no point meets more than a few leaves."""
    import math

    rng = random.Random(5)
    nodes = [(i, 10 + rng.gauss(0, 0.01), 50 + rng.gauss(0, 0.01)) for i in range(1500)]
    nodes += [(5000, nodes[3][1], nodes[3][2]), (6000, -20.0, -20.0)] + [(7000 + i, 11.0, 51.0) for i in range(100)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(60)] + [(99, 11.0, 51.0), (98, nodes[3][1], nodes[3][2])]
    frame = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    got = {r.point_id: r.node_id for r in roads.nearest_nodes(spark.createDataFrame(points, "point_id long, lon double, lat double"), frame, leaf=16).collect()}
    for i, x, y in points:
        d = lambda n: math.hypot((n[1] - x) * math.cos(math.radians(y)), n[2] - y)
        assert abs(d(next(n for n in nodes if n[0] == got[i])) - min(map(d, nodes))) < 1e-12
    assert got[99] == 7000 and got[98] == 3
    tree = roads.node_tree(frame.select("node_id", F.col("lon").alias("nlon"), F.col("lat").alias("nlat")), 16).collect()
    leaves = [r for r in tree if r.leaf]
    assert sum(r.n for r in leaves) == len(nodes)
    assert all(r.n <= 16 or r.level == roads.DEPTH for r in leaves) and max(r.n for r in leaves) == 100


def test_points_meet_only_the_nodes_in_reach_of_their_group(spark, monkeypatch):
    """A town of points and nodes, a ring of nodes round a far point; lists are cut, points come twice."""
    import math

    rng = random.Random(7)
    nodes = [(i, 10 + rng.uniform(0, 0.5), 50 + rng.uniform(0, 0.5)) for i in range(800)]
    nodes += [(900, nodes[5][1], nodes[5][2]), (None, nodes[6][1], nodes[6][2])]
    nodes += [(1000 + i, -60 + math.cos(i / 10), math.sin(i / 10)) for i in range(62)]
    points = [(i % 590, 10 + rng.uniform(0, 0.5), 50 + rng.uniform(0, 0.5)) for i in range(600)]
    points += [points[0], (None, 10.2, 50.2), (700, -60.0, 0.0), (701, nodes[5][1], nodes[5][2]), (702, nodes[6][1], nodes[6][2])]
    written, staged = {}, roads._staged

    def seen(rows, label):
        path, back = staged(rows, label)
        written[label] = back.selectExpr("group", "size(near) AS n").collect() if label == "near-nodes" else back.count()
        return path, back

    monkeypatch.setattr(roads, "_staged", seen)
    monkeypatch.setattr(roads, "_LISTED", 8)
    frame = spark.createDataFrame(points, "point_id long, lon double, lat double")
    got = roads.nearest_nodes(frame, spark.createDataFrame(nodes, "node_id long, lon double, lat double"), leaf=16).collect()
    want = []
    for k, x, y in set(points):
        shrink = math.cos(math.radians(y))
        d = lambda n: math.sqrt(((n[1] - x) * shrink) ** 2 + (n[2] - y) ** 2)
        want.append((k, min(nodes, key=lambda n: (d(n), n[0] is not None, n[0] or 0))[0]))
    far = [g for g in got if g.point_id == 700]
    assert len(far) == 1 and far[0].node_id >= 1000
    known = lambda rows: sorted((str(k), str(n)) for k, n in rows if k != 700)
    assert known(got) == known(want)
    town = [r.n for r in written["near-nodes"]]
    assert sum(town) < 5 * len(set(r.group for r in written["near-nodes"])) + 62 and max(town) < 30


def test_steps_leave_no_shuffle_files(spark, tmp_path):
    """The files of a step go with it, those of other actions stay."""
    from parcelcheck.session import drop_shuffles, stage

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    before = shuffles().size()
    with drop_shuffles(spark):
        assert spark.conf.get(name) == "true"
        rows.write.parquet(str(tmp_path / "a"))
    staged = stage(rows, "seventh")
    assert spark.conf.get(name) == "false" and staged.count() == 7
    spark._jvm.Thread.sleep(500)
    left = shuffles().size()
    rows.write.parquet(str(tmp_path / "b"))
    assert left <= before and shuffles().size() > left


def test_paths_cross_blocks_and_come_back(spark):
    """A grid of roads in blocks of a few links; lengths equal one walk over the whole graph."""
    rng = random.Random(11)
    n = 12
    links = []
    for x in range(n):
        for y in range(n):
            for u, v in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)):
                if 0 <= u < n and 0 <= v < n and rng.random() < 0.8:
                    links.append((x * n + y, u * n + v, rng.random() * 5))
    links += [(3, 3, 1.0), (5, None, 1.0), (None, 4, 1.0), (6, 7, None)]
    places = [(x * n + y, 20 + x * 0.01, 40 + y * 0.01) for x in range(n) for y in range(n)]
    best, queue = {0: 0.0}, [0]
    while queue:
        a = queue.pop(0)
        for u, v, w in links:
            if u == a and v is not None and w is not None and best[a] + w < best.get(v, 1e9):
                best[v] = best[a] + w
                queue.append(v)
    edges = spark.createDataFrame(links, "src long, dst long, length_m double")
    source = spark.createDataFrame([(0,)], "node_id long")
    got = roads.shortest_paths(edges, source, spark.createDataFrame(places, "node_id long, lon double, lat double"), block_links=90)
    got = {r.node_id: r.length_m for r in got.collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in got)
    nowhere = roads.shortest_paths(edges, source.where("node_id > 5"))
    assert nowhere.count() == 0 and roads.shortest_paths(edges.limit(0), source).count() == 1


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1, 2) for k in range(60)], "src long, dst long, length_m long")
    source = spark.createDataFrame([(0,)], "node_id long")
    got = {r.node_id: r.length_m for r in roads.shortest_paths(edges, source, block_links=8).collect()}
    assert got == {k: 2 * k for k in range(61)}


def test_median_of_null_keys_and_null_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", -2.0), ("b", 0.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in skew.group_median(df, ["k"], "v", "m").collect()}
    assert got == {None: 2.0, "a": None, "b": 0.0}


def test_trace_of_the_cell_limit(spark):
    vertex = "0.5000 0.5000 0 1;0.5000 0.5010 0 1;0.5010 0.5010 0 1;"
    text = (vertex * 1000)[: C.TRACE_CELL_LIMIT - 20].rsplit(";", 1)[0]
    text += ";" + "0.5 0.5 0 ".ljust(C.TRACE_CELL_LIMIT - len(text) - 1, "1")
    assert len(text) == C.TRACE_CELL_LIMIT
    row = spark.createDataFrame([(text,)], "t string").select(
        F.size(trace.trace_polygon(F.col("t"))).alias("kept"),
        F.size(trace.trace_polygon(F.col("t"), cell_limit=C.TRACE_CELL_LIMIT)).alias("dropped"),
        trace.cut_at_limit(F.col("t")).alias("cut"),
    ).first()
    assert (row.kept, row.dropped, row.cut) == (1, 0, True)


def test_no_distance_between_antipodes(spark):
    row = spark.range(1).select(
        project.geodesic_distance(F.lit(0.0), F.lit(0.0), F.lit(179.7), F.lit(0.3)).alias("far"),
        project.geodesic_distance(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(10.0)).alias("fine"),
        project.geodesic_distance(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("same"),
    ).first()
    assert row.far is None and row.fine > 9e6 and row.same == 0.0


def test_step_log(spark):
    log = StepLog()
    rows = spark.range(10).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    log.run("one", rows, F.col("v").isNull(), F.col("v") > 4)
    log.run("two", rows.limit(0), F.col("v").isNull())
    got = [tuple(r)[:5] for r in log.table(spark).collect()]
    assert got == [("one", 10, 2, 5, 2), ("two", 0, 2, 0, 0)]
