"""Levels joined and labelled slice by slice give the rows of the whole step."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from parcelcheck import session
from parcelcheck.operators import slices
from parcelcheck.plans import vegetation as V


def level(spark, rng, parents, n, prefix, schema, extra):
    """Rows whose parent is known, null or lost; some rows come twice."""
    rows = [(rng.choice([*parents, None, "lost"]), f"{prefix}{i}" if i % 9 else None, *extra(i)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], f"PARENT string, KEY string, {schema}"), [r[1] for r in rows if r[1]]


@pytest.fixture(scope="module")
def five(spark):
    rng = random.Random(3)
    day = datetime.datetime
    rows = [(f"P{i}", day(1997, 1 + i % 12, 1), f"e{i % 3}") for i in range(30)] + [(None, day(1997, 5, 1), "e")]
    plots = spark.createDataFrame(rows, "PLOT_KEY string, SubmissionDate timestamp_ntz, enumerator string")
    keys, out = [f"P{i}" for i in range(30)], [plots]
    for name, above, n, schema, extra in (
        ("SUBPLOT", "PLOT", 60, "gt_subplot string", lambda i: ("t",)),
        ("VEGETATION", "SUBPLOT", 120, "vegetation_type_number long, woody_species string", lambda i: (i, "w")),
        ("MEASUREMENT", "VEGETATION", 200, "tree_year_planted int, tree_prune string", lambda i: (i, "yes")),
        ("CIRCUMFERENCE", "MEASUREMENT", 900, "circumference_bh double, circumference_10cm double", lambda i: (i % 50 / 2, 2.0)),
    ):
        df, keys = level(spark, rng, keys, n, name[0], schema, extra)
        out.append(df.withColumnsRenamed({"PARENT": f"{above}_KEY", "KEY": f"{name}_KEY"}))
    return out


def sorted_rows(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("nulls_match", [False, True])
def test_levels_by_slices(spark, five, nulls_match, monkeypatch):
    columns = [*V.CIRCUMFERENCE_COLUMNS, "PLOT_KEY", "SUBPLOT_KEY", "CIRCUMFERENCE_KEY"]
    whole = V.join_levels(*five, "1997-01-01", "1997-08-31", nulls_match)
    removed = []
    monkeypatch.setattr(V, "remove_staged", lambda spark, path: (removed.append(path), session.remove_staged(spark, path)))
    finished = []
    linked = V.join_levels(
        *five, "1997-01-01", "1997-08-31", nulls_match, columns=V.CIRCUMFERENCE_COLUMNS, slice_rows=70, finished=finished.append
    )
    assert linked.written and not whole.written and len(removed) == 3 and finished == [3, 4, 5]
    want = sorted_rows(whole.circumference, columns)
    assert len(want) > 50 and sorted_rows(linked.circumference, columns) == want
    # one slice: a lazy plan as before
    small = V.join_levels(*five, "1997-01-01", "1997-08-31", nulls_match, columns=V.CIRCUMFERENCE_COLUMNS)
    assert not small.written and sorted_rows(small.circumference, columns) == want


def test_outliers_by_slices(spark):
    """A hot key, null keys and values, rows that come twice."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", None, *(f"k{i}" for i in range(40))]), rng.choice([None, rng.uniform(0, 90)]), i % 7) for i in range(800)]
    frame = spark.createDataFrame(rows + rows[:20], "k string, v double, other long")
    whole = V.with_outliers(frame, "k", "v", "m")
    parts = V.with_outliers(frame, "k", "v", "m", hot_rows=20, slice_rows=150)
    assert parts.dtypes == whole.dtypes
    assert sorted_rows(parts, whole.columns) == sorted_rows(whole, whole.columns)
    assert {"outlier", "ok"} == {r[0] for r in parts.select("Lower_outliers").distinct().collect() if r[0]}
    staged = session.stage(frame, "there")
    assert sorted_rows(V.with_outliers(staged, "k", "v", "m", written=True, slice_rows=400), whole.columns) == sorted_rows(whole, whole.columns)


def test_slices_are_written_one_after_the_other(spark):
    """No shuffle file of a slice is there when the next begins."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager
    rows, seen = spark.range(4000).withColumn("k", F.col("id") % 97), []

    def step(i):
        spark._jvm.Thread.sleep(500)
        seen.append(files().getAllFiles().size())
        return slices.slice_of(rows, "k", 4, i).groupBy("k").count()

    out = slices.by_slices(4, step, "counted")
    assert out.count() == 97 and out.agg(F.sum("count")).first()[0] == 4000
    assert max(seen[1:]) <= seen[0]
