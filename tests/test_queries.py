"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
# One query per operator family; tools/check.py compares all of them.
CHOSEN = [
    "p1_trace_parse",
    "g1_validity",
    "g5_zero_buffer",
    "g8_replacements",
    "g14_protruding",
    "g18_erode",
    "j1_ecoregion",
    "j2_country",
    "j6_full_outer",
    "a1_density",
    "w1_row_numbers",
    "w2_duplicate_ids",
    "w6_group_outliers",
    "p9_tree_columns",
    "s1_form_versions",
    "v7_quarantine",
    "s6_write_layer",
    "r1_mean_ndvi",
    "r4_road_distance",
    "v5_subplot_layer",
]


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = db.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in res.description], res.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts_reasons(spark):
    assert entry.entry(spark).count() == 5


def test_erosion_takes_every_shape(spark):
    """Every order's shape has a row; concave traces give what they gave alone."""
    from parcelcheck.catalog import frames as X
    from parcelcheck.catalog import polygons

    sf = "/root/testdata/sf0.001"
    got = {r.k: r for r in polygons.g18_nonconvex(spark, sf).collect()}
    ids = {r.k for r in X.shapes(spark, sf).select("k").collect()}
    assert set(got) == ids and len({k % 12 for k in got}) == 12
    concave = [r for k, r in got.items() if k % 12 == 9]
    assert concave and all(r.parts > 0 and r.eroded_cm > 0 for r in concave)
    assert any(r.parts > 0 for k, r in got.items() if k % 12 != 9)
