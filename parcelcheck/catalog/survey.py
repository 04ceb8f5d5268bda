"""Vegetation levels derived from the driver tables, and the queries on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcheck.catalog import frames as X
from parcelcheck.catalog.registry import query, scaled
from parcelcheck.operators.skew import first_per_key, group_median
from parcelcheck.operators.slices import write_packed
from parcelcheck.plans import layers
from parcelcheck.plans import vegetation as V
from parcelcheck.session import remove_staged, staging_path
from parcelcheck.sources.forms import read_levels, rename_keys

START, END = "1997-01-01", "1998-06-30"

PLOTS = """SELECT 'P' || cast(o_orderkey AS string) AS KEY, o_orderdate AS SubmissionDate, o_orderdate AS starttime,
    'Enum ' || cast(o_custkey % 40 AS string) AS enumerator, cast(o_custkey % 16 AS int) AS measured_subplots,
    o_orderpriority AS dbh_method, o_orderstatus AS dbh_unit, 'pole' AS height_method
  FROM orders"""

SUBPLOTS = """SELECT 'P' || cast(l_orderkey AS string) AS PARENT_KEY,
    'S' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS KEY,
    CASE WHEN min(l_suppkey) % 3 = 0 THEN NULL ELSE 'comment ' || cast(min(l_suppkey) % 5 AS string) END AS subplot_comments,
    'trace ' || cast(min(l_partkey) AS string) AS gt_subplot
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""

LINE_KEY = """cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' ||
    cast(l_partkey AS string) || '-' || cast(l_suppkey AS string)"""

# Gaps between the levels are rows whose parent is unknown: null, or a key that no parent has.
VEGETATION = f"""SELECT CASE WHEN l_partkey % 8 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 'lost ' || {LINE_KEY}
      ELSE 'S' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) END AS PARENT_KEY,
    'V' || {LINE_KEY} AS KEY,
    CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN 0 ELSE cast(l_quantity AS bigint) END AS vegetation_type_number,
    CASE WHEN l_suppkey % 4 = 0 THEN cast(l_quantity AS bigint) END AS coverage_vegetation,
    CASE WHEN l_suppkey % 4 = 0 THEN 'nonwoody_coverage' ELSE 'woody' END AS vegetation_type_woody,
    CASE l_partkey % 5 WHEN 1 THEN 'palms' WHEN 2 THEN 'bamboo' ELSE 'trees' END AS vegetation_species_type,
    CASE WHEN l_partkey % 7 = 0 THEN 'yes_groupbelow1.3' WHEN l_partkey % 7 = 3 THEN 'no_coverage' ELSE 'no' END AS vegetation_type_youngtree,
    CASE WHEN l_linenumber % 2 = 0 THEN 'yes_primary_group' ELSE 'no' END AS vegetation_type_primary,
    'nw ' || cast(l_partkey % 9 AS string) AS non_woody_species,
    CASE WHEN l_partkey % 3 = 0 THEN 'other' ELSE 'sp ' || cast(l_partkey % 50 AS string) END AS woody_species,
    'ban ' || cast(l_partkey % 4 AS string) AS banana_species,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 5 = 1 THEN 'Other' ELSE 'named ' || cast(l_partkey % 30 AS string) END AS other_species,
    'lang ' || cast(l_suppkey % 3 AS string) AS language_other_species,
    CASE WHEN l_suppkey % 2 = 0 THEN 'crop ' || cast(l_partkey % 6 AS string) END AS crop_comments
  FROM lineitem"""


def counted(source: str, name: str, n: str, div: str) -> str:
    """Rows of ``source`` n times, numbered from 1, in either dialect."""
    if div == "div":
        return f"{source} LATERAL VIEW explode(sequence(1, cast({n} AS int))) t_{name} AS {name}"
    return f"{source}, unnest(range(1, 1 + {n})) AS t_{name}({name})"


# Whole halves of metres and centimetres keep every median exact.
def measurement_sql(div: str) -> str:
    return f"""SELECT CASE WHEN l_suppkey % 14 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN 'lost ' || {LINE_KEY}
      ELSE 'V' || {LINE_KEY} END AS PARENT_KEY, 'M' || {LINE_KEY} || '-' || cast(j AS string) AS KEY,
    CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE (1 + (l_partkey + 7 * j) % 16) * CASE WHEN j = 5 THEN 5e0 ELSE 0.5e0 END END AS tree_height_m,
    cast(1990 + l_partkey % 30 AS int) AS tree_year_planted,
    CASE WHEN l_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS tree_prune, (l_partkey % 5) * 0.5e0 AS prune_height,
    CASE WHEN l_suppkey % 3 = 0 THEN 'yes' ELSE 'no' END AS tree_coppiced,
    CASE WHEN l_suppkey % 3 = 0 THEN (1 + (l_partkey + 3 * j) % 12) * CASE WHEN j = 4 THEN 4e0 ELSE 0.5e0 END END AS coppiced_height,
    cast((l_partkey + j) % 30 AS bigint) AS nr_stems_bh, cast((l_partkey + 2 * j) % 30 AS bigint) AS nr_stems_10cm
  FROM {counted("lineitem", "j", "(2 + l_suppkey % 4)", div)}"""


def circumference_sql(div: str) -> str:
    return f"""SELECT 'M' || {LINE_KEY} || '-' || cast(j AS string) AS PARENT_KEY,
    'C' || {LINE_KEY} || '-' || cast(j AS string) || '-' || cast(c AS string) AS KEY,
    (1 + (l_partkey + 5 * c) % 40) * CASE WHEN c = 3 THEN 6e0 ELSE 1e0 END AS circumference_bh,
    (1 + (l_partkey + 5 * c) % 50) * 2e0 AS circumference_10cm
  FROM {counted(counted("lineitem", "j", "2", div), "c", "(1 + l_suppkey % 3)", div)}"""


LEVELS_SQL = f"""WITH plots AS MATERIALIZED ({PLOTS}), subplots AS MATERIALIZED ({SUBPLOTS}), vegetation AS MATERIALIZED ({VEGETATION}),
measurement AS MATERIALIZED ({measurement_sql('//')}), circumference AS MATERIALIZED ({circumference_sql('//')}),
m_plots AS MATERIALIZED (SELECT p.KEY AS PLOT_KEY, p.* EXCLUDE (KEY), s.KEY AS SUBPLOT_KEY, s.subplot_comments, s.gt_subplot
            FROM plots p JOIN subplots s ON p.KEY = s.PARENT_KEY
            WHERE cast(p.SubmissionDate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'),
m_veg AS MATERIALIZED (SELECT m.*, v.KEY AS VEGETATION_KEY, v.* EXCLUDE (KEY, PARENT_KEY) FROM m_plots m JOIN vegetation v ON m.SUBPLOT_KEY = v.PARENT_KEY),
m_mea AS MATERIALIZED (SELECT m.*, x.KEY AS MEASUREMENT_KEY, x.* EXCLUDE (KEY, PARENT_KEY) FROM m_veg m JOIN measurement x ON m.VEGETATION_KEY = x.PARENT_KEY),
m_cir AS MATERIALIZED (SELECT m.*, c.KEY AS CIRCUMFERENCE_KEY, c.* EXCLUDE (KEY, PARENT_KEY) FROM m_mea m JOIN circumference c ON m.MEASUREMENT_KEY = c.PARENT_KEY)
"""

PARTS = {
    "plots": (PLOTS, "orders"),
    "subplots": (SUBPLOTS, "lineitem"),
    "vegetation": (VEGETATION, "lineitem"),
    "measurement": (measurement_sql("div"), "lineitem"),
    "circumference": (circumference_sql("div"), "lineitem"),
}


def raw_level(spark, sf, name: str) -> DataFrame:
    sql, table = PARTS[name]
    return X._views(spark, sf, sql, (table,))


def levels(spark, sf, columns: Sequence[str] | None = None) -> V.Levels:
    five = {n: rename_keys(raw_level(spark, sf, n), n) for n in PARTS}
    return V.join_levels(
        five["plots"], five["subplots"], five["vegetation"], five["measurement"], five["circumference"], START, END, columns=columns
    )


@query("p10_period", f"WITH p AS ({PLOTS}) SELECT KEY FROM p WHERE cast(SubmissionDate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'")
def p10(spark, sf):
    return V.in_period(raw_level(spark, sf, "plots"), START, END).select("KEY")


@query("s2_linked_levels", LEVELS_SQL + "SELECT PLOT_KEY, SUBPLOT_KEY, VEGETATION_KEY, MEASUREMENT_KEY, CIRCUMFERENCE_KEY FROM m_cir")
def s2(spark, sf):
    """Five files as a survey server exports them, read and linked."""
    paths = {name: staging_path(spark, f"level-{name}") for name in PARTS}
    for name, path in paths.items():
        write_packed(raw_level(spark, sf, name), path)
    five = read_levels(spark, paths)

    def finished(n: int) -> None:
        for name in [*PARTS][:n]:
            remove_staged(spark, paths[name])

    linked = V.join_levels(*[five[name] for name in PARTS], START, END, columns=[], finished=finished)
    return linked.circumference.select("PLOT_KEY", "SUBPLOT_KEY", "VEGETATION_KEY", "MEASUREMENT_KEY", "CIRCUMFERENCE_KEY")


@query("j4_plots_subplots", LEVELS_SQL + "SELECT PLOT_KEY, SUBPLOT_KEY, enumerator, subplot_comments FROM m_plots")
def j4(spark, sf):
    return levels(spark, sf).plots.select("PLOT_KEY", "SUBPLOT_KEY", "enumerator", "subplot_comments")


@query(
    "j5_level_chain",
    LEVELS_SQL
    + "SELECT 'veg' AS level, count(*) AS n FROM m_veg UNION ALL SELECT 'mea', count(*) FROM m_mea UNION ALL SELECT 'cir', count(*) FROM m_cir",
)
def j5(spark, sf):
    lv = levels(spark, sf)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n")
    return count(lv.vegetation, "veg").unionByName(count(lv.measurement, "mea")).unionByName(count(lv.circumference, "cir"))


# Every fifth plot and a third of the subplots have no partner.
LOOSE_PLOT = "CASE WHEN cast(substr(KEY, 2) AS bigint) % 5 = 0 THEN 'lost ' || KEY ELSE KEY END"
LOOSE_PARENT = "CASE WHEN length(KEY) % 3 = 0 THEN NULL ELSE PARENT_KEY END"


@query(
    "j6_full_outer",
    f"""WITH p AS ({PLOTS}), s AS ({SUBPLOTS}),
q AS (SELECT {LOOSE_PLOT} AS KEY, enumerator, dbh_method FROM p), t AS (SELECT KEY, {LOOSE_PARENT} AS PARENT_KEY, gt_subplot FROM s)
SELECT q.enumerator, q.dbh_method, t.KEY AS subplot_id, t.gt_subplot FROM q FULL OUTER JOIN t ON q.KEY = t.PARENT_KEY""",
)
def j6(spark, sf):
    plots = raw_level(spark, sf, "plots").withColumn("KEY", F.expr(LOOSE_PLOT))
    subplots = raw_level(spark, sf, "subplots").withColumn("PARENT_KEY", F.expr(LOOSE_PARENT))
    out = layers.join_plots_subplots(plots, subplots.withColumnRenamed("KEY", "subplot_id"))
    return out.select("enumerator", "dbh_method", "subplot_id", "gt_subplot")


@query(
    "q1_tool_audit",
    LEVELS_SQL
    + """SELECT PLOT_KEY, enumerator, cast(measured_subplots AS BIGINT) AS measured_subplots, dbh_method, dbh_unit, height_method
FROM (SELECT *, row_number() OVER (PARTITION BY PLOT_KEY ORDER BY SUBPLOT_KEY) AS r FROM m_plots) t WHERE r = 1""",
)
def q1(spark, sf):
    return V.tool_audit(levels(spark, sf).plots).withColumn(
        "measured_subplots", F.col("measured_subplots").cast("long")
    )


@query(
    "w4_first_per_group",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) t WHERE r = 1""",
)
def w4(spark, sf):
    rows = X.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return first_per_key(rows, ["o_custkey"], ["o_orderkey"])


NO_VEG = "SELECT enumerator, SUBPLOT_KEY, subplot_comments FROM m_plots m WHERE NOT EXISTS (SELECT 1 FROM m_veg v WHERE v.SUBPLOT_KEY = m.SUBPLOT_KEY)"


@query("j7_without_vegetation", LEVELS_SQL + "SELECT SUBPLOT_KEY FROM m_plots m WHERE NOT EXISTS (SELECT 1 FROM m_veg v WHERE v.SUBPLOT_KEY = m.SUBPLOT_KEY)")
def j7(spark, sf):
    lv = levels(spark, sf)
    return V.without(lv.plots, lv.vegetation, "SUBPLOT_KEY").select("SUBPLOT_KEY")


@query("q2_no_vegetation_report", LEVELS_SQL + NO_VEG)
def q2(spark, sf):
    lv = levels(spark, sf)
    return V.subplots_without_vegetation(lv.plots, lv.vegetation)


@query(
    "a1_density",
    LEVELS_SQL
    + """SELECT SUBPLOT_KEY, cast(coalesce(sum(vegetation_type_number), 0) AS BIGINT) AS vegetation_type_number,
 cast(coalesce(sum(coverage_vegetation), 0) AS BIGINT) AS coverage_vegetation, string_agg(DISTINCT enumerator, ';') AS enumerator,
 count(DISTINCT coalesce(subplot_comments, '?')) AS comments FROM m_veg GROUP BY SUBPLOT_KEY""",
)
def a1(spark, sf):
    return V.density(levels(spark, sf).vegetation).select(
        "SUBPLOT_KEY",
        "vegetation_type_number",
        "coverage_vegetation",
        F.array_join("enumerator", ";").alias("enumerator"),
        F.size("subplot_comments").cast("long").alias("comments"),
    )


MISSING = "SELECT enumerator, SUBPLOT_KEY, subplot_comments, crop_comments, non_woody_species, coverage_vegetation FROM m_veg m WHERE NOT EXISTS (SELECT 1 FROM m_mea x WHERE x.SUBPLOT_KEY = m.SUBPLOT_KEY)"
ONLY = "(SELECT SUBPLOT_KEY FROM m_veg GROUP BY SUBPLOT_KEY HAVING coalesce(sum(vegetation_type_number), 0) = 0)"


@query("j8_missing_measurements", LEVELS_SQL + MISSING)
def j8(spark, sf):
    lv = levels(spark, sf)
    return V.missing_measurements(lv.vegetation, lv.measurement)


@query(
    "q3_coverage_counts",
    LEVELS_SQL + f"SELECT (SELECT count(*) FROM {ONLY} t) AS coverage_only, (SELECT count(DISTINCT SUBPLOT_KEY) FROM ({MISSING}) u) AS missing_measurements",
)
def q3(spark, sf):
    lv = levels(spark, sf)
    return V.coverage_against_missing(lv.vegetation, lv.measurement)


REVERTED = f"SELECT SUBPLOT_KEY, string_agg(DISTINCT enumerator, ';') AS enumerator FROM m_veg r WHERE SUBPLOT_KEY IN {ONLY} AND NOT EXISTS (SELECT 1 FROM ({MISSING}) u WHERE u.SUBPLOT_KEY = r.SUBPLOT_KEY) GROUP BY SUBPLOT_KEY"


@query("j9_reverted", LEVELS_SQL + f"SELECT SUBPLOT_KEY FROM ({REVERTED}) r")
def j9(spark, sf):
    lv = levels(spark, sf)
    missing = V.missing_measurements(lv.vegetation, lv.measurement)
    return V.without(V.coverage_only(lv.vegetation), missing, "SUBPLOT_KEY")


@query("q4_reverted_report", LEVELS_SQL + REVERTED)
def q4(spark, sf):
    lv = levels(spark, sf)
    return V.reverted_answers(lv.vegetation, lv.measurement).withColumn(
        "enumerator", F.array_join("enumerator", ";")
    )


NAMED = "vegetation_type_number IS NOT NULL AND other_species IS NOT NULL"
OUT = "enumerator, SUBPLOT_KEY, other_species, language_other_species, vegetation_type_number"


@query("q5_primary_other", LEVELS_SQL + f"SELECT {OUT} FROM m_veg WHERE vegetation_type_primary = 'yes_primary_group' AND woody_species = 'other' AND {NAMED}")
def q5(spark, sf):
    return V.primary_other(levels(spark, sf).vegetation)


@query("q6_young_other", LEVELS_SQL + f"SELECT {OUT} FROM m_veg WHERE vegetation_type_youngtree = 'yes_groupbelow1.3' AND woody_species = 'other' AND {NAMED}")
def q6(spark, sf):
    return V.young_other(levels(spark, sf).vegetation)


@query("q7_non_primary_other", LEVELS_SQL + f"SELECT {OUT} FROM m_veg WHERE vegetation_type_primary = 'no' AND woody_species = 'other' AND {NAMED}")
def q7(spark, sf):
    return V.named_other(V.non_primary(levels(spark, sf).vegetation))


@query("q8_palms_other", LEVELS_SQL + f"SELECT {OUT}, vegetation_species_type FROM m_veg WHERE vegetation_species_type = 'palms' AND {NAMED}")
def q8(spark, sf):
    return V.named_other(V.species_group(levels(spark, sf).vegetation, V.PALMS), ["vegetation_species_type"])


@query("q9_bamboo_other", LEVELS_SQL + f"SELECT {OUT}, vegetation_species_type FROM m_veg WHERE vegetation_species_type = 'bamboo' AND {NAMED}")
def q9(spark, sf):
    return V.named_other(V.species_group(levels(spark, sf).vegetation, V.BAMBOO), ["vegetation_species_type"])


COVER = "(vegetation_type_woody = 'nonwoody_coverage' OR vegetation_type_youngtree = 'no_coverage')"


@query(
    "q10_coverage_other",
    LEVELS_SQL + f"SELECT enumerator, SUBPLOT_KEY, other_species, language_other_species, coverage_vegetation FROM m_veg WHERE {COVER} AND other_species IS NOT NULL",
)
def q10(spark, sf):
    return V.coverage_other(levels(spark, sf).vegetation)


def _share_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS kind, cast(floor(100000.0 * sum(CASE WHEN other_species IS NOT NULL THEN vegetation_type_number END)
 / sum(vegetation_type_number) + 0.5) AS BIGINT) AS share FROM m_veg WHERE {where}"""


@query(
    "a5_other_shares",
    LEVELS_SQL
    + " UNION ALL ".join(
        [
            _share_sql("trees", "vegetation_type_primary = 'no' AND woody_species = 'other'"),
            _share_sql("palms", "vegetation_species_type = 'palms'"),
            _share_sql("bamboo", "vegetation_species_type = 'bamboo'"),
            f"SELECT 'coverage', cast(floor(100000.0 * count(other_species) / count(*) + 0.5) AS BIGINT) FROM m_veg WHERE {COVER}",
        ]
    ),
)
def a5(spark, sf):
    veg = levels(spark, sf).vegetation
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), scaled(F.col("other_share")).alias("share"))
    return (
        row(V.other_share(V.non_primary(veg)), "trees")
        .unionByName(row(V.other_share(V.species_group(veg, V.PALMS)), "palms"))
        .unionByName(row(V.other_share(V.species_group(veg, V.BAMBOO)), "bamboo"))
        .unionByName(row(V.coverage_other_share(veg), "coverage"))
    )


HALF = "CASE WHEN l_orderkey % 2 = 0 THEN -1 WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_suppkey END"


@query(
    "a4_hot_median",
    f"SELECT {HALF} AS grp, median(CASE WHEN l_linenumber <> 7 THEN cast(l_quantity AS DOUBLE) END) AS m FROM lineitem GROUP BY 1",
)
def a4_hot(spark, sf):
    """One key holds half of the rows, others have few; one key is null."""
    rows = X.table(spark, sf, "lineitem").select(
        F.expr(HALF).alias("grp"), F.expr("CASE WHEN l_linenumber <> 7 THEN cast(l_quantity AS DOUBLE) END").alias("v")
    )
    return group_median(rows, ["grp"], "v", "m")


@query(
    "a4_group_medians",
    LEVELS_SQL
    + "SELECT VEGETATION_KEY, cast(floor(median(tree_height_m) * 1000 + 0.5) AS BIGINT) AS median_height FROM m_mea GROUP BY VEGETATION_KEY",
)
def a4(spark, sf):
    med = group_median(levels(spark, sf).measurement, ["VEGETATION_KEY"], "tree_height_m", "m")
    return med.select("VEGETATION_KEY", scaled(F.col("m")).alias("median_height"))


def _outlier_sql(rows: str, key: str, value: str, columns: str, extra: str = "true") -> str:
    return f"""SELECT {columns}, cast(floor({value} * 1000 + 0.5) AS BIGINT) AS value, cast(floor(med * 1000 + 0.5) AS BIGINT) AS median,
 CASE WHEN {value} > med * 4 THEN 'outlier' ELSE 'ok' END AS "Upper_outliers",
 CASE WHEN {value} < med / 4 THEN 'outlier' ELSE 'ok' END AS "Lower_outliers"
 FROM (SELECT *, median({value}) OVER (PARTITION BY {key}) AS med FROM {rows}) t WHERE {extra}"""


def _outliers(df: DataFrame, value: str, median: str, *columns: str) -> DataFrame:
    return df.select(
        *columns, scaled(F.col(value)).alias("value"), scaled(F.col(median)).alias("median"), "Upper_outliers", "Lower_outliers"
    )


@query("q11_height_outliers", LEVELS_SQL + _outlier_sql("m_mea", "VEGETATION_KEY", "tree_height_m", "enumerator, VEGETATION_KEY"))
def q11(spark, sf):
    return _outliers(V.height_check(levels(spark, sf).measurement), "tree_height_m", "median_height", "enumerator", "VEGETATION_KEY")


@query("w6_group_outliers", LEVELS_SQL + _outlier_sql("m_mea", "VEGETATION_KEY", "tree_height_m", "VEGETATION_KEY, SUBPLOT_KEY"))
def w6(spark, sf):
    # A low threshold: on the smallest tables both median paths run.
    return _outliers(
        V.height_check(levels(spark, sf).measurement, hot_rows=4), "tree_height_m", "median_height", "VEGETATION_KEY", "SUBPLOT_KEY"
    )


@query("q11_tall_trees", LEVELS_SQL + _outlier_sql("m_mea", "VEGETATION_KEY", "tree_height_m", "enumerator, VEGETATION_KEY", "tree_height_m > 25"))
def q11_tall(spark, sf):
    return _outliers(V.tall_trees(levels(spark, sf).measurement), "tree_height_m", "median_height", "enumerator", "VEGETATION_KEY")


@query("q12_coppice_outliers", LEVELS_SQL + _outlier_sql("m_mea", "VEGETATION_KEY", "coppiced_height", "enumerator, VEGETATION_KEY"))
def q12(spark, sf):
    return _outliers(V.coppice_check(levels(spark, sf).measurement), "coppiced_height", "median_coppiced", "enumerator", "VEGETATION_KEY")


@query("q13_many_stems", LEVELS_SQL + "SELECT enumerator, VEGETATION_KEY, woody_species, nr_stems_bh, nr_stems_10cm FROM m_mea WHERE nr_stems_bh > 20")
def q13(spark, sf):
    return V.many_stems(levels(spark, sf).measurement).select(
        "enumerator", "VEGETATION_KEY", "woody_species", "nr_stems_bh", "nr_stems_10cm"
    )


@query("q14_circumference_outliers", LEVELS_SQL + _outlier_sql("m_cir", "MEASUREMENT_KEY", "circumference_bh", "enumerator, MEASUREMENT_KEY"))
def q14(spark, sf):
    lv = levels(spark, sf, V.CIRCUMFERENCE_COLUMNS)
    return _outliers(V.circumference_check(lv.circumference, lv.written), "circumference_bh", "median_cir", "enumerator", "MEASUREMENT_KEY")


@query("q14_thick_bh", LEVELS_SQL + _outlier_sql("m_cir", "MEASUREMENT_KEY", "circumference_bh", "enumerator, MEASUREMENT_KEY", "circumference_bh > 90"))
def q14_bh(spark, sf):
    lv = levels(spark, sf, V.CIRCUMFERENCE_COLUMNS)
    return _outliers(V.thick_trees(lv.circumference, written=lv.written), "circumference_bh", "median_cir", "enumerator", "MEASUREMENT_KEY")


@query("q14_thick_10cm", LEVELS_SQL + _outlier_sql("m_cir", "MEASUREMENT_KEY", "circumference_bh", "enumerator, MEASUREMENT_KEY", "circumference_10cm > 90"))
def q14_10cm(spark, sf):
    lv = levels(spark, sf, V.CIRCUMFERENCE_COLUMNS)
    return _outliers(
        V.thick_trees(lv.circumference, "circumference_10cm", lv.written), "circumference_bh", "median_cir", "enumerator", "MEASUREMENT_KEY"
    )


@query(
    "a8_vegetation_totals",
    LEVELS_SQL
    + """SELECT SUBPLOT_KEY, cast(coalesce(sum(vegetation_type_number), 0) AS BIGINT) AS total_vegetation,
 cast(CASE WHEN count(*) FILTER (WHERE lower(other_species) = 'other') > 0
   THEN coalesce(sum(vegetation_type_number) FILTER (WHERE lower(other_species) = 'other'), 0) END AS BIGINT) AS other_vegetation
 FROM m_veg GROUP BY SUBPLOT_KEY""",
)
def a8(spark, sf):
    return V.vegetation_totals(levels(spark, sf).vegetation)


@query("a7_distinct_keys", LEVELS_SQL + "SELECT DISTINCT SUBPLOT_KEY FROM m_veg")
def a7(spark, sf):
    return levels(spark, sf).vegetation.select("SUBPLOT_KEY").distinct()


@query(
    "w2_duplicate_ids",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicate_id FROM lineitem""",
)
def w2(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
    )
    return layers.flag_duplicate_ids(rows, "id", ["l_partkey", "l_suppkey"]).drop("id")
