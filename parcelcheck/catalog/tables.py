"""Queries on forms, files, reports, remote sensing and roads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelcheck.catalog import frames as X
from parcelcheck.catalog import polygons as G
from parcelcheck.catalog import sql as Q
from parcelcheck.catalog.registry import query, scaled
from parcelcheck.functions import project as P
from parcelcheck.functions import rings as R
from parcelcheck.functions.rings import settle
from parcelcheck.functions.trace import named_trace_polygon
from parcelcheck.operators import reshape as H
from parcelcheck.operators.skew import number_rows
from parcelcheck.operators.steps import StepLog
from parcelcheck.plans import layers, ndvi, reports, roads, rules
from parcelcheck.session import stage, staging_path
from parcelcheck.sources import forms as S
from parcelcheck.sources import sinks as W

# --- forms ----------------------------------------------------------------

FORM = X.form_sql(Q.DIV)
PLOT_ID = f"'{X.COUNTRY}_PartnerCo_' || strftime(starttime, '%Y%m%d') || '_' || enumerator_id || '_' || cast(n AS VARCHAR)"


def numbered(spark, sf) -> DataFrame:
    """Forms in three source files, numbered in file order."""
    rows = X.forms(spark, sf).withColumn("source_file", F.concat(F.lit("f"), (F.col("k") % 3).cast("string")))
    return H.number_forms(rows, X.COUNTRY, X.PARTNER, "source_file", "k")


NUMBERED = f"nf AS (SELECT *, row_number() OVER (ORDER BY k % 3, k) AS n FROM ({FORM}) f), ids AS (SELECT *, {PLOT_ID} AS plot_id FROM nf)"


@query(
    "w1_row_numbers",
    "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS n FROM orders",
)
def w1(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return number_rows(rows, "o_orderstatus", "k", "n").select("k", "n")


@query("p3_survey_ids", f"WITH {NUMBERED} SELECT k, plot_id FROM ids")
def p3(spark, sf):
    return numbered(spark, sf).select("k", "plot_id")


@query(
    "p3_plot_ids_parity",
    f"""WITH nf AS (SELECT *, row_number() OVER (ORDER BY k % 3, k) AS n FROM ({FORM}) f WHERE gt_plot IS NOT NULL)
SELECT {PLOT_ID} AS plot_id, enumerator || ' (' || enumerator_id || ')' AS enumerator,
 strftime(starttime, '%Y-%m-%d') AS collection_date, split_part(device_info, 'SurveyCTO', 1) AS device FROM nf""",
)
def p3_parity(spark, sf):
    rows = X.forms(spark, sf).withColumn("source_file", F.concat(F.lit("f"), (F.col("k") % 3).cast("string")))
    return H.plot_rows(rows, X.COUNTRY, X.PARTNER, "source_file", "k", same_numbers=False).select(
        "plot_id", "enumerator", "collection_date", "device"
    )


@query(
    "p4_enumerator_labels",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'Unknown' WHEN o_orderkey % 6 = 1 THEN 'open (' || cast(o_custkey AS VARCHAR)
 ELSE 'Enum ' || cast(o_custkey % 40 AS VARCHAR) END AS shown FROM orders""",
)
def p4(spark, sf):
    rows = X.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    label = (
        F.when(k % 6 == 0, F.lit(None))
        .when(k % 6 == 1, F.concat(F.lit("open ("), F.col("o_custkey").cast("string")))
        .otherwise(
            reports.enumerator_label(F.concat(F.lit("Enum "), (F.col("o_custkey") % 40).cast("string")), F.col("o_custkey"))
        )
    )
    return rows.select(k.alias("k"), label.alias("label")).select("k", reports.clean_enumerator(F.col("label")).alias("shown"))


@query(
    "p5_date_device",
    "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS collection_date, o_orderpriority AS device FROM orders",
)
def p5(spark, sf):
    return X.traces(spark, sf).select(
        "k", F.date_format("starttime", "yyyy-MM-dd").alias("collection_date"), H.device_prefix(F.col("device_info")).alias("device")
    )


UNPIVOT = " UNION ALL ".join(f"SELECT plot_id, {i} AS i, gt_subplot_{i} AS trace, starttime FROM ids" for i in range(1, 17))


@query(
    "p6_subplot_unpivot",
    f"""WITH {NUMBERED}, u AS ({UNPIVOT}) SELECT plot_id || '_' || cast(i AS VARCHAR) AS subplot_id,
 strftime(starttime, '%Y-%m-%d') AS collection_date, cast(coalesce(length(trace), 0) AS BIGINT) AS trace_length FROM u""",
)
def p6(spark, sf):
    return H.subplot_rows(numbered(spark, sf), "k", numbered=True).select(
        "subplot_id", "collection_date", F.coalesce(F.length("trace"), F.lit(0)).cast("long").alias("trace_length")
    )


def trees_sql(div: str) -> str:
    fields = []
    for s in (1, 2):
        for t in (1, 2):
            q = 3 * s + t
            fields += [
                f"CASE WHEN (k + {q}) % 4 = 0 THEN NULL ELSE cast((k + {q}) % 5 AS int) END AS nr_trees_{s}_{t}",
                f"'sp ' || cast((k + {q}) % 9 AS string) AS tree_plant_crop_species_{s}_{t}",
                f"CASE WHEN (k + {q}) % 3 = 0 THEN 'oth ' || cast(k % 7 AS string) END AS other_species_{s}_{t}",
                f"CASE WHEN (k + {q}) % 2 = 0 THEN (k % 20) * 0.5e0 END AS tree_height_m_{s}_{t}",
                f"(k % 10) * 0.25e0 AS crop_height_m_{s}_{t}",
                f"cast((k + {q}) % 12 AS int) AS nr_stems_{s}_{t}",
                f"cast((k + {q}) % 200 AS int) AS tree_circumference_cm_{s}_{t}",
                f"(k % 4) * 0.5e0 AS prune_heigth_{s}_{t}",
                f"cast((k + {q}) % 100 AS int) AS coverage_percentage_{s}_{t}",
                f"starttime AS tree_year_planted_{s}_{t}",
                f"'c ' || cast((k + {q}) % 3 AS string) AS tree_comments_{s}_{t}",
            ]
    return f"""SELECT k, 'P' || cast(k AS string) AS plot_id, starttime, enumerator AS enumerator_name, {", ".join(fields)}
    FROM ({X.shapes_sql(div)}) f"""


def tree_forms(spark, sf) -> DataFrame:
    return X._views(spark, sf, trees_sql("div"), ("orders",))


GROUPS = " UNION ALL ".join(
    f"""SELECT plot_id || '_{s}' AS subplot_id, nr_trees_{s}_{t} AS n, coalesce(other_species_{s}_{t}, tree_plant_crop_species_{s}_{t}) AS species,
 coalesce(tree_height_m_{s}_{t}, crop_height_m_{s}_{t}) AS h, tree_circumference_cm_{s}_{t} AS circ, nr_stems_{s}_{t} AS stems,
 strftime(tree_year_planted_{s}_{t}, '%Y') AS year, tree_comments_{s}_{t} AS comments FROM tf WHERE nr_trees_{s}_{t} IS NOT NULL"""
    for s in (1, 2)
    for t in (1, 2)
)
TREES = f"tf AS ({trees_sql(Q.DIV)}), g AS ({GROUPS})"


@query("p7_tree_groups", f"WITH {TREES} SELECT subplot_id, cast(n AS BIGINT) AS nr_trees, species, comments FROM g")
def p7(spark, sf):
    return H.tree_group_rows(tree_forms(spark, sf)).select(
        F.concat_ws("_", "plot_id", "subplot_nr").alias("subplot_id"),
        F.col("nr_trees").cast("long").alias("nr_trees"),
        F.coalesce("other_species", "group_species").alias("species"),
        "comments",
    )


@query("p8_repeat_rows", f"WITH {TREES} SELECT subplot_id, cast(n AS BIGINT) AS nr_trees, unnest(range(1, n + 1)) AS tree_nr FROM g WHERE n >= 1")
def p8(spark, sf):
    return H.repeat_trees(H.tree_group_rows(tree_forms(spark, sf))).select(
        F.concat_ws("_", "plot_id", "subplot_nr").alias("subplot_id"),
        F.col("nr_trees").cast("long").alias("nr_trees"),
        F.col("tree_nr").cast("long").alias("tree_nr"),
    )


TREE_OUT = f"""WITH {TREES}, r AS (SELECT *, unnest(range(1, n + 1)) AS i FROM g WHERE n >= 1)
SELECT subplot_id, species, year, {Q.scaled('h')} AS height_mm, {Q.scaled('circ / pi()')} AS diameter_um,
 {Q.scaled('stems * 1.0 / n')} AS avg_stems, cast(n AS BIGINT) AS nr_grouped_trees FROM r"""


def _tree_out(df: DataFrame) -> DataFrame:
    return df.select(
        "subplot_id",
        "species",
        "year",
        scaled(F.col("vegetation_height_m")).alias("height_mm"),
        scaled(F.col("diameter_cm")).alias("diameter_um"),
        scaled(F.col("avg_stems")).alias("avg_stems"),
        F.col("nr_grouped_trees").cast("long").alias("nr_grouped_trees"),
    )


@query("p9_tree_columns", TREE_OUT)
def p9(spark, sf):
    return _tree_out(H.tree_columns(H.repeat_trees(H.tree_group_rows(tree_forms(spark, sf)))))


@query("t1_tree_order", TREE_OUT)
def t1(spark, sf):
    return _tree_out(H.tree_list(tree_forms(spark, sf)))


# --- files ----------------------------------------------------------------


def written_forms(spark, sf) -> str:
    """Two form versions as files: CSV with fewer columns, Parquet with all."""
    root = staging_path(spark, "forms")
    rows = X.forms(spark, sf)
    rows.where(F.col("k") % 3 != 0).write.parquet(f"{root}/v3")
    rows.where(F.col("k") % 3 == 0).drop("gt_subplot_16").write.option("header", True).csv(f"{root}/v2")
    return root


def stacked(spark, sf) -> DataFrame:
    older = T.StructType([f for f in S.FORM_V3.fields if f.name != "gt_subplot_16"])
    versions = {"v3": ("parquet", S.FORM_V3, None), "v2": ("csv", older, None)}
    return S.read_forms(spark, versions, written_forms(spark, sf))


STACKED = f"""SELECT k, starttime, enumerator, coalesce(length(gt_plot), 0) AS plot_length,
 CASE WHEN k % 3 = 0 THEN 0 ELSE coalesce(length(gt_subplot_16), 0) END AS last_length FROM ({FORM}) f"""


@query("s1_form_versions", STACKED)
def s1(spark, sf):
    return stacked(spark, sf).select(
        "k",
        "starttime",
        "enumerator",
        F.coalesce(F.length("gt_plot"), F.lit(0)).cast("long").alias("plot_length"),
        F.coalesce(F.length("gt_subplot_16"), F.lit(0)).cast("long").alias("last_length"),
    )


@query("u1_stack_by_name", f"SELECT k % 3 = 0 AS older, count(*) AS n, count(gt_plot) AS with_plot FROM ({FORM}) f GROUP BY 1")
def u1(spark, sf):
    rows = X.forms(spark, sf)
    older = rows.where(F.col("k") % 3 == 0).drop("gt_subplot_16").withColumn("older", F.lit(True))
    newer = rows.where(F.col("k") % 3 != 0).withColumn("older", F.lit(False))
    return (
        newer.unionByName(older, allowMissingColumns=True)
        .groupBy("older")
        .agg(F.count(F.lit(1)).alias("n"), F.count("gt_plot").alias("with_plot"))
    )


@query(
    "s3_country_layer",
    f"WITH l AS ({X.COUNTRIES_SQL}) SELECT iso3, name, cast(w AS BIGINT) AS west, 5 AS coordinates FROM l WHERE iso3 = 'IND'",
)
def s3(spark, sf):
    corner = lambda x, y: F.concat_ws(" ", (F.col(x) / 10000).cast("string"), (F.col(y) / 10000).cast("string"))
    layer = X._views(spark, sf, X.COUNTRIES_SQL, ("region",)).withColumn(
        "geometry",
        F.concat(
            F.lit("POLYGON (("),
            F.concat_ws(", ", corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s")),
            F.lit("))"),
        ),
    )
    out = R.settle(S.country_layer(layer, "IND"), b=R.bbox(F.col("geom")))
    return out.select(
        "iso3", "name", scaled(F.col("b.minx"), 10000).alias("west"), R.coordinate_count(F.col("geom")).alias("coordinates")
    )


# Sampled plots: WKT, GeoJSON, multi-part WKT, too few coordinates, a crossing
# ring, no text, empty, and arbitrary text from the documents.
SELECTED = """
    SELECT k, 'SP' || cast(k AS string) AS plot_id, CASE k % 8
      WHEN 0 THEN 'POLYGON ((' || p00 || ', ' || p10 || ', ' || p11 || ', ' || p01 || ', ' || p00 || '))'
      WHEN 1 THEN '{"type":"Polygon","coordinates":[[[' || replace(p00, ' ', ',') || '],[' || replace(p10, ' ', ',') || '],[' ||
                  replace(p11, ' ', ',') || '],[' || replace(p01, ' ', ',') || '],[' || replace(p00, ' ', ',') || ']]]}'
      WHEN 2 THEN 'MULTIPOLYGON (((' || p00 || ', ' || p10 || ', ' || p11 || ', ' || p00 || ')), ((' || q00 || ', ' || q10 || ', ' || q11 || ', ' || q00 || ')))'
      WHEN 3 THEN 'POLYGON ((' || p00 || ', ' || p10 || '))'
      WHEN 4 THEN 'POLYGON ((' || p00 || ', ' || p11 || ', ' || p10 || ', ' || p01 || ', ' || p00 || '))'
      WHEN 5 THEN NULL
      WHEN 6 THEN 'POLYGON EMPTY'
      ELSE text END AS geometry
    FROM (SELECT doc_id AS k, text, '72.' || p AS x, '72.' || p || ' 5.5' AS p00, '72.' || p || '4 5.5' AS p10,
                 '72.' || p || '4 5.5004' AS p11, '72.' || p || ' 5.5004' AS p01, '73.' || p || ' 6.5' AS q00,
                 '73.' || p || '4 6.5' AS q10, '73.' || p || '4 6.5004' AS q11
          FROM (SELECT doc_id, text, lpad(cast(doc_id % 1000 AS string), 3, '0') AS p FROM documents) d) s"""


def selected(spark, sf) -> DataFrame:
    rows = X._views(spark, sf, SELECTED, ("documents",)).withColumn("row_ix", F.col("k"))
    return S.sampled_plots(rows)


@query(
    "s4_sampled_ingest",
    """SELECT doc_id AS k, CASE doc_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 WHEN 6 THEN 0 ELSE -1 END AS parts,
 CASE doc_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 4 THEN 5 WHEN 6 THEN 0 ELSE -1 END AS coordinates FROM documents""",
)
def s4(spark, sf):
    g = F.col("geom")
    return selected(spark, sf).select(
        "k",
        F.coalesce(F.size(g), F.lit(-1)).alias("parts"),
        F.coalesce(F.size(R.vertices(g)), F.lit(-1)).alias("coordinates"),
    )


V7_CASE = """CASE doc_id % 8 WHEN 3 THEN 'Geometry conversion error' WHEN 4 THEN 'Invalid geometry' WHEN 5 THEN 'Geometry is None or NaN'
 WHEN 6 THEN 'Empty geometry' WHEN 7 THEN 'Geometry conversion error' END"""


@query(
    "v7_quarantine",
    f"""SELECT 'SP' || cast(doc_id AS VARCHAR) AS id, {V7_CASE} AS error FROM documents WHERE doc_id % 8 > 2
UNION ALL SELECT 'SP' || cast(doc_id AS VARCHAR), 'usable' FROM documents WHERE doc_id % 8 <= 2""",
)
def v7(spark, sf):
    good, bad = rules.quarantine(selected(spark, sf))
    return bad.select("id", "error").unionByName(good.select(F.col("plot_id").alias("id"), F.lit("usable").alias("error")))


ATTRIBUTES = "SELECT 'SP' || cast(p_partkey AS string) AS plot_id, p_size * 0.02e0 AS mean_ndvi, (p_partkey % 90) * 0.5e0 AS mean_slope, p_brand AS other FROM part"


@query(
    "s5_attribute_csv",
    "SELECT 'SP' || cast(p_partkey AS VARCHAR) AS plot_id, cast(floor(p_size * 0.02e0 * 1000 + 0.5) AS BIGINT) AS ndvi, cast(floor((p_partkey % 90) * 0.5e0 * 1000 + 0.5) AS BIGINT) AS slope FROM part",
)
def s5(spark, sf):
    path = staging_path(spark, "ndvi-slope")
    W.write_csv(X._views(spark, sf, ATTRIBUTES, ("part",)), path)
    return S.ndvi_slope(spark, path).select(
        "plot_id", scaled(F.col("mean_ndvi")).alias("ndvi"), scaled(F.col("mean_slope")).alias("slope")
    )


J10_SQL = f"""WITH a AS ({ATTRIBUTES}) SELECT 'SP' || cast(doc_id AS VARCHAR) AS plot_id, cast(floor(mean_ndvi * 1000 + 0.5) AS BIGINT) AS ndvi
FROM documents LEFT JOIN a ON 'SP' || cast(doc_id AS VARCHAR) = a.plot_id"""


@query("j10_attributes", J10_SQL)
def j10(spark, sf):
    plots = X.table(spark, sf, "documents").select(F.concat(F.lit("SP"), F.col("doc_id").cast("string")).alias("plot_id"))
    attributes = X._views(spark, sf, ATTRIBUTES, ("part",)).select("plot_id", "mean_ndvi", "mean_slope")
    return S.attach_attributes(plots, attributes).select("plot_id", scaled(F.col("mean_ndvi")).alias("ndvi"))


def verdicts(spark, sf) -> DataFrame:
    """A small checked layer: measures, reasons, validity, feature text."""
    rows = G.measured(spark, sf)
    has = {"in_radius", "area_m2", "nr_vertices_too_small", "protruding_ratio_too_big"}
    rows = rows.withColumn("reasons", F.array_join(rules.reason_list(G.C.SUBPLOTS_V1, has=has), ";"))
    rows = rows.withColumn("valid", F.length("reasons") == 0)
    return rows.withColumn("geojson", G.to_geojson(F.col("geom"), F.col("subplot_id")))


VERDICT = Q.ctes(*Q.measured(), f"v AS (SELECT t.k, t.reasons, m.area, m.mrr FROM ({G.MEASURE_ONLY.format(lo=450, hi=750)}) t JOIN m ON t.k = m.k)")


@query("s6_write_layer", VERDICT + "SELECT reasons = '' AS valid, count(*) AS n, count(*) AS features FROM v GROUP BY 1")
def s6(spark, sf):
    path = staging_path(spark, "layer")
    W.write_layer(stage(verdicts(spark, sf), "verdicts"), path)
    lines = spark.read.text(f"{path}/features")
    features = (
        lines.where(F.get_json_object("value", "$.type") == "Feature")
        .groupBy(F.col("valid").cast("boolean").alias("valid"))
        .agg(F.count(F.lit(1)).alias("features"))
    )
    rows = W.read_layer(spark, path).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(features, "valid")


@query(
    "s8_export_check",
    """SELECT count(*) FILTER (WHERE o_orderkey % 4 = 0) AS good, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS bad FROM orders""",
)
def s8(spark, sf):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.lit('{"type":"FeatureCollection","features":[{"type":"Feature"}]}'))
        .when(k % 4 == 1, F.lit('{"type":"FeatureCollection","features":[]}'))
        .when(k % 4 == 2, F.lit("not json"))
    )
    rows = X.table(spark, sf, "orders").select(k.alias("k"), text.alias("geojson"))
    good, watch = W.exportable(rows, "export-check")
    kept = stage(good, "export")
    return kept.agg(F.count(F.lit(1)).alias("good")).withColumn("bad", F.lit(watch.get["bad_shapes"]).cast("long"))


@query("s9_reload", VERDICT + f"SELECT k, reasons = '' AS valid, {Q.scaled('area', 100)} AS area_cm FROM v")
def s9(spark, sf):
    path = staging_path(spark, "layer")
    rows = stage(verdicts(spark, sf), "verdicts")
    good, bad = layers.split_by_validity(rows)
    both = layers.stack_by_validity(good.drop("valid"), bad.drop("valid"))
    both.select("k", "area_m2", "valid").write.partitionBy("valid").parquet(f"{path}/table")
    return W.read_layer(spark, path).select("k", "valid", scaled(F.col("area_m2"), 100).alias("area_cm"))


@query(
    "s9_reattach",
    f"""WITH a AS ({ATTRIBUTES}) SELECT 'SP' || cast(doc_id AS VARCHAR) AS plot_id, lang AS collection_date,
 {Q.scaled('mean_ndvi')} AS ndvi, {Q.scaled('mean_slope')} AS slope
FROM documents LEFT JOIN a ON 'SP' || cast(doc_id AS VARCHAR) = a.plot_id WHERE doc_id % 8 <= 2""",
)
def s9_reattach(spark, sf):
    """Sampled plots exported without attributes, reloaded with those of the attribute file."""
    good, _ = rules.quarantine(selected(spark, sf))
    langs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("collection_date"))
    plots, attributes = staging_path(spark, "selected"), staging_path(spark, "ndvi-slope")
    W.write_sampled(good.join(langs, "k"), plots)
    W.write_csv(X._views(spark, sf, ATTRIBUTES, ("part",)), attributes)
    return W.reload_sampled(spark, plots, S.ndvi_slope(spark, attributes)).select(
        "plot_id", "collection_date", scaled(F.col("mean_ndvi")).alias("ndvi"), scaled(F.col("mean_slope")).alias("slope")
    )


@query("s10_csv_export", VERDICT + "SELECT cast(k AS VARCHAR) AS k, nullif(reasons, '') AS reasons FROM v WHERE reasons LIKE '%Plot too small%'")
def s10(spark, sf):
    path = staging_path(spark, "csv")
    chosen = reports.filter_table(verdicts(spark, sf), reason="Plot too small")
    W.write_csv(chosen.select("k", "reasons"), path)
    return spark.read.schema("k string, reasons string").option("header", True).csv(path)


@query(
    "s11_sampled_export",
    "SELECT 'SP' || cast(doc_id AS VARCHAR) AS plot_id, lang AS collection_date FROM documents WHERE doc_id % 8 <= 2",
)
def s11(spark, sf):
    good, _ = rules.quarantine(selected(spark, sf))
    langs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("collection_date"))
    path = staging_path(spark, "selected")
    W.write_sampled(good.join(langs, "k"), path)
    return spark.read.parquet(path).select("plot_id", "collection_date")


LOOKUP = """SELECT CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'N' || cast(n_nationkey % 9 AS string) END AS iso3,
  CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE 'Land ' || cast(n_nationkey % 9 AS string) END AS name FROM nation"""


@query("s12_country_lookup", f"SELECT DISTINCT iso3, name FROM ({LOOKUP}) l WHERE iso3 IS NOT NULL AND name IS NOT NULL")
def s12(spark, sf):
    path = staging_path(spark, "lookup")
    W.write_lookup(S.country_lookup(X._views(spark, sf, LOOKUP, ("nation",))), path)
    return spark.read.schema("iso3 string, name string").json(path)


@query("u2_split_union", VERDICT + "SELECT k, reasons = '' AS valid FROM v")
def u2(spark, sf):
    rows = stage(verdicts(spark, sf).select("k", "valid"), "verdicts")
    good, bad = layers.split_by_validity(rows)
    return layers.stack_by_validity(good.drop("valid"), bad.drop("valid"))


# --- reports --------------------------------------------------------------


@query(
    "p12_format_reasons",
    VERDICT
    + "SELECT k, replace(reasons, 'Plot is protruding', 'Plot is protruding (' || printf('%.3f', mrr) || ')') AS reasons FROM v WHERE mrr IS NOT NULL",
)
def p12(spark, sf):
    rows = verdicts(spark, sf).where(F.col("mrr_ratio").isNotNull())
    return rows.select("k", reports.format_reasons(F.col("reasons"), F.col("mrr_ratio")).alias("reasons"))


@query(
    "p13_report_columns",
    VERDICT + "SELECT k, CASE WHEN reasons = '' THEN 'Valid' ELSE 'Invalid' END AS valid, cast(round(area * 100) AS BIGINT) AS area_cm FROM v",
)
def p13(spark, sf):
    rows = verdicts(spark, sf).withColumn("collection_date", F.lit("2024-01-01"))
    return reports.report_columns(rows).select("k", "valid", F.round(F.col("area_m2") * 100).cast("long").alias("area_cm"))


@query("p14_table_filter", VERDICT + "SELECT k, reasons FROM v WHERE reasons <> '' AND reasons <> 'Empty geometry' AND list_contains(string_split(reasons, ';'), 'Plot is protruding')")
def p14(spark, sf):
    return reports.filter_table(
        verdicts(spark, sf), valid=False, reason="Plot is protruding", ignore_empty=True
    ).select("k", "reasons")


# A sixth of the plots have no subplots; those subplots name a plot that is not there.
J11_PLOT = "CASE WHEN l_orderkey % 6 = 1 THEN 'lost ' || cast(l_partkey AS string) ELSE 'P' || cast(l_orderkey AS string) END"
J11_SQL = f"""SELECT 'P' || cast(o_orderkey AS VARCHAR) AS plot_id, count(l.k) AS subplot_count, count(l.k) FILTER (WHERE l.ok) AS valid_subplot_count
FROM orders LEFT JOIN (SELECT {J11_PLOT} AS k, l_quantity > 20 AS ok FROM lineitem) l ON 'P' || cast(o_orderkey AS VARCHAR) = l.k GROUP BY o_orderkey"""


@query("j11_subplot_counts", J11_SQL)
def j11(spark, sf):
    plots = X.table(spark, sf, "orders").select(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("plot_id"))
    subplots = (
        X.table(spark, sf, "lineitem")
        .select(F.expr(J11_PLOT).alias("plot_id"), (F.col("l_quantity") > 20).alias("valid"))
    )
    return reports.with_subplot_counts(plots, subplots)


@query("t2_report_order", VERDICT + "SELECT k, reasons FROM v")
def t2(spark, sf):
    return reports.report_order(stage(verdicts(spark, sf).select("k", "reasons"), "verdicts"), "k")


@query("t2_status_order", VERDICT + "SELECT k, reasons = '' AS valid FROM v")
def t2_status(spark, sf):
    return reports.status_order(stage(verdicts(spark, sf).select("k", "valid"), "verdicts"), "k")


@query(
    "o1_step_metrics",
    Q.ctes(Q.tokens(), Q.parsed())
    + """SELECT 'read' AS step, count(*) AS rows, 2 AS columns, count(*) - count(trace) AS empty FROM src
UNION ALL SELECT 'shape', count(*), 2, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.k = s.k)) FROM src s""",
)
def o1(spark, sf):
    log = StepLog()
    read = log.run("read", X.traces(spark, sf).select("k", "trace"), F.col("trace").isNull())
    shapes = settle(read, geom=named_trace_polygon("trace")).select("k", "geom")
    log.run("shape", shapes, F.size("geom") == 0)
    return log.table(spark).select("step", "rows", "columns", "empty")


# --- remote sensing -------------------------------------------------------

# A plot per supplier; every event is a pixel of a scene of its day inside or
# beside one of the first sixteen, the others lie where no scene was taken.
NDVI_PLOTS = """SELECT 'R' || cast(s_suppkey AS string) AS plot_id, 720 + s_suppkey % 4 AS w, 50 + s_suppkey {div} 4 AS s FROM supplier"""
PIXELS = """SELECT 'sc' || cast(event_id % 30 AS string) || '-' || cast(user_id % 4 AS string) AS scene_id,
    TIMESTAMP '2024-01-01 00:00:00' AS day0, event_id % 30 AS dd, user_id % 25 AS cloud_pct,
    (7200 + event_id % 4 * 10 + user_id % 12) * 0.01e0 + 0.005e0 AS x,
    (500 + event_id {div} 4 % 4 * 10 + event_id {div} 16 % 12) * 0.01e0 + 0.005e0 AS y,
    cast(event_id % 97 AS bigint) + 1 AS b4, cast(event_id % 89 AS bigint) + 40 AS b8
  FROM events"""


def pixels(spark, sf) -> DataFrame:
    rows = X._views(spark, sf, PIXELS.format(div="div"), ("events",))
    return rows.withColumn("ts", F.expr("cast(timestampadd(DAY, dd, day0) AS timestamp_ntz)")).drop("day0", "dd")


def ndvi_plots(spark, sf) -> DataFrame:
    x0, y0 = F.col("w") / 10, F.col("s") / 10
    ring = F.array(
        R.vertex(x0, y0), R.vertex(x0 + 0.08, y0), R.vertex(x0 + 0.08, y0 + 0.08), R.vertex(x0, y0 + 0.08), R.vertex(x0, y0)
    )
    rows = X._views(spark, sf, NDVI_PLOTS.format(div="div"), ("supplier",))
    return rows.select("plot_id", R.polygon(ring).alias("geom"))


NDVI = f"""WITH pl AS ({NDVI_PLOTS.format(div='//')}), px AS ({PIXELS.format(div='//')}),
hit AS (SELECT plot_id, scene_id, day0 + dd * INTERVAL 1 DAY AS ts, x, y, (b8 - b4) * 1.0 / (b8 + b4) AS v FROM px
        JOIN pl ON x > w / 10.0 AND x < w / 10.0 + 0.08 AND y > s / 10.0 AND y < s / 10.0 + 0.08
        WHERE cloud_pct <= 20 AND dd < 25),
sc AS (SELECT plot_id, scene_id, ts, row_number() OVER (PARTITION BY plot_id ORDER BY ts DESC, scene_id) AS r
       FROM (SELECT DISTINCT plot_id, scene_id, ts FROM hit) d),
used AS (SELECT * FROM sc WHERE r <= 6),
pv AS (SELECT h.plot_id, x, y, avg(v) AS v FROM hit h JOIN used u ON h.plot_id = u.plot_id AND h.scene_id = u.scene_id GROUP BY h.plot_id, x, y),
mv AS (SELECT plot_id, avg(v) AS mean_ndvi FROM pv GROUP BY plot_id),
dt AS (SELECT plot_id, string_agg(strftime(ts, '%Y-%m-%d'), ',' ORDER BY ts DESC) AS image_dates FROM used GROUP BY plot_id)
"""
AS_OF = "2024-01-26 00:00:00"


@query(
    "r1_mean_ndvi",
    NDVI + f"SELECT pl.plot_id, {Q.scaled('mean_ndvi', 1000000)} AS ndvi FROM pl LEFT JOIN mv ON pl.plot_id = mv.plot_id",
)
def r1(spark, sf):
    return ndvi.mean_ndvi(ndvi_plots(spark, sf), pixels(spark, sf), AS_OF, cell=0.05).select(
        "plot_id", scaled(F.col("mean_ndvi"), 1000000).alias("ndvi")
    )


@query("r2_image_dates", NDVI + "SELECT pl.plot_id, coalesce(image_dates, '') AS image_dates FROM pl LEFT JOIN dt ON pl.plot_id = dt.plot_id")
def r2(spark, sf):
    return ndvi.mean_ndvi(ndvi_plots(spark, sf), pixels(spark, sf), AS_OF, cell=0.05).select("plot_id", "image_dates")


@query("w5_latest_scenes", NDVI + "SELECT plot_id, scene_id, strftime(ts, '%Y-%m-%d') AS day FROM used")
def w5(spark, sf):
    hits = ndvi.pixels_in_plots(ndvi.usable_pixels(pixels(spark, sf), AS_OF), ndvi_plots(spark, sf), 0.05)
    return ndvi.latest_scenes(hits).select("plot_id", "scene_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


# --- distances ------------------------------------------------------------

ADDRESS = (73.2, 5.05)
NODES = "SELECT s_suppkey AS node_id, (7250 + s_suppkey % 40 * 5) * 0.01e0 AS lon, (500 + s_suppkey {div} 40 * 3) * 0.01e0 AS lat FROM supplier"
# Links go at most ten suppliers ahead, so paths have many steps; from every seventh they only lead back.
EDGES = """SELECT l_suppkey AS src, CASE WHEN l_suppkey % 7 = 3 THEN l_suppkey
      ELSE (l_suppkey + 1 + l_partkey % 10) % (l_suppkey {div} 40 * 40 + 43) END AS dst,
    cast(l_quantity AS bigint) * 100 AS length_m FROM lineitem"""


def nodes(spark, sf) -> DataFrame:
    return X._views(spark, sf, NODES.format(div="div"), ("supplier",))


def links(spark, sf) -> DataFrame:
    return X._views(spark, sf, EDGES.format(div="div"), ("lineitem",))


def _vincenty(lon1, lat1, lon2: str, lat2: str, source: str) -> str:
    """Vincenty's inverse as a recursive CTE over (k, lon2, lat2)."""
    f, a, b = P.FLAT, P.A, P.B
    return f"""
    v0 AS (SELECT k, atan({1 - f!r} * tan(radians({lat1}))) AS u1, atan({1 - f!r} * tan(radians({lat2}))) AS u2,
                  radians({lon2} - {lon1}) AS l FROM {source}),
    vi AS (SELECT k, u1, u2, l, l AS lam, 0 AS it FROM v0
      UNION ALL
      SELECT k, u1, u2, l, l + (1 - c) * {f!r} * sa * (sg + c * sn * (cm + c * cs * (2 * cm * cm - 1))), it + 1 FROM (
        SELECT *, {f!r} / 16 * c2 * (4 + {f!r} * (4 - 3 * c2)) AS c FROM (
          SELECT *, cs - 2 * sin(u1) * sin(u2) / c2 AS cm FROM (
            SELECT *, 1 - sa * sa AS c2 FROM (
              SELECT *, cos(u1) * cos(u2) * sin(lam) / sn AS sa, atan2(sn, cs) AS sg FROM (
                SELECT *, sqrt((cos(u2) * sin(lam))**2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))**2) AS sn,
                       sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM vi WHERE it < 12) a1) a2) a3) a4) a5),
    vd AS (SELECT k, {b!r} * (1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))) * (sg - cb * sn * (cm + cb / 4 *
             (cs * (2 * cm * cm - 1) - cb / 6 * cm * (4 * sn * sn - 3) * (4 * cm * cm - 3)))) AS metres FROM (
        SELECT *, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS cb FROM (
          SELECT *, cs - 2 * sin(u1) * sin(u2) / c2 AS cm, c2 * {(a * a - b * b) / (b * b)!r} AS uu FROM (
            SELECT *, 1 - sa * sa AS c2 FROM (
              SELECT *, cos(u1) * cos(u2) * sin(lam) / sn AS sa, atan2(sn, cs) AS sg FROM (
                SELECT *, sqrt((cos(u2) * sin(lam))**2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))**2) AS sn,
                       sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM vi WHERE it = 12) b1) b2) b3) b4) b5)"""


def recursive(*parts: str) -> str:
    return Q.ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


CENTRES = [*Q.base(), Q.edges("le", "ring", "x", "y"), Q.areas("la", "le")]


@query(
    "r3_crow_distance",
    recursive(*CENTRES, _vincenty(ADDRESS[0], ADDRESS[1], "cx", "cy", "la"))
    + f"SELECT s.k, {Q.scaled('metres')} AS distance_mm FROM src s LEFT JOIN vd ON s.k = vd.k",
)
def r3(spark, sf):
    rows = roads.crow_distance(G.repaired(spark, sf), *ADDRESS)
    return rows.select("k", scaled(F.col("distance_km") * 1000).alias("distance_mm"))


ALL_NODES = f"nd AS ({NODES.format(div='//')})"
NEAREST = """
    nn AS (SELECT la.k, arg_min(nd.node_id, {'d': ((nd.lon - cx) * cos(radians(cy)))**2 + (nd.lat - cy)**2, 'n': nd.node_id}) AS node_id
           FROM la, nd GROUP BY la.k)"""


@query("j12_nearest_node", Q.ctes(*CENTRES, ALL_NODES, NEAREST) + "SELECT k, node_id FROM nn")
def j12(spark, sf):
    c = F.col("centroid")
    points = roads.with_centroid(G.repaired(spark, sf)).select("k", "centroid").where(c.isNotNull()).select(
        F.col("k").alias("point_id"), c["cx"].alias("lon"), c["cy"].alias("lat")
    )
    return roads.nearest_nodes(points, nodes(spark, sf)).withColumnRenamed("point_id", "k")


def _network_sql(reach: int) -> str:
    """Nodes within reach of the working area's centre, as ``nd``."""
    mid = "radians((an.lat + ar.lat) / 2)"
    w2 = f"(1 - {P.E2!r} * sin({mid}) * sin({mid}))"
    return f"""
    an AS ({NODES.format(div='//')}),
    ar AS (SELECT (sum(cx) + {ADDRESS[0]}) / (count(*) + 1) AS lon, (sum(cy) + {ADDRESS[1]}) / (count(*) + 1) AS lat FROM la),
    nd AS (SELECT an.* FROM an, ar WHERE sqrt((radians(ar.lat - an.lat) * {P.A * (1 - P.E2)!r} / ({w2} * sqrt({w2})))**2
      + (radians(ar.lon - an.lon) * {P.A!r} / sqrt({w2}) * cos({mid}))**2) <= {reach})"""


def _relax(rounds: int) -> str:
    """Shortest paths by plain rounds of relaxation."""
    start = f"""(SELECT arg_min(node_id, {{'d': ((lon - {ADDRESS[0]}) * cos(radians({ADDRESS[1]})))**2 + (lat - {ADDRESS[1]})**2, 'n': node_id}}) FROM nd0)"""
    out = [
        "nd0 AS (SELECT * FROM nd)",
        f"lk AS (SELECT src, dst, min(length_m) AS w FROM ({EDGES.format(div='//')}) e GROUP BY src, dst)",
        f"sp0 AS (SELECT {start} AS node_id, cast(0 AS BIGINT) AS d)",
    ]
    for i in range(1, rounds + 1):
        out.append(
            f"sp{i} AS MATERIALIZED (SELECT node_id, min(d) AS d FROM (SELECT * FROM sp{i - 1} UNION ALL SELECT lk.dst, s.d + lk.w FROM sp{i - 1} s JOIN lk ON lk.src = s.node_id) u GROUP BY node_id)"
        )
    return ", ".join(out)


ROUNDS = 60


@query(
    "r4_road_distance",
    Q.ctes(*CENTRES, ALL_NODES, NEAREST, _relax(ROUNDS))
    + f"SELECT s.k, nn.node_id, sp{ROUNDS}.d AS metres FROM src s LEFT JOIN nn ON s.k = nn.k LEFT JOIN sp{ROUNDS} ON sp{ROUNDS}.node_id = nn.node_id",
)
def r4(spark, sf):
    rows = stage(G.repaired(spark, sf).select("k", F.col("subplot_id").alias("plot_id"), "geom"), "repaired")
    out = roads.road_distance(rows, nodes(spark, sf), links(spark, sf), *ADDRESS, reach_m=None)
    return out.select("k", "node_id", F.round(F.col("road_distance_km") * 1000).cast("long").alias("metres"))


@query(
    "r5_working_area",
    Q.ctes(*CENTRES, _network_sql(60000))
    + f"""SELECT {Q.scaled('(SELECT lon FROM ar)', 1000000)} AS lon, {Q.scaled('(SELECT lat FROM ar)', 1000000)} AS lat,
 (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ({EDGES.format(div='//')}) e WHERE src IN (SELECT node_id FROM nd) AND dst IN (SELECT node_id FROM nd)) AS links""",
)
def r5(spark, sf):
    # read by five plans below
    area = stage(roads.working_area(G.repaired(spark, sf), *ADDRESS), "working-area")
    kept, inside = roads.network_near(nodes(spark, sf), links(spark, sf), area, 60000.0)
    return area.select(
        scaled(F.col("lon"), 1000000).alias("lon"),
        scaled(F.col("lat"), 1000000).alias("lat"),
        kept.agg(F.count(F.lit(1)).alias("n")).scalar().alias("nodes"),
        inside.agg(F.count(F.lit(1)).alias("n")).scalar().alias("links"),
    )


@query(
    "t3_distance_order",
    recursive(*CENTRES, _vincenty(ADDRESS[0], ADDRESS[1], "cx", "cy", "la"))
    + f"SELECT cast(s.k AS VARCHAR) AS plot_id, {Q.scaled('metres')} AS distance_mm FROM src s LEFT JOIN vd ON s.k = vd.k",
)
def t3(spark, sf):
    rows = G.repaired(spark, sf).withColumnRenamed("subplot_id", "plot_id")
    # a sort reads its input twice
    far = stage(roads.crow_distance(rows, *ADDRESS).select("plot_id", "distance_km"), "distances")
    return reports.distance_order(far).select("plot_id", scaled(F.col("distance_km") * 1000).alias("distance_mm"))
