"""Summaries and tables built on the checked layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.plans.rules import EMPTY, PROTRUDING


def enumerator_label(name: Column, number: Column) -> Column:
    return F.concat(name, F.lit(" ("), number.cast("string"), F.lit(")"))


def clean_enumerator(label: Column) -> Column:
    """Name without the number in parentheses; ``Unknown`` when missing."""
    return (
        F.when(label.isNull(), "Unknown")
        .when(
            label.contains("(") & label.contains(")"), F.trim(F.substring_index(label, "(", 1))
        )
        .otherwise(label)
    )


def reason_items(reasons: Column) -> Column:
    return F.filter(F.transform(F.split(reasons, ";"), F.trim), lambda r: r != "")


def reason_counts(df: DataFrame) -> DataFrame:
    """How often each rule failed, the most frequent first."""
    return (
        df.select(F.explode(reason_items(F.col("reasons"))).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "reason")
    )


def validity_totals(df: DataFrame, flag: str = "valid") -> DataFrame:
    """Totals and percentages in one row; percentages are 0 for an empty layer."""
    total, valid = F.count(F.lit(1)), F.count_if(F.col(flag))
    share = lambda part: F.coalesce(F.try_divide(100 * part, total), F.lit(0.0))
    return df.agg(
        total.alias("total"),
        valid.alias("valid"),
        (total - valid).alias("invalid"),
        share(valid).alias("valid_pct"),
        share(total - valid).alias("invalid_pct"),
    )


def format_reasons(reasons: Column, ratio: Column) -> Column:
    """Reason list with the protruding ratio to three digits."""
    return F.array_join(
        F.transform(
            F.transform(F.split(reasons, ";"), F.trim),
            lambda r: F.when(
                r == PROTRUDING, F.concat(r, F.lit(" ("), F.format_string("%.3f", ratio), F.lit(")"))
            ).otherwise(r),
        ),
        ";",
    )


def filter_table(
    df: DataFrame,
    valid: bool | None = None,
    enumerator: str | None = None,
    plot_id: str | None = None,
    reason: str | None = None,
    ignore_empty: bool = False,
) -> DataFrame:
    """The filters of the tables; a reason must match a whole list item."""
    out = df
    if ignore_empty:
        out = out.where(~F.coalesce(F.col("reasons"), F.lit("")).contains(EMPTY))
    if valid is not None:
        out = out.where(F.col("valid") == valid)
    if enumerator is not None:
        out = out.where(F.col("enumerator_display") == enumerator)
    if plot_id is not None:
        out = out.where(F.col("plot_id") == plot_id)
    if reason is not None:
        out = out.where(F.array_contains(reason_items(F.coalesce("reasons", F.lit(""))), reason))
    return out


def subplot_counts(subplots: DataFrame) -> DataFrame:
    return subplots.groupBy("plot_id").agg(
        F.count(F.lit(1)).alias("subplot_count"), F.count_if("valid").alias("valid_subplot_count")
    )


def with_subplot_counts(plots: DataFrame, subplots: DataFrame) -> DataFrame:
    """Both counts per plot from one aggregate; plots without subplots get 0."""
    return plots.join(subplot_counts(subplots), "plot_id", "left").fillna(
        0, ["subplot_count", "valid_subplot_count"]
    )


def report_columns(df: DataFrame) -> DataFrame:
    """Status text, area to two digits, date text."""
    return (
        df.withColumn("valid", F.when(F.col("valid"), "Valid").otherwise("Invalid"))
        .withColumn("area_m2", F.bround("area_m2", 2))
        .withColumn("collection_date", F.date_format(F.col("collection_date").cast("date"), "yyyy-MM-dd"))
    )


def plot_report(plots: DataFrame, subplots: DataFrame) -> DataFrame:
    table = with_subplot_counts(plots, subplots).withColumn(
        "reasons", format_reasons(F.col("reasons"), F.col("mrr_ratio"))
    )
    return report_order(report_columns(table).drop("mrr_ratio"), "plot_id")


def report_order(df: DataFrame, id_column: str) -> DataFrame:
    """Reasons from Z to A, missing last; the id splits equal reasons over ranges."""
    return df.orderBy(F.col("reasons").desc_nulls_last(), F.col(id_column))


def status_order(df: DataFrame, id_column: str) -> DataFrame:
    return df.orderBy(F.col("valid").asc(), F.col(id_column))


def distance_order(df: DataFrame) -> DataFrame:
    """By road distance, else straight distance, else id, whichever is there."""
    for column in ("road_distance_km", "distance_km", "plot_id"):
        if column in df.columns:
            return df.orderBy(F.col(column).asc_nulls_last(), F.col("plot_id"))
    return df


def measure_range(df: DataFrame, *columns: str) -> DataFrame:
    """Smallest and largest value of each measure, one row."""
    return df.agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )
