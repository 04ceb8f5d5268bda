"""Checks of the five-level vegetation forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.operators.skew import HOT_ROWS, first_per_key, group_median, join_per_key
from parcelcheck.operators.slices import GROUP_ROWS, JOIN_ROWS, by_slices, slice_of, slices, write_packed
from parcelcheck.params import MAX_CIRCUMFERENCE_CM, MAX_STEMS, OUTLIER_FACTOR, TALL_TREE_M
from parcelcheck.session import remove_staged, staging_path

# Answer codes of the form.
PRIMARY = "yes_primary_group"
NOT_PRIMARY = "no"
YOUNG = "yes_groupbelow1.3"
OTHER = "other"
PALMS = "palms"
BAMBOO = "bamboo"
NONWOODY_COVERAGE = "nonwoody_coverage"
NO_COVERAGE = "no_coverage"
#: Keys by which the vegetation, measurement and circumference levels name their parents.
PARENTS = ("SUBPLOT_KEY", "VEGETATION_KEY", "MEASUREMENT_KEY")


@dataclass(frozen=True)
class Levels:
    """The joined levels; each is a lazy plan over the one before.

    ``written`` says that the lowest level is a table written slice by slice.
    """

    plots: DataFrame
    vegetation: DataFrame
    measurement: DataFrame
    circumference: DataFrame
    written: bool = False


def in_period(df: DataFrame, start: str, end: str, column: str = "SubmissionDate") -> DataFrame:
    """Rows submitted from ``start`` to ``end``, both days included.

    A plain range on the column itself, so it reaches the scan.
    """
    c = F.col(column)
    return df.where((c >= F.lit(start).cast("timestamp_ntz")) & (c < F.expr(f"timestamp_ntz'{end}' + interval 1 day")))


def inner(left: DataFrame, right: DataFrame, key: str, nulls_match: bool = False) -> DataFrame:
    """Inner join on one key; ``nulls_match`` pairs null keys as pandas does."""
    if not nulls_match:
        return left.join(right, key, "inner")
    renamed = right.withColumnRenamed(key, "_key")
    return left.join(renamed, F.col(key).eqNullSafe(F.col("_key")), "inner").drop("_key")


def inner_by_slices(
    left: DataFrame, right: DataFrame, key: str, nulls_match: bool = False, slice_rows: int = JOIN_ROWS
) -> tuple[DataFrame, bool]:
    """:func:`inner`, written by slices of the key where ``right`` has more rows than one; and whether it was.

    ``left`` is staged for that, because every slice reads it.
    """
    n = slices(right, slice_rows)
    if n == 1 or left.schema[key].dataType != right.schema[key].dataType:
        return inner(left, right, key, nulls_match), False
    path = staging_path(left.sparkSession, "level-above")
    write_packed(left, path)
    above = left.sparkSession.read.schema(left.schema).parquet(path)
    joined = by_slices(
        n, lambda i: inner(slice_of(above, key, n, i), slice_of(right, key, n, i), key, nulls_match), "level"
    )
    remove_staged(left.sparkSession, path)
    return joined, True


def join_levels(
    plots: DataFrame,
    subplots: DataFrame,
    vegetation: DataFrame,
    measurement: DataFrame,
    circumference: DataFrame,
    start: str,
    end: str,
    nulls_match: bool = False,
    columns: Sequence[str] | None = None,
    slice_rows: int = JOIN_ROWS,
    finished: Callable[[int], None] | None = None,
) -> Levels:
    """Inner chain down the levels; the period filter sits below the first join.

    With ``columns``, the levels keep their keys and these columns only, and a
    level of more than ``slice_rows`` rows is joined by slices of its parent's
    key, here and now. Name columns where the lowest level is wanted.
    ``finished`` is called with the number of tables, from the top, that the
    levels below such a one do not read any more.
    """
    plots = in_period(plots, start, end)
    if columns is None:
        m_plots = inner(plots, subplots, "PLOT_KEY", nulls_match)
        m_veg = inner(m_plots, vegetation, "SUBPLOT_KEY", nulls_match)
        m_mea = inner(m_veg, measurement, "VEGETATION_KEY", nulls_match)
        m_cir = inner(m_mea, circumference, "MEASUREMENT_KEY", nulls_match)
        return Levels(m_plots, m_veg, m_mea, m_cir)
    wanted = {"PLOT_KEY", *PARENTS, "CIRCUMFERENCE_KEY", *columns}
    plots, subplots, *below = [
        df.select(*[c for c in df.columns if c in wanted]) for df in (plots, subplots, vegetation, measurement, circumference)
    ]
    joined, written = [inner(plots, subplots, "PLOT_KEY", nulls_match)], False
    for above, (key, df) in enumerate(zip(PARENTS, below), 2):
        down, written = inner_by_slices(joined[-1], df, key, nulls_match, slice_rows)
        joined.append(down)
        if written and finished:
            finished(above + 1)
    return Levels(*joined, written)


def tool_audit(m_plots: DataFrame) -> DataFrame:
    """Measuring methods, one row per plot (the first by subplot key)."""
    # fixed values: the report's columns
    columns = ["enumerator", "measured_subplots", "dbh_method", "dbh_unit", "height_method"]
    return first_per_key(
        m_plots.select("PLOT_KEY", "SUBPLOT_KEY", *columns), ["PLOT_KEY"], ["SUBPLOT_KEY"]
    ).drop("SUBPLOT_KEY")


def without(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``present``."""
    return rows.join(present.select(key).distinct(), key, "left_anti")


def subplots_without_vegetation(m_plots: DataFrame, m_veg: DataFrame) -> DataFrame:
    return without(m_plots, m_veg, "SUBPLOT_KEY").select(
        "enumerator", "SUBPLOT_KEY", "subplot_comments"
    )


def density(m_veg: DataFrame) -> DataFrame:
    """Sums per subplot with the distinct enumerators and comments.

    One pass: rows are first summed per subplot, enumerator and comment, so a
    crowded subplot is reduced by many tasks and only its distinct values meet.
    Nulls count as a value.
    """
    numbers = ["vegetation_type_number", "coverage_vegetation"]
    lists = ["enumerator", "subplot_comments"]
    parts = m_veg.groupBy("SUBPLOT_KEY", *lists).agg(*[F.sum(c).alias(c) for c in numbers])

    def values(column: str) -> Column:
        found = F.collect_set(F.struct(F.col(column).alias("v")))
        return F.transform(F.array_sort(found), lambda s: s["v"]).alias(column)

    return parts.groupBy("SUBPLOT_KEY").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers], *[values(c) for c in lists]
    )


def coverage_only(m_veg: DataFrame) -> DataFrame:
    """Subplots whose counts add up to zero."""
    return (
        m_veg.groupBy("SUBPLOT_KEY")
        .agg(F.coalesce(F.sum("vegetation_type_number"), F.lit(0)).alias("n"))
        .where(F.col("n") == 0)
        .select("SUBPLOT_KEY")
    )


def missing_measurements(m_veg: DataFrame, m_mea: DataFrame) -> DataFrame:
    # fixed values: the report's columns
    return without(m_veg, m_mea, "SUBPLOT_KEY").select(
        "enumerator",
        "SUBPLOT_KEY",
        "subplot_comments",
        "crop_comments",
        "non_woody_species",
        "coverage_vegetation",
    )


def coverage_against_missing(m_veg: DataFrame, m_mea: DataFrame) -> DataFrame:
    """One row: coverage-only subplots, subplots without measurement."""
    only = coverage_only(m_veg).agg(F.count(F.lit(1)).alias("coverage_only"))
    missing = (
        missing_measurements(m_veg, m_mea)
        .select("SUBPLOT_KEY")
        .distinct()
        .agg(F.count(F.lit(1)).alias("missing_measurements"))
    )
    return only.withColumn("missing_measurements", missing.scalar())


def reverted_answers(m_veg: DataFrame, m_mea: DataFrame) -> DataFrame:
    """Coverage-only subplots that do have measurements, with their enumerators."""
    flagged = without(coverage_only(m_veg), missing_measurements(m_veg, m_mea), "SUBPLOT_KEY")
    names = m_veg.select("SUBPLOT_KEY", "enumerator").distinct()
    return (
        flagged.join(names, "SUBPLOT_KEY")
        .groupBy("SUBPLOT_KEY")
        .agg(F.array_sort(F.collect_list("enumerator")).alias("enumerator"))
    )


def named_other(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with a count and a written species name."""
    return rows.where(
        F.col("vegetation_type_number").isNotNull() & F.col("other_species").isNotNull()
    ).select(
        "enumerator",
        "SUBPLOT_KEY",
        *extra,
        "other_species",
        "language_other_species",
        "vegetation_type_number",
    )


def primary_other(m_veg: DataFrame) -> DataFrame:
    return named_other(
        m_veg.where((F.col("vegetation_type_primary") == PRIMARY) & (F.col("woody_species") == OTHER))
    )


def young_other(m_veg: DataFrame) -> DataFrame:
    return named_other(
        m_veg.where((F.col("vegetation_type_youngtree") == YOUNG) & (F.col("woody_species") == OTHER))
    )


def non_primary(m_veg: DataFrame) -> DataFrame:
    return m_veg.where(
        (F.col("vegetation_type_primary") == NOT_PRIMARY) & (F.col("woody_species") == OTHER)
    )


def species_group(m_veg: DataFrame, kind: str) -> DataFrame:
    return m_veg.where(F.col("vegetation_species_type") == kind)


def other_share(group: DataFrame) -> DataFrame:
    """Percent of the counted plants that carry a written name, in one pass."""
    n = F.col("vegetation_type_number")
    named = F.sum(F.when(F.col("other_species").isNotNull(), n))
    return group.agg(
        (100 * F.try_divide(F.coalesce(named, F.lit(0)), F.sum(n))).alias("other_share")
    )


def coverage_group(m_veg: DataFrame) -> DataFrame:
    return m_veg.where(
        (F.col("vegetation_type_woody") == NONWOODY_COVERAGE)
        | (F.col("vegetation_type_youngtree") == NO_COVERAGE)
    )


def coverage_other(m_veg: DataFrame) -> DataFrame:
    return (
        coverage_group(m_veg)
        .where(F.col("other_species").isNotNull())
        .select(
            "enumerator",
            "SUBPLOT_KEY",
            "other_species",
            "language_other_species",
            "coverage_vegetation",
        )
    )


def coverage_other_share(m_veg: DataFrame) -> DataFrame:
    return coverage_group(m_veg).agg(
        (100 * F.try_divide(F.count("other_species"), F.count(F.lit(1)))).alias("other_share")
    )


def label_outliers(value: Column, median: Column) -> tuple[Column, Column]:
    """Upper and lower label; a missing value or median is ``ok``."""

    def label(test: Column) -> Column:
        return F.when(test, "outlier").otherwise("ok")

    return label(value > median * OUTLIER_FACTOR), label(value < median / OUTLIER_FACTOR)


def with_outliers(
    rows: DataFrame,
    key: str,
    value: str,
    median_name: str,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
    slice_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Group median on each row and the two outlier labels.

    The rows come out of a chain of joins and are read several times here, so
    they are staged first unless they are ``written`` already. A table of more
    than ``slice_rows`` rows is labelled by slices of the key, here and now.
    """
    spark = rows.sparkSession
    path = None
    if not written:
        path = staging_path(spark, "grouped")
        write_packed(rows, path)
        rows = spark.read.schema(rows.schema).parquet(path)
    rest = [c for c in rows.columns if c != key]
    upper, lower = label_outliers(F.col(value), F.col(median_name))

    def labelled(part: DataFrame) -> DataFrame:
        medians = group_median(part, [key], value, median_name)
        out = join_per_key(part, medians, [key], rest, hot_rows)
        # An inner merge drops rows without a key.
        return (
            out.where(F.col(key).isNotNull())
            .withColumn("Upper_outliers", upper)
            .withColumn("Lower_outliers", lower)
        )

    n = slices(rows, slice_rows)
    if n == 1:
        return labelled(rows)
    done = by_slices(n, lambda i: labelled(slice_of(rows, key, n, i)), "labelled")
    if path:
        remove_staged(spark, path)
    return done


def height_check(m_mea: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    # fixed values: the report's columns
    columns = [
        "enumerator",
        "VEGETATION_KEY",
        "SUBPLOT_KEY",
        "vegetation_type_number",
        "tree_height_m",
        "tree_year_planted",
        "tree_prune",
        "tree_coppiced",
    ]
    return with_outliers(m_mea.select(*columns), "VEGETATION_KEY", "tree_height_m", "median_height", hot_rows)


def tall_trees(m_mea: DataFrame) -> DataFrame:
    return height_check(m_mea).where(F.col("tree_height_m") > TALL_TREE_M)


def coppice_check(m_mea: DataFrame) -> DataFrame:
    # fixed values: the report's columns
    columns = [
        "enumerator",
        "VEGETATION_KEY",
        "vegetation_type_number",
        "tree_height_m",
        "prune_height",
        "coppiced_height",
        "tree_year_planted",
        "tree_prune",
        "tree_coppiced",
    ]
    return with_outliers(m_mea.select(*columns), "VEGETATION_KEY", "coppiced_height", "median_coppiced")


def many_stems(m_mea: DataFrame) -> DataFrame:
    # fixed values: the report's columns
    return m_mea.where(F.col("nr_stems_bh") > MAX_STEMS).select(
        "enumerator",
        "VEGETATION_KEY",
        "other_species",
        "woody_species",
        "banana_species",
        "vegetation_type_number",
        "nr_stems_bh",
        "nr_stems_10cm",
        "tree_year_planted",
    )


# fixed values: the report's columns
CIRCUMFERENCE_COLUMNS = [
    "enumerator",
    "VEGETATION_KEY",
    "MEASUREMENT_KEY",
    "vegetation_type_number",
    "circumference_bh",
    "circumference_10cm",
    "tree_year_planted",
]


def circumference_check(m_cir: DataFrame, written: bool = False) -> DataFrame:
    rows = m_cir.select(*CIRCUMFERENCE_COLUMNS)
    return with_outliers(rows, "MEASUREMENT_KEY", "circumference_bh", "median_cir", written=written)


def thick_trees(m_cir: DataFrame, column: str = "circumference_bh", written: bool = False) -> DataFrame:
    return circumference_check(m_cir, written).where(F.col(column) > MAX_CIRCUMFERENCE_CM)


def vegetation_totals(m_veg: DataFrame) -> DataFrame:
    """Count per subplot and the part entered as plain "other"."""
    n = F.col("vegetation_type_number")
    is_other = F.lower("other_species") == OTHER
    return m_veg.groupBy("SUBPLOT_KEY").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_vegetation"),
        F.when(F.count_if(is_other) > 0, F.coalesce(F.sum(F.when(is_other, n)), F.lit(0))).alias(
            "other_vegetation"
        ),
    )
