"""Wide forms to long rows; ids of plots, subplots and trees."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.operators.skew import first_per_key, number_rows

SUBPLOTS_PER_PLOT = 16

# Column stems of one tree group, with the names they get.
TREE_FIELDS = {
    "nr_trees": "nr_trees",
    "tree_plant_crop_species": "group_species",
    "other_species": "other_species",
    "tree_height_m": "tree_height_m",
    "crop_height_m": "crop_height_m",
    "nr_stems": "total_nr_stems",
    "tree_circumference_cm": "tree_circumference_cm",
    "prune_heigth": "prune_height_m",
    "coverage_percentage": "crop_percentage",
    "tree_year_planted": "planted",
    "tree_comments": "comments",
}
TREE_TYPE = "tree_over_1.3m"


def survey_id(country: str, partner: str, start: Column, enumerator_id: Column, n: Column) -> Column:
    """``ISO3_partner_yyyymmdd_enumerator_n``."""
    return F.concat_ws(
        "_",
        F.lit(country),
        F.lit(partner.replace(" ", "")),
        F.date_format(start, "yyyyMMdd"),
        enumerator_id,
        n.cast("string"),
    )


def device_prefix(info: Column) -> Column:
    """Text before the name of the collection app."""
    return F.substring_index(info, "SurveyCTO", 1)


def number_forms(
    forms: DataFrame, country: str, partner: str, source: str, position: str
) -> DataFrame:
    """Add ``plot_id`` from the running number of the form in file order."""
    numbered = number_rows(forms, source, position, "_n")
    return numbered.withColumn(
        "plot_id",
        survey_id(country, partner, F.col("starttime"), F.col("enumerator_id"), F.col("_n")),
    ).drop("_n")


def plot_rows(
    forms: DataFrame, country: str, partner: str, source: str, position: str, same_numbers: bool = True
) -> DataFrame:
    """One row per form with a plot trace.

    ``same_numbers=False`` numbers only the forms that have a trace, which
    can make plot and subplot ids disagree, as in the original.
    """
    has = F.col("gt_plot").isNotNull()
    rows = forms if same_numbers else forms.where(has)
    out = number_forms(rows, country, partner, source, position)
    return out.where(has).select(
        "plot_id",
        F.concat(F.col("enumerator"), F.lit(" ("), F.col("enumerator_id").cast("string"), F.lit(")")).alias(
            "enumerator"
        ),
        "enumerator_id",
        F.date_format("starttime", "yyyy-MM-dd").alias("collection_date"),
        device_prefix(F.col("device_info")).alias("device"),
        F.col("gt_plot").alias("trace"),
    )


def subplot_rows(forms: DataFrame, position: str, numbered: bool = False) -> DataFrame:
    """Sixteen trace columns to sixteen rows per plot.

    ``forms`` has ``plot_id``; forms sharing one are reduced to the first.
    ``numbered`` says that the ids come from ``number_forms``, so that none
    repeats and the wide rows need no second shuffle.
    """
    first = forms if numbered else first_per_key(forms, ["plot_id"], [position])
    stacked = ", ".join(f"{i}, gt_subplot_{i}" for i in range(1, SUBPLOTS_PER_PLOT + 1))
    return first.select(
        "plot_id",
        "enumerator",
        "enumerator_id",
        F.date_format("starttime", "yyyy-MM-dd").alias("collection_date"),
        device_prefix(F.col("device_info")).alias("device"),
        F.expr(f"stack({SUBPLOTS_PER_PLOT}, {stacked}) AS (subplot_nr, trace)"),
    ).withColumn("subplot_id", F.concat_ws("_", "plot_id", F.col("subplot_nr").cast("string")))


def tree_groups(columns: list[str]) -> list[tuple[str, str]]:
    """(subplot, group) pairs for which the form has a count column."""
    found = (re.fullmatch(r"nr_trees_(\d+)_(\d+)", c) for c in columns)
    return [(m.group(1), m.group(2)) for m in found if m]


def tree_group_rows(forms: DataFrame) -> DataFrame:
    """One row per tree group with a count; columns a form lacks become NULL."""
    groups = tree_groups(forms.columns)
    have = set(forms.columns)

    def group(s: str, t: str) -> Column:
        fields = [
            (F.col(f"{stem}_{s}_{t}") if f"{stem}_{s}_{t}" in have else F.lit(None)).alias(name)
            for stem, name in TREE_FIELDS.items()
        ]
        return F.struct(F.lit(s).alias("subplot_nr"), F.lit(t).alias("group_nr"), *fields)

    keep = ["plot_id", "starttime", "enumerator_name"]
    return (
        forms.select(*keep, F.explode(F.array(*[group(s, t) for s, t in groups])).alias("g"))
        .select(*keep, "g.*")
        .where(F.col("nr_trees").isNotNull())
    )


def repeat_trees(groups: DataFrame) -> DataFrame:
    """Each group of n trees becomes n rows."""
    n = F.col("nr_trees").cast("int")
    return groups.where(n >= 1).withColumn("tree_nr", F.explode(F.sequence(F.lit(1), n)))


def tree_columns(trees: DataFrame) -> DataFrame:
    """Derived columns of the tree list."""
    n = F.col("nr_trees")
    return trees.select(
        F.concat_ws("_", "plot_id", "subplot_nr").alias("subplot_id"),
        F.date_format("starttime", "yyyy/MM/dd").alias("collection_date"),
        "enumerator_name",
        F.lit(TREE_TYPE).alias("vegetation_type"),
        F.coalesce("other_species", "group_species").alias("species"),
        F.coalesce("tree_height_m", "crop_height_m").alias("vegetation_height_m"),
        (F.col("tree_circumference_cm").cast("double") / math.pi).alias("diameter_cm"),
        F.date_format("planted", "yyyy").alias("year"),
        F.try_divide(F.col("total_nr_stems"), n).alias("avg_stems"),
        "prune_height_m",
        F.coalesce(n.cast("double"), F.col("crop_percentage") / 100).alias("crop_count"),
        "comments",
        "other_species",
        "tree_height_m",
        "crop_height_m",
        "tree_circumference_cm",
        n.alias("nr_grouped_trees"),
        "total_nr_stems",
        "crop_percentage",
    )


def tree_list(forms: DataFrame) -> DataFrame:
    """Unpivot, repeat, derive and order the trees of all forms."""
    return tree_order(tree_columns(repeat_trees(tree_group_rows(forms))))


def tree_order(trees: DataFrame) -> DataFrame:
    return trees.orderBy(
        F.col("subplot_id").asc(), F.col("vegetation_type").desc(), F.col("nr_grouped_trees").desc()
    )
