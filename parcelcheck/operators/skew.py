"""Helpers for keys that hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcheck.session import stage

#: A key of more rows is split into parts of at most so many.
HOT_ROWS = 1_000_000
#: Keys that are split, at most: beyond, parts grow with the table.
HOT_KEYS = 200_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that need more than one part, with ``_salts``, the number of parts.

    A part holds ``hot_rows`` rows or the ``HOT_KEYS``-th part of the table,
    whichever is more. So there are fewer than ``HOT_KEYS`` such keys whatever
    the input, and the result is safe to broadcast.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"))
    part = F.greatest(F.lit(hot_rows).cast("long"), F.ceil(total.scalar() / HOT_KEYS))
    return counts.where(F.col("_n") > part).select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_salts"))


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str | Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join with a table of at most one row per key.

    Rows of hot keys are spread over as many salts as their counted rows need,
    by the hash of ``spread_by`` (columns that differ between the rows of one
    key); the single matching row is copied to every salt. Keys that are not
    hot keep salt 0.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(rows, keys, hot_rows))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    )
    spread = (
        per_key.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted.drop("_salts").join(spread, [*keys, "_salt"], "left").drop("_salt")


def _order_bucket(value: Column) -> Column:
    # Grows with the value; 32 buckets per power of two.
    size = F.floor(F.log2(F.abs(value)) * 32) + 40000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def group_median(
    rows: DataFrame, keys: Sequence[str], value: str, name: str
) -> DataFrame:
    """Exact median per key, nulls skipped.

    One way for all keys: values are counted, then value buckets; only the
    buckets holding the middle ranks are looked at value by value. Counts
    combine on the map side, so no task sees all rows of a group. A key
    without a value has a NULL median.
    """
    keys = list(keys)
    counted = (
        rows.select(*keys, F.col(value).cast("double").alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count("_v").alias("_n"))
        .withColumn("_b", F.coalesce(_order_bucket(F.col("_v")), F.lit(0)))
    )
    by_key = Window.partitionBy(*keys)
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(by_key.orderBy("_b")) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(by_key))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
        .where(
            (F.col("_before") < F.col("_hi"))
            & (F.col("_before") + F.col("_bn") >= F.col("_lo"))
        )
        .withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_b": "_kb"})
    )
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    middle = (
        counted.join(buckets, same)
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_bucket))
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_upto") >= F.col("_lo"), F.col("_v"))).alias("_vl"),
            F.min(F.when(F.col("_upto") >= F.col("_hi"), F.col("_v"))).alias("_vh"),
        )
        .select(*keys, ((F.col("_vl") + F.col("_vh")) / 2).alias(name))
    )
    return middle


def first_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """First row of each key by ``order``; combines on the map side, no window."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def number_rows(rows: DataFrame, source: str, position: str, name: str = "row_number") -> DataFrame:
    """1-based number over all rows in (source, position) order, nulls first.

    A prefix sum over ranges: one range shuffle deals the rows in order, each
    part is counted and numbered by itself, and the counts of the parts before
    it are added. The dealt rows are staged, because ranges are drawn from a
    sample that would be another one in a second run.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        rows.repartitionByRange(parts, source, position).withColumn("_part", F.spark_partition_id()), "numbered"
    )
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for part in range(parts):  # one number for each shuffle partition
        offsets.append(before)
        before += counts.get(part, 0)
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(source, position))
    offset = F.get(F.lit(offsets).cast("array<bigint>"), F.col("_part"))
    return dealt.withColumn(name, (offset + inner).cast("long")).drop("_part")
