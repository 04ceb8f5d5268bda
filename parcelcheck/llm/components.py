"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcheck.session import remove_staged, staging_path


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``(a, b)``; the component is its least id.

    A round gives every vertex the least label among its neighbours and then
    the label of that label, so labels travel in growing steps. Rounds go on
    until no label changes; each is written to the shared folder and the one
    before it removed. Grouped minima combine on the map side, so a hub costs
    no more than its links. Null ends are left out, loops and repeated links
    do no harm; no links give no rows.
    """
    spark = links.sparkSession
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    edges_path = staging_path(spark, "edges")
    both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(edges_path)
    edges = spark.read.schema("a long, b long").parquet(edges_path)
    first = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    path, labels = _written(first)
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("__near"))
        moved = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("__old"), F.least("component", "__near").alias("__new")
        )
        up = labels.select(F.col("id").alias("__up"), F.col("component").alias("__top"))
        jumped = moved.join(up, moved["__new"] == up["__up"]).select(
            "id", "__old", F.least("__new", "__top").alias("component")
        )
        next_path, rows = _written(jumped)
        changed = rows.where(F.col("component") != F.col("__old")).limit(1).count()
        remove_staged(spark, path)
        path, labels = next_path, rows.select("id", "component")
        if not changed:
            remove_staged(spark, edges_path)
            return labels


def _written(rows: DataFrame) -> tuple[str, DataFrame]:
    path = staging_path(rows.sparkSession, "labels")
    rows.write.parquet(path)
    return path, rows.sparkSession.read.schema(rows.schema).parquet(path)
