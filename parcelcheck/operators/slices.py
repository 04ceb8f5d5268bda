"""Large joins and groupings, slice by slice of a key.

All rows of a key fall in one slice, so a step that joins or groups by the key
may run for one slice after the other. Shuffle files of a slice go when it is
written, so the disk holds the shuffles of one slice only, and the results as
compressed columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcheck.session import drop_shuffles, staging_path

#: Rows of a slice, about: of the larger table of a join, and of a table grouped again and again.
JOIN_ROWS = 300_000_000
GROUP_ROWS = 32_000_000


def slices(rows: DataFrame, slice_rows: int) -> int:
    return max(1, math.ceil(rows.count() / slice_rows))


def slice_of(rows: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Rows of slice ``i`` of ``n``; null keys are in one slice."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def write_packed(rows: DataFrame, path: str) -> None:
    with drop_shuffles(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)


def by_slices(n: int, step: Callable[[int], DataFrame], label: str) -> DataFrame:
    """The rows of ``step(0)`` to ``step(n - 1)``, each written before the next begins."""
    paths = []
    for i in range(n):  # few: one for each slice_rows rows
        made = step(i)
        paths.append(staging_path(made.sparkSession, f"{label}-{i}"))
        write_packed(made, paths[-1])
    return made.sparkSession.read.schema(made.schema).parquet(*paths)
