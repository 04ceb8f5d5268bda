"""Metrics of the steps of a job: rows, columns, seconds, fixed and empty shapes."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelcheck.session import stage


@dataclass
class StepLog:
    """Runs steps by writing their results to the shared folder.

    The counters are observed while a step is written, so nothing is computed
    twice; one row for each step is kept.
    """

    rows: list[tuple] = field(default_factory=list)

    def run(self, step: str, df: DataFrame, empty: Column, fixed: Column | None = None) -> DataFrame:
        """Write ``df`` and count its rows, those where ``empty`` holds and those where ``fixed`` does."""
        watch = Observation(step)
        seen = df.observe(
            watch,
            F.count(F.lit(1)).alias("n"),
            F.count_if(empty).alias("empty"),
            F.count_if(F.lit(False) if fixed is None else fixed).alias("fixed"),
        )
        begun = time.perf_counter()
        done = stage(seen, step)
        got = watch.get
        self.rows.append(
            (step, got["n"], len(df.columns), got["empty"], got["fixed"], time.perf_counter() - begun)
        )
        return done

    def table(self, spark: SparkSession) -> DataFrame:
        """``step, rows, columns, empty, fixed, seconds`` in the order the steps ran."""
        return spark.createDataFrame(
            self.rows, "step string, rows long, columns int, empty long, fixed long, seconds double"
        )
