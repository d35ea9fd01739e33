"""Run metrics: row counts taken while a stage is written, and timings."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glyphist.schema import RUN_METRICS_SCHEMA


class RunLog:
    """Collects ``(stage, metric, value)`` rows of one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple[str, str, float]] = []
        self._observed: list[tuple[str, Observation]] = []

    def add(self, stage: str, metric: str, value: float) -> None:
        self.rows.append((stage, metric, float(value)))

    def counted(self, df: DataFrame, stage: str, **metrics) -> DataFrame:
        """Count the rows of ``df`` as a by-product of the next action on it.

        A stage that runs again after a lost executor may count its rows twice.
        """
        seen = Observation(f"{stage}-{len(self._observed)}")
        self._observed.append((stage, seen))
        columns = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]]
        return df.observe(seen, *columns)

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        self.add(stage, "seconds", time.perf_counter() - start)

    def collect(self) -> list[tuple[str, str, float]]:
        """All rows; waits for the actions that were observed."""
        for stage, seen in self._observed:
            for metric, value in seen.get.items():
                self.add(stage, metric, value)
        self._observed.clear()
        return self.rows

    def to_df(self) -> DataFrame:
        return self.spark.createDataFrame(self.collect(), RUN_METRICS_SCHEMA)

    def append_to(self, path: str) -> None:
        self.to_df().coalesce(1).write.mode("append").json(path)
