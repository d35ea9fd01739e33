"""Tables between the steps of an operator, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphist.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Writes tables that outlive lost executors, and removes those that are done with.

    While a table is written, Spark is told to delete the shuffle files of that query at
    its end: whoever reads on reads the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._folder = scratch_path(spark, name)
        self._written = 0
        self._held: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._written += 1
        path = f"{self._folder}/{self._written}-{name}"
        before = self._spark.conf.get(_CLEANUP, None)
        self._spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self._spark.conf.unset(_CLEANUP)
            else:
                self._spark.conf.set(_CLEANUP, before)
        kept = self._spark.read.schema(df.schema).parquet(path)
        kept._step_path = path
        self._held.append(kept)
        return kept

    def leave(self, *tables: DataFrame) -> None:
        """Delete all tables of ``keep`` but these: once what is read on depends on these alone."""
        self.drop(*[t for t in self._held if not any(t is left for left in tables)])

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``keep`` that nothing reads any more."""
        jvm = self._spark._jvm
        self._held = [t for t in self._held if not any(t is gone for gone in tables)]
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._step_path)
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
