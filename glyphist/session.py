"""Session settings, the shared scratch folder, and partition spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only behaviour-relevant settings; sizing (executors, memory) belongs to the job.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library's settings to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Unset is an error on a cluster: a temporary folder of one machine would lose the
    data with that machine. A local session without the setting gets a new temporary
    folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphist-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/glyphist/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For tables that are read again and again: compressed, column-pruned, and independent
    of what computed them. ``release`` removes it once its results are no longer used.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables written by ``stored``; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path is not None:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Rebalance rows that have fewer partitions than the session has cores.

    A Parquet file with one row group is one task however many cores wait. Inputs that
    already fill the cluster are returned as they are, without a shuffle. For frames
    read from files or checkpoints: asking a shuffled plan for its partitions runs it.
    """
    wanted = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def ship_with_tasks() -> None:
    """Send this package's functions to the tasks by value.

    For drivers whose import path the executors do not share; a cluster job may use
    ``--py-files`` instead.
    """
    from pyspark import cloudpickle

    import glyphist

    cloudpickle.register_pickle_by_value(glyphist)
