"""Tables that are bucketed and sorted by entity, so that joins on it move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.session import scratch_path

DEFAULT_BUCKETS = 200


def store_by_entity(rows: DataFrame, buckets: int = DEFAULT_BUCKETS, key: str = "id", name: str = "entities") -> DataFrame:
    """``rows`` as a table of ``buckets`` files by ``key``, each sorted by it, in the shared folder.

    The rows are shuffled once, here. Tables with the same number of buckets and the same type
    of key join, group and look up by it without an exchange, as often as they are used.
    Rows without a key can meet nothing and are left out. A key with a large share of the rows
    makes its bucket as large: use ``join_on_entity`` for such tables. ``release_by_entity``
    removes the table.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spark, table = rows.sparkSession, f"glyphist_{name}_{uuid.uuid4().hex}"
    # The partitioning of a shuffle is that of the buckets, so each task writes one file.
    placed = rows.filter(F.col(key).isNotNull()).repartition(buckets, key).sortWithinPartitions(key)
    writer = placed.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    stored = spark.table(table)
    stored._entity_table = table
    return stored


def release_by_entity(*tables: DataFrame) -> None:
    """Remove tables of ``store_by_entity`` and their files; other frames are left alone."""
    for table in tables:
        name = getattr(table, "_entity_table", None)
        if name is None:
            continue
        spark = table.sparkSession
        place = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first().data_type
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
