"""Dataset manifests: which entity files exist, where their metadata lies, which split."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphist.functions.paths import base_name, metadata_name
from glyphist.session import scratch_path, stored


ENTITY_SCHEMA = "path string, length long, hidden boolean"
# Hidden and empty files are handed to Spark in pieces of this many names.
NAMES_PER_PIECE = 100_000
# Spark's list of files is kept whole in the driver, at a kilobyte or more for each and once for each
# frame. A folder of the machine, or mounted there, that has more files than this is not listed by Spark.
INDEXED_FILES = 20_000
# Names leave a task in batches of this many, contents in batches of about this many bytes.
BATCH_FILES = 10_000
BATCH_BYTES = 4 << 20
_ENTITY = pa.schema({"path": pa.string(), "length": pa.int64(), "hidden": pa.bool_()})
_CONTENT = pa.schema({"path": pa.string(), "content": pa.binary()})
# Spark gives a task 32 files at most, however small; here it gets more, up to this many bytes,
# unless that leaves fewer tasks than these for each core.
TASK_BYTES = 64 << 20
TASKS_PER_CORE = 4


# Characters that file name patterns of Spark's readers treat specially; here only * and ? are.
_PATTERN_MARKS = re.compile(r"([\\\[\]{},^])")


def _folder(spark: SparkSession, directory: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(path)


def _local(folder) -> str | None:
    """The folder's path for ``open``, if it is one of the machine or mounted there."""
    uri = folder.toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _has_many(spark: SparkSession, directory: str) -> bool:
    """Whether Spark's list of the files in and below the folder would be too long for the driver."""
    start = _local(_folder(spark, directory)[1])
    if start is None or not os.path.isdir(start):
        return False
    folders, n = [start], 0
    while folders:
        with os.scandir(folders.pop()) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    folders.append(entry.path)
                elif (n := n + 1) > INDEXED_FILES:
                    return True
    return False


def _listed(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length, hidden)`` of the files directly in a folder of the machine, as a table that a task writes.

    The checksum files of Hadoop's local file system are no entities, as in its own listings.
    """
    _, folder = _folder(spark, directory)
    local, prefix = _local(folder), folder.toString().rstrip("/")

    def files() -> Iterator[tuple[str, int, bool]]:
        with os.scandir(local) as entries:
            for entry in entries:
                name = entry.name
                if not (name[0] == "." and name.endswith(".crc")) and entry.is_file():
                    yield f"{prefix}/{name}", entry.stat().st_size, name[0] in "_."

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            found = files()
            while piece := list(islice(found, BATCH_FILES)):
                columns = [pa.array(v, t) for v, t in zip(zip(*piece), _ENTITY.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=_ENTITY)

    one = spark.range(0, 1, 1, 1)
    return stored(one.mapInArrow(run, ENTITY_SCHEMA).repartition(_tasks(spark, 0), "path"), "listing")


def _named(files: DataFrame, glob: str | None) -> DataFrame:
    """Those of the files whose names match ``glob``, in which * and ? are marks."""
    if glob is None:
        return files
    pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return files.filter(F.regexp_replace("path", r"(?s)^.*/", "").rlike(f"^(?s:{pattern})$"))


def _readable(files: DataFrame, directory: str, skip_hidden: bool) -> DataFrame:
    """The files without the hidden ones; or all, if no hidden one has content."""
    if skip_hidden:
        return files.filter("NOT hidden")
    if unread := files.filter("hidden AND length > 0").count():
        raise ValueError(f"{unread} hidden files in {directory} cannot be read; skip_hidden leaves them out")
    return files


def _dealt(files: DataFrame) -> DataFrame:
    """The files in as many tasks as their bytes ask for."""
    size = files.agg(F.sum("length")).first()[0]
    return files.repartition(_tasks(files.sparkSession, size), "path")


def _opened(files: DataFrame) -> DataFrame:
    """``(path, content)`` of files of the machine, or mounted there, opened by the tasks themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, size = [], [], 0
            for path in batch.column("path").to_pylist():
                with open(path.removeprefix("file:"), "rb") as file:
                    contents.append(file.read())
                paths.append(path)
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, _CONTENT)
                    paths, contents, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, _CONTENT)

    return _dealt(files).select("path").mapInArrow(run, "path string, content binary")


def _visible(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """``(path, length, content)`` of the files directly in ``directory`` that Spark's sources read.

    Those are the files that are neither hidden nor empty. Nested files, also in folders such
    as ``k=1``, are left out by a condition on the path that the scan applies to its list of
    files: they are not opened, and nothing is joined or shuffled. A column that is not
    asked for is not read.
    """
    _, folder = _folder(spark, directory)
    depth = folder.toUri().getPath().rstrip("/").count("/") + 1
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", _PATTERN_MARKS.sub(r"\\\1", glob))
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return reader.load(directory).filter(F.size(F.split(path, "/")) - 1 == depth).select("path", "length", "content")


def _counted(visible: DataFrame) -> tuple[int, int]:
    """The number of files, and how many tasks are to read them."""
    few = _tasks(visible.sparkSession, 0)
    n, size = visible.coalesce(few).agg(F.count("*"), F.sum("length")).first()
    return n, _tasks(visible.sparkSession, size)


def _tasks(spark: SparkSession, size: int | None) -> int:
    """How many tasks are to read files of ``size`` bytes."""
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)


def _others(spark: SparkSession, directory: str, n_visible: int) -> DataFrame:
    """``(path, length, hidden)`` of the files directly in ``directory`` that ``_visible`` does not have.

    A folder without nested ones tells how many files it has; if they are all visible, no
    name is looked at here. Otherwise the driver goes through the names and keeps the hidden
    and the empty ones, a piece at a time.
    """
    system, path = _folder(spark, directory)
    whole = system.getContentSummary(path)
    if whole.getDirectoryCount() == 1 and whole.getFileCount() == n_visible:
        return spark.createDataFrame([], ENTITY_SCHEMA)
    statuses = system.listStatusIterator(path)
    target, piece, pieces = scratch_path(spark, "listing"), [], 0

    def write() -> None:
        spark.createDataFrame(piece, ENTITY_SCHEMA).write.mode("append").parquet(target)

    while statuses.hasNext():
        status = statuses.next()
        if status.isFile():
            length, name = status.getLen(), status.getPath().getName()
            if name[0] in "_." or not length:
                piece.append((status.getPath().toString(), length, name[0] in "_."))
        if len(piece) >= NAMES_PER_PIECE:
            write()
            piece, pieces = [], pieces + 1
    if not pieces:
        return spark.createDataFrame(piece, ENTITY_SCHEMA)
    if piece:
        write()
    return spark.read.schema(ENTITY_SCHEMA).parquet(target)


def list_entities(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length, hidden)`` of every file directly in ``directory``, whatever its name.

    Empty files are listed too, and folders such as ``k=1`` neither are entities nor change
    the listing. ``hidden`` marks names that begin with ``_`` or ``.``, which Spark's sources do
    not read. The rows come from Spark's own list of files; if a folder of the machine has more than
    ``INDEXED_FILES``, from a table that a task writes; the driver then has no name at all.
    """
    if _has_many(spark, directory):
        return _dealt(_listed(spark, directory))
    visible = _visible(spark, directory)
    n, tasks = _counted(visible)
    listed = visible.coalesce(tasks).select("path", "length", F.lit(False).alias("hidden"))
    return listed.unionByName(_others(spark, directory, n))


def read_files(spark: SparkSession, directory: str, glob: str | None = None, skip_hidden: bool = False) -> DataFrame:
    """``(path, content)`` of every file directly in ``directory``.

    Empty files have empty content. Spark cannot read hidden files: one that is not empty is an
    error, unless ``skip_hidden`` leaves all hidden files out. Contents are read where the
    rows are used; they are not shuffled. The tasks open the files themselves where Spark's list of
    them would be too long for the driver (``INDEXED_FILES``).
    """
    if _has_many(spark, directory):
        files = _named(_listed(spark, directory), glob)
        return _opened(_readable(files, directory, skip_hidden))
    visible = _visible(spark, directory)
    n, tasks = _counted(visible)
    others = _others(spark, directory, n)
    if glob is not None:
        visible = _visible(spark, directory, glob)
    others = _readable(_named(others, glob), directory, skip_hidden)
    empty = others.filter("length = 0").select("path", F.lit(b"").alias("content"))
    return visible.coalesce(tasks).select("path", "content").unionByName(empty)


def manifest(paths: DataFrame, path: str, metadata_dir: str | None = None) -> DataFrame:
    """``(id, path, meta_path)`` from a table of paths.

    With ``metadata_dir`` the metadata path is that directory and the file name;
    otherwise the metadata lies beside the entity.
    """
    name: Column = F.col(path)
    if metadata_dir is not None:
        name = F.concat(F.lit(metadata_dir.rstrip("/") + "/"), F.regexp_replace(path, r"(?s)^.*[/\\]", ""))
    return paths.select(
        base_name(path).alias("id"), F.col(path).alias("path"), metadata_name(name).alias("meta_path")
    )


def write_path_lists(split_manifest: DataFrame, target: str) -> None:
    """Text path lists in ``split=.../list=.../``, one path per line, in one pass."""
    lists = F.array(
        F.struct(F.lit("entity").alias("list"), F.col("path").alias("value")),
        F.struct(F.lit("metadata").alias("list"), F.col("meta_path").alias("value")),
    )
    rows = split_manifest.select("split", F.explode(lists).alias("e")).select("split", "e.list", "e.value")
    rows.write.mode("overwrite").partitionBy("split", "list").text(target)


def read_path_list(spark: SparkSession, target: str, split: str, kind: str) -> DataFrame:
    """``(path)`` of one list; only its directory is read."""
    return spark.read.text(f"{target}/split={split}/list={kind}").select(F.col("value").alias("path"))


def write_manifest(split_manifest: DataFrame, target: str) -> None:
    """The manifest as one Parquet table, partitioned by split."""
    split_manifest.write.mode("overwrite").partitionBy("split").parquet(target)
