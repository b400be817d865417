"""Whole-file steps on any file system that Spark reaches: list, move, delete, small texts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it doesn't exist."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, folder).listStatus(_path(spark, folder)))


def changed_at(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds of the epoch."""
    return _system(spark, path).getFileStatus(_path(spark, path)).getModificationTime() / 1000


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it; nothing if it doesn't exist."""
    _system(spark, path).delete(_path(spark, path), True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder in one step. Raises FileExistsError if ``new`` exists, and
    never moves into it."""
    sc = spark.sparkContext
    kind = sc._jvm.org.apache.hadoop.fs.Options.Rename
    if exists(spark, new):
        raise FileExistsError(f"{new} already exists")
    at = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(spark, old).getUri(), sc._jsc.hadoopConfiguration())
    at.rename(_path(spark, old), _path(spark, new), sc._gateway.new_array(kind, 0))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a new file."""
    out = _system(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
