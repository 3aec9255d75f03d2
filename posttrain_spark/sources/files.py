"""File moves through the session's own file system, for outputs whose names are prescribed."""

from __future__ import annotations

from urllib.parse import unquote

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf), hadoop_path, jvm.org.apache.hadoop.fs.Path


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, target, _ = _fs(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, target, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def model_files(spark: SparkSession, root: str, file: str, prefix: str = "") -> list[str]:
    """Paths of ``<root>/<model>/<file>`` for the directories that hold it.

    Listed by name, not by a pattern, as patterns break at names with a colon.
    """
    fs, target, Path = _fs(spark, root)
    found = []
    for status in fs.listStatus(target) if fs.exists(target) else []:
        if status.isDirectory() and status.getPath().getName().startswith(prefix):
            path = Path(status.getPath().toString() + "/" + file)
            if fs.exists(path):
                found.append(path.toString())
    return sorted(found)


def arrow_place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it; a path without a scheme is local."""
    if path.startswith("file:") and "://" not in path:
        path = path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(path)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename one file, replacing the target; only names move, never content."""
    fs, src, Path = _fs(spark, source)
    dst = Path(target)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst):
        fs.delete(dst, False)
    if not fs.rename(src, dst):
        raise OSError(f"could not move {source} to {target}")


def partition_value(name: str, column: str) -> str:
    """The value in a partition directory's name, which escapes some characters."""
    return unquote(name.removeprefix(f"{column}="))


def only_part_file(spark: SparkSession, folder: str) -> str:
    """The one data file of a folder; any other number is an error."""
    files = part_files(spark, folder)
    if len(files) != 1:
        raise OSError(f"expected one data file in {folder}, found {len(files)}")
    return files[0]


def part_files(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/{n}" for n in list_names(spark, folder) if n.startswith("part-")]
