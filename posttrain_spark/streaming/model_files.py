"""A streaming source of one file per model directory.

``<root>/<model>/<file>`` is listed at depth one, whatever characters the names hold; the engine's own
file stream lists by patterns, which names with a colon break.  The offset is the listing itself: the
modification time of each model's file, so a file that is new or was rewritten since the last batch
is read, and no other.  The driver handles names and times alone, files are read by tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from posttrain_spark.sources.files import arrow_place

FORMAT = "model_files"
# Files read by one task.
FILES_A_TASK = 64


class ModelFiles(DataSource):
    """Options: ``root``, ``file``, ``prefix`` of the directories, ``skip`` (a JSON list of names), ``content``
    (``false`` leaves ``value`` NULL)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "model string, written timestamp, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ModelFilesReader(dict(self.options))


class ModelFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.file = options["root"], options["file"]
        self.prefix, self.skip = options.get("prefix", ""), set(json.loads(options.get("skip", "[]")))
        self.content = options.get("content", "true").lower() != "false"

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Modification times in nanoseconds of the files that are there, by model."""
        system, root = arrow_place(self.root)
        listed = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(
            d.base_name
            for d in listed
            if d.type == fs.FileType.Directory and d.base_name.startswith(self.prefix) and d.base_name not in self.skip
        )
        found = system.get_file_info([f"{root}/{n}/{self.file}" for n in names]) if names else []
        return {"files": {n: f.mtime_ns or 0 for n, f in zip(names, found) if f.type == fs.FileType.File}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = sorted((n, t) for n, t in end["files"].items() if start["files"].get(n) != t)
        cuts = range(0, len(changed), FILES_A_TASK)
        return [InputPartition(changed[i : i + FILES_A_TASK]) for i in cuts] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, root = arrow_place(self.root)
        for name, written in partition.value:
            value = None
            if self.content:
                try:
                    with system.open_input_stream(f"{root}/{name}/{self.file}") as stream:
                        value = stream.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
            yield name, datetime.fromtimestamp(written / 1e9, timezone.utc), value


def read_stream(spark: SparkSession, root: str, file: str, **options: str) -> DataFrame:
    """Streaming ``model``, ``written`` and ``value`` of the files below ``root``."""
    spark.dataSource.register(ModelFiles)
    return spark.readStream.format(FORMAT).options(root=root, file=file, **options).load()
