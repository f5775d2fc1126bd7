"""Listings of folders and buckets as a data source, for batches and for streams.

    register(spark)
    spark.read.format("listing").option("extensions", "txt,md").load("s3://bucket/folder")

path is a local folder or any address that pyarrow's file systems know (file, s3, gs, hdfs); local
ones must be mounted on every executor. There is a partition for each folder right below it and one
for the files beside those. As a stream, every batch is one poll: the whole listing with the poll's
time, as streaming.stateful.listing_changes takes it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, prefix string, size long, modified timestamp, version string, poll timestamp"


@dataclass
class Prefix(InputPartition):
    """A folder below the root; None stands for the root's own files."""

    name: str | None
    poll: int  # milliseconds


class Folder:
    """Options: path; extensions (comma-separated, default all); most_bytes (larger files are left out)."""

    def __init__(self, options: dict):
        self.path = options.get("path", "").rstrip("/")
        if not self.path:
            raise ValueError("the option path is missing")
        self.extensions = tuple("." + e.strip().lower().lstrip(".") for e in options.get("extensions", "").split(",") if e.strip())
        self.most = int(options.get("most_bytes", 0))

    def opened(self):
        from pyarrow import fs

        if "://" in self.path:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def prefixes(self, poll: int) -> list[Prefix]:
        from pyarrow import fs

        system, root = self.opened()
        below = system.get_file_info(fs.FileSelector(root, allow_not_found=False))
        return [Prefix(None, poll), *(Prefix(i.base_name, poll) for i in sorted(below, key=lambda i: i.path) if i.type == fs.FileType.Directory)]

    def rows(self, prefix: Prefix) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = self.opened()
        where = root if prefix.name is None else f"{root}/{prefix.name}"
        at = datetime.fromtimestamp(prefix.poll / 1000, UTC)
        for info in system.get_file_info(fs.FileSelector(where, recursive=prefix.name is not None, allow_not_found=True)):
            hidden = any(p.startswith((".", "_")) for p in info.path[len(root) :].split("/"))
            if info.type != fs.FileType.File or hidden or (self.extensions and not info.base_name.lower().endswith(self.extensions)) or (self.most and info.size > self.most):
                continue
            yield info.path, prefix.name or "", info.size, info.mtime, f"{info.mtime_ns}-{info.size}", at


class ListingReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Prefix]:
        return self.folder.prefixes(time.time_ns() // 1_000_000)

    def read(self, partition: Prefix) -> Iterator[tuple]:
        return self.folder.rows(partition)


class ListingStream(DataSourceStreamReader):
    """An offset is the time of a poll; a batch that is repeated lists anew under the same time."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Prefix]:
        return self.folder.prefixes(end["poll"])

    def read(self, partition: Prefix) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(Folder(self.options))

    def streamReader(self, schema) -> ListingStream:  # noqa: N802
        return ListingStream(Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
