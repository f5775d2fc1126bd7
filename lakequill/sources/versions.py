"""Tables with versions: several tables that change together, each state of them readable.

A commit writes new rows and the keys that it retires to folders of its own, and then one manifest,
`_versions/<number>.json`. The manifest with the highest number is the pointer to the current state:
until it is there, readers see the old state whole, and after that the new one whole. Rows stay
where they are; a row is live in a version if it was written in it or before, and its key was not
retired after it was written. A writer that finds its number taken reads the new state and commits
after it, unless the other one changed the same keys. What a lost writer wrote is in no manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer changed the same keys meanwhile."""


class VersionedTables:
    """Tables under a path. Columns named _written are the tables' own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.path}/_versions"))

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of all states, ascending; empty before the first commit."""
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/_versions")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        return json.loads(self._text(f"{self.path}/_versions/{version:012}.json"))

    def _claim(self, version: int, manifest: dict) -> bool:
        """Put a manifest in place if its number is free: written aside, then renamed, which fails if it is there."""
        aside, final = (self._path(f"{self.path}/_versions/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:012}.json"))
        out = self._fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri())
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(aside, final, options)
        except Exception as e:  # py4j wraps it
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def commit(self, *, add: dict[str, DataFrame] | None = None, retire: dict[str, tuple[str, DataFrame]] | None = None) -> int:
        """Retire keys and add rows, all tables at once; the number of the new version.

        retire: table -> (key column, keys); rows with such a key from before this commit go. Keys
        that nothing has, and null keys, retire nothing. Slow work comes first; the commit is one
        rename.
        """
        base = (self.versions() or [0])[-1]
        manifest = {"add": {}, "retire": {}}
        for kind, frames in (("add", add or {}), ("retire", {t: keys.select(F.col(c)).where(F.col(c).isNotNull()).distinct() for t, (c, keys) in (retire or {}).items()})):
            for table, rows in frames.items():
                folder = f"{table}/{kind}-{uuid.uuid4().hex}"
                rows.write.parquet(f"{self.path}/{folder}")
                manifest[kind][table] = {"folder": folder} | ({"key": retire[table][0]} if kind == "retire" else {})
        version = base + 1
        while not self._claim(version, manifest):
            self._check(version, manifest)
            version += 1
        return version

    def _check(self, version: int, manifest: dict) -> None:
        """Raise if the commit of another writer retired, or added rows with, a key that this one retires."""
        other = self.manifest(version)
        for table, mine in manifest["retire"].items():
            keys = self.spark.read.parquet(f"{self.path}/{mine['folder']}")
            for theirs in (other[kind].get(table) for kind in ("retire", "add")):
                if theirs and not self.spark.read.parquet(f"{self.path}/{theirs['folder']}").join(keys, mine["key"], "left_semi").isEmpty():
                    raise Conflict(f"{table}: keys of this commit were changed by version {version}")

    def read(self, table: str, version: int | None = None, *, retired: bool = False) -> DataFrame:
        """The live rows of a table in a version (default: the current one), with _written, the version of the row.

        With retired, all rows up to that version, with _retired, the version that retired each (null: live).
        """
        upto = [v for v in self.versions() if version is None or v <= version]
        rows, gone, key = None, None, None
        for v in upto:
            m = self.manifest(v)
            if table in m["add"]:
                part = self.spark.read.parquet(f"{self.path}/{m['add'][table]['folder']}").withColumn("_written", F.lit(v).cast("long"))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            if table in m["retire"]:
                key = m["retire"][table]["key"]
                part = self.spark.read.parquet(f"{self.path}/{m['retire'][table]['folder']}").select(F.col(key).alias("_key"), F.lit(v).cast("long").alias("_at"))
                gone = part if gone is None else gone.unionByName(part)
        if rows is None:
            raise ValueError(f"no table {table} in this version")
        if gone is None:
            return rows.withColumn("_retired", F.lit(None).cast("long")) if retired else rows
        times = gone.groupBy("_key").agg(F.array_sort(F.collect_set("_at")).alias("_times"))  # a number a version at most
        ended = rows.join(times, F.col(key) == F.col("_key"), "left").withColumn("_retired", F.try_element_at(F.filter("_times", lambda x: x > F.col("_written")), F.lit(1))).drop("_key", "_times")
        return ended if retired else ended.where("_retired IS NULL").drop("_retired")

    def compact(self, table: str) -> int:
        """Write the live rows of a table anew as one commit, so that readers of later versions skip what was retired.

        Versions before it stay readable. A row's _written becomes the new version.
        """
        live = self.read(table).drop("_written")
        key = next((m["retire"][table]["key"] for m in map(self.manifest, reversed(self.versions())) if table in m["retire"]), None)
        if key is None:
            raise ValueError("nothing was retired")
        return self.commit(add={table: live}, retire={table: (key, live.select(key))})


def replace_documents(tables: VersionedTables, docs: DataFrame, chunks: DataFrame, *, key: str = "doc_id", documents: str = "documents", chunk_table: str = "chunks") -> int:
    """Put documents and their chunks in place of those with the same keys, in one commit."""
    keys = docs.select(key)
    return tables.commit(add={documents: docs, chunk_table: chunks}, retire={documents: (key, keys), chunk_table: (key, keys)})
