"""Tables in versioned folders: a write makes new folders and then adds a pointer, so readers see the old
table or the new one, and a job that is lost in between changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import patch, upsert, upsert_newer


class WriteConflict(RuntimeError):
    """Another writer has the version that was to be written; the table is as that writer leaves it."""


class TableStore:
    """``root`` is any address Spark can write. The newest pointer names the folders of a table's version;
    folders are never written again, and an append adds one to those of the version before."""

    _POINTER = "number long, writer string, paths array<string>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        """A path and its file system, as Spark's own readers and writers see them."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}/_pointers"
        where, files = self._file(path)
        return self.spark.read.schema(self._POINTER).parquet(path) if files.exists(where) else None

    def _version(self, name: str) -> tuple[int, list[str]]:
        pointers = self._pointers(name)
        row = pointers.orderBy("number", ascending=False).first() if pointers else None
        return (row.number, row.paths) if row else (0, [])

    def _claim(self, name: str, number: int):
        return self._file(f"{self.root}/{name}/_claims/{number}")

    def _publish(self, name: str, number: int, paths: list[str]) -> None:
        """A version belongs to the writer that makes its claim, a file that must not exist; file systems make such a
        file once. A writer that finds the claim made, or the version there, changes nothing."""
        where, files = self._claim(name, number)
        if not files.createNewFile(where) or self._version(name)[0] >= number:
            raise WriteConflict(f"version {number} of {name} was claimed by another job")
        self.spark.createDataFrame([(number, uuid.uuid4().hex, paths)], self._POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/_pointers")

    def release(self, name: str) -> None:
        """Gives up the claim of the next version, of a job that is known to be lost before it wrote its pointer."""
        where, files = self._claim(name, self._version(name)[0] + 1)
        files.delete(where, False)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        _, paths = self._version(name)
        if not paths:
            if schema is None:
                raise LookupError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*paths)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        number, _ = self._version(name)
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._publish(name, number + 1, [path])

    def append(self, name: str, rows: DataFrame, batch: str | None = None) -> None:
        """Adds rows as a folder of their own; a named batch that is there already adds nothing."""
        number, paths = self._version(name)
        path = f"{self.root}/{name}/{batch or uuid.uuid4().hex}"
        if path not in paths:
            rows.write.mode("overwrite").parquet(path)  # of a batch that was lost before its pointer
            self._publish(name, number + 1, [*paths, path])

    def upsert(self, name: str, rows: DataFrame, keys: list[str], newer: str | None = None, schema: str | None = None) -> None:
        """``newer``: only rows whose time in that column is not before the known one count."""
        old = self.read(name, schema)
        self.overwrite(name, upsert_newer(old, rows, keys, newer) if newer else upsert(old, rows, keys))

    def patch(self, name: str, where, values: dict) -> None:
        self.overwrite(name, patch(self.read(name), where, values))
