"""Tables that take each batch once, however often it is written.

Rows go to a folder of their own; what is valid is listed in a numbered manifest.  A commit writes the next manifest under its final
name in one step that fails if that name is taken, so a batch is in the table wholly or not at all, a retried job or a repeated micro-batch changes
nothing, and of two writers that meet one starts over from the other's manifest.  Folders that no manifest lists are leftovers
of broken jobs and are never read.
"""

from __future__ import annotations

import json
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """The tables below ``root``.  The driver holds one manifest: a line a batch and a folder name a stored part; ``compact`` makes few of many parts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = self._path(root).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.makeQualified(self._path(root)).toUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def manifest(self) -> dict:
        """The newest manifest: number, batches, folders of each table, notes."""
        folder = self._path(f"{self.root}/_ledger")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        newest = max((n for n in names if n.endswith(".json")), default=None)
        if newest is None:
            return {"number": 0, "batches": [], "tables": {}, "notes": {}}
        stream = self._fs.open(self._path(f"{self.root}/_ledger/{newest}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> bool:
        name = f"{self.root}/_ledger/{manifest['number']:012d}.json"
        begun = self._path(f"{self.root}/_ledger/_{uuid.uuid4()}")
        out = self._fs.create(begun)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._context.rename(begun, self._path(name), self._rename)
        except Exception as e:  # another writer was first, or the store is out of reach
            if not self._fs.exists(self._path(name)):
                raise
            self._fs.delete(begun, False)
            assert "Exists" in str(e) or self._fs.exists(self._path(name))
            return False
        return True

    def committed(self, batch: int | str) -> bool:
        return batch in self.manifest()["batches"]

    def commit(
        self, batch: int | str, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, notes: dict | None = None,
        by: tuple[str, ...] = (),
    ) -> bool:
        """Add rows to tables, or put rows in the place of all that tables held, as one step; False if the batch was there already.

        ``by``: columns whose values get folders of their own, so that readers can leave others out.
        """
        if self.committed(batch):
            return False
        written = {}
        for name, df in {**(append or {}), **(replace or {})}.items():
            written[name] = f"{name}/{uuid.uuid4()}"
            df.write.partitionBy(*by).parquet(f"{self.root}/{written[name]}")
        while True:
            now = self.manifest()
            if batch in now["batches"]:
                return False
            tables = {**now["tables"]}
            for name, folder in written.items():
                tables[name] = [folder] if name in (replace or {}) else [*tables.get(name, []), folder]
            if self._publish({"number": now["number"] + 1, "batches": [*now["batches"], batch], "tables": tables, "notes": {**now["notes"], **(notes or {})}}):
                return True

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of a table that are committed now."""
        folders = self.manifest()["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self._union(folders, schema)

    def _union(self, folders: list[str], schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{f}") for f in folders]
        for more in parts[1:]:
            parts[0] = parts[0].unionByName(more)
        return parts[0]

    def compact(self, name: str, schema: str, most: int = 16, by: tuple[str, ...] = (), fold: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Store the parts of a table as one if there are more than ``most``, ``fold`` applied; batches that come in meanwhile stay beside it."""
        old = self.manifest()["tables"].get(name, [])
        if len(old) <= most:
            return False
        folder, rows = f"{name}/{uuid.uuid4()}", self._union(old, schema)
        (fold(rows) if fold else rows).write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        while True:
            now = self.manifest()
            parts = now["tables"].get(name, [])
            if not set(old) <= set(parts):
                return False  # another writer has replaced them
            now["tables"][name] = [folder, *(f for f in parts if f not in old)]
            if self._publish({**now, "number": now["number"] + 1}):
                return True
