"""Helpers that several operators share: reading tables, the shared folder, Arrow text columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rules: space and the control characters 0x09 to 0x0D.  A fixed value.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset and all runs in one process (tests), a folder in the warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


class Shelf:
    """Intermediate tables of one operator run, as Parquet files in the shared folder.

    They cut the lineage, survive lost executors and are read back with pruned columns.  ``drop`` deletes a table that nothing
    reads any more; what a returned DataFrame reads must stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/{uuid.uuid4()}", 0

    def put(self, df: DataFrame, **options: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._shelf_path = path
        return kept

    def drop(self, *tables: DataFrame | None) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = getattr(table, "_shelf_path", None)
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_keys(docs: DataFrame, shelf: Shelf) -> tuple[DataFrame, str]:
    """``docs`` with a column (long) that is never null, differs in every row and is the same at every reading; and its name.

    Rows of a plain Parquet table are known by their file (numbered in the order of paths) and their place in it.  All other inputs are
    stored with their rows counted.
    """
    name = free_name(docs, "_row")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRelation":
        try:
            meta = docs.metadataColumn("_metadata")
            placed = docs.select("*", meta["file_path"].alias(file := free_name(docs, "_file")), meta["row_index"].alias(name))
            listed = list(plan.relation().location().inputFiles())
        except AnalysisException:  # another format, which doesn't number its rows
            listed = []
        if listed and len(listed) == len(set(listed)):  # a file that is read twice gives its rows twice
            files = sorted(r[0] for r in placed.select(file).distinct().collect())
            numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{file} string, {name}_file long")
            numbered = placed.join(F.broadcast(numbers), file)  # one row a file
            return numbered.select(*docs.columns, (F.shiftleft(f"{name}_file", 40) + F.col(name)).alias(name)), name
    return shelf.put(docs.withColumn(name, F.monotonically_increasing_id())), name


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is.  ``lower`` does the same on text of one-byte characters, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(-1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, n + 1 offsets) of a string or binary Arrow column; null counts as empty."""
    flat = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def batches_of(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` (one row at least), so that memory doesn't follow row length."""
    for batch in batches:
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < len(at) - 1:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end
