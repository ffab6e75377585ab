"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text (A-Z lower-cased) is cut where its own characters say so; its recipe is the ordered list of its chunks' identifiers.  Recipes are
made where the text is read and only they are compared, so no text moves.  An identifier is a 64-bit hash; for the documents whose
recipes meet, every identifier in use is verified against a second hash, a checksum and the length of all chunks that bear it.  A document that holds an
identifier with two contents is compared by the SHA-256 of its whole text beside the recipe.

Defined results: a null text counts as empty; all empty texts are one group; of equal texts the row with the largest id stays, a null
id only if no other is there; rows that repeat with the same id are all reported, and of those that would stay, each is; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf, lower_ascii, with_row_keys

#: A chunk ends after the first border at or beyond LEAST characters, or after MOST.
LEAST, MOST = 1024, 8192
#: The border: two characters in a row that are rare enough in any prose, so that cuts follow content, not position.
BORDER = r"[a-h][.\s]|[^\x00-\x7f][b-k]|[0-9][0-9]"
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:{BORDER})|.{{1,{MOST}}}"


def chunks(norm: Column) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, row, recipe, facts, key, text_sha256): one scan, no shuffle.  ``facts`` verify the identifiers of ``recipe``, ``key`` is its hash.

    ``row`` names a column of row keys; without one it is null.
    """
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"), lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", "row", chunks(F.col("norm")).alias("cut"), F.sha2("norm", 256).alias("text_sha256"))
    fact = lambda c: F.struct(F.xxhash64(F.lit("second"), c).alias("other"), F.crc32(c.cast("binary")).alias("crc"), F.octet_length(c).alias("size"))
    made = cut.select("doc_id", "row", F.transform("cut", lambda c: F.xxhash64(c)).alias("recipe"), F.transform("cut", fact).alias("facts"), "text_sha256")
    return made.withColumn("key", F.xxhash64("recipe"))


def collided(table: DataFrame) -> DataFrame:
    """Identifiers that stand for two contents among the documents whose recipes meet; empty but for hash collisions."""
    shared = table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    meet = table.join(shared, "key", "left_semi").select(F.explode(F.arrays_zip("recipe", "facts")).alias("c")).select(F.col("c.recipe").alias("id"), "c.facts.*")
    two = [F.min(k) != F.max(k) for k in ("other", "crc", "size")]
    return meet.groupBy("id").agg((two[0] | two[1] | two[2]).alias("two")).filter("two").select("id")


SAME = ["recipe", "exact"]


def judged_by(table: DataFrame, shelf: Shelf) -> DataFrame:
    """Stored recipes with ``exact``: rows are equal texts if both columns of SAME are."""
    bad = shelf.put(collided(table))
    if bad.isEmpty():
        return table.withColumn("exact", F.lit(""))
    used = table.select("key", "recipe", F.explode("recipe").alias("id")).join(bad, "id", "left_semi").select("key").distinct()
    return table.join(used.withColumn("hit", F.lit(True)), "key", "left").withColumn("exact", F.when(F.col("hit"), F.col("text_sha256")).otherwise(F.lit("")))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    shelf = Shelf(docs.sparkSession)
    judged = judged_by(shelf.put(recipes(docs)), shelf)
    sizes = judged.groupBy(*SAME).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    sizes = sizes.withColumn("key", F.xxhash64("recipe")).withColumnsRenamed({"recipe": "of", "exact": "of_exact"})
    joined = judged.join(sizes, (judged["key"] == sizes["key"]) & (judged["recipe"] == sizes["of"]) & (judged["exact"] == sizes["of_exact"]))
    return joined.select(judged["doc_id"], "keep_id", "group_size", F.col("keep_id").eqNullSafe(judged["doc_id"]).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they are: one row of each group of equal texts, that of the largest id.

    A null id stays if no other is there.  Of rows that share the largest id, or have none, one stays, the last by its row key.
    """
    shelf = Shelf(docs.sparkSession)
    rows, row = with_row_keys(docs, shelf)
    judged = judged_by(shelf.put(recipes(rows, row)), shelf)
    stay = judged.groupBy(*SAME).agg(F.max(F.struct("doc_id", "row")).alias("top")).select(F.col("top.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
