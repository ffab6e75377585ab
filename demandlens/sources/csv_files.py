"""Lead CSV import with header aliases, and spreadsheet-safe CSV export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text


MOST_COLUMNS = 256  # of a CSV file


def _norm(s: str) -> str:
    return re.sub(r"\s+", " ", (s or "").lower()).strip()


def resolve_headers(headers: list[str], aliases=None) -> dict[str, int]:
    """Field -> column index; the first alias in list order that is present wins."""
    head = [_norm(h.lstrip("﻿")) for h in headers]
    found = {}
    for name, names in (aliases or fixed.CSV_ALIASES).items():
        at = next((head.index(n) for n in names if n in head), None)
        if at is not None:
            found[name] = at
    if "name" not in found:
        raise ValueError('Could not find a name column. Expected a header such as "name", "title" or "business name".')
    return found


def leads_from_table(raw: DataFrame, aliases=None, headers: list[str] | None = None) -> DataFrame:
    """Any table with recognisable headers -> lead columns; rows with a blank name are dropped.

    ``headers`` replaces the column names, which cannot repeat where a header row may.
    """
    at = resolve_headers(headers or raw.columns, aliases)
    cells = raw.toDF(*[f"_c{i}" for i in range(len(raw.columns))])

    def cell(name: str) -> Column:
        return text.js_trim(text.or_blank(F.col(f"_c{at[name]}").cast("string"))) if name in at else F.lit("")

    out = cells.select(
        *[cell(n).alias(n) for n in ("name", "phone", "website", "address", "city", "area", "email", "place_id", "notes", "contact_name")],
        # parseFloat: the longest numeric prefix
        _leading_number(cell("rating")).alias("rating"),
        F.regexp_replace(cell("reviews"), "[^0-9]", "").try_cast("int").alias("reviews"),
        cell("url").alias("_url"),
    )
    maps = F.col("_url").rlike("(?i)" + fixed.MAPS_URL)
    return (
        out.withColumns(
            {
                "maps_url": F.when(maps, F.col("_url")).otherwise(""),
                "website": F.when(~maps & (F.col("website") == ""), F.col("_url")).otherwise(F.col("website")),
            }
        )
        .drop("_url")
        .filter(F.col("name") != "")
    )


def _leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double")


def read_leads_csv(spark: SparkSession, path: str, aliases=None) -> DataFrame:
    """Lead CSV files, each with a header row of its own; quoted cells may hold commas, quotes and line breaks.

    Files are read in parallel, one task per file: a quoted line break makes a single file unsplittable.  Their header rows are
    compared first; files with like headers are then read together, each group by its own columns.
    """
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    cells = [f"_c{i}" for i in range(MOST_COLUMNS)]
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).option("header", False).csv(path)
    numbered = rows.select(F.array(*cells).alias("cells"), "_metadata.file_path", F.monotonically_increasing_id().alias("_n"))
    first = numbered.groupBy("file_path").agg(F.min_by("cells", "_n").alias("cells"))
    heads: dict[tuple[str, ...], list[str]] = {}
    for r in first.orderBy("file_path").toLocalIterator():  # a header row a file
        used = max((i + 1 for i, c in enumerate(r.cells) if c is not None), default=0)
        heads.setdefault(tuple(c or "" for c in r.cells[:used]), []).append(r.file_path)
    parts = []
    for head, same in heads.items():
        raw = reader.schema(", ".join(f"`_c{i}` string" for i in range(len(head)))).option("header", True).option("enforceSchema", True).csv(same)
        parts.append((raw, head))
    parts = [(raw, head) for raw, head in parts if not raw.isEmpty()]
    if not parts:
        raise ValueError("The file has no rows.")
    out = [leads_from_table(raw, aliases, list(head)) for raw, head in parts]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every cell quoted, quotes doubled, CRLF between rows.  Cells come from ``csv_safe`` columns; a BOM is for downloads."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").option(
        "emptyValue", ""
    ).csv(path)
