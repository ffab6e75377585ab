"""Stored tables: schemas, keyword sink, activity log, deletes, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.operators.leads import EXTRA_TYPE
from demandlens.sources.ledger import Ledger

SCHEMAS = {
    "searches": "id long, seed string, country string, lang string, city string, depth string, sources array<string>, requests int, "
    "phrases int, status string, note string, created timestamp, finished timestamp",
    "keywords": "search_id long, rank long, phrase string, sources array<string>, occ long, score int, band string, intent string, "
    "place string, fringe boolean, terms array<string>",
    "leads": "id long, place_id string, name string, address string, area string, city string, phone string, wa string, "
    "phone_type string, website string, email string, instagram string, facebook string, rating double, reviews int, maps_url string, "
    "lat double, lng double, source string, query string, seed string, signals array<struct<label:string,pts:int>>, "
    f"extra {EXTRA_TYPE}, score int, stage string, lang string, contact_name string, notes string, touches int, next_action string, "
    "next_followup timestamp, last_contacted timestamp, pilot_start timestamp, lost_reason string, enriched timestamp, "
    "created timestamp, updated timestamp",
    "activities": "id long, lead_id long, type string, step string, lang string, body string, at timestamp",
    "usage": "day date, api string, n long",
    "cache": "k string, v string, exp timestamp, written timestamp",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet with the declared schema, so nothing is inferred; filters and columns are pushed to the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write_keywords(keywords: DataFrame, root: str) -> None:
    """Replace all keywords of the scans in ``keywords`` and of no other scan.

    One directory per scan, swapped by dynamic partition overwrite when the job commits; a huge scan is written by many tasks.
    """
    keywords.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("search_id").parquet(f"{root}/keywords")


def stamp_phrases(searches: DataFrame, keywords: DataFrame) -> DataFrame:
    """Searches with their phrase count after a keyword write; scans without keywords in this write keep theirs."""
    counts = keywords.groupBy(F.col("search_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return searches.join(counts, "id", "left").withColumn("phrases", F.coalesce("_n", "phrases")).select(*searches.columns)


def append_activities(activities: DataFrame, root: str) -> None:
    activities.write.mode("append").parquet(f"{root}/activities")


def commit_activities(activities: DataFrame, root: str, batch: int | str) -> bool:
    """Append a batch of activities once: writing it again, as a retried job or a repeated micro-batch does, adds nothing."""
    ledger = Ledger(activities.sparkSession, f"{root}/activity_log")
    done = ledger.commit(batch, append={"activities": activities.select(*[c.split()[0] for c in SCHEMAS["activities"].split(", ")])})
    ledger.compact("activities", SCHEMAS["activities"])
    return done


def read_activities(spark: SparkSession, root: str) -> DataFrame:
    return Ledger(spark, f"{root}/activity_log").read("activities", SCHEMAS["activities"])


def drop_scans(searches: DataFrame, keywords: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the scans in ``ids(id)``."""
    return searches.join(ids, "id", "left_anti"), keywords.join(
        ids.withColumnRenamed("id", "search_id"), "search_id", "left_anti"
    )


def drop_leads(leads: DataFrame, activities: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return leads.join(ids, "id", "left_anti"), activities.join(ids.withColumnRenamed("id", "lead_id"), "lead_id", "left_anti")


def scan_history(searches: DataFrame, newest: int = 50) -> DataFrame:
    return searches.orderBy(F.col("id").desc()).limit(newest)
