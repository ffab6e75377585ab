"""Readers for dumps of suggestion, place, app-catalogue, page and geocoder responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.plans.attempts import outcome

PLACE_SCHEMA = """array<struct<id:string,displayName:struct<text:string>,formattedAddress:string,shortFormattedAddress:string,
nationalPhoneNumber:string,internationalPhoneNumber:string,websiteUri:string,rating:double,userRatingCount:int,googleMapsUri:string,
businessStatus:string,location:struct<latitude:double,longitude:double>,types:array<string>>>"""
PLACES_BODY = f"struct<places:{PLACE_SCHEMA},nextPageToken:string>".replace("\n", "")
APPS_BODY = (
    "struct<results:array<struct<trackName:string,artistName:string,averageUserRating:double,userRatingCount:int,"
    "formattedPrice:string,primaryGenreName:string,trackViewUrl:string,currentVersionReleaseDate:string>>>"
)
GEOCODER_BODY = "array<struct<lat:string,lon:string,category:string,class:string,type:string,display_name:string>>"

# JSON inside a callback; the whole rest of the body up to the last closing parenthesis
_ARRAY_CALL = r"(?s)\((\[.*\])\)\s*;?\s*$"
_EBAY_CALL = r"(?s)cb\((.*)\)\s*;?\s*$"


def source_catalog(spark: SparkSession) -> DataFrame:
    """(id, label, is_default): seven rows."""
    return spark.createDataFrame(list(fixed.SOURCES), "id string, label string, is_default boolean")


def _json(c: Column) -> Column:
    return F.try_parse_json(c)


def _at(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def suggestion_list(source: Column, body: Column) -> Column:
    """The phrases of a raw autocomplete body in order; NULL when the body is not what the source sends.

    Four shapes: ``[query, [phrase, ...]]``; a callback around ``[query, [[phrase, ...], ...]]``; ``cb({"res": {"sug": [...]}})``, empty
    when missing; ``{"suggestions": [{"value": phrase}, ...]}``.
    """
    plain = _at(_json(body), "$[1]", "array<string>")
    called = F.transform(
        _at(_json(F.regexp_extract(body, _ARRAY_CALL, 1)), "$[1]", "array<variant>"), lambda v: _at(v, "$[0]", "string")
    )
    ebay = _json(F.regexp_extract(body, _EBAY_CALL, 1))
    missing = _at(ebay, "$.res.sug", "variant").isNull() | F.is_variant_null(_at(ebay, "$.res.sug", "variant"))
    shop = F.when(ebay.isNotNull() & missing, F.array().cast("array<string>")).otherwise(_at(ebay, "$.res.sug", "array<string>"))
    values = F.transform(_at(_json(body), "$.suggestions", "array<variant>"), lambda v: _at(v, "$.value", "string"))
    found = F.when(source == "youtube", called).when(source == "ebay", shop).when(source == "amazon", values).otherwise(plain)
    # a list element that is JSON null reads as the word
    return F.transform(found, lambda s: F.coalesce(s, F.lit("null")))


def read_responses(responses: DataFrame) -> DataFrame:
    """``responses(source, status, body, ...)`` with ``list`` and ``outcome`` (ok / rate / err)."""
    decoded = text.computed_once(responses, "list", suggestion_list(F.col("source"), F.col("body")))
    return decoded.withColumn("outcome", outcome(F.col("status"), F.col("list").isNotNull())).drop("body")


def read_suggestions(responses: DataFrame) -> DataFrame:
    """One row per suggested phrase of every ok response, with its 0-based position."""
    ok = read_responses(responses).filter(F.col("outcome") == "ok")
    return ok.select(*[c for c in ok.columns if c not in ("list", "outcome", "status")], F.posexplode("list").alias("pos", "phrase"))


def read_places(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Places responses -> one row per place (lead columns), keeping the other columns of ``bodies``."""
    keep = [c for c in bodies.columns if c != body]
    parsed = bodies.select(*keep, F.from_json(body, PLACES_BODY).alias("b"))
    p = parsed.select(*keep, F.col("b.nextPageToken").alias("token"), F.posexplode("b.places").alias("pos", "p"))

    def txt(path: str, name: str) -> Column:
        return text.or_blank(F.col(f"p.{path}")).alias(name)

    return p.select(
        *keep, "token", "pos",
        F.col("p.id").alias("place_id"), txt("displayName.text", "name"), txt("formattedAddress", "address"),
        txt("shortFormattedAddress", "area"), txt("nationalPhoneNumber", "phone"), txt("internationalPhoneNumber", "intl_phone"),
        txt("websiteUri", "website"), F.col("p.rating").alias("rating"), F.col("p.userRatingCount").alias("reviews"),
        txt("googleMapsUri", "maps_url"), txt("businessStatus", "status"), F.col("p.location.latitude").alias("lat"),
        F.col("p.location.longitude").alias("lng"), F.coalesce("p.types", F.array().cast("array<string>")).alias("types"),
    )


def read_apps(bodies: DataFrame, body: str = "body") -> DataFrame:
    """App-catalogue responses -> one row per app; a rating of 0 counts as none."""
    keep = [c for c in bodies.columns if c != body]
    a = bodies.select(*keep, F.posexplode(F.from_json(body, APPS_BODY)["results"]).alias("pos", "a"))
    rating = F.nullif(F.col("a.averageUserRating"), F.lit(0.0))
    return a.select(
        *keep, "pos", F.col("a.trackName").alias("name"), F.col("a.artistName").alias("developer"), text.to_fixed(rating, 1).alias("rating"),
        F.coalesce("a.userRatingCount", F.lit(0)).alias("ratings"), text.or_blank(F.col("a.formattedPrice")).alias("price"),
        text.or_blank(F.col("a.primaryGenreName")).alias("genre"), text.or_blank(F.col("a.trackViewUrl")).alias("url"),
        text.or_blank(F.col("a.currentVersionReleaseDate")).alias("updated"),
    )


def read_gazetteer(bodies: DataFrame) -> DataFrame:
    """Geocoder responses ``(name, country, body)`` -> (place, country, lat, lng, category, type, verdict).

    Only the first hit counts.  No hit is ``not``; a body that cannot be read is left out, so the place stays unknown.
    """
    hits = F.from_json("body", GEOCODER_BODY)
    first = F.get(hits, F.lit(0))
    category = F.when(first["category"].isin(*fixed.PLACE_CATEGORIES), first["category"]).otherwise(first["class"])
    real = category.isin(*fixed.PLACE_CATEGORIES) & first["type"].isin(*fixed.PLACE_TYPES)
    return bodies.filter(hits.isNotNull()).select(
        F.lower("name").alias("place"), "country", first["lat"].try_cast("double").alias("lat"), first["lon"].try_cast("double").alias("lng"),
        category.alias("category"), first["type"].alias("type"), F.when(real, "real").otherwise("not").alias("verdict"),
    )


def read_pages(dump: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``dump(url, html[, content_type])`` -> readable pages (url, html); an empty body means the site did not answer.

    Whole pages by default; ``max_bytes`` sets a download limit like a crawler's.
    """
    out = dump
    if "content_type" in dump.columns:
        kind = text.or_blank(F.col("content_type"))
        out = out.filter((kind == "") | kind.rlike("(?i)html|text"))
    if max_bytes:
        out = out.withColumn("html", F.left("html", F.lit(max_bytes)))
    return out.filter(text.or_blank(F.col("html")) != "").select("url", "html")
