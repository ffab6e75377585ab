"""Leads: scoring, listing, patching and the small reports around the lead table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.functions.phone import norm_phone
from demandlens.operators import ordering
from demandlens.settings import Settings

EXTRA_TYPE = (
    "struct<hasApp:string,appEvidence:array<string>,emails:array<string>,otherPhones:array<string>,phoneNote:string,enrichError:string>"
)
BASE_SCORE = 30


def is_chain(name: Column, words: str) -> Column:
    """Whether a name holds one of the comma-separated chain names as whole words."""
    listed = [w.strip().lower() for w in (words or "").split(",") if w.strip()]
    if not listed:
        return F.lit(False)
    return text.or_blank(name).rlike(text.any_word_pattern(listed))


def score_rules(chain_words: str) -> list[tuple[Column, Column | str, int]]:
    """(condition, label, points) in the order in which signals are listed."""
    rating, reviews, phone = F.col("rating"), F.col("reviews"), text.or_blank(F.col("phone_type"))
    has_app = text.or_blank(F.col("extra.hasApp"))
    enriched = F.col("enriched").isNotNull()
    score, n_reviews = text.js_number(rating), reviews.cast("string")
    known = phone.isin("mobile", "landline", "unknown")
    found = [
        ("high_rating", rating >= 4.5, score),
        ("good_rating", (rating >= 4.0) & (rating < 4.5), score),
        ("low_rating", rating < 3.5, score),
        ("active", (reviews >= 5) & (reviews <= 150), n_reviews),
        ("known", (reviews > 150) & (reviews <= 500), n_reviews),
        ("large", reviews > 500, n_reviews),
        ("few", reviews < 5, None),
        ("mobile", phone == "mobile", None),
        ("landline", phone == "landline", None),
        ("phone", phone == "unknown", None),
        ("no_phone", ~known, None),
        ("own_app", has_app == "yes", None),
        ("portal", has_app == "maybe", None),
        ("no_app", (has_app == "no") & enriched, None),
        ("website", (text.or_blank(F.col("website")) != "") & ~enriched, None),
        ("chain", is_chain(F.col("name"), chain_words), None),
    ]
    return [(when, text.filled(fixed.SIGNALS[name][0], value), fixed.SIGNALS[name][1]) for name, when, value in found]


def score_leads(leads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Set ``score`` (0-100) and ``signals``, the itemised reasons, from rating, reviews, phone_type, extra, enriched, website,
    name.  Narrow: no shuffle."""
    rules = score_rules(settings.chain_words)
    signals = [
        F.when(c, F.struct((F.lit(x) if isinstance(x, str) else x).alias("label"), F.lit(p).alias("pts"))) for c, x, p in rules
    ]
    total = F.lit(BASE_SCORE)
    for c, _, p in rules:
        total = total + F.when(c, p).otherwise(0)
    return leads.withColumns(
        {
            "score": F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"),
            "signals": F.array_compact(F.array(*signals)),
        }
    )


def rescore(leads: DataFrame, settings: Settings, now, only: Column | None = None) -> DataFrame:
    """Score again all leads, or those ``only`` selects."""
    fresh = score_leads(leads.withColumns({"_score": F.col("score"), "_signals": F.col("signals")}), settings)
    picked = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    return fresh.withColumns(
        {
            "score": F.when(picked, F.col("score")).otherwise(F.col("_score")),
            "signals": F.when(picked, F.col("signals")).otherwise(F.col("_signals")),
            "updated": F.when(picked, F.lit(now)).otherwise(F.col("updated")),
        }
    ).drop("_score", "_signals")


def guess_area(address: Column, city: Column) -> Column:
    """The address segment before the city (or the one before that), if it does not look like a street line."""
    segments = F.filter(F.transform(F.split(text.or_blank(address), ","), text.js_trim), lambda s: s != "")
    town = F.lower(text.or_blank(city))
    at_city = F.transform(segments, lambda s: (F.lower(s) == town) | F.startswith(F.lower(s), F.concat(town, F.lit(" "))))
    i = F.array_position(at_city, True).cast("int") - 1
    street = text.word_pattern(fixed.STREET_WORDS, ignore_case=True)

    def fits(s: Column) -> Column:
        return s.isNotNull() & ~s.rlike("[0-9]") & (F.length(s) <= 30) & ~s.rlike(street)

    one, two = F.get(segments, i - 1), F.get(segments, i - 2)
    return F.when((town != "") & (i > 0) & fits(one), one).when((town != "") & (i > 1) & fits(two), two).otherwise("")


def prepare_leads(rows: DataFrame, source: str, seed: str = "", query: str = "") -> DataFrame:
    """Stamp an import with its source, seed and query, and guess a missing area."""

    def given(value: str, column: str) -> Column:
        own = text.or_blank(F.col(column)) if column in rows.columns else F.lit("")
        return F.lit(value) if value else own

    area = text.blank_to_null(F.col("area")) if "area" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns(
        {
            "source": F.lit(source),
            "seed": given(seed, "seed"),
            "query": given(query, "query"),
            "area": F.coalesce(area, guess_area(F.col("address"), F.col("city"))),
        }
    )


def guard_leads(rows: DataFrame) -> DataFrame:
    """``skip_reason``: closed businesses and rows without a name are not imported."""
    return rows.withColumn(
        "skip_reason",
        F.when(text.or_blank(F.col("status")).rlike("(?i)CLOSED"), "closed").when(text.or_blank(F.col("name")) == "", "no name"),
    )


def import_report(outcomes: DataFrame) -> DataFrame:
    """One row: inserted, updated, skipped, from ``outcomes(outcome)``."""
    return outcomes.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "skipped")]
    )


# --- patches ------------------------------------------------------------------------------------------------------------


def apply_patches(leads: DataFrame, patches: DataFrame, settings: Settings, now) -> DataFrame:
    """``patches(id, set map<string,string>)``: only known fields, valid stages and languages; rescored.  Of several rows for a lead the one with the
    most fields counts, of equals the last by its text.

    Values are cut at 2,000 characters and phones at 40, as the fields are defined.  Patches are dealt out by lead before they are
    compared: each is moved and sorted once, without its text in JSON, and the join goes on from there.  It merges, since Spark's guess of
    a map's size would send all patches everywhere.
    """
    one = patches.filter(F.col("id").isNotNull()).repartition("id").groupBy("id").agg(F.max_by("set", F.struct(F.size("set"), F.to_json("set"))).alias("_set"))
    joined = leads.join(one.hint("merge"), "id", "left")
    phone = F.element_at("_set", F.lit("phone"))
    joined = text.computed_once(joined, "_ph", norm_phone(phone, settings.cc))

    def patched(name: str) -> Column:
        # a key that is present with NULL clears the field
        value = F.left(text.or_blank(F.element_at("_set", F.lit(name))), F.lit(2000))
        given = F.coalesce(F.map_contains_key("_set", name), F.lit(False))
        if name == "stage":
            given = given & value.isin(*fixed.STAGES)
        if name == "lang":
            given = given & value.isin(*fixed.LANGUAGES)
        return F.when(given, value).otherwise(F.col(name))

    has_phone = F.coalesce(F.map_contains_key("_set", "phone"), F.lit(False))
    parsed = F.col("_ph")
    changes = {name: patched(name) for name in fixed.PATCHABLE}
    changes["phone"] = F.when(has_phone, F.left(text.or_blank(phone), F.lit(40))).otherwise(F.col("phone"))
    changes["wa"] = F.when(has_phone, parsed["wa"]).otherwise(F.col("wa"))
    changes["phone_type"] = F.when(has_phone, parsed["type"]).otherwise(F.col("phone_type"))
    return rescore(joined.withColumns(changes), settings, now, F.col("_set").isNotNull()).drop("_set", "_ph")


# --- listing ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LeadQuery:
    stage: str = ""
    q: str = ""
    min_score: float = 0
    has_phone: bool = False
    hide_app: bool = False
    hide_chains: bool = False
    query: str = ""
    sort: str = "score"
    offset: int = 0
    limit: int = 100


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _like(column: str, q: str) -> Column:
    """LIKE that folds ASCII case only; % and _ in the text stay wildcards, a backslash is an ordinary character."""
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    folded = "".join(ch.lower() if ch.isascii() else ch for ch in pattern)
    return _ascii_lower(text.or_blank(F.col(column))).like(folded)


def filter_leads(leads: DataFrame, q: LeadQuery) -> DataFrame:
    out = leads
    if q.stage:
        out = out.filter(F.col("stage") == q.stage)
    if q.q:
        out = out.filter(_like("name", q.q) | _like("area", q.q) | _like("phone", q.q) | _like("notes", q.q))
    if q.min_score:
        out = out.filter(F.col("score") >= q.min_score)
    if q.has_phone:
        out = out.filter(F.col("phone_type") != "invalid")
    if q.hide_app:
        out = out.filter(text.or_blank(F.col("extra.hasApp")) != "yes")
    if q.hide_chains:
        out = out.filter(~F.exists("signals", lambda s: F.contains(s["label"], F.lit("franchise or chain"))))
    if q.query:
        out = out.filter(F.col("query") == q.query)
    return out


def lead_order(sort: str) -> list[Column]:
    orders = {
        "new": F.col("created").desc(),
        "name": _ascii_lower(F.col("name")).asc(),
        "follow": F.col("next_followup").asc_nulls_first(),
    }
    return [orders.get(sort, F.col("score").desc()), F.col("id").desc()]


def list_leads(leads: DataFrame, q: LeadQuery) -> DataFrame:
    """One page, at most 300 rows: a distributed top-k, not a full sort."""
    limit = min(300, q.limit or 100)
    return filter_leads(leads, q).orderBy(*lead_order(q.sort)).offset(max(0, q.offset)).limit(limit)


def lead_facets(leads: DataFrame, q: LeadQuery = LeadQuery(), top: int = 20) -> DataFrame:
    """(dim, k, n): the filtered total, leads per stage and the most frequent queries, from one pass over the leads."""
    none = F.array().cast("array<struct<dim:string,k:string>>")

    def value(dim, key):
        return F.array(F.struct(F.lit(dim).alias("dim"), key.alias("k")))

    flagged = leads.select(
        "stage", "query", F.explode(F.concat(value("stage", F.col("stage")), F.when(text.or_blank(F.col("query")) != "", value("query", F.col("query"))).otherwise(none))).alias("v")
    )
    counts = flagged.groupBy("v.dim", "v.k").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordering.top_per_group(counts, ["dim"], [F.col("n").desc(), F.col("k").asc()], top).select("dim", "k", "n")
    total = filter_leads(leads, q).agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("dim"), F.lit("").alias("k"), "n")
    return ranked.unionByName(total)


def timeline(leads: DataFrame, activities: DataFrame, latest: int = 100) -> DataFrame:
    """Every lead with its newest ``latest`` activities, newest first (``pos`` from 1)."""
    newest = ordering.top_per_group(activities, ["lead_id"], [F.col("at").desc(), F.col("id").desc()], latest, "pos")
    newest = newest.withColumnRenamed("id", "activity_id")
    return leads.join(newest, leads["id"] == newest["lead_id"], "left")


def export_leads(leads: DataFrame) -> DataFrame:
    """The 18 export columns, spreadsheet-safe, instants as ISO text; sort by score when writing."""

    def iso(c: str) -> Column:
        return F.coalesce(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))

    cells = {
        "name": F.col("name"), "area": F.col("area"), "city": F.col("city"), "phone": F.col("phone"), "whatsapp": F.col("wa"),
        "website": F.col("website"), "email": F.col("email"), "rating": text.js_number(F.col("rating")), "reviews": F.col("reviews"),
        "score": F.col("score"), "stage": F.col("stage"), "touches": F.col("touches"), "next_action": F.col("next_action"),
        "next_followup": iso("next_followup"), "last_contacted": iso("last_contacted"), "has_app": F.col("extra.hasApp"),
        "notes": F.col("notes"), "maps_url": F.col("maps_url"),
    }
    return leads.select("id", F.col("score").alias("_score"), *[text.csv_safe(c).alias(n) for n, c in cells.items()])


def enrich_candidates(leads: DataFrame, most: int = 500, ids: DataFrame | None = None) -> DataFrame:
    """The best leads with a website nobody has read yet; with ``ids(id)`` those that have one, whatever their stage and whether it was read."""
    if ids is not None:
        return leads.filter(text.or_blank(F.col("website")) != "").join(ids.select("id"), "id", "left_semi").select(*leads.columns)
    open_ = ~F.col("stage").isin(*fixed.CLOSED_STAGES)
    fresh = leads.filter((text.or_blank(F.col("website")) != "") & F.col("enriched").isNull() & open_)
    return fresh.orderBy(F.col("score").desc(), F.col("id").asc()).limit(most)
