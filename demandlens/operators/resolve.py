"""Entity resolution: fold a batch of business records into the lead table.

Rows are taken in the order of ``seq``.  A row belongs to the lead that owns its place id; failing that, to the oldest lead that
has its WhatsApp number; failing that, it becomes a new lead.  A lead without a number or place id takes over the first one it is
given, so the answer for a row depends on the rows before it.

That dependency only runs through the keys.  Where all rows of a place id (or of a number without place ids) can only ever meet
in one lead, the match is read off the key.  The other keys are reduced to the few rows that can change who owns what; those
are a first-come matching of place ids and numbers, settled in parallel rounds (see ``matching``).  The merge itself is a plain aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions import text
from demandlens.functions.phone import norm_phone
from demandlens.operators import ordering
from demandlens.operators.leads import EXTRA_TYPE, guard_leads, score_leads
from demandlens.operators.matching import first_come
from demandlens.session import pin
from demandlens.settings import Settings

OLD = 1 << 53  # leads that exist already are numbered id - OLD, so they come before every seq of the batch
LATEST = ("address", "area", "website", "rating", "reviews", "maps_url", "lat", "lng", "city")
FIRST = ("name", "email", "instagram", "facebook", "source", "query", "seed", "lang", "contact_name", "notes")



def _decide(core: DataFrame, own0: DataFrame, hold0: DataFrame) -> DataFrame:
    """(kind, k, t, lid): which lead owns a place id, or holds a number, from which time on.

    A place id is unowned, then owned by a lead without a number, then by one with a number; what its rows without a number do is known
    beforehand, and so is what they do to a number's first holder.  Left open are the rows with both keys.  Such a row
    takes effect if its place id has no owner with a number yet and its number's oldest holder has no place id yet; then neither
    key is open afterwards.  That is a first-come matching.
    """
    p, w, seq = F.col("p"), F.col("w"), F.col("seq")
    places = core.filter(p != "").groupBy("p").agg(F.min(F.when(w == "", seq)).alias("t_blank")).join(own0, "p", "left")
    places = places.withColumn("own_from", F.coalesce("t_own", "t_blank"))
    numbers = core.filter(w != "").groupBy("w").agg(F.min(F.when(p == "", seq)).alias("t_bare")).join(hold0, "w", "left")
    numbers = numbers.withColumn("held_from", F.coalesce("t_hold", "t_bare"))
    both = core.filter((p != "") & (w != "")).join(places.filter("t_wa IS NULL").select("p", "own_from"), "p")
    owned = F.coalesce(F.col("own_from") < seq, F.lit(False))
    # the first row of a pair while the place id has no owner, and the first row with a number after it has one
    opening = both.filter(~owned).groupBy("p", "w").agg(F.min("seq").alias("t"), F.lit(None).cast("long").alias("owner"))
    filling = both.filter(owned).groupBy("p").agg(F.min_by("w", "seq").alias("w"), F.min("seq").alias("t"), F.min("own_from").alias("owner"))
    rows = opening.unionByName(filling).join(numbers.select("w", "held_from", F.col("t_sat").isNotNull().alias("settled")), "w")
    bare = F.coalesce(F.col("held_from") >= F.col("t"), F.lit(True))  # nobody holds the number before the row, unless another row with both keys made it so
    rows = pin(rows.withColumn("bare", bare))
    settles = F.col("owner").isNull() | F.col("bare") | (F.col("owner") < F.col("held_from"))
    taken = first_come(rows.filter(~F.col("settled") & settles))
    made = pin(rows.filter("owner IS NULL").join(taken.select("t"), "t", "left_semi"))
    event = lambda kind, k, t, lid: (F.lit(kind).alias("kind"), k.alias("k"), t.alias("t"), lid.alias("lid"))
    t, at_once = F.col("t"), made.filter("bare")
    named = made.select("p")
    return (
        made.select(*event("own", p, t, F.when(F.col("bare"), t).otherwise(F.col("held_from"))))
        .unionByName(at_once.select(*event("hold", w, t, t)))
        .unionByName(rows.filter("owner IS NOT NULL").join(named, "p", "left_anti").select(*event("hold", w, t, F.col("owner"))))
        .unionByName(places.filter("t_own IS NULL AND t_blank IS NOT NULL").join(named, "p", "left_anti").select(*event("own", p, F.col("t_blank"), F.col("t_blank"))))
        .unionByName(numbers.filter("t_hold IS NULL AND t_bare IS NOT NULL").select(*event("hold", w, F.col("t_bare"), F.col("t_bare"))))
    )


def match_leads(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(seq, p, w)`` with ``lid``: id - OLD of an existing lead, or the seq of the row that creates the lead.

    ``existing(id, place_id, wa)``; '' means no key.  ``seq`` is a unique integer from 0.
    """
    p, w = F.col("p"), F.col("w")
    old = existing.select(
        text.or_blank(F.col("place_id")).alias("p"), text.or_blank(F.col("wa")).alias("w"), (F.col("id") - OLD).alias("lid")
    ).filter((p != "") | (w != ""))
    keyed = pin(rows.select("seq", "p", "w").filter((p != "") | (w != "")))  # only the keys; read several times below

    # distinct key pairs, pre-aggregated; n_old counts existing leads
    pairs = keyed.select("p", "w", F.lit(0).alias("o")).unionByName(old.select("p", "w", F.lit(1).alias("o")))
    pairs = pairs.groupBy("p", "w").agg(F.sum("o").alias("n_old"))
    # a number is exclusive when all its rows carry one and the same place id, or none
    numbers = pairs.filter(w != "").groupBy("w").agg(
        (F.count(F.lit(1)) == 1).alias("exclusive"), (F.sum("n_old") <= 1).alias("few_old")
    )
    judged = pin(pairs.join(numbers, "w", "left"))
    closed_places = (
        judged.filter(p != "").groupBy("p").agg(F.min((w == "") | F.col("exclusive")).alias("closed")).filter("closed").select("p")
    )
    lone_numbers = judged.filter((p == "") & F.col("exclusive") & F.col("few_old")).select("w")
    by_place = closed_places.withColumnRenamed("p", "k").withColumn("is_place", F.lit(True))
    by_number = lone_numbers.withColumnRenamed("w", "k").withColumn("is_place", F.lit(False))
    simple_keys = by_place.unionByName(by_number)

    key = F.when(p != "", p).otherwise(w)
    tagged = keyed.withColumns({"k": key, "is_place": p != ""})
    first = tagged.groupBy("k", "is_place").agg(F.min("seq").alias("first_seq"))
    old_first = old.withColumns({"k": key, "is_place": p != ""}).groupBy("k", "is_place").agg(F.min("lid").alias("old_lid"))
    simple = (
        simple_keys.join(first, ["k", "is_place"])
        .join(old_first, ["k", "is_place"], "left")
        .select("k", "is_place", F.coalesce("old_lid", "first_seq").alias("simple_lid"))
    )
    tagged = pin(tagged.join(simple, ["k", "is_place"], "left"))
    direct = tagged.filter(F.col("simple_lid").isNotNull()).select("seq", "p", "w", F.col("simple_lid").alias("lid"))

    # the rest: matches that depend on the rows before
    core = tagged.filter(F.col("simple_lid").isNull()).select("seq", "p", "w")
    own0 = old.filter(p != "").select("p", F.col("lid").alias("t_own"), F.col("lid").alias("own_lid"), F.when(w != "", F.col("lid")).alias("t_wa"))
    hold0 = old.filter(w != "").groupBy("w").agg(F.min(F.struct("lid", (p != "").alias("placed"))).alias("m")).select(
        "w", F.col("m.lid").alias("t_hold"), F.col("m.lid").alias("min_lid"), F.when(F.col("m.placed"), F.col("m.lid")).alias("t_sat")
    )
    events = pin(_decide(core, own0, hold0))
    own = events.filter("kind = 'own'").select(F.col("k").alias("p"), F.col("t").alias("t_own"), "lid").unionByName(
        own0.select("p", "t_own", F.col("own_lid").alias("lid"))
    )
    located = core.join(own, "p", "left").withColumn(
        "lid", F.when((p != "") & (F.col("seq") >= F.col("t_own")), F.col("lid"))
    )
    found = located.filter(F.col("lid").isNotNull()).select("seq", "p", "w", "lid")
    # the others go to the oldest lead that holds the number at their time: a running minimum over holders and askers
    asking = located.filter(F.col("lid").isNull()).select("w", (F.col("seq") * 2 + 1).alias("at"), F.lit(None).cast("long").alias("lid"), "seq", "p")
    holders = events.filter("kind = 'hold'").select(F.col("k").alias("w"), (F.col("t") * 2).alias("at"), "lid")
    # of the holders a number starts with only the oldest can win
    holders = holders.unionByName(hold0.select("w", F.lit(-2).cast("long").alias("at"), F.col("min_lid").alias("lid")))
    holders = holders.withColumns({"seq": F.lit(None).cast("long"), "p": F.lit("")})
    merged = holders.select("w", "at", "lid", "seq", "p").unionByName(asking)
    held = ordering.running(merged, ["w"], "at", {"holder": ("min", F.col("lid"))})
    by_number_found = held.filter(F.col("seq").isNotNull()).select("seq", "p", "w", F.col("holder").alias("lid"))

    unkeyed = rows.filter((p == "") & (w == "")).select("seq", "p", "w", F.col("seq").alias("lid"))
    return direct.unionByName(found).unionByName(by_number_found).unionByName(unkeyed)


def _missing_safe(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def resolve_leads(existing: DataFrame, batch: DataFrame, settings: Settings, now) -> tuple[DataFrame, DataFrame]:
    """(leads, outcomes): the lead table after the batch, and inserted / updated / skipped per batch row.

    ``batch`` has ``seq`` (unique integer from 0) and the import columns; ``existing`` is the lead table.
    """
    guarded = guard_leads(batch)
    raw_phone = F.coalesce(text.blank_to_null(F.col("phone")), text.blank_to_null(F.col("intl_phone")))
    rows = text.computed_once(guarded.filter(F.col("skip_reason").isNull()), "_ph", norm_phone(raw_phone, settings.cc))
    rows = rows.withColumns(
        {"p": text.or_blank(F.col("place_id")), "w": F.col("_ph.wa"), "phone_type": F.col("_ph.type")}
    ).drop("_ph")
    matched = pin(match_leads(existing, rows.select("seq", "p", "w")).select("seq", "lid"))
    full = rows.join(matched, "seq")

    def value(c: str) -> Column:
        return F.col(c) if c in rows.columns else F.lit(None).cast("string")

    has_wa, has_place = F.col("w") != "", F.col("p") != ""
    phone = F.struct(F.col("w").alias("wa"), text.or_blank(F.col("phone")).alias("phone"), F.col("phone_type").alias("phone_type"))
    folded = full.groupBy("lid").agg(
        *[F.max_by(F.when(_missing_safe(c), F.col(c)), F.when(_missing_safe(c), F.col("seq"))).alias(f"b_{c}") for c in LATEST],
        *[F.min_by(text.or_blank(value(c)), "seq").alias(f"b_{c}") for c in FIRST],
        F.min_by(F.when(has_wa, phone), F.when(has_wa, F.col("seq"))).alias("b_reached"),
        F.min_by(phone, "seq").alias("b_phone"),
        F.min_by(F.when(has_place, F.col("p")), F.when(has_place, F.col("seq"))).alias("b_place"),
    )
    old = existing.withColumn("lid", F.col("id") - OLD)
    created = folded.filter(F.col("lid") >= 0).select("lid")
    top_id = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = ordering.running(created, [], "lid", {"_n": ("sum", F.lit(1))}).select("lid", (top_id + F.col("_n")).alias("new_id"))

    got = F.col("b_reached")
    upd = old.join(folded, "lid", "left")
    touched = F.col("b_name").isNotNull()
    keeps_wa = text.or_blank(F.col("wa")) != ""
    changes = {c: F.coalesce(F.col(f"b_{c}"), F.col(c)) for c in LATEST}
    for c in ("phone", "phone_type"):
        changes[c] = F.when(~keeps_wa & got.isNotNull(), got[c]).otherwise(F.col(c))
    changes["wa"] = F.when(~keeps_wa & got.isNotNull(), got["wa"]).otherwise(F.col("wa"))
    changes["place_id"] = F.coalesce(text.blank_to_null(F.col("place_id")), F.col("b_place"))
    changes["updated"] = F.when(touched, F.lit(now)).otherwise(F.col("updated"))
    changes["_touched"] = touched
    updated = upd.withColumns(changes)
    kept_score = {"_score": F.col("score"), "_signals": F.col("signals")}
    rescored = score_leads(updated.withColumns(kept_score), settings).withColumns(
        {
            "score": F.when(F.col("_touched"), F.col("score")).otherwise(F.col("_score")),
            "signals": F.when(F.col("_touched"), F.col("signals")).otherwise(F.col("_signals")),
        }
    )

    chosen = F.coalesce(got, F.col("b_phone"))
    fresh = folded.filter(F.col("lid") >= 0).join(numbered, "lid")
    new = {c: F.coalesce(F.col(f"b_{c}"), F.lit("")) for c in LATEST if c not in ("rating", "reviews", "lat", "lng")}
    new |= {c: F.col(f"b_{c}") for c in ("rating", "reviews", "lat", "lng")}
    new |= {c: F.col(f"b_{c}") for c in FIRST}
    new |= {
        "id": F.col("new_id"), "place_id": F.col("b_place"), "wa": chosen["wa"], "phone": chosen["phone"], "phone_type": chosen["phone_type"],
        "lang": F.coalesce(text.blank_to_null(F.col("b_lang")), F.lit(settings.lang)),
        "source": F.coalesce(text.blank_to_null(F.col("b_source")), F.lit("manual")),
        "extra": F.lit(None).cast(EXTRA_TYPE), "stage": F.lit("new"), "touches": F.lit(0), "created": F.lit(now), "updated": F.lit(now),
        "enriched": F.lit(None).cast("timestamp"),
    }
    inserted = score_leads(fresh.withColumns(new), settings)
    types = {f.name: f.dataType for f in existing.schema.fields}
    out_cols = existing.columns
    inserted = inserted.select(
        *[(F.col(c) if c in inserted.columns else F.lit(None)).cast(types[c]).alias(c) for c in out_cols]
    )
    rescored = rescored.select(*[F.col(c).cast(types[c]).alias(c) for c in out_cols])
    skipped = guarded.filter(F.col("skip_reason").isNotNull()).select("seq", F.lit("skipped").alias("outcome"), "skip_reason")
    outcomes = matched.select(
        "seq", F.when(F.col("lid") == F.col("seq"), "inserted").otherwise("updated").alias("outcome"), F.lit(None).cast("string").alias("skip_reason")
    ).unionByName(skipped)
    return rescored.unionByName(inserted), outcomes
