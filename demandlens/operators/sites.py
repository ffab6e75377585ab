"""Contact data from business web pages, and what it changes about a lead."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text, urls
from demandlens.functions.phone import norm_phone
from demandlens.operators.leads import score_leads
from demandlens.session import pin
from demandlens.settings import Settings

ARRAYS = ("emails", "phones", "wa", "stores", "words")
SOCIAL = ("instagram", "facebook")


def strip_html(html: Column) -> Column:
    """Script and style blocks become one space."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")


def _where(found: Column, low: Column | None, *signs: str) -> Column:
    """``found`` where the lower-cased page holds one of the signs without which nothing can be found; else what is found in no text."""
    if low is None:
        return found
    return F.when(functools.reduce(lambda a, b: a | b, [low.contains(s) for s in signs]), found)


def emails(body: Column, junk: str = fixed.JUNK_EMAIL, most: int = 5) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit("(?i)" + fixed.EMAIL), F.lit(0)), F.lower))
    return F.slice(F.filter(found, lambda e: ~e.rlike("(?i)" + junk)), 1, most)


def phones(body: Column) -> Column:
    """Ten-digit Indian mobiles in running text, then those of tel: links."""
    digits = lambda t: F.right(F.regexp_replace(t, "[^0-9]", ""), F.lit(10))
    written = F.transform(F.regexp_extract_all(body, F.lit(fixed.MOBILE), F.lit(0)), digits)  # the number is what a match ends with
    dialled = F.transform(
        F.regexp_extract_all(body, F.lit("(?i)" + fixed.TEL_HREF), F.lit(1)),
        digits,
    )
    return F.array_union(written, F.filter(dialled, lambda d: F.length(d) == 10))


def wa_links(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit("(?i)" + fixed.WHATSAPP), F.lit(1)))


def stores(body: Column) -> Column:
    return F.array_compact(F.array(*[F.when(body.rlike("(?i)" + p), F.lit(label)) for p, label in fixed.STORES]))


def portal_words(body: Column, low: Column | None = None) -> Column:
    found = [F.lower(F.regexp_extract(body, text.word_pattern(p, ignore_case=True), 0)) for p in fixed.PORTAL_WORDS]
    signs = [re.match("[a-z]+", p)[0] for p in fixed.PORTAL_WORDS]  # the word that each pattern begins with
    return F.filter(F.array(*[F.coalesce(_where(f, low, sign), F.lit("")) for f, sign in zip(found, signs, strict=True)]), lambda w: w != "")


def contact_link(html: Column) -> Column:
    """First href with "contact" in it, from the page as it came."""
    return F.regexp_extract(html, "(?i)" + fixed.CONTACT_HREF, 1)


def extract(pages: DataFrame, junk: str = fixed.JUNK_EMAIL) -> DataFrame:
    """Add the extracted columns to ``pages(html, ...)`` and drop the html.  Narrow: no shuffle, whole pages."""
    body, low = F.col("_body"), F.col("_low")
    none = F.when(low.isNotNull(), F.array().cast("array<string>"))
    blank = F.when(low.isNotNull(), F.lit(""))
    page = text.computed_once(pages, "_low", F.lower("html"))
    page = page.withColumn("contact_link", F.coalesce(_where(contact_link(F.col("html")), low, "contact"), blank))
    stripped = text.computed_once(page, "_body", F.coalesce(_where(strip_html(F.col("html")), low, "<script", "<style"), F.col("html")))
    return stripped.withColumns(
        {
            "emails": F.coalesce(_where(emails(body, junk), low, "@"), none),
            "phones": phones(body),
            "wa": F.coalesce(_where(wa_links(body), low, "wa.me/", "whatsapp.com/send"), none),
            "instagram": F.coalesce(_where(F.regexp_extract(body, "(?i)" + fixed.INSTAGRAM, 0), low, "instagram.com/"), blank),
            "facebook": F.coalesce(_where(F.regexp_extract(body, "(?i)" + fixed.FACEBOOK, 0), low, "facebook.com/"), blank),
            "stores": F.coalesce(_where(stores(body), low, "play.google", "apps.apple"), F.array().cast("array<string>")),
            "words": portal_words(body, low),
        }
    ).drop("_body", "_low", "html")


def has_app(stores: Column, words: Column) -> Column:
    return F.when(F.size(stores) > 0, "yes").when(F.size(words) > 0, "maybe").otherwise("no")


def contact_target(link: Column, base: Column) -> Column:
    """``parse`` struct of the contact page to read next, NULL if there is none on the same host."""
    target = urls.parse(urls.resolve(link, base))
    follow = (link != "") & ~link.rlike("(?i)^(mailto|tel|javascript|#)")
    return F.when(follow & (target["host"] == base["host"]) & (target["href"] != base["href"]), target)


def read_sites(leads: DataFrame, pages: DataFrame, junk: str = fixed.JUNK_EMAIL) -> DataFrame:
    """``leads(id, website)`` and a page dump ``pages(url, html)`` -> one result per lead with a website.

    Pages are reduced to their small extracted columns before any join, so html is never shuffled.  A home page is joined to
    its contact page on the resolved address; list columns are united, social links filled.
    """
    dump = extract(pages.filter(text.or_blank(F.col("html")) != ""), junk).withColumn("_u", urls.parse(F.col("url")))
    dump = dump.filter(F.col("_u").isNotNull()).withColumn("page", F.col("_u.page"))
    # one answer per address; written once, because home pages and contact pages both look into it
    found = pin(
        dump.groupBy("page").agg(F.min_by(F.struct("contact_link", *ARRAYS, *SOCIAL), F.struct("url", "contact_link")).alias("x"))
    )
    site = leads.filter(text.or_blank(F.col("website")) != "").select(
        "id", urls.parse(urls.with_scheme(F.col("website"))).alias("base")
    )
    home = site.withColumn("page", F.col("base.page")).join(found, "page", "left")
    target = contact_target(F.col("x.contact_link"), F.col("base"))
    # sites without a contact page get a key of their own that matches nothing, instead of sharing one
    home = text.computed_once(home, "page2", F.coalesce(target["page"], F.concat(F.lit("none "), F.col("id").cast("string"))))
    second = found.select(F.col("page").alias("page2"), F.col("x").alias("y"))
    both = home.join(second, "page2", "left")

    def union(c: str) -> Column:
        return F.when(F.col("y").isNull(), F.col(f"x.{c}")).otherwise(F.array_union(f"x.{c}", f"y.{c}"))

    ok = F.col("base").isNotNull() & F.col("x").isNotNull()
    out = both.select(
        "id",
        ok.alias("ok"),
        F.when(F.col("base").isNull(), "bad url").when(F.col("x").isNull(), "site did not respond").alias("reason"),
        *[union(c).alias(c) for c in ARRAYS],
        *[F.coalesce(text.blank_to_null(F.col(f"x.{c}")), F.col(f"y.{c}"), F.lit("")).alias(c) for c in SOCIAL],
    )
    return out.withColumn("hasApp", F.when(F.col("ok"), has_app(F.col("stores"), F.col("words"))))


def apply_enrichment(leads: DataFrame, sites: DataFrame, settings: Settings, now) -> DataFrame:
    """Write what ``read_sites`` found into the leads and score them again; leads without a result stay as they are.

    Of several results for a lead one that worked counts, of these the greatest field by field.
    """
    results = sites.groupBy("id").agg(F.max(F.struct("ok", "reason", "hasApp", *ARRAYS, *SOCIAL)).alias("_s"))
    joined = leads.join(results, "id", "left")
    s, ok = F.col("_s"), F.coalesce(F.col("_s.ok"), F.lit(False))
    seen = s.isNotNull()

    def blank(c: Column) -> Column:
        return text.or_blank(c) == ""

    first_wa, first_phone = F.get(s["wa"], F.lit(0)), F.get(s["phones"], F.lit(0))
    joined = text.computed_once(joined, "_link", norm_phone(F.concat(F.lit("+"), first_wa), settings.cc))
    joined = text.computed_once(joined, "_text", norm_phone(first_phone, settings.cc))
    from_link, from_text = F.col("_link"), F.col("_text")
    use_link = ok & first_wa.isNotNull() & (from_link["wa"] != "")
    not_mobile = text.or_blank(F.col("phone_type")) != "mobile"
    use_text = ok & first_wa.isNull() & not_mobile & first_phone.isNotNull() & (from_text["type"] == "mobile")
    note = F.when(use_link, "WhatsApp number from website").when(use_text, "Mobile number from website")

    def extra(field: str, value: Column) -> Column:
        return F.when(ok, value).otherwise(F.col(f"extra.{field}")).alias(field)

    new_extra = F.struct(
        extra("hasApp", s["hasApp"]),
        extra("appEvidence", F.concat(s["stores"], s["words"])),
        extra("emails", s["emails"]),
        extra("otherPhones", F.transform(s["phones"], lambda p: F.concat(F.lit("+91"), p))),
        extra("phoneNote", F.coalesce(note, F.col("extra.phoneNote"))),
        F.when(ok, F.lit(None)).otherwise(s["reason"]).alias("enrichError"),
    )
    changes = {
        "extra": F.when(seen, new_extra).otherwise(F.col("extra")),
        "enriched": F.when(seen, F.lit(now).cast("timestamp")).otherwise(F.col("enriched")),
        "updated": F.when(seen, F.lit(now).cast("timestamp")).otherwise(F.col("updated")),
        "wa": F.when(use_link, from_link["wa"]).when(use_text, from_text["wa"]).otherwise(F.col("wa")),
        "phone": F.when(use_link & blank(F.col("phone")), F.concat(F.lit("+"), first_wa))
        .when(use_text & blank(F.col("phone")), first_phone)
        .otherwise(F.col("phone")),
        "phone_type": F.when(use_link | use_text, "mobile").otherwise(F.col("phone_type")),
        "_seen": seen,
        "_score": F.col("score"),
        "_signals": F.col("signals"),
    }
    for c, found in (("email", F.get(s["emails"], F.lit(0))), ("instagram", s["instagram"]), ("facebook", s["facebook"])):
        changes[c] = F.when(ok & blank(F.col(c)), text.or_blank(found)).otherwise(F.col(c))
    scored = score_leads(joined.withColumns(changes), settings)
    return scored.withColumns(
        {
            "score": F.when(F.col("_seen"), F.col("score")).otherwise(F.col("_score")),
            "signals": F.when(F.col("_seen"), F.col("signals")).otherwise(F.col("_signals")),
        }
    ).drop("_s", "_link", "_text", "_seen", "_score", "_signals")
