"""Message texts, next actions and deep links for whole lead tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.operators.cadence import current_step
from demandlens.settings import Settings


def step_dim(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """(step, label, channel, template, hint): eight rows."""
    rows = [(s, label, ch, tpl, settings.hints.get(s, "")) for s, label, ch, tpl in fixed.STEPS]
    return spark.createDataFrame(rows, "step string, label string, channel string, template string, hint string")


def variables(settings: Settings) -> dict[str, Column]:
    """What each {name} in a template stands for, per lead."""
    contact, area = text.or_blank(F.col("contact_name")), text.or_blank(F.col("area"))
    hello = F.when(contact != "", text.filled(fixed.GREETINGS[0], contact)).otherwise(fixed.GREETINGS[1])
    found = F.concat(F.lit(f"I found your {settings.org} in "), area, F.lit("."))
    fixed_values = {k: F.lit(getattr(settings, k)) for k in ("sender", "product", "topic", "org", "link", "offer")}
    return {
        "hello": hello,
        **fixed_values,
        "area": area,
        "name": text.or_blank(F.col("name")),
        "area_line": F.when(area != "", found).otherwise(""),
        "details_link": F.lit(""),
    }


def render_template(template: str, values: dict[str, Column]) -> Column:
    """A template as one concatenation: cut at its tokens here, filled per row there, so filled-in text is never scanned again.

    Unknown tokens stay.  Then blanks before a line end go, three or more line ends become two, and the whole is trimmed.
    """
    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template, re.ASCII):
        if m.group(1) in values:
            pieces += [F.lit(template[at : m.start()]), values[m.group(1)]]
            at = m.end()
    filled = F.concat(*pieces, F.lit(template[at:]))
    squeezed = F.regexp_replace(F.regexp_replace(filled, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return text.js_trim(squeezed)


def render(step: Column, lang: Column, settings: Settings) -> Column:
    """The text of a step in a language, falling back to English, else ''."""
    values = variables(settings)
    out = F.when(F.lit(False), "")
    for name, _, _, tpl in fixed.STEPS:
        default = settings.templates.get(f"{tpl}_en") or ""
        for key in sorted(settings.templates):
            if key.startswith(f"{tpl}_") and key != f"{tpl}_en" and settings.templates[key]:
                out = out.when((step == name) & (lang == key[len(tpl) + 1 :]), render_template(settings.templates[key], values))
        out = out.when(step == name, render_template(default, values))
    return out.otherwise("")


def wa_link(wa: Column, message: Column) -> Column:
    return F.when(
        text.or_blank(wa) != "", F.concat(F.lit("https://wa.me/"), wa, F.lit("?text="), text.uri_component(message))
    ).otherwise("")


def tel_link(wa: Column, phone: Column) -> Column:
    raw = F.concat(F.lit("tel:"), F.regexp_replace(text.or_blank(phone), r"[^0-9+]", ""))
    return (
        F.when(text.or_blank(wa) != "", F.concat(F.lit("tel:+"), wa)).when(text.or_blank(phone) != "", raw).otherwise("")
    )


def next_actions(leads: DataFrame, settings: Settings, step: str | None = None, lang: str | None = None) -> DataFrame:
    """Add ``action``: struct(step, label, channel, hint, lang, text, wa, tel), NULL when nothing is next.

    A WhatsApp step for a lead without WhatsApp becomes the call script.  ``step`` and ``lang`` override the lead's own.
    All lookups are literals in the plan: no join, no shuffle.
    """
    labels = {s: (label, channel) for s, label, channel, _ in fixed.STEPS}

    def lookup(mapping: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col("_step"))

    chosen = F.lit(step) if step else current_step()
    language = F.lit(lang) if lang else F.coalesce(text.blank_to_null(F.col("lang")), F.lit("en"))
    can_wa = (text.or_blank(F.col("wa")) != "") & (text.or_blank(F.col("phone_type")) != "landline")
    base = leads.withColumns({"_step": chosen, "_lang": language, "_can": can_wa})
    own_channel = lookup({s: c for s, (_, c) in labels.items()})
    falls_back = (own_channel == "whatsapp") & ~F.col("_can")
    base = base.withColumns({"_call": falls_back, "_key": F.when(falls_back, "call").otherwise(F.col("_step"))})
    base = text.computed_once(base, "_text", render(F.col("_key"), F.col("_lang"), settings))
    action = F.struct(
        F.col("_key").alias("step"),
        F.when(F.col("_call"), "Call (no WhatsApp number)").otherwise(lookup({s: x for s, (x, _) in labels.items()})).alias("label"),
        F.when(F.col("_call"), "call").otherwise(own_channel).alias("channel"),
        lookup({s: settings.hints.get(s, "") for s in labels}).alias("hint"),
        F.col("_lang").alias("lang"),
        F.col("_text").alias("text"),
        F.when(F.col("_can"), wa_link(F.col("wa"), F.col("_text"))).otherwise("").alias("wa"),
        tel_link(F.col("wa"), F.col("phone")).alias("tel"),
    )
    return base.withColumn("action", F.when(F.col("_step").isNotNull(), action)).drop(
        "_step", "_lang", "_can", "_call", "_key", "_text"
    )


def queue_with_actions(due: DataFrame, fresh: DataFrame, settings: Settings) -> DataFrame:
    """Both queues, each row with its action; ``queue`` says which."""
    both = due.withColumn("queue", F.lit("due")).unionByName(fresh.withColumn("queue", F.lit("fresh")))
    return next_actions(both, settings)
