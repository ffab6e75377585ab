"""Extraction from every whole page, two-page union, and enrichment of leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.checks import lead_views as v
from demandlens.checks.registry import check, table, view
from demandlens.operators import sites

JUNK = r"\.(png|jpe?g|gif|webp|svg|css|js)$|^(you|your|name|user)@"  # the provided addresses are all under example.com

_I = "CAST(page_id AS VARCHAR)"
# what is appended to a page, by page_id % 6, and the href of its contact page
_TAILS = (
    "' <a href=\"tel:+91 98' || lpad({i}, 8, '0') || '\">x</a> Student  Portal, student portal '",
    "' https://wa.me/+9197' || lpad({i}, 8, '0') || ' and WA.me/9197' || lpad({i}, 8, '0') || ' '",
    "' <a href=''https://www.Instagram.com/shop_' || {i} || '?x=1''>i</a> Download our App '",
    "' https://play.google.com/store/apps/details?id=' || {i} || ' lms '",
    "' https://facebook.com/shop.' || {i} || '/about  call 9' || lpad({i}, 4, '8') || '-' || lpad({i}, 5, '0') || ' '",
    "' <script>write(\"a' || {i} || '@shop.in\")</script> b' || {i} || '@Shop' || {i} || '.in logo@2x.png '",
)
_HREF = (
    "regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/Contact-' || {i}",
    "'/contact-' || {i}",
    "'mailto:contact' || {i} || '@shop.in'",
)


def _case(key: str, options: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {n} THEN {o.format(i=_I)}" for n, o in enumerate(options)) + " END"


view(
    "v_pages",
    f"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/p' || page_id || regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS url, html || {_case('page_id', _TAILS)} || '<a href="' || {_case('page_id', _HREF)} || '">c</a>' AS html FROM pages""",
)
view(
    "v_contacts",
    """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN page_id % 3 = 0 THEN '/Contact-' ELSE '/contact-' END || page_id AS url,
  '<p>Mail c' || page_id || '@two.in, b' || page_id || '@shop' || page_id || '.in. Student login. https://wa.me/91960000' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '</p>' AS html
  FROM pages WHERE page_id % 3 < 2""",
)


def _tail_columns():
    i = F.col("page_id").cast("string")
    return (
        F.concat(F.lit(' <a href="tel:+91 98'), F.lpad(i, 8, "0"), F.lit('">x</a> Student  Portal, student portal ')),
        F.concat(F.lit(" https://wa.me/+9197"), F.lpad(i, 8, "0"), F.lit(" and WA.me/9197"), F.lpad(i, 8, "0"), F.lit(" ")),
        F.concat(F.lit(" <a href='https://www.Instagram.com/shop_"), i, F.lit("?x=1'>i</a> Download our App ")),
        F.concat(F.lit(" https://play.google.com/store/apps/details?id="), i, F.lit(" lms ")),
        F.concat(F.lit(" https://facebook.com/shop."), i, F.lit("/about  call 9"), F.lpad(i, 4, "8"), F.lit("-"), F.lpad(i, 5, "0"), F.lit(" ")),
        F.concat(F.lit(' <script>write("a'), i, F.lit('@shop.in")</script> b'), i, F.lit("@Shop"), i, F.lit(".in logo@2x.png ")),
    )


def _origin():
    return F.regexp_extract("url", "^(https?://[^/?#]+)", 1)


def own_url():
    """Some addresses differ in their fragment only; a path of its own keeps every page apart."""
    return F.concat(_origin(), F.lit("/p"), F.col("page_id").cast("string"), F.regexp_extract("url", "^https?://[^/?#]+(.*)$", 1))


def pages(spark, d):
    k, i = F.col("page_id"), F.col("page_id").cast("string")
    href = (
        F.when(k % 3 == 0, F.concat(_origin(), F.lit("/Contact-"), i))
        .when(k % 3 == 1, F.concat(F.lit("/contact-"), i))
        .otherwise(F.concat(F.lit("mailto:contact"), i, F.lit("@shop.in")))
    )
    tail = F.when(F.lit(False), "")
    for n, c in enumerate(_tail_columns()):
        tail = tail.when(k % 6 == n, c)
    return table(spark, d, "pages").select("page_id", own_url().alias("url"), F.concat("html", tail, F.lit('<a href="'), href, F.lit('">c</a>')).alias("html"))


def contacts(spark, d):
    k, i = F.col("page_id"), F.col("page_id").cast("string")
    url = F.concat(_origin(), F.when(k % 3 == 0, "/Contact-").otherwise("/contact-"), i)
    html = F.concat(
        F.lit("<p>Mail c"), i, F.lit("@two.in, b"), i, F.lit("@shop"), i, F.lit(".in. Student login. https://wa.me/91960000"), F.lpad(i, 4, "0"), F.lit("</p>")
    )
    return table(spark, d, "pages").filter(k % 3 < 2).select("page_id", url.alias("url"), html.alias("html"))


def _q(p: str) -> str:
    return p.replace("'", "''")


def _extract_sql(source: str, keys: str) -> str:
    """Everything ``extract`` finds, over ``source``."""
    words = ", ".join(f"lower(regexp_extract(body, '(?i)\\b({p})\\b'))" for p in fixed.PORTAL_WORDS)
    stores = ", ".join(f"CASE WHEN regexp_matches(body, '(?i){p}') THEN '{label}' END" for p, label in fixed.STORES)
    return f"""SELECT {keys},
    [e for e in {_distinct("[lower(x) for x in regexp_extract_all(body, '(?i)" + _q(fixed.EMAIL) + "')]")} if NOT regexp_matches(e, '(?i){_q(JUNK)}')][1:5] AS emails,
    {_distinct("regexp_extract_all(body, '(?i)" + _q(fixed.WHATSAPP) + "', 1)")} AS wa,
    regexp_extract(body, '(?i){_q(fixed.INSTAGRAM)}') AS instagram, regexp_extract(body, '(?i){_q(fixed.FACEBOOK)}') AS facebook,
    {_phones_sql('body')} AS phones,
    [x for x in [{stores}] if x IS NOT NULL] AS stores, [x for x in [{words}] if x <> ''] AS words,
    regexp_extract(html, '(?i){_q(fixed.CONTACT_HREF)}', 1) AS contact_link
  FROM (SELECT *, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g') AS body FROM {source})"""


def _distinct(items: str) -> str:
    """First occurrences in order."""
    return f"[z.x for z in [{{'x': y, 'i': list_position({items}, y), 'n': n}} for y, n in {items}] if z.i = z.n]"


# RE2 has no look-around: every non-digit is doubled, so that one copy can serve as the end of a match and one as the next start
_MOBILE_RE2 = r"(?:^|[^0-9])(?:(?:\+\+|\+)?91(?:[\s\x0B\p{Z}-]*))?0?([6-9][0-9]{4}(?:(?:\s|\x0B|\p{Z}|-){2})?[0-9]{5})(?:$|[^0-9])"


def _phones_sql(body: str) -> str:
    """Written mobiles, then the last ten digits of tel: links."""
    doubled = f"regexp_replace({body}, '([^0-9])', '\\1\\1', 'g')"
    written = f"[regexp_replace(y, '[^0-9]', '', 'g') for y in regexp_extract_all({doubled}, '{_MOBILE_RE2}', 1)]"
    digits = f"[regexp_replace(y, '[^0-9]', '', 'g') for y in regexp_extract_all({body}, '(?i){_q(fixed.TEL_HREF)}', 1)]"
    dialled = f"[right(y, 10) for y in {digits} if length(y) >= 10]"
    return _distinct(f"list_concat({written}, {dialled})")


view("v_extract", _extract_sql("v_pages", "page_id, url"), ("v_pages",))
view("v_extract2", _extract_sql("v_contacts", "page_id, url"), ("v_contacts",))
_FLAT = "array_to_string({0}, '|') AS {0}"


@check(
    "enrich_extract",
    f"""SELECT page_id, {', '.join(_FLAT.format(c) for c in ('emails', 'phones', 'wa', 'stores', 'words'))}, instagram, facebook, contact_link FROM v_extract""",
    ("v_extract",),
)
def enrich_extract(spark, d):
    out = sites.extract(pages(spark, d), JUNK)
    return out.select(
        "page_id", *[F.array_join(c, "|").alias(c) for c in ("emails", "phones", "wa", "stores", "words")], "instagram", "facebook", "contact_link"
    )


_STRIPPED = "regexp_replace(text, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"


@check(
    "enrich_phones",
    f"""SELECT doc_id, array_to_string({_phones_sql(_STRIPPED)}, '|') AS phones FROM (
  SELECT doc_id, text || ' ' || (9000000000 + doc_id * 7) || ',+91 98765' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || ' 0' || (7000000000 + doc_id) || '1' AS text FROM documents)""",
)
def enrich_phones(spark, d):
    """Mobiles in whole documents."""
    i = F.col("doc_id")
    body = F.concat(
        "text", F.lit(" "), (F.lit(9000000000) + i * 7).cast("string"), F.lit(",+91 98765"), F.lpad(i.cast("string"), 5, "0"), F.lit(" 0"),
        (F.lit(7000000000) + i).cast("string"), F.lit("1"),
    )
    return table(spark, d, "documents").select("doc_id", F.array_join(sites.phones(sites.strip_html(body)), "|").alias("phones"))


view(
    "v_sites",
    f"""SELECT page_id + 1 AS id, CASE WHEN page_id % 50 = 0 THEN 'bad url' WHEN page_id % 5 = 4 THEN 'site did not respond' END AS reason, a.page_id,
    CASE WHEN b.page_id IS NULL THEN a.emails ELSE list_concat(a.emails, [x for x in b.emails if NOT list_contains(a.emails, x)]) END AS emails,
    CASE WHEN b.page_id IS NULL THEN a.wa ELSE list_concat(a.wa, [x for x in b.wa if NOT list_contains(a.wa, x)]) END AS wa,
    CASE WHEN b.page_id IS NULL THEN a.phones ELSE list_concat(a.phones, [x for x in b.phones if NOT list_contains(a.phones, x)]) END AS phones,
    CASE WHEN b.page_id IS NULL THEN {_distinct('a.words')} ELSE list_concat({_distinct('a.words')}, [x for x in b.words if NOT list_contains(a.words, x)]) END AS words,
    a.stores, a.instagram, a.facebook
  FROM v_extract a LEFT JOIN v_extract2 b USING (page_id)""",
    ("v_extract", "v_extract2"),
)


def site_leads(spark, d):
    k = F.col("page_id")
    website = (
        F.when(k % 50 == 0, "http://").when(k % 5 == 4, F.concat(F.lit("missing"), k.cast("string"), F.lit(".example"))).otherwise(own_url())
    )
    return table(spark, d, "pages").select((k + 1).alias("id"), website.alias("website"))


def site_results(spark, d):
    dump = pages(spark, d).select("url", "html").unionByName(contacts(spark, d).select("url", "html"))
    return sites.read_sites(site_leads(spark, d), dump, JUNK)


@check(
    "enrich_sites",
    """SELECT id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN array_to_string(emails, '|') END AS emails, CASE WHEN reason IS NULL THEN array_to_string(wa, '|') END AS wa,
  CASE WHEN reason IS NULL THEN array_to_string(list_sort(list_distinct(words)), '|') END AS words,
  CASE WHEN reason IS NULL THEN CASE WHEN len(stores) > 0 THEN 'yes' WHEN len(words) > 0 THEN 'maybe' ELSE 'no' END END AS "hasApp" FROM v_sites""",
    ("v_sites",),
)
def enrich_sites(spark, d):
    out = site_results(spark, d)
    return out.select(
        "id", "ok", "reason", F.array_join("emails", "|").alias("emails"), F.array_join("wa", "|").alias("wa"),
        F.array_join(F.array_sort(F.array_distinct("words")), "|").alias("words"), "hasApp",
    )


@check(
    "enrich_apply",
    f"""SELECT id, {v.score_sql()} AS score, wa, phone, phone_type, email, has_app, others, note, error FROM (
  SELECT l.id, name, rating, reviews, website, enriched OR s.id IS NOT NULL AS enriched, error,
    CASE WHEN link THEN s.wa[1] WHEN written THEN '91' || phones[1] ELSE l.wa END AS wa,
    CASE WHEN l.phone <> '' THEN l.phone WHEN link THEN '+' || s.wa[1] WHEN written THEN phones[1] ELSE '' END AS phone,
    CASE WHEN link OR written THEN 'mobile' ELSE l.phone_type END AS phone_type,
    CASE WHEN ok THEN coalesce(s.emails[1], '') ELSE '' END AS email,
    CASE WHEN ok THEN CASE WHEN len(stores) > 0 THEN 'yes' WHEN len(words) > 0 THEN 'maybe' ELSE 'no' END ELSE l.has_app END AS has_app,
    CASE WHEN ok THEN array_to_string(['+91' || x for x in phones], '|') END AS others,
    CASE WHEN link THEN 'WhatsApp number from website' WHEN written THEN 'Mobile number from website' END AS note
  FROM v_leads l LEFT JOIN (SELECT *, reason AS error, reason IS NULL AS ok FROM v_sites) s ON l.id = s.id,
    LATERAL (SELECT coalesce(ok AND len(s.wa) > 0, false) AS link),
    LATERAL (SELECT coalesce(ok AND len(s.wa) = 0 AND l.phone_type <> 'mobile' AND len(phones) > 0 AND phones[1] >= '6', false) AS written))""",
    ("v_sites", "v_leads"),
)
def enrich_apply(spark, d):
    out = sites.apply_enrichment(v.leads(spark, d), site_results(spark, d), v.SETTINGS, v.now())
    extra = F.col("extra")
    return out.select(
        "id", "score", "wa", "phone", "phone_type", "email", extra["hasApp"].alias("has_app"), F.array_join(extra["otherPhones"], "|").alias("others"),
        extra["phoneNote"].alias("note"), extra["enrichError"].alias("error"),
    )
