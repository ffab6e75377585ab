"""Hand-computed rows for single operators."""

import datetime as dt

import pytest
from lead_tables import NOW, lead_rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text, urls
from demandlens.functions.phone import norm_phone
from demandlens.operators import explore, intents, leads, outreach, phrases, reports, sites
from demandlens.plans import attempts, places, tasks
from demandlens.plans.grid import cover_grid
from demandlens.settings import Settings
from demandlens.sources import csv_files, dumps, tables


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_helpers(spark):
    assert column(spark, ["  A \tB  c ", None, "﻿x"], text.norm) == ["a b c", "", "x"]
    assert column(spark, [2.5, -2.5, 0.49], text.js_round, "double") == [3, -2, 0]
    assert column(spark, ["a b (c)!*~'&é"], text.uri_component) == ["a%20b%20(c)!*~'%26%C3%A9"]
    assert column(spark, ["=1+1", "@x", "-x", "+91 98", "+(44)", "a", None], text.csv_safe) == ["'=1+1", "'@x", "'-x", "+91 98", "+(44)", "a", ""]
    assert column(spark, ["abc-தமிழ் x1", "!!"], text.tokens) == [["abc", "தமிழ்", "x1"], []]
    # a letter of another script next to a word does not hide it
    assert column(spark, ["பரapp", "myapp", "an app"], lambda c: c.rlike(text.word_pattern("apps?"))) == [True, False, True]
    assert column(spark, [4.0, 4.5], text.js_number, "double") == ["4", "4.5"]
    # 1.575 and 4.35 are stored a little below, 0.125 is a true half
    assert column(spark, [1.575, 0.125, -0.125, 2.0, 0.315], lambda c: text.to_fixed(c, 2), "double") == [1.57, 0.13, -0.13, 2.0, 0.32]
    assert column(spark, [4.35, 4.25], lambda c: text.to_fixed(c, 1), "double") == [4.3, 4.3]


def test_phones(spark):
    raw = ["097913 20405", "+91 97913 20405", "0091 97913 20405", "044 2234 5678", "22345678", "+65 6123 4567", None, "n/a", "0065 61234567"]
    got = [(r.wa, r.type) for r in column(spark, raw, norm_phone)]
    assert got == [
        ("919791320405", "mobile"), ("919791320405", "mobile"), ("919791320405", "mobile"), ("914422345678", "landline"), ("", "invalid"),
        ("6561234567", "unknown"), ("", "invalid"), ("", "invalid"), ("6561234567", "unknown"),
    ]
    other = [(r.wa, r.type) for r in column(spark, ["061234567", "+65 123", "0044 20", "65 9"], lambda c: norm_phone(c, "65"))]
    assert other == [("6561234567", "unknown"), ("65123", "unknown"), ("4420", "unknown"), ("659", "unknown")]


def test_phrase_scores(spark):
    obs = [("google", "Abacus  Classes", 0, 1.0), ("bing", "abacus classes", 1, 1.0), ("google", "abacus classes", 12, 0.8), ("google", "abacus price", 4, 0.9),
           ("bing", "buy abacus", 9, 0.6), ("google", "abacus", 0, 1.0), ("google", "chess app", 0, 1.0), ("google", "abacus " + "x" * 90, 0, 1.0), ("other", "abacus x", 0, 1.0)]
    obs = spark.createDataFrame([(7, *o) for o in obs], "search_id long, source string, phrase string, pos int, w double")
    scans = spark.createDataFrame([(7, "abacus", ["google", "bing"])], "search_id long, seed string, sources array<string>")
    rows = phrases.keyword_table(obs, scans).orderBy("rank").collect()
    assert [(r.phrase, r.sources, r.occ, r.score, r.band) for r in rows] == [
        ("abacus classes", ["bing", "google"], 3, 92, "high"), ("abacus price", ["google"], 1, 48, "medium"), ("buy abacus", ["bing"], 1, 24, "low"),
    ]


def test_terms_intents_places(spark):
    cases = [
        ("abacus classes near me", ["near me"], "local", ""),
        ("abacus kids app", ["kids", "kids app", "app"], "app", ""),
        ("abacus classes in salem", ["in salem", "salem"], "local", "salem"),
        ("abacus classes anna nagar", ["classes anna", "anna", "anna nagar", "nagar"], "local", "anna nagar"),
        ("abacus in chennai online", ["in chennai", "chennai", "chennai online"], "other", "chennai"),
        ("abacus teacher training jobs", ["teacher", "teacher training", "training", "training jobs", "jobs"], "jobs", ""),
        ("abacus in my home", ["my home", "home"], "other", ""),
        ("starting a abacus", ["starting", "starting a"], "business", ""),
    ]
    df = spark.createDataFrame([(i, c[0], ["abacus"]) for i, c in enumerate(cases)], "i int, phrase string, seeds array<string>")
    out = phrases.topic_terms(intents.classify_intent(df), "seeds").withColumn("place", intents.place_candidate(F.col("phrase")))
    assert [(r.phrase, r.terms, r.intent, r.place) for r in out.orderBy("i").collect()] == cases
    assert intents.intent_dim(spark).count() == 14


def test_place_validation_second_cut(spark):
    """A place nobody looked up moves into the top after one above it is removed."""
    rows = [("a", 5), ("b", 4), ("c", 3), ("d", 2)]
    kw = spark.createDataFrame([(1, p, f"{p}{i}") for p, n in rows for i in range(n)], "search_id long, place string, phrase string")
    verdicts = spark.createDataFrame([("a", "not"), ("b", "real"), ("c", "not")], "place string, verdict string")
    kept = intents.validate_places(kw, verdicts, top=2).filter("place <> ''").select("place").distinct()
    # c ranks third, so its verdict was never asked for; d stays outside
    assert sorted(r.place for r in kept.collect()) == ["b", "c"]


def test_app_market(spark):
    def market(n, ratings):
        df = spark.createDataFrame([("t", f"a{i}", ratings if i == 0 else 0) for i in range(n)], "term string, name string, ratings int")
        return explore.app_market(df).first()

    assert market(7, 90000).crowd == "open" and market(8, 20000).crowd == "moderate" and market(8, 20001).crowd == "crowded"
    assert market(8, 0).strongest is None and market(8, 5).strongest == "a0"


def test_lead_scores(spark):
    extra = [None] * 6

    def ex(app):
        return tuple([app] + extra[1:])

    cases = [
        ({"rating": 4.8, "reviews": 55, "phone_type": "mobile", "website": "w"}, 78, 4),
        ({"rating": 4.1, "reviews": 12, "phone_type": "landline"}, 60, 3),
        ({"phone_type": "unknown", "website": "w", "enriched": NOW, "extra": ex("no")}, 46, 2),
        ({"rating": 3.2, "reviews": 900, "phone_type": "invalid", "extra": ex("yes"), "name": "My Chain Ltd"}, 0, 5),
        ({"rating": 3.7, "reviews": 3, "phone_type": "mobile", "extra": ex("maybe")}, 38, 3),
    ]
    df = lead_rows(spark, [{"id": i, **c[0]} for i, c in enumerate(cases)])
    got = leads.score_leads(df, Settings(chain_words="big co, chain")).orderBy("id").collect()
    assert [(r.score, len(r.signals)) for r in got] == [c[1:] for c in cases]
    assert [(s.label, s.pts) for s in got[3].signals][:2] == [("Low rating 3.2", -5), ("900 reviews: likely large", 0)]


def test_area_and_lists(spark):
    address = "No 12, Gandhi St, Adyar, Chennai, Tamil Nadu 600020, India"
    df = spark.createDataFrame([(address, "Chennai"), (address, ""), ("Lake Rd, Chennai 6", "chennai"), ("Porur, 3rd Floor, Chennai", "Chennai"), (None, "x")], "a string, c string")
    assert [r.o for r in df.select(leads.guess_area(F.col("a"), F.col("c")).alias("o")).collect()] == ["Adyar", "", "", "Porur", ""]
    table = lead_rows(spark, [{"id": 1, "name": "Ünï A_b", "score": 5}, {"id": 2, "name": "AXB", "score": 9}, {"id": 3, "name": "zz", "notes": "a\\b", "score": 9}])
    assert [r.id for r in leads.list_leads(table, leads.LeadQuery(q="a_b")).collect()] == [3, 2, 1]
    assert [r.id for r in leads.list_leads(table, leads.LeadQuery(q="\\b")).collect()] == [3]
    assert [r.id for r in leads.list_leads(table, leads.LeadQuery(q="üN")).collect()] == []


def test_breaker_and_budget(spark):
    seq = "rate rate rate ok rate rate rate rate ok".split()
    df = spark.createDataFrame([(1, "s", i, o) for i, o in enumerate(seq)], "search_id long, source string, seq long, outcome string")
    for chunk in (2, 65536):
        rows = attempts.breaker(df, chunk=chunk).orderBy("seq").collect()
        assert [r.strikes for r in rows][:8] == [1, 2, 3, 0, 1, 2, 3, 4]
        assert [r.skipped for r in rows] == [False] * 8 + [True] and rows[0].off_at == 7
    todo = spark.createDataFrame([(1, i, 3, 3, False) for i in range(4)], "plan_id long, ord long, pages int, needed int, failed boolean")
    assert [r.used for r in places.admit_tasks(todo, 7, chunk=2).orderBy("ord").collect()] == [3, 3, 1, 0]
    failed = todo.withColumn("failed", F.col("ord") == 0)
    assert [r.used for r in places.admit_tasks(failed, 7).orderBy("ord").collect()] == [0, 3, 1, 0]


def test_pages_cache_plan(spark):
    rows = [(1, 1, 20, "t"), (1, 2, 20, "t"), (1, 3, 5, None), (2, 1, 20, "t"), (2, 2, 12, "t"), (2, 3, 20, "t")]
    pages = spark.createDataFrame(rows, "search_no long, page int, results int, token string")
    assert sorted((r.search_no, r.page) for r in places.follow_pages(pages).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    ms = dt.timedelta(milliseconds=1)
    cache = spark.createDataFrame([("a", "1", NOW, NOW), ("b", "1", NOW - ms, NOW), ("c", "old", NOW, NOW - ms), ("c", "new", NOW, NOW)], "k string, v string, exp timestamp, written timestamp")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert {r.k: (r.hit, r.v) for r in tasks.cache_lookup(keys, cache, NOW).collect()} == {"a": (True, "1"), "b": (False, None), "c": (True, "new"), "d": (False, None)}
    req = spark.createDataFrame([(1, ["abacus classes"], "Chennai", "localities", ["Adyar", "Anna Nagar", "T Nagar"], 0, None, None)], "plan_id long, queries array<string>, city string, mode string, localities array<string>, pages int, lat double, lng double")
    used = spark.createDataFrame([(6,)], "n long")
    est = places.plan_estimate(places.plan_searches(req), used, 200).first()
    assert (est.searches, est.worst_requests, est.room_today, est.est_usd, est.sample[0]) == (3, 9, 194, 0.32, "abacus classes in Adyar, Chennai")
    grid = cover_grid(spark.createDataFrame([(13.08, 80.27)], "lat double, lng double"), 12, 4)
    assert grid.count() == 37 and {r.radius for r in grid.collect()} == {3000}


def test_level_one(spark):
    scans = spark.createDataFrame([(1, "abacus", ["google"], "", "quick"), (2, "abacus, Abacus ,chess", ["google", "bing"], "Salem", "max")], "search_id long, seed string, sources array<string>, city string, depth string")
    out = tasks.expand_level1(scans)
    counts = {r.search_id: r["count"] for r in out.groupBy("search_id").count().collect()}
    # "near" and "can"... never collide with the letters, so one seed on one source gives all templates
    assert counts == {1: 1 + 76 + 11 + 26, 2: 2 * 2 * (1 + 76 + 11 + 26 + 10 + 26 + 4)}
    first = out.filter("search_id = 2 and source = 'bing' and q = 'abacus near Salem'").first()
    assert first.w == 0.9


HTML = """<a href="https://play.google.com/store/apps/details?id=x">app</a> <a href='https://wa.me/919876543210?text=hi'>chat</a> hello@abacusfun.in
98765 43210 <script>mail("hidden@x.in")</script> https://www.instagram.com/abacusfun/ info@example.com logo@2x.png"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "Call 91234-56789 or +91 98411 72896 <a href='../Contact.html'>c</a> student portal"), (3, "1234598765432101 <a href=\"tel:+91-98411 00000\">")], "id long, html string")
    a, b, c = sites.extract(pages).orderBy("id").collect()
    assert (a.stores, a.wa, a.emails, a.phones, a.instagram) == (["Google Play link"], ["919876543210"], ["hello@abacusfun.in"], ["9876543210"], "https://www.instagram.com/abacusfun")
    assert (b.phones, b.contact_link, b.words) == (["9123456789", "9841172896"], "../Contact.html", ["student portal"])
    assert c.phones == ["9841100000"]


def test_two_pages_and_enrichment(spark):
    dump = [
        ("https://one.in/", "<a href='/contact-us'>c</a>"), ("https://one.in/contact-us", "mail teacher@sunrise.in https://wa.me/919876500000"),
        ("http://two.in/a/b", "<a href=\"../contact\">c</a> call 98411 72896"), ("http://two.in/contact", "android app"),
        ("https://three.in/", "<a href='https://other.in/contact'>c</a>"), ("https://other.in/contact", "x@other.in"),
    ]
    pages = spark.createDataFrame(dump, "url string, html string")
    table = lead_rows(spark, [
        {"id": 1, "website": "One.in", "phone": "044 2234 5678", "wa": "914422345678", "phone_type": "landline"}, {"id": 2, "website": "http://two.in:80/x/../a/b"},
        {"id": 3, "website": "https://three.in", "email": "keep@x.in"}, {"id": 4, "website": "https://dead.in"}, {"id": 5, "website": "http://"}, {"id": 6},
    ])
    found = sites.read_sites(table, pages)
    after = {r.id: r for r in sites.apply_enrichment(table, found, Settings(), NOW).collect()}
    one, two, three, four, five, six = (after[i] for i in range(1, 7))
    assert (one.wa, one.phone, one.phone_type, one.email, one.extra.hasApp, one.extra.phoneNote) == ("919876500000", "044 2234 5678", "mobile", "teacher@sunrise.in", "no", "WhatsApp number from website")
    assert (two.wa, two.phone, two.extra.hasApp, two.extra.appEvidence, two.extra.otherPhones) == ("919841172896", "9841172896", "maybe", ["android app"], ["+919841172896"])
    assert (three.email, three.extra.emails) == ("keep@x.in", [])
    assert (four.extra.enrichError, five.extra.enrichError) == ("site did not respond", "bad url") and four.enriched is not None
    assert six.extra is None and six.enriched is None


def test_urls(spark):
    base = urls.parse(F.lit("https://Shop.in:443/a/b.html?x=1#t"))
    links = ["c.html", "/c", "//o.in/c", "http://shop.in:8080/c", "../../c/./d", "?q", "#z"]
    got = column(spark, links, lambda c: urls.parse(urls.resolve(c, base))["href"])
    assert got == ["https://shop.in/a/c.html", "https://shop.in/c", "https://o.in/c", "http://shop.in:8080/c", "https://shop.in/c/d", "https://shop.in/a/b.html?q", "https://shop.in/a/b.html?x=1#z"]


def test_messages(spark):
    table = lead_rows(spark, [
        {"id": 1, "wa": "919876543210", "phone_type": "mobile", "area": "Adyar"}, {"id": 2, "phone": "044-22 34", "phone_type": "landline", "wa": ""},
        {"id": 3, "stage": "won"}, {"id": 4, "wa": "91", "phone_type": "mobile", "lang": "ta", "contact_name": "{name}"},
    ])
    s = Settings(templates={"first_en": "{hello}\n{area_line}  \n\n\n{unknown} {name}!", "first_ta": "வணக்கம்", "call_en": "Call {org}"})
    a, b, c, d = outreach.next_actions(table, s).orderBy("id").collect()
    assert a.action.text == "Hello 🙏\nI found your centre in Adyar.\n\n{unknown} !"
    assert a.action.wa.startswith("https://wa.me/919876543210?text=Hello%20") and a.action.tel == "tel:+919876543210"
    assert (b.action.step, b.action.label, b.action.channel, b.action.wa, b.action.tel, b.action.text) == ("call", "Call", "call", "", "tel:0442234", "Call centre")
    assert c.action is None and "%E0%AE" in d.action.wa
    # a filled-in name that looks like a token is not filled again; a step without WhatsApp falls back to the call
    one = outreach.next_actions(table, s, step="first", lang="en").orderBy("id").collect()
    assert one[3].action.text.startswith("Hello {name} 🙏") and one[1].action.label == "Call (no WhatsApp number)"
    assert outreach.step_dim(spark).count() == 8


def test_funnel_and_days(spark):
    row = spark.createDataFrame([(100, 80, 40, 4, 2, 1)], "found long, reachable long, contacted long, replied long, pilot long, won long")
    w = reports.weakest_step(reports.funnel_conversion(row)).first()
    assert (w.from_stage, w.to_stage, w.percent) == ("Contacted", "Replied", 10)
    acts = spark.createDataFrame([(1, 1, "sent", "first", "en", "", NOW), (2, 1, "replied", "", "en", "", NOW - dt.timedelta(days=13)), (3, 1, "sent", "", "en", "", NOW - dt.timedelta(days=14))], tables.SCHEMAS["activities"])
    days = reports.daily_activity(acts, NOW).orderBy("day").collect()
    assert len(days) == 14 and (days[-1].sent, days[0].replied, sum(r.sent for r in days)) == (1, 1, 1)


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "leads.csv"
    path.write_text('﻿title,phoneUnformatted,website,url,totalScore,reviewsCount,address,city\n"Sunrise Abacus, Adyar",+919841112233,http://sunrise.example,https://www.google.com/maps/place/x,4.8x,"1,055","5 Lake Rd, Adyar, Chennai, India",Chennai\nBright Minds,044 4455 6677,,http://bright.in,,,,Chennai\n,123,,,,,,\n', encoding="utf-8")
    a, b = csv_files.read_leads_csv(spark, str(path)).orderBy(F.col("name").desc()).collect()
    assert (a.name, a.website, a.maps_url, a.rating, a.reviews) == ("Sunrise Abacus, Adyar", "http://sunrise.example", "https://www.google.com/maps/place/x", 4.8, 1055)
    assert (b.website, b.maps_url, b.rating, b.reviews) == ("http://bright.in", "", None, None)
    twice = tmp_path / "twice.csv"
    twice.write_text("Name,phone,NAME\nFirst,9876543210,Second\n")
    assert [r.name for r in csv_files.read_leads_csv(spark, str(twice)).collect()] == ["First"]
    bad = tmp_path / "bad.csv"
    bad.write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="name column"):
        csv_files.read_leads_csv(spark, str(bad))
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.csv").write_text('name,phone,city\n"One",111,Salem\n')
    (mixed / "b.csv").write_text("city,rating,title\nErode,4.5,Two\n")
    (mixed / "c.csv").write_text('name,phone,city\n"Three, Ltd",333,Theni\n')
    (mixed / "empty.csv").write_text("")
    got = sorted((r.name, r.phone, r.city, r.rating) for r in csv_files.read_leads_csv(spark, str(mixed)).collect())
    assert got == [("One", "111", "Salem", None), ("Three, Ltd", "333", "Theni", None), ("Two", "", "Erode", 4.5)]
    prepared = leads.prepare_leads(csv_files.read_leads_csv(spark, str(path)), "import", "abacus", "csv import").orderBy(F.col("name").desc()).first()
    assert (prepared.area, prepared.source, prepared.seed, prepared.query) == ("Adyar", "import", "abacus", "csv import")
    out = str(tmp_path / "out")
    csv_files.write_csv(leads.export_leads(lead_rows(spark, [{"id": 1, "name": 'say "hi"', "phone": "-x", "next_followup": NOW}])).drop("id", "_score").coalesce(1), out)
    body = next((tmp_path / "out").glob("part-*.csv")).read_bytes().decode()
    assert body.split("\r\n")[1].startswith('"say ""hi""","","","\'-x"') and "2024-01-31T12:00:00.000Z" in body


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    kw = spark.createDataFrame([(s, 1, p, ["a"], 1, 5, "low", "other", "", False, ["t"]) for s, p in ((1, "x"), (1, "y"), (2, "z"))], tables.SCHEMAS["keywords"])
    tables.write_keywords(kw, root)
    tables.write_keywords(kw.filter("phrase = 'y'"), root)
    assert sorted((r.search_id, r.phrase) for r in tables.read_table(spark, root, "keywords").collect()) == [(1, "y"), (2, "z")]
    act = spark.createDataFrame([(1, 1, "sent", "first", "en", "", NOW)], tables.SCHEMAS["activities"])
    tables.append_activities(act, root)
    tables.append_activities(act, root)
    assert tables.read_table(spark, root, "activities").count() == 2
    assert dumps.source_catalog(spark).filter("is_default").count() == 4
    assert len(fixed.SUFFIXES) == 76 and len(set(fixed.STOP_WORDS)) == 73 and len(set(fixed.NOT_PLACE_WORDS)) == 143


def test_brief_is_one_row_per_scan(spark):
    kw = spark.createDataFrame([Row(search_id=1, rank=1, phrase="a b", sources=["g"], occ=1, score=9, band="low", intent="local", place="x", fringe=False, terms=["b"])])
    scans = spark.createDataFrame([(1, "a", "c"), (2, "q", "")], "search_id long, seed string, city string")
    (row,) = explore.brief(kw, scans).collect()
    assert row.intents == '[{"k":"Find a provider","n":1}]' and row.places == '[{"k":"x","n":1}]' and row.total == 1
