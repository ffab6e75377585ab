"""Sparse numbers, NULL keys, many intents, sources outside the catalogue, session zones, countries: nothing is lost or mixed up."""

from pyspark.sql import functions as F

from demandlens.operators import explore, intents, ordering, phrases
from demandlens.plans import attempts, places


def test_sparse_numbers_and_null_keys(spark):
    rows = [(None if i % 2 else 7, i * 1_000_003, 1) for i in range(1000)]
    got = ordering.running(spark.createDataFrame(rows, "g long, seq long, v long"), ["g"], "seq", {"s": ("sum", F.col("v"))}).collect()
    assert sorted(r.s for r in got) == sorted(2 * list(range(1, 501)))
    tried = spark.createDataFrame([(None, None, i * 1_000_003, "rate") for i in range(50)], "search_id long, source string, seq long, outcome string")
    strikes = attempts.breaker(tried).orderBy("seq").collect()
    assert [r.strikes for r in strikes] == list(range(1, 51)) and strikes[-1].skipped and not strikes[0].skipped
    top = lambda k: ordering.top_per_group(spark.createDataFrame(rows, "g long, seq long, v long"), ["g"], [F.col("seq")], k).count()
    assert top(1000) == top(1001) == 1000


def test_all_intents_and_sources(spark):
    words = [(1, f"p{i}", f"intent{i:02}", "", [], False, 10) for i in range(70)]
    kw = spark.createDataFrame(words, "search_id long, phrase string, intent string, place string, terms array<string>, fringe boolean, score int")
    assert explore.facets(kw, explore.KeywordQuery()).filter("dim = 'intent'").count() == 70
    seen = [(1, "a b", "elsewhere", 1.0, 0), (1, "a b", "google", 1.0, 1), (1, "a c", "nowhere", 0.5, 0), (1, "a b", "google", 0.2, 0)]
    got = phrases.aggregate_phrases(spark.createDataFrame(seen, "search_id long, phrase string, source string, w double, pos int")).orderBy("phrase").collect()
    assert [(r.phrase, r.sources, r.occ, r.best) for r in got] == [("a b", ["elsewhere", "google"], 3, 1.0), ("a c", ["nowhere"], 1, 0.5)]


def test_usage_days_are_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    log = spark.range(1).select(F.timestamp_micros(F.lit(20 * 3_600_000_000)).alias("at"), F.lit("places").alias("api"), F.lit(1).alias("n"))
    try:
        for name in ("UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [str(r.day) for r in places.usage_daily(log).collect()] == ["1970-01-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_verdicts_hold_for_their_country(spark):
    kw = spark.createDataFrame([(1, "IN", "a", "salem"), (2, "US", "b", "salem")], "search_id long, country string, phrase string, place string")
    verdicts = spark.createDataFrame([("salem", "IN", "real"), ("salem", "IN", "real"), ("salem", "US", "not")], "place string, country string, verdict string")
    assert {(r.search_id, r.place) for r in intents.validate_places(kw, verdicts).collect()} == {(1, "salem"), (2, "")}
