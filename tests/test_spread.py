"""Rows that make many others are dealt out first, whatever files they come from; large values are moved once and never sent everywhere."""

from pyspark.sql import functions as F

from demandlens.operators import leads as L
from demandlens.plans import places, tasks
from demandlens.settings import Settings
from tests.lead_tables import NOW, lead_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_dealt_out(spark, monkeypatch):
    rows = [(i // 2, "abacus, chess", ["google"], "", "quick") for i in range(6)]  # ids repeat
    scans = spark.createDataFrame(rows, "search_id long, seed string, sources array<string>, city string, depth string").coalesce(1)
    monkeypatch.setattr(tasks, "SCANS_A_TASK", 2)
    out = tasks.expand_level1(scans)
    assert "RoundRobinPartitioning(3)" in plan_of(out)
    assert {r.search_id: r["count"] for r in out.groupBy("search_id").count().collect()} == dict.fromkeys(range(3), 2 * (1 + 76 + 11 + 26))
    assert tasks.expand_level1(scans.limit(0)).count() == 0


def test_requests_are_dealt_out(spark, monkeypatch):
    rows = [(i, ["a", "b"], "Salem", m, ["x", "y"], 1, 13.0, 80.0) for i, m in enumerate(("localities", "grid", "city", None))]
    schema = "plan_id long, queries array<string>, city string, mode string, localities array<string>, pages int, lat double, lng double"
    monkeypatch.setattr(places, "REQUESTS_A_TASK", 1)
    out = places.plan_estimate(places.plan_searches(spark.createDataFrame(rows, schema).coalesce(1)), spark.createDataFrame([(0,)], "n long"))
    assert plan_of(out).count("RoundRobinPartitioning(4)") >= 3  # one for each mode
    assert {r.plan_id: (r.searches, r.sample) for r in out.collect()} == {
        0: (4, ["a in x, Salem", "a in y, Salem", "b in x, Salem"]), 1: (74, ["a in Salem"] * 3), 2: (2, ["a in Salem", "b in Salem"]), 3: (2, ["a in Salem", "b in Salem"]),
    }


def test_patches_move_once(spark):
    leads = lead_rows(spark, [{"id": i, "name": "old"} for i in range(4)])
    rows = [(0, {"name": "a", "notes": "n"}), (0, {"name": "z"}), (1, {"name": "a"}), (1, {"name": "b"}), (None, {"name": "c"}), (9, {"name": "d"})]
    out = L.apply_patches(leads, spark.createDataFrame(rows, "id long, set map<string,string>"), Settings(), F.lit(NOW))
    assert {r.id: r["name"] for r in out.collect()} == {0: "a", 1: "b", 2: "old", 3: "old"}
    steps = plan_of(out)
    assert "BroadcastExchange" not in steps and "SortMergeJoin" in steps
    assert steps.count("max_by") and steps.index("partial_max_by") < steps.index("REPARTITION_BY_COL")  # dealt out before they are compared
