import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.dataset import Dataset
from tidemark.operators import verify as vf
from tidemark.operators import correlation as co, forest, joins as jn, outliers as ou, profiling as pr, segments as sg, trend as tr, windows as wn
from tidemark.plans import analyze as az
from tidemark.registry import run_tool


def days(spark, values):
    return spark.createDataFrame([(f"2025-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)], "day string, v double")


def test_trend_stable_and_down(spark):
    r = tr.trend(days(spark, [100 + i * 2 / 9 for i in range(10)]), "day", "v").summary.first()
    assert r["overall_trend"] == "stable"
    r = tr.trend(days(spark, [100 - i * 40 / 9 for i in range(10)]), "day", "v").summary.first()
    assert r["percentage_change"] == -40.0 and r["overall_trend"] == "downward" and r["p_value"] < 1e-6
    assert tr.trend(days(spark, [1, 2]), "day", "v").status == "skipped"


def test_profile_edges(spark):
    d = spark.createDataFrame([(None, 5, True, "a"), (None, 5, False, "b")], "n double, c int, b boolean, t string")
    p = {r["column"]: r for r in pr.profile_columns(d).collect()}
    assert p["n"]["null_percentage"] == 100.0 and p["c"]["unique_count"] == 1 and p["b"]["inferred_type"] == "boolean"
    assert "Only one value (constant column)" in p["c"]["warnings"]
    assert p["t"]["inferred_type"] == "categorical"


def test_imputed_cells_do_not_count(spark):
    rows = [(float(i), float(2 * i), i >= 40) for i in range(50)]
    d = spark.createDataFrame(rows, "x double, y double, _imputed_y boolean")
    ds = Dataset(d, ["y"])
    pair = co.correlation_pairs(ds).first()
    assert (pair["n_used"], pair["n_excluded"], pair["correlation"]) == (40, 10, 1.0)
    s = ou.outliers(ds).summary.first()
    assert s["n_used"] + s["n_excluded"] == 50 == s["total_records"]


def test_anova_and_guard(spark):
    d = spark.range(300).select((F.col("id") % 3).cast("string").alias("g"), ((F.col("id") % 3) * 10 + F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("string").alias("row_id"))
    r = sg.segment_compare(d, "g", "x")
    assert r.summary.first()["is_significant"]
    with pytest.raises(ValueError, match="identifier"):
        sg.segment_compare(d, "row_id", "x")
    assert run_tool("segment_compare", az.as_dataset(d), segment="row_id", metric="x").status == "error"


def test_no_variance_gives_no_f(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert sg.anova(d, "g", "x").first()["f_statistic"] is None


def test_rates_and_yates(spark):
    rows = [("s", "Yes")] * 8 + [("s", "no")] * 12 + [("t", "yes")] * 15 + [("t", "No")] * 5 + [("nan", "Yes"), ("t", "none")]
    d = spark.createDataFrame(rows, "seg string, churned string").withColumn("churned", F.initcap("churned"))
    r = sg.segment_compare(d, "seg", "churned")
    rates = {x["segment"]: x["rate_percent"] for x in r.tables["segments"].collect()}
    assert rates == {"s": 40.0, "t": 75.0}
    # 2x2 with continuity correction: N(|ad-bc|-N/2)^2 / (r1 r2 c1 c2)
    want = 40 * (abs(8 * 5 - 12 * 15) - 20) ** 2 / (20 * 20 * 23 * 17)
    assert r.summary.first()["statistic"] == pytest.approx(want)


def test_isolation_forest_finds_far_points(spark):
    d = spark.range(600).select(
        F.when(F.col("id") < 12, 40.0 + F.col("id")).otherwise(F.randn(1)).alias("a"), F.when(F.col("id") < 12, -35.0 - F.col("id")).otherwise(F.randn(2)).alias("b"), F.col("id")
    )
    s = forest.isolation_scores(d, ["a", "b"])
    assert s.filter("score <= 0 or score >= 1").count() == 0
    top = s.orderBy(F.desc("score")).limit(12).filter("a >= 40").count()
    assert top == 12
    r = forest.isolation_forest(d, ["a", "b"]).summary.first()
    assert r["n_used"] == 600 and r["anomaly_count"] == pytest.approx(30, abs=2)
    assert forest.isolation_forest(d.limit(5), ["a", "b"]).status == "skipped"


def test_bh_against_plain_python(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([0.0, 0.01, 0.01, rnd.random() ** 3, rnd.random(), 1.0]), i) for g in "ab" for i in range(400)]
    want = {}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        run, m = 1.0, len(mine)
        for k, r in enumerate(mine):
            run = min(run, r[1] * m / (m - k))
            want[(g, r[2])] = run
    # Ties share the best of their ratios.
    for g in "ab":
        best = {}
        for r in rows:
            if r[0] == g:
                best[r[1]] = min(best.get(r[1], 9), want[(g, r[2])])
        for r in rows:
            if r[0] == g:
                want[(g, r[2])] = best[r[1]]
    got = wn.bh_adjust(spark.createDataFrame(rows, "g string, p double, i int"), "p", ["g"]).collect()
    assert len(got) == 800
    for r in got:
        assert r["p_adj"] == pytest.approx(want[(r["g"], r["i"])], rel=1e-9)


@pytest.mark.parametrize("rel,abs_", [(0.02, 0.05), (0.05, 1e-9), (0.05, 0.05)])
def test_number_matching_equals_all_pairs(spark, rel, abs_):
    rnd = random.Random(2)
    pool = [rnd.choice([0.0, 1.0, rnd.uniform(-4, 4), rnd.uniform(-1e6, 1e6), 2.75 + rnd.random() / 5]) for _ in range(150)]
    nums = [rnd.choice([p * (1 + rnd.uniform(-0.06, 0.06)) + rnd.choice([0, 0.05, -0.04]) for p in [rnd.choice(pool)]]) for _ in range(1500)] + [0.0, 3.0, -0.05]
    n, p = spark.createDataFrame([(x,) for x in nums], "number double"), spark.createDataFrame([(x,) for x in pool], "value double")
    got = {r["number"]: r["result"] != "unverifiable" for r in jn.classify_numbers(n, p, rel=rel, abs_=abs_).collect()}

    def ok(x):
        forms = {x, round(x, 2), round(x, 1), float(int(x))}
        return bool(forms & set(pool)) or any((abs(c) > 0 and abs(x - c) / abs(c) <= rel) or abs(x - c) <= abs_ for c in pool)

    wrong = [x for x in nums if got[x + 0.0] != ok(x)]
    assert not wrong


def test_drilldown_triggers(spark):
    d = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("team"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("site"),
        ((F.col("id") % 2) * 20 + F.col("id") % 11).cast("double").alias("score"), ((F.col("id") % 2) * 40 + F.col("id") % 13).cast("double").alias("pay"),
    )
    rows = pr.profile_columns(d).collect()
    reasons = [r for r, _ in az.drilldowns(d, az.baseline_scan(d, rows), rows)]
    assert len(reasons) == 3 and any(r.startswith("|r|=") for r in reasons) and any(r.startswith("segment p=") for r in reasons)
    quiet = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("team"), F.floor(F.col("id") / 2 % 7).cast("double").alias("score"))
    rows = pr.profile_columns(quiet).collect()
    assert az.drilldowns(quiet, az.baseline_scan(quiet, rows), rows) == []


def test_auto_analysis_finds_planted_signals(spark):
    n = 900
    d = spark.range(n).select(
        F.concat(F.lit("R-"), "id").alias("record_id"), F.when(F.col("id") % 5 < 2, "GroupA").when(F.col("id") % 5 < 4, "GroupB").otherwise("GroupC").alias("cohort"),
        (F.when(F.col("id") % 5 < 2, 112.0).otherwise(100.0) + F.randn(1) * 15).alias("metric_score"), (F.randn(2) * 10 + 50).alias("var_x"),
        F.when(F.col("id") % 33 == 0, 999.0).otherwise((F.col("id") % 9 + 1).cast("double")).alias("satisfaction"),
        F.when(F.col("id") % 50 == 0, -1.0).otherwise(85000 + F.randn(3) * 15000).alias("salary"), F.when(F.col("id") % 5 == 0, None).otherwise(F.randn(4) * 12 + 70).alias("activity"),
    ).withColumn("var_y", F.col("var_x") * 0.6 + F.randn(5) * 8)
    a = az.auto_analyze(d)
    ids = {r["insight_id"] for r in a.insights.collect()}
    assert "insight-seg-cohort-metric_score" in ids and "insight-corr-var_x-var_y" in ids
    assert any("imputation-activity" in i for i in ids)
    for r in a.insights.collect():
        assert r["n_used"] + r["n_excluded"] == n
    text = a.narrative.first()["executive_summary"]
    assert text.startswith("Autonomous analysis concluded") and "None" not in text


def test_tools_report_every_fault(spark):
    ds = az.as_dataset(days(spark, range(20)).withColumn("w", F.col("v") * 2))
    assert run_tool("trend_analysis", ds, date="day", value="v", freq="Q").status == "error"
    assert "str" in run_tool("detect_outliers", ds, method=3).message
    assert run_tool("detect_outliers", ds, columns="v").status == "error" and run_tool("run_correlation", ds, threshold=True).status == "error"
    late = run_tool("query_sql", ds, sql="SELECT 1 / (v - v) AS x FROM df")
    assert late.status == "error" and "DIVIDE_BY_ZERO" in late.message
    assert run_tool("generate_chart", ds, kind="trend", date="day", value="v").summary.count() > 0
    assert run_tool("generate_chart", ds, kind="correlation").summary.count() == 4
    assert run_tool("generate_chart", ds, kind="pie").status == "error"


def test_equal_steps_run_once_and_others_all(spark):
    for n in (10, 11):
        profile = [{"column": f"m{i}", "inferred_type": "numeric", "unique_count": 50, "is_unique": False, "rows": 50} for i in range(n)]
        steps = az.baseline_steps(profile) + az.plan(profile)
        d = spark.range(50).select(*[(F.col("id") * (i + 1) % 37).cast("double").alias(f"m{i}") for i in range(n)])
        done = az.run_steps(az.as_dataset(d), steps)
        assert sorted(r.tool for r in done) == ["detect_outliers", "run_correlation", "run_correlation"]
        assert {len(s.args["columns"]) for s in steps} == {n}


def test_left_out_steps_are_named():
    profile = [{"column": f"m{i}", "inferred_type": "numeric", "unique_count": 50} for i in range(3)]
    profile += [{"column": f"c{i}", "inferred_type": "categorical", "unique_count": 4} for i in range(3)]
    assert len(az.left_out(profile, az.AnalysisOptions())) == 5
    assert az.left_out(profile, az.AnalysisOptions(segment_labels=None, segment_measures=None)) == []


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_adjusted_p_values_by_hand(spark, range_rows):
    r = random.Random(3)
    # nine in ten lie within 0.01 of 1, with ties
    groups = {g: [0.99 + r.randrange(60) / 6000 if r.random() < 0.9 else r.random() ** 4 for _ in range(150)] for g in ("a", "b")}
    rows = [(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)] + [("a", -1, None)]
    got = {(x.g, x.i): x.p_adj for x in wn.bh_adjust(spark.createDataFrame(rows, "g string, i int, p double"), "p", ["g"], range_rows).collect()}
    assert got.pop(("a", -1)) is None and len(got) == 300
    for g, ps in groups.items():
        ranked = sorted(ps)
        for i, p in enumerate(ps):
            want = min([1.0] + [x * len(ps) / sum(y <= x for y in ranked) for x in ranked if x >= p])
            assert got[g, i] == pytest.approx(want)


def test_small_groups_of_p_values_share_ranges(spark, monkeypatch):
    """However many ranges all the data needs, a small group lies in one or two of them."""
    seen, plain = [], wn.in_ranges
    monkeypatch.setattr(wn, "in_ranges", lambda *a: seen.append(plain(*a)) or seen[-1])
    rows = [(g, i / 7) for g in range(300) for i in range(1, 7)]
    got = {(x.g, x.p): x.p_adj for x in wn.bh_adjust(spark.createDataFrame(rows, "g int, p double"), "p", ["g"], 20).collect()}
    assert len(got) == len(rows) and all(v == pytest.approx(6 / 7) for v in got.values())
    assert seen[0].select("_part").distinct().count() > 20
    assert seen[0].select("g", "_part").distinct().count() <= 300 + 90


@pytest.mark.parametrize("by", [[], ["g"]])
def test_long_series_are_cut(spark, by):
    r = random.Random(4)
    rows = [(r.choice(["a", None]), i, r.choice([None, float(r.randint(0, 9))])) for i in range(300)]
    d = spark.createDataFrame(rows, "g string, t int, v double").repartition(6)
    got = {x["t"]: x["rolling_mean"] for x in wn.rolling_mean(d, "t", "v", 5, by, series_rows=7).collect()}
    at = {x["t"]: x["idx"] for x in wn.period_index(d, "t", by).collect()}
    for g in ("a", None) if by else (0,):
        mine = [x for x in rows if not by or x[0] == g]
        for i, x in enumerate(mine):
            some = [y[2] for y in mine[max(0, i - 4) : i + 1] if y[2] is not None]
            assert at[x[1]] == i
            assert got[x[1]] == (pytest.approx(sum(some) / len(some), abs=0.0051) if some else None)


def test_adjusted_p_values_with_null_groups(spark):
    d = spark.createDataFrame([(None, 0.01), (None, 0.04), ("a", 0.5), (None, None)], "g string, p double")
    assert sorted(((x["g"], x["p"], x["p_adj"]) for x in wn.bh_adjust(d, "p", ["g"]).collect()), key=str) == sorted([(None, 0.01, 0.02), (None, 0.04, 0.04), ("a", 0.5, 0.5), (None, None, None)], key=str)


def test_numbers_without_end(spark):
    """Infinity, NaN and null on both sides, and nine in ten numbers in one narrow range."""
    inf, nan, rnd = float("inf"), float("nan"), random.Random(1)
    nums = [inf, -inf, nan, None, 1e300, 5.0] + [100 + rnd.random() / 1000 for _ in range(900)]
    pool = [inf, nan, None, 1e300, 5.04, 100.0005]
    n, p = spark.createDataFrame([(x,) for x in nums], "number double"), spark.createDataFrame([(x,) for x in pool], "value double")
    got = {str(r["number"]): r["result"] for r in jn.classify_numbers(n, p).collect()}
    assert len(got) == 905 and {got["inf"], got["-inf"], got["nan"]} == {"unverifiable"}
    assert got["1e+300"] == "match" and got["5.0"] == "rounding" and list(got.values()).count("rounding") == 901
    few = {r["number"]: (r["lower"], r["upper"]) for r in jn.nearest_values(n, p, ranges=5).collect()}
    for x in [v for v in nums if v is not None and abs(v) < inf]:
        known = [5.04, 100.0005, 1e300]
        assert few[x] == (max((k for k in known if k <= x), default=None), min((k for k in known if k >= x), default=None))


def test_a_narrative_is_checked_against_its_findings(spark):
    schema = "run_id string, insight_id string, title string, summary string, metrics map<string,double>, significance double, effect_size double, n_used long, n_excluded long, exclusion_rate double"
    rows = [
        ("r1", "a", "Pay differs by team", "Team A earns 52.35 on average. The share is 12.5%.", {"top_mean": 52.349, "share": 0.125}, 0.01, 0.4, 90, 10, 0.1),
        ("r1", "b", "A guess", "Nobody measured the value 777.7 anywhere.", {"x": 1.0}, None, 0.1, 90, 10, 0.1),
        (None, "c", "Rows", "We used 90 rows.", {"n": 90.0}, None, 0.1, 90, 0, 0.0),
        ("r2", "d", "No numbers", "Nothing to see.", {}, None, None, None, None, None),
    ]
    findings = spark.createDataFrame(rows, schema)
    text = "Team A earns 52.35 on average. The share is 12.5%. Nobody measured the value 777.7 anywhere. Sales were 31 units."
    story = spark.createDataFrame([("r1", text), (None, "We used 90 rows."), ("r2", "Nothing to see."), ("r3", None)], "run_id string, executive_summary string")
    got = vf.check_narrative(findings, story)
    assert {(r["value"], r["status"]) for r in got.claims.collect()} == {(52.35, "verified"), (12.5, "verified"), (777.7, "metric_missing"), (90.0, "verified")}
    kept = {r["run_id"]: (r["executive_summary"], r["sentences_dropped"]) for r in got.narrative.collect()}
    assert kept == {"r1": ("Team A earns 52.35 on average. The share is 12.5%.", 2), None: ("We used 90 rows.", 0), "r2": ("Nothing to see.", 0), "r3": (None, 0)}
    rates = {r["run_id"]: (r["number_verification_rate"], r["post_strip_rate"], r["claim_presence_rate"], r["status"]) for r in got.rates.collect()}
    assert rates == {"r1": (50.0, 100.0, 100.0, "flagged"), None: (100.0, 100.0, 100.0, "passed")}


def test_many_correlations_from_one_scan(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(900, 30)) + 1e7
    x[:, 1] = 3 * x[:, 0] - 2e7 + rnd.normal(size=900) * 0.3
    x[:, 2] = 0.1
    x[rnd.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    x[4, 5] = np.inf
    d = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(30)])).repartition(5)
    got = {(r["column_x"], r["column_y"]): r for r in co.correlation_pairs(d).collect()}
    assert len(got) == 30 * 29 // 2
    for (a, b), r in got.items():
        u, v = x[:, int(a[1:])], x[:, int(b[1:])]
        both = ~np.isnan(u) & ~np.isnan(v)
        u, v = u[both], v[both]
        assert r["n_used"] == len(u) and r["n_excluded"] == 900 - len(u)
        if len(u) < 2 or u.std() < 1e-12 or v.std() < 1e-12 or not (np.isfinite(u).all() and np.isfinite(v).all()):
            assert r["correlation"] is None, (a, b, r)
        else:
            assert r["correlation"] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-4)
    monkeypatch.setattr(co, "AGGREGATED_PAIRS", 10_000)
    few = [f"c{i}" for i in range(9)]  # built-in aggregates give the same rows
    same = co.correlation_pairs(d, few).collect()
    assert len(same) == 36 and [r for r in same if r != got[r["column_x"], r["column_y"]]] == []
    monkeypatch.setattr(co, "AGGREGATED_PAIRS", 1)
    assert co.correlation_pairs(d.limit(0)).where("n_used = 0 and n_excluded = 0 and correlation is null").count() == 435


def test_a_thousand_columns_in_one_scan(spark):
    wide = spark.range(400).select(*[((F.col("id") * (i + 7) * 2654435761) % (1009 + i)).cast("double").alias(f"c{i}") for i in range(1000)])
    plan = co.correlation_pairs(wide)
    assert plan.count() == 1000 * 999 // 2
    assert plan.where("n_used <> 400 or abs(correlation) > 1 or correlation is null").count() == 0


def _forest_rows(spark, n):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id") * 37 % 1013 / 7.0).alias("a"),
        F.when(F.col("id") % 3 == 0, 2.5).otherwise(F.col("id") * 53 % 997 / 5.0).alias("score"),
    )


def test_forest_scores_do_not_depend_on_partitions(spark):
    d = _forest_rows(spark, 60_000)
    for key in (["id"], None):
        runs = []
        for parts in (2, 7):
            s = forest.isolation_scores(d.repartition(parts, F.rand(parts)), ["a", "score"], key=key)
            assert s.columns == [*(key or []), "a", "score", "score_"]
            runs.append(sorted(map(tuple, s.collect())))
        assert runs[0] == runs[1] and len(runs[0]) == 60_000
    r = forest.isolation_forest(d, ["a", "score"], key=["id"]).tables["scores"]
    assert r.columns == ["id", "a", "score", "score_", "is_anomaly"] and r.select("id").distinct().count() == 60_000


def test_forest_draws_copies_as_often_as_they_are(spark):
    rows = _forest_rows(spark, 60_000).select(F.col("a").alias("v0"), F.col("score").alias("v1"))
    picks = forest._draw(rows, [], ["v0", "v1"], 60_000, 100, 42).toPandas()
    first = picks.sort_values(["tree", "u", "v0", "v1"]).groupby("tree").head(forest.SUBSET)
    assert (first.groupby("tree").size() == forest.SUBSET).all()
    assert (first["v0"] == 1.5).mean() == pytest.approx(1 / 3, abs=0.03)
    whole = forest._draw(rows.limit(100), [], ["v0", "v1"], 100, 3, 42)  # a small table is drawn whole by each tree
    assert whole.groupBy("tree").count().filter("count <> 100").count() == 0


def test_forest_edges(spark):
    assert forest.isolation_scores(spark.createDataFrame([("a",)], "t string")) is None
    d = spark.range(20).select(F.when(F.col("id") > 4, F.col("id")).alias("x"), F.lit(None).cast("string").alias("k"))
    got = forest.isolation_scores(d, ["x"], key=["k"])
    assert got.count() == 15 and got.columns == ["k", "x", "score"]
    assert run_tool("detect_outliers", d, method="isolation_forest", columns=["x"], key=["k"]).status == "success"


def test_profile_of_long_texts(spark):
    base = "x" * 40_000
    texts = [base + chr(97 + i % 7) for i in range(50)] + ["short", "short", "", None]
    d = spark.createDataFrame([(t, i % 3, f"2025-01-{i % 28 + 1:02d}") for i, t in enumerate(texts)], "t string, n int, `d.ay` string").repartition(4)
    p = {r["column"]: r for r in pr.column_counts(d).collect()}
    assert p["t"]["unique_count"] == 9 and p["t"]["null_count"] == 1 and p["t"]["rows"] == 54
    assert p["t"]["sample_values"] == sorted({t for t in texts if t is not None})[:5]
    assert p["n"]["sample_values"] == ["0", "1", "2"] and p["d.ay"]["inferred_type"] == "datetime"
    empty = {r["column"]: r for r in pr.column_counts(d.limit(0)).collect()}
    assert empty["t"]["unique_count"] == 0 and empty["t"]["sample_values"] is None
