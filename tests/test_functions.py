import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles, scoring as sc, tails, text as tx
from tidemark.functions.labels import format_label, title_case
from tidemark.functions.ranges import carry, join_keys, running_sum
from tidemark.functions.quantiles import cumulative_histogram, exact_quantiles, value_histogram, values_at_ranks


def linear(values, p):
    s = sorted(values)
    pos = p * (len(s) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return s[lo] + (s[hi] - s[lo]) * (pos - lo)


def test_tails_match_frozen_values():
    assert tails.f_upper(3.2, 2, 57) == pytest.approx(0.04818252296114012, rel=1e-10)
    assert 1 - tails.t_two_sided(2.0, 57) / 2 == pytest.approx(0.9748633244731026, rel=1e-10)
    assert 1 - tails.chi2_upper(7.8, 3) == pytest.approx(0.9496689021401464, rel=1e-10)
    assert tails.f_upper(0.0, 3, 9) == 1.0
    assert tails.chi2_upper(0.0, 3) == 1.0
    assert tails.f_upper(2.0, 4, 1e7) == pytest.approx(tails.chi2_upper(8.0, 4), rel=1e-5)


def test_corr_p_value_edges(spark):
    d = spark.createDataFrame([(1.0, 10), (0.5, 30), (0.2, 2)], "r double, n long").select("r", tails.corr_pvalue(F.col("r"), F.col("n")).alias("p"))
    p = {r["r"]: r["p"] for r in d.collect()}
    assert p[1.0] == 0.0 and p[0.2] is None
    assert p[0.5] == pytest.approx(0.004898, abs=1e-5)


@pytest.mark.parametrize("shape", ["hot", "normal", "few", "one", "constant", "narrow"])
@pytest.mark.parametrize("accuracy, here", [(50, 50_000), (10_000, 50_000), (50, 10), (10_000, 10)])
def test_exact_quantiles_equal_brute_force(spark, monkeypatch, shape, accuracy, here):
    monkeypatch.setattr(quantiles, "CELL_VALUES", here)
    rnd = random.Random(7)
    values = {
        "narrow": [rnd.gauss(0, 10) for _ in range(300)] + [3 + rnd.random() * 1e-9 for _ in range(2700)],
        "hot": [42.5] * 1000 + [rnd.uniform(0, 100) for _ in range(2000)], "normal": [rnd.gauss(0, 10) for _ in range(3000)],
        "few": [1.0, 2.0], "one": [3.25], "constant": [5.0] * 700,
    }[shape]
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    d = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(7)
    got = {r["p"]: r["value"] for r in exact_quantiles(d, ["x"], probs, accuracy=accuracy).collect()}
    for p in probs:
        assert got[p] == pytest.approx(linear(values, p), rel=1e-12)


def test_exact_quantiles_by_group_with_null_key(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.expovariate(1), rnd.random()) for _ in range(2000)]
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r["k"], r["column"], r["p"]): r["value"] for r in exact_quantiles(d, ["x", "y"], [0.5, 0.9], by=["k"], accuracy=100).collect()}
    assert len(got) == 12
    for k in ("a", "b", None):
        for i, c in ((1, "x"), (2, "y")):
            vals = [r[i] for r in rows if r[0] == k]
            for p in (0.5, 0.9):
                assert got[(k, c, p)] == pytest.approx(linear(vals, p), rel=1e-12)


def test_exact_quantiles_without_values(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert [(r["column"], r["value"]) for r in exact_quantiles(d, ["x", "y"], [0.5]).collect()] == [("y", 1.5)]


@pytest.mark.parametrize("ranges", [None, 2, 16, 100])
def test_rank_lookup_equals_sorted_list(spark, ranges):
    rnd = random.Random(5)
    # nine in ten values lie within 0.001
    values = [float(rnd.randint(0, 300)) for _ in range(300)] + [77.0] * 1500 + [50 + rnd.random() / 1000 for _ in range(2700)]
    hist = cumulative_histogram(value_histogram(spark.createDataFrame([("c", v) for v in values], "column string, value double")), ranges)
    n = len(values)
    ranks = spark.createDataFrame([("c", r, n) for r in range(0, n, 37)], "column string, rank long, n long")
    s = sorted(values)
    for r in values_at_ranks(hist, ranks, ranges).collect():
        assert r["found"] == s[r["rank"]]


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_sums_and_carried_values_over_ranges(spark, ranges):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, 1.0])) for i in range(500)]
    d = spark.createDataFrame([(g, i, v and float(i)) for g, i, v in rows], "g string, i int, v double").repartition(5)
    sums = {r["i"]: (r["upto"], r["total"]) for r in running_sum(d, ["g"], ["i"], "i", ranges).collect()}
    near = {r["i"]: (r["below"], r["above"]) for r in carry(d, ["g"], ["i"], "v", ranges).collect()}
    for g, i, _ in rows:
        mine = [x[1] for x in rows if x[0] == g]
        known = [x[1] for x in rows if x[0] == g and x[2]]
        assert sums[i] == (sum(x for x in mine if x <= i), sum(mine))
        assert near[i] == (max((x for x in known if x <= i), default=None), min((x for x in known if x >= i), default=None))


def test_join_keys_takes_nulls_for_equal(spark):
    a, b = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int"), spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    rows = lambda how: sorted(((r["k"], r["a"], r["b"]) for r in join_keys(a, b, ["k"], how).collect()), key=str)
    assert rows("inner") == [(None, 2, 3)] and rows("left") == sorted([("x", 1, None), (None, 2, 3)], key=str)
    assert rows("full") == sorted([("x", 1, None), (None, 2, 3), ("y", None, 4)], key=str)


def test_numbers_in_text(spark):
    cases = {
        "Revenue rose to $1,234.50 (12%) in 2024, see TXN-1003 on 2025-03-23.": [1234.5, 12.0],
        "1. First point costs 5. Step 2 took -3 days": [5.0, -3.0],
        "No digits é5 here": [],
        "On 03/23/2025 we saw 46.36": [46.36],
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.numbers_in(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in d.collect()} == cases


def test_phrases_and_placeholders(spark):
    d = spark.createDataFrame([("Sales are Stable because of price. It drives growth.",)], "t string")
    r = d.select(tx.replace_phrases(F.col("t")).alias("t"), F.size(tx.phrase_hits(F.col("t"))).alias("n")).first()
    assert r["t"] == "Sales are consistent in the presence of price. It is associated with growth." and r["n"] == 3
    flags = {"value is None": True, "x IS NOT NULL": False, "a null cell": True, "": True, "the highest metric": True, "fine": False}
    d = spark.createDataFrame([(k,) for k in flags], "t string").select("t", tx.has_placeholder(F.col("t")).alias("f"))
    assert {r["t"]: r["f"] for r in d.collect()} == flags


def test_labels(spark):
    d = spark.createDataFrame([("o'neil e-mail",), ("hr",), (" ",), (None,), ("paypal",), ("LinkedIn",)], "t string")
    assert [r[0] for r in d.select(format_label(F.col("t"))).collect()] == ["O'Neil E-Mail", "HR", "unspecified", "unspecified", "PayPal", "LinkedIn"]
    assert d.select(title_case(F.col("t"))).first()[0] == "O'Neil E-Mail"


def test_confidence_and_wilson(spark):
    cases = [(25, 0.1, "low"), (100, 0.45, "low"), (45, 0.1, "medium"), (100, 0.25, "medium"), (100, 0.05, "high")]
    d = spark.createDataFrame(cases, "n int, r double, c string").select("c", sc.confidence(F.col("n"), F.col("r")).alias("got"))
    assert all(r["c"] == r["got"] for r in d.collect())
    lo, hi = sc.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(40, 70)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r["lo"], 1), round(r["hi"], 1)) == (45.5, 68.1)


def test_impact_of_no_outliers_is_small(spark):
    one = F.lit(None).cast("double")
    s = sc.impact_score(F.lit("outlier"), F.lit(0.0), one, F.lit(100), F.lit(0), F.lit("high"), F.lit(0))
    assert spark.range(1).select(s).first()[0] == 0.1
