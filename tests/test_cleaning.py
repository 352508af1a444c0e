import pytest
from pyspark.sql import functions as F

from tidemark.operators import casing, cleaning as cl, imputation as im, sentinels as se
from tidemark.plans.clean import CleaningOptions, clean


def canon(frame, values):
    d = frame("v string", values)
    return [r["v"] for r in casing.canonical_case(d, ["v"]).collect()]


def test_canonical_spellings(frame):
    assert canon(frame, ["HR", "HR", "Hr"]) == ["HR"] * 3
    assert canon(frame, ["LinkedIn", "linkedin"]) == ["LinkedIn"] * 2
    assert canon(frame, ["Google  Ads", " google ads "]) == ["Google Ads"] * 2
    assert canon(frame, ["central", "central", "hr", "hr", "it", "north", "north"]) == ["Central", "Central", "HR", "HR", "IT", "North", "North"]
    assert canon(frame, ["e-mail", None, "o'neil"]) == ["E-Mail", None, "O'Neil"]


def test_label_map_too_large_to_broadcast_is_shuffled(frame, monkeypatch):
    monkeypatch.setattr(casing, "MAP_ROWS", 1)
    assert sorted(canon(frame, ["central", "north", "NORTH", "North", "North", "Central"])) == ["Central"] * 2 + ["North"] * 4


def test_sentinel_is_found_and_nulled(frame):
    d = frame("metric double", [10.0, 12.0, 11.0, 13.0, 10.5, 11.2, 12.1, 999.0, 999.0, 999.0, 999.0])
    f = se.repeated_value_findings(d).collect()
    assert [(r["value"], r["count"], r["kind"]) for r in f] == [(999.0, 4, "sentinel")]
    assert se.null_sentinels(d, f).filter("metric is null").count() == 4


def test_repeated_extreme_is_kept(frame):
    d = frame("conversions double", [1.0, 2.0, 1.0, 3.0, 2.0, 1.0, 2.0, 90.0, 90.0, 90.0, 90.0])
    f = se.repeated_value_findings(d).collect()
    assert [(r["value"], r["count"], r["kind"]) for r in f] == [(90.0, 4, "extreme")]
    assert se.null_sentinels(d, f).filter("conversions = 90").count() == 4


def test_hot_value_does_not_hide_the_fence(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -999.0).otherwise((F.col("id") % 50).cast("double")).alias("x"))
    assert [(r["value"], r["count"]) for r in se.repeated_value_findings(d).collect()] == [(-999.0, 1000)]


def test_returns_kept_and_invalid_nulled(frame):
    d = frame("quantity double, salary double, age double", [10.0, 20.0, -5.0, -2.0, 15.0, 30.0], [1.0, 2.0, -10000.0, 3.0, 4.0, 5.0], [30.0, 150.0, -5.0, 40.0, 50.0, 60.0])
    found = {(r["column"], r["rule"]): r["count"] for r in cl.domain_findings(d).collect()}
    assert found == {("quantity", "returns"): 2, ("salary", "non_negative_constraint"): 1, ("age", "age_bounds_0_100"): 2}
    out = cl.null_bad_ages(cl.null_negatives(d))
    assert out.agg(F.count("quantity"), F.count("salary"), F.count("age")).first()[:] == (6, 5, 4)


def test_rules_match_name_parts_unless_told_otherwise():
    assert cl.domain_rule("discount") is None
    assert cl.domain_rule("discount", substring=True) == "returns"
    assert cl.domain_rule("unit_price") == "non_negative_constraint"


def test_mixed_dates_and_single_format(frame):
    d = frame("when_date string", ["2025-03-23", "03/23/2025", "23-03-2025", "junk", "2025-01-02"])
    assert cl.coerce_dates(d).filter("when_date is not null").count() == 4
    one = cl.coerce_dates(d, formats=["yyyy-M-d"])
    assert one.schema["when_date"].dataType.simpleString() == "string"


def test_currency(frame):
    d = frame("p string", ["$1,200.50", "€3", " 7 ", "abc", None])
    assert [r[0] for r in d.select(cl.currency_to_double("p")).collect()] == [1200.5, 3.0, 7.0, None, None]


def test_roles(spark):
    d = spark.range(50).select(
        F.concat(F.lit("EMP-"), "id").alias("badge"), F.col("id").alias("order_id"), (F.col("id") % 3).cast("double").alias("tenure_years"),
        (F.col("id") % 5 + 2020).cast("double").alias("start_year"), F.lit("x").alias("team"), F.rand(1).alias("score"),
    )
    assert im.classify_roles(d) == {
        "badge": "identifier", "order_id": "identifier", "tenure_years": "measure", "start_year": "date", "team": "categorical", "score": "measure"
    }


@pytest.mark.parametrize("strategy,fill", [("auto", 2.0), ("mean", 22.2), ("median", 2.0), ("constant", 0.0), ("mode", 2.0)])
def test_imputation_strategies(frame, strategy, fill):
    d = frame("x double", [1.0, 1.0, 2.0, 3.0, 104.0, None])
    stats = im.imputation_stats(d, {"x": "measure"}, strategy).collect()
    ds = im.impute(d, stats)
    assert ds.df.filter("_imputed_x").select("x").first()[0] == pytest.approx(fill)
    assert ds.observed().filter("x is null").count() == 1


def test_clean_options(frame):
    d = frame("`Col A ` string, Constant int", ["x", "x", " y"], [1, 1, 1])
    ds = clean(d, CleaningOptions(drop_duplicates=False))
    assert ds.columns == ["Col A"] and ds.df.count() == 3


def test_clean_end_to_end(spark):
    n = 300
    d = spark.range(n).select(
        F.concat(F.lit("TXN-"), "id").alias("txn_id"), F.when(F.col("id") % 4 == 0, "sales").when(F.col("id") % 4 == 1, " Sales").otherwise("HR").alias("Department"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, F.concat(F.lit("$"), F.col("id") + 100)).otherwise((F.col("id") + 100).cast("string")).alias("unit_price"),
        F.when(F.col("id") % 15 == 0, 999.0).otherwise((F.col("id") % 9).cast("double")).alias("rating"),
    )
    ds = clean(d.unionByName(d.filter("txn_id in ('TXN-1', 'TXN-2', 'TXN-3')")))
    r = ds.report
    assert r["clean_rows"] == n and r["duplicates_removed"] == 3
    assert r["type_conversions"] == {"unit_price": "numeric"}
    assert {x["Department"] for x in ds.df.select("Department").distinct().collect()} == {"Sales", "HR"}
    kinds = {(x["column"], x["kind"]): x["count"] for x in r["findings"].collect()}
    assert kinds == {("rating", "sentinel"): 20}
    assert ds.mask_cols and ds.df.filter("_imputed_rating").count() == 20
    assert ds.df.filter("rating is null or unit_price is null").count() == 0
    steps = [x["step"] for x in r["log"].orderBy("position").collect()]
    assert steps[0] == "normalize_headers" and "remove_duplicates" in steps and "replace_sentinel_values" in steps
    assert 0 <= r["quality_raw"] <= 100 and 0 <= r["quality_clean"] <= 100


def test_sample_and_guard(spark):
    d = spark.range(1000)
    a, b = cl.sample_rows(d, 50, "id"), cl.sample_rows(d.repartition(9), 50, "id")
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()}
    assert cl.sampling_disclosure(50, 1000)["sampling_disclosure"] == "random sample of 50 of 1,000 rows (seed 42)"
    with pytest.raises(ValueError, match="maximum supported row count"):
        cl.guard_rows(d, 10)


def test_numbers_are_strict(spark):
    texts = ["12D", "5F", "Infinity", "NaN", "$1,200.50", " 7 ", "-3.", ".5", "1e3", "0x1", "", None, "€ 9"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(cl.currency_to_double("t")).collect()] == [None, None, None, None, 1200.5, 7.0, -3.0, 0.5, 1000.0, None, None, None, 9.0]
    seats = spark.createDataFrame([(f"{i}D",) for i in range(9)], "seat string")
    assert cl.coerce_numeric(seats).schema["seat"].dataType.simpleString() == "string"


@pytest.mark.parametrize("text,day", [
    ("2024/01/15", "2024-01-15 00:00:00"), ("Jan 5, 2024", "2024-01-05 00:00:00"), ("January 5, 2024", "2024-01-05 00:00:00"), ("5 Mar 2024", "2024-03-05 00:00:00"),
    ("1/15/24", "2024-01-15 00:00:00"), ("2024-01-15T10:20:30.123456", "2024-01-15 10:20:30.123456"), ("2024-01-15T10:20:30Z", "2024-01-15 10:20:30"),
    ("2024-01-15 10:20:30+02:00", "2024-01-15 08:20:30"), ("2024-13-45", "None"), ("Foo 5, 2024", "None"),
])
def test_dates_in_many_forms(spark, text, day):
    from tidemark.functions.dates import parse_date

    d = spark.createDataFrame([(text,)], "order_date string")
    assert str(d.select(parse_date("order_date")).first()[0]) == day
    if day != "None":
        rows = spark.createDataFrame([(text,)] * 5, "order_date string")
        assert cl.coerce_dates(rows).schema["order_date"].dataType.simpleString() == "timestamp"


def test_blanks_of_any_kind(spark):
    d = spark.createDataFrame([("\tab  c\n",), (" \n",), (None,)], "t string")
    assert [r[0] for r in d.select(cl.collapse_spaces(F.col("t"))).collect()] == ["ab c", "", None]


def test_clean_an_empty_table(spark):
    ds = clean(spark.createDataFrame([], "a string, b double"))
    assert ds.df.count() == 0 and ds.report["quality_raw"] == 100.0


def test_samples_need_a_key(spark):
    d = spark.createDataFrame([(f"k{i}", float(i)) for i in range(40)], "k string, x double")
    with pytest.raises(ValueError, match="sample_key"):
        clean(d, CleaningOptions(sample=10))
    kept = cl.sample_rows(d, 10, "k")
    assert kept.count() == 10 and {r.k for r in kept.collect()} == {r.k for r in cl.sample_rows(d.repartition(3), 10, "k").collect()}


def test_cells_are_trimmed_as_by_the_pattern(spark):
    """Without running it on every cell; odd line ends, nulls and blanks too."""
    cells = ["", " ", " a  b ", "a\tb", "\n a \r\n", "a \u0085", "a \u2028", " \u2029", "a\u00a0 ", "\u00a0a", "a \n\u2028", "\va\f", "plain", None, "a \u2028\u2028", "a b c"]
    d = spark.createDataFrame([(x,) for x in cells], "s string")
    ends = F.regexp_replace("s", r"^\s+|\s+$", "")
    got = d.select(ends.alias("e"), cl.stripped(F.col("s")).alias("t"), F.regexp_replace(ends, r"\s+", " ").alias("c"), cl.collapse_spaces(F.col("s")).alias("k"))
    assert [(r["t"], r["k"]) for r in got.collect()] == [(r["e"], r["c"]) for r in got.collect()]
