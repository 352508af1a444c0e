"""AN-*: the analysis tools on the given tables."""

from pyspark.sql import functions as F

from tidemark.operators import correlation as co
from tidemark.operators import outliers as ou
from tidemark.operators import segments as sg
from tidemark.operators import trend as tr
from workload.registry import query, table

LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NUMS = ["quantity", "unit_price", "salary", "age"]


def _union_all(parts):
    return "\nUNION ALL\n".join(parts)


def _pair_sql(cols, src):
    return _union_all([
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, round(corr({a},{b}),4) AS correlation, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_used, count(*) FILTER ({a} IS NULL OR {b} IS NULL) AS n_excluded FROM {src}"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    ])


@query("an01_correlation_pairs", _pair_sql(LINE_NUMS, "lineitem"))
def an01(spark, sf):
    return co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS)


@query("an01_correlation_matrix", f"""
WITH p AS ({_pair_sql(LINE_NUMS, "lineitem")})
SELECT column_x, column_y, correlation FROM p UNION ALL SELECT column_y, column_x, correlation FROM p
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (SELECT DISTINCT unnest([column_x, column_y]) AS c FROM p)""")
def an01_matrix(spark, sf):
    return co.correlation_matrix(co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS))


# 26 columns, each without a seventh of the rows: too many pairs for built-in aggregates.
_WIDE = [f"CASE WHEN l_linenumber <> {k % 7 + 1} THEN CAST(l_quantity + l_orderkey * {k + 3} % {11 + k} AS DOUBLE) END AS w{k}" for k in range(26)]


@query("an01_wide_pairs", f"WITH w AS (SELECT {', '.join(_WIDE)} FROM lineitem) " + _pair_sql([f"w{k}" for k in range(26)], "w"))
def an01_wide(spark, sf):
    return co.correlation_pairs(table(spark, sf, "lineitem").selectExpr(*_WIDE))


_STRENGTH = """CASE WHEN abs(correlation) >= 0.7 THEN 'very strong' WHEN abs(correlation) >= 0.5 THEN 'strong'
 WHEN abs(correlation) >= 0.3 THEN 'moderate' ELSE 'weak' END || CASE WHEN correlation > 0 THEN ' positive' ELSE ' negative' END"""


@query("an02_strong_pairs", f"""
WITH p AS ({_pair_sql(LINE_NUMS, "lineitem")})
SELECT *, abs(correlation) AS abs_correlation, {_STRENGTH} AS strength, abs(correlation) >= 0.4 AS is_strong FROM p WHERE correlation IS NOT NULL""")
def an02(spark, sf):
    return co.with_strength(co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS))


@query("an03_correlation_test", f"""
WITH p AS ({_pair_sql(LINE_NUMS, "lineitem")})
SELECT column_x, column_y, n_used, round(correlation * sqrt((n_used - 2) / (1 - correlation * correlation)), 6) AS t_statistic FROM p""")
def an03(spark, sf):
    from tidemark.functions.tails import corr_t

    p = co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS)
    return p.select("column_x", "column_y", "n_used", F.round(corr_t(F.col("correlation"), F.col("n_used")), 6).alias("t_statistic"))


@query("an03_correlation_p_values")
def an03_p(spark, sf):
    return co.with_p_value(co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS))


def _iqr_sql(cols, src, k):
    return _union_all([f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
 round(count(*) FILTER ({c} < lo OR {c} > hi) / count({c}) * 100, 2) AS outlier_percentage, count({c}) AS n_used, 0::BIGINT AS n_excluded,
 any_value(lo) AS lower_bound, any_value(hi) AS upper_bound, any_value(round(a,4)) AS q25, any_value(round(b,4)) AS q75
FROM {src}, (SELECT a, b, round(a - {k} * (b - a), 4) AS lo, round(b + {k} * (b - a), 4) AS hi
 FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {src}))""" for c in cols])


@query("an04_iqr_outliers", _iqr_sql(["l_quantity", "l_extendedprice", "l_discount"], "lineitem", 0.6))
def an04(spark, sf):
    r = ou.outliers(table(spark, sf, "lineitem"), "iqr", ["l_quantity", "l_extendedprice", "l_discount"], 0.6)
    return r.tables["column_outliers"]


@query("an04_iqr_event_samples", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
f AS (SELECT round(a - 1.5 * (b - a), 4) AS lo, round(b + 1.5 * (b - a), 4) AS hi FROM q),
o AS (SELECT value, row_number() OVER (ORDER BY value) AS rank FROM events, f WHERE value < lo OR value > hi)
SELECT 'value' AS "column", value, rank FROM o WHERE rank <= 10""")
def an04_samples(spark, sf):
    return ou.outliers(table(spark, sf, "events"), "iqr", ["value"], 1.5).tables["samples"].withColumn("rank", F.col("rank").cast("long"))


def _z_sql(cols, src, k):
    return _union_all([f"""SELECT '{c}' AS "column", count(*) FILTER (abs(({c} - m) / s) > {k}) AS outlier_count,
 round(count(*) FILTER (abs(({c} - m) / s) > {k}) / count({c}) * 100, 2) AS outlier_percentage, count({c}) AS n_used, 0::BIGINT AS n_excluded,
 any_value(round(m, 4)) AS mean, any_value(round(s, 4)) AS std, {k}::DOUBLE AS z_threshold
FROM {src}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {src})""" for c in cols])


@query("an05_zscore_outliers", _z_sql(["value"], "events", 2.0))
def an05(spark, sf):
    r = ou.outliers(table(spark, sf, "events"), "zscore", ["value"], 2.0).tables["column_outliers"]
    return r.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("an06_isolation_forest")
def an06(spark, sf):
    return ou.outliers(table(spark, sf, "lineitem"), "isolation_forest", LINE_NUMS).summary


@query("an06_forest_rows", "SELECT event_id, value, true AS scored FROM events WHERE value IS NOT NULL")
def an06_rows(spark, sf):
    r = ou.outliers(table(spark, sf, "events"), "isolation_forest", ["value"], key=["event_id"]).tables["scores"]
    return r.select("event_id", "value", F.col("score").between(0, 1).alias("scored"))


@query("an07_anomalous_rows", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b,
 quantile_cont(l_quantity, 0.25) AS c, quantile_cont(l_quantity, 0.75) AS d FROM lineitem),
f AS (SELECT round(a-0.6*(b-a),4) AS l1, round(b+0.6*(b-a),4) AS h1, round(c-0.6*(d-c),4) AS l2, round(d+0.6*(d-c),4) AS h2 FROM q),
x AS (SELECT (l_extendedprice < l1 OR l_extendedprice > h1) AS o1, (l_quantity < l2 OR l_quantity > h2) AS o2 FROM lineitem, f)
SELECT 'iqr' AS method, count(*) AS total_records, count(*) AS n_used, 0::BIGINT AS n_excluded, count(*) FILTER (o1 OR o2) AS anomaly_count,
 round(count(*) FILTER (o1 OR o2) / count(*) * 100, 2) AS anomaly_rate_percent,
 (max(CASE WHEN o1 THEN 1 ELSE 0 END) + max(CASE WHEN o2 THEN 1 ELSE 0 END))::INTEGER AS columns_with_outliers FROM x""")
def an07(spark, sf):
    return ou.outliers(table(spark, sf, "lineitem"), "iqr", ["l_extendedprice", "l_quantity"], 0.6).summary


_SEG = """SELECT {s} AS segment, count({m}) AS count, round(sum({m}),2) AS sum, round(avg({m}),2) AS mean, round(median({m}),2) AS median,
 round(stddev_samp({m}),2) AS std, round(min({m}),2) AS min, round(max({m}),2) AS max,
 round(sum({m}) / (SELECT sum({m}) FROM {t}) * 100, 2) AS share_of_total_percent,
 round(round(avg({m}),2) / (SELECT avg({m}) FROM {t}), 2) AS relative_to_overall_mean FROM {t} GROUP BY 1"""
ORDERS_SEG = _SEG.format(s="o_orderpriority", m="o_totalprice", t="orders")


@query("an08_segment_compare", ORDERS_SEG)
def an08(spark, sf):
    return sg.segment_stats(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@query("an08_segment_events", _SEG.format(s="event_type", m="value", t="events"))
def an08_events(spark, sf):
    return sg.segment_stats(table(spark, sf, "events"), "event_type", "value")


@query("an09_top_bottom_segment", f"""
WITH s AS ({ORDERS_SEG}), t AS (SELECT segment, mean FROM s ORDER BY mean DESC, segment LIMIT 1), b AS (SELECT segment, mean FROM s ORDER BY mean, segment DESC LIMIT 1)
SELECT t.segment AS top_segment, t.mean AS top_value, b.segment AS bottom_segment, b.mean AS bottom_value, round(t.mean - b.mean, 2) AS absolute_difference,
 CASE WHEN b.mean > 0 THEN round(t.mean / b.mean, 2) END AS top_vs_bottom_ratio, (SELECT count(*) FROM s) AS total_segments FROM t, b""")
def an09(spark, sf):
    return sg.top_bottom(sg.segment_stats(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query("an10_anova", """
WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
t AS (SELECT count(*) AS groups, sum(n)::BIGINT AS n_used, sum(n * pow(m - (SELECT avg(o_totalprice) FROM orders), 2)) AS ssb, sum((n - 1) * v) AS ssw FROM g)
SELECT groups, n_used, (groups - 1)::DOUBLE AS df_between, (n_used - groups)::DOUBLE AS df_within,
 round((ssb / (groups - 1)) / (ssw / (n_used - groups)), 6) AS f_statistic FROM t""")
def an10(spark, sf):
    return sg.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select(
        "groups", "n_used", "df_between", "df_within", F.round("f_statistic", 6).alias("f_statistic"))


@query("an10_anova_p_value")
def an10_p(spark, sf):
    return sg.with_anova_p(sg.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query("an11_cardinality_guard", """
SELECT 'o_custkey' AS segment_column, count(DISTINCT o_custkey) AS distinct_segments, count(*) AS n_used, round(count(DISTINCT o_custkey) / count(*), 4) AS cardinality_ratio,
 (count(DISTINCT o_custkey) / count(*) >= 0.7 AND count(DISTINCT o_custkey) > 15) OR count(DISTINCT o_custkey) / count(*) >= 0.5 OR count(DISTINCT o_custkey) > 30 AS rejected,
 CASE WHEN count(DISTINCT o_custkey) / count(*) >= 0.7 AND count(DISTINCT o_custkey) > 15 THEN 'high cardinality'
  WHEN count(DISTINCT o_custkey) / count(*) >= 0.5 OR count(DISTINCT o_custkey) > 30 THEN 'identifier name' ELSE 'ok' END AS reason FROM orders""")
def an11(spark, sf):
    return sg.cardinality_guard(table(spark, sf, "orders"), "o_custkey", "o_totalprice")


_TOXIC = "SELECT lang, toxic FROM documents JOIN labels USING (doc_id)"


def _toxic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").select("lang", "toxic")


@query("an12_segment_rates", f"""
SELECT lang AS segment, count(*) AS n_used, sum(toxic)::BIGINT AS positive_count, round(avg(toxic), 4) AS rate, round(avg(toxic) * 100, 2) AS rate_percent
FROM ({_TOXIC}) GROUP BY GROUPING SETS ((lang), ())""")
def an12(spark, sf):
    return sg.segment_rates(_toxic(spark, sf), "lang", "toxic")


@query("an13_chi_square", """
WITH c AS (SELECT o_orderpriority AS s, o_orderstatus AS t, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT s, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT t, sum(n) AS cn FROM c GROUP BY 1), x AS (SELECT sum(n) AS total FROM c),
e AS (SELECT r.s, k.t, rn * cn / total AS e FROM r, k, x)
SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM k) AS cols, (SELECT total::BIGINT FROM x) AS n_used,
 (((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1))::DOUBLE AS df, round(sum(pow(coalesce(n, 0) - e, 2) / e), 6) AS chi2_statistic
FROM e LEFT JOIN c USING (s, t)""")
def an13(spark, sf):
    r = sg.chi_square(sg.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"))
    return r.withColumn("chi2_statistic", F.round("chi2_statistic", 6))


@query("an13_chi_square_2x2", """
WITH c AS (SELECT l_linestatus AS s, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS t, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT s, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT t, sum(n) AS cn FROM c GROUP BY 1), x AS (SELECT sum(n) AS total FROM c),
e AS (SELECT r.s, k.t, rn * cn / total AS e FROM r, k, x)
SELECT 2::BIGINT AS rows, 2::BIGINT AS cols, (SELECT total::BIGINT FROM x) AS n_used, 1.0::DOUBLE AS df,
 round(sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e), 6) AS chi2_statistic FROM e JOIN c USING (s, t)""")
def an13_yates(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus", F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("returned"))
    return sg.chi_square(sg.crosstab(li, "l_linestatus", "returned")).withColumn("chi2_statistic", F.round("chi2_statistic", 6))


@query("an13_chi_square_p_value")
def an13_p(spark, sf):
    return sg.with_chi2_p(sg.chi_square(sg.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")))


@query("an14_crosstab", """SELECT o_orderpriority AS segment, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
 count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def an14(spark, sf):
    return sg.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def line_sql(period, date, value, src):
    return f"""WITH d AS (SELECT {date} AS ds, avg({value}) AS y FROM {src} WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1),
p AS (SELECT {period} AS period, avg(y) AS y FROM d GROUP BY 1),
o AS (SELECT period, y, row_number() OVER (ORDER BY period) - 1 AS idx, count(*) OVER () AS n_periods FROM p),
tl AS (SELECT a.period, a.idx::INTEGER AS idx, a.y, round(a.y, 2) AS value, a.n_periods,
 round((SELECT avg(b.y) FROM o b WHERE b.idx <= a.idx AND b.idx > a.idx - greatest(2, least(5, a.n_periods // 3))), 2) AS rolling_avg FROM o a)"""


ORDER_LINE = line_sql("last_day(ds)", "o_orderdate", "o_totalprice", "orders")
EVENT_LINE = line_sql("ds::DATE", "ts", "value", "events")


def _order_line(spark, sf):
    return tr.timeline(tr.period_means(tr.trend_points(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), "month"))


def _event_line(spark, sf):
    return tr.timeline(tr.period_means(tr.trend_points(table(spark, sf, "events"), "ts", "value"), "day"))


@query("an15_monthly_series", ORDER_LINE + " SELECT period, idx, value FROM tl")
def an15(spark, sf):
    r = tr.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    assert r.params["unit"] == "month"
    return r.tables["timeline"].select("period", "idx", "value")


@query("an15_weekly_series", line_sql("date_trunc('week', ds)::DATE + 6", "ts", "value", "events") + " SELECT period, idx, value FROM tl")
def an15_week(spark, sf):
    return tr.trend(table(spark, sf, "events"), "ts", "value", freq="W").tables["timeline"].select("period", "idx", "value")


@query("an16_trend_slope", ORDER_LINE + """ SELECT count(*) AS n_periods, round(regr_slope(y, idx), 4) AS linear_slope, round(corr(y, idx), 4) AS standardized_slope FROM tl""")
def an16(spark, sf):
    return tr.trend_summary(_order_line(spark, sf)).select("n_periods", "linear_slope", "standardized_slope")


@query("an16_trend_p_value")
def an16_p(spark, sf):
    return tr.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice").summary


_CHANGE = """ SELECT round(arg_min(y, idx), 2) AS start_value, round(arg_max(y, idx), 2) AS end_value,
 round((arg_max(y, idx) - arg_min(y, idx)) / abs(arg_min(y, idx)) * 100, 2) AS percentage_change,
 CASE WHEN (arg_max(y, idx) - arg_min(y, idx)) / abs(arg_min(y, idx)) * 100 <= -5 THEN 'downward'
  WHEN (arg_max(y, idx) - arg_min(y, idx)) / abs(arg_min(y, idx)) * 100 >= 5 THEN 'upward' ELSE 'stable' END AS overall_trend FROM tl"""


@query("an17_percent_change", EVENT_LINE + _CHANGE)
def an17(spark, sf):
    return tr.trend_summary(_event_line(spark, sf)).select("start_value", "end_value", "percentage_change", "overall_trend")


@query("an18_peak_trough", EVENT_LINE + """ SELECT (SELECT period FROM tl ORDER BY y DESC, idx LIMIT 1) AS peak_period, round(max(y), 2) AS peak_value,
 (SELECT period FROM tl ORDER BY y, idx LIMIT 1) AS trough_period, round(min(y), 2) AS trough_value FROM tl""")
def an18(spark, sf):
    return tr.trend_summary(_event_line(spark, sf)).select("peak_period", "peak_value", "trough_period", "trough_value")


@query("an19_rolling_mean", EVENT_LINE + " SELECT period, idx, rolling_avg FROM tl")
def an19(spark, sf):
    return _event_line(spark, sf).select("period", "idx", "rolling_avg")
