"""IN-*, EV-*, MD-*: findings, run metrics and metadata on derived result tables."""

from pyspark.sql import functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import charts as ch, correlation as co, evaluation as ev, imputation as im, insights as ins, metadata as md, segments as sg
from workload import fixtures_text as fx
from workload.analysis import LINE_NUMS, ORDER_LINE, ORDERS_SEG, _order_line, _pair_sql
from workload.cleaning import _ROLES, _STATS, R, rows
from workload.registry import query, table
from workload.relational import derived


def dec(x, k):
    """A number as text with k places, halves away from zero."""
    return f"(({x})::DOUBLE::VARCHAR::DECIMAL(38,20)::DECIMAL(18,{k})::VARCHAR)"


def sdec(x, k):
    return f"(CASE WHEN ({x}) >= 0 THEN '+' ELSE '' END || {dec(x, k)})"


_CONF = "CASE WHEN {r} > 0.4 OR {n} < 30 THEN 'low' WHEN {r} > 0.2 OR {n} < 60 THEN 'medium' ELSE 'high' END"
_RATE = "round({x} / greatest(1, {t}), 4)"


def score_sql(kind, eff, p, n, x, conf, anom="NULL"):
    tot = f"({n} + {x})"
    an = f"(coalesce(least(1.0, abs({eff})), 0.5) * 0.45 + CASE WHEN {p} > 0.05 THEN 0.4 ELSE 1.0 END * 0.35 + CASE WHEN {tot} > 0 THEN {n} / {tot} ELSE 1.0 END * 0.20) * CASE WHEN {p} > 0.05 THEN 0.55 ELSE 1.0 END"
    dq = f"0.35 + 0.65 * least(1.0, {x} / greatest(1, {tot}) * 1.5)"
    raw = f"CASE WHEN {kind} = 'data_quality' THEN {dq} WHEN {kind} = 'outlier' AND {anom} = 0 THEN least(0.10, {an}) ELSE {an} END"
    return f"round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, ({raw})::DOUBLE * CASE {conf} WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END::DOUBLE)), 4)"


def caveat_sql(n, r, p):
    return (f"concat_ws('|', CASE WHEN {r} > 0.25 THEN 'High exclusion/imputation rate (' || {dec(r + ' * 100', 1)} || '% rows affected).' END, "
            f"CASE WHEN {n} < 30 THEN 'Small sample size (n=' || {n} || '); interpret with caution.' END, "
            f"CASE WHEN {p} > 0.05 THEN 'Not statistically significant at alpha=0.05 (p=' || {dec(p, 4)} || ').' END)")


# A table of results, one row per order, with all parts of a score. Totals are
# primes so that no share lands on a rounding tie.
RESULTS = """SELECT o_orderkey AS run_id, CASE o_orderkey % 5 WHEN 0 THEN 'data_quality' WHEN 1 THEN 'outlier' WHEN 2 THEN 'trend' WHEN 3 THEN 'correlation' ELSE 'segment_difference' END AS kind,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 131) / 131.0E0 END AS effect, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 11) / 100.0E0 END AS p,
 o_custkey % 97 AS n_used, CASE o_orderkey % 3 WHEN 0 THEN 101 WHEN 1 THEN 149 ELSE 211 END - o_custkey % 97 AS n_excluded, o_orderkey % 4 AS anomalies FROM orders"""


def results(spark, sf):
    return derived(spark, sf, RESULTS)


@query("in01_confidence", f"SELECT run_id, {_CONF.format(n='n_used', r='r')} AS confidence FROM (SELECT *, {_RATE.format(x='n_excluded', t='(n_used + n_excluded)')} AS r FROM ({RESULTS}))")
def in01(spark, sf):
    d = results(spark, sf)
    return d.select("run_id", sc.confidence(F.col("n_used"), sc.exclusion_rate(F.col("n_excluded"), F.col("n_used") + F.col("n_excluded"))).alias("confidence"))


@query("in02_impact_score", f"SELECT run_id, {score_sql('kind', 'effect', 'p', 'n_used', 'n_excluded', 'c', 'anomalies')} AS impact_score FROM (SELECT *, {_CONF.format(n='n_used', r='(n_excluded / greatest(1, n_used + n_excluded))')} AS c FROM ({RESULTS}))")
def in02(spark, sf):
    d = results(spark, sf)
    conf = sc.confidence(F.col("n_used"), F.col("n_excluded") / F.greatest(F.lit(1), F.col("n_used") + F.col("n_excluded")))
    return d.select("run_id", sc.impact_score(F.col("kind"), F.col("effect"), F.col("p"), F.col("n_used"), F.col("n_excluded"), conf, F.col("anomalies")).alias("impact_score"))


_R3 = f"(SELECT *, n_used + n_excluded AS total_records, {_RATE.format(x='n_excluded', t='(n_used + n_excluded)')} AS r FROM ({RESULTS}))"


def suppressed_sql(src, analysis, target):
    """Rows of suppress() for a source with run_id, n_used, n_excluded, r."""
    rule = f"concat_ws(' and ', CASE WHEN n_used < 20 THEN 'n_used=' || n_used || ' < 20' END, CASE WHEN r > 0.5 THEN 'exclusion_rate=' || {dec('r * 100', 1)} || '% > 50%' END)"
    sc_ = score_sql("'data_quality'", "r", "NULL::DOUBLE", "n_used", "n_excluded", "'low'")
    return (f"SELECT run_id, 'insight-dq-insufficient-' || {analysis} || '-' || regexp_replace({target}, '[ /]', '_', 'g') AS insight_id, 'data_quality' AS type, 'Insufficient data for ' || {analysis} || ' on ' || {target} AS title, "
            f"'Analytical finding for ' || {analysis} || ' on ''' || {target} || ''' was suppressed due to insufficient data for ' || {analysis} || ' (' || {rule} || ').' AS summary, n_used, n_excluded, r AS exclusion_rate, 'low' AS confidence, "
            f"'insufficient data for ' || {analysis} AS caveats, {sc_} AS impact_score FROM {src} WHERE n_used < 20 OR r > 0.5")


_OUT = ["run_id", "insight_id", "type", "title", "summary", "n_used", "n_excluded", "exclusion_rate", "confidence", "caveats", "impact_score"]


def flat(df):
    return df.withColumn("caveats", F.array_join("caveats", "|")).select(*_OUT)


@query("in03_suppress", suppressed_sql(_R3, "kind", "('run ' || run_id)"))
def in03(spark, sf):
    d = results(spark, sf).select("run_id", F.col("kind").alias("analysis"), F.concat(F.lit("run "), F.col("run_id")).alias("target"), "n_used", "n_excluded", (F.col("n_used") + F.col("n_excluded")).alias("total_records"))
    return flat(ins.suppress(d))


@query("in04_caveats", f"SELECT run_id, {caveat_sql('n_used', 'r', 'p')} AS caveats FROM {_R3}")
def in04(spark, sf):
    d = results(spark, sf)
    rate = sc.exclusion_rate(F.col("n_excluded"), F.col("n_used") + F.col("n_excluded"))
    return d.select("run_id", F.array_join(sc.caveats(F.col("n_used"), rate, F.col("p")), "|").alias("caveats"))


def insight_sql(src, kind, analysis, target, iid, title, summary, eff, p, anom="NULL"):
    """Kept and suppressed rows for a source that has n_used and total_records."""
    s = f"(SELECT *, total_records - n_used AS n_excluded, {_RATE.format(x='(total_records - n_used)', t='total_records')} AS r FROM {src})"
    conf = _CONF.format(n="n_used", r="r")
    kept = (f"SELECT run_id, {iid} AS insight_id, '{kind}' AS type, {title} AS title, {summary} AS summary, n_used, n_excluded, r AS exclusion_rate, {conf} AS confidence, "
            f"{caveat_sql('n_used', 'r', p)} AS caveats, {score_sql(chr(39) + kind + chr(39), eff, p, 'n_used', 'n_excluded', '(' + conf + ')', anom)} AS impact_score FROM {s} WHERE NOT (n_used < 20 OR r > 0.5)")
    return kept + " UNION ALL " + suppressed_sql(s, f"'{analysis}'", target)


# One segment comparison per customer's market segment and nation: o_orderpriority x o_totalprice.
_SEGS = """SELECT c_nationkey AS run_id, o_orderpriority AS segment, count(*) AS n, floor(median(o_totalprice) * 100) / 100 AS shown FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
_SUMM = """SELECT run_id, 'priority' AS segment_column, 'price' AS metric_column, CASE WHEN run_id % 2 = 0 THEN 'numeric' ELSE 'rate' END AS kind,
 max(CASE WHEN r = 1 THEN segment END) AS top_segment, max(CASE WHEN r = k THEN segment END) AS bottom_segment, round(max(shown) - min(shown), 2) AS absolute_difference,
 CASE WHEN run_id % 8 = 4 THEN NULL ELSE floor(max(shown) / min(shown) * 100) / 100 END AS top_vs_bottom_ratio, CAST(run_id AS DOUBLE) + 0.25 AS overall_rate_percent,
 CASE WHEN run_id % 9 = 8 THEN NULL ELSE run_id % 13 / 100.0E0 END AS p_value, CAST(sum(n) AS BIGINT) AS n_used, CAST(sum(n) * (1 + run_id % 3) AS BIGINT) AS total_records
 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY shown DESC, segment) AS r, count(*) OVER (PARTITION BY run_id) AS k FROM s) GROUP BY run_id"""


def _seg_source():
    per = """(SELECT u.*, g.groups, g.smallest, g.ts, g.bs, g.tn, g.bn FROM summ u JOIN (SELECT s.run_id, string_agg(s.segment || ': n=' || s.n, ', ' ORDER BY s.shown DESC, s.segment) AS groups, min(s.n) AS smallest,
 max(s.shown) FILTER (s.segment = u2.top_segment) AS ts, max(s.shown) FILTER (s.segment = u2.bottom_segment) AS bs, max(s.n) FILTER (s.segment = u2.top_segment) AS tn, max(s.n) FILTER (s.segment = u2.bottom_segment) AS bn
 FROM s JOIN summ u2 USING (run_id) GROUP BY s.run_id) g USING (run_id))"""
    nothing = "(CASE WHEN kind = 'rate' THEN NOT coalesce(p_value < 0.05, false) ELSE coalesce(p_value >= 0.05, false) END)"
    pt = f"coalesce('p=' || {dec('p_value', 4)}, 'p not available')"
    power = "CASE WHEN smallest < 30 THEN ' (limited statistical power due to small sample size in some groups, n < 30)' ELSE '' END"
    title = f"CASE WHEN {nothing} THEN 'No clear difference in ' || metric_column || ' across ' || segment_column WHEN kind = 'rate' THEN metric_column || ' rate depends on ' || segment_column ELSE 'Differences in ' || metric_column || ' across ' || segment_column END"
    summary = (f"CASE WHEN {nothing} THEN 'the groups do not differ significantly (group sizes: ' || groups || ', ' || {pt} || ')' || {power} || '.' "
               f"WHEN kind = 'rate' THEN 'Overall ' || metric_column || ' rate is ' || {dec('overall_rate_percent', 2)} || '% across ' || n_used || ' non-imputed rows (chi2 ' || {pt} || '). ' || top_segment || ' recorded ' || {dec('ts', 2)} || '% (n=' || tn || '), compared to ' || bottom_segment || ' at ' || {dec('bs', 2)} || '% (n=' || bn || ').' "
               f"ELSE top_segment || ' leads in ' || metric_column || ' (median ' || {dec('ts', 2)} || ') compared to ' || bottom_segment || ' (median ' || {dec('bs', 2)} || ')' || coalesce(', ' || {dec('top_vs_bottom_ratio', 2)} || ' times as much', '') || coalesce(' (p=' || {dec('p_value', 4)} || ')', '') || '.' END")
    eff = "CASE WHEN kind = 'rate' THEN round(absolute_difference / 100, 4) ELSE coalesce(round(abs(top_vs_bottom_ratio - 1), 4), 0.2) END"
    return insight_sql(per, "segment_difference", "segment_difference", "(segment_column || ' vs ' || metric_column)", "'insight-seg-' || segment_column || '-' || metric_column", title, summary, eff, "p_value")


def segment_results(spark, sf):
    s = derived(spark, sf, _SEGS)
    s.createOrReplaceTempView("s")
    return spark.sql(_SUMM), s


@query("in05_segment_insights", f"WITH s AS ({_SEGS}), summ AS ({_SUMM}) {_seg_source()}")
def in05(spark, sf):
    return flat(ins.segment_insights(*segment_results(spark, sf)))


_PAIRS = """SELECT run_id, 'l_quantity' AS column_x, other AS column_y, r AS correlation, n AS n_used, n * (run_id % 4) AS n_excluded, run_id % 17 / 100.0E0 AS p_value FROM (
 SELECT l_suppkey AS run_id, 'l_extendedprice' AS other, round(corr(l_quantity, l_extendedprice), 4) AS r, count(*) AS n FROM lineitem GROUP BY 1
 UNION ALL SELECT l_suppkey, 'l_discount', round(corr(l_quantity, l_discount), 4), count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'l_tax', round(corr(l_quantity, l_tax), 4), count(*) FROM lineitem GROUP BY 1) x"""
_ST = "CASE WHEN abs(correlation) >= 0.7 THEN 'very strong' WHEN abs(correlation) >= 0.5 THEN 'strong' WHEN abs(correlation) >= 0.3 THEN 'moderate' ELSE 'weak' END || CASE WHEN correlation > 0 THEN ' positive' ELSE ' negative' END"
_PSRC = f"""(SELECT *, n_used + n_excluded AS total_records FROM (SELECT *, {_ST} AS strength, row_number() OVER (PARTITION BY run_id ORDER BY abs(correlation) >= 0.08 DESC, abs(correlation) DESC, column_x, column_y) AS k FROM ({_PAIRS})) WHERE k <= 2 AND (k = 1 OR abs(correlation) >= 0.08))"""


@query("in06_correlation_insights", insight_sql(_PSRC, "correlation", "correlation", "(column_x || ' vs ' || column_y)", "'insight-corr-' || column_x || '-' || column_y",
       "upper(left(strength, 1)) || substr(strength, 2) || ' relationship between ' || column_x || ' and ' || column_y",
       f"'Pearson r=' || {dec('correlation', 4)} || ' relates ' || column_x || ' and ' || column_y || ' across ' || n_used || ' rows with both (left out: ' || {dec('r * 100', 1)} || '%).'", "correlation", "p_value").replace("SELECT *, total_records - n_used AS n_excluded", "SELECT * EXCLUDE (n_excluded), total_records - n_used AS n_excluded"))
def in06(spark, sf):
    p = derived(spark, sf, _PAIRS)
    p = p.withColumns({"strength": co.strength(F.col("correlation")), "is_strong": F.abs("correlation") >= 0.08})
    return flat(ins.correlation_insights(p))


_TRENDS = """SELECT l_suppkey AS run_id, 'l_quantity' AS value_column, CASE l_suppkey % 3 WHEN 0 THEN 'upward' WHEN 1 THEN 'downward' ELSE 'stable' END AS overall_trend,
 CAST(floor(avg(l_quantity) * 100) / 100 - 25 AS DOUBLE) AS percentage_change, CAST(floor(avg(l_tax) * 10000) / 10000 AS DOUBLE) - 0.04 AS standardized_slope,
 CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey % 9 / 100.0E0 END AS p_value, l_suppkey % 40 + 3 AS n_periods, count(*) AS n_used, count(*) * (1 + l_suppkey % 3) AS total_records FROM lineitem GROUP BY l_suppkey"""
_DIR = "CASE overall_trend WHEN 'stable' THEN 'consistent' ELSE overall_trend END"
_PT = f"coalesce('p=' || {dec('p_value', 4)}, 'p not available')"


@query("in07_trend_insights", insight_sql(f"({_TRENDS})", "trend", "trend", "value_column", "'insight-trend-' || value_column",
       f"CASE WHEN p_value >= 0.05 THEN 'No clear trend in ' || value_column ELSE upper(left({_DIR}, 1)) || substr({_DIR}, 2) || ' course of ' || value_column || ' (' || {sdec('percentage_change', 1)} || '%)' END",
       f"CASE WHEN p_value >= 0.05 THEN 'A fitted line shows no significant trend in ' || value_column || ' (' || {_PT} || ', standardized slope=' || {sdec('standardized_slope', 4)} || ')' ELSE value_column || ' shows a mostly ' || {_DIR} || ' course (standardized slope=' || {sdec('standardized_slope', 4)} || ', ' || {_PT} || ')' END || ' across ' || n_periods || ' time periods (' || n_used || ' rows used).'",
       "round(abs(standardized_slope), 4)", "p_value"))
def in07(spark, sf):
    return flat(ins.trend_insights(derived(spark, sf, _TRENDS)))


_OUTL = """SELECT l_suppkey AS run_id, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'l_extendedprice' END AS top_column, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE count(CASE WHEN l_extendedprice > 90000 THEN 1 END) END AS anomaly_count,
 CASE WHEN l_suppkey % 4 = 0 THEN 0.0E0 ELSE round(count(CASE WHEN l_extendedprice > 90000 THEN 1 END) * 100.0E0 / count(*), 2) END AS anomaly_rate_percent, count(*) AS n_used, count(*) + l_suppkey AS total_records FROM lineitem GROUP BY l_suppkey"""


@query("in08_outlier_insights", insight_sql(f"(SELECT *, coalesce(top_column, 'features') AS c FROM ({_OUTL}))", "outlier", "outliers", "c", "'insight-outlier-' || c",
       f"CASE WHEN anomaly_count = 0 THEN 'No values beyond the fences' ELSE anomaly_count || ' values beyond the fences (' || {dec('anomaly_rate_percent', 1)} || '%)' END",
       f"CASE WHEN anomaly_count = 0 THEN 'No value lies beyond the fences among ' || n_used || ' records using IQR 3.0x fence methodology.' ELSE 'Identified ' || anomaly_count || ' anomalous rows (' || {dec('anomaly_rate_percent', 1)} || '% anomaly rate) across ' || n_used || ' records, predominantly concentrated in column ''' || c || '''.' END",
       "round(anomaly_rate_percent / 100, 4)", "NULL::DOUBLE", "anomaly_count"))
def in08(spark, sf):
    return flat(ins.outlier_insights(derived(spark, sf, _OUTL)))


_FIND = """SELECT o_custkey AS run_id, 'col_' || CAST(o_orderkey AS STRING) AS "column", CASE o_orderkey % 4 WHEN 0 THEN 'sentinel' WHEN 1 THEN 'invalid' WHEN 2 THEN 'returns' ELSE 'extreme' END AS kind,
 'age_bounds_0_100' AS rule, CAST(o_orderkey % 1000 AS DOUBLE) AS value, o_orderkey % 300 + 1 AS "count", CASE o_orderkey % 3 WHEN 0 THEN 401 WHEN 1 THEN 701 ELSE 1009 END AS total_records FROM orders"""
_IMP = """SELECT o_custkey AS run_id, 'col_' || CAST(o_orderkey AS STRING) AS "column", o_orderkey % 400 AS imputed_count, round((o_orderkey % 400) / 409.0E0, 4) AS imputation_rate, 409 AS total_records FROM orders"""


def spark_sql(sql):
    return sql.replace('"column"', "`column`").replace('"count"', "`count`")


def _dq_sql():
    f = f"""SELECT run_id, 'insight-dq-' || CASE kind WHEN 'extreme' THEN 'extremes' ELSE kind END || '-' || "column" AS insight_id,
 CASE kind WHEN 'sentinel' THEN 'Sentinel values sanitized in ' WHEN 'invalid' THEN 'Invalid domain values sanitized in ' WHEN 'returns' THEN 'Suspected transaction returns in ' ELSE 'Repeated extreme values in ' END || "column" AS title,
 CASE kind WHEN 'sentinel' THEN 'Detected and sanitized ' || count || ' sentinel values (' || value::VARCHAR || ') in column ''' || "column" || ''' prior to imputation.'
  WHEN 'invalid' THEN 'Identified and sanitized ' || count || ' invalid values in column ''' || "column" || ''' violating ' || rule || ' prior to imputation.'
  WHEN 'returns' THEN 'Identified ' || count || ' negative entries in ''' || "column" || ''' flagged as suspected customer returns and preserved in dataset.'
  ELSE 'Identified ' || count || ' occurrences of repeated value ' || value::VARCHAR || ' in column ''' || "column" || ''' outside 3x IQR fence; preserved as valid extremes.' END AS summary,
 CASE WHEN kind IN ('sentinel', 'invalid') THEN count ELSE 0 END AS x, total_records, round(count / total_records, 4) AS e,
 CASE kind WHEN 'sentinel' THEN 'Replaced ' || count || ' values with median before statistical analysis.' WHEN 'invalid' THEN count || ' invalid entries converted to NaN and imputed.' WHEN 'returns' THEN 'Negative values preserved to reflect transaction return dynamics.' ELSE 'Extreme values preserved without deletion.' END AS caveats,
 CASE kind WHEN 'returns' THEN 0.45 WHEN 'extreme' THEN 0.42 END AS fixed FROM ({_FIND})
UNION ALL SELECT run_id, 'insight-dq-imputation-' || "column", 'Elevated imputation rate in ' || "column" || ' (' || {dec('imputation_rate * 100', 1)} || '%)',
 'Column ''' || "column" || ''' required ' || {dec('imputation_rate * 100', 1)} || '% imputation (' || imputed_count || ' missing entries imputed).', imputed_count, total_records, imputation_rate,
 'Substantial proportion (' || {dec('imputation_rate * 100', 1)} || '%) of values were deterministically imputed.', NULL FROM ({_IMP}) WHERE imputation_rate >= 0.10"""
    conf = f"CASE WHEN fixed IS NOT NULL THEN 'high' ELSE {_CONF.format(n='n', r='r')} END"
    return f"""SELECT run_id, insight_id, 'data_quality' AS type, title, summary, n AS n_used, x AS n_excluded, r AS exclusion_rate, {conf} AS confidence, caveats,
 coalesce(fixed::DOUBLE, {score_sql("'data_quality'", 'e', 'NULL::DOUBLE', 'n', 'x', '(' + conf + ')')}) AS impact_score FROM (SELECT *, greatest(0, total_records - x) AS n, {_RATE.format(x='x', t='total_records')} AS r FROM ({f}))"""


@query("in09_quality_insights", _dq_sql())
def in09(spark, sf):
    return flat(ins.quality_insights(derived(spark, sf, spark_sql(_FIND)), derived(spark, sf, spark_sql(_IMP))))


# Many insights per run, with repeats.
_MANY = """SELECT o_custkey % 50 AS run_id, CASE WHEN o_orderkey % 8 = 0 THEN 'insight-dq-insufficient-' ELSE 'insight-' END || CAST(o_orderkey AS STRING) AS insight_id,
 CASE WHEN o_orderkey % 8 = 0 OR o_orderkey % 3 = 0 THEN 'data_quality' WHEN o_orderkey % 3 = 1 THEN 'trend' ELSE 'segment_difference' END AS type, o_orderpriority || ' ' || CAST(o_orderkey % 40 AS STRING) AS title,
 'Order ' || CAST(o_orderkey % 40 AS STRING) || ' is stable.' AS summary, o_orderstatus AS target, o_orderkey % 500 AS n_used, (o_orderkey * 7919 % 10007) / 10007.0E0 AS impact_score FROM orders"""
_RANKED = f"""d AS (SELECT * FROM ({_MANY}) QUALIFY row_number() OVER (PARTITION BY run_id, type, target, title ORDER BY impact_score DESC, insight_id DESC) = 1),
a AS (SELECT *, (type = 'data_quality')::INT AS c, row_number() OVER (PARTITION BY run_id, type = 'data_quality' ORDER BY CASE WHEN type <> 'data_quality' OR contains(insight_id, 'insufficient') THEN 0 ELSE 1 END, impact_score DESC, insight_id) AS r FROM d),
z AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY c, r))::INTEGER AS rank FROM a WHERE r <= CASE c WHEN 1 THEN 3 ELSE 5 END), ranked AS (SELECT * EXCLUDE (c, r) FROM z WHERE rank <= 8)"""


def ranked(spark, sf):
    return ins.rank_insights(derived(spark, sf, _MANY))


@query("in10_rank_insights", f"WITH {_RANKED} SELECT * FROM ranked")
def in10(spark, sf):
    return ranked(spark, sf)


_TEXTS = """SELECT o_orderkey AS text_id, CASE o_orderkey % 8 WHEN 0 THEN 'Value None recorded' WHEN 1 THEN 'price is nan for ' || o_orderpriority WHEN 2 THEN 'WHERE price IS NOT NULL' WHEN 3 THEN 'a NULL value' WHEN 4 THEN ''
 WHEN 5 THEN 'the highest metric wins' WHEN 6 THEN 'nonetheless fine ' || o_orderstatus ELSE 'Price across priority ' || o_orderpriority END AS text FROM orders"""


@query("in11_placeholder_flags", """SELECT text_id, text, text = '' OR regexp_matches(lower(text), '\\b(metric across segment|in metric across|highest metric|lowest metric|median none|mean none|across segment|none recorded|compared to none|for none|none vs none)\\b')
 OR regexp_matches(text, '\\b(None|nan|NaN)\\b') OR (regexp_matches(lower(text), '\\bnull\\b') AND NOT regexp_matches(lower(text), '\\b(is\\s+not\\s+null|is\\s+null|not\\s+null|set\\s+null)\\b')) AS has_placeholder FROM (""" + _TEXTS + ")")
def in11(spark, sf):
    return ins.placeholder_flags(derived(spark, sf, _TEXTS), "text")


_CAT = "CASE WHEN starts_with(insight_id, 'insight-dq-insufficient') THEN 'Data Quality Suppression' WHEN type = 'data_quality' THEN 'Data Quality' WHEN type = 'trend' THEN 'Trend Analysis' ELSE 'Segment Comparison' END"


@query("in16_narrate_findings", f"WITH {_RANKED} SELECT run_id, rank, insight_id, {_CAT} AS category, title AS headline, replace(summary, 'stable', 'consistent') AS narrative, n_used, impact_score FROM ranked")
def in16_findings(spark, sf):
    return ins.narrate_findings(ranked(spark, sf))


@query("in16_narrate", f"""WITH {_RANKED}, f AS (SELECT run_id, rank, {_CAT} AS category, replace(summary, 'stable', 'consistent') AS narrative, row_number() OVER (PARTITION BY run_id, {_CAT} ORDER BY rank) AS k FROM ranked)
SELECT run_id, count(*) AS total_findings, concat_ws(' ', 'Autonomous analysis concluded with validated analytical findings.', string_agg(narrative, ' ' ORDER BY rank) FILTER (category NOT LIKE 'Data Quality%'),
 'Suppressed analyses: ' || string_agg(narrative, '; ' ORDER BY rank) FILTER (category = 'Data Quality Suppression') || '.', 'Data quality caveats: ' || string_agg(narrative, ' ' ORDER BY rank) FILTER (category = 'Data Quality')) AS executive_summary FROM f GROUP BY 1""")
def in16(spark, sf):
    return ins.narrate(ranked(spark, sf))


@query("in17_segment_points", f"SELECT 'bar' AS chart_type, segment AS label, mean AS value, round(std / sqrt(count), 4) AS error FROM ({ORDERS_SEG})")
def in17_segment(spark, sf):
    return ch.chart_points("segment", sg.segment_stats(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query("in17_matrix_points", f"WITH p AS ({_pair_sql(LINE_NUMS, 'lineitem')}) SELECT 'heatmap' AS chart_type, * FROM (SELECT column_x AS x, column_y AS y, correlation AS value FROM p UNION ALL SELECT column_y, column_x, correlation FROM p UNION ALL SELECT c, c, 1.0 FROM (SELECT DISTINCT unnest([column_x, column_y]) AS c FROM p))")
def in17_matrix(spark, sf):
    return ch.chart_points("correlation", co.correlation_matrix(co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS)))


@query("in17_timeline_points", ORDER_LINE + " SELECT 'line' AS chart_type, period AS x, value AS y, rolling_avg AS rolling FROM tl")
def in17_line(spark, sf):
    return ch.chart_points("trend", _order_line(spark, sf))


@query("in17_imputation_points", f"WITH {R}, s AS ({_STATS}) SELECT 'bar' AS chart_type, \"column\" AS label, round(imputation_rate * 100, 1) AS value FROM s WHERE round(imputation_rate * 100, 1) > 0 ORDER BY value DESC LIMIT 8")
def in17_imputation(spark, sf):
    return ch.chart_points("imputation", im.imputation_stats(rows(spark, sf).select(*_ROLES), _ROLES))


@query("in18_box_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, max({c}) AS max FROM lineitem" for c in ["l_quantity", "l_extendedprice"]))
def in18_box(spark, sf):
    return ch.box_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("in18_histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(floor((value - lo) / (hi - lo) * 15), 14)::INTEGER AS bin, lo, hi FROM events, e)
SELECT bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 15), 6) AS bin_start, round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 15), 6) AS bin_end, count(*) AS count FROM b GROUP BY bin""")
def in18_histogram(spark, sf):
    return ch.histogram(table(spark, sf, "events"), "value")


_KINDS = "CASE k WHEN 0 THEN 'segment_difference' WHEN 1 THEN 'correlation' WHEN 2 THEN 'trend' WHEN 3 THEN 'outlier' WHEN 4 THEN 'sentinel' WHEN 5 THEN 'invalid_domain' ELSE 'missingness' END"
_PLANT = f"SELECT c_custkey AS run_id, 'P' || CAST(k AS STRING) AS planted_id, {_KINDS} AS kind, CASE WHEN k < 2 THEN 'cohort' ELSE 'metric score' END AS name_1, CASE WHEN k < 2 THEN 'metric_score' END AS name_2 FROM (SELECT c_custkey, c_custkey % 7 AS k FROM customer) c"
_RUNS = """SELECT o_custkey AS run_id, 'ins-' || CAST(o_orderkey AS STRING) AS insight_id, CASE o_orderkey % 5 WHEN 0 THEN 'segment_difference' WHEN 1 THEN 'correlation' WHEN 2 THEN 'trend' WHEN 3 THEN 'outlier' ELSE 'data_quality' END AS type,
 CASE o_orderkey % 3 WHEN 0 THEN 'Metric Score by cohort' WHEN 1 THEN 'Sentinel and invalid values' ELSE 'Other' END AS title, CASE o_orderkey % 4 WHEN 0 THEN 'missing metric_score' ELSE 'in metric score 999' END AS summary,
 o_orderkey % 100 / 100.0E0 AS effect_size, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 10 / 100.0E0 END AS significance, CASE o_orderkey % 4 WHEN 0 THEN 'downward' WHEN 1 THEN 'upward' END AS direction FROM orders"""
_HIT = """CASE kind WHEN 'segment_difference' THEN type = 'segment_difference' AND coalesce(significance < 0.05, true) WHEN 'correlation' THEN type = 'correlation' AND effect_size >= 0.4 WHEN 'trend' THEN type = 'trend' AND coalesce(direction, 'upward') = 'upward'
 WHEN 'outlier' THEN type = 'outlier' WHEN 'sentinel' THEN type = 'data_quality' AND (contains(b, '999') OR contains(b, 'sentinel')) WHEN 'invalid_domain' THEN type = 'data_quality' AND (contains(b, 'negative') OR contains(b, 'invalid'))
 ELSE type = 'data_quality' AND (contains(b, 'missing') OR contains(b, 'imput')) END"""
_MATCHED = f"""p AS ({_PLANT}), i AS (SELECT *, replace(lower(title || ' ' || summary), ' ', '_') AS b FROM ({_RUNS})),
h AS (SELECT p.run_id, p.planted_id, min(insight_id) AS matching_insight_id FROM p JOIN i ON p.run_id = i.run_id AND {_HIT} AND contains(b, replace(lower(name_1), ' ', '_')) AND contains(b, replace(lower(coalesce(name_2, '')), ' ', '_')) GROUP BY 1, 2),
mt AS (SELECT p.*, matching_insight_id, matching_insight_id IS NOT NULL AS found FROM p LEFT JOIN h USING (run_id, planted_id))"""


def matched(spark, sf):
    return ev.match_planted(derived(spark, sf, _PLANT), derived(spark, sf, _RUNS))


@query("ev01_match_planted", f"WITH {_MATCHED} SELECT * FROM mt")
def ev01(spark, sf):
    return matched(spark, sf)


def _wilson(k, n):
    z = "1.95996"
    d = f"(1.0 + {z} * {z} / {n})"
    c = f"(({k} / {n} + {z} * {z} / (2.0 * {n})) / {d})"
    m = f"(({z} / {d}) * sqrt({k} / {n} * (1.0 - {k} / {n}) / {n} + {z} * {z} / (4.0 * {n} * {n})))"
    return f"greatest(0.0::DOUBLE, round(({c} - {m}) * 100, 2))", f"least(100.0::DOUBLE, round(({c} + {m}) * 100, 2))"


@query("ev02_recall", f"""WITH {_MATCHED}, g AS (SELECT kind, count(*)::DOUBLE AS n, count(*) FILTER (found)::DOUBLE AS k FROM mt GROUP BY GROUPING SETS ((kind), ()))
SELECT kind, n::BIGINT AS total_planted, k::BIGINT AS found, round(k / n * 100, 2) AS recall_percent, {_wilson('k', 'n')[0]} AS ci_low, {_wilson('k', 'n')[1]} AS ci_high FROM g""")
def ev02(spark, sf):
    return ev.recall(matched(spark, sf))


@query("ev03_wilson", f"SELECT l_suppkey, n::BIGINT AS n, k::BIGINT AS k, {_wilson('k', 'n')[0]} AS ci_low, {_wilson('k', 'n')[1]} AS ci_high FROM (SELECT l_suppkey, count(*)::DOUBLE AS n, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS k FROM lineitem GROUP BY 1)")
def ev03(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    lo, hi = sc.wilson(F.col("k"), F.col("n"))
    return g.withColumns({"ci_low": lo, "ci_high": hi})


_TESTS = "SELECT l_suppkey AS run_id, CASE l_linenumber % 4 WHEN 0 THEN 'trend' WHEN 1 THEN 'correlation' WHEN 2 THEN 'segment_difference' ELSE 'outlier' END AS type, CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE CAST(l_orderkey * l_orderkey % 9973 AS DOUBLE) * (l_orderkey * 31 % 9973) / (9973.0E0 * 9973.0E0) / (1 + l_orderkey % 2 * 40) END AS p_value FROM lineitem"
_FP = f"""t AS (SELECT * FROM ({_TESTS}) WHERE type <> 'outlier'), r AS (SELECT *, count(p_value) OVER (PARTITION BY run_id) AS m, rank() OVER (PARTITION BY run_id ORDER BY p_value NULLS LAST) + count(*) OVER (PARTITION BY run_id, p_value) - 1 AS rk FROM t),
a AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / rk) FILTER (p_value IS NOT NULL) OVER (PARTITION BY run_id ORDER BY p_value DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS p_adj FROM r),
g AS (SELECT run_id, count(*) AS tests, count(*) FILTER (p_value < 0.05 AND p_adj < 0.05) AS fp FROM a GROUP BY 1)"""


@query("ev04_null_false_positives", f"WITH {_FP} SELECT count(*) AS null_runs, sum(tests)::BIGINT AS total_tests, sum(fp)::BIGINT AS false_positives, round(sum(fp) / count(*), 2) AS fp_per_run, round(sum(fp) / sum(tests) * 100, 2) AS per_test_fp_rate FROM g")
def ev04(spark, sf):
    return ev.null_false_positives(derived(spark, sf, _TESTS))


_AUDIT = "SELECT CASE WHEN l_partkey % 7 < 2 THEN 'match' WHEN l_partkey % 7 < 5 THEN 'rounding' ELSE 'unverifiable' END AS result FROM lineitem"


@query("ev05_numeric_accuracy", f"""SELECT count(*) AS total_numbers, count(*) FILTER (result <> 'unverifiable') AS verified, count(*) FILTER (result = 'unverifiable') AS unverifiable,
 round(count(*) FILTER (result <> 'unverifiable') / count(*) * 100, 2) AS numeric_accuracy, round(count(*) FILTER (result = 'unverifiable') / count(*) * 100, 2) AS unverifiable_rate FROM ({_AUDIT})""")
def ev05(spark, sf):
    return ev.numeric_accuracy(derived(spark, sf, _AUDIT))


_EFF = "SELECT o_totalprice / 10000 AS wall_time_seconds, o_custkey AS tokens, o_orderkey % 7 AS steps, o_orderkey % 3 + 1 AS rounds, o_orderkey % 11 AS tool_calls, o_orderkey % 5 = 0 AS follow_up, o_orderkey % 4 = 0 AS is_null FROM orders"


@query("ev06_run_efficiency", f"""SELECT count(*) AS runs, round(avg(wall_time_seconds) FILTER (wall_time_seconds > 0), 2) AS mean_wall_time, round(avg(tokens), 0) AS mean_tokens, round(avg(steps), 2) AS mean_steps, round(avg(rounds), 2) AS mean_rounds,
 round(avg(tool_calls), 2) AS mean_tool_calls, round(count(*) FILTER (NOT is_null AND follow_up) / count(*) FILTER (NOT is_null) * 100, 2) AS follow_up_percent FROM ({_EFF})""")
def ev06(spark, sf):
    return ev.run_efficiency(derived(spark, sf, _EFF))


_LOG = "SELECT l_suppkey AS run_id, CASE l_linenumber % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'model' ELSE 'synthesis' END AS phase, l_quantity AS seconds FROM lineitem"


@query("ev07_latency_totals", f"SELECT run_id, count(*) AS steps, {', '.join(f'round(sum(CASE WHEN phase = {chr(39)}{p}{chr(39)} THEN seconds ELSE 0.0 END), 3) AS {p}_seconds' for p in ('tool', 'model', 'synthesis'))}, round(sum(seconds), 3) AS total_seconds FROM ({_LOG}) GROUP BY 1")
def ev07(spark, sf):
    return ev.latency_totals(derived(spark, sf, _LOG))


_FB = "SELECT o_custkey AS job_id, o_orderpriority AS insight_id, CASE WHEN o_orderkey % 3 = 0 THEN 'not_relevant' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'helpful' END AS rating FROM orders"
_SCH = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Hourly' WHEN 1 THEN 'weekly' ELSE 'daily' END AS frequency, o_orderkey % 3 <> 0 AS is_active, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS next_run_at FROM orders"


@query("md01_feedback_counts", f"SELECT job_id, insight_id, count(*) AS total_feedbacks, count(*) FILTER (rating = 'helpful') AS helpful_count, count(*) FILTER (rating = 'not_relevant') AS not_relevant_count FROM ({_FB}) GROUP BY 1, 2")
def md01(spark, sf):
    return md.feedback_counts(derived(spark, sf, _FB))


@query("md02_due_schedules", f"SELECT * FROM ({_SCH}) WHERE is_active AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '1998-06-01')")
def md02(spark, sf):
    return md.due_schedules(derived(spark, sf, _SCH), "1998-06-01 00:00:00")


@query("md03_next_run", f"SELECT id, CASE lower(frequency) WHEN 'hourly' THEN next_run_at + INTERVAL 1 HOUR WHEN 'weekly' THEN next_run_at + INTERVAL 7 DAY ELSE next_run_at + INTERVAL 1 DAY END AS next_run FROM ({_SCH})")
def md03(spark, sf):
    return derived(spark, sf, _SCH).select("id", md.next_run(F.col("frequency"), F.col("next_run_at")).alias("next_run"))


@query("md04_tenant_rows", f"SELECT job_id, user_id FROM ({fx.JOBS}) WHERE user_id = 4 OR user_id IS NULL")
def md04(spark, sf):
    return md.tenant_rows(derived(spark, sf, fx.JOBS), 4).select("job_id", "user_id")


@query("md05_recency_buckets", f"""SELECT job_id, created_at, time_group, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY time_group ORDER BY created_at DESC, job_id) AS rank FROM (SELECT *, CASE created_at::DATE WHEN DATE '2001-07-31' THEN 'Today' WHEN DATE '2001-07-30' THEN 'Yesterday' ELSE 'Older' END AS time_group FROM ({fx.JOBS}))) WHERE rank <= 8""")
def md05(spark, sf):
    return md.recency_buckets(derived(spark, sf, fx.JOBS), "2001-07-31").select("job_id", "created_at", "time_group", "rank")


@query("md06_search_rows", f"SELECT job_id, goal, status FROM ({fx.JOBS}) WHERE contains(lower(goal), 'high') OR contains(lower(status), 'high') OR contains(job_id::VARCHAR, 'high')")
def md06(spark, sf):
    return md.search_rows(derived(spark, sf, fx.JOBS), ["goal", "status", "job_id"], " HIGH ").select("job_id", "goal", "status")
