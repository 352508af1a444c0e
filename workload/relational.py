"""SQ-*, JN-*, WN-*, SO-*, ST-*: questions, joins, windows, sorts and sets."""

from pyspark.sql import functions as F

from tidemark.functions.labels import format_label
from tidemark.functions.quantiles import cumulative_histogram, value_histogram
from tidemark.operators import casing, cleaning as cl, correlation as co, imputation as im, joins as jn, outliers as ou, questions as qu
from tidemark.operators import segments as sg, sentinels as se, sets as st, sqlview as sq, windows as wn
from workload import fixtures_text as fx
from workload.analysis import EVENT_LINE, LINE_NUMS, ORDERS_SEG, _event_line, _iqr_sql, _pair_sql
from workload.cleaning import _CANON, _COUNTS, _FILL, _MEASURES, _ROLES, R, rows
from workload.registry import query, table


def derived(spark, sf, sql):
    for t in ("orders", "part", "customer", "lineitem", "events", "documents", "conversations"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def imputed(spark, sf):
    m = rows(spark, sf).select(*_ROLES)
    return im.impute(m, im.imputation_stats(m, _ROLES).collect())


FILLED = f"""{R}, f AS (SELECT {', '.join(f'{_FILL.format(c=c)} AS f_{c}' for c in _MEASURES)} FROM m),
data_observed AS (SELECT order_id, priority, quantity, salary, age::DOUBLE AS age FROM m),
data_clean AS (SELECT order_id, priority, {', '.join(f'coalesce({c}, f_{c}) AS {c}' for c in _MEASURES)} FROM m, f)"""

_S1 = "SELECT priority, count(*) AS n, round(avg(salary), 2) AS avg_salary FROM data_clean WHERE priority IS NOT NULL GROUP BY priority"


@query("sq01_query_sql", f"WITH {FILLED} {_S1}")
def sq01(spark, sf):
    return sq.query_sql(imputed(spark, sf), _S1)


# The other engine's own parser lists the tables and functions of a statement. Two forms it cannot parse are told by their key.
_READ = f"SELECT *, json_serialize_sql(statement) AS j, regexp_extract_all(json_serialize_sql(statement), '\"table_name\":\"([^\"]*)\"', 1) AS tables, regexp_extract_all(json_serialize_sql(statement), '\"function_name\":\"([^\"]*)\"', 1) AS calls, regexp_extract_all(json_serialize_sql(statement), '\"key\":\"([^\"]*)\"', 1) AS named FROM ({fx.STATEMENTS})"
_REASON = """CASE WHEN trim(statement) = '' THEN 'empty' WHEN statement_id % 32 = 7 THEN 'unreadable' WHEN statement_id % 32 = 10 THEN 'external access' WHEN j::JSON ->> '$.error' = 'true' OR statement = 'SHOW TABLES' THEN 'not a select'
 WHEN json_array_length(j::JSON, '$.statements') > 1 THEN 'multiple statements'
 WHEN list_has_any(calls, ['read_csv', 'java_method', 'reflect']) OR j LIKE '%"schema_name":"default"%' OR NOT list_has_all(list_concat(named, ['data_clean', 'df', 'dataset', 'data_observed']), tables) THEN 'external access' END"""


@query("sq02_statement_guard", f"SELECT statement_id, statement, {_REASON} AS reason, {_REASON} IS NULL AS allowed FROM ({_READ})")
def sq02(spark, sf):
    return sq.check_statements(derived(spark, sf, fx.STATEMENTS), "statement")


@query("sq03_result_limit", f"WITH {FILLED} SELECT least(200, count(*)) AS limited, count(*) AS n, sum(order_id)::BIGINT AS ids, round(sum(salary), 2) AS salaries FROM data_clean")
def sq03(spark, sf):
    ds = imputed(spark, sf)
    few = sq.query_sql(ds, "SELECT order_id, salary FROM data_clean -- LIMIT 3", 200).agg(F.count("*").alias("limited"))
    every = sq.query_sql(ds, "SELECT order_id, salary FROM data_clean")
    return every.agg(few.scalar().alias("limited"), F.count("*").alias("n"), F.sum("order_id").alias("ids"), F.round(F.sum("salary"), 2).alias("salaries"))


def _any(words, q="q"):
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


_ROUTE = f"""CASE WHEN {_any(qu.CLEAN_WORDS)} THEN 'data_clean' WHEN {_any(qu.OBSERVED_WORDS)} THEN 'data_observed'
 WHEN ({_any(qu.COUNT_WORDS)} OR contains(q, 'share of credit card') OR (contains(q, 'share of') AND contains(q, 'payment'))) AND NOT {_any(qu.METRIC_WORDS)} THEN 'data_clean' ELSE 'data_observed' END"""


@query("sq04_route_questions", f"SELECT question_id, question, {_ROUTE} AS basis FROM (SELECT *, lower(question) AS q FROM ({fx.QUESTIONS}))")
def sq04(spark, sf):
    return qu.route_questions(derived(spark, sf, fx.QUESTIONS))


def _mention_sql(c):
    words = [c] + [p for p in c.split("_") if len(p) > 2]
    conds = [f"regexp_matches(q, '\\b{w}\\b')" for w in words]
    for names, parts in qu.COLUMN_ALIASES:
        target = next((x for x in fx.COLUMNS if any(p in x for p in parts)), None)
        if target is None and "sales" in names:
            target = "quantity"
        if target == c:
            conds.append(_any(names))
    return " OR ".join(conds)


_MATCH = " UNION ALL ".join(f"SELECT question_id, question, '{c}' AS \"column\" FROM qs WHERE {_mention_sql(c)}" for c in fx.COLUMNS)
_QS = f"qs AS (SELECT *, lower(question) AS q FROM ({fx.QUESTIONS}))"


@query("sq05_match_columns", f"WITH {_QS} {_MATCH}")
def sq05(spark, sf):
    return qu.match_columns(derived(spark, sf, fx.QUESTIONS), fx.COLUMNS)


@query("sq06_group_metric", f"WITH {FILLED} SELECT priority, round(avg(salary), 2) AS avg_salary, round(avg(age), 2) AS avg_age, count(*) AS n, 'data_observed' AS basis FROM data_observed WHERE priority IS NOT NULL AND salary IS NOT NULL AND age IS NOT NULL GROUP BY 1")
def sq06(spark, sf):
    return sq.group_metric(imputed(spark, sf), "priority", ["salary", "age"])


@query("sq07_group_count", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def sq07(spark, sf):
    return sq.group_count(table(spark, sf, "events"), "event_type", highest_first=True)


@query("sq08_category_share", f"WITH {R} SELECT priority, count(*) AS n, round(count(*) * 100.0 / (SELECT count(priority) FROM m), 2) AS share_percent, (SELECT count(priority) FROM m) AS n_total FROM m WHERE priority IS NOT NULL GROUP BY 1")
def sq08(spark, sf):
    return sq.category_share(rows(spark, sf), "priority")


@query("sq09_ratio_of_sums", """SELECT l_returnflag, round(sum(l_discount), 4) AS total_num, round(sum(l_quantity), 4) AS total_den, count(*) AS n,
 round(sum(l_discount) * 100.0 / nullif(sum(l_quantity), 0), 2) AS rate_percent FROM lineitem GROUP BY 1""")
def sq09(spark, sf):
    return sq.ratio_of_sums(table(spark, sf, "lineitem"), "l_returnflag", "l_discount", "l_quantity").withColumns({c: F.round(c, 4) for c in ("total_num", "total_den")})


@query("sq10_overall_metric", "SELECT round(avg(l_quantity), 2) AS avg_l_quantity, round(avg(l_extendedprice), 2) AS avg_l_extendedprice, count(*) AS n FROM lineitem")
def sq10(spark, sf):
    return sq.overall_metric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("sq10_overall_count", "SELECT count(*) AS total_count FROM lineitem")
def sq10_count(spark, sf):
    return sq.overall_count(table(spark, sf, "lineitem"))


@query("sq11_annotate_basis", f"""WITH {FILLED} SELECT priority, round(avg(salary), 2) AS avg_salary, count(*) AS n, 'data_clean' AS basis,
 'imputed share: salary ' || format('{{:.1f}}', round((SELECT (count(*) - count(salary)) / count(*) FROM m), 4) * 100) || '% imputed' AS note FROM data_clean WHERE priority IS NOT NULL GROUP BY 1""")
def sq11(spark, sf):
    ds = imputed(spark, sf)
    stats = im.imputation_stats(rows(spark, sf).select(*_ROLES), _ROLES)
    return sq.annotate_basis(sq.group_metric(ds, "priority", ["salary"], basis="data_clean").drop("basis"), "salary", "data_clean", stats)


_LABELS = """SELECT o_orderkey AS label_id, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'paypal' WHEN 3 THEN 'CREDIT card' WHEN 4 THEN ' hr '
 WHEN 5 THEN lower(o_orderpriority) WHEN 6 THEN 'self-employed staff' WHEN 7 THEN o_orderpriority ELSE 'McDonald' END AS label FROM orders"""


@query("sq12_format_label", f"""SELECT label_id, CASE WHEN label IS NULL OR t = '' THEN 'unspecified' WHEN lower(t) = 'paypal' THEN 'PayPal' WHEN lower(t) = 'credit card' THEN 'Credit Card'
 WHEN upper(t) IN ('HR','IT','ID','PR','AI','ML','BI','USA','UK','EU') THEN upper(t)
 WHEN t = lower(t) AND t <> upper(t) THEN list_aggregate(list_transform(regexp_extract_all(t, '[a-z]+|[^a-z]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', '') ELSE t END AS shown
 FROM (SELECT *, trim(label) AS t FROM ({_LABELS}))""")
def sq12(spark, sf):
    return derived(spark, sf, _LABELS).select("label_id", format_label(F.col("label")).alias("shown"))


def _entity_sql():
    import re

    names = {re.sub(r"[^a-z0-9]", "", c) for c in fx.COLUMNS}
    words = {w for c in fx.COLUMNS for w in c.split("_") if len(w) > 2}
    parts = []
    for e, aliases in qu.ENTITIES:
        if not any(a in names or any(a in w for w in words) for a in aliases):
            parts.append(f"WHEN regexp_matches(q, '\\b({'|'.join([e, *aliases])})\\b') THEN '{e}'")
    return "CASE " + " ".join(parts) + " END"


@query("sq13_missing_entities", f"WITH {_QS} SELECT * FROM (SELECT question_id, question, {_entity_sql()} AS missing_entity FROM qs) WHERE missing_entity IS NOT NULL")
def sq13(spark, sf):
    return qu.missing_entities(derived(spark, sf, fx.QUESTIONS), fx.COLUMNS)


_REFUSED = " OR ".join("regexp_matches(trim(lower(t)), '" + p.replace("'", "''") + "')" for p in qu.REFUSED)


@query("sq14_flag_requests", f"SELECT question_id, question, {_REFUSED} AS is_refused FROM (SELECT *, question AS t FROM ({fx.QUESTIONS}))")
def sq14(spark, sf):
    return qu.flag_requests(derived(spark, sf, fx.QUESTIONS), "question")


@query("sq14_flag_conversations", f"SELECT conv_id, turn, {_REFUSED} AS is_refused FROM (SELECT *, text AS t FROM conversations)")
def sq14_conversations(spark, sf):
    return qu.flag_requests(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "is_refused")


@query("sq15_match_insights", f"""WITH {_QS}, mc AS ({_MATCH}), i AS ({fx.INSIGHT_ROWS}),
ci AS (SELECT DISTINCT c."column", insight_id, impact_score FROM (SELECT DISTINCT "column" FROM mc) c JOIN i ON contains(i.metric, c."column") OR contains(c."column", i.metric)
  OR regexp_matches(lower(title || ' ' || summary), '\\b' || c."column" || '\\b')),
p AS (SELECT question_id, insight_id, max(impact_score) AS impact_score FROM mc JOIN ci USING ("column") GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY impact_score DESC, insight_id)::INTEGER AS rank FROM p) SELECT * FROM r WHERE rank <= 3""")
def sq15(spark, sf):
    ins = derived(spark, sf, fx.INSIGHT_ROWS).withColumn("metric_columns", F.array("metric"))
    return qu.match_insights(derived(spark, sf, fx.QUESTIONS), ins, fx.COLUMNS)


@query("jn01_apply_label_map", f"""WITH {R}, {_COUNTS}, {_CANON} SELECT order_id, p.canonical AS priority FROM m
 LEFT JOIN k p ON p."column" = 'priority' AND p.key = lower(regexp_replace(trim(priority), '\\s+', ' ', 'g'))""")
def jn01(spark, sf):
    m = rows(spark, sf).select("order_id", "priority")
    return casing.apply_map(m, casing.changed_spellings(casing.spelling_counts(m, ["priority"])), "priority")


@query("jn02_percentile_without", f"""WITH {R}, h AS (SELECT visits::DOUBLE AS value, count(*) AS cnt FROM m GROUP BY 1)
SELECT 'visits' AS "column", value, cnt, (SELECT count(*) FROM m) AS n, (SELECT round(quantile_cont(x.visits::DOUBLE, 0.25), 6) FROM m x WHERE x.visits <> h.value) AS q1,
 (SELECT round(quantile_cont(x.visits::DOUBLE, 0.75), 6) FROM m x WHERE x.visits <> h.value) AS q3 FROM h""")
def jn02(spark, sf):
    h = cumulative_histogram(value_histogram(cl.doubles(rows(spark, sf), ["visits"])))
    return se.percentile_without(h, h).withColumns({"q1": F.round("q1", 6), "q3": F.round("q3", 6)})


@query("jn03_join_claims", f"""WITH c AS ({fx.CLAIMS}), s AS ({fx.METRICS}) SELECT source_id, metric_key, claim_id, round(c.value, 2) AS value, round(s.value, 2) AS expected,
 abs(c.value - s.value) / greatest(1e-9, abs(s.value)) <= 0.05 OR abs(c.value - s.value) <= 0.05 AS is_match FROM c JOIN s USING (source_id, metric_key)""")
def jn03(spark, sf):
    r = jn.join_claims(derived(spark, sf, fx.CLAIMS), derived(spark, sf, fx.METRICS))
    return r.withColumns({"value": F.round("value", 2), "expected": F.round("expected", 2)})


_POOLED = f"""n AS ({fx.NUMBERS}), p AS (SELECT DISTINCT value FROM ({fx.POOL})), d AS (SELECT DISTINCT number FROM n),
x AS (SELECT number, bool_or(number = value OR round(number, 2) = value OR round(number, 1) = value OR trunc(number) = value) AS exact,
 bool_or((abs(value) > 0 AND abs(number - value) / abs(value) <= 0.02) OR abs(number - value) <= 0.05) AS near FROM d, p GROUP BY 1)"""


@query("jn04_match_numbers", f"WITH {_POOLED} SELECT number, number_id, CASE WHEN exact THEN 'match' ELSE 'rounding' END AS result FROM n JOIN x USING (number) WHERE exact OR near")
def jn04(spark, sf):
    return jn.match_numbers(derived(spark, sf, fx.NUMBERS), derived(spark, sf, fx.POOL))


@query("jn05_unmatched", f"WITH {_POOLED} SELECT number, number_id FROM n JOIN x USING (number) WHERE NOT (exact OR near)")
def jn05(spark, sf):
    return jn.unmatched(derived(spark, sf, fx.NUMBERS), derived(spark, sf, fx.POOL))


_PLANTED = "SELECT o_custkey AS seed, o_orderpriority AS finding, o_orderkey AS planted_id FROM orders"
_REPORTED = "SELECT c_custkey AS seed, CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' ELSE '5-LOW' END AS finding FROM customer"


@query("jn06_found_signals", f"SELECT p.* FROM ({_PLANTED}) p WHERE EXISTS (SELECT 1 FROM ({_REPORTED}) r WHERE r.seed = p.seed AND r.finding = p.finding)")
def jn06(spark, sf):
    return jn.found_signals(derived(spark, sf, _PLANTED), derived(spark, sf, _REPORTED), ["seed", "finding"]).select("seed", "finding", "planted_id")


@query("jn07_label_jobs", f"SELECT dataset_id, job_id, status, coalesce(d.filename, 'Dataset') AS dataset_name FROM ({fx.JOBS}) j LEFT JOIN ({fx.DATASETS}) d ON d.id = j.dataset_id")
def jn07(spark, sf):
    return jn.label_jobs(derived(spark, sf, fx.JOBS), derived(spark, sf, fx.DATASETS)).select("dataset_id", "job_id", "status", "dataset_name")


_S8 = """SELECT c.priority, count(*) AS n, count(o.salary) AS observed, round(avg(c.salary), 2) AS clean_mean, round(avg(o.salary), 2) AS observed_mean
 FROM data_clean c JOIN data_observed o ON c.order_id = o.order_id GROUP BY c.priority"""


@query("jn08_compare_views", f"WITH {FILLED} {_S8}")
def jn08(spark, sf):
    return jn.compare_views(imputed(spark, sf), _S8)


@query("wn01_rolling_mean", EVENT_LINE + " SELECT period, round(avg(y) OVER (ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) AS rolling_mean FROM tl")
def wn01(spark, sf):
    return wn.rolling_mean(_event_line(spark, sf).select("period", "y"), "period", "y", 5).select("period", "rolling_mean")


@query("wn02_best_spelling", f"WITH {R}, {_COUNTS}, {_CANON} SELECT \"column\", key, winner, n FROM w")
def wn02(spark, sf):
    return casing.best_spelling(casing.spelling_counts(rows(spark, sf), ["priority", "churned"])).select("column", "key", "winner", "n")


@query("wn03_share_of_total", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 2) AS share_percent FROM orders GROUP BY 1")
def wn03(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return wn.share_of_total(g, "total").withColumn("total", F.round("total", 2))


@query("wn04_period_index", "SELECT DISTINCT l_shipdate::DATE AS day, (dense_rank() OVER (ORDER BY l_shipdate::DATE) - 1)::INTEGER AS idx FROM lineitem")
def wn04(spark, sf):
    return wn.period_index(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct(), "day")


@query("wn05_first_last", """SELECT event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value,
 arg_min(event_id, (-value, event_id)) AS peak_at, max(value) AS peak_value, arg_min(event_id, (value, event_id)) AS trough_at, min(value) AS trough_value FROM events GROUP BY 1""")
def wn05(spark, sf):
    return wn.first_last(table(spark, sf, "events"), "event_id", "value", ["event_type"])


_PVALUES = """SELECT l_orderkey AS test_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS seed,
 CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE floor((l_discount * 10 + l_tax) * (l_partkey % 97 + 1) / 120 * 10000) / 10000 END AS p FROM lineitem"""


@query("wn06_bh_adjust", f"""WITH t AS (SELECT * FROM ({_PVALUES})), r AS (SELECT *, count(p) OVER (PARTITION BY seed) AS m, rank() OVER (PARTITION BY seed ORDER BY p NULLS LAST) + count(*) OVER (PARTITION BY seed, p) - 1 AS rk FROM t)
SELECT test_id, seed, p, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * m / rk) OVER (PARTITION BY seed ORDER BY p DESC NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) END AS p_adj FROM r""")
def wn06(spark, sf):
    return wn.bh_adjust(derived(spark, sf, _PVALUES), "p", ["seed"]).withColumn("p_adj", F.round("p_adj", 8))


@query("wn07_latest_job", f"""SELECT job_id, dataset_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, job_id) AS r FROM ({fx.JOBS}) WHERE status = 'completed') WHERE r = 1""")
def wn07(spark, sf):
    j = derived(spark, sf, fx.JOBS).filter("status = 'completed'").select("job_id", "dataset_id", "created_at")
    return wn.latest_per_key(j, "dataset_id", "created_at", "job_id")


@query("wn08_top_k", f"""SELECT metric, insight_key, impact_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY impact_score DESC, insight_key)::INTEGER AS rank FROM ({fx.INSIGHT_ROWS})) WHERE rank <= 5""")
def wn08(spark, sf):
    i = derived(spark, sf, fx.INSIGHT_ROWS).select("metric", "insight_key", "impact_score")
    return wn.top_k(i, ["metric"], "impact_score", "insight_key", 5)


@query("wn09_first_per_key", "SELECT doc_id, lang, source, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def wn09(spark, sf):
    return wn.first_per_key(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), ["text"], ["doc_id"])


@query("so01_rank_segments", ORDERS_SEG + " ORDER BY mean DESC, segment")
def so01(spark, sf):
    return sg.rank_segments(sg.segment_stats(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query("so02_top_pair", f"SELECT * FROM ({_pair_sql(LINE_NUMS, 'lineitem')}) ORDER BY abs(correlation) DESC, column_x, column_y LIMIT 1")
def so02(spark, sf):
    return co.top_pair(co.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMS))


@query("so03_rank_outlier_columns", f"SELECT \"column\", outlier_count AS count, outlier_percentage AS percentage FROM ({_iqr_sql(['l_quantity', 'l_extendedprice'], 'lineitem', 0.6)}) WHERE outlier_count > 0 ORDER BY 2 DESC")
def so03(spark, sf):
    return ou.rank_outlier_columns(ou.outliers(table(spark, sf, "lineitem"), "iqr", ["l_quantity", "l_extendedprice"], 0.6).tables["column_outliers"])


@query("so04_page", f"SELECT job_id, created_at FROM ({fx.JOBS}) ORDER BY created_at DESC, job_id OFFSET 20 LIMIT 15")
def so04(spark, sf):
    return wn.page(derived(spark, sf, fx.JOBS).select("job_id", "created_at"), [F.desc("created_at"), "job_id"], 20, 15)


@query("so05_top_groups", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def so05(spark, sf):
    return wn.top_groups(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"])


_PARTY = {"customer": ["c_custkey", "c_name", "c_acctbal"], "supplier": ["s_suppkey", "s_name", "s_acctbal"]}


def parties(spark, sf):
    return {t: table(spark, sf, t).select(*[F.col(c).alias(n) for c, n in zip(cols, ["key", "name", "balance"])]) for t, cols in _PARTY.items()}


_PARTIES = " UNION ALL ".join(f"SELECT {c[0]} AS key, {c[1]} AS name, {c[2]} AS balance, '{t}' AS source_table FROM {t}" for t, c in _PARTY.items())


@query("st01_union_tagged", _PARTIES)
def st01(spark, sf):
    return st.union_tagged(parties(spark, sf))


@query("st02_column_diff", " UNION ALL ".join([f"SELECT 'left' AS side, '{c}' AS \"column\", count({c}) AS \"values\" FROM orders" for c in ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]]
       + [f"SELECT 'right', '{c}', count(*) FROM orders" for c in ["o_year"]]))
def st02(spark, sf):
    o = table(spark, sf, "orders")
    return st.column_diff(o, o.select("o_orderstatus", F.year("o_orderdate").alias("o_year")))


@query("st03_distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def st03(spark, sf):
    return st.distinct_rows(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("st04_union_flags", "SELECT event_id FROM events WHERE value > 30 OR event_type = 'error'")
def st04(spark, sf):
    return st.union_flags(table(spark, sf, "events"), {"high": F.col("value") > 30, "error": F.col("event_type") == "error"}).select("event_id")
