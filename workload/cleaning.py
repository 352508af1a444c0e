"""CL-*: the cleaning steps on the messy orders."""

from pyspark.sql import functions as F

from tidemark.operators import casing, cleaning as cl, imputation as im, sentinels as se
from tidemark.plans.clean import CleaningOptions, clean
from workload.fixtures import MESSY, MESSY_ROWS, messy
from workload.registry import query, table

M = f"m AS ({MESSY})"
R = f"m AS ({MESSY_ROWS})"


def rows(spark, sf):
    return messy(spark, sf, MESSY_ROWS)


@query("cl01_guard_rows", "SELECT count(*) AS n FROM lineitem")
def cl01(spark, sf):
    return cl.guard_rows(table(spark, sf, "lineitem"), 10_000_000_000).agg(F.count("*").alias("n"))


@query("cl02_sample_rows", "SELECT l_orderkey FROM lineitem ORDER BY ((l_orderkey + 42) * 2654435761) % 4294967296, l_orderkey LIMIT 500")
def cl02(spark, sf):
    return cl.sample_rows(table(spark, sf, "lineitem").select("l_orderkey"), 500, "l_orderkey")


@query("cl03_trim_headers", "SELECT n_name AS \"name\", n_regionkey AS \"region key\" FROM nation")
def cl03(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias(" name "), F.col("n_regionkey").alias("region key  "))
    return cl.trim_headers(n)


@query("cl04_trim_cells", f"WITH {R} SELECT order_id, regexp_replace(priority, '^\\s+|\\s+$', '', 'g') AS priority FROM m")
def cl04(spark, sf):
    return cl.trim_cells(rows(spark, sf).select("order_id", "priority"))


@query("cl05_collapse_spaces", r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS text FROM documents")
def cl05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cl.collapse_spaces(F.col("text")).alias("text"))


_TITLE = "regexp_replace({c}, '^.', upper(left({c}, 1)))"
# The labels here are runs of capitals after "<digit>-"; no lower-case winner needs title case
# except churned, whose lower-case form loses to its title-case spelling by count.
_COUNTS = """c AS (SELECT "column", lower(spelling) AS key, spelling, count(*) AS n FROM (
 SELECT 'priority' AS "column", regexp_replace(trim(priority), '\\s+', ' ', 'g') AS spelling FROM m UNION ALL SELECT 'churned', regexp_replace(trim(churned), '\\s+', ' ', 'g') FROM m)
 WHERE spelling IS NOT NULL GROUP BY 1, 2, 3)"""
_CANON = """w AS (SELECT "column", key, sum(n)::BIGINT AS n, arg_min(spelling, (-n, CASE WHEN regexp_matches(substr(spelling, 2), '[A-Z]') THEN 0 ELSE 1 END,
  CASE WHEN regexp_matches(spelling, '^[A-Z]') THEN 0 ELSE 1 END, spelling)) AS winner,
 arg_min(spelling, (-n, spelling)) FILTER (regexp_matches(spelling, '^[A-Z]') AND NOT regexp_matches(substr(spelling, 2), '[A-Z]')) AS best_title FROM c GROUP BY 1, 2),
k AS (SELECT "column", key, n, CASE WHEN winner = upper(winner) AND winner <> lower(winner) AND length(winner) <= 4 THEN winner
  WHEN regexp_matches(substr(winner, 2), '[A-Z]') THEN winner
  WHEN winner = lower(winner) AND winner <> upper(winner) THEN coalesce(best_title, upper(left(winner, 1)) || substr(winner, 2)) ELSE winner END AS canonical FROM w)"""


@query("cl06_canonical_map", f"WITH {R}, {_COUNTS}, {_CANON} SELECT \"column\", key, canonical, n FROM k")
def cl06_map(spark, sf):
    return casing.canonical_map(casing.spelling_counts(rows(spark, sf), ["priority", "churned"]))


@query("cl06_canonical_case", f"""WITH {R}, {_COUNTS}, {_CANON}
SELECT order_id, p.canonical AS priority, h.canonical AS churned FROM m LEFT JOIN k p ON p."column" = 'priority' AND p.key = lower(regexp_replace(trim(priority), '\\s+', ' ', 'g'))
LEFT JOIN k h ON h."column" = 'churned' AND h.key = lower(regexp_replace(trim(churned), '\\s+', ' ', 'g'))""")
def cl06(spark, sf):
    return casing.canonical_case(rows(spark, sf).select("order_id", "priority", "churned"), ["priority", "churned"])


def _cand(c):
    return f"""SELECT '{c}' AS "column", count(DISTINCT s) AS distinct_values, count(DISTINCT lower(s)) AS distinct_keys, count(DISTINCT s) > count(DISTINCT lower(s)) AS has_case_variants,
 count(DISTINCT s) / any_value(n) < 0.85 OR count(DISTINCT s) <= 250 OR count(DISTINCT s) > count(DISTINCT lower(s)) AS is_categorical
 FROM (SELECT regexp_replace(trim({c}), '\\s+', ' ', 'g') AS s, (SELECT count(*) FROM m) AS n FROM m)"""


@query("cl07_case_candidates", f"WITH {R} " + " UNION ALL ".join(_cand(c) for c in ["customer_id", "priority", "unit_price", "churned"]))
def cl07(spark, sf):
    m = rows(spark, sf)
    total = m.agg(F.count("*").alias("n")).scalar()
    return casing.case_candidates(casing.spelling_counts(m, ["customer_id", "priority", "unit_price", "churned"]), total)


@query("cl08_drop_duplicates", f"WITH {M} SELECT DISTINCT * FROM m")
def cl08(spark, sf):
    return cl.drop_duplicate_rows(messy(spark, sf))


@query("cl08_duplicate_count", f"WITH {M} SELECT (SELECT count(*) FROM m) AS rows, count(*) AS distinct_rows, (SELECT count(*) FROM m) - count(*) AS duplicates_removed FROM (SELECT DISTINCT * FROM m)")
def cl08_count(spark, sf):
    return cl.duplicate_count(messy(spark, sf))


@query("cl09_drop_null_columns", f"WITH {R} SELECT * EXCLUDE (notes) FROM m")
def cl09(spark, sf):
    return cl.drop_null_columns(rows(spark, sf))


@query("cl10_drop_constant_columns", f"WITH {R} SELECT * EXCLUDE (source) FROM m")
def cl10(spark, sf):
    return cl.drop_constant_columns(rows(spark, sf))


_COLS = ["order_id", "customer_id", "order_date", "priority", "unit_price", "quantity", "salary", "age", "visits", "churned", "notes", "source"]


@query("cl10_column_facts", f"WITH {R} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_share, "
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS is_constant FROM m" for c in _COLS))
def cl10_facts(spark, sf):
    return cl.column_facts(rows(spark, sf)).withColumn("null_share", F.round("null_share", 6))


_NUM = "try_cast(regexp_replace(trim({c}), '[$,€£¥]', '', 'g') AS DOUBLE)"


@query("cl11_currency_to_double", f"WITH {R} SELECT order_id, {_NUM.format(c='unit_price')} AS unit_price FROM m")
def cl11(spark, sf):
    return rows(spark, sf).select("order_id", cl.currency_to_double("unit_price").alias("unit_price"))


@query("cl12_coerce_numeric", f"WITH {R} SELECT order_id, customer_id, {_NUM.format(c='unit_price')} AS unit_price, priority FROM m")
def cl12(spark, sf):
    return cl.coerce_numeric(rows(spark, sf).select("order_id", "customer_id", "unit_price", "priority"))


DATE_SQL = """coalesce(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({c}, '%Y-%m-%d') END,
 CASE WHEN regexp_full_match({c}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({c}, '%m/%d/%Y') END,
 CASE WHEN regexp_full_match({c}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({c}, '%d-%m-%Y') END)"""


@query("cl13_coerce_dates", f"WITH {R} SELECT order_id, {DATE_SQL.format(c='order_date')} AS order_date FROM m")
def cl13(spark, sf):
    return cl.coerce_dates(rows(spark, sf).select("order_id", "order_date")).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query("cl14_flag_returns", f"WITH {R} SELECT 'quantity' AS \"column\", 'returns' AS rule, count(*) AS count FROM m WHERE quantity < 0")
def cl14(spark, sf):
    return cl.flag_returns(rows(spark, sf))


@query("cl15_null_negatives", f"WITH {R} SELECT order_id, CASE WHEN salary >= 0 THEN salary END AS salary, quantity FROM m")
def cl15(spark, sf):
    return cl.null_negatives(rows(spark, sf).select("order_id", "salary", "quantity"))


@query("cl16_null_bad_ages", f"WITH {R} SELECT order_id, CASE WHEN age BETWEEN 0 AND 100 THEN age END AS age FROM m")
def cl16(spark, sf):
    return cl.null_bad_ages(rows(spark, sf).select("order_id", "age"))


def repeated_sql(cols, src):
    """Brute force: one quantile query per repeated value of every column."""
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", value, cnt AS count, q[1] AS q1, q[2] AS q3 FROM (
 SELECT h.value, h.cnt, (SELECT quantile_cont(x.{c}::DOUBLE, [0.25, 0.75]) FROM {src} x WHERE x.{c} <> h.value) AS q,
  (SELECT count(x.{c}) FROM {src} x WHERE x.{c} <> h.value) AS others
 FROM (SELECT {c}::DOUBLE AS value, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) h) WHERE others >= 5""")
    return f"""SELECT "column", value, count, CASE WHEN value IN (999, 9999, 99999, -1, -999, -9999) THEN 'sentinel' ELSE 'extreme' END AS kind,
 round(q1 - 3 * (q3 - q1), 2) AS lower_fence, round(q3 + 3 * (q3 - q1), 2) AS upper_fence FROM ({" UNION ALL ".join(parts)})
 WHERE q3 > q1 AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))"""


@query("cl17_sentinels", f"WITH {R} SELECT * FROM ({repeated_sql(['quantity', 'visits'], 'm')}) WHERE kind = 'sentinel'")
def cl17(spark, sf):
    return se.repeated_value_findings(rows(spark, sf), ["quantity", "visits"]).filter("kind = 'sentinel'")


@query("cl17_null_sentinels", f"WITH {R} SELECT order_id, CASE WHEN quantity <> 999 THEN quantity END AS quantity, visits FROM m")
def cl17_null(spark, sf):
    m = rows(spark, sf).select("order_id", "quantity", "visits")
    return se.null_sentinels(m, se.repeated_value_findings(m, ["quantity", "visits"]).filter("kind = 'sentinel'").collect())


@query("cl18_repeated_extremes", f"WITH {R} SELECT * FROM ({repeated_sql(['quantity', 'visits'], 'm')}) WHERE kind = 'extreme'")
def cl18(spark, sf):
    return se.repeated_value_findings(rows(spark, sf), ["quantity", "visits"]).filter("kind = 'extreme'")


@query("cl19_role_facts", f"WITH {R} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, "
     f"coalesce(bool_or(regexp_matches({c}, '[A-Za-z]+[-_]?[0-9]+|[0-9]+[-_]?[A-Za-z]+')), false) AS code_like, NULL::DOUBLE AS max_value FROM m" for c in ["customer_id", "priority", "churned"]]
    + [f"SELECT '{c}', count({c}), NULL, false, max({c})::DOUBLE FROM m" for c in ["order_id", "quantity", "age"]]))
def cl19(spark, sf):
    return im.role_facts(rows(spark, sf).select("order_id", "customer_id", "priority", "churned", "quantity", "age"))


@query("cl19_roles", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{r}' AS role, (SELECT count(*) FROM orders) AS n" for c, r in [
    ("order_id", "identifier"), ("customer_id", "identifier"), ("order_date", "date"), ("priority", "categorical"), ("quantity", "measure"), ("age", "measure")]))
def cl19_roles(spark, sf):
    m = rows(spark, sf).select("order_id", "customer_id", "order_date", "priority", "quantity", "age")
    n = table(spark, sf, "orders").count()
    return spark.createDataFrame([(c, r, n) for c, r in im.classify_roles(m).items()], "column string, role string, n bigint")


_MEASURES = ["quantity", "salary", "age"]
_ROLES = {"order_id": "identifier", "priority": "categorical", "quantity": "measure", "salary": "measure", "age": "measure"}
_FILL = "CASE WHEN abs(skewness({c})) > 1 THEN median({c}) ELSE avg({c}) END"


@query("cl20_impute", f"WITH {R}, f AS (SELECT " + ", ".join(f"{_FILL.format(c=c)} AS f_{c}" for c in _MEASURES) + ") ".replace(")", " FROM m)")
       + " SELECT order_id, priority, " + ", ".join(f"round(coalesce({c}, f_{c}), 4) AS {c}, {c} IS NULL AS _imputed_{c}" for c in _MEASURES) + " FROM m, f")
def cl20(spark, sf):
    m = rows(spark, sf).select(*_ROLES)
    ds = im.impute(m, im.imputation_stats(m, _ROLES).collect())
    return ds.df.withColumns({c: F.round(c, 4) for c in _MEASURES})


@query("cl21_imputed_mask", f"WITH {R} SELECT order_id, quantity IS NULL AS _imputed_quantity, salary IS NULL AS _imputed_salary FROM m")
def cl21(spark, sf):
    return im.imputed_mask(rows(spark, sf), ["quantity", "salary"]).select("order_id", "_imputed_quantity", "_imputed_salary")


_STATS = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, 0::BIGINT AS imputed_count, 0.0::DOUBLE AS imputation_rate, 'none' AS strategy, '{r}' AS skip_reason, NULL::DOUBLE AS fill_value FROM m"
     for c, r in [("order_id", "identifier_column"), ("priority", "categorical_segment")]]
    + [f"SELECT '{c}', count(*) - count({c}), count(*) - count({c}), round((count(*) - count({c})) / count(*), 4), 'auto', NULL, round({_FILL.format(c=c)}, 4) FROM m" for c in _MEASURES])


@query("cl22_imputation_stats", f"WITH {R} {_STATS}")
def cl22(spark, sf):
    return im.imputation_stats(rows(spark, sf).select(*_ROLES), _ROLES).withColumn("fill_value", F.round("fill_value", 4))


_RAWQ = f"""WITH {M}, t AS (SELECT count(*) AS rows, {' + '.join(f'(count(*) - count({c}))' for c in _COLS)} AS missing_cells,
 count(*) FILTER (salary < 0) + count(*) FILTER (age > 100) AS invalid_count, count(*) FILTER (quantity = 999) AS sentinel_count,
 {' + '.join('CASE WHEN (count(*) - count(' + c + ')' + {'salary': ' + count(*) FILTER (salary < 0)', 'age': ' + count(*) FILTER (age > 100)', 'quantity': ' + count(*) FILTER (quantity = 999)'}.get(c, '') + ') / count(*) > 0.30 THEN 1 ELSE 0 END' for c in _COLS)} AS defective_columns FROM m),
d AS (SELECT (SELECT count(*) FROM m) - count(*) AS duplicate_rows FROM (SELECT DISTINCT * FROM m))
SELECT rows, missing_cells, duplicate_rows, invalid_count, sentinel_count, defective_columns::BIGINT AS defective_columns,
 greatest(0.0, round(100 - (0.7 * missing_cells / (rows * {len(_COLS)}) * 100 + duplicate_rows / rows * 100 + 3.5 * invalid_count / (rows * {len(_COLS)}) * 100
  + 2.5 * sentinel_count / (rows * {len(_COLS)}) * 100 + 12.0 * defective_columns), 1)) AS quality_raw FROM t, d"""


@query("cl23_quality_raw", _RAWQ)
def cl23(spark, sf):
    m = messy(spark, sf)
    found = m.agg(F.count_if(F.col("salary") < 0).alias("s"), F.count_if(F.col("age") > 100).alias("a"), F.count_if(F.col("quantity") == 999).alias("q")).select(
        F.explode(F.array(
            F.struct(F.lit("salary").alias("column"), F.lit("invalid").alias("kind"), F.col("s").alias("count")),
            F.struct(F.lit("age").alias("column"), F.lit("invalid").alias("kind"), F.col("a").alias("count")),
            F.struct(F.lit("quantity").alias("column"), F.lit("sentinel").alias("kind"), F.col("q").alias("count")))).alias("x")).select("x.*")
    return im.quality_raw(m, found)


@query("cl24_quality_clean", f"""WITH {R}, t AS (SELECT count(*) AS rows, count(*) - count(priority) AS missing, {' + '.join(f'(count(*) - count({c}))' for c in _MEASURES)} AS imputed FROM m)
SELECT missing AS remaining_missing, imputed AS imputed_cells, round(100 - (0.4 * missing / (rows * 5) * 100 + 0.3 * imputed / (rows * 5) * 100), 1) AS quality_clean FROM t""")
def cl24(spark, sf):
    m = rows(spark, sf).select(*_ROLES)
    return im.quality_clean(im.impute(m, im.imputation_stats(m, _ROLES).collect()), m.count() * 5)


@query("cl25_cleaning_log")
def cl25(spark, sf):
    return clean(messy(spark, sf)).report["log"].withColumn("affected_columns", F.array_join("affected_columns", ","))


@query("cl26_observed_view", f"WITH {R} SELECT order_id, priority, quantity, salary, age::DOUBLE AS age FROM m")
def cl26(spark, sf):
    m = rows(spark, sf).select(*_ROLES)
    return im.impute(m, im.imputation_stats(m, _ROLES).collect()).observed()


# The whole cleaner, step by step in SQL.
CLEAN_SQL = f"""{M}, {_COUNTS}, {_CANON},
d AS (SELECT DISTINCT order_id, customer_id, order_date, p.canonical AS priority, unit_price, quantity, salary, age, visits, h.canonical AS churned, notes, source FROM m
 LEFT JOIN k p ON p."column" = 'priority' AND p.key = lower(regexp_replace(trim(priority), '\\s+', ' ', 'g'))
 LEFT JOIN k h ON h."column" = 'churned' AND h.key = lower(regexp_replace(trim(churned), '\\s+', ' ', 'g'))),
ty AS (SELECT order_id, customer_id, {DATE_SQL.format(c='order_date')} AS order_date, priority,
 CASE WHEN {_NUM.format(c='unit_price')} >= 0 THEN {_NUM.format(c='unit_price')} END AS unit_price, CASE WHEN quantity <> 999 THEN quantity END AS quantity,
 CASE WHEN salary >= 0 THEN salary END AS salary, CASE WHEN age BETWEEN 0 AND 100 THEN age END AS age, visits, churned FROM d),
fl AS (SELECT {', '.join(f'{_FILL.format(c=c)} AS f_{c}' for c in ['unit_price', 'quantity', 'salary', 'age'])} FROM ty)"""


@query("cl27_clean_table", f"""WITH {CLEAN_SQL} SELECT order_id, customer_id, order_date, priority, visits, churned,
 {', '.join(f'round(coalesce({c}, f_{c}), 2) AS {c}, {c} IS NULL AS _imputed_{c}' for c in ['unit_price', 'quantity', 'salary', 'age'])} FROM ty, fl""")
def cl27(spark, sf):
    ds = clean(messy(spark, sf))
    return ds.df.withColumns({c: F.round(c, 2) for c in ["unit_price", "quantity", "salary", "age"]}).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query("cl27_clean_findings", f"""WITH {M}, d AS (SELECT DISTINCT * FROM m)
SELECT 'quantity' AS "column", 'returns' AS kind, count(*) AS count FROM d WHERE quantity < 0 UNION ALL SELECT 'salary', 'invalid', count(*) FROM d WHERE salary < 0
UNION ALL SELECT 'age', 'invalid', count(*) FROM d WHERE age > 100 UNION ALL SELECT 'quantity', 'sentinel', count(*) FROM d WHERE quantity = 999
UNION ALL SELECT 'visits', 'extreme', count(*) FROM d WHERE visits = 400""")
def cl27_findings(spark, sf):
    return clean(messy(spark, sf), CleaningOptions()).report["findings"].select("column", "kind", "count")
