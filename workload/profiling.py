"""PR-*: profiles of the messy orders, line items and customers."""

from pyspark.sql import functions as F

from tidemark.operators import profiling as pr
from workload.analysis import LINE_NUMS
from workload.cleaning import DATE_SQL, M, R
from workload.fixtures import MESSY_ROWS, messy
from workload.registry import query, table

COLS = ["order_id", "customer_id", "order_date", "priority", "unit_price", "quantity", "age", "churned", "notes"]
NUMERIC = {"order_id", "quantity", "age"}


def rows(spark, sf):
    return messy(spark, sf, MESSY_ROWS).select(*COLS)


def _type(c):
    if c in NUMERIC:
        return f"CASE WHEN count({c}) FILTER ({c} NOT IN (0, 1)) = 0 AND count(DISTINCT {c}) <= 2 THEN 'boolean' ELSE 'numeric' END"
    return (f"CASE WHEN count({c}) > 0 AND count({DATE_SQL.format(c=c)}) / count({c}) > 0.8 THEN 'datetime' "
            f"WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count(*) < 0.2 THEN 'categorical' ELSE 'text' END")


@query("pr01_infer_types", f"WITH {R} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_type(c)} AS inferred_type FROM m" for c in COLS))
def pr01(spark, sf):
    return pr.infer_types(rows(spark, sf))


_COUNT_SQL = f"WITH {R} " + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", {_type(c)} AS inferred_type, count(*) AS rows, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage, count(DISTINCT {c}) AS unique_count, "
    f"count(DISTINCT {c}) = count(*) AS is_unique, "
    f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM m WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values FROM m"
    for i, c in enumerate(COLS))


@query("pr02_column_counts", _COUNT_SQL)
def pr02(spark, sf):
    return pr.column_counts(rows(spark, sf)).withColumn("sample_values", F.array_join("sample_values", "|"))


def stats_sql(c, src):
    return f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(any_value(q2), 2) AS median,
 round(any_value(q1), 2) AS q25, round(any_value(q3), 2) AS q75, count(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS outliers_count
 FROM {src}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {src})"""


@query("pr03_numeric_stats", " UNION ALL ".join(stats_sql(c, "lineitem") for c in LINE_NUMS))
def pr03(spark, sf):
    return pr.numeric_stats(table(spark, sf, "lineitem"), LINE_NUMS)


@query("pr03_messy_stats", f"WITH {R} " + " UNION ALL ".join(stats_sql(c, "m") for c in ["quantity", "salary", "age", "visits"]))
def pr03_messy(spark, sf):
    return pr.numeric_stats(messy(spark, sf, MESSY_ROWS), ["quantity", "salary", "age", "visits"])


@query("pr04_top_values", f"WITH {R}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM m" for c in ["priority", "churned", "customer_id"])
       + """), g AS (SELECT "column", value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INTEGER AS rank FROM g)
 SELECT "column", rank, value, count, round(count / (SELECT count(*) FROM m) * 100, 2) AS percentage FROM r WHERE rank <= 5""")
def pr04(spark, sf):
    return pr.top_values(rows(spark, sf), ["priority", "churned", "customer_id"])


@query("pr05_date_stats", """SELECT 'ts' AS "column", min(ts) AS min_date, max(ts) AS max_date, floor(date_diff('second', min(ts), max(ts)) / 86400)::BIGINT AS timespan_days FROM events""")
def pr05(spark, sf):
    return pr.date_stats(table(spark, sf, "events"), ["ts"]).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_date", "max_date")})


_SMALL = ["priority", "unit_price", "age", "visits", "notes", "source"]
_WARN = f"""WITH {R}, o AS (SELECT * FROM ({stats_sql('age', 'm')} UNION ALL {stats_sql('visits', 'm')})), p AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, round((count(*) - count({c})) / count(*) * 100, 2) AS np, "
    + ("'numeric'" if c in ("age", "visits") else _type(c)) + " AS t FROM m" for c in _SMALL) + """)
SELECT "column", concat_ws('|', CASE WHEN np > 30 THEN 'Many nulls (' || np::VARCHAR || '% of rows)' END, CASE WHEN u = 1 THEN 'Only one value (constant column)' END,
 CASE WHEN t = 'categorical' AND u > 100 THEN 'Labels with many values (' || u || ' distinct values)' END,
 CASE WHEN outliers_count > 0 THEN outliers_count || ' value(s) beyond three interquartile ranges.' END) AS warnings FROM p LEFT JOIN o USING ("column")"""


@query("pr06_column_warnings", _WARN)
def pr06(spark, sf):
    p = pr.profile_columns(messy(spark, sf, MESSY_ROWS).select(*_SMALL))
    return p.select("column", F.array_join("warnings", "|").alias("warnings"))


@query("pr07_profile_dataset", f"""WITH {M}, s AS (SELECT {', '.join(_SMALL)} FROM m), {_WARN.split('WITH ' + R + ', ')[1].split(')' + chr(10) + 'SELECT "column"')[0].replace('FROM m', 'FROM s')}),
w AS (SELECT sum((np > 30)::INT + (u = 1)::INT + (t = 'categorical' AND u > 100)::INT + coalesce(outliers_count > 0, false)::INT) AS warnings FROM p LEFT JOIN o USING ("column")),
t AS (SELECT count(*) AS row_count, {' + '.join(f'count(*) - count({c})' for c in _SMALL)} AS missing_cells FROM s),
d AS (SELECT (SELECT count(*) FROM s) - count(*) AS duplicate_rows FROM (SELECT DISTINCT * FROM s)),
x AS (SELECT row_count, {len(_SMALL)}::BIGINT AS column_count, missing_cells, row_count * {len(_SMALL)} AS total_cells, duplicate_rows, warnings,
 round(missing_cells / (row_count * {len(_SMALL)}) * 100, 2) AS missing_percentage, round(duplicate_rows / row_count * 100, 2) AS duplicate_percentage FROM t, d, w)
SELECT row_count, column_count, missing_cells, total_cells, duplicate_rows, warnings::BIGINT AS column_warnings, missing_percentage, duplicate_percentage,
 greatest(0.0, round(100 - (0.7 * missing_percentage + duplicate_percentage + 1.5 * warnings), 1)) AS quality_score,
 concat_ws('|', CASE WHEN missing_percentage > 10 THEN 'More than a tenth of all cells are null: ' || missing_percentage::VARCHAR || '%.' END,
  CASE WHEN duplicate_rows > 0 THEN duplicate_rows || ' rows repeat others (' || duplicate_percentage::VARCHAR || '%).' END) AS warnings FROM x""")
def pr07(spark, sf):
    return pr.profile_dataset(messy(spark, sf).select(*_SMALL)).withColumn("warnings", F.array_join("warnings", "|"))


@query("pr08_estimated_bytes", """SELECT (count(*) * (8 + 8 + 8 + 8) + sum(octet_length(encode(o_orderstatus))) + sum(octet_length(encode(o_orderpriority))))::BIGINT AS estimated_bytes FROM orders""")
def pr08(spark, sf):
    return pr.estimated_bytes(table(spark, sf, "orders"))
