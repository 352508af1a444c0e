"""AN-20, AN-21, IN-12..15, UF-01: whole analyses."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profiling import profile_columns
from tidemark.plans import analyze as az
from tidemark.registry import OPERATORS, run_tool, tool_statuses
from workload.analysis import LINE_NUMS
from workload.cleaning import R
from workload.fixtures import messy
from workload.registry import query, table
from workload.relational import FILLED, imputed


@query("an20_tool_statuses", """SELECT 0 AS position, 'segment_compare' AS tool, 'success' AS status UNION ALL SELECT 1, 'segment_compare', 'error' UNION ALL SELECT 2, 'segment_compare', CASE WHEN count(DISTINCT o_custkey) > 30 THEN 'error' ELSE 'success' END FROM orders
UNION ALL SELECT 3, 'trend_analysis', 'success' UNION ALL SELECT 4, 'run_correlation', 'skipped' UNION ALL SELECT 5, 'query_sql', 'error' UNION ALL SELECT 6, 'make_coffee', 'error'""")
def an20(spark, sf):
    o = az.as_dataset(table(spark, sf, "orders"))
    runs = [
        run_tool("segment_compare", o, segment="o_orderpriority", metric="o_totalprice"), run_tool("segment_compare", o, segment="nothing", metric="o_totalprice"),
        run_tool("segment_compare", o, segment="o_custkey", metric="o_totalprice"), run_tool("trend_analysis", o, date="o_orderdate", value="o_totalprice"),
        run_tool("run_correlation", o, columns=["o_orderstatus"]), run_tool("query_sql", o, sql="DROP TABLE df"), run_tool("make_coffee", o),
    ]
    return tool_statuses(runs, o.df).drop("message")


@query("an21_row_accounting", f"""WITH {FILLED}, u AS (SELECT count(*) AS total, count(*) FILTER (quantity IS NOT NULL AND salary IS NOT NULL AND age IS NOT NULL) AS full_rows, count(*) FILTER (salary IS NOT NULL AND priority IS NOT NULL) AS seg FROM m)
SELECT 'detect_outliers' AS tool, full_rows AS n_used, total - full_rows AS n_excluded, total AS total_records FROM u UNION ALL SELECT 'run_correlation', full_rows, total - full_rows, total FROM u UNION ALL SELECT 'segment_compare', seg, total - seg, total FROM u""")
def an21(spark, sf):
    ds = imputed(spark, sf)
    nums = ["quantity", "salary", "age"]
    runs = [run_tool("detect_outliers", ds, columns=nums), run_tool("run_correlation", ds, columns=nums), run_tool("segment_compare", ds, segment="priority", metric="salary")]
    return reduce(DataFrame.unionByName, [r.summary.select(F.lit(r.tool).alias("tool"), "n_used", "n_excluded", "total_records") for r in runs])


def orders_and_lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_NUMS, "l_returnflag", "l_linestatus", "l_shipdate")


@query("in12_baseline_scan", """SELECT 'detect_outliers' AS tool, NULL AS segment, NULL AS metric, count(*) AS n_used FROM lineitem UNION ALL SELECT 'run_correlation', NULL, NULL, count(*) FROM lineitem
UNION ALL SELECT 'segment_compare', s, m, (SELECT count(*) FROM lineitem) FROM (VALUES ('l_returnflag'), ('l_linestatus')) a(s), (VALUES ('l_quantity'), ('l_extendedprice')) b(m)""")
def in12(spark, sf):
    runs = az.baseline_scan(orders_and_lines(spark, sf))
    cell = lambda r, k: F.lit(r.params.get(k)).cast("string").alias(k)
    return reduce(DataFrame.unionByName, [r.summary.select(F.lit(r.tool).alias("tool"), cell(r, "segment"), cell(r, "metric"), "n_used") for r in runs])


@query("in13_plan", """SELECT 1 AS position, 'detect_outliers' AS tool, 'l_quantity,l_extendedprice,l_discount,l_tax' AS target, (SELECT count(*) FROM lineitem) AS row_count UNION ALL SELECT 2, 'run_correlation', 'l_quantity,l_extendedprice,l_discount,l_tax', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 3, 'segment_compare', 'l_returnflag,l_quantity', (SELECT count(*) FROM lineitem) UNION ALL SELECT 4, 'trend_analysis', 'l_shipdate,l_quantity', (SELECT count(*) FROM lineitem)""")
def in13(spark, sf):
    rows = profile_columns(orders_and_lines(spark, sf)).collect()
    def target(s):
        return ",".join(s.args["columns"] if "columns" in s.args else [s.args.get("segment") or s.args.get("date"), s.args.get("metric") or s.args.get("value")])
    data = [(i, s.tool, target(s), rows[0]["rows"]) for i, s in enumerate(az.plan(rows), 1)]
    return spark.createDataFrame(data, "position int, tool string, target string, row_count bigint")


@query("in14_segment_drilldown", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def in14(spark, sf):
    return az.segment_drilldown(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("in14_value_frequencies", "SELECT l_quantity, count(*) AS frequency FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def in14_values(spark, sf):
    return az.value_frequencies(table(spark, sf, "lineitem"), "l_quantity")


@query("in14_pair_means", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 2) AS avg_l_quantity, round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def in14_pairs(spark, sf):
    return az.pair_means(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query("in14_triggers")
def in14_triggers(spark, sf):
    m = messy(spark, sf).select("priority", "churned", "quantity", "salary", (F.col("salary") * 2 + F.col("age")).alias("income"))
    rows = profile_columns(m).collect()
    follow = az.drilldowns(m, az.baseline_scan(m, rows), rows)
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("rows")).select(F.lit(reason).alias("reason"), "rows") for reason, d in follow])


@query("in15_auto_analyze")
def in15(spark, sf):
    a = az.auto_analyze(messy(spark, sf))
    return a.insights.drop("metrics").withColumn("caveats", F.array_join("caveats", "|"))


@query("uf01_registry", f"WITH {R} SELECT 'query_sql' AS tool, count(*) AS n, (SELECT count(*) FROM m WHERE salary IS NULL) AS missing FROM m")
def uf01(spark, sf):
    ds = imputed(spark, sf)
    r = run_tool("query_sql", ds, sql="SELECT count(*) AS n, count(*) - count(salary) AS missing FROM data_observed")
    assert set(OPERATORS) == {"profile_dataset", "run_correlation", "detect_outliers", "segment_compare", "trend_analysis", "query_sql", "generate_chart", "write_summary"}
    return r.summary.select(F.lit(r.tool).alias("tool"), "n", "missing")
