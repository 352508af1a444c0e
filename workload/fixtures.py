"""Deterministic messy tables over the given ones, as SQL both engines accept.

Noise is injected by key arithmetic: blanks, currency text, mixed date formats,
case and space variants, sentinels, negatives, impossible ages. The extra rows
of ``MESSY`` are exact copies: they add duplicates and leave no row out.
"""

from pyspark.sql import DataFrame, SparkSession

from workload.registry import table

MESSY_ROWS = """SELECT o_orderkey AS order_id,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'CUST-' || CAST(o_custkey AS STRING) END AS customer_id,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '-' || lpad(CAST(day(o_orderdate) AS STRING),2,'0')
      WHEN o_orderkey % 3 = 1 THEN lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '/' || lpad(CAST(day(o_orderdate) AS STRING),2,'0') || '/' || CAST(year(o_orderdate) AS STRING)
      ELSE lpad(CAST(day(o_orderdate) AS STRING),2,'0') || '-' || lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '-' || CAST(year(o_orderdate) AS STRING) END AS order_date,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 5 = 1 THEN '  ' || o_orderpriority || ' ' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS unit_price,
 CAST(CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 999.0 WHEN o_orderkey % 29 = 0 THEN -1.0 * (o_orderkey % 4 + 2) ELSE CAST(o_orderkey % 10 + 1 AS DOUBLE) END AS DOUBLE) AS quantity,
 CAST(CASE WHEN o_orderkey % 31 = 0 THEN -5000.0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE 40000.0 + (o_custkey % 100) * 1000 END AS DOUBLE) AS salary,
 CAST(CASE WHEN o_orderkey % 37 = 0 THEN 150 WHEN o_orderkey % 9 = 0 THEN NULL ELSE 20 + o_custkey % 45 END AS INT) AS age,
 CAST(CASE WHEN o_orderkey % 43 = 0 THEN 400 ELSE o_orderkey % 12 END AS INT) AS visits,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderkey % 2 = 0 THEN 'no' ELSE 'No' END AS churned,
 CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE NULL END AS notes,
 'const' AS source
FROM orders"""

MESSY = f"SELECT * FROM ({MESSY_ROWS}) a UNION ALL SELECT * FROM ({MESSY_ROWS}) b WHERE order_id % 50 = 0"


def messy(spark: SparkSession, sf_dir: str, sql: str = MESSY) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(sql)
