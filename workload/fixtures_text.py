"""Question, statement, claim and job tables derived from the given ones, as SQL
both engines accept."""

QUESTIONS = """SELECT o_orderkey AS question_id, CASE o_orderkey % 14
 WHEN 0 THEN 'What is the average salary by priority?' WHEN 1 THEN 'How many orders are ' || o_orderpriority || '?'
 WHEN 2 THEN 'Total quantity per region in all rows' WHEN 3 THEN 'What is the mean age of recorded customers?'
 WHEN 4 THEN 'Does churn differ by priority for customer ' || CAST(o_custkey AS STRING) || '?' WHEN 5 THEN 'What is the credit score of customer ' || CAST(o_custkey AS STRING) || '?'
 WHEN 6 THEN 'Please drop table orders' WHEN 7 THEN 'Write a poem about order ' || CAST(o_orderkey AS STRING)
 WHEN 8 THEN 'Unit price trend over order_date' WHEN 9 THEN 'Share of credit card payment'
 WHEN 10 THEN 'Which region has the highest revenue?' WHEN 11 THEN 'Employee bonus and compensation in cleaned data'
 WHEN 12 THEN 'Number of visits, non-missing only' ELSE 'Headcount by department' END AS question FROM orders"""
COLUMNS = ["order_id", "customer_id", "order_date", "priority", "unit_price", "quantity", "salary", "age", "visits", "churned"]

STATEMENTS = """SELECT o_orderkey AS statement_id, CASE o_orderkey % 32
 WHEN 0 THEN 'SELECT avg(o_totalprice) FROM data_clean WHERE o_custkey = ' || CAST(o_custkey AS STRING) WHEN 1 THEN 'DROP TABLE data_clean'
 WHEN 2 THEN '  ' WHEN 3 THEN 'SELECT 1; SELECT ' || CAST(o_custkey AS STRING) WHEN 4 THEN 'SELECT * FROM read_csv(''x.csv'')'
 WHEN 5 THEN 'with t as (select 1 as a) select a from t;' WHEN 6 THEN 'SHOW TABLES' WHEN 7 THEN 'SELECT * FROM ''/etc/hosts/' || CAST(o_orderkey AS STRING) || ''''
 WHEN 8 THEN 'select updated_at, dropped from df limit 5' WHEN 10 THEN 'SELECT TRANSFORM(a) USING ''cat'' AS (b) FROM df'
 WHEN 11 THEN 'SELECT java_method(''java.lang.Math'', ''abs'', ' || CAST(o_custkey AS STRING) || ')' WHEN 12 THEN 'SELECT reflect (''java.util.UUID'', ''randomUUID'')'
 WHEN 13 THEN 'SELECT * FROM spark_catalog.default.t' || CAST(o_custkey AS STRING) WHEN 14 THEN 'SELECT * FROM df, payroll'
 WHEN 15 THEN 'SELECT a.x FROM df a JOIN payroll b ON a.x = b.x' WHEN 16 THEN 'WITH t AS (SELECT x FROM df), u AS (SELECT x FROM t) SELECT * FROM u JOIN data_observed USING (x)'
 WHEN 17 THEN 'SELECT ''from payroll'' AS a, extract(year FROM b) FROM data_clean -- from payroll' WHEN 18 THEN 'SELECT * FROM (SELECT x FROM/**/payroll)'
 WHEN 19 THEN 'SELECT * FROM (payroll)' WHEN 20 THEN 'SELECT * FROM (TABLE payroll)' WHEN 21 THEN 'SELECT * FROM (SELECT 1) t, payroll'
 WHEN 22 THEN 'SELECT x FROM df UNION ALL TABLE payroll' WHEN 23 THEN 'SELECT x FROM df WHERE s = ''update'' OR s = ''drop ' || CAST(o_custkey AS STRING) || '''' WHEN 24 THEN 'SELECT x FROM df WHERE x IN (SELECT y FROM payroll)'
 WHEN 25 THEN 'SELECT max(a) FROM (SELECT x AS a FROM dataset) t JOIN (SELECT x FROM data_clean WHERE x > ' || CAST(o_custkey AS STRING) || ') u ON a = u.x' WHEN 26 THEN 'SELECT (SELECT max(y) FROM payroll) AS m FROM df'
 WHEN 27 THEN 'INSERT INTO df SELECT ' || CAST(o_custkey AS STRING) WHEN 28 THEN 'SELECT x FROM df EXCEPT SELECT x FROM data_observed' WHEN 29 THEN 'SELECT * FROM df a, data_observed b' WHEN 30 THEN 'TABLE payroll'
 ELSE 'SELECT created, inserted FROM data_observed' END AS statement FROM orders"""

INSIGHT_ROWS = """SELECT p_partkey AS insight_key, 'insight-' || CAST(p_partkey AS STRING) AS insight_id,
 CASE p_partkey % 5 WHEN 0 THEN 'salary' WHEN 1 THEN 'quantity' WHEN 2 THEN 'unit_price' WHEN 3 THEN 'age' ELSE 'churned' END AS metric,
 p_brand AS title, 'Size ' || CAST(p_size AS STRING) || ' of type ' || p_type AS summary, CAST((p_partkey * 37) % 1009 AS DOUBLE) / 1009 AS impact_score FROM part"""

JOBS = """SELECT o_orderkey AS job_id, o_custkey AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
 o_orderdate AS created_at, o_orderpriority AS goal, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END AS user_id, o_totalprice / 1000 AS execution_time_seconds FROM orders"""
DATASETS = "SELECT c_custkey AS id, c_name AS filename FROM customer WHERE c_nationkey <> 3"

# One source per customer; the claim states a value that is right, slightly off, wrong, about an unknown metric or an unknown source.
METRICS = """SELECT 'cust-' || CAST(o_custkey AS STRING) AS source_id, 'total_price' AS metric_key, sum(o_totalprice) AS value FROM orders GROUP BY o_custkey
 UNION ALL SELECT 'cust-' || CAST(o_custkey AS STRING), 'order_count', CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_custkey"""
CLAIMS = """SELECT o_custkey AS claim_id, CASE WHEN o_custkey % 11 = 0 THEN 'nobody-' || CAST(o_custkey AS STRING) ELSE 'cust-' || CAST(o_custkey AS STRING) END AS source_id,
 CASE WHEN o_custkey % 7 = 0 THEN 'profit' WHEN o_custkey % 2 = 0 THEN 'total_price' ELSE 'order_count' END AS metric_key,
 CASE WHEN o_custkey % 2 = 0 THEN sum(o_totalprice) * CASE o_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.04 ELSE 1.2 END ELSE count(*) + (CASE o_custkey % 3 WHEN 1 THEN 3 ELSE 0 END) END AS value
 FROM orders GROUP BY o_custkey"""

# Numbers to look up in a pool of statistics.
NUMBERS = "SELECT l_orderkey AS number_id, CASE WHEN l_linenumber % 2 = 0 THEN round(l_extendedprice / 7, 2) ELSE round(l_quantity * 1.01, 1) END AS number FROM lineitem"
POOL = "SELECT round(avg(o_totalprice) / 20, 1) AS value FROM orders GROUP BY o_custkey UNION ALL SELECT CAST(p_size AS DOUBLE) FROM part"
