"""IO-* and SM-*: files and streams that Spark derives from the given tables."""

from pyspark.sql import functions as F

from tidemark.operators import sets as st
from tidemark.plans.clean import clean
from tidemark.session import materialize, scratch_path
from tidemark.sources import catalog as ca, readers as rd, store as so
from tidemark.streaming import events as sm
from workload.cleaning import CLEAN_SQL
from workload.fixtures import messy
from workload.registry import query, table
from workload.relational import _PARTIES, derived, parties

_ORDERS = "SELECT CAST(o_orderkey AS STRING) AS order_key, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'a \"quoted\", value' ELSE o_orderpriority END AS priority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price FROM orders"


def csv_files(spark, sf, sep, compression="none"):
    out = scratch_path(spark, "csv")
    d = derived(spark, sf, _ORDERS)
    d = d.select("order_key", F.coalesce("priority", F.lit("N/A")).alias("priority"), "price")
    d.write.option("header", True).option("sep", sep).option("escape", '"').option("compression", compression).csv(out)
    return out


@query("io01_read_delimited", _ORDERS)
def io01(spark, sf):
    return rd.read_delimited(spark, csv_files(spark, sf, "|"))


@query("io01_read_tab_delimited", _ORDERS)
def io01_tab(spark, sf):
    return rd.read_delimited(spark, csv_files(spark, sf, "\t"))


@query("io02_read_latin1", "SELECT doc_id::VARCHAR AS doc_id, 'Déjà-vu ' || lang AS label FROM documents")
def io02(spark, sf):
    out = scratch_path(spark, "latin1")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Déjà-vu "), F.col("lang")).alias("label"))
    d.write.option("header", True).option("encoding", "ISO-8859-1").csv(out)
    return rd.read_delimited(spark, out)


def json_documents(spark, sf, body):
    """One JSON document per 100 suppliers, each in a file of its own."""
    out = scratch_path(spark, "json")
    s = table(spark, sf, "supplier")
    rec = F.struct("s_suppkey", "s_name", F.struct("s_nationkey", "s_acctbal").alias("at"))
    g = s.groupBy(F.floor(F.col("s_suppkey") / 100).alias("part")).agg(F.collect_list(rec).alias("rows"), F.collect_list("s_name").alias("names"))
    g.select(body(g).alias("value")).write.option("maxRecordsPerFile", 1).text(out)
    return out


_SUPP = "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS \"at.s_nationkey\", s_acctbal AS \"at.s_acctbal\" FROM supplier"


@query("io03_read_json_array", _SUPP)
def io03(spark, sf):
    return rd.read_json(spark, json_documents(spark, sf, lambda g: F.to_json("rows")))


@query("io03_read_json_scalars", "SELECT s_name AS value FROM supplier")
def io03_scalars(spark, sf):
    return rd.read_json(spark, json_documents(spark, sf, lambda g: F.to_json("names")))


@query("io04_read_json_container", _SUPP)
def io04(spark, sf):
    return rd.read_json(spark, json_documents(spark, sf, lambda g: F.to_json(F.struct(F.col("part").alias("page"), F.col("rows").alias("results")))))


@query("io05_flatten", "SELECT event_id, event_type, (props::JSON->>'k')::BIGINT AS \"props.k\" FROM events")
def io05(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return rd.flatten(e)


@query("io06_read_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def io06(spark, sf):
    out = scratch_path(spark, "jsonl")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(out)
    return rd.read_json_lines(spark, out)


@query("io07_read_xml", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io07(spark, sf):
    out = scratch_path(spark, "xml")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(out)
    return rd.read_xml(spark, out, "supplier")


@query("io08_read_parquet", "SELECT * FROM part")
def io08(spark, sf):
    return rd.read_parquet(spark, f"{sf}/part.parquet")


@query("io09_read_gzip", _ORDERS)
def io09(spark, sf):
    return rd.read_delimited(spark, csv_files(spark, sf, ";", "gzip"))


_LINES = r"""SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_number, unnest(l) AS text_content FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s]')) AS l FROM documents)"""
_FACTS = r"length(text_content)::INTEGER AS character_count, len(list_filter(regexp_split_to_array(text_content, '\s+'), lambda w: w <> ''))::INTEGER AS word_count"


@query("io10_text_lines", f"SELECT *, {_FACTS} FROM ({_LINES})")
def io10(spark, sf):
    return rd.text_lines(table(spark, sf, "documents"), "text", ["doc_id"])


@query("io10_read_text_lines", f"SELECT count(*) AS lines, sum(character_count)::BIGINT AS characters, sum(word_count)::BIGINT AS words FROM (SELECT *, {_FACTS} FROM ({_LINES}))")
def io10_files(spark, sf):
    out = scratch_path(spark, "text")
    table(spark, sf, "documents").select("text").write.text(out)
    d = rd.read_text_lines(spark, out)
    return d.agg(F.count_distinct("file", "line_number").alias("lines"), F.sum("character_count").alias("characters"), F.sum("word_count").alias("words"))


@query("io11_catalog_files")
def io11(spark, sf):
    out = scratch_path(spark, "files")
    s = table(spark, sf, "supplier")
    s.write.option("header", True).csv(f"{out}/a")
    s.write.json(f"{out}/b")
    s.write.parquet(f"{out}/c")
    s.write.option("compression", "gzip").csv(f"{out}/d")
    table(spark, sf, "pages").select("html").write.text(f"{out}/e")
    return ca.catalog_files(spark, out).groupBy("extension", "format", "is_tabular", "status").agg(F.count("*").alias("files"))


_FILES = """SELECT 'file_' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 9 WHEN 0 THEN '.CSV' WHEN 1 THEN '.exe' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.xlsm' WHEN 4 THEN '.parquet' WHEN 5 THEN '.png' WHEN 6 THEN '.json' WHEN 7 THEN '.js' ELSE '' END AS file_name,
 CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey * 7000 END AS length, CASE o_orderkey % 5 WHEN 0 THEN '504B0304' WHEN 1 THEN '312C320A' WHEN 2 THEN '50415231' WHEN 3 THEN '5B7B7D5D' ELSE '0001' END AS head FROM orders"""
_EXT = "lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1))"
_FORMAT = """CASE WHEN head = '504B0304' THEN CASE WHEN extension IN ('xlsx', 'xlsm') THEN 'excel' ELSE 'zip' END WHEN extension = 'parquet' OR head = '50415231' THEN 'parquet'
 WHEN extension = 'json' OR head = '5B7B7D5D' THEN 'json' WHEN extension = 'png' THEN 'media' WHEN extension = 'csv' THEN 'csv' WHEN head = '0001' THEN 'binary' ELSE 'csv' END"""


@query("io11_classify_files", f"SELECT file_name, format, format IN ('csv', 'json', 'parquet') AS is_tabular FROM (SELECT *, {_FORMAT} AS format FROM (SELECT *, {_EXT} AS extension FROM ({_FILES})))")
def io11_classify(spark, sf):
    return ca.classify_files(derived(spark, sf, _FILES)).select("file_name", "format", "is_tabular")


@query("io12_sanitize_headers", 'SELECT n_nationkey AS key, n_name AS key_1, n_regionkey AS col_2 FROM nation')
def io12(spark, sf):
    return rd.sanitize_headers(table(spark, sf, "nation").toDF(" key", "key ", "  "))


@query("io13_accept_files", f"""SELECT file_name, CASE WHEN length = 0 THEN 'empty file' WHEN extension IN ('exe', 'js') THEN 'executable' WHEN length > 52428800 THEN 'too large'
 WHEN extension IN ('xlsx', 'xlsm') AND head <> '504B0304' THEN 'content does not match extension' END AS reject_reason FROM (SELECT *, {_EXT} AS extension FROM ({_FILES}))""")
def io13(spark, sf):
    return ca.accept_files(ca.classify_files(derived(spark, sf, _FILES)), 50 * 1024 * 1024).select("file_name", "reject_reason")


_CLEAN_TOTALS = "SELECT count(*) AS rows, count(*) FILTER (quantity IS NULL) AS imputed_quantity, round(sum(coalesce(quantity, f_quantity)), 1) AS quantity FROM ty, fl"


def _totals(ds):
    return ds.df.agg(F.count("*").alias("rows"), F.count_if("_imputed_quantity").alias("imputed_quantity"), F.round(F.sum("quantity"), 1).alias("quantity"))


@query("io14_write_clean", f"WITH {CLEAN_SQL} {_CLEAN_TOTALS}")
def io14(spark, sf):
    path = so.write_clean(clean(messy(spark, sf)), scratch_path(spark, "clean"))
    return _totals(so.read_clean(spark, path))


@query("io15_load_or_clean", f"WITH {CLEAN_SQL} {_CLEAN_TOTALS}")
def io15(spark, sf):
    messy(spark, sf).createOrReplaceTempView("messy_orders")
    store = scratch_path(spark, "store")
    so.load_or_clean(spark, "messy_orders", store)
    return _totals(so.load_or_clean(spark, "messy_orders", store))


@query("io16_preview", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total_rows FROM customer ORDER BY c_custkey LIMIT 25")
def io16(spark, sf):
    return rd.preview(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], 25)


@query("io17_combine_same", _PARTIES.replace("source_table", "_sheet"))
def io17(spark, sf):
    return st.combine_tables(parties(spark, sf))


@query("io17_combine_largest", "SELECT * FROM customer")
def io17_largest(spark, sf):
    return st.combine_tables({t: table(spark, sf, t) for t in ("nation", "supplier", "customer")})


@query("sm01_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS recent,
 count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 >= 5 AS is_limited FROM events""")
def sm01(spark, sf):
    return sm.rate_limit_flags(table(spark, sf, "events"), "event_type", "ts", 5, 3600).select("event_id", "recent", "is_limited")


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("sm01_rate_limit_windows", """WITH w AS (SELECT event_type, unnest([0, 1, 2, 3, 4, 5]) AS k, ts FROM events), b AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 600) * 600 - k * 600)::TIMESTAMP AS start FROM w)
SELECT start, event_type, count(*) AS events, count(*) >= 5 AS is_limited FROM b GROUP BY 1, 2""")
def sm01_stream(spark, sf):
    out = sm.drain(sm.rate_limit_windows(event_stream(spark, sf), "event_type", "ts", 5, "1 hour", "10 minutes"), "update", "limits")
    return sm.newest(out, ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", "is_limited")


@query("sm02_quality_monitor", """SELECT ts::DATE::TIMESTAMP AS start, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (value < 0) AS negatives, count(*) FILTER (value < 1 OR value > 30) AS fence_violations, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def sm02(spark, sf):
    out = sm.drain(sm.quality_monitor(event_stream(spark, sf), "ts", "value", 1.0, 30.0), "update", "monitor")
    return sm.newest(out, ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


_RAW = """SELECT o_orderkey AS id, ' ' || o_orderpriority || ' ' AS label, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS price, CAST(CASE WHEN o_orderkey % 8 = 0 THEN 150 ELSE 20 + o_orderkey % 60 END AS INT) AS age FROM orders"""


@query("sm03_stream_clean", f"SELECT id, trim(label) AS label, coalesce(replace(price, '$', '')::DOUBLE, 1.5) AS price, CASE WHEN age <= 100 THEN age END AS age, price IS NULL AS _imputed_price FROM ({_RAW})")
def sm03(spark, sf):
    src, sink = scratch_path(spark, "raw"), scratch_path(spark, "cleaned")
    raw = derived(spark, sf, _RAW)
    raw.write.parquet(src)
    sm.stream_clean(spark.readStream.schema(raw.schema).parquet(src), sm.StreamRules(["price"], ["price"], {"price": 1.5}), sink)
    return spark.read.option("basePath", f"{sink}/data").parquet(f"{sink}/data").drop("batch")


@query("sm04_stream_dedupe", "SELECT event_id, ts, value FROM events")
def sm04(spark, sf):
    src = scratch_path(spark, "repeats")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.unionByName(e).write.parquet(src)
    out = sm.drain(sm.stream_dedupe(spark.readStream.schema(e.schema).parquet(src), ["event_id"], "ts", "40 days"), "append", "dedupe")
    return out.drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Ten batches of three days; a key is met at most once in each. Keys stay known for five
# days past the watermark, which follows one batch behind: after a row of bucket b its
# repeats up to bucket b + 5 are dropped, one of bucket b + 6 passes. Rows of bucket 0
# that come again with batch 8 are late.
_BUCKET = "floor(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) / 3)::INTEGER"


@query("sm04_state_across_batches", f"""WITH e AS (SELECT DISTINCT user_id * 20 + event_id % 20 AS k, {_BUCKET} AS b FROM events),
 one AS (SELECT k, min(b) AS b FROM e GROUP BY k), two AS (SELECT e.k, min(e.b) AS b FROM e JOIN one o ON e.k = o.k AND e.b >= o.b + 6 GROUP BY e.k)
 SELECT k, b, TIMESTAMP '2024-01-01' + to_days(3 * b) AS ts, b::BIGINT AS batch FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""")
def sm04_batches(spark, sf):
    src = scratch_path(spark, "batches")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = table(spark, sf, "events").select((F.col("user_id") * 20 + F.col("event_id") % 20).alias("k"), F.floor(day / 3).cast("int").alias("b")).distinct()
    e = materialize(e.withColumn("ts", F.timestamp_add("DAY", 3 * F.col("b"), F.lit("2024-01-01").cast("timestamp"))), "buckets")
    for b in range(10):  # one file a batch, in the order they are written
        late = F.lit(b == 8) & (F.col("b") == 0)
        e.filter((F.col("b") == b) | late).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = sm.drain(sm.stream_dedupe(stream, ["k"], "ts", "5 days"), "append", "dedupe")
    return out.select("k", "b", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("batch").cast("long").alias("batch"))
