"""TX-*: numbers, claims and phrases in documents and narratives."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import statpool as sp, verify as vf
from workload import fixtures_text as fx
from workload.registry import query, table
from workload.relational import derived

_D = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"
# One narrative per customer: right and wrong numbers, dates, codes, phrases.
NARRATIVES = f"""SELECT o_custkey AS doc_id, 'Customer placed ' || CAST(count(*) AS STRING) || ' orders. Revenue was $' || {_D.format('sum(o_totalprice)')} || ' in step 3.'
 || CASE o_custkey % 4 WHEN 0 THEN ' An unrelated figure of 777.25 drives growth!' WHEN 1 THEN ' On 2023-04-05 invoice INV-' || CAST(o_custkey AS STRING) || ' left no effect.' WHEN 2 THEN ' Sales are stable because of 12% off, or 1,250.5 units.' ELSE '' END
 || ' The largest is ' || {_D.format('max(o_totalprice)')} || '?' AS text FROM orders GROUP BY o_custkey"""
# Claims about those narratives: (claim_id, doc_id, source_id, metric_key, value).
NARRATIVE_VALUES = """SELECT o_custkey AS doc_id, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey"""

# Plain ASCII word characters for an engine whose \\b knows no other letters.
_ASCII = r"regexp_replace(regexp_replace({t}, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def numbers_sql(t):
    s = _ASCII.format(t=t)
    for p in (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b[A-Za-z0-9]+-\d+\b"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    s = f"regexp_replace({s}, '(^|[.!?\\n])\\s*\\(?\\d+\\)?[.\\-:]\\s+', '\\1 ', 'g')"
    s = f"regexp_replace({s}, '(?i)\\b(?:step|round|stage|source|insight|item|phase)\\s+\\d+\\b', ' ', 'g')"
    s = f"regexp_extract_all({s}, '[-+]?\\$?\\b(?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?%?\\b')"
    s = f"list_transform({s}, lambda r: regexp_replace(r, '[$%,]', '', 'g')::DOUBLE)"
    return f"list_filter({s}, lambda v: v NOT IN (2020, 2021, 2022, 2023, 2024, 2025, 2026))"


def exploded(keys, lst, src, value="number"):
    return f"SELECT {keys}, (generate_subscripts(l, 1) - 1)::INTEGER AS position, unnest(l) AS {value} FROM (SELECT {keys}, {lst} AS l FROM {src})"


@query("tx01_extract_numbers", exploded("doc_id", numbers_sql("text"), "documents"))
def tx01(spark, sf):
    return vf.extract_numbers(table(spark, sf, "documents"), "text", ["doc_id"])


@query("tx01_narrative_numbers", exploded("doc_id", numbers_sql("text"), f"({NARRATIVES})"))
def tx01_narratives(spark, sf):
    return vf.extract_numbers(derived(spark, sf, NARRATIVES), "text", ["doc_id"])


# Separators are doubled so that one can close a token and open the next; commas
# inside numbers are set aside before.
def plain_sql(t):
    s = t
    for _ in range(2):
        s = f"regexp_replace({s}, '(\\d),(\\d{{3}})', '\\1' || chr(2) || '\\2', 'g')"
    s = f"regexp_replace({s}, '([^\\w.\\-\\x02])', '\\1\\1', 'g')"
    s = f"regexp_extract_all({s}, '(?:^|[^\\w.\\-])(-?\\d{{1,3}}(?:\\x02\\d{{3}})*(?:\\.\\d+)?|-?\\d+\\.\\d+)(?:\\W|$)', 1)"
    return f"list_transform({s}, lambda x: replace(x, chr(2), ','))"


@query("tx01_plain_numbers", exploded("doc_id", f"list_transform({plain_sql('regexp_replace(' + _ASCII.format(t='text') + ', ' + chr(39) + r'\b\d{4}-\d{2}-\d{2}\b' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda r: replace(r, ',', '')::DOUBLE)", "documents"))
def tx01_plain(spark, sf):
    return vf.extract_numbers(table(spark, sf, "documents"), "text", ["doc_id"], plain=True)


@query("tx02_metric_index", """SELECT 'supplier ' || s_suppkey AS source_id, unnest(['accountbalance', 'nationkey2']) AS metric_key, unnest([s_acctbal, s_nationkey::DOUBLE]) AS value FROM supplier
UNION ALL SELECT 'order ' || o_orderkey, 'totalprice', o_totalprice FROM orders""")
def tx02(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier "), F.col("s_suppkey")).alias("id"),
        F.create_map(F.lit("Account Balance"), F.col("s_acctbal"), F.lit("Nation-Key 2"), F.col("s_nationkey").cast("double")).alias("m"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey")).alias("id"), F.create_map(F.lit("Total_Price"), F.col("o_totalprice")).alias("m"))
    return vf.metric_index(s.unionByName(o), "id", "m")


_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_CLAIM_SQL = f"""c AS (SELECT *, CASE metric_key WHEN 'profit' THEN 'price' ELSE {_NORM.format('metric_key')} END AS k FROM ({fx.CLAIMS})),
s AS (SELECT source_id, {_NORM.format('metric_key')} AS k, value FROM ({fx.METRICS})),
x AS (SELECT c.claim_id, c.source_id, c.k AS metric_key, c.value, (SELECT max(value) FROM s WHERE s.source_id = c.source_id AND s.k = c.k) AS ex,
 EXISTS (SELECT 1 FROM s WHERE s.source_id = c.source_id) AS src,
 EXISTS (SELECT 1 FROM s WHERE s.source_id = c.source_id AND (contains(s.k, c.k) OR contains(c.k, s.k)) AND (abs(c.value - s.value) / greatest(1e-9, abs(s.value)) <= 0.05 OR abs(c.value - s.value) <= 0.05)) AS near FROM c)
SELECT claim_id, source_id, metric_key, CASE WHEN NOT src THEN 'source_missing' WHEN ex IS NOT NULL THEN CASE WHEN abs(value - ex) / greatest(1e-9, abs(ex)) <= 0.05 OR abs(value - ex) <= 0.05 THEN 'verified' ELSE 'mismatch' END
 WHEN near THEN 'verified' ELSE 'metric_missing' END AS status,
 CASE WHEN NOT src THEN 'there is no such source' WHEN ex IS NOT NULL THEN CASE WHEN abs(value - ex) / greatest(1e-9, abs(ex)) <= 0.05 OR abs(value - ex) <= 0.05 THEN 'the metric has this value' ELSE 'the metric has another value' END
 WHEN near THEN 'a metric of a related name has this value' ELSE 'the source has no such metric' END AS reason FROM x"""


@query("tx03_verify_claims", f"WITH {_CLAIM_SQL}")
def tx03(spark, sf):
    claims = derived(spark, sf, fx.CLAIMS).withColumn("metric_key", F.when(F.col("metric_key") == "profit", "price").otherwise(tx.normalize_key(F.col("metric_key"))))
    metrics = derived(spark, sf, fx.METRICS).withColumn("metric_key", tx.normalize_key(F.col("metric_key")))
    return vf.verify_claims(claims, metrics).select("claim_id", "source_id", "metric_key", "status", "reason")


_NUMS = f"nums AS ({exploded('doc_id', numbers_sql('text'), f'({NARRATIVES})')})"
_VER = f"""{_NUMS}, vals AS ({NARRATIVE_VALUES}), forms AS (SELECT doc_id, unnest([round(value, 2), round(value, 1), round(value, 4), trunc(value)]) AS value FROM vals),
ok AS (SELECT doc_id, position, number, EXISTS (SELECT 1 FROM forms f WHERE f.doc_id = nums.doc_id AND (round(number, 2) = f.value OR round(number, 1) = f.value OR trunc(number) = f.value
 OR (abs(f.value) > 0 AND abs(number - f.value) / abs(f.value) <= 0.05))) AS is_verified FROM nums)"""


def _verified(spark, sf):
    docs = derived(spark, sf, NARRATIVES)
    nums = vf.extract_numbers(docs, "text", ["doc_id"])
    return docs, vf.verify_numbers(nums, derived(spark, sf, NARRATIVE_VALUES), ["doc_id"])


@query("tx03_verify_numbers", f"WITH {_VER} SELECT doc_id, position, number, is_verified FROM ok")
def tx03_numbers(spark, sf):
    return _verified(spark, sf)[1].select("doc_id", "position", "number", "is_verified")


# The same with a null key, null texts and claims that have a wording.
_DOCS = f"SELECT nullif(doc_id, 5) AS doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text FROM ({NARRATIVES})"
_VALUES = f"SELECT nullif(doc_id, 5) AS doc_id, value FROM ({NARRATIVE_VALUES})"
_WORDED = f"""SELECT doc_id, 'c' AS claim_id, value, CASE WHEN value > 5000 THEN 'verified' ELSE 'mismatch' END AS status,
 CASE doc_id % 4 WHEN 0 THEN 'An unrelated FIGURE' WHEN 1 THEN 'Orders were placed by this customer' WHEN 2 THEN 'stable' ELSE 'Revenue, customer and orders' END AS text FROM ({_VALUES})"""
_VER_NULLS = _VER.replace(NARRATIVES, _DOCS).replace(NARRATIVE_VALUES, _VALUES).replace("f.doc_id = nums.doc_id", "f.doc_id IS NOT DISTINCT FROM nums.doc_id")
_STRIPPED = f"""{_VER_NULLS}, docs AS ({_DOCS}), claimed AS ({_WORDED}),
sent AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM docs WHERE text IS NOT NULL)),
bad AS (SELECT doc_id, pos, sentence, EXISTS (SELECT 1 FROM ok WHERE ok.doc_id IS NOT DISTINCT FROM sent.doc_id AND NOT is_verified AND list_contains(list_transform({numbers_sql('sentence')}, lambda v: round(v, 2)), round(ok.number, 2)))
 OR EXISTS (SELECT 1 FROM claimed c WHERE c.doc_id IS NOT DISTINCT FROM sent.doc_id AND status <> 'verified' AND length(c.text) > 10 AND contains(lower(sentence), lower(c.text))) AS is_bad FROM sent),
cleaned AS (SELECT docs.doc_id, CASE WHEN any_value(docs.text) IS NOT NULL THEN coalesce(string_agg(trim(sentence), ' ' ORDER BY pos) FILTER (NOT is_bad), '') END AS cleaned_text, count(*) FILTER (is_bad) AS sentences_dropped
 FROM docs LEFT JOIN bad ON bad.doc_id IS NOT DISTINCT FROM docs.doc_id GROUP BY 1)"""


def _verified_nulls(spark, sf):
    docs = derived(spark, sf, _DOCS)
    nums = vf.verify_numbers(vf.extract_numbers(docs, "text", ["doc_id"]), derived(spark, sf, _VALUES), ["doc_id"])
    return docs, nums, derived(spark, sf, _WORDED)


@query("tx04_strip_unverified", f"WITH {_STRIPPED} SELECT doc_id, cleaned_text, sentences_dropped FROM cleaned")
def tx04(spark, sf):
    docs, nums, claims = _verified_nulls(spark, sf)
    return vf.strip_unverified(docs, "text", "doc_id", nums.filter("not is_verified"), claims)


@query("tx05_verification_rates", f"""WITH {_STRIPPED}, w AS (SELECT c.*, lower(d.text) AS body, list_filter(regexp_extract_all(lower(c.text), '\\w+'), lambda x: length(x) > 3) AS ws FROM claimed c LEFT JOIN docs d ON d.doc_id IS NOT DISTINCT FROM c.doc_id),
cl AS (SELECT doc_id, value, status = 'verified' AS v, EXISTS (SELECT 1 FROM nums WHERE nums.doc_id IS NOT DISTINCT FROM w.doc_id AND (abs(number - value) < 1e-4 OR (abs(value) > 0 AND abs(number - value) / abs(value) <= 0.05)))
 OR coalesce(contains(body, lower(text)) OR (body IS NOT NULL AND len(ws) >= 2 AND len(list_filter(list_slice(ws, 1, 3), lambda x: NOT contains(body, x))) = 0), false) AS p FROM w),
n AS (SELECT doc_id, count(*) AS numbers, count(*) FILTER (is_verified) AS verified_numbers FROM ok GROUP BY 1),
c AS (SELECT doc_id, count(*) AS claims, count(*) FILTER (v) AS verified_claims, count(*) FILTER (p) AS present FROM cl GROUP BY 1),
l AS (SELECT doc_id, unnest({numbers_sql('cleaned_text')}) AS number FROM cleaned), a AS (SELECT doc_id, count(*) AS numbers_after,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc_id IS NOT DISTINCT FROM l.doc_id AND NOT is_verified AND round(ok.number, 2) = round(l.number, 2))) AS good FROM l GROUP BY 1)
SELECT c.doc_id, coalesce(numbers, 0) AS numbers, coalesce(verified_numbers, 0) AS verified_numbers, CASE WHEN numbers > 0 THEN round(verified_numbers / numbers * 100, 2) ELSE 100.0 END AS number_verification_rate,
 claims, verified_claims, round(present / claims * 100, 2) AS claim_presence_rate, coalesce(numbers_after, 0) AS numbers_after, CASE WHEN numbers_after > 0 THEN round(good / numbers_after * 100, 2) ELSE 100.0 END AS post_strip_rate,
 CASE WHEN coalesce(numbers, 0) = coalesce(verified_numbers, 0) AND claims = verified_claims AND claims = present THEN 'passed' ELSE 'flagged' END AS status
FROM c LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM c.doc_id LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM c.doc_id""")
def tx05(spark, sf):
    docs, nums, claims = _verified_nulls(spark, sf)
    cleaned = vf.strip_unverified(docs, "text", "doc_id", nums.filter("not is_verified"), claims)
    return vf.verification_rates(nums, claims, "doc_id", texts=docs, cleaned=cleaned)


def _replaced(t):
    for p, r in tx.FORBIDDEN_TERMS + tx.CAUSAL_TERMS:
        t = f"regexp_replace({t}, '(?i){p}', '{r}', 'g')"
    return t


def _violations(t):
    return " + ".join(f"regexp_matches(lower({t}), '{p}')::INTEGER" for p, _ in tx.FORBIDDEN_TERMS + tx.CAUSAL_TERMS)


@query("tx06_scrub_phrases", f"SELECT doc_id, ({_violations('text')})::INTEGER AS violations, trim({_replaced('text')}) AS scrubbed_text FROM ({NARRATIVES})")
def tx06(spark, sf):
    return vf.scrub_phrases(derived(spark, sf, NARRATIVES), "text").select("doc_id", "violations", "scrubbed_text")


@query("tx06_document_violations", f"SELECT doc_id, ({_violations('a')})::INTEGER AS violations FROM (SELECT doc_id, {_ASCII.format(t='text')} AS a FROM documents)")
def tx06_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.phrase_hits(F.col("text"))).alias("violations"))


_CTX = f"""sent AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS sentence_no, unnest(l) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ({NARRATIVES}))),
tok AS (SELECT doc_id, sentence_no, sentence, (generate_subscripts(l, 1) - 1)::INTEGER AS token_no, unnest(l) AS token FROM (SELECT *, {plain_sql('sentence')} AS l FROM sent)),
ctx AS (SELECT doc_id, sentence_no, token_no, token, replace(token, ',', '')::DOUBLE AS number,
 trim(substr(sentence, greatest(strpos(sentence, token) - 30, 1), least(strpos(sentence, token) + length(token) + 29, length(sentence)) - greatest(strpos(sentence, token) - 30, 1) + 1)) AS context FROM tok)"""


@query("tx07_number_context", f"WITH {_CTX} SELECT * FROM ctx")
def tx07(spark, sf):
    return vf.number_context(derived(spark, sf, NARRATIVES), "text", ["doc_id"]).drop("sentence")


_POOL8 = "SELECT avg(o_totalprice) AS value FROM orders GROUP BY o_orderpriority, o_orderstatus UNION ALL SELECT CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_custkey UNION ALL SELECT o_totalprice FROM orders"


@query("tx08_audit_numbers", f"""WITH {_CTX}, p AS (SELECT DISTINCT value FROM ({_POOL8})), d AS (SELECT DISTINCT number FROM ctx),
x AS (SELECT number, bool_or(number = value OR round(number, 2) = value OR round(number, 1) = value OR trunc(number) = value) AS exact,
 bool_or((abs(value) > 0 AND abs(number - value) / abs(value) <= 0.02) OR abs(number - value) <= 0.05) AS near FROM d, p GROUP BY 1)
SELECT doc_id, sentence_no, token_no, token, number, context, CASE WHEN exact THEN 'match' WHEN near THEN 'rounding' ELSE 'unverifiable' END AS result FROM ctx JOIN x USING (number)""")
def tx08(spark, sf):
    return vf.audit_numbers(derived(spark, sf, NARRATIVES), "text", ["doc_id"], derived(spark, sf, _POOL8)).drop("recomputed")


def _pool_numeric(c):
    q = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.5) AS m, quantile_cont({c}::DOUBLE, 0.75) AS b FROM lineitem)"
    out = lambda k: f"count(*) FILTER ({c} < a - {k} * (b - a) OR {c} > b + {k} * (b - a))::DOUBLE"
    names = [("mean", f"avg({c})"), ("median", "any_value(m)"), ("std", f"stddev_samp({c})"), ("sum", f"sum({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("q25", "any_value(a)"),
             ("q75", "any_value(b)"), ("iqr", "any_value(b - a)"), ("missing", f"(count(*) - count({c}))::DOUBLE"), ("missing_percent", f"(count(*) - count({c})) / count(*) * 100"),
             ("outliers_1.5", out(1.5)), ("outliers_1.5_percent", out(1.5) + " / count(*) * 100"), ("outliers_3.0", out(3.0)), ("outliers_3.0_percent", out(3.0) + " / count(*) * 100")]
    lst = ", ".join(f"'{c}.{n}'" for n, _ in names), ", ".join(f"({e})::DOUBLE" for _, e in names)
    return f"SELECT unnest([{lst[0]}]) AS metric, unnest([{lst[1]}]) AS value FROM lineitem, {q}"


_PN = ["l_quantity", "l_extendedprice"]
_POOL9 = " UNION ALL ".join(
    [_pool_numeric(c) for c in _PN]
    + ["SELECT 'rows', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'columns', 4.0"]
    + ["SELECT 'l_returnflag=' || l_returnflag || '.count', count(*)::DOUBLE FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_returnflag=' || l_returnflag || '.percent', count(*) / (SELECT count(*) FROM lineitem) * 100 FROM lineitem GROUP BY l_returnflag"]
    + [f"SELECT 'l_returnflag=' || l_returnflag || '.{c}.{n}', {e} FROM lineitem GROUP BY l_returnflag" for c in _PN for n, e in [("n", f"count({c})::DOUBLE"), ("mean", f"avg({c})"), ("median", f"quantile_cont({c}::DOUBLE, 0.5)")]]
    + ["SELECT 'l_shipdate.dates', count(DISTINCT l_shipdate)::DOUBLE FROM lineitem UNION ALL SELECT 'l_shipdate.months', count(DISTINCT date_trunc('month', l_shipdate))::DOUBLE FROM lineitem UNION ALL SELECT 'l_shipdate.years', count(DISTINCT year(l_shipdate))::DOUBLE FROM lineitem"]
    + [f"SELECT 'l_shipdate.{c}.' || k, v FROM (WITH d AS (SELECT l_shipdate AS ds, avg({c}) AS y FROM lineitem GROUP BY 1), p AS (SELECT last_day(ds) AS ds, avg(y) AS y FROM d GROUP BY 1) SELECT unnest(['periods', 'growth_percent']) AS k, unnest([count(*)::DOUBLE, (arg_max(y, ds) - arg_min(y, ds)) / abs(arg_min(y, ds)) * 100]) AS v FROM p)" for c in _PN]
    + [f"SELECT 'outliers_{k}.l_quantity+l_extendedprice' || s, v FROM (SELECT unnest(['', '_percent']) AS s, unnest([sum(value), sum(value) / (SELECT count(*) FROM lineitem) * 100]) AS v FROM ({' UNION ALL '.join(_pool_numeric(c) for c in _PN)}) WHERE metric LIKE '%.outliers_{k}')" for k in ("1.5", "3.0")])


@query("tx09_stat_pool", f"SELECT metric, round(value, 4) AS value FROM ({_POOL9})")
def tx09(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return sp.stat_pool(li).withColumn("value", F.round("value", 4))
