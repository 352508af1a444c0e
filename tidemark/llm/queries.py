"""The registered queries of the training-data operators, thin over the operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run
from tidemark.llm import ann, hard_negatives, kneser_ney, masked_lm, mixing, packing, page_text, prefix_trie, rules, simhash, suffix, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_best_fit_packing")
def op1(spark, sf_dir):
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, digest=zlib.crc32)
    return out.select("doc_id", "piece", "start", "length", F.col("digest").alias("ids_crc32"), "sequence_id", "offset")


@_query("op2_quality_classifier")
def op2(spark, sf_dir):
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_simhash_near_duplicates")
def op3(spark, sf_dir):
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op4_masked_lm_scoring")
def op4(spark, sf_dir):
    return masked_lm.score(_table(spark, sf_dir, "documents"))


@_query("op5_source_mixing")
def op5(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


@_query("op6_toxicity")
def op6(spark, sf_dir):
    out = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder() != 0)
    return out.select("doc_id", (_remainder() == 0).alias("held_out"), "score", "predicted")


_OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM p LEFT JOIN b USING (d)
"""


@_query("op7_warc_transactions", _OP7_SQL)
def op7(spark, sf_dir):
    payload = F.col("response.payload")
    digests = [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest")]
    # whole transactions; of the payload, what the query returns
    keep = ["capture_id", "page_id", "url", "response.record_type", "response.refers_to", "response.digest", *digests, "request", "metadata"]
    got = warc.round_trip(_table(spark, sf_dir, "pages"), keep=keep)
    # a revisit has the payload of the response that it names
    full = got.where("record_type = 'response'").select(F.col("capture_id").alias("held_in"), F.col("page_id").alias("held_by"), "payload_bytes", "payload_digest")
    each = got.select("page_id", "record_type", F.coalesce("refers_to", "capture_id").alias("held_in"))
    return each.join(full, "held_in").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("held_by")).alias("refers_to"),
    )


_OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM w LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines
    OR 10 * n_upper > 5 * n_letters OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept,
  ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (10 * n_dup_lines > 5 * n_lines)::INT
    + 16 * (10 * n_upper > 5 * n_letters)::INT + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT)::BIGINT AS failure_bits
FROM m
"""


@_query("op8_quality_rules", _OP8_SQL)
def op8(spark, sf_dir):
    led = rules.ledger(_table(spark, sf_dir, "documents"))
    bits = F.col("failure_bits")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(bits, "base")).alias("base_failed"), rules.passes(bits, "v1").alias("kept"), "failure_bits",
    )


@_query("op9_suffix_dedup")
def op9(spark, sf_dir):
    out = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.floor(F.size("spans") / 2).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query("op10_nearest_neighbours")
def op10(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query("op11_main_text")
def op11(spark, sf_dir):
    return page_text.extract(_table(spark, sf_dir, "pages"))


_OP12_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c::VARCHAR AS s FROM t GROUP BY c),
bits AS (SELECT c, list_transform(range(8 * length(s)), lambda k: (ascii(s[k // 8 + 1]) >> (k % 8)) & 1) AS bs FROM ids),
k AS (SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bs),
  lambda a, x: xor(a >> 1, 3988292384 * (xor(a, x) & 1)))) % 9 AS h FROM bits),
r AS (SELECT k.c, 0 AS part, i, role, text FROM k JOIN t ON t.c = k.b AND i < h UNION ALL SELECT k.c, 1, i, role, text FROM k JOIN t ON t.c = k.c AND i >= h),
o AS (SELECT c, row_number() OVER w AS d, strlen(text)::BIGINT AS bytes,
  md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i)),
p AS (SELECT *, lag(node, 1, 'root') OVER (PARTITION BY c ORDER BY d) AS parent, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS is_end FROM o),
n AS (SELECT node, d, min(parent) AS parent, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end) AS ends FROM p GROUP BY node, d
  UNION ALL SELECT 'root', 0, NULL, min(c), count(*), 0, (SELECT string_agg(c::VARCHAR, ',' ORDER BY c) FROM k WHERE c NOT IN (SELECT c FROM p)) FROM k HAVING count(*) > 0),
up AS (SELECT c, d, node FROM p UNION ALL SELECT c, 0, 'root' FROM k),
kids AS (SELECT parent, count(*) AS m FROM n GROUP BY parent),
below AS (SELECT up.node, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved, count(*) FILTER (kids.m IS NULL) AS leaves
  FROM n JOIN up ON up.c = n.c AND up.d <= n.d LEFT JOIN kids ON kids.parent = n.node GROUP BY up.node)
SELECT n.c AS conv_id, n.d AS depth, q.c AS parent_conv_id, n.n_convs, coalesce(kids.m, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN below ON below.node = n.node LEFT JOIN n q ON q.node = n.parent LEFT JOIN kids ON kids.parent = n.node
"""


@_query("op12_prefix_trie", _OP12_SQL)
def op12(spark, sf_dir):
    c = F.col("conv_id")
    turns = prefix_trie.turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.build(*prefix_trie.with_heads(turns, c - c % 5, F.crc32(c.cast("string")) % 9, 8))


_OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 3
"""


@_query("op13_hard_negatives", _OP13_SQL)
def op13(spark, sf_dir):
    rows, label = _table(spark, sf_dir, "embeddings"), F.col("label")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(relabelled, F.col("vec_id") % 50 == 0)


@_query("pipeline", ORACLE_SQL)
def pipeline(spark, sf_dir):
    return run(spark, sf_dir)
