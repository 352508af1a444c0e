import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.operators import insights as ins, questions as qu, sqlview as sq, verify as vf
from tidemark.sources import catalog as ca, readers as rd, store as so
from tidemark.streaming import events as sm


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, sep):
    f = tmp_path / "t.txt"
    f.write_text(f"id{sep}name{sep}score\n1{sep}Ann{sep}2.5\n2{sep}N/A{sep}3.5\n")
    d = rd.read_delimited(spark, str(f))
    assert d.columns == ["id", "name", "score"] and [tuple(r) for r in d.collect()] == [("1", "Ann", "2.5"), ("2", None, "3.5")]


def test_headers_quotes_and_gzip(spark, tmp_path):
    f = tmp_path / "t.csv.gz"
    with gzip.open(f, "wt") as h:
        h.write('a,a,,Unnamed: 3\n1,"x, ""y""",2,3\n')
    d = rd.read_delimited(spark, str(f))
    assert d.columns == ["a", "a_1", "col_2", "col_3"] and d.first()["a_1"] == 'x, "y"'


def test_latin1(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_bytes("name,city\nJosé,Köln\n".encode("latin1"))
    assert rd.read_delimited(spark, str(f)).first()[:] == ("José", "Köln")


def test_json_shapes(spark, tmp_path):
    def j(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)
    assert rd.read_json(spark, j("a.json", '[{"a":1,"b":{"c":2}},{"a":3,"b":{"c":4}}]')).columns == ["a", "b.c"]
    assert rd.read_json(spark, j("b.json", '{"meta":1,"items":[{"x":1,"y":2},{"x":3,"y":4}]}')).count() == 2
    assert [r["value"] for r in rd.read_json(spark, j("c.json", '["u","v"]')).collect()] == ["u", "v"]
    assert rd.read_json(spark, j("d.json", '{"k":{"z":1},"w":2}')).columns == ["k.z", "w"]
    assert rd.read_json_lines(spark, j("e.jsonl", '{"a":1}\n{"a":2}\n')).count() == 2


def test_xml(spark, tmp_path):
    f = tmp_path / "t.xml"
    f.write_text('<rows><row id="1"><n>a</n></row><row id="2"><n>b</n></row></rows>')
    assert rd.read_xml(spark, str(f), "row").count() == 2
    with pytest.raises(ValueError):
        rd.read_xml(spark, str(f), "n")


def test_text_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "  " for i in range(20_000)]
    f = tmp_path / "t.txt"
    f.write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = rd.read_text_lines(spark, str(f))
        assert d.rdd.getNumPartitions() >= 1
        rows = d.select("line_number", "text_content", "word_count").orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    kept = [x for x in lines if x.strip()]
    assert [r["text_content"] for r in rows] == kept
    assert [r["line_number"] for r in rows] == list(range(1, len(kept) + 1))
    assert rows[0]["word_count"] == 2


def test_catalog_and_rejects(spark, tmp_path):
    files = {"a.csv": b"x,y\n1,2\n", "b.png": b"\x89PNG\r\n", "c.exe": b"MZ\x00", "d.xlsx": b"not a zip", "e.csv": b"", "f": b"PAR1abc", "g.json": b"[]"}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    rows = {r["file_name"]: r for r in ca.accept_files(ca.catalog_files(spark, str(tmp_path))).collect()}
    assert {n: r["format"] for n, r in rows.items() if n in ("a.csv", "b.png", "f", "g.json")} == {"a.csv": "csv", "b.png": "media", "f": "parquet", "g.json": "json"}
    # The file scan leaves empty files out; a listing from elsewhere may hold them.
    assert rows["c.exe"]["reject_reason"] == "executable" and "e.csv" not in rows
    empty = spark.createDataFrame([("e.csv", 0, "csv", None)], "file_name string, length long, extension string, head string")
    assert ca.accept_files(empty).first()["reject_reason"] == "empty file"
    assert rows["d.xlsx"]["reject_reason"] == "content does not match extension" and rows["a.csv"]["accepted"]


def test_store_round_trip(spark, tmp_path):
    spark.range(40).select((F.col("id") % 4).cast("string").alias("g"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("x")).createOrReplaceTempView("raw_t")
    a = so.load_or_clean(spark, "raw_t", str(tmp_path))
    spark.catalog.dropTempView("raw_t")
    b = so.load_or_clean(spark, "raw_t", str(tmp_path))
    assert b.mask_cols == ["x"] and b.df.count() == a.df.count() == 36
    assert b.report["quality_raw"] == a.report["quality_raw"]
    with pytest.raises(ValueError, match="could not be found"):
        so.load_or_clean(spark, "nothing", str(tmp_path))


@pytest.mark.parametrize("sql,word", [
    ("", "empty"), (" ; ", "empty"), ("SELECT 1; SELECT 2", "multiple"), ("DROP TABLE df", "not a select"), ("SELECT * FROM read_csv('x')", "external"),
    ("SELECT * FROM '/etc/passwd/x'", "unreadable"), ("SHOW TABLES", "not a select"), ("SELECT * FROM parquet.`x`", "external"), ("SELECT * FROM `parquet`.`x`", "external"),
    ("SELECT TRANSFORM(a) USING 'cat' AS (b) FROM df", "external"), ("SELECT java_method('java.lang.System', 'exit', 0)", "external"),
    ("SELECT reflect ('java.util.UUID', 'randomUUID')", "external"), ("SELECT * FROM spark_catalog.default.other", "external"), ("SELECT * FROM other", "external"),
    ("SELECT * FROM df, other", "external"), ("SELECT * FROM df a JOIN other b ON a.x = b.x", "external"), ("SELECT * FROM (SELECT * FROM/**/other)", "external"),
    ("SELECT * FROM (secret)", "external"), ("SELECT * FROM (TABLE secret)", "external"), ("SELECT * FROM (SELECT 1) t, secret", "external"),
    ("SELECT x FROM df UNION ALL TABLE secret", "external"), (r"SELECT 'a\'', x FROM secret WHERE 'q' <> ''", "external"), ('SELECT "a\\"", x FROM secret WHERE "q" <> ""', "external"),
    ("WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "external"), ("SELECT * FROM secret, (WITH secret AS (SELECT 1) SELECT * FROM secret) t", "external"),
    ("WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "external"), ("SELECT x IN (SELECT y FROM secret) FROM df", "external"), ("SELECT (SELECT max(y) FROM secret) FROM df", "external"),
    ("SELECT * FROM df, LATERAL (SELECT * FROM secret)", "external"), ("SELECT * FROM identifier('sec' || 'ret')", "external"), ("SELECT identifier('reflect')('a', 'b')", "external"),
    ("SELECT transform(array(1), v -> reflect('a', 'b')) FROM df", "external"), ("SELECT * FROM df ORDER BY input_file_name()", "external"), ("SELECT sum(x) OVER (ORDER BY reflect('a', 'b')) FROM df", "external"),
    ("SELECT '${env:HOME}' FROM df", "external"), ("SELECT * FROM STREAM df", "external"), ("SELECT my.own(x) FROM df", "external"), ("SELECT own_udf(x) FROM df", "external"), ("SELECT * FROM df VERSION AS OF 1", "external"),
    ("EXPLAIN SELECT 1", "not a select"), ("SET x = 1", "not a select"), ("INSERT INTO df SELECT 1", "not a select"), ("EXECUTE IMMEDIATE 'DROP TABLE x'", "not a select"),
    ("BEGIN SELECT 1; END", "multiple|not a select|unreadable"), ("SELECT 1) t, (SELECT * FROM secret", "unreadable"), ("SELECT 1 /* open", "unreadable"), (None, "empty"),
])
def test_statement_guard(spark, sql, word):
    with pytest.raises(ValueError, match=word):
        sq.guard_statement(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT EXTRACT(year FROM date'2024-01-01') AS y FROM df", "WITH t AS (SELECT x FROM df), u AS (SELECT x FROM t) SELECT * FROM u JOIN data_observed USING (x)",
    "SELECT 'from other' AS a, transform(array(x), v -> v + 1) AS b FROM data_clean -- from other", "select x from `df` where x is distinct from 3",
    "SELECT x FROM df WHERE 'update' <> 'drop; delete' OR x = 'http://x/y/z'", "/* note */ WITH t AS (SELECT x FROM df) SELECT * FROM t; -- done; really", "SELECT a.x FROM df a, data_observed b WHERE a.x = b.x",
    "SELECT x FROM (TABLE df) WHERE x IN (SELECT x FROM data_clean) ;", "WITH df AS (SELECT 7 AS x UNION ALL SELECT 8) SELECT x FROM df", "SELECT x, sum(x) OVER w AS s FROM df WINDOW w AS (ORDER BY x)",
    "SELECT x, v FROM df LATERAL VIEW explode(array(1, 2)) t AS v", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", "SELECT count(DISTINCT x) FILTER (WHERE x > 1) AS n FROM df GROUP BY GROUPING SETS ((x), ())",
    "SELECT '\n+- CTE [secret]' AS a FROM df", "SELECT * FROM range(4)", "SELECT x FROM df UNION ALL SELECT x FROM dataset ORDER BY x",
])
def test_statements_that_may_run(spark, sql):
    assert sq.query_sql(spark.range(3).withColumnRenamed("id", "x").withColumn("x", F.col("x").cast("string")) if "http" in sql else spark.range(3).withColumnRenamed("id", "x"), sql).count() >= 2


def test_statement_tables(spark):
    """Statements are told apart by all but free-standing numbers; nulls and repeats stay."""
    rows = [(1, "SELECT x FROM df LIMIT 5"), (2, "SELECT x FROM df LIMIT 77"), (3, "SELECT x FROM df2"), (4, None), (4, None), (5, "WITH `a 1` AS (SELECT 1) SELECT * FROM `a 2`"), (6, "WITH a1 AS (SELECT 1) SELECT * FROM a2")]
    got = sq.check_statements(spark.createDataFrame(rows, "id int, s string"), "s")
    assert sorted((r["id"], r["reason"], r["allowed"]) for r in got.collect()) == [
        (1, None, True), (2, None, True), (3, "external access", False), (4, "empty", False), (4, "empty", False), (5, "external access", False), (6, "external access", False)]
    assert sq.check_statements(got.limit(0).select("id", "s"), "s").columns == ["id", "s", "reason", "allowed"]


def test_statements_of_one_form_are_parsed_once(spark, monkeypatch):
    """Names, texts and integers do not make a form; what the parser reads stays as written."""
    asked, told = [], sq.StatementGuard.reason
    monkeypatch.setattr(sq.StatementGuard, "reason", lambda self, x: asked.append(x) or told(self, x))
    one = [f"SELECT c{i} FROM df WHERE s = 'it''s {i}' AND t{i}.x IN ({i}, 'v{i}')" for i in range(40)]
    two = [f"SELECT * FROM cat.db.t{i}" for i in range(40)]
    other = [
        "SELECT date'2024-01-01' FROM df", "SELECT date'soon' FROM df", "WITH t1 AS (SELECT 1) SELECT * FROM t1", "WITH t1 AS (SELECT 1) SELECT * FROM t2", "WITH T1 AS (SELECT 1) SELECT * FROM t1",
        "SELECT log10(x) FROM df", "SELECT log11(x) FROM df", "SELECT CAST(x AS DECIMAL(50, 2)) FROM df", "SELECT CAST(x AS DECIMAL(8, 2)) FROM df", "SELECT CAST(x AS foo) FROM df",
        "SELECT x /* it's */ FROM df WHERE y = 'a'", "SELECT x FROM df WHERE y LIKE 'a' ESCAPE '//'", "WITH a AS (SELECT 1), a AS (SELECT 2) SELECT * FROM a", "SELECT * FROM identifier('df')",
        "SELECT 'a;b' FROM FROM", "SELECT X'1F', 1.5, 1e3 FROM df; SELECT 2", "SELECT x -- a; b\n FROM FROM",
    ]
    got = sq.check_statements(spark.createDataFrame([(x,) for x in one + two + other], "s string"), "s").collect()
    assert len(asked) <= 2 + len(other)
    guard = sq.StatementGuard(spark)
    assert {r["s"]: r["reason"] for r in got} == {x: told(guard, x) for x in one + two + other}


def test_query_limit_and_views(spark):
    d = spark.range(500).withColumnRenamed("id", "x")
    spark.range(7).createOrReplaceTempView("df")
    assert sq.query_sql(d, "SELECT x FROM data_clean").count() == 500
    assert sq.query_sql(d, "SELECT x FROM data_clean -- LIMIT 9", 200).count() == 200
    assert sq.query_sql(d, "select x from df limit 300").count() == 300
    assert spark.table("df").count() == 7
    with pytest.raises(ValueError, match="at least 1"):
        sq.query_sql(d, "SELECT x FROM df", 0)


def test_dotted_names(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), (None, 5.0, float("nan"))], "`p.seg` string, `p.x` double, `p.y` double")
    assert sq.group_metric(d, "p.seg", ["p.x", "p.y"]).count() == 2 and sq.group_count(d, "p.seg", True).count() == 2
    assert sq.category_share(d, "p.seg").count() == 2 and sq.ratio_of_sums(d, "p.seg", "p.x", "p.y").count() == 2
    assert sq.overall_metric(d, ["p.x", "p.y"]).first()["n"] == 2


def test_claim_statuses(spark):
    m = spark.createDataFrame([("s1", "attritionrate", 62.73), ("s1", "nused", 110.0)], "source_id string, metric_key string, value double")
    c = spark.createDataFrame([
        (1, "s1", "attrition_rate", 46.36), (2, "s1", "Attrition Rate", 62.7), (3, "s1", "rate", 62.73), (4, "s1", "profit", 1.0), (5, "s9", "n_used", 110.0), (6, "s1", "rate", 5.0),
    ], "claim_id int, source_id string, metric_key string, value double")
    got = {r["claim_id"]: r["status"] for r in vf.verify_claims(c, m).collect()}
    assert got == {1: "mismatch", 2: "verified", 3: "verified", 4: "metric_missing", 5: "source_missing", 6: "metric_missing"}


def test_strip_keeps_order(spark):
    d = spark.createDataFrame([(1, "We saw 10 rows. Then 99 came! All 10 stayed? Yes."), (2, "Nothing here.")], "id int, t string")
    bad = spark.createDataFrame([(1, 99.0)], "id int, number double")
    got = {r["id"]: (r["cleaned_text"], r["sentences_dropped"]) for r in vf.strip_unverified(d, "t", "id", bad).collect()}
    assert got == {1: ("We saw 10 rows. All 10 stayed? Yes.", 1), 2: ("Nothing here.", 0)}


def test_claims_by_other_values_texts_and_long_keys(spark):
    m = spark.createDataFrame([("s", "rate", 10.0), ("s", "rate", 25.25), (None, "n", 4.0), ("k", "x" * 10_000 + "abcd", 3.0)], "source_id string, metric_key string, value double")
    c = spark.createDataFrame([
        (1, "s", "rate", 25.25), (2, "s", "rate", 10.0), (3, "s", "rate", 30.0), (4, "s", "other", 7.5), (5, None, "n", 4.0), (6, "t", "x", 7.5), (7, "k", "xabcd", 3.0), (8, "k", "y" * 9000, 3.0), (9, "s", None, 1.0), (10, "s", "rate", None),
        (11, "s", "rate", float("inf")),
    ], "claim_id int, source_id string, metric_key string, value double")
    own = vf.harvest(spark.createDataFrame([("s", "It was 7.5 then."), ("t", "7.5 again"), ("u", None)], "id string, t string"), "id", "t")
    got = {r["claim_id"]: r["status"] for r in vf.verify_claims(c, m, harvested=own).collect()}
    assert got == {1: "verified", 2: "verified", 3: "mismatch", 4: "verified", 5: "verified", 6: "verified", 7: "verified", 8: "metric_missing", 9: "metric_missing", 10: "mismatch", 11: "mismatch"}


def test_documents_without_text_or_key_stay(spark):
    d = spark.createDataFrame([(1, None), (None, "We saw 10 rows. It never happened, they said."), (3, "")], "id int, t string")
    bad = spark.createDataFrame([(1, 99.0)], "id int, number double")
    said = spark.createDataFrame([(None, "NEVER happened", "mismatch", 1.0), (None, "saw", "mismatch", 2.0), (3, "We saw 10 rows", "mismatch", 3.0)], "id int, text string, status string, value double")
    got = {r["id"]: (r["cleaned_text"], r["sentences_dropped"]) for r in vf.strip_unverified(d, "t", "id", bad, said).collect()}
    assert got == {1: (None, 0), None: ("We saw 10 rows.", 1), 3: ("", 0)}


def test_wordings_are_sought_by_whole_pieces(spark, monkeypatch):
    """Wordings that count are longer than a piece, so no shorter piece of a sentence is indexed."""
    sizes, plain = [], vf._pieces
    monkeypatch.setattr(vf, "_pieces", lambda df, by, name, n: sizes.append(list(n)) or plain(df, by, name, n))
    docs = spark.createDataFrame([(1, "Sales rose a lot here. Nothing else."), (2, "Sales rose a lot here.")], "id int, t string")
    said = spark.createDataFrame([(1, "ROSE a lot h", "mismatch"), (2, "rose a lot", "mismatch")], "id int, text string, status string")
    none = spark.createDataFrame([], "id int, number double")
    got = {r["id"]: r["cleaned_text"] for r in vf.strip_unverified(docs, "t", "id", none, said).collect()}
    assert got == {1: "Nothing else.", 2: "Sales rose a lot here."} and sizes == [[vf.PIECE]] * 2


def test_questions(spark):
    cols = ["Department", "Annual_Salary", "Attrition", "Region"]
    q = spark.createDataFrame([(1, "Average pay by department?"), (2, "What is the credit score?"), (3, "How many rows per region?")], "question_id int, question string")
    assert {(r["question_id"], r["column"]) for r in qu.match_columns(q, cols).collect()} == {(1, "Department"), (1, "Annual_Salary"), (3, "Region")}
    assert [r["missing_entity"] for r in qu.missing_entities(q, cols).collect()] == ["credit score"]
    assert {r["question_id"]: r["basis"] for r in qu.route_questions(q).collect()} == {1: "data_observed", 2: "data_observed", 3: "data_clean"}
    i = spark.createDataFrame([("a", ["Annual_Salary"], "Pay", "by team", 0.5), ("b", ["Region"], "Region counts", "x", 0.9)], "insight_id string, metric_columns array<string>, title string, summary string, impact_score double")
    assert {(r["question_id"], r["insight_id"]) for r in qu.match_insights(q, i, cols).collect()} == {(1, "a"), (3, "b")}


def test_suppression(spark):
    d = spark.createDataFrame([("r", "trend", "x", 15, 10, 25), ("r", "trend", "y", 40, 60, 100), ("r", "trend", "z", 90, 10, 100)], "run_id string, analysis string, target string, n_used int, n_excluded int, total_records int")
    assert {r["target"] for r in ins.suppress(d).collect()} == {"x", "y"}


def test_rate_limit_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaab"), 1_700_000_000 + rnd.randint(0, 600)) for i in range(800)]
    d = spark.createDataFrame(rows, "i int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["i"]: r["recent"] for r in sm.rate_limit_flags(d, "k", "ts", 10, 60).collect()}
    for i, k, s in rows:
        assert got[i] == sum(1 for j, k2, s2 in rows if k2 == k and j != i and 0 <= s - s2 < 60)


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    p = tmp_path / "late.csv"
    p.write_bytes(b"name,n\n" + b"".join(b"row%d,%d\n" % (i, i) for i in range(500)) + "Déjà,1\n".encode("latin-1"))
    assert rd.detect_encoding(spark, str(p)) == "ISO-8859-1"
    assert rd.read_delimited(spark, str(p)).filter("name = 'Déjà'").count() == 1
    (tmp_path / "utf.csv").write_text("name,n\nDéjà �,1\n", encoding="utf-8")
    assert rd.detect_encoding(spark, str(tmp_path / "utf.csv")) == "UTF-8"


def test_preview_obeys(spark):
    assert rd.preview(spark.range(300), ["id"], 250).count() == 250
    with pytest.raises(ValueError, match="at least 1"):
        rd.preview(spark.range(3), ["id"], 0)


def test_related_keys_stay_in_their_source(spark):
    m = spark.createDataFrame([(f"s{i}", f"rate{i}", float(i + 1)) for i in range(30)], "source_id string, metric_key string, value double")
    asked = spark.createDataFrame([(f"s{i}", "rate") for i in range(30)], "source_id string, asked_key string")
    got = vf._related_keys(asked, m).collect()
    assert len(got) == 30 and all(r.metric_key == f"rate{r.source_id[1:]}" for r in got)


def test_a_cluster_needs_a_shared_folder():
    from tidemark import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Session:
        conf, sparkContext = Conf({"spark.master": "spark://host:1"}), Context()

    s = Session()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(s)
    Context.folder = "hdfs://shared/dir/"
    assert session.scratch_dir(s) == "hdfs://shared/dir"
    s.conf["spark.checkpoint.dir"] = "s3a://bucket/x/"
    assert session.scratch_dir(s) == "s3a://bucket/x"


def test_index_holds_only_sizes_that_are_asked(spark, monkeypatch):
    """A key of four and more characters asks for no shorter pieces, keys are dealt by
    rows, and short keys are still found."""
    pieces, seen = vf._pieces, []

    def counted(df, by, name, sizes):
        out = pieces(df, by, name, sizes)
        seen.append((name, df.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(vf, "_pieces", counted)
    monkeypatch.setattr(vf, "PART_ROWS", 10)
    m = spark.createDataFrame([(f"s{i}", k, 1.0) for i in range(60) for k in ("total_price", "order_count")], "source_id string, metric_key string, value double")
    asked = spark.createDataFrame([(f"s{i}", "price") for i in range(60)], "source_id string, asked_key string")
    got = vf._related_keys(asked, m).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"s{i}", "price", "total_price") for i in range(60))
    assert max(n for _, _, n in seen) == 60 * 16 and max(p for _, p, _ in seen) == 13
    asked = spark.createDataFrame([("s1", "x"), ("s1", "price"), ("s2", "e"), ("s3", "t_total_price"), (None, "r")], "source_id string, asked_key string")
    got = vf._related_keys(asked, m.unionByName(spark.createDataFrame([(None, "order", 1.0)], m.schema))).collect()
    assert {tuple(r) for r in got} == {("s1", "price", "total_price"), ("s2", "e", "total_price"), ("s2", "e", "order_count"), ("s3", "t_total_price", "total_price"), (None, "r", "order")}
