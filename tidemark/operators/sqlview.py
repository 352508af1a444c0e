"""SQ-01..03, SQ-06..11: read-only SQL and the fixed question templates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.java_gateway import JavaObject, is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset
from tidemark.operators.cleaning import col
from tidemark.session import materialize, pin

#: The names a statement may read besides those it defines with WITH.
VIEWS = ("data_clean", "df", "dataset", "data_observed")
# Plan nodes that a reading statement is made of, as Spark's parser names them.
PLANS = frozenset(
    "Project Filter Aggregate Sort Distinct Deduplicate GlobalLimit LocalLimit Offset Union Intersect Except Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedHaving UnresolvedHint WithWindowDefinition Window Generate Pivot UnresolvedPivot Unpivot Sample Expand RepartitionByExpression Repartition "
    "OneRowRelation OneRowRelation$ LocalRelation UnresolvedInlineTable UnresolvedRelation UnresolvedTableValuedFunction".split()
)
# Table functions that make rows out of their arguments alone.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
# Built-in functions that reach files or the Java runtime.
DENIED_FUNCTIONS = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())
MESSAGES = {
    "empty": "The statement is empty.", "multiple statements": "Only one statement is allowed.", "not a select": "Only statements that read are allowed.",
    "external access": "The statement reaches outside the two views.", "unreadable": "The statement cannot be parsed.",
}
_CATALYST = "org.apache.spark.sql.catalyst"
# The pieces of a statement (text, comments, numbers, words, any other character),
# and what makes it count as written: other quotes, escapes, settings, hints, nested comments,
# and words after which the parser reads into a text or a number.
_PIECE_RE = r"(?s)'[^']*'|--[^\r\n]*|/\*.*?\*/|\d+\.\d*\w*|\.\d+\w*|[\p{L}\w]+|\s+|."
_AS_WRITTEN_RE = (
    r"(?is)[`\"\\$]|/\*\+|/\*(?:(?!\*/).){0,999}/\*|\b[rx]\s*'|\b(?:identifier|interval|date|time|timestamp|timestamp_ltz|timestamp_ntz|escape|collate|collation|dec|decimal|numeric"
    r"|char|character|varchar|tablesample|options|\w*properties|set|reset)\b"
)
_CHUNK = 5000


class _Refused(Exception):
    """Why a statement is not allowed."""


class StatementGuard:
    """SQ-02: reads a statement with the session's own parser and walks the plan that it
    builds. Every relation has to be one of the four views or a name that a WITH defines
    for that place, every table function and function a known built-in one, and every
    node one of a reading statement; so no wording can hide a table.

    The parser is part of the driver: a Spark Connect session has none."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._parser = spark._jsparkSession.sessionState().sqlParser()
        self._builtin = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - DENIED_FUNCTIONS

    def words(self, spark: SparkSession) -> list[str]:
        """The lower-case words that mean something to the parser or to this guard."""
        keywords = {r[0].lower() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect()}
        return sorted(w for w in keywords | self._builtin | DENIED_FUNCTIONS | TABLE_FUNCTIONS | set(VIEWS) if w.isidentifier())

    def reason(self, sql: str | None) -> str | None:
        """None for an allowed statement, else a key of ``MESSAGES``."""
        if sql is None or not sql.strip().rstrip(";").strip():
            return "empty"
        if "${" in sql:  # the parser puts settings and environment variables there
            return "external access"
        try:
            plan = self._parser.parsePlan(sql)
        except (PySparkException, Py4JJavaError):  # also a number or type that the parser refuses
            ends = (i for i, c in enumerate(sql) if c == ";")
            return "multiple statements" if any(self._parses(sql[:i]) for i in ends) else "unreadable"
        try:
            self._walk(plan, frozenset(VIEWS))
        except _Refused as e:
            return str(e)
        return None

    def body(self, sql: str) -> str:
        """An allowed statement without what ends it."""
        text = sql.strip()
        whole = self._shape(text)
        for i in range(len(text) - 1, -1, -1):
            if text[i] == ";" and self._parses(text[:i]) and self._shape(text[:i]) == whole:
                return self.body(text[:i])
        return text

    def _shape(self, sql: str) -> str:
        return re.sub(r"#\d+", "#", self._parser.parsePlan(sql).toString())

    def _parses(self, sql: str) -> bool:
        try:
            self._parser.parsePlan(sql)
        except (PySparkException, Py4JJavaError):  # also a number or type that the parser refuses
            return False
        return True

    def _is(self, x, name: str) -> bool:
        return is_instance_of(self._gateway, x, name)

    def _walk(self, x, names: frozenset[str]) -> None:
        """All plans and expressions below ``x``, through lists, options and pairs;
        ``names`` are the relations that can be read here."""
        if not isinstance(x, JavaObject):
            return
        if self._is(x, f"{_CATALYST}.plans.logical.LogicalPlan"):
            kind = x.getClass().getSimpleName()
            if kind == "ScriptTransformation":
                raise _Refused("external access")
            if kind not in PLANS:
                raise _Refused("external access" if "Identifier" in kind or "TimeTravel" in kind or "Relation" in kind else "not a select")
            if kind == "UnresolvedRelation" and (x.isStreaming() or self._name(x.multipartIdentifier()) not in names):
                raise _Refused("external access")
            if kind == "UnresolvedTableValuedFunction" and self._name(x.name()) not in TABLE_FUNCTIONS:
                raise _Refused("external access")
            if kind == "UnresolvedWith":
                self._with(x, names)
                return
        elif self._is(x, f"{_CATALYST}.expressions.Expression"):
            kind = x.getClass().getSimpleName()
            if "UnresolvedIdentifier" in kind or (kind == "UnresolvedFunction" and self._name(x.nameParts()) not in self._builtin):
                raise _Refused("external access")
        if self._is(x, "scala.collection.IterableOnce"):
            self._each(x.iterator(), names)
        elif self._is(x, "scala.Product"):
            self._each(x.productIterator(), names)

    def _each(self, it, names: frozenset[str]) -> None:
        while it.hasNext():
            self._walk(it.next(), names)

    def _with(self, x, names: frozenset[str]) -> None:
        """A name holds in the definitions after its own and in the statement itself; in
        its own only if WITH is recursive."""
        it = x.cteRelations().iterator()
        while it.hasNext():
            pair = it.next()
            name = pair._1().lower()
            self._walk(pair._2(), names | {name} if x.allowRecursion() else names)
            names = names | {name}
        self._walk(x.child(), names)

    @staticmethod
    def _name(parts) -> str:
        """The lower-case name, whole: ``a.b`` is none of the known names."""
        return parts.mkString("\0").lower()


def with_form(df: DataFrame, sql: Column, words: Sequence[str]) -> DataFrame:
    """``df`` with ``_shape``, a statement with other names, texts and numbers in the places
    of its own: names that are none of ``words`` (lower case) and texts are numbered in the
    order in which they come first, and integers of up to nine digits become 1. Equal ones
    stay equal and different ones different, so all statements of a form have one verdict.

    Where the parser looks into a text or a number, or cuts pieces otherwise than here,
    and where a name comes in two spellings, the statement is its own form."""
    is_text = lambda p: p.startswith("'")
    own = lambda p: F.when(is_text(p), F.length(p) > 1).otherwise(p.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower(p).isin(*words))
    at = lambda p: F.array_position("_own", p)
    numbered = lambda p: F.when(is_text(p), F.concat(F.lit("'t"), at(p).cast("string"), F.lit("'"))).otherwise(F.concat(F.lit("_n"), at(p).cast("string")))
    put = F.transform("_pieces", lambda p: F.when(at(p) > 0, numbered(p)).when(p.rlike("^[0-9]{1,9}$"), F.lit("1")).otherwise(p))
    low = F.transform("_own", lambda p: F.when(is_text(p), p).otherwise(F.lower(p)))
    spelled_alike = F.size("_own") == F.size(F.array_distinct(low))
    out = df.withColumn("_sql", sql).withColumn("_pieces", F.regexp_extract_all("_sql", F.lit(_PIECE_RE), F.lit(0)))
    out = out.withColumn("_own", F.array_distinct(F.filter("_pieces", own)))
    shape = F.when(~F.col("_sql").rlike(_AS_WRITTEN_RE) & spelled_alike, F.array_join(put, "")).otherwise(F.col("_sql"))
    return out.withColumn("_shape", shape).drop("_sql", "_pieces", "_own")


def check_statements(df: DataFrame, sql: str) -> DataFrame:
    """SQ-02 over a table of statements: adds ``reason`` and ``allowed``.

    Spark's parser belongs to the driver. Statements of one form (:func:`with_form`)
    have one verdict, and each form is parsed there, some thousands at a time."""
    spark = df.sparkSession
    guard = StatementGuard(spark)
    # read twice
    shaped = materialize(with_form(df, col(sql).cast("string"), guard.words(spark)), "statement-forms")
    out, held = [], []

    def told() -> None:
        if held:
            out.append(pin(spark.createDataFrame([(x, guard.reason(x)) for x in held], "_told string, reason string"), "statements"))
            held.clear()

    for r in shaped.select("_shape").distinct().toLocalIterator():
        held.append(r[0])
        if len(held) == _CHUNK:
            told()
    told()
    if not out:
        return df.withColumns({"reason": F.lit(None).cast("string"), "allowed": F.lit(None).cast("boolean")})
    verdicts = reduce(DataFrame.unionByName, out)
    return shaped.join(verdicts, F.col("_shape").eqNullSafe(F.col("_told")), "left").drop("_shape", "_told").withColumn("allowed", F.col("reason").isNull())


def guard_statement(spark: SparkSession, sql: str) -> str:
    """SQ-02 for one statement: the text to run, or a ValueError."""
    guard = StatementGuard(spark)
    reason = guard.reason(sql)
    if reason:
        raise ValueError(f"{reason}: {MESSAGES[reason]}")
    return guard.body(sql)


def query_sql(ds: Dataset | DataFrame, sql: str, max_rows: int | None = None) -> DataFrame:
    """SQ-01, SQ-03: run a checked statement over ``data_clean`` (also ``df`` and
    ``dataset``) and ``data_observed``. All rows come back unless ``max_rows`` is given.

    The views are names of this statement only: a caller's views of the same names
    stay as they are."""
    ds = as_dataset(ds)
    if max_rows is not None and max_rows < 1:
        raise ValueError("max_rows has to be at least 1")
    spark = ds.df.sparkSession
    body = guard_statement(spark, sql)
    clean, observed = (f"{name}_{uuid.uuid4().hex}" for name in ("clean", "observed"))
    ds.clean().createOrReplaceTempView(clean)
    ds.observed().createOrReplaceTempView(observed)
    views = ", ".join(f"{v} AS (SELECT * FROM {observed if v == 'data_observed' else clean})" for v in VIEWS)
    try:
        out = spark.sql(f"WITH {views} SELECT * FROM (\n{body}\n)")
    finally:
        for name in (clean, observed):
            spark.catalog.dropTempView(name)
    return out if max_rows is None else out.limit(max_rows)


def _view(ds: Dataset | DataFrame, basis: str) -> DataFrame:
    ds = as_dataset(ds)
    return ds.observed() if basis == "data_observed" else ds.clean()


def present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows in which all the columns hold a value (no NULL, no NaN)."""
    nan = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    keep = F.lit(True)
    for n in names:
        keep = keep & col(n).isNotNull() & ((~F.isnan(col(n))) if n in nan else F.lit(True))
    return df.filter(keep)


def group_metric(ds: Dataset | DataFrame, group: str, metrics: Sequence[str], how: str = "avg", basis: str = "data_observed") -> DataFrame:
    """SQ-06: averages or sums per group over rows in which group and all
    metrics are present, with n."""
    rows = present(_view(ds, basis), [group, *metrics])
    f, prefix = (F.avg, "avg") if how == "avg" else (F.sum, "total")
    return rows.groupBy(col(group)).agg(*[F.round(f(col(m)), 2).alias(f"{prefix}_{m.lower()}") for m in metrics], F.count("*").alias("n")).withColumn("basis", F.lit(basis))


def group_count(ds: Dataset | DataFrame, group: str, highest_first: bool = False, basis: str = "data_clean") -> DataFrame:
    """SQ-07."""
    out = present(_view(ds, basis), [group]).groupBy(col(group)).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), col(group)) if highest_first else out


def category_share(ds: Dataset | DataFrame, column: str, basis: str = "data_clean") -> DataFrame:
    """SQ-08: share of each value among rows that have one."""
    g = present(_view(ds, basis), [column]).groupBy(col(column)).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t")).scalar()
    return g.select(col(column), "n", F.round(F.col("n") * 100.0 / total, 2).alias("share_percent"), total.alias("n_total"))


def ratio_of_sums(ds: Dataset | DataFrame, group: str, num: str, den: str, basis: str = "data_observed") -> DataFrame:
    """SQ-09: sum(num)/sum(den) in percent per group, highest first."""
    rows = present(_view(ds, basis), [group, num, den])
    g = rows.groupBy(col(group)).agg(F.sum(col(num)).alias("total_num"), F.sum(col(den)).alias("total_den"), F.count("*").alias("n"))
    rate = F.round(F.col("total_num") * 100.0 / F.nullif(F.col("total_den"), F.lit(0)), 2)
    return g.withColumn("rate_percent", rate).orderBy(F.desc_nulls_last("rate_percent"), col(group))


def overall_metric(ds: Dataset | DataFrame, metrics: Sequence[str], how: str = "avg", basis: str = "data_observed") -> DataFrame:
    """SQ-10: the same without a group."""
    rows = present(_view(ds, basis), metrics)
    f, prefix = (F.avg, "avg") if how == "avg" else (F.sum, "total")
    return rows.agg(*[F.round(f(col(m)), 2).alias(f"{prefix}_{m.lower()}") for m in metrics], F.count("*").alias("n"))


def overall_count(ds: Dataset | DataFrame, basis: str = "data_clean") -> DataFrame:
    """SQ-10."""
    return _view(ds, basis).agg(F.count("*").alias("total_count"))


def annotate_basis(answers: DataFrame, metric: str, basis: str, stats: DataFrame) -> DataFrame:
    """SQ-11: add the basis, and the imputed share of the metric when the answer
    rests on the cleaned view. ``stats`` has one row per column."""
    rate = stats.filter((F.lower("column") == metric.lower()) & (F.col("imputation_rate") > 0)).agg(F.max("imputation_rate").alias("r")).scalar()
    note = F.concat(F.lit(f"imputed share: {metric} "), F.format_number(rate * 100, 1), F.lit("% imputed"))
    return answers.withColumns({"basis": F.lit(basis), "note": F.when((F.lit(basis) == "data_clean") & rate.isNotNull(), note)})
