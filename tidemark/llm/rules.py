"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger holds the measurements and
one failure bit per rule. Policies are versioned masks over the same bits, so a
policy can be changed, compared or ablated without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import column, small_batches

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
_SCHEMA = StructType([StructField(m, LongType()) for m in MEASURES])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over the measurements) is true; ``bit`` never changes."""

    bit: int
    name: str
    fails: str


RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "upper_case", "10 * n_upper > 5 * n_letters"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]
#: Versions are never edited; a new policy gets a new name.
POLICIES = {"base": ["few_words", "repeated_words"], "v1": [r.name for r in RULES]}


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:  # three ids would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
        code = pairs[:-1] * len(seen) + ids[2:]
    else:
        code = pairs[:-1] * len(seen) + ids[2:]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, code)
    hit = twice[np.minimum(at, len(twice) - 1)] == code
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def _measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()] if words else []
    chars = int(count[:128].sum() + count[192:].sum()) - int(count[_SPACES].sum())
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    return len(words), chars, int(count[_SYMBOLS].sum()), len(lines) - len(set(lines)), _repeated(words), len(lines), upper, upper + lower


@F.pandas_udf(_SCHEMA)
def _measures(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([_measure(x) for x in part], columns=MEASURES, dtype="int64")


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def failure_bits(measures: str) -> Column:
    """One long with the bit of each failed rule, from a struct column of measurements."""
    bits = [F.when(F.expr(_qualified(r.fails, measures)), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def _qualified(sql: str, prefix: str) -> str:
    return " ".join(f"{prefix}.{w}" if w in MEASURES else w for w in sql.split())


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failure_bits``.

    A null text is an empty one (no words: ``few_words`` fails). Repeated rows and
    null ids each keep their own row. An empty table gives an empty ledger.
    """
    small_batches(docs)
    # asNondeterministic keeps the optimizer from evaluating the texts once per use
    measured = docs.select(column(id_col).alias("doc_id"), _measures.asNondeterministic()(column(text_col).cast("string")).alias("m"))
    return measured.select("doc_id", "m.*", failure_bits("m").alias("failure_bits"))


def passes(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents, all columns unchanged, that fail no rule of the policy."""
    small_batches(docs)
    m = "__rule_measures"
    while m.lower() in {c.lower() for c in docs.columns}:
        m += "_"
    out = docs.withColumn(m, _measures.asNondeterministic()(column(text_col).cast("string")))
    return out.where(passes(failure_bits(m), policy)).select(*[column(c) for c in docs.columns])


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it (they would
    stay without the rule), and that pass the policy.

    The ledger is first counted by masked bit pattern (at most 2 ** rules rows).
    """
    m = mask(policy)
    patterns = led.groupBy(F.col("failure_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("docs"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    one_row = patterns.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("docs"))), F.lit(0)).alias("n_kept"),
        F.array(*[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0, F.col("docs"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("bits") == (1 << r.bit), F.col("docs"))), F.lit(0)).alias("n_failed_only"),
            )
            for r in rules
        ]).alias("rules"),
    )
    return one_row.select(F.lit(policy).alias("policy"), "n_docs", "n_kept", F.inline("rules"))
