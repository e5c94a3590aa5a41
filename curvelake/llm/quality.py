"""Quality rules: a ledger of measurements and one bit for each failed rule.

Every rule is evaluated once for each text.  ``failed_bits`` keeps bit k set where
rule k failed, beside the measurements; policies (versioned sets of rules) and
ablations are then bitwise aggregates over the ledger and never touch texts again.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, lines are cut at \\n.

Defined results: null or empty text has no words and fails rule 0 (too few words);
null ids and repeated rows are kept; other columns are ignored; an empty table gives
an empty ledger.  Memory is bounded by slices of a few MB or one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small_batches, tidy
from .words import Words, map_batches, slices, window_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: (name, SQL that holds where it fails) by bit. The first two are the base rules.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 50 * n_words)"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
]
#: Versioned policies: the rules that reject a document.
POLICIES = {"v1": ["few_words", "repeated_windows"], "v2": [name for name, _ in RULES]}
BASE_POLICY, POLICY = "v1", "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True


def bits(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def _repeats(hashes: np.ndarray) -> int:
    """Words in 3-word windows that stand twice or more, given a text's word hashes."""
    if len(hashes) < 4:
        return 0
    w = window_hashes(hashes, 3)
    _, of, n = np.unique(w, return_inverse=True, return_counts=True)
    again = n[of] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(w)] |= again
    return int(covered.sum())


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text."""
    out = {m: np.zeros(len(column), np.int64) for m in MEASURES}
    for first, end in slices(column):
        w = Words(column, first, end)
        at = slice(first, end)
        out["n_words"][at] = np.diff(w.rows)
        extra = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_FOLLOWS[w.data], out=extra[1:])
        chars = np.zeros(len(w.start) + 1, np.int64)
        np.cumsum((w.end - w.start) - (extra[w.end] - extra[w.start]), out=chars[1:])
        out["word_chars"][at] = np.diff(chars[w.rows])
        symbols = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_SYMBOL[w.data], out=symbols[1:])
        out["n_symbols"][at] = np.diff(symbols[w.offsets])
        raw = w.data.tobytes()
        for k in range(end - first):
            out["n_repeat_words"][first + k] = _repeats(w.hash[w.rows[k] : w.rows[k + 1]])
            out["n_lines"][first + k], out["n_dup_lines"][first + k] = _lines(raw[w.offsets[k] : w.offsets[k + 1]])
    return out


def _failed_bits() -> Column:
    total = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(RULES):
        total = total + F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0))
    return total.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits of every row of docs (doc_id, text)."""

    def run(batch):
        m = measure(batch.column("text"))
        yield [batch.column("doc_id"), *(m[k] for k in MEASURES)]

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = map_batches(kept, run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumn("failed_bits", _failed_bits())


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(bits(policy))) == 0)


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents failing it, failing nothing else, and kept without it."""
    mask = bits(policy)
    own = F.col("failed_bits").bitwiseAND(F.lit(mask))
    patterns = rows.select(own.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if mask >> k & 1])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    return each.groupBy("rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed_bits").bitwiseAND(F.lit(bits(BASE_POLICY))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


def filter_stage(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, that the policy keeps."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([whole.schema["_doc"], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    @tidy
    def run(batches):
        for batch in batches:
            m = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in MEASURES)], names=["_doc", *MEASURES])

    rows = small_batches(whole).mapInArrow(run, schema).withColumn("failed_bits", _failed_bits())
    return apply_policy(rows).where("kept").select("_doc.*")


_WORD = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT r, k, hash(w[k], w[k + 1], w[k + 2]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, h) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k + j) AS n FROM again, range(3) v(j) GROUP BY r),
line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{_WORD}') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (r) LEFT JOIN line USING (r)),
f AS (SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 50 * n_words) THEN 4 ELSE 0 END)
  + (CASE WHEN n_symbols > n_words THEN 8 ELSE 0 END)
  + (CASE WHEN n_lines > 3 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END))::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""
