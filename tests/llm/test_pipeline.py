"""Each stage of the pipeline against brute force on its own input, and the whole of it."""

import collections

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm_operators import WORD, brute_components, brute_mix, brute_repeats, corpus

import corpus_pipeline as pipeline
from curvelake.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def encoder():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def good(text):
    """Whether no rule of the policy fails."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    again = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    return not (len(w) < 50 or 100 * len(again) > 50 * len(w) or chars < 2 * len(w) or chars > 50 * len(w) or symbols > len(w) or len(lines) > 3 and 2 * dup > len(lines))


def mixed(spark, rows):
    """(doc_id, text) of the mix of rows, by brute force."""
    df = spark.createDataFrame(rows, COLUMNS)
    keys = {r["doc_id"]: (r["h0"], r["h1"]) for r in df.select("doc_id", *mixing.row_key(df, df.columns)).collect()}
    found = brute_mix([(*keys[r[0]], r[3], len(WORD.findall(r[1]))) for r in rows])
    out = []
    for r, (taken, _) in zip(rows, found):
        for n in taken:
            ends = [m.end() for m in WORD.finditer(r[1])]
            out += [(r[0], r[1] if n == len(ends) else r[1][: ends[n - 1]])] if n else []
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    return [(k, t, "en", f"src{k % 3}", 0 if t is None else len(t)) for k, t in enumerate(corpus(7, 48))]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard", "substring_dedup", "source_mix", "byte_bpe"]
    stage = dict(pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, "").cache()
    kept = sorted(tuple(r) for r in one.collect())
    assert one.columns == docs.columns and kept == [r for r in rows if good(r[1])]
    two = stage["ngram_jaccard"](spark, one, "").cache()
    components = brute_components(kept)
    first = {c for _, c in components.values()}
    single = sorted(tuple(r) for r in two.collect())
    assert single == [r for r in kept if r[0] in first]
    three = stage["substring_dedup"](spark, two, "").cache()
    cut = sorted(tuple(r) for r in three.collect())
    for got, old, (n, lost, sha) in zip(cut, single, brute_repeats([r[1] for r in single])):
        words = WORD.findall(got[1])
        assert (got[0], len(words), got[4]) == (old[0], n - lost, len(got[1]))
        assert lost or got == old
    four = stage["source_mix"](spark, three, "").cache()
    assert four.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in four.collect()) == mixed(spark, cut)
    five = stage["byte_bpe"](spark, four, "")
    known = encoder()
    want = sorted((r["doc_id"], known.encode(r["text"], disallowed_special=())) for r in four.collect())
    assert sorted((r["doc_id"], list(r["ids"])) for r in five.collect()) == want


def test_run(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.withColumn("_row", F.lit("mine")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path))
    want = docs
    for _, stage in pipeline.STAGES:
        want = stage(spark, want.withColumn("_row", F.lit("mine")) if "_row" not in want.columns else want, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())
    assert key(got) == key(want) and got.count() > 10
    assert pipeline.queries() == {"pipeline": pipeline.run} and pipeline.oracle_sql() == {}
