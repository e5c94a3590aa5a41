"""License scans: exact containment join of text blocks with license templates.

A template is a short license notice.  Its blocks in a text are windows of consecutive
words, over line ends, that begin with one of its words and have SLACK_PERCENT of its
length; the text's end may cut them.  A block meets a template when it holds at least
THRESHOLD_PERCENT of the template's distinct words, all words that MUST and none that BAR
name for its label, which tell the licenses of a family apart.

Tokens are ordered by how many documents of the whole table hold them, rarest first; a
block that meets a template of n words with overlap ``need`` must hold one of its
n - need + 1 rarest words (prefix filter), the text must have ``need`` words (length
filter), and the words within a block's length of that word's place must hold ``need`` of
the template's (positional filter).  What passes is verified on whole blocks.  Only DataFrame functions are used.

Words: A-Z lowered, maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Defined results: null or empty text has no words, no labels and score 0; repeated
rows each give a row; null ids are kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT, SLACK_PERCENT = 80, 125

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Words of common public license notices, and their labels.
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["licensed under the gnu lesser general public license version 3"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "reserved": ["all rights reserved"],
}

# Words that a block needs or must not hold for a label.
MUST = {"mit": [], "apache": [], "gpl": ["general"], "lgpl": ["lesser"], "bsd": ["binary"], "mpl": ["mozilla"], "cc-by": [], "cc-by-nc": ["nc"], "cc-by-sa": ["sa"], "reserved": []}
BAR = {"gpl": ["lesser"], "cc-by": ["nc", "sa", "nd"], "cc-by-nc": ["sa", "nd"], "cc-by-sa": ["nc", "nd"]}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _LETTERS, _LETTERS.lower())


def spaced(text: Column) -> Column:
    """Lowered text with a space on either side of every word, and nothing else."""
    bare = F.btrim(F.regexp_replace(lowered(text), _GAP, " "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), F.replace(bare, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _count_words(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _as_phrase(phrase: str) -> str:
    return f" {phrase.replace(' ', '  ')} "


def base_columns(words: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and the base labels of a spaced text."""
    found, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        p = _as_phrase(phrase)
        count = ((F.length(words) - F.length(F.replace(words, F.lit(p), F.lit("")))) / len(p)).cast("long")
        found = found + count
        has = F.contains(words, F.lit(p))
        labels.append(F.when(has, F.lit(label)))
        first.append(F.when(has, _count_words(F.substring(words, F.lit(1), F.instr(words, p) - 1))))
        behind = F.instr(F.reverse(words), p[::-1])
        last.append(F.when(has, _count_words(words) - len(phrase.split()) - _count_words(F.substring(F.reverse(words), F.lit(1), behind - 1))))
    return {"n_base": found, "first_word": F.least(*first), "last_word": F.greatest(*last), "base_set": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def global_order(docs: DataFrame) -> list[dict]:
    """Templates with their words rarest first over all documents.

    A count for each template word comes to the driver, however large the table is.
    """
    vocabulary = sorted({w for texts in TEMPLATES.values() for text in texts for w in text.split()})
    held = docs.select(F.explode(F.array_intersect(F.split(spaced(F.col("text")), " +"), F.lit(vocabulary))).alias("token"))
    count = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    out = []
    for label, texts in TEMPLATES.items():
        for text in texts:
            tokens = sorted(set(text.split()), key=rank.get)
            need = -(-THRESHOLD_PERCENT * len(tokens) // 100)
            width = -(-SLACK_PERCENT * len(text.split()) // 100)
            out.append({"label": label, "tokens": tokens, "need": need, "width": width, "must": MUST.get(label, []), "bar": BAR.get(label, [])})
    return out


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): n_words, n_base, first_word,
    last_word, base_labels, labels, score (the largest containment that meets the
    threshold; 1 with a base phrase; else 0)."""
    templates = global_order(docs)
    heads = [(t["tokens"][k], k, t["label"], t["need"], t["width"], t["tokens"], t["must"], t["bar"]) for t in templates for k in range(len(t["tokens"]) - t["need"] + 1)]
    keys = sorted({h[0] for h in heads})
    widest = max(t["width"] for t in templates)
    has_key = F.rlike(F.col("s"), F.lit(" (" + "|".join(keys) + ") "))

    # ids are used within one job only, to bring a row's probes together again
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), spaced(F.col("text")).alias("s"))
    plain = {"n_words": _count_words(F.col("s")), **base_columns(F.col("s"))}
    rows = rows.select("doc_id", "row", *[c.alias(k) for k, c in plain.items()], F.when(has_key, F.split(F.btrim("s"), " +")).alias("words"))
    at = F.filter(F.transform("words", lambda w, j: F.struct(w.alias("token"), j.alias("j"))), lambda x: F.array_contains(F.lit(keys), x["token"]))
    around = lambda j: F.slice("words", F.greatest(j - (widest - 1), F.lit(0)) + 1, 2 * widest - 1)
    probes = F.transform(at, lambda x: F.struct(x["token"].alias("token"), F.least(x["j"], F.lit(widest - 1)).alias("at"), around(x["j"]).alias("near")))
    probes = rows.select("doc_id", "row", *plain, F.explode_outer(probes).alias("p")).select("doc_id", "row", *plain, "p.*")
    heads = docs.sparkSession.createDataFrame(heads, "token string, place int, label string, need int, width int, tokens array<string>, must array<string>, bar array<string>")
    joined = probes.join(F.broadcast(heads), "token", "left")  # the template table is a constant of this module
    possible = (F.col("n_words") >= F.col("need")) & (F.size(F.array_intersect("tokens", "near")) >= F.col("need"))
    starts = F.filter(F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), F.col("at")), lambda k: F.array_contains("tokens", F.get("near", k)))

    def overlap(k: Column) -> Column:
        block = F.slice("near", k + 1, F.col("width"))
        right = (F.size(F.array_intersect("must", block)) == F.size("must")) & ~F.arrays_overlap("bar", block)
        return F.when(right, F.size(F.array_intersect("tokens", block))).otherwise(0)

    best = F.when(possible, F.array_max(F.transform(starts, overlap)))
    met = joined.withColumn("overlap", best).withColumn("share", F.when(F.col("overlap") >= F.col("need"), F.col("overlap") / F.size("tokens")))
    out = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", *plain)], F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("met"), F.max("share").alias("best"))
    labels = F.array_sort(F.array_union("base_set", "met"))
    score = F.greatest(F.when(F.size("base_set") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    templates = ", ".join(f"({k}, '{label}', '{text}', {lists(MUST.get(label, []))}, {lists(BAR.get(label, []))})" for k, (label, text) in enumerate((label, text) for label, texts in TEMPLATES.items() for text in texts))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    low = f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')"
    words = lambda x: f"regexp_extract_all({x}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words(low)} AS w FROM documents),
p AS (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {phrases}) v(phrase, label)),
hit AS (SELECT r, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda k: w[k + 1:k + len(p)] = p)) AS place FROM d, p),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS base FROM hit GROUP BY r),
tpl AS (SELECT tid, label, list_distinct(string_split(words, ' ')) AS t, must, bar,
  ({SLACK_PERCENT} * len(string_split(words, ' ')) + 99) // 100 AS width FROM (VALUES {templates}) v(tid, label, words, must, bar)),
pos AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
held AS (SELECT r, i, word, tid FROM pos JOIN (SELECT tid, unnest(t) AS word FROM tpl) USING (word)),
enough AS (SELECT r, tid FROM held JOIN tpl USING (tid) GROUP BY r, tid, len(t) HAVING 100 * count(DISTINCT word) >= {THRESHOLD_PERCENT} * len(t)),
win AS (SELECT r, tid, label, t, must, bar, w[i:i + width - 1] AS b FROM held JOIN enough USING (r, tid) JOIN tpl USING (tid) JOIN d USING (r)),
met AS (SELECT r, list(DISTINCT label) AS met, max(len(list_intersect(list_distinct(b), t)) / len(t)) AS best FROM win
  WHERE 100 * len(list_intersect(list_distinct(b), t)) >= {THRESHOLD_PERCENT} * len(t) AND list_has_all(b, must) AND NOT list_has_any(b, bar) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ',') AS labels,
  greatest(CASE WHEN base IS NULL THEN 0.0 ELSE 1.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN met USING (r)
"""


SQL = _sql()
