"""The ten operators on small tables against brute force; nulls, empty and odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.llm import bpe, chat, html_text, jpeg, license, mixing, neardup, prefix_counts, quality, substrings
from curvelake.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Prose with exact and near copies, repeated passages and odd texts."""
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["É", "ñu", "漢字", "|", "#"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(60)
    out = []
    for k in range(n):
        kind = k % 6
        if kind == 1 and out:
            out.append(r.choice(out))
        elif kind == 2 and out:
            words = r.choice(out).split()
            if words:
                words[r.randrange(len(words))] = "edited"
            out.append(" ".join(words))
        elif kind == 3:
            out.append(text(r.randint(5, 80)) + "\n" + passage + "\t" + text(r.randint(5, 80)))
        else:
            out.append(text(r.choice([0, 1, 3, 4, 5, 7, 8, 9, 34, 35, 36, 80, 150, 300])))
    return out + ["", " \n\t", None, "a", "A b c d", "a B c d", "x x x x x x x x x x x x", "x " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 11 == 0 else f"src{k % 4}", 0 if t is None else len(t)) for k, t in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache(), rows


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = {k: shingles(t) for k, t, *_ in rows}
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_near_duplicates(spark, docs):
    df, rows = docs
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_a_chain(spark):
    base = [f"t{k}" for k in range(100)]
    rows = []
    for k in range(30):  # each differs from the next by one word, the ends by many
        base[k * 3] = f"new{k}"
        rows.append((100 - k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def near_copies(seed=3, n=90):
    """Edits of a few texts, many of them just beyond the threshold, and edits of edits."""
    r = random.Random(seed)
    out = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(120)]
        for k in range(n // 3):
            copy = list(r.choice(out[-5:]).split()) if k % 4 == 3 and out else list(words)
            for e in range(k % 9):
                copy[r.randrange(len(copy))] = f"e{base}x{k}y{e}"
            out.append(" ".join(copy))
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("small", [1, 8, 32])
def test_open_blocks_around_hubs(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(rows)


def test_nodes_that_share_a_name(spark, monkeypatch):
    whole = neardup.node_of
    monkeypatch.setattr(neardup, "node_of", lambda s: (whole(s)[0] & 7, whole(s)[1]))
    rows = near_copies(5, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = neardup._sets(neardup._prepared(df))
    assert len(neardup._renamed(sets.groupBy("node", "node2").agg(F.min("t0")))) > 10
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def mirrored(k):
    """Two words of 2^k letters whose polynomial hashes agree modulo 2^64 for k of ten or more."""
    x, y = "a", "b"
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("k", [10, 13])
def test_words_alike_modulo_powers_of_two(spark, k):
    x, y = mirrored(k)
    tail = " ".join(f"c{j}" for j in range(34))
    rows = [(0, f"{x} {tail}"), (1, f"{y} {tail}"), (2, f"{x} p q r s"), (3, f"{y} p q r s"), (4, f"{x} p q {y} p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["_doc"]["doc_id"]: r["_n_removed"] for r in substrings.remove_repeats(df).collect()} == dict.fromkeys(range(5), 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows) and got[3][1] == 3
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.ledger(df).collect()} == dict.fromkeys(range(5), 0)


def test_near_duplicates_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, None), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, 2, None), (3, 0, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.dedup_stage(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in neardup.dedup_stage(df).collect()) == [-1, 3, 3]


def brute_repeats(rows, width=35):
    seen = {}
    words = [WORD.findall(t or "") for t in rows]
    for d, w in enumerate(words):
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append((d, k))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d].update(range(k, k + width))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for w, g in zip(words, gone)]


def test_substring_dedup(spark, docs):
    df, rows = docs
    got = {r["_doc"]["doc_id"]: (r["_n_words"], r["_n_removed"], r["_kept_sha256"]) for r in substrings.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats([r[1] for r in rows])))
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_a_full_sketch_loses_nothing(spark, docs, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(substrings, "estimates", lambda sketch, hashes: np.ones(len(hashes), bool))
    got = [tuple(r) for r in substrings.remove_repeats(df.select("doc_id", "text")).select("_n_words", "_n_removed", "_kept_sha256").collect()]
    assert sorted(got) == sorted(brute_repeats([r[1] for r in rows]))


def test_quality(spark, docs):
    df, rows = docs
    got = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(df)).collect()}
    for k, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert (r["failed_bits"] & 3 != 0) == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    kept = {r["doc_id"] for r in quality.filter_stage(df).collect()}
    assert kept == {k for k, r in got.items() if r["kept"]}
    table = {r["rule"]: r for r in quality.ablations(quality.ledger(df)).collect()}
    assert table["few_words"]["n_failed"] == sum(r["failed_bits"] & 1 for r in got.values())


def test_mixing(spark, docs):
    df, rows = docs
    got = mixing.mix(df).collect()
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.share_out(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    by = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r["doc_id"]][1] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[by[r["doc_id"]]] and abs(r["target"] - target[by[r["doc_id"]]]) < 1e-6
        taken[by[r["doc_id"]]] += r["taken"]
    assert len(got) == len(rows)
    for s, n in taken.items():
        assert abs(n - target[s]) <= 1.5 * mixing.BLOCK, (s, n, target[s])
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 or all(target[s] == 2 * sizes[s] for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0
    staged = mixing.mix_stage(df)
    assert staged.columns == df.columns
    assert staged.select(F.sum(mixing.count_words(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def brute_mix(keyed):
    """(taken, slots by pass) of rows (h0, h1, source, size), word by word."""
    sizes = {}
    for _, _, source, size in keyed:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.share_out(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    need = {s: mixing.slots_needed(sizes[s], target[s]) for s in order}
    n, high, at = sum(need.values()), [], 0.0
    for s in order:
        at += need[s] / n
        high.append(at)
    slots = {s: [] for s in order}
    for k in range(n):
        x = (k + 1) * mixing.GOLDEN
        slots[next((s for s, h in zip(order, high) if x - math.floor(x) < h), order[-1])].append(k)
    for i, s in enumerate(order):
        got = len(slots[s])
        slots[s] += [n + j * len(order) + i for j in range(need[s] - got)]
    out = {}
    for s in order:
        rows = sorted((h0 % mixing.BUCKETS, h0, h1, k) for k, (h0, h1, source, size) in enumerate(keyed) if source == s)
        words = [k for *_, k in rows for _ in range(keyed[k][3])]
        left = math.ceil(target[s])
        blocks = -(-len(words) // mixing.BLOCK)
        for r, slot in enumerate(slots[s]):
            if not blocks or left <= 0:
                break
            epoch, b = divmod(r, blocks)
            part = words[b * mixing.BLOCK : (b + 1) * mixing.BLOCK][:left]
            left -= len(part)
            for k in part:
                taken, first = out.setdefault(k, ([0, 0], [None, None]))
                taken[epoch] += 1
                first[epoch] = slot if first[epoch] is None else min(first[epoch], slot)
    return [out.get(k, ([0, 0], [None, None])) for k in range(len(keyed))]


def test_mixing_against_brute_force(spark, docs):
    df, rows = docs
    known = df.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"), *mixing.row_key(df, ["doc_id", "source", "text"])).orderBy("doc_id").collect()
    want = brute_mix([(r["h0"], r["h1"], r["source"], r["size"]) for r in known])
    got = {r["doc_id"]: (r["passes"], r["slots"]) for r in mixing.mix(df).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(known, want)}
    assert len({x for _, s in got.values() for x in s if x is not None}) > 20


def test_mixed_texts_and_their_order(spark, docs):
    df, rows = docs
    df = df.where("text IS NOT NULL")
    texts = {r[0]: r[1] for r in rows}
    mixing_rows = mixing.mix(df, ("doc_id", "text", "lang", "source", "n_chars")).collect()
    want = sorted((slot, r["doc_id"], w) for r in mixing_rows for w, slot in zip(r["passes"], r["slots"]) if w)
    staged = [(r["doc_id"], r["text"], r["n_chars"]) for r in mixing.mix_stage(df).collect()]
    by_slot = lambda pairs: sorted(pairs)
    assert by_slot((d, len(WORD.findall(t))) for d, t, _ in staged) == by_slot((d, w) for _, d, w in want)
    for d, t, n in staged:
        assert texts[d].startswith(t) and n == len(t)
    place = {}
    for slot, d, _ in want:
        place.setdefault(d, []).append(slot)
    at = [min(place[d]) if k == [x[0] for x in staged].index(d) else max(place[d]) for k, (d, *_) in enumerate(staged)]
    assert at == sorted(at)


def test_many_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, None, "")] * 40 + [(1, "a", "x y z")] * 50 + [(2, "b", "p q")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == 93 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got if r["doc_id"] == 1) == math.ceil(next(r["target"] for r in got if r["doc_id"] == 1))
    staged = mixing.mix_stage(df).collect()
    assert sum(len(r["text"].split()) for r in staged) == sum(r["taken"] for r in got)


def odd_columns(df):
    """Columns named like inner ones, and a map."""
    return df.select("*", F.lit(7).alias("_row"), F.lit("mine").alias("_text"), F.lit("d").alias("_doc"), F.lit(1).alias("h0"), F.lit(2).alias("size"), F.lit("n").alias("n"), F.lit(3).alias("t0"), F.lit("k").alias("_kept"), F.create_map(F.lit("a"), F.col("source")).alias("marks"), F.struct(F.lit(None).cast("string").alias("a"), F.col("source").alias("b")).alias("pair"))


@pytest.mark.parametrize("stage", [quality.filter_stage, neardup.dedup_stage, substrings.dedup_stage, mixing.mix_stage])
def test_stages_keep_clashing_columns(spark, docs, stage):
    df, _ = docs
    plain = sorted(repr((r["doc_id"], r["text"])) for r in stage(df).collect())
    wide = odd_columns(df)
    got = stage(wide)
    assert got.schema.simpleString() == wide.schema.simpleString()
    rows = got.collect()
    if stage is not mixing.mix_stage:  # its shuffle is by all columns
        assert sorted(repr((r["doc_id"], r["text"])) for r in rows) == plain
    assert rows and all((r["_row"], r["_text"], r["_doc"], r["h0"], r["size"], r["n"], r["t0"], r["_kept"]) == (7, "mine", "d", 1, 2, "n", 3, "k") for r in rows)
    assert all(r["marks"]["a"] == r["source"] == r["pair"]["b"] for r in rows)
    assert stage(wide.limit(0)).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([("  a\n b\t\tc  ",)], "text string")
    assert [df.select(mixing.first_words(F.col("text"), F.lit(k))).first()[0] for k in (1, 2, 3)] == ["  a", "  a\n b", "  a\n b\t\tc"]


def test_mixing_meets_small_targets(spark):
    words = {"hot": 60_000, **{f"s{k}": 40 for k in range(7)}, "t": 129, "u": 1000, "v": 65, "empty": 0}
    rows = [(k, "w " * min(500, n - at), s) for s, n in words.items() for k, at in enumerate(range(0, max(n, 1), 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = sorted(words)
    target = mixing.share_out(words, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    got = mixing.mix(df, ("doc_id", "source")).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    assert {r["source"]: r["taken"] for r in got} == {s: math.ceil(target[s]) for s in words}
    sources = mixing.plan(spark, df.select("source", mixing.count_words(F.col("text")).alias("size")))
    slots = mixing.schedule(spark, sources).orderBy("slot").collect()
    assert len({r["slot"] for r in slots}) == len(slots)
    for r in sources.collect():
        own = [s["rank"] for s in slots if s["sid"] == r["sid"]]
        assert own == list(range(len(own))) and len(own) >= r["slots"]


def test_chat(spark):
    odd = "\\ <| \\<| <|im_sep|> \n \\\\ \\| <|im_end|>\n"
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "user", odd), (1, 3, "assistant", odd), (1, 4, "assistant", None), (2, 0, "we\\ird\n<|role", "x\\"), (2, None, None, "first"), (3, 0, "assistant", ""), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), chat.loss_mask(F.col("segments")))).collect()}
    turns = lambda k: [(t["role"], t["text"]) for t in out[k]["turns"]]
    assert turns(1) == [("system", "s"), ("user", "u1"), ("user", odd), ("assistant", odd), ("assistant", "")]
    assert out[1]["loss"] == odd and out[1]["formatted"].count("<|im_start|>") == 3
    assert turns(2) == [("", "first"), ("we\\ird\n<|role", "x\\")]
    assert turns(3) == [("assistant", "")] and turns(None) == [("user", "no id")]
    assert chat.digest(df.limit(0)).count() == 0


def test_planted_conversation(spark, tmp_path):
    long = "word é 漢 " * 40_000
    rows = [(5, 0, "user", "q"), (5, 1, "assistant", long), (5, 2, "user", None), (5, 3, "assistant", chat.PLANTED)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[-1]["n_turns"], got[-1]["loss_sha256"], got[-1]["turns_sha256"]) == (2, sha(chat.PLANTED), sha(f"user\n{chat.PLANTED}\nassistant\n{chat.PLANTED}\n"))
    assert (got[5]["loss_chars"], got[5]["loss_sha256"]) == (len(long) + len(chat.PLANTED), sha(long + chat.PLANTED))


def test_mixing_of_a_very_long_text(spark):
    rows = [(1, "w x " * 60_000, "a"), (2, "y z", "a"), (3, "q " * 50, "b")]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["size"] == 120_000 and got[1]["taken"] + got[2]["taken"] == math.ceil(got[1]["target"]) and got[3]["taken"] == 100


def test_other_tokenizers_are_refused():
    import json

    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [dict(spec["added_tokens"][0], lstrip=True)]}):
        with pytest.raises(ValueError, match="not counted|are counted"):
            prefix_counts.PrefixCounter(json.dumps(spec | change).encode())


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "mit license mit license"), (3, None), (4, "Licensed under CC BY-NC 4.0."), (5, "the quick brown fox"), (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"), (7, "x GENERAL  public-license y"), (8, ""), (8, ""), (9, "x\nThis program is free software: you can redistribute\nit and/or modify it under the terms of the\n GNU General Public\nLicense y"), (10, "Licensed under the GNU Lesser\nGeneral Public License, version 3"), (11, "all " + "a b c d e f g " * 30 + "rights reserved"), (12, "w " * 30_000 + "All rights\nreserved. " + "v " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license.scan(df).collect()}
    assert license.scan(df).count() == len(rows) and license.scan(df.limit(0)).count() == 0
    assert (got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("mit", 1, 3, 3)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 2)
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["first_word"] is None
    assert got[4]["labels"] == "cc-by-nc" and got[4]["base_labels"] == ""
    assert got[9]["labels"] == "gpl" and got[10]["labels"] == "gpl,lgpl" and got[11]["labels"] == ""
    assert (got[12]["labels"], got[12]["n_words"], got[12]["score"]) == ("reserved", 60_003, 1.0)
    assert got[5]["labels"] == "" and got[5]["score"] == 0.0
    assert got[6]["labels"] == "mit" and got[6]["base_labels"] == ""
    assert got[7]["base_labels"] == "gpl" and got[7]["first_word"] == 1


PAGE = "<html><head><title>t</title></head><body><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>We use cookies</div>%s<footer>&copy; x</footer></body></html>"


def test_html(spark):
    pages = [(k, "http://a.example/%d" % k, PAGE % f"<article><h1>Title {k}</h1><p>One &amp; two\n three<br>four<p>Five <b>six</b><!-- no --><form><input></form></article>") for k in range(4)]
    pages += [(k, "http://b.example/%d" % k, f"<body><div>Same promo</div><div id=c><p>Long text number {k} of this page<p>and more of it {k}</div><aside>s</aside>") for k in range(10, 14)]
    pages += [(20, None, None), (21, "http://c.example", "<p>cut <foo"), (22, "", "plain &am")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.main_texts(df).collect()}
    for k in range(4):
        assert got[k]["text"] == f"Title {k}\n\nOne & two three four\n\nFive six"
    assert got[11]["text"] == "Long text number 11 of this page\n\nand more of it 11"
    assert got[20]["text"] == "" and got[21]["text"] == "cut" and got[22]["text"] == "plain &am"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_html_copies_and_attributes(spark):
    page = "<body><div>Same promo</div><div id=c><p>Long text number %s of this page</div>"
    pages = [(1, "http://two.example/1", page % 1), (2, "http://two.example/2", page % 1)]
    pages += [(k, f"http://three.example/{k}", page % min(k, 4)) for k in (3, 4, 5)]
    pages += [(6, "http://attr.example/", "<p data-id=menu title='x id=footer' data-role=\"dialog\">Kept</p><p id=menu>Left out</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Same promo\n\nLong text number 1 of this page"
    assert [got[k] for k in (3, 4, 5)] == [f"Long text number {min(k, 4)} of this page" for k in (3, 4, 5)]
    assert got[6] == "Kept"


POST = """<body class="home has-sidebar"><div class=top>Welcome to all</div><div class="post no-sidebar" id=post-%d>
<div class=post-header><h1>Title %d</h1></div><div class=label>Published by staff</div><section id=search-engines><p>%s</p></section><p>End of number %d.</p></div>
<div class=extra>Other words %d</div></body>"""


def words_of(k, n=40):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_html_template_decides(spark):
    pages = [(k, f"http://p.example/{k}", POST % (k, k, words_of(k), k, k)) for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(df).collect()}
    for k, _, page in pages:
        assert got[k] == f"Title {k}\n\n{words_of(k)}\n\nEnd of number {k}."
        # without the template, what is outside the container and the template's text stay
        assert html_text.extract(page, frozenset(), None) == f"Welcome to all\n\nTitle {k}\n\nPublished by staff\n\n{words_of(k)}\n\nEnd of number {k}.\n\nOther words {k}"


def test_html_article_goes_through_the_template(spark):
    page = "<body><nav>n</nav><article class='post no-sidebar'><header><h1>T%d</h1></header><div>Share this</div><p>%s</p><div class=comments>c</div></article><div>%s</div>"
    pages = [(k, "http://q.example/", page % (k, words_of(k), words_of(50 + k, 30))) for k in range(5)]
    copies = [(10 + k, "http://copies.example/", page % (0, words_of(7) + str(k), "x")) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(pages + copies, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k] == f"T{k}\n\n{words_of(k)}"
    same = [(20 + k, "http://same.example/", page % (0, words_of(7), "x%d" % k)) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    # near copies: the template would be all of the article, so they keep it
    assert set(got.values()) == {f"T0\n\nShare this\n\n{words_of(7)}"}


def test_html_classes(spark):
    """Occurrence vectors, order and nesting against brute force on small hosts."""
    r = random.Random(5)
    part = lambda: "".join(r.choice(["<h2>t</h2>", "<p>x</p>", "<ul><li>a<li>b</ul>", "<div class=z><b>q</b></div>"]) for _ in range(r.randrange(1, 5)))
    pages = [(k, f"http://h{k % 3}.example/", f"<body><div id=a>{part()}</div><section>{part()}<i>{r.randrange(3)}</i></section>") for k in range(24)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    keyed = df.select(html_text._host().alias("host"), F.xxhash64("html").alias("row"), "html")
    found = html_text.candidates(keyed).collect()
    want = {}
    for h in range(3):
        mine = sorted({p for k, _, p in pages if k % 3 == h})
        vectors = {}
        for n, p in enumerate(mine):
            sequence, facts = html_text.page_tokens(p)
            for t in set(sequence):
                vectors.setdefault((t, facts[t][1] == 4, facts[t][2]), []).append((n, sequence.count(t)))
        for (t, is_text, holder), v in vectors.items():
            if len(v) > 1 and 2 * len(v) >= len(mine):
                want[f"h{h}.example", t] = (tuple(v), is_text, t if is_text else holder)
    got = {(x["host"], x["token"]): x["class"] for x in found if x["token"]}
    assert got.keys() == want.keys()
    for a in want:
        for b in want:
            assert a[0] != b[0] or (want[a] == want[b]) == (got[a] == got[b])
    assert html_text.order_of([1, 2, 1, 2], {1: 7, 2: 7})[7][1] is False
    assert html_text.order_of([1, 2, 2, 1], {1: 7, 2: 7})[7][1] is True
    assert [bad for _, bad in html_text.order_of([1, 3, 4, 2], {1: 7, 2: 7, 3: 8, 4: 8}).values()] == [False, False]
    assert sorted(bad for _, bad in html_text.order_of([1, 3, 2, 4], {1: 7, 2: 7, 3: 8, 4: 8}).values()) == [False, True]


def test_html_of_long_pages(spark):
    page = "<body><article>" + "".join(f"<p>{words_of(k, 9)}</p>" for k in range(5000)) + "</article>"
    got = html_text.main_texts(spark.createDataFrame([(1, "http://l.example", page), (2, "http://l.example", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[0]["text"] == "\n\n".join(words_of(k, 9) for k in range(5000)) and got[1]["text"] == ""


def test_counts_codes_and_media(spark, docs):
    import public_tokenizers as P

    df, rows = docs
    counts = prefix_counts.token_counts(df, P.path("byte_bpe_50k.json"), 50)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in counts.collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids) and r["n_bytes"] == len(text.encode())
        assert len(library.encode(text[: r["chars_within"]], add_special_tokens=False).ids) <= 50
    encoded = bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert back == {r[0]: (r[1] or "").encode() for r in rows}
    for r in jpeg.stored_texts(df).collect():
        raw = (rows[r["doc_id"]][1] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    for f in (lambda d: prefix_counts.token_counts(d, P.path("byte_bpe_50k.json"), 5), lambda d: jpeg.stored_texts(d), lambda d: bpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)):
        assert f(df.limit(0)).count() == 0


def test_image_features(spark):
    good = jpeg.store(bytes(range(64)) * 4)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "id long, content binary")
    got = {r["id"]: r for r in jpeg.image_features(df).collect()}
    assert (got[1]["width"], got[1]["height"]) == (32, 8) and got[2]["feature"] is None and got[3]["width"] is None


def test_words_of_long_texts():
    import pyarrow as pa

    text = ("ab " * 200_000) + "z" * 700_000 + " end"
    w = Words(pa.array([None, text, "", "x"]))
    assert np.diff(w.rows).tolist() == [0, 200_002, 0, 1]
    assert len(set(w.hash[:200_000].tolist())) == 1
    assert w.hash[0] == Words(pa.array(["ab"])).hash[0] and w.hash[200_000] == Words(pa.array(["z" * 700_000])).hash[0]
