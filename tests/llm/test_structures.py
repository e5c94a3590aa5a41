"""Periodic runs, conversation repair and packing against brute force; odd tables."""

import hashlib
import heapq
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curvelake.llm import packing, repair, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, runs string, n long"
TURNS = "conv_id long, turn long, role string, text string, copies string"


def brute_runs(words, times, least):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size, u = j + q - i, words[i : j + q]
            if size >= max(least, times * q) and not any(all(u[k] == u[k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        size, k = r.choice([0, 1, 5, 6, 9, 20, 60, 200]), r.choice([1, 2, 2, 3, 5])
        t = [r.randrange(k) for _ in range(size)]
        if r.random() < 0.6 and size > 8:
            a = r.randrange(size)
            p = r.randint(1, max(1, (size - a) // 4))
            t = [t[i] if i < a else t[a + (i - a) % p] for i in range(size)]
        if r.random() < 0.3 and size > 8:
            t[r.randrange(size)] = 9
        yield [f"w{x}" for x in t]


@pytest.mark.parametrize(("times", "least"), [(4, 6), (2, 2), (3, 3)])
def test_runs_of_texts_refined_together(times, least):
    texts = list(periodic_texts(times, 600))
    for k in range(0, len(texts), 6):
        some = texts[k : k + 6]
        names = {w: i for i, w in enumerate({(d, x) for d, t in enumerate(some) for x in t})}
        label = np.array([names[d, x] for d, t in enumerate(some) for x in t], np.int64)
        found = runs.word_runs(label, np.cumsum([0] + [len(t) for t in some]), times, least)
        want = [(d, *r) for d, t in enumerate(some) for r in brute_runs(t, times, least)]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def test_run_words_of_special_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for words in (list(fib[-1]), list("a" * 500), list("ab" * 300), list("aab" * 100 + "b")):
        label = np.unique(words, return_inverse=True)[1]
        found = runs.word_runs(label, np.array([0, len(words)]), 2, 2)
        assert list(zip(*(x.tolist() for x in found[1:]), strict=True)) == brute_runs(words, 2, 2)


def test_periodic_runs_of_a_table(spark):
    texts = [" \t".join(t) + "\n" for t in periodic_texts(7, 120)] + [None, "", " \n", "x " * 50, "É  " * 9, "one " * 3000 + "end"]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "y " * 7, None, None), (3, texts[3], None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {(d, hashlib.sha256((t or "").encode()).digest()): WORD.findall(t or "") for d, t, *_ in rows}
    for r in got:
        words = next(w for (d, _), w in by.items() if d == r.doc_id)
        want = brute_runs(words, 4, 6)
        assert [(x.start, x.length, x.period) for x in r.runs] == want
        assert r.collapsed == collapse(words, want)
        assert r.n_words == len(words)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def planted_words(doc, words):
    h = zlib.crc32(str(doc).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op11_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 6, 40, 150]))) for _ in range(900)] + [None, ""]
    rows = [(k, t, "", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for k, t, *_ in rows:
        words = planted_words(k, WORD.findall(t or ""))
        want, row = brute_runs(words, 4, 6), got[k]
        planted += bool(want)
        assert row.n_runs == len(want)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapse(words, want).encode()).hexdigest()
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if want else None
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 10


def brute_edits(initials, must_go, truncated):
    """Least cost, and of its edits the least audit, over all edit sequences."""
    n = len(initials)
    begun = lambda roles: re.fullmatch("s?(ua)*u?", roles)
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (audit, i, roles) in seen:
            continue
        seen.add((audit, i, roles))
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        steps = []
        if i < n:
            steps.append((2, "D", 1, ""))
            if not must_go[i]:
                more = 5 * truncated[i]
                steps += [(more, "K", 1, initials[i])] * (initials[i] in ("s", "u", "a")) + [(more + 1, "R", 1, x) for x in "ua"]
        if cost <= 2 * n:
            steps += [(5, "I", 0, x) for x in "ua"]
        for c, letter, k, x in steps:
            if begun(roles + x):
                heapq.heappush(heap, (cost + c, audit + letter, i + k, roles + x))


def test_plan_is_the_least_of_all_edits():
    r = random.Random(2)
    for _ in range(500):
        initials = [r.choice(["s", "u", "a", "u", "a", "t", ""]) for _ in range(r.randint(0, 6))]
        must_go = [r.random() < 0.2 for _ in initials]
        truncated = [not g and r.random() < 0.2 for g in must_go]
        cost, audit, turns = repair.plan(initials, must_go, truncated)
        assert (cost, audit, "".join(" sua"[s] for _, s in turns)) == brute_edits(initials, must_go, truncated)


def test_plan_of_a_long_conversation():
    r = random.Random(4)
    initials = [r.choice("uuaas") for _ in range(20_000)]
    cost, audit, turns = repair.plan(initials, [False] * len(initials), [r.random() < 0.1 for _ in initials])
    assert re.fullmatch("s?(ua)+", "".join(" sua"[s] for _, s in turns))
    assert len(audit) - audit.count("I") == len(initials)
    assert cost >= 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I")


def damage(rows):
    """Rows of one conversation after the query's damage, by turn."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


def brute_conversation(rows):
    after = damage(rows)
    first, seen = [], set()
    for _, role, text in after:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        first.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, roles = brute_edits([r[:1] for _, r, _ in after], [f in ("blank", "duplicate") for f in first], [f == "truncated" for f in first])
    lines, i, k = [], 0, 0
    for letter in audit:
        if letter in "KR":
            lines.append((after[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[roles[k]]) + ":" + after[i][2])
        elif letter == "I":
            lines.append({"u": "user", "a": "assistant"}[roles[k]] + ":")
        k += letter != "D"
        i += letter != "I"
    turns = {t for t, *_ in after if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))  # noqa: B905
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, first.count("blank"), first.count("duplicate"), first.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_op12_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for conv in [*range(150), None, -7]:
        for turn in range(r.randint(1, 6)):
            rows.append((conv, None if r.random() < 0.05 else turn + (r.random() < 0.1), r.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), r.choice(["Yes.", "No!", "why?", "cut", " \n", None, "É…", f"t{turn}."]), "clash"))
    rows += [(r0, t, role, text, "copy") for r0, t, role, text, _ in rows[:3]]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row[:4])
    assert got.keys() == by.keys()
    assert any(not damage(x) for x in by.values())
    for conv, mine in by.items():
        assert got[conv] == brute_conversation(mine), mine


def test_repair_keeps_whole_turns(spark):
    rows = [(1, 1, "user", "a.", ""), (1, 2, "user", "b.", ""), (1, None, "system", "s.", "")]
    turns = spark.createDataFrame(rows, TURNS)
    row = repair.repair(turns).collect()[0]
    assert [tuple(t) for t in row.repaired] == [("system", "s."), ("user", "a."), ("assistant", "b.")]
    assert (row.audit, row.cost, row.gaps) == ("KKR", 1, 0)
    assert repair.repair(turns.limit(0)).count() == 0
    assert [tuple(r.repaired) for r in repair.repair(turns, F.lit(0)).collect()] == [()]


def one_by_one(lengths, size):
    """Best fit, pieces one at a time from the longest down: the rooms left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


def test_plan_on_counts_is_best_fit_one_by_one():
    r = random.Random(6)
    for _ in range(200):
        size = r.choice([1, 7, 50, 200])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        slots, sequences = packing.best_fit(counts, size)
        filled = [[] for _ in range(sequences)]
        for n, many in counts.items():
            mine = slots[slots[:, 0] == n]
            for rank in range(many):
                _, first, sequence, per, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                filled[sequence + (rank - first) // per].append((offset + (rank - first) % per * n, n))
        for parts in filled:
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert 0 < at <= size
        assert sorted(size - sum(n for _, n in p) for p in filled) == one_by_one(lengths, size)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts(seed, n):
    r = random.Random(seed)
    alphabet = [*"abc'sS!.1é́ßΣ \n\t\x0b ​İ日本\x1c", "<|endoftext|>", " the ", " word"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_words_encode_as_whole_texts_do(library):
    encoder = packing.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    import pyarrow as pa

    texts = [*odd_texts(8, 2000), "", "x" * 5000, "<|startoftext|>a <|endoftext|>"]
    ids, begin = encoder.encode(packing.Pieces(pa.array(texts)))
    for k, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[begin[k] : begin[k + 1]].tolist() == found.ids


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


@pytest.mark.parametrize("size", [16, 4096])
def test_packing_of_a_table(spark, library, size):
    texts = [*odd_texts(9, 200), None, "", "", "a b c d " * 2500, "z " * (2 * size - 1)]
    rows = [(k, t, "clash", 2) for k, t in enumerate(texts)] + [(None, "null id", None, None), (5, texts[5], None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size, ids=True).cache()
    want, total = [], 0
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for start in range(0, len(ids), size):
            part = ids[start : start + size]
            want.append((doc is None, doc or 0, start // size, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), tuple(part)))
    got = packed.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == sorted(want)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(0 < len(x) <= size for x in whole.values())
    assert sum(map(len, whole.values())) == total
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sorted(size - len(x) for x in whole.values()) == one_by_one([w[4] for w in want], size)
    plain = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size)
    assert "ids" not in plain.columns
    assert plain.count() == len(want)
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), size).count() == 0
