"""BPE, prefix counts and JPEG against libraries, brute force and round trips."""

import base64
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from curvelake.llm import jpeg
from curvelake.llm.bpe import Ranks
from curvelake.llm.prefix_counts import PrefixCounter

TEXTS = ["", " ", "a", "don't we'll I've 'tis '''re 'r", "  two  spaces\n\n\n end ", "Éauxé über ñandú 漢字 🙂🙂 ع", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x\t\ty \n \n z", "1234567890 12 3", "!!! ??? ... --", "<|endoftext|> and <|endoftext|>", "\x00\x01 ​", "word " * 40, "       ", "\n \n  \t b"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    alphabet = "abcdefghij   \n\t'.,!réü漢🙂0123stvmld"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return Ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def test_encoding_equals_the_library(ranks):
    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    for text in TEXTS + random_texts(400) + ["ab" * 3000, "é" * 2000]:
        ids = library.encode_ordinary(text)
        assert ranks.encode(text) == ids
        assert ranks.decode(ids) == text.encode()
        assert ranks.encode_digits(text) == ",".join(map(str, ids))
        assert ranks.decode_digits(ranks.encode_digits(text)) == text.encode()


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_counts_of_all_prefixes(counter):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in TEXTS + random_texts(150, 2):
        brute = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text) == brute, text
        assert counter.count(text) == brute[-1]
        for budget in {0, 1, 2, 5, brute[-1]}:
            assert counter.truncate(text, budget) == max(k for k, n in enumerate(brute) if n <= budget), (text, budget)


def test_counting_cuts_a_text_once_and_encodes_no_pair(counter, monkeypatch):
    texts = [t for t in TEXTS + random_texts(100, 3) if "<|" not in t]
    wanted = [(counter.count(t), counter.truncate(t, 4)) for t in texts]
    r, tokens = random.Random(4), sorted(counter.whole)
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(3000)] + [(t, t) for t in tokens[:1000]] + [(b"-" * 2, b"-"), (b"-", b"-" * 2)]
    assert [counter._apart(a, b) for a, b in pairs] == [counter._encode(a + b) == [a, b] for a, b in pairs]

    class Cuts:
        texts = []

        def findall(self, text):
            self.texts.append(text)
            return pattern.findall(text)

    pattern, cuts = counter.pattern, Cuts()
    monkeypatch.setattr(counter, "pattern", cuts)
    monkeypatch.setattr(counter, "_encode", None)
    counter.counts.clear()
    counter.pairs.clear()
    assert [counter.measure(t, 4) for t in texts] == wanted
    assert all(cuts.texts.count(t) == texts.count(t) for t in texts if len(pattern.findall(t)) > 9)


@pytest.mark.parametrize("merges", [["a b", "b c", "ab c"], ["a b", "b c", "ab c", "a bc"], ["a a", "aa a", "aa aa", "b aa"], ["b c", "a bc", "c a", "abc a", "a b"]])
def test_counts_by_other_merges(merges):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    letters = [t for t in spec["model"]["vocab"] if len(t) == 1]
    spec["model"]["vocab"] = {t: k for k, t in enumerate(dict.fromkeys(letters + [m.replace(" ", "") for m in merges]))}
    spec["model"]["merges"] = merges
    spec["added_tokens"] = []
    small, library = PrefixCounter(json.dumps(spec).encode()), Tokenizer.from_str(json.dumps(spec))
    assert small.ordered == (len({m.replace(" ", "") for m in merges}) == len(merges))
    for n in range(1, 8):
        for text in map("".join, itertools.product("abc", repeat=n)):
            assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def payloads():
    r = np.random.default_rng(3)
    yield bytes(64)
    yield b"\x80" * 128
    yield bytes(range(256)) * 3
    yield r.integers(0, 256, 64 * 2000).astype(np.uint8).tobytes()
    yield np.where(r.random(64 * 50) < 0.95, 128, r.integers(0, 256, 64 * 50)).astype(np.uint8).tobytes()
    yield "Éa text of words. ".encode() * 64


def test_stored_bytes_come_back():
    files = [jpeg.store(p) for p in payloads()]
    many = jpeg._decode_many(files)
    for payload, raw, info in zip(payloads(), files, many):
        assert jpeg.read_payload(info) == payload
        assert jpeg.read_payload(jpeg.decode(raw)) == payload
        data, bounds = jpeg._split_scan(np.frombuffer(raw, np.uint8)[info["scan"]:])
        assert np.array_equal(jpeg._serial(info, data, bounds)[0], info["coefficients"][0])


def test_bad_files_are_refused():
    good = jpeg.store(bytes(range(64)))
    for bad in (b"", b"\xff\xd8", good[:40], b"\x00" + good, good[:2] + b"\xff\xd9"):
        with pytest.raises((jpeg.BadJpeg, KeyError, IndexError)):
            jpeg.decode(bad)
