"""Token counts by prefix dynamic programming.

For a piece of the pre-tokenizer, place i of the table holds the last token of the
exact encoding of the piece's first i bytes, and how many tokens that encoding has.
A sequence of tokens is an encoding exactly when each neighbouring pair encodes to
itself, so the last token at i is the one vocabulary word ending at i that forms
such a pair with the last token at its own start.  Words are tried from the shortest on and
only while some token ends so.  Whether a pair encodes to itself is read by undoing
its merges, latest first: it does unless a pair across the border has an earlier merge
than the one that uses up either side.  Pieces that begin with the same bytes share
their table up to there.  One pass gives the counts of all prefixes; a text is cut into
pieces once, for its count and its longest prefix within a budget.

A text's prefix ends in a piece that may be cut; only the cut piece (with the white
space before it) is cut anew by the pattern, as the rest cannot change.

Defined results: null text is empty with no tokens; special tokens' strings count as
the library's default does (one token when ``specials`` names them); repeated rows
and null ids each give a row; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import map_batches

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 800_000
CACHE_PAIRS = 400_000
CACHE_HEADS = 100_000
#: pieces that begin with the same so many bytes share their table up to there
HEAD = 5
NONE = 1 << 40
#: instead of a merge, for single bytes
FIRST = (b"", b"", -1)


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in vocabulary files: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, content: bytes):
        spec = json.loads(content)
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("type") != "BPE":
            raise ValueError("only byte-level pairs cut by the usual pattern, without a normalizer, are counted")
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in what is beside them are not counted")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.vocabulary = {raw(t) for t in model["vocab"] if all(c in letters for c in t)}
        #: a token's merge: left part, right part, rank
        self.made = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        #: each token has one merge, which comes after those of its parts: merges of a text go by rank
        self.ordered = len(self.made) == len(self.rank) and all(self.made.get(t, FIRST)[2] < k for pair, k in self.rank.items() for t in pair)
        #: tokens that encode to themselves; no others stand in an encoding
        self.whole = self._whole()
        #: what tokens end with, and whether it is one itself
        self.ends = dict.fromkeys((t[k:] for t in self.whole for k in range(1, len(t))), False) | dict.fromkeys(self.whole, True)
        self.pattern = regex.compile(PATTERN)
        specials = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.counts: dict[str, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[bytes]]] = {}

    # -- exact encoding of short byte strings: pairs of tokens only --

    def _encode(self, raw: bytes) -> list[bytes]:
        parts = [raw[k : k + 1] for k in range(len(raw))]
        rank = self.rank
        while len(parts) > 1:
            least, at = min((rank.get((parts[k], parts[k + 1]), NONE), k) for k in range(len(parts) - 1))
            if least == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self) -> set[bytes]:
        if not self.ordered:
            return {t for t in self.vocabulary if self._encode(t) == [t]}
        whole = {bytes([k]) for k in range(256)}
        for (a, b), k in sorted(self.rank.items(), key=lambda x: x[1]):
            if a in whole and b in whole and self._apart(a, b, k):
                whole.add(a + b)
        return whole & self.vocabulary

    def _apart(self, a: bytes, b: bytes, limit: int = NONE) -> bool:
        """Whether nothing is merged across the border of two whole tokens before rank ``limit``."""
        rank, made = self.rank.get, self.made.get
        while rank((a, b), NONE) >= limit:
            left, right = made(a, FIRST), made(b, FIRST)
            if left[2] > right[2]:
                a, limit = left[1], left[2]
            elif right[2] >= 0:
                b, limit = right[0], right[2] + 1  # of equal pairs the left one is merged first
            else:
                return True
        return False

    def _fits(self, a: bytes, b: bytes) -> bool:
        known = self._apart(a, b) if self.ordered else self._encode(a + b) == [a, b]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = known
        return known

    def table(self, raw: bytes) -> list[int]:
        """Token counts of the prefixes of one piece: place i is for i bytes."""
        if len(raw) <= HEAD:
            return self._extended(raw, [0], [b""])[0]
        head = self.heads.get(raw[:HEAD])
        if head is None:
            head = self._extended(raw[:HEAD], [0], [b""])
            if len(self.heads) >= CACHE_HEADS:
                self.heads.clear()
            self.heads[raw[:HEAD]] = head
        return self._extended(raw, *map(list.copy, head))[0]

    def _extended(self, raw: bytes, count: list[int], last: list[bytes]) -> tuple[list[int], list[bytes]]:
        """A piece's table, counts and last tokens, from that of a beginning of it."""
        ends, pairs = self.ends.get, self.pairs.get
        for i in range(len(count), len(raw) + 1):
            for j in range(i - 1, -1, -1):
                token = raw[j:i]
                whole = ends(token)
                if whole:
                    if not j:
                        break
                    known = pairs((last[j], token))
                    if self._fits(last[j], token) if known is None else known:
                        break
                elif whole is None:
                    raise ValueError(f"no encoding ends at byte {i} of {raw[:i]!r}")
            else:
                raise ValueError(f"no encoding ends at byte {i} of {raw[:i]!r}")
            count.append(count[j] + 1)
            last.append(token)
        return count, last

    def piece_count(self, piece: str) -> int:
        known = self.counts.get(piece)
        if known is None:
            raw = piece.encode()
            known = 1 if raw in self.whole else self.table(raw)[-1]
            if len(piece) <= 64:
                if len(self.counts) >= CACHE_PIECES:
                    self.counts.clear()
                self.counts[piece] = known
        return known

    # -- texts --

    def parts(self, text: str):
        """(string, is special) parts of a text."""
        if self.special is None or not self.special.search(text):
            return [(text, False)]
        return [(p, k % 2 == 1) for k, p in enumerate(self.special.split(text)) if p]

    def _counted(self, part: str) -> tuple[list[str], list[int]]:
        """Pieces of a part and their token counts."""
        known, pieces = self.counts, self.pattern.findall(part)
        counts = list(map(known.get, pieces))
        if None in counts:
            counts = [self.piece_count(p) if n is None else n for p, n in zip(pieces, counts, strict=True)]
        return pieces, counts

    def count(self, text: str) -> int:
        return sum(1 if special else sum(self._counted(part)[1]) for part, special in self.parts(text))

    def _tails(self, part: str):
        """For each prefix length of a part from 1 on: its exact token count.

        (end, count) in order; ``done`` tokens stand before the last piece that a
        following character can change.
        """
        done = 0
        pieces = self.pattern.findall(part)
        at = 0
        for k, piece in enumerate(pieces):
            here = self.table(piece.encode())
            before = pieces[k - 1] if k and pieces[k - 1].isspace() else ""
            sizes = [0]
            for c in piece:
                sizes.append(sizes[-1] + len(c.encode()))
            lead = done - (self.piece_count(before) if before else 0)
            plain = not piece.startswith("'") or len(piece) < 3
            for m in range(1, len(piece) + 1):
                cut = piece[:m]
                if m == len(piece) and not (cut.isspace() and before):
                    n = done + here[-1]
                elif before and cut.isspace():
                    n = lead + self.table((before + cut).encode())[-1]
                elif plain or m == 1:
                    n = done + here[sizes[m]]
                else:
                    n = done + sum(self.piece_count(p) for p in self.pattern.findall(cut))
                yield at + m, n
            done += here[-1]
            at += len(piece)

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token counts of text[:0], text[:1], ..., text[:len(text)].

        A prefix that ends inside a special token's string holds that string's first
        characters as ordinary text.
        """
        out, lead, before = [0], 0, ""
        for part, special in self.parts(text):
            if special:
                start = lead - self.count(before)
                out.extend(start + n for end, n in self._tails(before + part[:-1]) if end > len(before))
                lead, before = lead + 1, ""
                out.append(lead)
            else:
                out.extend(lead + n for _, n in self._tails(part))
                lead, before = lead + self.count(part), part
        return out

    def truncate(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        return self.measure(text, budget)[1]

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """Token count of a text and code points of its longest prefix with at most ``budget`` tokens."""
        parts = self.parts(text)
        cut = [([], [1]) if special else self._counted(part) for part, special in parts]
        sizes = [sum(counts) for _, counts in cut]
        n = sum(sizes)
        if n <= budget:
            return n, len(text)
        p = total = at = 0
        while total + sizes[p] <= budget:
            total, at, p = total + sizes[p], at + len(parts[p][0]), p + 1
        if parts[p][1]:
            pieces = cut[p - 1][0] if p else []
            return n, self._within(pieces, len(pieces), parts[p][0][:-1], total, budget, at)
        pieces, counts = cut[p]
        behind = parts[p + 1][0][:-1] if p + 1 < len(parts) else ""
        after = list(accumulate(counts, initial=total))
        k = bisect_right(after, budget) - 1
        return n, self._within(pieces, k, behind, after[k], budget, at + sum(map(len, pieces[:k])))

    def _within(self, pieces: list[str], k: int, behind: str, total: int, budget: int, at: int) -> int:
        """The longest prefix within the budget where piece k, which starts at ``at`` after
        ``total`` tokens, is over it. Only white space before it, itself and the piece
        after it can be cut differently by an earlier end."""
        back = k - 1 if k and pieces[k - 1].isspace() else k
        for piece in pieces[back:k]:
            total, at = total - self.piece_count(piece), at - len(piece)
        part = "".join(pieces[back : k + 2]) + (behind if k + 2 >= len(pieces) else "")
        return at + max((end for end, n in self._tails(part) if total + n <= budget), default=0)


@lru_cache(2)
def _counter(content: bytes) -> PrefixCounter:
    return PrefixCounter(content)


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int) -> DataFrame:
    """n_bytes, n_tokens, over_limit and chars_within (code points of the longest prefix
    of at most ``limit`` tokens) of every row of docs (doc_id, text)."""
    with open(tokenizer_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under a few MB

    def run(batch):
        counter = _counter(content.value)
        rows = []
        texts = batch.column("text")
        for first in range(0, len(texts), 256):
            for text in texts.slice(first, 256).to_pylist():
                text = text or ""
                n, within = counter.measure(text, limit)
                rows.append((len(text.encode()), n, n > limit, within))
        yield [batch.column("doc_id"), *zip(*rows, strict=True)]

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(kept, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


LIMIT = 512


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
