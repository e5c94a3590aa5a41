"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut by the pre-tokenizer's pattern; each piece is encoded by itself.  A
segment tree over the piece's byte positions holds, for every live symbol, the rank
of the pair it forms with its next live neighbour; each node keeps the leftmost
position of the least rank, so the root names the next merge.  A merge changes the
pairs of two live neighbours and drops one position: three logarithmic updates.

Encoded pieces are kept per worker, as words repeat: a young table takes over what is met
again from the last one, which it then replaces. Digests keep two of DIGEST_PIECES entries
(under 200 MB); encoding, which also holds ids, two of ENCODE_PIECES, and these go with the
ranks when a task ends, for a worker outlives its tasks.

Defined results: null text is empty and has no tokens; very long pieces cost
n log n; repeated rows and null ids each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import map_batches

NONE = 1 << 40
DIGEST_PIECES, ENCODE_PIECES = 400_000, 100_000


class Ranks:
    """Token bytes by id and ids by token bytes, from a rank file's content."""

    def __init__(self, content: bytes, pattern: str, most: int = ENCODE_PIECES):
        self.most = most
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.pattern = regex.compile(pattern)
        self.by_digits = {str(i): t for i, t in self.tokens.items()}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        return [whole] if whole is not None else merge(piece, self.ids)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p.encode())]

    def encode_digits(self, text: str) -> str:
        """Ids of a text as decimal numbers joined by commas."""
        pieces = self.pieces(text)
        found = list(map(self.young.get, pieces))
        if None in found:
            for k, digits in enumerate(found):
                if digits is None:
                    found[k] = self._digits(pieces[k])
        return ",".join(found)

    def _digits(self, piece: str) -> str:
        digits = self.young.get(piece)
        if digits is None:
            digits = self.old.get(piece)
            if digits is None:
                digits = ",".join(map(str, self.encode_piece(piece.encode())))
            if len(piece) <= 64:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[piece] = digits
        return digits

    def decode_digits(self, digits: str) -> bytes:
        return b"".join(map(self.by_digits.__getitem__, digits.split(","))) if digits else b""

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def merge(piece: bytes, ids: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the least-ranked adjacent pair, leftmost first, until none has a rank."""
    n = len(piece)
    if n < 2:
        return [ids[piece]] if n else []
    get = ids.get
    leaves = 1 << (n - 1).bit_length()
    low = [NONE] * (2 * leaves)  # low[v]: least rank below v; the place is found by going down left first
    for k in range(n - 1):
        low[leaves + k] = get(piece[k : k + 2], NONE)
    for v in range(leaves - 1, 0, -1):
        a, b = low[2 * v], low[2 * v + 1]
        low[v] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(k: int, rank: int) -> None:
        v = leaves + k
        low[v] = rank
        v >>= 1
        while v:
            a, b = low[2 * v], low[2 * v + 1]
            least = a if a <= b else b
            if low[v] == least:
                return
            low[v] = least
            v >>= 1

    while (least := low[1]) < NONE:
        v = 1
        while v < leaves:
            v *= 2
            if low[v] != least:
                v += 1
        k = v - leaves
        gone = after[k]
        to = after[k] = after[gone]
        put(gone, NONE)
        if to < n:
            before[to] = k
            put(k, get(piece[k : after[to]], NONE))
        else:
            put(k, NONE)
        if (left := before[k]) >= 0:
            put(left, get(piece[left:to], NONE))
    out, k = [], 0
    while k < n:
        out.append(ids[piece[k : after[k]]])
        k = after[k]
    return out


@lru_cache(2)
def _ranks(content: bytes, pattern: str, most: int) -> Ranks:
    return Ranks(content, pattern, most)


def _encoded(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool) -> DataFrame:
    with open(rank_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under a few MB

    def run(batch):
        ranks = _ranks(content.value, pattern, ENCODE_PIECES if keep_ids else DIGEST_PIECES)
        texts, counts, ids_sha, back_sha, ids = batch.column("text"), [], [], [], []
        for first in range(0, len(texts), 256):
            for text in texts.slice(first, 256).to_pylist():
                digits = ranks.encode_digits(text or "")
                counts.append(digits.count(",") + 1 if digits else 0)
                ids_sha.append(hashlib.sha256(digits.encode()).hexdigest())
                back_sha.append(hashlib.sha256(ranks.decode_digits(digits)).hexdigest())
                if keep_ids:
                    ids.append(np.array(digits.split(",") if digits else [], np.int32))
        columns = [batch.column("doc_id"), counts, ids_sha, back_sha]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
        yield columns

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(kept, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, _ranks.cache_clear if keep_ids else None)


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row of docs (doc_id, text)."""
    return _encoded(docs, rank_file, pattern, True)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id and decoded (binary) of rows with ids."""
    with open(rank_file, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batch):
        ranks = _ranks(content.value, "", ENCODE_PIECES)
        yield [batch.column("doc_id"), pa.array([ranks.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())]

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    return _encoded(docs, rank_file, pattern, False)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
