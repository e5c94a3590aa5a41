"""Best-fit packing of tokenized documents into sequences of bounded length.

Every text becomes its token ids and an end id; only what is longer than a sequence is
cut, into whole sequences and one rest.  The packing is planned on the histogram of piece
lengths, never on pieces: lengths from the largest down take the fullest open sequences
they fit into, many equal sequences at a time, as best fit would place them one by one.
The plan says which ranks of a length stand in which sequences; a piece finds its slot by
its rank among the pieces of its length.

Ranks come without sorting: a task numbers its own pieces of each length, the numbered
pieces are written down, and counts by task and length are summed up to the first rank of
each.  The driver holds the histogram, one row a length, and the plan.  A length opens or
splits at most four groups of equal sequences, and a group is met again by a smaller
length each time, so the plan is bounded by the sequence's length alone (4,096: 16,384
groups of at most 90 lengths), however many documents there are.

Texts are encoded piece by piece, each distinct piece of a slice once.  Words of ASCII and
Latin letters are cut as the tokenizer's pattern cuts them (runs of letters, single
digits, runs of others) on whole arrays of bytes; all other words, and those that hold an
apostrophe or a ``<``, are pieces as a whole and go through the library's tokenizer with
its normalizer, pattern and special tokens.  Pieces of the first kind need only the
merges, which another library's merge loop does: a token's rank is that of the merge
that makes it, and the end of a word is a byte that no text has.  Joining by the rank of
the joined token equals joining by pairs as long as every token is the encoding of its own
bytes, so tokens that are not are left out; no text gets them.  Files with other
normalizers, patterns or added-token flags are refused.

Defined results: null or empty text is the end id alone; repeated rows and null ids each
give their pieces; other columns are ignored; an empty table gives no rows.  Memory is
bounded by slices of a few MB or one text.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches, stored, tidy
from .words import Words, slices

#: Production parameters: ids in a sequence, and the id that ends a document.
SIZE, END = 4096, 1

SLICE_BYTES = 4 << 20
CACHE_WORDS = 100_000

#: Kinds of bytes in words of ASCII and of letters up to U+017F: letter, digit, other.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1
#: Bytes that make a word one of the library's: leads of other scripts, apostrophe, less-than.
_LIBRARY = np.zeros(256, bool)
_LIBRARY[0xC0:0x100] = True
_LIBRARY[0xC3:0xC6] = False
_LIBRARY[[39, 60]] = True
#: Characters of the Latin range that are no letters or have a lower case of two characters.
_LIBRARY_PAIRS = ["\u00d7", "\u00f7", "\u0130"]
_WORD_END = b"\xff"

#: The tokenizer's normalizers and pattern.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Pieces(Words):
    """Pieces of the texts of a slice; ``whole``: those that are words for the library."""

    def __init__(self, column: pa.Array, first: int = 0, stop: int | None = None):
        super().__init__(column, first, stop, hashes=False)
        data, n = self.data, len(self.data)
        bad = _LIBRARY[data]
        for pair in _LIBRARY_PAIRS:
            lead, follow = pair.encode()
            bad[:-1] |= (data[:-1] == lead) & (data[1:] == follow)
        count = np.zeros(n + 1, np.int32)
        np.cumsum(bad, out=count[1:])
        library = count[self.end] > count[self.start]
        inside = np.zeros(n + 1, np.int8)  # 1 in words to be cut
        inside[self.start[~library]] += 1
        inside[self.end[~library]] -= 1
        kind = _KIND[data]
        cut = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        cut[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cut[self.start] = True
        cut[: self.start[0] if len(self.start) else n] = False
        start = np.flatnonzero(cut)
        word = np.searchsorted(self.start, start, "right") - 1
        end = np.minimum(np.append(start[1:], n), self.end[word]) if len(start) else start
        self.start, self.end, self.whole = start, end, library[word]
        self.rows = np.searchsorted(self.start, self.offsets)
        self.hash = self.lane(0)


class WordEncoder:
    """Ids of texts, piece by piece, as the library's tokenizer gives them."""

    def __init__(self, content: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(content)
        cut = spec.get("pre_tokenizer") or {}
        split = (cut.get("pretokenizers") or [{}])[0]
        letters = len(cut.get("pretokenizers") or []) == 2 and cut["pretokenizers"][1] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        model = spec["model"]
        merges_only = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk"))
        added = spec.get("added_tokens", [])
        if not (letters and plain and merges_only) or any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized")) or not all(t["content"].startswith("<") for t in added):
            raise ValueError("only the word tokenizer's normalizers, pattern and merges are known here")
        self.tokenizer = Tokenizer.from_buffer(content)
        self.known: dict[bytes, list[int]] = {}
        ranks, self.ids = _ranks(model)
        self.merge = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _library(self, words: list[bytes]) -> list[list[int]]:
        out = list(map(self.known.get, words))
        new = [k for k, x in enumerate(out) if x is None]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
        for k in new:
            out[k] = self.tokenizer.encode(words[k].decode(), add_special_tokens=False).ids
            if len(words[k]) <= 64 and len(self.known) < CACHE_WORDS:
                self.known[words[k]] = out[k]
        return out

    def encode(self, w: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one more than texts)."""
        first, of = w.distinct()
        raw, merge = w.data.tobytes(), self.merge
        whole = w.whole[first]
        pieces = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        merged = [merge((p.lower() if p.isascii() else p.decode().lower().encode()) + _WORD_END) for p, library in zip(pieces, whole.tolist(), strict=True) if not library]
        found = self._library([pieces[k] for k in np.flatnonzero(whole)])
        flat = np.concatenate([self.ids[np.fromiter(chain.from_iterable(merged), np.int64)], np.fromiter(chain.from_iterable(found), "<u4")])
        each = np.empty(len(pieces), np.int64)
        each[~whole] = np.fromiter(map(len, merged), np.int64, len(merged))
        each[whole] = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.empty(len(pieces), np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([each[~whole], each[whole]]))[:-1]])[: len(pieces)]
        begin[~whole], begin[whole] = ends[: len(merged)], ends[len(merged) :]
        counts = each[of]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begin[of] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[w.rows]


def _ranks(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks by token bytes (a word's end is one byte more), and the id of each rank."""
    from .prefix_counts import _byte_letters

    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s.removesuffix("</w>")) + _WORD_END * s.endswith("</w>")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t.removesuffix("</w>"))}
    singles = [bytes([b]) for b in range(256)]
    # a last byte and the end are one symbol from the start, so they join before all merges
    order = [b + _WORD_END for b in singles] + singles + [a + b for a, b in pairs if _encoded(a + b, pairs) == [a + b]]
    ranks = {t: k for k, t in enumerate(dict.fromkeys(order))}
    return ranks, np.array([ids.get(t, 0) for t in ranks], "<u4")


def _encoded(token: bytes, pairs: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The merges of one token's bytes."""
    body = token.removesuffix(_WORD_END)
    parts = [body[k : k + 1] for k in range(len(body))]
    if token != body:
        parts[-1] += _WORD_END
    while len(parts) > 1:
        rank, at = min((pairs.get((parts[k], parts[k + 1]), 1 << 40), k) for k in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(2)
def _encoder(content: bytes) -> WordEncoder:
    return WordEncoder(content)


def numbered_pieces(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, (ids,) part and
    place (the piece's number among those of its length in task ``part``)."""
    with open(tokenizer_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under a few MB
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * ids

    def pieces(batch, seen):
        column = batch.column(1)
        for first, stop in slices(column, SLICE_BYTES):
            flat, begin = _encoder(content.value).encode(Pieces(column, first, stop))
            flat = np.insert(flat, begin[1:], end).astype("<u4")
            begin += np.arange(len(begin))
            total = np.diff(begin)
            parts = -(-total // size)
            doc = np.repeat(np.arange(stop - first), parts)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = number * size
            length = np.minimum(size, total[doc] - start)
            at = begin[doc] + start
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, head, many = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - np.repeat(head - seen[kinds], many)
            seen[kinds] += many
            columns = [batch.column(0).slice(first, stop - first).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), TaskContext.get().partitionId()), pa.int32()), pa.array(place)]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, begin[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    @tidy
    def run(batches):
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            yield from pieces(batch, seen)

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return small_batches(kept).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * ids)


def best_fit(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Slots of ranks, and how many sequences they take.

    A slot row (length, first rank, sequence, per, offset): from that rank on, pieces of
    the length go ``per`` to a sequence, the first at ``offset``, into consecutive sequences.
    """
    slots, sequences = [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    rooms = 0  # bit r: open_[r] is not empty

    def put(room: int, first: int, many: int) -> None:
        nonlocal rooms
        if room and many:
            open_.setdefault(room, []).append((first, many))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, many = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            else:
                room, first = size, sequences
                many = -(-left // (size // length))
                sequences += many
            per = room // length
            full = min(many, left // per)
            slots.append((length, rank, first, per, size - room))
            put(room - per * length, first, full)
            rank, left, first, many = rank + full * per, left - full * per, first + full, many - full
            if many and left:
                put(room - left * length, first, 1)
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            put(room, first, many)
    return np.array(slots, np.int64).reshape(-1, 5), sequences


_RANKS = 1 << 44


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece."""
    pieces = stored(numbered_pieces(docs, tokenizer_file, size, end, ids))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: at most size
    plan = docs.sparkSession.sparkContext.broadcast(best_fit(histogram, size)[0])
    ranked = pieces.join(bases, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("rank", F.col("base") + F.col("place"))
    carried = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    @tidy
    def run(batches):
        slots = plan.value
        key = slots[:, 0] * _RANKS + slots[:, 1]
        order = np.argsort(key)
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            slot = slots[order[np.searchsorted(key[order], length * _RANKS + rank, "right") - 1]]
            step = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(slot[:, 2] + step // slot[:, 3]), pa.array(slot[:, 4] + step % slot[:, 3] * length)], names=[*carried, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * ids + "sequence_id long, offset long"
    return ranked.select(*carried, "rank").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (array<int>) of every sequence of pieces packed with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
