"""Substring dedup: a count-min prefilter, then exact counts of what may repeat.

A window is WIDTH consecutive words of one text.  Every window has an anchor: of its
GRAM-word grams the one with the least hash, leftmost of equals.  Equal windows have
equal anchors at the same place in them, so two windows of equal words at different
starts have anchors of equal grams at different starts, and the number of places at
which an anchor's gram is an anchor is at least the number of the window's starts.

Pass 1 counts anchor places in a count-min sketch: each partition sends the cells it
touched, merged cell segment by cell segment; cells stop at two.  An estimate below
two proves a window unique.  Pass 2 sends only windows estimated repeated and counts
them exactly, by 128 bits of their words; those that turn out to stand once are sent
back to their text by its hash, each with its own.  Pass 3 removes the words that
repeated windows cover.  Nothing is lost: the sketch only overestimates, and what it
overestimates is undone exactly.

The sketch has CELLS cells in each of ROWS rows at 2 bits, 32 MB however large the
table is; a fuller sketch sends more windows to pass 2, up to all of them.

Defined results: null or empty text has no words and keeps the empty text; repeated
rows repeat each other's windows; null ids are kept; texts of fewer than WIDTH words
are kept whole; other columns are kept as they are, whatever their names and types.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import released, small_batches, tidy
from .words import Words, map_batches, mix, slices, window_hashes

WIDTH, GRAM = 35, 8
CELLS, ROWS, SEGMENT = 1 << 26, 2, 1 << 20
_U = np.uint64


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows, the number of each one's anchor place, and the gram's
    hash at each anchor place."""
    grams = window_hashes(words.hash, GRAM)
    starts = np.flatnonzero(words.within(WIDTH))
    if not len(starts):
        return starts, starts, np.zeros(0, _U)
    n, span, step, low = len(words.hash) - WIDTH + 1, WIDTH - GRAM + 1, 1 << 20, _U((1 << 24) - 1)
    least = np.empty(n, np.int64)
    for c in range(0, n, step):
        part = grams[c : min(n, c + step) + span - 1]
        # 40 bits of hash before the place: the least is the leftmost of the least grams
        key = (part & ~low) | np.arange(len(part), dtype=_U)
        have = 1
        while have * 2 <= span:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        rest = span - have
        key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        least[c : c + len(key)] = (key & low).astype(np.int64) + c
    place = least[starts]
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    return starts, np.cumsum(new) - 1, grams[place[new]]


def cells(hashes: np.ndarray, row: int) -> np.ndarray:
    return (mix(hashes + _U(0x9E3779B97F4A7C15 * (row + 1) & (2**64 - 1))) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


@tidy
def _sketch_part(batches):
    """Touched cells of a partition, by row and segment: positions and counts of at most two."""
    schema = pa.schema([("slot", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
    held, size = [], 0

    def flush():
        hashes = np.concatenate(held)
        for row in range(ROWS):
            at, n = np.unique(cells(hashes, row), return_counts=True)
            segment = at // SEGMENT
            cut = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
            slots, positions, counts = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                slots.append(row * (CELLS // SEGMENT) + int(segment[a]))
                positions.append((at[a:b] % SEGMENT).astype(np.uint32).tobytes())
                counts.append(np.minimum(n[a:b], 2).astype(np.uint8).tobytes())
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(positions, pa.binary()), pa.array(counts, pa.binary())], schema=schema)

    for batch in batches:
        column = batch.column(0)
        for first, end in slices(column):
            h = anchors(Words(column, first, end))[2]
            if len(h):
                held.append(h)
                size += len(h)
        if size > 500_000:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


@tidy
def _merge_parts(batches):
    """The sum of each segment's parts, cells at two at most, four cells to a byte."""
    schema = pa.schema([("slot", pa.int32()), ("bits", pa.binary())])
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held = total.setdefault(slot, np.zeros(SEGMENT, np.uint8))
            at = np.frombuffer(at, np.uint32)
            held[at] = np.minimum(held[at] + np.frombuffer(n, np.uint8), 2)  # positions of a part are distinct
    for slot, held in total.items():
        bits = held[0::4] | held[1::4] << 2 | held[2::4] << 4 | held[3::4] << 6
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([bits.tobytes()], pa.binary())], schema=schema)


def build_sketch(docs: DataFrame):
    """The merged sketch as a broadcast dictionary of packed segments, 32 MB at most."""
    parts = small_batches(docs.select("_text")).mapInArrow(_sketch_part, "slot int, cells binary, counts binary")
    merged = parts.repartition(F.col("slot")).mapInArrow(_merge_parts, "slot int, bits binary")
    packed = {r["slot"]: bytes(r["bits"]) for r in merged.collect()}
    released(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(packed)


def estimates(sketch: dict[int, bytes], hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is counted at least twice in every row of the sketch."""
    out = np.ones(len(hashes), bool)
    for row in range(ROWS):
        live = np.flatnonzero(out)
        at = cells(hashes[live], row)
        order = np.argsort(at)
        at = at[order]
        segment = at // SEGMENT
        cut = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
        twice = np.zeros(len(at), bool)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            bits = sketch.get(row * (CELLS // SEGMENT) + int(segment[a]))
            if bits is not None:
                place = at[a:b] % SEGMENT
                twice[a:b] = (np.frombuffer(bits, np.uint8)[place >> 2] >> (2 * (place & 3)).astype(np.uint8)) & 3 >= 2
        out[live[order]] = twice
    return out


def _suspects(words: Words, sketch: dict[int, bytes]) -> np.ndarray:
    """First words of the windows estimated repeated."""
    starts, number, hashes = anchors(words)
    return starts[estimates(sketch, hashes)[number]] if len(starts) else starts


def candidate_windows(docs: DataFrame, sketch) -> DataFrame:
    """(h, h2, spot, row): windows estimated repeated, once within a slice of texts; spot is
    twice the place of the first word in its text, and one more where the slice repeats it."""

    def run(batch):
        column, rows = batch.column("_text"), batch.column("_row").to_numpy()
        for first, end in slices(column):
            w = Words(column, first, end)
            at = _suspects(w, sketch.value)
            if not len(at):
                continue
            h, h2 = (window_hashes(words, WIDTH)[at] for words in (w.hash, w.lane(1)))
            order = np.lexsort((h2, h))
            h, h2, at = h[order], h2[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            one = np.flatnonzero(new)
            many = np.diff(np.append(one, len(h))) > 1
            at = at[one]
            doc = np.searchsorted(w.rows, at, "right") - 1
            yield [h[one].view(np.int64), h2[one].view(np.int64), 2 * (at - w.rows[doc]) + many, rows[first:end][doc]]

    return map_batches(docs.select("_text", "_row"), run, "h long, h2 long, spot long, row long")


def _covered(w: Words, at: np.ndarray) -> np.ndarray:
    """Which words the windows beginning at ``at`` cover."""
    began = np.zeros(len(w.start) + WIDTH + 1, np.int64)
    began[at] = 1
    began = np.cumsum(began)
    n = len(w.start)
    out = began[:n] > 0
    out[WIDTH:] = began[WIDTH:n] > began[: max(0, n - WIDTH)]
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: _doc (the row, a struct), _n_words, _n_removed, _kept_sha256
    and _kept: the kept words joined by spaces where words were removed, else null."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), text.alias("_text"), F.xxhash64(text).alias("_row"))
    sketch = build_sketch(rows)
    counted = candidate_windows(rows, sketch).groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("spot").alias("spot"), F.min("row").alias("_row"))
    falsely = counted.where("n = 1 AND spot % 2 = 0").groupBy("_row").agg(F.collect_list(F.struct((F.col("spot") / 2).cast("long").alias("place"), "h")).alias("_false"))  # bounded by a text's words
    joined = rows.join(falsely, "_row", "left").select("_doc", "_text", "_false")
    new = T.StructType([T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept_sha256", T.StringType()), T.StructField("_kept", T.StringType())])

    @tidy
    def run(batches):
        for batch in batches:
            column, false = batch.column(1), batch.column(2)
            n_words, n_removed, digests, texts = [], [], [], []
            for first, end in slices(column):
                w = Words(column, first, end)
                at = _suspects(w, sketch.value)
                if len(at):
                    at = np.setdiff1d(at, _unique(w, false, first, end))
                gone = _covered(w, at)
                raw = w.data.tobytes()
                for a, b in zip(w.rows[:-1], w.rows[1:], strict=True):
                    kept = np.flatnonzero(~gone[a:b]) + a
                    text = b" ".join([raw[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True)])
                    n_words.append(b - a)
                    n_removed.append(b - a - len(kept))
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode() if n_removed[-1] else None)
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_doc", *new.names])

    return small_batches(joined).mapInArrow(run, T.StructType([joined.schema["_doc"], *new.fields]))


def _unique(w: Words, false, first: int, end: int) -> np.ndarray:
    """First words of the windows that pass 2 found once: those sent to a text by its hash
    whose own hash stands at the place."""
    hashes, out = None, [np.zeros(0, np.int64)]
    for k in range(first, end):
        if sent := false[k].values:
            hashes = window_hashes(w.hash, WIDTH).view(np.int64) if hashes is None else hashes
            at = w.rows[k - first] + sent.field(0).to_numpy()
            own = sent.field(1).to_numpy()[at + WIDTH <= w.rows[k - first + 1]]
            at = at[at + WIDTH <= w.rows[k - first + 1]]
            out.append(at[hashes[at] == own])
    return np.concatenate(out)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return remove_repeats(docs).select("_doc.doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns; a text that lost words becomes its kept words joined by spaces."""
    whole = {c: F.col("_doc").getField(c) for c in docs.columns}
    whole["text"] = F.coalesce("_kept", whole["text"])
    if "n_chars" in whole:
        whole["n_chars"] = F.when(F.col("_kept").isNull(), whole["n_chars"]).otherwise(F.length("_kept")).cast(docs.schema["n_chars"].dataType)
    return remove_repeats(docs).select(*[c.alias(name) for name, c in whole.items()])


_WORD = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT r, k, md5(array_to_string(w[k:k + {WIDTH - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WIDTH - 2})) AS k FROM d)),
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, k + j AS k FROM again, range({WIDTH}) v(j)),
word AS (SELECT r, k, w[k] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
