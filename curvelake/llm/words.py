"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  White space of
that kind is ASCII, so it can be found on UTF-8 bytes without decoding.  Every
word gets a hash of 64 bits in each of LANES lanes; a lane mixes the word's bytes
eight at a time by a finaliser that is not linear, and words beyond LONG bytes go
through BLAKE2b, so no family of words collides by its form.  A window's hash is
mixed from those of its halves.  Two lanes are 128 bits.
Work goes over slices of a few MB, so memory does not grow with a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .storage import small_batches, tidy

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Where each lane begins, for words and for windows.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
LONG = 256
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first, end) row ranges of at most ``limit`` bytes of text, one row at least."""
    offsets = text_buffers(column)[1]
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(end, n)
        first = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class Words:
    """Words of the rows [first, end) of a column.

    start, end: byte places within ``data``; rows: word counts before each row,
    one more than rows; hash: 64 bits of each word; hash2: the second lane.
    """

    def __init__(self, column: pa.Array, first: int = 0, stop: int | None = None, lower: bool = False, hashes: bool = True):
        stop = len(column) if stop is None else stop
        data, offsets = text_buffers(column.slice(first, stop - first))
        self.offsets = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        n = len(self.data)
        if n:
            solid = ~SPACE[self.data]
            cut = np.zeros(n + 1, bool)
            cut[self.offsets] = True
            begins = solid.copy()
            begins[1:] &= ~solid[:-1] | cut[1:n]
            ends = solid
            ends[:-1] &= ~solid[1:] | cut[1:n]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.rows = np.searchsorted(self.start, self.offsets)
        self.lower = lower
        self.hash = self.lane(0) if hashes else None

    def lane(self, k: int) -> np.ndarray:
        """Lane k of every word's hash."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = LOWER[self.data] if self.lower else self.data
        eights = np.ndarray(len(self.data) + 1, "<u8", data, 0, (1,))  # the eight bytes from each place on
        size = self.end - self.start
        out = mix(size.astype(_U) + _U(SEEDS[k]))
        live, done = np.flatnonzero(size <= LONG), 0
        while len(live):
            left = size[live] - done
            part = eights[self.start[live] + done]
            short = left < 8
            part[short] &= (_U(1) << (_U(8) * left[short].astype(_U))) - _U(1)
            out[live] = mix(out[live] ^ part)
            done += 8
            live = live[left > 8]
        for w in np.flatnonzero(size > LONG):
            digest = hashlib.blake2b(data[self.start[w] : self.end[w]], digest_size=16).digest()
            out[w] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each distinct word, and which of them every word is; words are
        told apart by both lanes."""
        import pandas as pd

        of, hashes = pd.factorize(self.hash)
        first = np.empty(len(hashes), np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        second = self.lane(1)
        if not np.array_equal(second, second[first][of]):
            both = np.stack([self.hash, second], axis=1)
            _, first, of = np.unique(both, axis=0, return_index=True, return_inverse=True)
        return first, of.reshape(-1)

    def within(self, width: int) -> np.ndarray:
        """Whether ``width`` words from each window start on belong to one row."""
        n = max(0, len(self.start) - width + 1)
        last = np.repeat(self.rows[1:], np.diff(self.rows))[:n]
        return np.arange(n) + width <= last


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on: mixed from the hashes of windows of
    powers of two, the widest first."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, at, have, part = None, 0, 1, words
    wide = [words]
    while have * 2 <= width:
        part = mix(part[:-have] * _U(0x9E3779B97F4A7C15) + part[have:])
        have *= 2
        wide.append(part)
    for k in range(len(wide) - 1, -1, -1):
        if width >> k & 1:
            piece = wide[k][at : at + n]
            out = mix(piece + _U(width)) if out is None else mix(out * _U(0x9E3779B97F4A7C15) + piece)
            at += 1 << k
    return out


def few_words_hash(words: np.ndarray) -> int:
    """Hash of a whole short sequence of words, apart from those of full windows."""
    return int(window_hashes(words, len(words))[0])


def map_batches(df, function, schema: str, after=None):
    """df through ``function`` (a batch to an iterator of batches), Arrow batch by batch;
    ``after`` is called when a task ends."""
    arrow = arrow_schema(schema)

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    @tidy
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            if after is not None:
                after()

    return small_batches(df).mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])
