"""Periodic runs of words by partition refinement.

Crochemore's refinement: positions of a text are in one class of length l where the l
words from them on are the same.  Going from l to l + 1 splits a class by the classes of
the positions one further on; of the parts a class was split into, all but the largest
alive one name the positions to look at next, so a position is looked at a logarithmic
number of times.  Each class keeps its positions linked in order; the link from a
position to its neighbour, if it is l long at length l, is a square of period l whose
root is no power.  Squares of one period at consecutive positions are merged into runs.

All texts of a slice of a few MB are refined together with array operations.  A
run of ``times`` periods or more gives every class that its squares stand in
``times - 1`` members, so smaller classes are given up: exactly the runs asked for are
found, with their whole extent.  Lengths end at a text's n / times words.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; words are told apart by 128 bits.

Defined results: null or empty text, and text of white space, has no runs and an empty
collapsed text; repeated rows and null ids give a row each; other columns are ignored;
an empty table gives no rows.  A text is one unit of work, however long; memory grows
with its words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, tidy
from .words import SPACE, Words, map_batches, slices

#: Production parameters: periods in a run at least, and words in a run at least.
TIMES, LEAST_WORDS = 4, 6


#: Texts that are refined together.
SLICE_BYTES = 4 << 20
#: So many positions are taken one by one.
_FEW = 12


class _Refinement:
    """Classes of positions of several texts laid end to end.

    ``label`` names each word, texts apart; ``limit`` is the last length that matters at
    each position, ``ends`` where each text ends.  Slot n of every array stands for no
    position.
    """

    def __init__(self, label: np.ndarray, limit: np.ndarray, ends: np.ndarray, least: int):
        n = self.n = len(label)
        self.least, self.limit, self.ends = least, limit, ends
        self.cls = np.append(label, 0)
        self.size = np.zeros(2 * n + int(label.max(initial=0)) + 2, np.int64)
        self.labels = int(label.max(initial=-1)) + 1
        counts = np.bincount(label, minlength=self.labels)
        self.size[: self.labels] = counts
        self.alive = np.append(counts[label] >= least, False)
        self.next = np.full(n + 1, n)
        self.before = np.full(n + 1, n)
        self.since = np.ones(n + 1, np.int64)
        #: members of class c, and some that have left it, are pool[lo[c]:hi[c]]
        self.pool = np.argsort(label, kind="stable")
        self.filled = n
        self.lo, self.hi = np.zeros_like(self.size), np.zeros_like(self.size)
        self.hi[: self.labels] = np.cumsum(counts)
        self.lo[: self.labels] = self.hi[: self.labels] - counts
        self._link(self.pool[self.alive[self.pool]])
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _link(self, members: np.ndarray) -> None:
        """Neighbours of whole classes, given by class and position."""
        n = self.n
        same = self.cls[members[1:]] == self.cls[members[:-1]]
        self.next[members] = np.append(np.where(same, members[1:], n), n)[: len(members)]
        self.before[members] = np.insert(np.where(same, members[:-1], n), 0, n)[: len(members)]

    def _keep(self, members: np.ndarray, starts: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> None:
        """Puts the members of classes into the pool."""
        need = self.filled + len(members)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(members)), np.int64)])
        self.pool[self.filled : need] = members
        self.lo[label] = self.filled + starts
        self.hi[label] = self.filled + starts + sizes
        self.filled = need

    def _squares(self, at: np.ndarray, length: int) -> None:
        """Notes the links of these positions that were as long as the length at some time
        before ``length``."""
        gap = self.next[at] - at
        ok = (self.next[at] < self.n) & (self.since[at] <= gap) & (gap < length)
        if ok.any():
            self.found.append((at[ok], gap[ok]))

    def _members(self, classes: np.ndarray, leaving: np.ndarray) -> np.ndarray:
        """Members of these classes that are not leaving, by class."""
        sizes = self.hi[classes] - self.lo[classes]
        ends = np.cumsum(sizes)
        each = np.repeat(self.lo[classes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        out = self.pool[each]
        return out[self.alive[out] & (self.cls[out] == np.repeat(classes, sizes)) & ~leaving[out]]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods of the squares."""
        n, alive = self.n, self.alive
        small = np.flatnonzero(alive[:n])
        dead = np.union1d(np.flatnonzero(~alive[:n]), self.ends)  # nothing follows a text's last word
        leaving = np.zeros(n + 1, bool)
        length = 1
        while len(small) or len(dead):
            length += 1
            if not len(small) and len(dead) <= _FEW and self._few(dead, length):
                dead = dead - 1
                continue
            dying = dead[dead > 0] - 1
            dying = dying[alive[dying] & (self.limit[dying] >= length)]
            alive[dying] = False
            moving = small[small > 0] - 1
            moving = moving[alive[moving] & (self.limit[moving] >= length)]
            small, dead = self._split(dying, moving, leaving, length)
        return self._all()

    def _few(self, dead: np.ndarray, length: int) -> bool:
        """The step where only the positions before a few dead ones die, one by one, as in
        the long middle of a run; False, and nothing done, where more happens."""
        before = [i for i in (dead - 1).tolist() if i >= 0 and self.alive[i] and self.limit[i] >= length]
        if len(before) < len(dead) or any(self.size[self.cls[i]] - len(before) < self.least for i in before):
            return False
        for i in before:
            left, right, since = int(self.before[i]), int(self.next[i]), int(self.since[i])
            if right < self.n and since <= right - i < length:
                self.found.append((np.array([i]), np.array([right - i])))
            if left < self.n:
                if self.since[left] <= i - left < length:
                    self.found.append((np.array([left]), np.array([i - left])))
                self.next[left] = right
                self.since[left] = length
            if right < self.n:
                self.before[right] = left
            self.alive[i] = False
            self.size[self.cls[i]] -= 1
        return True

    def _split(self, dying: np.ndarray, moving: np.ndarray, leaving: np.ndarray, length: int):
        n, cls, alive, size = self.n, self.cls, self.alive, self.size
        # parts that move: by class and by the class one further on
        key = cls[moving] * np.int64(self.labels + 1) + cls[moving + 1]
        order = np.lexsort((moving, key))
        moving, key = moving[order], key[order]
        first = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True)[: len(key)])
        part_size = np.diff(np.append(first, len(key)))
        part_class = cls[moving[first]]
        gone = np.concatenate([cls[dying], cls[moving]])
        touched, lost = np.unique(gone, return_counts=True)
        rest = size[touched] - lost
        # of each class the largest part stays: what did not move, or one of the parts
        largest = np.zeros(len(touched), np.int64)
        stays = np.full(len(touched), -1)
        if len(first):
            of = np.searchsorted(touched, part_class)
            by_size = np.lexsort((part_size, of))
            top = by_size[np.append(of[by_size][1:] != of[by_size][:-1], True)]
            largest[of[top]] = part_size[top]
            stays[of[top]] = top
        moved_stay = largest > rest
        # the rest of a class goes where a part is larger, and dies where it is too small
        goes = (rest > 0) & (moved_stay | (rest < self.least))
        leaving[moving] = True
        rests = self._members(touched[goes], leaving)
        leaving[moving] = False
        rest_dies = np.repeat(rest[goes] < self.least, rest[goes])
        staying = np.zeros(len(first), bool)
        staying[stays[moved_stay & (largest >= self.least)]] = True
        small_part = part_size < self.least
        part_of = np.repeat(np.arange(len(first)), part_size)
        dead = np.concatenate([dying, moving[small_part[part_of]], rests[rest_dies]])
        new = ~staying & ~small_part
        fresh_moving = moving[new[part_of]]
        fresh_rest = rests[~rest_dies]
        small = np.concatenate([fresh_moving, fresh_rest])
        out = np.concatenate([dead, small])
        # links: what leaves is cut out of its old class
        out = out[np.lexsort((out, cls[out]))]
        left = right = out[:0]
        if len(out):
            apart = self.next[out[:-1]] != out[1:]
            left = self.before[out[np.insert(apart, 0, True)]]
            right = self.next[out[np.append(apart, True)]]
            real = left < n
            self._squares(np.concatenate([out, left[real]]), length)
            self.next[left], self.before[right] = right, left
            self.since[left] = length
            self.next[n] = self.before[n] = n
        alive[dead] = False
        # classes: new labels for small parts, sizes and members for all
        size[touched] = rest
        if staying.any():
            kept = moving[staying[part_of]]
            sizes = part_size[staying]
            label = part_class[staying]
            size[label] = sizes
            self._keep(kept, np.cumsum(sizes) - sizes, sizes, label)
        gone_class = touched[(rest < self.least) & ~(moved_stay & (largest >= self.least))]
        size[gone_class] = 0
        if len(small):
            live_rest = goes & (rest >= self.least)
            sizes = np.concatenate([part_size[new], rest[live_rest]])
            label = self.labels + np.arange(len(sizes))
            self.labels += len(sizes)
            cls[small] = np.repeat(label, sizes)
            size[label] = sizes
            ordered = small[np.lexsort((small, cls[small]))]
            self._keep(ordered, np.cumsum(sizes) - sizes, sizes, label)
            self._link(ordered)
            self.since[ordered] = length
        return small, dead

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.alive[: self.n])
        gap = self.next[at] - at
        ok = (self.next[at] < self.n) & (self.since[at] <= gap) & (gap <= self.limit[at])
        self.found.append((at[ok], gap[ok]))
        return np.concatenate([a for a, _ in self.found]), np.concatenate([g for _, g in self.found])


def word_runs(label: np.ndarray, rows: np.ndarray, times: int = TIMES, least_words: int = LEAST_WORDS):
    """Runs of texts laid end to end: text number, start (in its text), length and period,
    by text, start and period.

    label: what each word is (texts apart); rows: words before each text, and all.
    """
    sizes = np.diff(rows)
    limit = np.repeat(sizes // times, sizes)
    at, period = _Refinement(label, limit, rows[1:], max(2, times - 1)).run()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    text = np.searchsorted(rows, at, "right") - 1
    apart = np.flatnonzero((np.diff(at) != 1) | (np.diff(period) != 0) | (np.diff(text) != 0)) + 1 if len(at) else np.zeros(0, np.int64)
    first = np.concatenate([np.zeros(min(1, len(at)), np.int64), apart])
    last = np.append(apart, len(at))[: len(first)] - 1
    start, p = at[first], period[first]
    length = at[last] - start + 2 * p
    ok = length >= np.maximum(least_words, times * p)
    start, length, p, text = start[ok], length[ok], p[ok], text[first][ok]
    start -= rows[text]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


def _labels(w: Words) -> np.ndarray:
    """A number for each word, the same for the same word of the same text only."""
    _, of = w.distinct()
    text = np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
    return np.unique(text * np.int64(of.max(initial=0) + 1) + of, return_inverse=True)[1]


def _collapsed(w: Words, dropped: np.ndarray) -> list[bytes]:
    """Each text's words that are not dropped, joined by a space."""
    keep = np.flatnonzero(~dropped)
    size = w.end[keep] - w.start[keep] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    solid = np.zeros(len(w.data) + 1, np.int64)
    solid[w.start[keep]] += 1
    solid[w.end[keep]] -= 1
    taken = np.cumsum(solid[:-1]) > 0
    is_word = np.ones(len(out), bool)
    is_word[ends - 1] = False
    out[is_word] = w.data[taken]
    raw = out.tobytes()
    cut = np.concatenate([[0], ends])[np.searchsorted(keep, w.rows)]
    return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, times: int = TIMES, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (array of struct<start, length, period> by start and period)
    and collapsed (the text's words without those that any run holds after its first
    period, joined by a space) of every row of docs (doc_id, text)."""

    def parts(batch):
        column = batch.column(1)
        for first, end in slices(column, SLICE_BYTES):
            w = Words(column, first, end)
            text, start, length, period = word_runs(_labels(w), w.rows, times, least_words)
            covered = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(covered, w.rows[text] + start + period, 1)
            np.add.at(covered, w.rows[text] + start + length, -1)
            collapsed = _collapsed(w, np.cumsum(covered[:-1]) > 0)
            offsets = np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(w.rows)), found.cast(_RUN), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    @tidy
    def run(batches):
        for batch in batches:
            yield from parts(batch)

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return small_batches(kept).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, of smallest start, then period, among them; null
    without runs."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a periodic tail in about every tenth text: of n words, and
    with h the CRC-32 of the decimal doc_id and g = h // 10, where h % 10 = 0 each word
    i >= a = g % n becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8)."""

    def run(batch):
        texts = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = zlib.crc32(str(doc).encode()) if doc is not None else 1
            words = _split(text) if h % 10 == 0 and text else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = " ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
            texts.append(text)
        yield [batch.column(0), pa.array(texts, pa.string())]

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string")


_SPACES = bytes(np.flatnonzero(SPACE).astype(np.uint8)).decode()
_BLANK = str.maketrans(dict.fromkeys(_SPACES, " "))


def _split(text: str) -> list[str]:
    return [x for x in text.translate(_BLANK).split(" ") if x]


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of periodic_runs' rows."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", "runs", "collapsed", "n_words", best_run(F.col("runs")).alias("best"))
    milli = (F.lit(1000) * F.col("best.length") - (F.lit(1000) * F.col("best.length")) % F.col("best.period")) / F.col("best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
