"""N-gram Jaccard join over parity sketches.

A text's set holds its distinct 5-word shingles (A-Z lowered); texts link when the
sets' Jaccard similarity is at least THRESHOLD_PERCENT.  Texts of equal sets are one
node, so copies cost nothing further.

Sketch: a hash sends each shingle to one of P blocks and to one of the block's 2^32
bits, which it flips; a block is kept as the XOR of its set bits' hashes, since few of
them are set.  Two sets whose sketches differ in h bits differ in at least h shingles,
so linked sets, which differ in at most (a + b) / 9 of theirs (at 80 %), differ in at
most that many blocks.  As the other set has at most 5 / 4 of its shingles, a set of n
differs from any linked one in at most n / 4 blocks: it keeps its n / 4 + 1 least common
blocks (by one global order: empty ones are the commonest, then by how many nodes share
the block) and may drop all others; the least common equal block stays in both.  Band c
takes sets of its size range and those within reach of it from the band below.

Candidates from equal blocks pass a size filter and parity sketches of the whole set, of
256 bits and of a bit a shingle, then are verified on the texts.  A block shared by many
nodes is not turned into all its pairs: its least node and its hubs are verified against
the others, links form components, and only blocks that still hold several components are
open.  In an open block of up to SMALL nodes, nodes of different components meet.  In a
larger one every node x is replaced by X, the shingles in which it differs from one node c,
the hub of the block's largest component; a node linked to c joins that component at once.
If x isn't linked to c, a set y linked to x must share at least
(|X| + |Y| - (|x| + |y|) / 9) / 2 > 0 shingles with X in its own Y, so prefixes of X and Y in
one order find every such pair: what c doesn't hold comes first, then what it alone holds.
What a group of near copies has in common is in no X, and its nodes meet one hub, not each other.

Defined results: null or empty text has an empty set (0 shingles), is linked with
nothing and is its own component; with fewer than five words the whole sequence is
one shingle; null ids are kept and take no part in naming components; rows of one id
are one vertex for naming; other columns are ignored, whatever their names and types.
Texts and sets are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, released, stored, tidy
from .words import Words, few_words_hash, map_batches, mix, slices, window_hashes

WORDS, THRESHOLD_PERCENT = 5, 80
#: Nodes of a block that are held before they are written; larger blocks are counted after that.
HELD = 64
#: Open blocks of up to so many nodes are compared pair by pair: a pair meets in some twenty
#: blocks, a node has some fifty shingles in which it differs from a hub.
SMALL = 8
#: Ids are broadcast up to so many rows (16 MB at most); beyond, tables are joined by id.
BROADCAST_ROWS = 400_000
#: Hubs of a block that meet the nodes outside their components before all others do.
HUBS = 4
_U = np.uint64


@lru_cache(1)
def bands() -> list[tuple[int, int, int]]:
    """(first size, d, P) of each band; a band's sizes are above 1.5 times the last's."""
    t, out, first = THRESHOLD_PERCENT, [], 4
    while first < 1 << 40:
        nxt = -(-first * 25 // 16)
        d = 2 * (nxt - 1) * (100 - t) // (100 + t)
        out.append((first, d, d + 1 + max(1, (d + 1) // 4)))
        first = nxt
    return out


_FIRST = np.array([b[0] for b in bands()])


def bands_of(n: int) -> list[int]:
    """The bands in which a set of n shingles takes part."""
    own = int(np.searchsorted(_FIRST, n, "right")) - 1
    if own < 0:
        return []
    reach = n * 100 // THRESHOLD_PERCENT
    return [own, own + 1] if reach >= _FIRST[own + 1] else [own]


def shingle_sets(words: Words):
    """The sorted distinct shingle hashes of each row."""
    windows = window_hashes(words.hash, WORDS)
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(windows[a : b - WORDS + 1])
        elif b > a:
            yield np.array([few_words_hash(words.hash[a:b])], _U)
        else:
            yield np.zeros(0, _U)


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; the first half is its node but where two sets share that."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def most_apart(n: int) -> int:
    """In how many shingles a set of n can differ from a linked one: (n + m) / 9 at 80 % with m at most 5 n / 4."""
    t = THRESHOLD_PERCENT
    return (n + n * 100 // t) * (100 - t) // (100 + t)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Four words of 64 bits, a parity sketch of the whole set."""
    out = np.zeros(4, _U)
    np.bitwise_xor.at(out, (shingles >> _U(6) & _U(3)).astype(np.int64), _U(1) << (shingles & _U(63)))
    return out.view(np.int64)


def wide_parity(shingles: np.ndarray) -> bytes:
    """A parity sketch of at least a bit for each shingle, in a power of two of bits."""
    size = max(256, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 256
    odd = np.bincount((shingles >> _U(20) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_distance(x: bytes, y: bytes) -> int:
    """Differing bits of two wide sketches, the larger folded to the size of the other: a
    folded sketch is that of the same set over fewer bits."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), 0)).sum())


def blocks(shingles: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Keys of a set's blocks that are not empty, and how many more blocks may be dropped.

    The lowest bit of a key is the band's lowest bit.
    """
    _, d, p = bands()[band]
    d = min(d, most_apart(len(shingles)))
    h = mix(shingles + _U(band + 1))
    word = np.zeros(p, _U)
    # the hash of a block is the XOR of its set bits' hashes: a bit flipped twice cancels
    np.bitwise_xor.at(word, ((h >> _U(32)) * _U(p) >> _U(32)).astype(np.int64), mix((h & _U(0xFFFFFFFF)) + _U(0x9E3779B97F4A7C15)))
    number = np.arange(p, dtype=_U)
    empty = word == 0
    drops = p - 1 - d - int(empty.sum())
    if drops >= 0:
        word, number = word[~empty], number[~empty]
    else:  # more empty blocks than may be dropped: the last ones by number stay
        spare = np.flatnonzero(empty)[: p - 1 - d]
        word, number, drops = np.delete(word, spare), np.delete(number, spare), 0
    key = mix(word ^ mix(number + (_U(band) << _U(32))))
    return (key & ~_U(1) | _U(band & 1)).view(np.int64), drops


def _sets(rows: DataFrame) -> DataFrame:
    """Each row's size, node, parity sketch, and drops by the band's lowest bit."""

    def run(batch):
        column, out = batch.column("_text"), []
        for first, end in slices(column):
            for s in shingle_sets(Words(column, first, end, lower=True)):
                drops = [0, 0]
                for band in bands_of(len(s)):
                    drops[band & 1] = blocks(s, band)[1]
                out.append((len(s), *node_of(s), *parity(s).tolist(), *drops, wide_parity(s)))
        yield [batch.column("t0"), batch.column("t1"), batch.column("doc_id"), *zip(*out, strict=True)]

    return map_batches(rows, run, "t0 long, t1 long, doc_id long, n long, node long, node2 long, p0 long, p1 long, p2 long, p3 long, drop0 int, drop1 int, wide binary")


def _keys(docs: DataFrame, renamed: dict) -> DataFrame:
    """(key, node) of all blocks of all sets, once within a batch."""

    def run(batch):
        column = batch.column("_text")
        seen, keys, nodes = set(), [], []
        for first, end in slices(column):
            for s in shingle_sets(Words(column, first, end, lower=True)):
                halves = node_of(s)
                node = renamed.get(halves, halves[0])
                if len(s) < _FIRST[0] or node in seen:
                    continue
                seen.add(node)
                for band in bands_of(len(s)):
                    k = blocks(s, band)[0]
                    keys.append(k)
                    nodes.append(np.full(len(k), node))
        if keys:
            yield [np.concatenate(keys), np.concatenate(nodes)]

    return map_batches(docs.select("_text"), run, "key long, node long")


@tidy
def _shared(batches):
    """Of rows sorted by key and node: those whose key has two nodes or more, with the
    number of its nodes, HELD at most, and its least node. At most HELD rows of a key
    are held."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("nodes", pa.int64()), ("leader", pa.int64())])

    def out(keys, nodes, counts, leaders):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(leaders, pa.int64())], schema=schema)

    def whole(key, nodes, count, leader):
        return out(np.full(len(nodes), key), nodes, np.full(len(nodes), count), np.full(len(nodes), leader))

    last_key, last_node, held, many, lead = None, None, [], False, None
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        if key[0] == last_key and node[0] == last_node:
            new[0] = False
        last_seen = (key[-1], node[-1])
        key, node = key[new], node[new]
        if not len(key):
            continue
        begin = 0
        if last_key is not None and key[0] == last_key:
            begin = int(np.searchsorted(key, last_key, "right"))
            if many:
                yield whole(last_key, node[:begin], HELD, lead)
            else:
                held.append(node[:begin])
                if sum(map(len, held)) >= HELD:
                    yield whole(last_key, np.concatenate(held), HELD, lead)
                    held, many = [], True
        if begin < len(key):
            if held and (n := sum(map(len, held))) > 1:
                yield whole(last_key, np.concatenate(held), n, lead)
            held, many = [], False
            key, node = key[begin:], node[begin:]
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.append(cut, len(key)))
            tail = cut[-1]
            each = np.repeat(size, size)[:tail]
            keep = each > 1
            if keep.any():
                yield out(key[:tail][keep], node[:tail][keep], np.minimum(each[keep], HELD), np.repeat(node[cut], size)[:tail][keep])
            rest, lead = node[tail:], node[tail]
            if len(rest) >= HELD:
                yield whole(key[tail], rest, HELD, lead)
                many = True
            else:
                held = [rest]
        last_key, last_node = last_seen
    if held and (n := sum(map(len, held))) > 1:
        yield whole(last_key, np.concatenate(held), n, lead)


def _within(a: str, b: str) -> Column:
    """Whether the sizes and parity sketches of two nodes allow a link."""
    t = THRESHOLD_PERCENT
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(4)), F.lit(0))
    return (100 * F.least(n, m) >= t * F.greatest(n, m)) & (bits * (100 + t) <= (n + m) * (100 - t))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide sketches allow a link."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("wide").alias(f"wide_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    t = THRESHOLD_PERCENT

    def run(batch):
        total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        far = np.array([wide_distance(x, y) for x, y in zip(batch.column("wide_a").to_pylist(), batch.column("wide_b").to_pylist(), strict=True)])
        keep = pa.array(far * (100 + t) <= total * (100 - t))
        yield [batch.column("a").filter(keep), batch.column("b").filter(keep)]

    return map_batches(joined.select("a", "b", "n_a", "n_b", "wide_a", "wide_b"), run, "a long, b long")


def _texts(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text), stored, of the nodes of the pairs (a, b); pairs is a stored table."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "t0", "t1"), "node")
    few = 2 * pairs.count() <= BROADCAST_ROWS
    texts = docs.select("t0", "t1", "_text").join(F.broadcast(named) if few else named, ["t0", "t1"])
    return stored(texts.groupBy("node").agg(F.first("_text").alias("text")))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts link; pairs is a stored table."""
    texts = _texts(pairs, nodes, docs)
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batch):
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        left, right = batch.column("text_a"), batch.column("text_b")
        link, last, known = np.zeros(len(a), bool), None, None
        at = 0
        for first, end in slices(right):
            for s in shingle_sets(Words(right, first, end, lower=True)):
                if a[at] != last:
                    last, known = a[at], next(shingle_sets(Words(left, at, at + 1, lower=True)))
                both = len(np.intersect1d(known, s, assume_unique=True))
                link[at] = 100 * both >= THRESHOLD_PERCENT * (len(known) + len(s) - both)
                at += 1
        yield [a[link], b[link]]

    out = stored(map_batches(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long"))
    dropped(texts)
    released(docs.sparkSession)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each end of the edges (a, b) can reach."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        step = stored(step.join(onward, "label").select("node", "old", F.least("label", "onward").alias("label")))
        dropped(labels)
        labels = step.select("node", "label")
        if step.where("label != old").isEmpty():
            dropped(both)
            return labels


def _labelled(rows: DataFrame, labels: DataFrame, few: bool, *columns: tuple[str, str]) -> DataFrame:
    """rows with the components of nodes, (column, name) each; a node without links is its own."""
    for column, name in columns:
        other = labels.select(F.col("node").alias(column), F.col("label").alias("_l"))
        rows = rows.join(F.broadcast(other) if few else other, column, "left").withColumn(name, F.coalesce("_l", column)).drop("_l")
    return rows


def _star_pairs(rows: DataFrame, info: DataFrame) -> DataFrame:
    """rows (node, leader): distinct pairs (leader, node) that the filters allow."""
    pairs = rows.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    out = pairs.join(info.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(info.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return out.where(_within("x", "y")).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, renamed: dict) -> DataFrame:
    """Edges (a, b) between nodes that give the components of all links.

    docs: t0, t1, _text; nodes: node, n, t0, t1, p0..p3, drop0, drop1, wide.
    """
    info = nodes.select("node", F.struct("n", "p0", "p1", "p2", "p3").alias("sketch"))
    shared = stored(_keys(docs, renamed).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, nodes long, leader long"))
    released(docs.sparkSession)
    tested = [stored(_plausible(_star_pairs(shared, info), nodes))]
    edges = [_verified(tested[0], nodes, docs)]
    labels = components(edges[0])
    few = labels.count() <= BROADCAST_ROWS

    # blocks in which some node is outside the least node's component
    marked = _labelled(shared, labels, few, ("node", "label"), ("leader", "leading"))
    keys = stored(marked.where("label != leading").select("key").distinct())
    some = keys.count() <= BROADCAST_ROWS
    mixed = shared.join(F.broadcast(keys) if some else keys, "key", "left_semi")
    # of these, those that neither node may drop as one of its most common
    even = F.col("key").bitwiseAND(F.lit(1)) == 0
    order = Window.partitionBy("node", even).orderBy(F.desc("nodes"), "key")  # a set's blocks: bounded by its text
    large = shared.where(F.col("nodes") >= HELD).groupBy("key").agg(F.count("*").alias("_n"))
    own = shared.join(mixed.select("node").distinct(), "node", "left_semi").select("key", "node", "nodes")
    own = own.join(large, "key", "left").withColumn("nodes", F.coalesce("_n", "nodes")).drop("_n")
    ranked = own.join(nodes.select("node", "drop0", "drop1"), "node").withColumn("_k", F.row_number().over(order))
    kept = ranked.where(F.col("_k") > F.when(even, F.col("drop0")).otherwise(F.col("drop1"))).select("key", "node")
    kept = stored(kept.join(F.broadcast(keys) if some else keys, "key", "left_semi"))
    dropped(shared, keys)
    released(docs.sparkSession)

    # a block's hubs, the nodes with most company in all their blocks, stand nearest to what a
    # group of near copies was made from; they meet the nodes outside their components
    size = kept.groupBy("key").agg(F.count("*").alias("size"))
    central = kept.join(size, "key").groupBy("node").agg(F.sum("size").alias("central"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("central"), "node"))
    hubs = stored(kept.join(central, "node").withColumn("rank", rank).where(F.col("rank") <= HUBS).select("key", F.col("node").alias("leader"), "rank"))
    met = _labelled(kept.join(hubs, "key"), labels, few, ("node", "label"), ("leader", "leading")).where("label != leading")
    ordered = met.select(F.least("node", "leader").alias("leader"), F.greatest("node", "leader").alias("node"))
    pairs = _star_pairs(ordered, info).join(_all(tested), ["a", "b"], "left_anti")
    tested.append(stored(_plausible(pairs, nodes)))
    edges.append(_verified(tested[-1], nodes, docs))
    labels = components(_all(edges))
    few = labels.count() <= BROADCAST_ROWS
    # blocks that hold several components still
    labelled = _labelled(kept, labels, few, ("node", "label"))
    open_blocks = stored(labelled.join(_leading(labelled), "key").join(info, "node"))
    centres = stored(_labelled(central, labels, few, ("node", "label")).groupBy("label").agg(F.max_by("node", F.struct("central", "node")).alias("hub")))
    small = open_blocks.where(F.col("size") <= SMALL)
    x = small.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("sketch").alias("x"))
    y = small.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("sketch").alias("y"))
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _within("x", "y")).select("a", "b")
    large = open_blocks.where(F.col("size") > SMALL)
    around = large.join(centres.select(F.col("label").alias("leading"), "hub"), "leading")
    around = stored(around.select("hub", "leading", "node", "label", F.col("sketch.n").alias("n")).distinct())
    found, near = _around_hubs(around, nodes, docs)
    edges.append(near)
    pairs = pairs.union(found).distinct()
    last = stored(_plausible(pairs.join(_all(tested), ["a", "b"], "left_anti"), nodes))
    edges.append(_verified(last, nodes, docs))
    dropped(open_blocks, centres, kept, hubs, around, last, *tested)
    return _all(edges)


def _around_hubs(around: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes of one hub and different components that may link, one of them
    at least not linked to the hub; and edges (a, b) from hubs to nodes of other components.
    around, a stored table: hub, leading (its component), node, label, n."""
    t = THRESHOLD_PERCENT
    pairs = around.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "leading", "label", "n")
    texts = _texts(pairs, nodes, docs)
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batch):
        hubs, mine = batch.column("a").to_pylist(), batch.column("text_a")
        texts, last, known = batch.column("text_b"), None, None
        apart_of = batch.column("leading").to_numpy() != batch.column("label").to_numpy()
        at = 0
        for first, end in slices(texts):
            rows, facts, parts, starts = [], [], [], []
            for s in shingle_sets(Words(texts, first, end, lower=True)):
                if hubs[at] != last:
                    last, known = hubs[at], next(shingle_sets(Words(mine, at, at + 1, lower=True)))
                added, gone = np.setdiff1d(s, known, assume_unique=True), np.setdiff1d(known, s, assume_unique=True)
                gap, total = len(added) + len(gone), len(s) + len(known)
                # not linked to the hub: gap > (n + n_hub) / 9
                far = gap * (100 + t) > total * (100 - t)
                # shared with a set that isn't linked to the hub: more than (gap + (n_hub - n) / 9) / 2
                least = (gap * (100 + t) + (len(known) - len(s)) * (100 - t)) // (2 * (100 + t)) + 1
                early = gap - least + 1
                apart = np.concatenate([added, gone])
                joins = not far and apart_of[at]  # an edge: a row of place 0
                parts.append(apart if far else np.concatenate([np.zeros(int(joins), _U), apart[: max(early, 0)]]))
                starts.append(0 if joins else 1)
                rows.append(at)
                facts.append((gap, far, early))
                at += 1
            of = np.repeat(np.arange(len(rows)), [len(x) for x in parts])
            place = np.concatenate([np.arange(a, a + len(x)) for a, x in zip(starts, parts, strict=True)])
            column = lambda name: batch.column(name).to_numpy()[rows][of]  # noqa: B023, E731
            gap, far, early = (np.array(x)[of] for x in zip(*facts, strict=True))
            yield [column("a"), column("b"), column("label"), column("n"), gap, place, far, (place > 0) & (place <= early), np.concatenate(parts).view(np.int64)]

    schema = "hub long, node long, label long, n long, gap long, place long, far boolean, early boolean, shingle long"
    apart = stored(map_batches(joined.select("a", "b", "leading", "label", "n", "text_a", "text_b"), run, schema))
    x = apart.where("far").select("hub", "shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "label", "n", "gap", "place", "early")])
    y = apart.where("early").select("hub", "shingle", *[F.col(c).alias(f"{c}_y") for c in ("node", "label", "n", "gap", "place", "far")])
    need = F.ceil(((F.col("gap_x") + F.col("gap_y")) * (100 + t) - (F.col("n_x") + F.col("n_y")) * (100 - t)) / (2 * (100 + t)))
    met = x.join(y, ["hub", "shingle"]).where("label_x != label_y AND (NOT far_y OR (early_x AND node_x < node_y))")
    met = met.where((F.col("place_x") <= F.col("gap_x") - need + 1) & (F.col("place_y") <= F.col("gap_y") - need + 1))
    met = met.where(100 * F.least("n_x", "n_y") >= t * F.greatest("n_x", "n_y"))
    out = stored(met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())
    near = stored(apart.where("place = 0").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    dropped(texts, apart)
    return out, near


def _leading(labelled: DataFrame) -> DataFrame:
    """(key, size, leading): the blocks that hold several components, how many nodes, and the
    largest component."""
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
    whole = counts.groupBy("key").agg(F.sum("k").alias("size"), F.max_by("label", F.struct("k", "label")).alias("leading"), F.count("*").alias("labels"))
    return whole.where("labels > 1").drop("labels")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out


def _text_key(text) -> tuple:
    """128 bits of a text as two columns."""
    return F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1")


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*_text_key(text), text.alias("_text"), F.col("doc_id").cast("long").alias("doc_id"))


def _renamed(nodes: DataFrame) -> dict:
    """Other names for nodes that share a first half: one set in 2^64 / n of n sets."""
    twice = nodes.groupBy("node").agg(F.min("node2").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = nodes.select("node", "node2").join(twice.select("node", "least"), "node").where("node2 != least")
    return {(r["node"], r["node2"]): r["name"] for r in rows.select("node", "node2", F.xxhash64("node", "node2").alias("name")).collect()}


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text and others): t0, t1 (of its text), doc_id,
    n_shingles, component_id (the least doc_id that links reach)."""
    rows = _prepared(docs)
    sets = stored(_sets(rows))
    filled = sets.where("n > 0")
    texts = F.min(F.struct("t0", "t1")).alias("_t")  # of one text
    nodes = filled.groupBy("node", "node2").agg(texts, F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3", "drop0", "drop1", "wide")])
    nodes = stored(nodes.select("*", "_t.t0", "_t.t1").drop("_t"))
    if renamed := _renamed(nodes):
        names = docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "node long, node2 long, _name long")
        rename = lambda df: df.join(F.broadcast(names), ["node", "node2"], "left").withColumn("node", F.coalesce("_name", "node")).drop("_name")
        nodes, sets = stored(rename(nodes)), rename(sets)
        filled = sets.where("n > 0")
    labels = components(links(rows, nodes, renamed))
    named = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # rows of one id with several texts tie their components together
    several = filled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    if not several.isEmpty():
        ties = filled.join(several.select("doc_id", "a"), "doc_id").where("node != a").select("a", F.col("node").alias("b"))
        joined = ties.union(labels.where("node != label").select(F.col("label").alias("a"), F.col("node").alias("b")))
        named = nodes.select("node", "rep").join(components(joined), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "label").select("node", "component_id")
    out = sets.join(by_node, "node", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("t0", "t1", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, one for each component: that of its least doc_id, of rows
    of one id the one of the least text hash, and of rows alike in both one. Rows with an
    empty text or a null id stay."""
    found = stored(near_duplicates(docs).where("n_shingles > 0 AND doc_id IS NOT NULL"))
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min(F.struct("t0", "t1")).alias("_t"), F.count("*").alias("_n"))
    # rows that go: another id than the component's least, or its id with another text
    others = found.where("doc_id != component_id").select("doc_id", "t0", "t1").distinct()
    several = first.where("_n > 1")
    others = stored(others.union(found.join(several, "doc_id").where(F.struct("t0", "t1") != F.col("_t")).select("doc_id", "t0", "t1").distinct()))
    few = others.count() <= BROADCAST_ROWS
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), *_text_key(F.col("text").cast("string")))
    kept = whole.join(F.broadcast(others) if few else others, ["doc_id", "t0", "t1"], "left_anti")
    again = stored(several.select("doc_id", "_t.t0", "_t.t1"))
    if again.isEmpty():
        return kept.select("_doc.*")
    few = again.count() <= BROADCAST_ROWS
    marked = kept.join((F.broadcast(again) if few else again).withColumn("_again", F.lit(True)), ["doc_id", "t0", "t1"], "left")
    one = marked.where("_again").groupBy("doc_id").agg(F.first("_doc").alias("_doc"))
    return marked.where("_again IS NULL").select("_doc.*").union(one.select("_doc.*"))


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS to_id FROM d UNION SELECT r.doc_id, d.b FROM reach r JOIN d ON d.a = r.to_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS c FROM reach GROUP BY doc_id) c USING (doc_id)
"""
