"""Mixing sources to target weights with a low-discrepancy schedule.

Slot k of the mix gets the point frac((k + 1) * golden ratio); mapped through the
cumulative shares of the slots that targets need it names a source, so every stretch of
the mix holds the sources near their shares.  A source's slots are ranked; its documents
are shuffled by a hash and laid end to end, and the stream is cut into blocks of BLOCK
tokens (words).  The r-th slot takes block r modulo the number of blocks; slots are taken
until the source's target is met, the last one in part, so no document is used more
than MAX_EPOCHS times.  The few slots that the points leave a source short of follow
after all others, so every source's target is met exactly (rounded up to a word).

A document stands in the mix at the slot of the first block it has words in, once for
each pass; the mixed rows come in that order.  A pass takes a source's blocks from the
first on, so what it takes of a document in part are its first words.

Ranks and places in streams come from counts by chunk (slots) or by bucket (shuffled
documents) whose prefix sums are small tables, so no source is sorted in one task.  Rows
alike in all columns are one row with a count until their places are known.  The driver
holds a row for each source.

Defined results: null or empty text has size 0 and is never taken; null source is a
source of its own, ordered last; repeated rows are documents of their own; null ids
are kept; an empty table gives no rows; other columns may have any name and type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
BLOCK = 64
CHUNK = 1 << 14
BUCKETS = 4096
#: Copies of a row that one task lays out.
COPIES = 1 << 16
GOLDEN = (math.sqrt(5) - 1) / 2


def count_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return True  # hashes skip null fields, JSON names those that are there
    return isinstance(kind, (T.MapType, T.VariantType))


def row_key(docs: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits of a row's columns, h0 and h1."""
    values = [F.to_json(F.col(c)) if _holds_map(docs.schema[c].dataType) else F.col(c) for c in columns]
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.lit("v")) for c in columns])
    return [F.xxhash64(nulls, *values).alias("h0"), F.xxhash64(F.lit(1), nulls, *values).alias("h1")]


def share_out(sizes: dict, weights: dict) -> dict:
    """Targets: shares of SHARE_PERCENT of all sizes by weight, at most MAX_EPOCHS times
    a source's size; what is over goes to the others by weight until none is above."""
    total = sum(sizes.values()) * SHARE_PERCENT / 100
    target, free = {s: 0.0 for s in sizes}, dict.fromkeys(s for s in sizes if sizes[s] > 0)
    left = total
    while free:
        whole = sum(weights[s] for s in free)
        full = [s for s in free if left * weights[s] / whole > MAX_EPOCHS * sizes[s]]
        if not full:
            for s in free:
                target[s] = left * weights[s] / whole
            break
        for s in full:
            target[s] = float(MAX_EPOCHS * sizes[s])
            free.pop(s)
        left = total - sum(target.values())
    return target


def slots_needed(size: int, target: float) -> int:
    """Slots that take ceil(target) tokens; the last block of an epoch may be short but has a slot."""
    epochs, rest = divmod(math.ceil(target), size) if size else (0, 0)
    return epochs * -(-size // BLOCK) + -(-rest // BLOCK)


def plan(spark, sizes: DataFrame) -> DataFrame:
    """A row per source: source, sid, source_size, target, slots (that the target needs), low,
    high (its share of [0, 1), by slots).

    What comes to the driver is one row per source.
    """
    rows = {r["source"]: r["size"] for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    order = sorted(rows, key=lambda s: (s is None, s or ""))
    weights = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    target = share_out(rows, weights)
    need = {s: slots_needed(rows[s], target[s]) for s in order}
    whole, low, out = sum(need.values()), 0.0, []
    for k, s in enumerate(order):
        high = low + (need[s] / whole if whole else 0.0)
        out.append((s, k, rows[s], target[s], need[s], low, high))
        low = high
    return spark.createDataFrame(out, "source string, sid int, source_size long, target double, slots long, low double, high double")


def schedule(spark, sources: DataFrame) -> DataFrame:
    """Slots in order: slot, sid, rank (of the slot within its source, from 0).

    Every source has the slots its target needs at least: ranks that the points do not
    reach come after all others, in turn by source (their slot numbers leave gaps).
    """
    known = sources.collect()
    n = sum(r["slots"] for r in known)
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    point = point - F.floor(point)
    # shares are found by cells of [0, 1): as many as sources, so the table is of their size
    cells = max(1, len(known))
    cell = F.least(F.floor(F.col("point") * cells), F.lit(cells - 1)).cast("int")
    live = sources.where("slots > 0")
    # the last share ends at 1 but for rounding
    last = live.agg(F.max("sid")).first()[0]
    shares = live.select("sid", "low", F.when(F.col("sid") == F.lit(last), F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    cover = F.sequence(F.least(F.floor(F.col("low") * cells), F.lit(cells - 1)).cast("int"), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)).cast("int"))
    shares = F.broadcast(shares.withColumn("cell", F.explode(cover)))  # a row or two for each source, from the driver
    drawn = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    drawn = drawn.withColumn("cell", cell).join(shares, "cell").where("low <= point AND point < high")
    drawn = drawn.select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    ranked = drawn.withColumn("own", own).join(chunks.select("sid", "chunk", F.coalesce(before, F.lit(0)).alias("before")), ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("before") + F.col("own") - 1).alias("rank"))
    # a source's points differ from its share by a few at any n, so few ranks are missing
    got = chunks.groupBy("sid").agg(F.sum("n").alias("got"))
    short = sources.select("sid", "slots").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    rest = short.select("sid", "got", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    rest = rest.select((F.lit(n) + (F.col("rank") - F.col("got")) * len(known) + F.col("sid")).alias("slot"), "sid", "rank")
    return ranked.unionByName(rest)


def streams(groups: DataFrame) -> DataFrame:
    """groups (h0, h1, n, sid, size), n rows of one size each, with ``start``: the place of
    the first of them in their source's shuffled stream; the others follow at once."""
    marked = groups.withColumn("bucket", F.pmod("h0", F.lit(BUCKETS)))
    whole = F.col("n") * F.col("size")
    sums = marked.groupBy("sid", "bucket").agg(F.sum(whole).alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    w = Window.partitionBy("sid", "bucket").orderBy("h0", "h1").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("inner", F.coalesce(F.sum(whole).over(w), F.lit(0))).join(sums, ["sid", "bucket"])
    return placed.withColumn("start", F.col("before") + F.col("inner")).drop("bucket", "inner", "before")


def copies(placed: DataFrame) -> DataFrame:
    """A row for each copy: h0, h1, copy, sid, size, start."""
    parts = placed.select("h0", "h1", "sid", "size", "start", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    parts = parts.repartition("h0", "h1", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    out = parts.select("h0", "h1", "sid", "size", "start", F.explode(F.sequence(F.col("part") * COPIES, last)).alias("copy"))
    return out.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def taken_blocks(slots: DataFrame, sources: DataFrame) -> DataFrame:
    """For each block of a source's stream and each pass that takes it: (sid, block, epoch,
    slot, take), its first ``take`` tokens."""
    size, target = F.col("source_size"), F.ceil("target").cast("long")
    blocks = F.ceil(size / BLOCK).cast("long")
    small = F.broadcast(sources.select("sid", "source_size", target.alias("goal"), blocks.alias("blocks")))  # a row per source, from the driver
    s = slots.join(small, "sid").where("blocks > 0")
    block, epoch = F.pmod("rank", "blocks"), F.floor(F.col("rank") / F.col("blocks")).cast("long")
    begin = block * BLOCK
    length = F.least(F.lit(BLOCK), size - begin)
    left = F.col("goal") - epoch * size - begin
    return s.select("sid", block.alias("block"), epoch.alias("epoch"), "slot", F.least(length, left).alias("take")).where("take > 0")


def _mixed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: h0, h1, source, size, and others.  Sources as plan gives them, one of each group
    of rows alike in h0 and h1 (a stored table), and a row for each row:
    h0, h1, copy, sid, size, words and slots (arrays by pass: words taken, and the slot of
    the first block with one of them, null where none is taken)."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("source").alias("source"), *[F.first(c).alias(c) for c in rows.columns if c not in ("h0", "h1", "source", "size")]))
    sources = plan(spark, groups.select("source", (F.col("n") * F.col("size")).alias("size")))
    small = F.broadcast(sources.select(F.col("source").alias("own_source"), "sid"))  # a row per source, from the driver
    sized = groups.join(small, F.col("source").eqNullSafe(F.col("own_source"))).select("h0", "h1", "n", "sid", "size")
    placed = copies(streams(sized))
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    taken = spans.join(taken_blocks(schedule(spark, sources), sources), ["sid", "block"])
    begin = F.col("block") * BLOCK
    overlap = F.least(begin + F.col("take"), F.col("start") + F.col("size")) - F.greatest(begin, F.col("start"))
    taken = taken.withColumn("overlap", overlap).where("overlap > 0")
    by_pass = [(F.col("epoch") == e) for e in range(MAX_EPOCHS)]
    sums = [F.sum(F.when(p, F.col("overlap")).otherwise(0)).alias(f"words{e}") for e, p in enumerate(by_pass)]
    firsts = [F.min(F.when(p, F.col("slot"))).alias(f"slot{e}") for e, p in enumerate(by_pass)]
    got = taken.groupBy("h0", "h1", "copy").agg(*sums, *firsts)
    out = placed.join(got, ["h0", "h1", "copy"], "left")
    words = F.array(*[F.coalesce(f"words{e}", F.lit(0)).cast("long") for e in range(MAX_EPOCHS)])
    return sources, groups, out.select("h0", "h1", "copy", "sid", "size", words.alias("words"), F.array(*[f"slot{e}" for e in range(MAX_EPOCHS)]).alias("slots"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of docs (source, text and the columns ``keep``) with size, source_size,
    target, taken, ``passes`` (words taken in each pass) and ``slots`` (where each pass
    puts the row in the mix, null where it takes nothing of it)."""
    known = list(dict.fromkeys([*keep, "source", "text"]))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), *row_key(docs, known))
    sources, groups, mixed = _mixed(rows)
    small = F.broadcast(sources.select("sid", "source_size", "target"))  # a row per source, from the driver
    out = mixed.join(groups.select("h0", "h1", "kept"), ["h0", "h1"]).join(small, "sid")
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], "size", "source_size", "target", total.alias("taken"), F.col("words").alias("passes"), "slots")


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space between words as it is."""
    ends = F.split(text, r"(?<=[^ \t-\r])(?=[ \t-\r])")  # each part but the last ends with a word
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mix_stage(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, as often as the mix takes them and in its order; where a
    pass takes a document in part, the row's text is the first of its words."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), *row_key(docs, docs.columns))
    got = _mixed(rows.select("h0", "h1", "source", "size"))[2]
    got = got.select("h0", "h1", "size", F.explode(F.arrays_zip("words", "slots")).alias("p")).where("p.words > 0")
    got = got.select("h0", "h1", F.when(F.col("p.words") < F.col("size"), F.col("p.words")).alias("_cut"), F.col("p.slots").alias("_slot"))
    # rows alike in all columns give one text each, dealt to their places
    out = rows.groupBy("h0", "h1").agg(F.first("_doc").alias("_doc")).join(got, ["h0", "h1"])
    out = out.repartitionByRange("_slot").sortWithinPartitions("_slot", "h0", "h1")
    whole = {c: F.col("_doc").getField(c) for c in docs.columns}
    cut = F.col("_cut").isNotNull()
    whole["text"] = F.when(cut, first_words(whole["text"].cast("string"), F.col("_cut"))).otherwise(whole["text"])
    if "n_chars" in whole:
        whole["n_chars"] = F.when(cut, F.length(whole["text"])).otherwise(whole["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(name) for name, c in whole.items()])
