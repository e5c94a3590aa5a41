"""Baseline JPEG columns: markers, Huffman scans and DC-only thumbnails in numpy.

``decode`` parses the markers of a baseline file, decodes its one interleaved scan to
quantised coefficients and builds a thumbnail with one luminance pixel per 8x8 block
from the DC coefficients alone; no inverse transform is run.  Restart segments are
independent, so files with many of them are decoded in lockstep: one lane a segment,
each numpy step reading one symbol in every lane.  Files with few segments are
decoded symbol by symbol.

``store`` keeps a byte payload without loss as the format's units: each 64 bytes are
the coefficients of one grey 8x8 block, value minus 128, in the file's zigzag order,
every block a restart segment of its own.  A comment segment holds the payload size;
blocks that fill the last row hold no coefficients.  The Huffman tables give every
symbol and its value bits 16 bits together, so encoding is a table look-up.

Defined results: null text is empty and stored as one block of zero bytes; a null or
unreadable file gives null features; repeated rows each give a row; other columns
are ignored; memory is bounded by slices of a few MB, or one text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import map_batches, slices

#: Lanes from which the lockstep decoder is used.
LOCKSTEP = 24
WIDEST_ROW = 1024


class BadJpeg(ValueError):
    pass


# ---------------------------------------------------------------- tables


def huffman_codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a table given as counts of codes by length 1..16."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(lengths: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + code length; 0 where no code starts so."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in huffman_codes(lengths, symbols).items():
        a = code << (16 - length)
        out[a : a + (1 << (16 - length))] = symbol * 32 + length
    return out


def _unit_tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """DC and AC tables in which a symbol of s value bits has a code of 16 - s bits."""
    ac: dict[int, list[int]] = {}
    for size in range(1, 9):
        ac.setdefault(16 - size, []).extend(run << 4 | size for run in range(16))
    ac.setdefault(16, []).extend([0x00, 0xF0])
    dc = {16 - size: [size] for size in range(9)}

    def table(by_length):
        return [len(by_length.get(n, [])) for n in range(1, 17)], [s for n in range(1, 17) for s in by_length.get(n, [])]

    return table(dc), table(ac)


DC_TABLE, AC_TABLE = _unit_tables()
_DC, _AC = huffman_codes(*DC_TABLE), huffman_codes(*AC_TABLE)


def _units(codes: dict[int, tuple[int, int]], runs: int) -> np.ndarray:
    """[run, value + 128] -> the 16 bits of code and value bits."""
    out = np.zeros((runs, 256), np.uint16)
    for v in range(-128, 128):
        size = abs(v).bit_length()
        if size or runs == 1:
            bits = v if v > 0 else v + (1 << size) - 1
            for run in range(runs):
                code, length = codes[run << 4 | size]
                assert length + size == 16
                out[run, v + 128] = code << size | bits
    return out


_DC_UNIT, _AC_UNIT = _units(_DC, 1)[0], _units(_AC, 16)
_EOB, _ZRL = _AC[0x00][0], _AC[0xF0][0]


# ---------------------------------------------------------------- storing bytes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def store(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the bytes of a payload of 64 * n bytes."""
    n = len(payload) // 64
    across = min(n, WIDEST_ROW)
    down = -(-n // across)
    if down > 8191:
        across, down = 8191, -(-n // 8191)
    head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(payload)) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0))
    head += _segment(0xC4, b"\0" + bytes(DC_TABLE[0]) + bytes(DC_TABLE[1])) + _segment(0xC4, b"\x10" + bytes(AC_TABLE[0]) + bytes(AC_TABLE[1]))
    head += _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0, 0, 63, 0))
    values = np.frombuffer(payload, np.uint8).reshape(n, 64)
    return head + _scan(values, across * down) + b"\xff\xd9"


def _scan(values: np.ndarray, blocks: int) -> bytes:
    """Entropy-coded segments, with restart markers between them."""
    n = len(values)
    row, col = np.nonzero(values[:, 1:] != 128)
    col = col + 1
    last = np.zeros(len(col), np.int64)
    if len(col):
        last[1:] = np.where(row[1:] == row[:-1], col[:-1], 0)
    run = col - last - 1
    zrl = run >> 4
    units = 1 + zrl
    ends = np.ones(blocks, np.int64)  # the end-of-block unit; none where coefficient 63 is set
    ends[:n] = values[:, 63] == 128
    per_block = 1 + ends
    per_block[:n] += np.bincount(row, units, n).astype(np.int64)
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(per_block, out=start[1:])
    out = np.full(start[-1], _ZRL, np.uint16)
    out[start[:-1]] = _DC_UNIT[128]
    out[start[:n]] = _DC_UNIT[values[:, 0]]
    before = np.zeros(len(col) + 1, np.int64)
    np.cumsum(units, out=before[1:])
    first = np.searchsorted(row, np.arange(n))
    place = start[row] + 1 + before[1:] - 1 - before[first[row]] if len(col) else np.zeros(0, np.int64)
    out[place] = _AC_UNIT[run & 15, values[row, col]]
    done = ends.astype(bool)
    out[start[1:][done] - 1] = _EOB
    raw = out.astype(">u2").view(np.uint8)
    stuffed = raw == 0xFF
    shift = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(stuffed, out=shift[1:])
    # a restart marker of two bytes after each block but the last
    block = np.repeat(np.arange(blocks), per_block * 2)
    places = np.arange(len(raw)) + shift[:-1] + 2 * block
    scan = np.zeros(len(raw) + shift[-1] + 2 * (blocks - 1), np.uint8)
    scan[places] = raw
    marks = 2 * start[1:-1] + shift[2 * start[1:-1]] + 2 * np.arange(blocks - 1)
    scan[marks], scan[marks + 1] = 0xFF, 0xD0 + (np.arange(blocks - 1) & 7)
    return scan.tobytes()


# ---------------------------------------------------------------- reading


def parse(raw: bytes) -> dict:
    """Markers of a baseline file: frame, tables, restart interval, comments, and its scan's place."""
    if raw[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    out = {"dc": {}, "ac": {}, "quant": {}, "interval": 0, "comments": []}
    at = 2
    while True:
        while raw[at : at + 1] == b"\xff" and raw[at + 1 : at + 2] == b"\xff":
            at += 1
        if len(raw) < at + 4 or raw[at] != 0xFF:
            raise BadJpeg("a marker is missing")
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                step = 128 if wide else 64
                out["quant"][name] = np.frombuffer(body[k + 1 : k + 1 + step], ">u2" if wide else np.uint8).astype(np.int64)
                k += 1 + step
        elif marker in (0xC0, 0xC1):
            bits, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise BadJpeg("only samples of 8 bits")
            out["components"] = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("not a baseline file")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = list(body[k + 1 : k + 17])
                n = sum(lengths)
                out["ac" if body[k] >> 4 else "dc"][body[k] & 15] = (lengths, list(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out["comments"].append(body)
        elif marker == 0xDA:
            if "components" not in out:
                raise BadJpeg("a scan before its frame")
            own = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            for c in out["components"]:
                if c["id"] not in own:
                    raise BadJpeg("components in several scans")
                c["dc"], c["ac"] = own[c["id"]] >> 4, own[c["id"]] & 15
            return out | {"scan": at}
        elif marker == 0xD9:
            raise BadJpeg("no scan")


def _split_scan(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy bytes without stuffing and markers, and the segments' bounds in them."""
    nxt = np.zeros(len(scan), np.uint8)
    nxt[:-1] = scan[1:]
    high = scan == 0xFF
    other = np.flatnonzero(high & (nxt != 0) & (nxt != 0xFF) & ((nxt < 0xD0) | (nxt > 0xD7)))
    if len(other):
        scan, nxt, high = scan[: other[0]], nxt[: other[0]], high[: other[0]]
    restart = high & (nxt >= 0xD0) & (nxt <= 0xD7)
    drop = np.zeros(len(scan), bool)
    marks = np.flatnonzero(restart)
    drop[marks] = True
    drop[marks + 1] = True
    stuffing = np.flatnonzero(high & (nxt == 0)) + 1
    drop[stuffing[stuffing < len(scan)]] = True
    kept = np.zeros(len(scan) + 1, np.int64)
    np.cumsum(~drop, out=kept[1:])
    return scan[~drop], np.concatenate([[0], kept[marks], [kept[-1]]])


def decode(raw: bytes, dc_only: bool = False) -> dict:
    """parse()'s result with ``blocks``, a component's int16 array of blocks in coding
    order and zigzag coefficients, and ``thumbnail``."""
    return _decode_many([raw], dc_only)[0]


def _decode_many(files: list[bytes], dc_only: bool = False) -> list[dict]:
    """decode() of several files; those with equal tables and one component share lanes."""
    out, groups = [], {}
    for k, raw in enumerate(files):
        info = parse(raw)
        data, bounds = _split_scan(np.frombuffer(raw, np.uint8)[info["scan"] :])
        comps = info["components"]
        hs, vs = max(c["h"] for c in comps), max(c["v"] for c in comps)
        if len(comps) == 1:
            comps[0]["h"] = comps[0]["v"] = hs = vs = 1
        info["across"], info["down"] = -(-info["width"] // (8 * hs)), -(-info["height"] // (8 * vs))
        info["mcus"] = info["across"] * info["down"]
        out.append(info)
        lanes = -(-info["mcus"] // info["interval"]) if info["interval"] else 1
        if len(bounds) - 1 < lanes:
            raise BadJpeg("restart segments are missing")
        bounds = bounds[: lanes + 1]
        if len(comps) == 1 and lanes > 1:
            c = comps[0]
            key = (info["interval"], *(tuple(map(tuple, info[t][c[t]])) for t in ("dc", "ac")))
            groups.setdefault(key, []).append((k, data, bounds))
        else:
            info["coefficients"] = _serial(info, data, bounds)
    for (interval, dc, ac), members in groups.items():
        starts, shift = [], 0
        for _, data, bounds in members:
            starts.append(bounds[:-1] + shift)
            shift += len(data) + 8
        joined = np.zeros(shift, np.uint8)
        shift = 0
        for _, data, _ in members:
            joined[shift : shift + len(data)] = data
            shift += len(data) + 8
        counts = np.concatenate([_lane_blocks(out[k]["mcus"], interval) for k, _, _ in members])
        got, at = _lockstep(joined, np.concatenate(starts), counts, lookup(*dc), lookup(*ac)), 0
        for k, _, _ in members:
            n = out[k]["mcus"]
            out[k]["coefficients"] = [got[at : at + n]]
            at += n
    for info in out:
        info["thumbnail"] = thumbnail(info)
    return out


def _lane_blocks(mcus: int, interval: int) -> np.ndarray:
    out = np.full(-(-mcus // interval), interval, np.int64)
    out[-1] = mcus - interval * (len(out) - 1)
    return out


def _lockstep(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients of all lanes' blocks, one component: [block, 64] int16."""
    first = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    out = np.zeros((int(counts.sum()), 64), np.int16)
    flat = out.reshape(-1)
    word = np.zeros(len(data) + 4, np.uint32)  # 32 bits from each byte on
    wide = np.zeros(len(data) + 8, np.uint32)
    wide[: len(data)] = data
    for k in range(4):
        word |= wide[k : k + len(word)] << np.uint32(24 - 8 * k)
    bit = starts * 8
    level = np.zeros(len(counts), np.int64)

    def take(bit, n):
        """The n bits (an array, 0 to 16) from each bit place on."""
        ahead = word[bit >> 3] << (bit & 7).astype(np.uint32)
        n32 = n.astype(np.uint32)
        return ((ahead >> np.uint32(1)) >> (np.uint32(31) - n32)).astype(np.int64)

    def symbol(bit, table):
        ahead = word[bit >> 3] << (bit & 7).astype(np.uint32)
        got = table[ahead >> np.uint32(16)]
        if not got.all():
            raise BadJpeg("a code that is in no table")
        return got >> 5, got & 31

    def value(bits, size):
        return np.where(bits < (np.int64(1) << np.maximum(size - 1, 0)), bits - (np.int64(1) << size) + 1, bits) * (size > 0)

    for b in range(int(counts.max())):
        lanes = np.flatnonzero(counts > b)
        size, length = symbol(bit[lanes], dc)
        at = bit[lanes] + length
        level[lanes] += value(take(at, size), size)
        at += size
        base = (first[lanes] + b) * 64
        flat[base] = level[lanes]
        place = np.ones(len(lanes), np.int64)
        live, where = lanes, np.arange(len(lanes))
        ends = np.empty(len(lanes), np.int64)
        while len(live):
            got, length = symbol(at, ac)
            run, size = got >> 4, got & 15
            at = at + length
            stop = (size == 0) & (run < 15)
            place = place + run
            if (place > 63 + stop * 64).any():
                raise BadJpeg("too many coefficients in a block")
            more = size > 0
            v = value(take(at, size), size)
            flat[base[more] + place[more]] = v[more]
            at = at + size
            place = place + 1
            over = stop | (place > 63)
            if over.any():
                ends[where[over]] = at[over]
                go = ~over
                live, where, at, base, place = live[go], where[go], at[go], base[go], place[go]
        bit[lanes] = ends
    return out


def _serial(info: dict, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Coefficients of each component, blocks in coding order, segment by segment."""
    comps = info["components"]
    tables = [[lookup(*info[t][c[t]]).tolist() for t in ("dc", "ac")] for c in comps]
    out = [np.zeros((info["mcus"] * c["h"] * c["v"], 64), np.int16) for c in comps]
    filled = [0] * len(comps)
    interval = info["interval"] or info["mcus"]
    left = info["mcus"]
    for s in range(len(bounds) - 1):
        raw = data[bounds[s] : bounds[s + 1]].tobytes()
        bits, at, have, end = 0, 0, 0, len(raw)
        levels = [0] * len(comps)

        def fill():
            nonlocal bits, at, have
            chunk = raw[at : at + 6]
            chunk += b"\xff" * (6 - len(chunk))
            if at > end + 12:
                raise BadJpeg("the scan ends early")
            bits = (bits & ((1 << have) - 1)) << 48 | int.from_bytes(chunk, "big")
            at, have = at + 6, have + 48

        def code(table):
            nonlocal have
            if have < 32:
                fill()
            got = table[bits >> (have - 16) & 0xFFFF]
            if not got:
                raise BadJpeg("a code that is in no table")
            have -= got & 31
            return got >> 5

        def value(size):
            nonlocal have
            if not size:
                return 0
            if have < size:
                fill()
            have -= size
            v = bits >> have & ((1 << size) - 1)
            return v if v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(interval, left)):
            for k, c in enumerate(comps):
                dc, ac = tables[k]
                for _ in range(c["h"] * c["v"]):
                    block = out[k][filled[k]]
                    filled[k] += 1
                    levels[k] += value(code(dc))
                    block[0] = levels[k]
                    place = 1
                    while place < 64:
                        got = code(ac)
                        run, size = got >> 4, got & 15
                        if not size:
                            if run < 15:
                                break
                            place += 16
                            continue
                        place += run
                        if place > 63:
                            raise BadJpeg("too many coefficients in a block")
                        block[place] = value(size)
                        place += 1
        left -= interval
    return out


def thumbnail(info: dict) -> np.ndarray:
    """One luminance pixel per 8x8 block of the first component, from DC alone."""
    c = info["components"][0]
    dc = info["coefficients"][0][:, 0].astype(np.int64) * int(info["quant"][c["q"]][0])
    grid = dc.reshape(info["down"], info["across"], c["v"], c["h"]).transpose(0, 2, 1, 3).reshape(info["down"] * c["v"], -1)
    hs, vs = max(x["h"] for x in info["components"]), max(x["v"] for x in info["components"])
    wide, high = -(-info["width"] * c["h"] // (8 * hs)), -(-info["height"] * c["v"] // (8 * vs))
    return np.clip((grid[:high, :wide] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: which of 9 by 8 area means rise from left to right."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)

    def bounds(n, parts):
        lo = np.arange(parts) * n // parts
        return lo, np.maximum(lo + 1, (np.arange(parts) + 1) * n // parts)

    (a, b), (c, d) = bounds(pixels.shape[0], 8), bounds(pixels.shape[1], 9)
    means = (total[np.ix_(b, d)] - total[np.ix_(a, d)] - total[np.ix_(b, c)] + total[np.ix_(a, c)]) / np.outer(b - a, d - c)
    return np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()


def feature(info: dict) -> str:
    return f"{info['width']}x{info['height']}:{difference_hash(info['thumbnail'])}"


def read_payload(info: dict) -> bytes:
    """The bytes that store() kept."""
    size = next((int(c[8:]) for c in info["comments"] if c.startswith(b"payload ")), None)
    if size is None:
        raise BadJpeg("it holds no payload")
    return (info["coefficients"][0].reshape(-1)[:size] + 128).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- tables of files


def image_features(images: DataFrame, column: str = "content") -> DataFrame:
    """width, height, thumbnail_hash and feature of a binary column, row by row; other
    columns stay. Files that are null or not baseline JPEG get nulls."""
    kept = [c for c in images.columns if c not in ("width", "height", "thumbnail_hash", "feature")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*kept).schema) + ", width long, height long, thumbnail_hash string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(column).to_pylist():
                try:
                    info = decode(raw) if raw is not None else None
                except (BadJpeg, KeyError, IndexError, struct.error):
                    info = None
                rows.append((info["width"], info["height"], difference_hash(info["thumbnail"]), feature(info)) if info else (None,) * 4)
            new = list(zip(*rows, strict=True)) if rows else [()] * 4
            arrays = [pa.array(x, t) for x, t in zip(new, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "width", "height", "thumbnail_hash", "feature"])

    return images.select(*kept).mapInArrow(run, schema)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Every text of docs (doc_id, text) stored as a JPEG, read back, with features."""

    def run(batch):
        column, rows = batch.column("text"), []
        for first, end in slices(column, 1 << 20):
            texts = [(t or "").encode() for t in column.slice(first, end - first).to_pylist()]
            files = [store(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
            for text, raw, info in zip(texts, files, _decode_many(files), strict=True):
                back = read_payload(info)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(info)))
        yield [batch.column("doc_id"), *zip(*rows, strict=True)]

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(kept, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_jpeg_media(spark, sf_dir: str) -> DataFrame:
    return stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
