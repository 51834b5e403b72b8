"""Baseline JPEG as a lossless store of texts, decoded to DC-only luminance thumbnails.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the quantised
coefficients of 8x8 blocks (byte minus 128, 64 to a block, zigzag order, all quantisers 1),
entropy-coded in a greyscale baseline scan with a restart marker after each block. Reading
back parses the markers, Huffman-decodes the scan, returns the payload and rebuilds a
thumbnail of one pixel per block from the DC coefficients alone. All restart intervals of
a batch are decoded in step by numpy; the decoder also takes other baseline files with
one scan (sampled components, any restart interval).

Null counts as an empty text (a payload of 64 zero bytes). Equal texts give equal bytes and
features; one row per input row; an empty table gives no rows. Memory follows the
slice, half a megabyte of text or one text.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.lattice import slices, text_buffers
from weftgraph.sources.ship import ship

STEP, WIDE, MOST = 500_000, 64, 8191
#: Code lengths 1 to 16: how many symbols have each, then the symbols from short to long.
DC_BITS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (5, 4, 6, 7, 8, 3, 2, 1, 0, 9, 10, 11)
AC_BITS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
_FIRST = [0x05, 0x04, 0x07, 0x03, 0x06, 0x08, 0x02, 0x00, 0x01, 0xF0]
AC_SYMBOLS = tuple(_FIRST + [s for s in (r * 16 + n for n in range(1, 11) for r in range(16)) if s not in _FIRST])


@functools.cache
def canonical(bits: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Code and code length by symbol."""
    codes, sizes, code, at = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int32), 0, 0
    for size, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            codes[s], sizes[s] = code, size
            code += 1
        at, code = at + n, code << 1
    return codes, sizes


@functools.cache
def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + code length, or 0."""
    bits, symbols = tuple(table[:16]), tuple(table[16:])
    out, (codes, sizes) = np.zeros(1 << 16, dtype=np.int32), canonical(bits, symbols)
    for s in symbols:
        size = int(sizes[s])
        start = int(codes[s]) << (16 - size)
        out[start : start + (1 << (16 - size))] = s * 32 + size
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(0xC4, bytes([0x00, *DC_BITS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_BITS, *AC_SYMBOLS])) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
_QUANTISERS = _segment(0xDB, bytes([0] + [1] * 64))


def grid(blocks: int) -> tuple[int, int]:
    """Blocks a row, and rows."""
    wide = min(blocks, max(WIDE, -(-blocks // MOST)))
    return wide, -(-blocks // wide)


#: Bits that a value from -2048 on takes.
_CATEGORY = np.array([abs(v).bit_length() for v in range(-2048, 2048)], dtype=np.int32)


def _categories(values: np.ndarray) -> np.ndarray:
    return _CATEGORY[values + 2048]


def _tokens(values: np.ndarray, symbols: np.ndarray, size: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    return (codes[symbols] << size) | extra, lengths[symbols] + size


def _place(byte: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """Sums of parts by byte, which ascends; parts of one byte have no bit in common."""
    some = np.flatnonzero(part)
    byte, part = byte[some], part[some]
    out = np.zeros(n + 4, dtype=np.uint8)
    if len(byte):
        heads = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        out[byte[heads]] = np.bitwise_or.reduceat(part, heads)
    return out[:n]


def encode_blocks(coefficients: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of all blocks (n x 64) with stuffing and restart markers, and each
    block's end. `last` marks blocks that end a scan; `rst` numbers start anew there."""
    n = len(coefficients)
    dc_codes, dc_sizes = canonical(DC_BITS, DC_SYMBOLS)
    ac_codes, ac_sizes = canonical(AC_BITS, AC_SYMBOLS)
    dc = coefficients[:, 0].astype(np.int32)
    size = _categories(dc)
    dc_bits, dc_len = _tokens(dc, size, size, dc_codes, dc_sizes)
    where = np.flatnonzero(np.ascontiguousarray(coefficients[:, 1:]))
    row, col = (where // 63).astype(np.int32), (where % 63).astype(np.int32)
    values = coefficients.reshape(-1)[where + row + 1].astype(np.int32)
    before = np.full(len(row), -1, dtype=np.int32)
    same = row[1:] == row[:-1]
    before[1:][same] = col[:-1][same]
    run = col - before - 1
    size = _categories(values)
    bits, length = _tokens(values, (run & 15) * 16 + size, size, ac_codes, ac_sizes)
    long_runs = run >> 4
    per_token = 1 + long_runs
    per_block = np.bincount(row, per_token, n).astype(np.int64)
    open_end = np.ones(n, dtype=bool)
    open_end[row[col == 62]] = False
    begin = np.concatenate([[0], np.cumsum(per_block + 3)])  # DC, the end of block and the filling have places too
    value, taken = np.zeros(begin[-1], dtype=np.int32), np.zeros(begin[-1], dtype=np.int32)
    value[begin[:-1]], taken[begin[:-1]] = dc_bits, dc_len
    done = np.cumsum(per_token)
    shift = begin[:-1] - np.cumsum(per_block) + per_block
    at = done + shift[row]
    value[at], taken[at] = bits, length
    gaps = np.flatnonzero(long_runs)
    for back in range(1, 4):
        more = at[gaps[long_runs[gaps] >= back]] - back
        value[more], taken[more] = ac_codes[0xF0], ac_sizes[0xF0]
    ends = begin[1:] - 2
    value[ends], taken[ends] = np.where(open_end, ac_codes[0], 0), np.where(open_end, ac_sizes[0], 0)
    total = np.cumsum(taken)
    spent = np.diff(np.concatenate([[0], total[begin[1:] - 1]]))
    fill = -spent % 8
    value[begin[1:] - 1], taken[begin[1:] - 1] = (1 << fill) - 1, fill
    starts = np.cumsum(taken) - taken
    word = value << (31 - (starts & 7) - taken)  # bits 30 to 0: 31 from the byte's start
    byte, size_of = starts >> 3, int(starts[-1] + taken[-1]) >> 3
    raw = _place(byte, word >> 23, size_of)
    for j, part in ((1, word >> 15), (2, word >> 7), (3, word << 1)):
        raw += _place(byte + j, part & 255, size_of)
    block_end = np.cumsum((spent + fill) >> 3)
    wide = 1 + (raw == 255).astype(np.int64)
    ending = block_end - 1
    marked = ending[~last]
    wide[marked] += 2
    place = np.cumsum(wide) - wide
    out = np.zeros(int(place[-1] + wide[-1]), dtype=np.uint8)
    out[place] = raw
    first = np.concatenate([[True], last[:-1]])
    number = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tail = place[marked] + wide[marked]
    out[tail - 2], out[tail - 1] = 255, 0xD0 + (number[~last] & 7)
    return out, (place + wide)[ending]


def encode(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """JPEG files of texts, and the texts' bytes."""
    data, offsets = text_buffers(column)
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // 64))
    grids = [grid(int(b)) for b in blocks]
    filled = np.array([w * h for w, h in grids], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(filled)])
    padded = np.zeros(int(start[-1]) * 64, dtype=np.uint8)
    padded[np.repeat(start[:-1] * 64 - offsets[:-1], sizes) + np.arange(len(data))] = data
    coefficients = padded.reshape(-1, 64).astype(np.int16) - 128
    spare = np.arange(start[-1]) - np.repeat(start[:-1], filled) >= np.repeat(blocks, filled)
    coefficients[spare] = 0
    last = np.zeros(int(start[-1]), dtype=bool)
    last[start[1:] - 1] = True
    scan, ends = encode_blocks(coefficients, last)
    ends = np.concatenate([[0], ends[start[1:] - 1]])
    body, files = scan.tobytes(), []
    for i, (w, h) in enumerate(grids):
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % (blocks[i] * 64)) + _QUANTISERS + _segment(0xC0, struct.pack(">BHHB3B", 8, h * 8, w * 8, 1, 1, 0x11, 0)) + _TABLES
        files.append(head + body[ends[i] : ends[i + 1]] + b"\xff\xd9")
    return files, sizes


class Header(NamedTuple):
    """What the markers say: size, sampling and tables per component, restart interval."""

    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int], ...]  # h, v, DC table, AC table, first quantiser
    tables: tuple[tuple[int, bytes], ...]
    interval: int
    payload: int
    scan: int  # where the scan begins


def parse(file: bytes) -> Header:
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, quantisers, interval, payload, frame = 2, {}, {}, 0, -1, None
    while True:
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        if file[at] != 0xFF:
            raise ValueError("a marker is missing")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and body.startswith(b"payload "):
            payload = int(body[8:])
        elif marker == 0xDB:
            while body:
                n = 65 + 64 * (body[0] >> 4)
                quantisers[body[0] & 15] = body[1] if n == 65 else int.from_bytes(body[1:3], "big")
                body = body[n:]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = (width, height, [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)])
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise ValueError("one scan of all components is asked for")
            use = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            parts = tuple((h, v, use[c] >> 4, 16 + (use[c] & 15), quantisers[q]) for c, h, v, q in frame[2])
            if len(parts) == 1:
                parts = ((1, 1, *parts[0][2:]),)
            return Header(frame[0], frame[1], parts, tuple(sorted(tables.items())), interval, payload, at)


def decode_scans(heads: list[Header], scans: list[bytes]) -> list[np.ndarray]:
    """Coefficients (blocks x 64, in scan order) of files with the same components, tables
    and interval, all restart intervals in step."""
    head = heads[0]
    luts = {k: _lookup(t) for k, t in head.tables}
    pattern = [i for i, c in enumerate(head.components) for _ in range(c[0] * c[1])]
    dc = np.stack([luts[head.components[i][2]] for i in pattern]).reshape(-1)
    ac = np.stack([luts[head.components[i][3]] for i in pattern]).reshape(-1)
    kind = np.array(pattern)
    across, down = 8 * max(c[0] for c in head.components), 8 * max(c[1] for c in head.components)
    mcus = np.array([-(-h.width // across) * -(-h.height // down) for h in heads], dtype=np.int64)
    raw = np.frombuffer(b"".join(scans), dtype=np.uint8)
    file_start = np.concatenate([[0], np.cumsum([len(s) for s in scans])])
    full, after = raw == 255, np.append(raw[1:], 0)
    restart = np.flatnonzero(full & ((after & 0xF8) == 0xD0))
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] &= ~(full[:-1] & (raw[1:] == 0))
    keep[restart] = False
    keep[restart + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    begins = np.sort(np.concatenate([file_start[:-1], restart + 2]))
    data = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(data) - 4, dtype=np.uint64)
    for j in range(5):
        window |= data[j : len(data) - 4 + j] << np.uint64(32 - 8 * j)
    window = window.astype(np.int64)
    per = len(pattern)
    step = head.interval or int(mcus.max(initial=1))
    units = -(-mcus // step)
    if units.sum() != len(begins):
        raise ValueError("restart markers are missing")
    first_unit = np.concatenate([[0], np.cumsum(units)])
    nth = np.arange(first_unit[-1]) - np.repeat(first_unit[:-1], units)
    block_start = np.concatenate([[0], np.cumsum(mcus * per)])
    block = np.repeat(block_start[:-1], units) + nth * step * per
    end = np.minimum(block + step * per, np.repeat(block_start[1:], units))
    out = np.zeros((int(block_start[-1]), 64), dtype=np.int16)
    position = kept[begins] * 8
    base, k = block.copy(), np.zeros(len(begins), dtype=np.int64)
    predicted = np.zeros((len(begins), len(head.components)), dtype=np.int64)
    live = np.arange(len(begins))
    while len(live):
        bit = position[live]
        bits = window[bit >> 3] << (bit & 7)
        slot = (block[live] - base[live]) % per
        look = (slot << 16) + ((bits >> 24) & 0xFFFF)
        is_dc = k[live] == 0
        found = np.where(is_dc, dc[look], ac[look])
        length, symbol = found & 31, found >> 5
        if not length.all():
            raise ValueError("an unknown code")
        size, run = np.where(is_dc, symbol, symbol & 15), np.where(is_dc, 0, symbol >> 4)
        extra = (bits >> (40 - length - size)) & ((1 << size) - 1)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        position[live] = bit + length + size
        dcs = live[is_dc]
        of = kind[slot[is_dc]]
        predicted[dcs, of] += value[is_dc]
        value[is_dc] = predicted[dcs, of]
        at = k[live] + run
        ended = ~is_dc & (size == 0) & (run != 15)
        put = ~ended & (at < 64)
        out[block[live][put], at[put]] = value[put]
        at = np.where(ended, 64, at + 1)
        full_block = at >= 64
        k[live] = np.where(full_block, 0, at)
        block[live] += full_block
        live = live[block[live] < end[live]]
    return [out[block_start[i] : block_start[i + 1]] for i in range(len(heads))]


def thumbnail(head: Header, coefficients: np.ndarray) -> np.ndarray:
    """Luminance, one pixel per block of the first component."""
    h, v, _, _, quantiser = head.components[0]
    per = sum(c[0] * c[1] for c in head.components)
    most = 8 * max(c[0] for c in head.components)
    wide = -(-head.width // most)
    dc = coefficients[:, 0].reshape(-1, per)[:, : h * v].reshape(-1, wide, v, h).transpose(0, 2, 1, 3).reshape(-1, wide * h)
    return np.clip(np.round(dc.astype(np.float64) * quantiser / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8x8 sampled pixels are brighter than their mean."""
    rows, cols = (np.arange(8) * pixels.shape[0]) // 8, (np.arange(8) * pixels.shape[1]) // 8
    small = pixels[rows][:, cols].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()


def read_back(files: list[bytes]) -> list[tuple[bytes, str]]:
    """Payload and feature of each stored file."""
    heads, groups = [parse(f) for f in files], defaultdict(list)
    for i, h in enumerate(heads):
        groups[h.components, h.tables, h.interval].append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        found = decode_scans([heads[i] for i in members], [files[i][heads[i].scan : -2] for i in members])
        for i, c in zip(members, found, strict=True):
            payload = (c + 128).astype(np.uint8).tobytes()
            out[i] = (payload[: heads[i].payload] if heads[i].payload >= 0 else payload, f"{heads[i].width}x{heads[i].height}:{thumbnail_hash(thumbnail(heads[i], c))}")
    return out


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and the text's JPEG file as binary column `media`."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP):
            files, sizes = encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes), pa.array(files, pa.binary())], ["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored files back: digests of payload and file, and the thumbnail's feature."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", STEP):
            files = batch.column("media").to_pylist()
            back = read_back(files)
            columns = [
                batch.column("key"),
                batch.column("n_bytes"),
                pa.array([len(p) for p, _ in back], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p, _ in back]),
                pa.array([zlib.crc32(p[-64:]) for p, _ in back], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array([f for _, f in back]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("key", key)
