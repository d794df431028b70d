"""Progressive JPEG columns: decoding to RGB tensors, and storing bytes losslessly as coefficients.

A progressive file sends each coefficient in several scans: by spectral selection,
a band of frequencies at a time, and by successive approximation, high bits first.
The decoder accumulates all scans in coefficient arrays, inverse-transforms them
in numpy, and brings chroma to full resolution. It steps through all restart
intervals of a batch of files at once, one symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.session import prepare
from sessionmill.llm.words import ragged, text_batches

SCALE = 20
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
NEXT_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def _basis() -> np.ndarray:
    """Inverse transform of a block in zigzag order to 64 samples, in integers of SCALE bits, so that sums in doubles are exact."""
    x, u = np.arange(8), np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[_zigzag()] * (1 << SCALE))


# --- bits ---------------------------------------------------------------------------------


class Bits:
    """Entropy-coded intervals laid end to end; ``at`` is where each begins, in bits."""

    def __init__(self, intervals: list[bytes]):
        data = b"".join(x.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff" for x in intervals) + b"\xff" * 8
        size = np.array([len(x) - x.count(b"\xff\x00") + 4 for x in intervals], np.int64)
        self.at = (np.cumsum(size) - size) * 8
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        self.words = ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]).astype(np.int64)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """``n`` bits, up to 24, at each place."""
        return ((self.words[at >> 3] << (at & 7)) & 0xFFFFFFFF) >> (32 - n)


def lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits, code length << 8 | symbol of the canonical Huffman code they begin with."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


# --- files --------------------------------------------------------------------------------


@dataclass
class File:
    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantisation table)
    quantisation: dict = field(default_factory=dict)
    script: list = field(default_factory=list)  # of each scan: components and tables, band, approximation, Huffman tables
    restarts: list = field(default_factory=list)
    data: list = field(default_factory=list)
    comment: bytes = b""


def parse(data: bytes) -> File:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at, restart, huffman = File(), 2, 0, {}
    while at + 4 <= len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xD9:
            break
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                out.quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            restart = int.from_bytes(body)
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            n = body[0]
            ids = [c[0] for c in out.components]
            members = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n))
            start, end, approximation = body[1 + 2 * n : 4 + 2 * n]
            found = NEXT_MARKER.search(data, at)
            stop = found.start() if found else len(data)
            out.script.append((members, start, end, approximation >> 4, approximation & 15, tuple(sorted(huffman.items()))))
            out.restarts.append(restart)
            out.data.append(data[at:stop])
            at = stop
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman-coded files are read")
    return out


@dataclass
class Layout:
    """Where a group's blocks are: per component, each file's first block, its blocks per row, and how many of them a scan of it alone has."""

    first: list[np.ndarray]
    wide: list[np.ndarray]
    own_columns: list[np.ndarray]
    own_rows: list[np.ndarray]
    columns: np.ndarray
    rows: np.ndarray
    total: int


def layout(files: list[File]) -> Layout:
    components = files[0].components
    hm, vm = max(c[1] for c in components), max(c[2] for c in components)
    w, h = np.array([f.width for f in files]), np.array([f.height for f in files])
    columns, rows = -(-w // (8 * hm)), -(-h // (8 * vm))
    first, wide, own_c, own_r, at = [], [], [], [], 0
    for _, ch, cv, _ in components:
        n = columns * ch * rows * cv
        first.append(at + np.cumsum(n) - n)
        at += int(n.sum())
        wide.append(columns * ch)
        own_c.append(-(-(-(-w * ch // hm)) // 8))
        own_r.append(-(-(-(-h * cv // vm)) // 8))
    return Layout(first, wide, own_c, own_r, columns, rows, at)


def _blocks(files: list[File], where: Layout, members: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a scan in coding order, file after file; the member each belongs to; units (MCUs) per file."""
    components = files[0].components
    if len(members) == 1:
        c = members[0][0]
        units = where.own_columns[c] * where.own_rows[c]
        i = ragged(np.zeros(len(files), np.int64), units)
        wide = np.repeat(where.own_columns[c], units)
        block = np.repeat(where.first[c], units) + i // wide * np.repeat(where.wide[c], units) + i % wide
        return block, np.zeros(len(block), np.int64), units
    units = where.columns * where.rows
    i = ragged(np.zeros(len(files), np.int64), units)
    my, mx = i // np.repeat(where.columns, units), i % np.repeat(where.columns, units)
    parts, owner = [], []
    for m, (c, _, _) in enumerate(members):
        _, ch, cv, _ = components[c]
        for v in range(cv):
            for h in range(ch):
                parts.append(np.repeat(where.first[c], units) + (my * cv + v) * np.repeat(where.wide[c], units) + mx * ch + h)
                owner.append(m)
    return np.column_stack(parts).ravel(), np.tile(owner, len(i)), units


def _intervals(files: list[File], scan: int, units: np.ndarray, per_unit: int) -> tuple[Bits, np.ndarray, np.ndarray]:
    """The intervals' bits, and where each one's blocks begin and end in coding order."""
    pieces, starts, ends, at = [], [], [], 0
    for f, n in zip(files, units.tolist(), strict=True):
        step = f.restarts[scan] or max(1, n)
        own = RESTART.split(f.data[scan])
        count = -(-n // step)
        pieces += (own + [b""] * count)[:count]
        edge = np.minimum(np.arange(count + 1) * step, n) * per_unit + at
        starts.append(edge[:-1])
        ends.append(edge[1:])
        at += n * per_unit
    return Bits(pieces), np.concatenate(starts), np.concatenate(ends)


def _dc_first(coefficients: np.ndarray, bits: Bits, starts, ends, block, owner, tables, low: int) -> None:
    at, i = bits.at.copy(), starts.copy()
    previous = np.zeros((len(starts), len(tables)), np.int64)
    on = np.flatnonzero(i < ends)
    while len(on):
        member = owner[i[on]]
        found = np.choose(member, [t[bits.peek(at[on], 16)] for t in tables]) if len(tables) > 1 else tables[0][bits.peek(at[on], 16)]
        at[on] += found >> 8
        size = found & 15
        difference = extend(bits.peek(at[on], size), size)
        at[on] += size
        previous[on, member] += difference
        coefficients[block[i[on]], 0] = previous[on, member] << low
        i[on] += 1
        on = on[i[on] < ends[on]]


def _dc_refine(coefficients: np.ndarray, bits: Bits, starts, ends, block, low: int) -> None:
    n = ends - starts
    coefficients[block[ragged(starts, n)], 0] |= bits.peek(ragged(bits.at, n), 1).astype(coefficients.dtype) << low


def _ac_first(coefficients: np.ndarray, bits: Bits, starts, ends, block, table, first: int, last: int, low: int) -> None:
    flat = coefficients.reshape(-1)
    on = np.flatnonzero(starts < ends)
    at, i, end = bits.at[on].copy(), starts[on].copy(), ends[on]
    k = np.full(len(on), first)
    while len(at):
        found = table[bits.peek(at, 16)]
        at += found >> 8
        run, size = (found >> 4) & 15, found & 15
        value = extend(bits.peek(at, size), size)
        at += size
        plain = size > 0
        if plain.all():
            k += run
            flat[block[i] * 64 + k] = value << low
            k += 1
        else:
            k += np.where(plain, run, 0)
            flat[block[i[plain]] * 64 + k[plain]] = value[plain] << low
            k += plain
            k += np.where(~plain & (run == 15), 16, 0)
            rest = ~plain & (run < 15)
            skipped = (1 << run) + bits.peek(at, run) - 1
            at += np.where(rest, run, 0)
            i += np.where(rest, skipped, 0)
            k[rest] = last + 1
        over = k > last
        i += over
        k[over] = first
        if over.any():
            stay = i < end
            if not stay.all():
                at, i, end, k = at[stay], i[stay], end[stay], k[stay]


def _ac_refine(coefficients: np.ndarray, bits: Bits, starts, ends, block, table, first: int, last: int, low: int) -> None:
    step = 1 << low
    on = np.flatnonzero(starts < ends)
    at, i, end = bits.at[on].copy(), starts[on].copy(), ends[on]
    k, skip = np.full(len(on), first), np.zeros(len(on), np.int64)
    places = np.arange(first, last + 1)

    def correct(lanes: np.ndarray, upto: np.ndarray) -> None:
        """One more bit for each known coefficient from k to before ``upto``."""
        own = coefficients[block[i[lanes]], first : last + 1]
        known = (own != 0) & (places >= k[lanes, None]) & (places < upto[:, None])
        rank = np.cumsum(known, axis=1)
        bit = bits.peek(at[lanes, None] + rank - 1, 1)
        own += np.where(known & (bit == 1), np.where(own > 0, step, -step), 0).astype(own.dtype)
        coefficients[block[i[lanes]], first : last + 1] = own
        at[lanes] += rank[:, -1]

    while len(at):
        ask = np.flatnonzero(skip == 0)
        if len(ask):
            found = table[bits.peek(at[ask], 16)]
            at[ask] += found >> 8
            run, size = (found >> 4) & 15, found & 15
            stop = (size == 0) & (run < 15)
            skip[ask[stop]] = (1 << run[stop]) + bits.peek(at[ask[stop]], run[stop])
            at[ask[stop]] += run[stop]
            go = ask[~stop]
            if len(go):
                fresh = size[~stop] > 0
                sign = bits.peek(at[go], 1)
                at[go] += fresh
                own = coefficients[block[i[go]], first : last + 1]
                free = (own == 0) & (places >= k[go, None])
                reached = np.cumsum(free, axis=1) > run[~stop][:, None]
                to = np.where(reached.any(axis=1), first + reached.argmax(axis=1), last + 1)
                correct(go, to)
                new = np.flatnonzero(fresh & (to <= last))
                coefficients[block[i[go[new]]], to[new]] = np.where(sign[new] == 1, step, -step)
                k[go] = to + 1
        rest = np.flatnonzero(skip > 0)
        if len(rest):
            correct(rest, np.full(len(rest), last + 1))
            k[rest] = last + 1
            skip[rest] -= 1
        over = k > last
        i += over
        k[over] = first
        stay = i < end
        if not stay.all():
            at, i, end, k, skip = at[stay], i[stay], end[stay], k[stay], skip[stay]


def coefficients_of(files: list[File]) -> tuple[np.ndarray, Layout]:
    """All blocks (zigzag order) of files that share components and scan script."""
    where = layout(files)
    out = np.zeros((where.total, 64), np.int32)
    for scan, (members, first, last, high, low, huffman) in enumerate(files[0].script):
        tables = dict(huffman)
        block, owner, units = _blocks(files, where, members)
        per_unit = len(block) // max(1, int(units.sum()))
        bits, starts, ends = _intervals(files, scan, units, per_unit)
        if first == 0 and high == 0:
            _dc_first(out, bits, starts, ends, block, owner, [lookup(*tables[d]) for _, d, _ in members], low)
        elif first == 0:
            _dc_refine(out, bits, starts, ends, block, low)
        else:
            scan_of = _ac_refine if high else _ac_first
            scan_of(out, bits, starts, ends, block, lookup(*tables[16 | members[0][2]]), first, last, low)
    return out, where


def rgb_of(files: list[File], coefficients: np.ndarray, where: Layout) -> list[np.ndarray]:
    """Full-resolution tensors (height, width, 3), uint8, or of one channel for grey files."""
    basis = _basis()
    samples = np.empty((len(coefficients), 64), np.uint8)
    components = files[0].components
    hm, vm = max(c[1] for c in components), max(c[2] for c in components)
    table = np.concatenate([np.full(int((where.wide[c] * where.rows * cv).sum()), c) for c, (_, _, cv, _) in enumerate(components)])
    factors = np.array([files[0].quantisation[q] for *_, q in components])
    for a in range(0, len(coefficients), 8192):
        part = slice(a, a + 8192)
        value = (coefficients[part] * factors[table[part]]).astype(np.float64) @ basis
        samples[part] = np.clip(np.floor(value / (1 << SCALE) + 0.5) + 128, 0, 255)
    out = []
    for f, file in enumerate(files):
        planes = []
        for c, (_, ch, cv, _) in enumerate(components):
            across, down = int(where.wide[c][f]), int(where.rows[f] * cv)
            own = samples[where.first[c][f] : where.first[c][f] + across * down]
            plane = own.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
            planes.append(np.repeat(np.repeat(plane, vm // cv, axis=0), hm // ch, axis=1)[: file.height, : file.width].astype(np.int32))
        if len(planes) == 1:
            out.append(planes[0].astype(np.uint8)[:, :, None])
            continue
        y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
        half = 1 << 15
        rgb = np.stack(((y + 91881 * cr + half) >> 16, (y - 22554 * cb - 46802 * cr + half) >> 16, (y + 116130 * cb + half) >> 16), axis=-1)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


@dataclass
class Image:
    file: File
    blocks: np.ndarray  # coefficients in zigzag order, MCU by MCU
    rgb: np.ndarray


def decode(data: list[bytes]) -> list[Image]:
    """Decoded files; those with equal components and scan scripts are decoded together."""
    files = [parse(d) for d in data]
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        groups.setdefault((tuple(f.components), tuple(f.script), tuple((k, v.tobytes()) for k, v in sorted(f.quantisation.items()))), []).append(i)
    out: list = [None] * len(files)
    for own in groups.values():
        members = [files[i] for i in own]
        blocks, where = coefficients_of(members)
        order, owner, units = _blocks(members, where, tuple((c, 0, 0) for c in range(len(members[0].components))))
        ends = np.cumsum(units * (len(order) // max(1, int(units.sum()))))[:-1]
        for i, coded, rgb in zip(own, np.split(blocks[order], ends), rgb_of(members, blocks, where), strict=True):
            out[i] = Image(files[i], coded, rgb)
    return out


# --- storing bytes as coefficients ---------------------------------------------------------

# Every byte becomes a coefficient of 128 to 255 or of -255 to -128, so none is lost to rounding or taken for zero.
INTERVAL = 8
DC_TABLE = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]), bytes(range(11)))
AC_TABLE = (bytes([1, 1, *[0] * 14]), bytes([0x07, 0x00]))
REFINE_TABLE = (bytes([1, *[0] * 15]), bytes([0x00]))
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _packed(values: np.ndarray, sizes: np.ndarray, per_interval: np.ndarray) -> list[bytes]:
    """The bytes of each interval: its values of ``sizes`` bits each, filled up with ones, with stuffed zeros."""
    ends = np.cumsum(sizes)
    cut = np.concatenate(([0], np.cumsum(per_interval)))
    bit = np.concatenate(([0], ends))[cut]
    n_bits = np.diff(bit)
    n_bytes = (n_bits + 7) // 8
    begin = np.cumsum(n_bytes) - n_bytes
    pad = n_bytes * 8 - n_bits
    at = ends - sizes + np.repeat(begin * 8 - bit[:-1], per_interval)
    at, values, sizes = np.concatenate((at, begin * 8 + n_bits)), np.concatenate((values, (1 << pad) - 1)), np.concatenate((sizes, pad))
    word, window = at >> 5, values.astype(np.uint64) << (64 - (at & 31) - sizes).astype(np.uint64) % np.uint64(64)
    window[sizes == 0] = 0
    n = int(n_bytes.sum()) // 4 + 3
    sums = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = sums.astype(np.uint64).astype(">u4").tobytes()
    return [data[a : a + b].replace(b"\xff", b"\xff\x00") for a, b in zip(begin.tolist(), n_bytes.tolist(), strict=True)]


def _category(value: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(value) + 1)).astype(np.int64)


def _amplitude(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < 0, value + (1 << size) - 1, value)


def _codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, size, at, now = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            code[table[1][at]], size[table[1][at]] = now, n
            now, at = now + 1, at + 1
        now <<= 1
    return code, size


def encode(payloads: list[bytes], comments: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 file for each payload (a positive multiple of 64 bytes): 64 bytes to a block, six blocks to an MCU."""
    n = np.array([len(p) // 64 for p in payloads], np.int64)
    mcus = -(-n // 6)
    columns = np.ceil(np.sqrt(mcus)).astype(np.int64)
    rows = -(-mcus // columns)
    shells = [File(int(c) * 16, int(r) * 16, [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)]) for c, r in zip(columns, rows, strict=True)]
    where = layout(shells)
    every = ((0, 0, 0), (1, 0, 0), (2, 0, 0))
    block, _, units = _blocks(shells, where, every)
    raw = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, 64)
    starts = np.cumsum(units * 6) - units * 6
    coefficients = np.zeros((where.total, 64), np.int64)
    coefficients[block[ragged(starts, n)]] = np.where(raw < 128, raw - 255, raw)

    scans: list[tuple[bytes, list[list[bytes]]]] = []

    def add(members, first: int, last: int, high: int, low: int, values: np.ndarray, sizes: np.ndarray, blocks_each: np.ndarray, per_unit: int, units: np.ndarray) -> None:
        """Deals coded blocks (``blocks_each`` values for each) to restart intervals and intervals to files."""
        step = INTERVAL if per_unit == 1 else 2
        counts = -(-units // step)
        edge = np.minimum(ragged(np.zeros(len(units), np.int64), counts) * step, np.repeat(units, counts))
        length = np.minimum(step, np.repeat(units, counts) - edge) * per_unit
        cut = np.concatenate(([0], np.cumsum(blocks_each)))[np.concatenate(([0], np.cumsum(length)))]
        packed = _packed(values, sizes, np.diff(cut))
        header = _segment(0xDD, struct.pack(">H", step)) + _segment(0xDA, bytes([len(members)]) + b"".join(bytes([c + 1, 0 if first == 0 else int(high > 0)]) for c in members) + bytes([first, last, high << 4 | low]))
        ends = np.cumsum(counts).tolist()
        scans.append((header, [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]))

    ones = np.ones(len(block), np.int64)
    dc = coefficients[block, 0] >> 1
    # differences to the block before of the same component, afresh in each interval of two MCUs
    place = ragged(np.zeros(len(units), np.int64), units * 6) % 12
    member = np.array([0, 0, 0, 0, 1, 2])[place % 6]
    back = np.where(member == 0, np.where(place % 6 == 0, 3, 1), 6)
    previous = np.where(np.where(member == 0, place == 0, place < 6), 0, dc[np.maximum(np.arange(len(dc)) - back, 0)])
    size = _category(dc - previous)
    code, code_size = _codes(DC_TABLE)
    add((0, 1, 2), 0, 0, 0, 1, (code[size] << size) | _amplitude(dc - previous, size), code_size[size] + size, ones, 6, units)
    code, code_size = _codes(AC_TABLE)
    alone = [_blocks(shells, where, ((c, 0, 0),)) for c in range(3)]
    for first, last in BANDS:
        for c, (own, _, own_units) in enumerate(alone):
            value = coefficients[own, first : last + 1]
            half = np.sign(value) * (np.abs(value) >> 1)
            full = value[:, 0] != 0
            count = np.where(full, last + 1 - first, 1)
            at = np.cumsum(count) - count
            values, sizes = np.full(int(count.sum()), code[0]), np.full(int(count.sum()), code_size[0])
            held = ragged(at[full], count[full])
            values[held] = (code[7] << 7) | _amplitude(half[full].ravel(), np.full(len(held), 7))
            sizes[held] = code_size[7] + 7
            add((c,), first, last, 0, 1, values, sizes, count, 1, own_units)
    add((0, 1, 2), 0, 0, 1, 0, coefficients[block, 0] & 1, ones, ones, 6, units)
    for c, (own, _, own_units) in enumerate(alone):
        value = np.abs(coefficients[own, 1:]) & 1
        full = coefficients[own, 1] != 0
        count = np.where(full, 4, 1)
        at = np.cumsum(count) - count
        values, sizes = np.zeros(int(count.sum()), np.int64), np.ones(int(count.sum()), np.int64)
        three = value[full].reshape(-1, 3, 21) @ (1 << np.arange(20, -1, -1))
        held = at[full, None] + np.arange(1, 4)
        values[held], sizes[held] = three, 21
        add((c,), 1, 63, 1, 0, values, sizes, count, 1, own_units)

    tables = b"".join(_segment(0xC4, bytes([k]) + t[0] + t[1]) for k, t in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))
    marks = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    out = []
    for i, f in enumerate(shells):
        parts = [b"\xff\xd8", _segment(0xFE, comments[i]), _segment(0xDB, bytes([0]) + b"\x01" * 64), _segment(0xC2, struct.pack(">BHHB", 8, f.height, f.width, 3) + b"".join(bytes([k, h << 4 | v, q]) for k, h, v, q in f.components)), tables]
        for header, own in scans:
            parts.append(header)
            for j, piece in enumerate(own[i]):
                if j:
                    parts.append(marks[(j - 1) % 8])
                parts.append(piece)
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


def payload_of(image: Image) -> tuple[bytes, int]:
    """The bytes that ``encode`` stored and, from the comment, how many of them are the text's."""
    n_bytes, padded = struct.unpack(">QQ", image.file.comment)
    value = image.blocks[: padded // 64]
    return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes(), n_bytes


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % 64 if data else 64), len(data)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, most_bytes=2 << 20):
        payloads = [padded(t) for t in batch["text"].to_pylist()]
        files = encode([p for p, _ in payloads], [struct.pack(">QQ", n, len(p)) for p, n in payloads])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(files, pa.binary())], names=["doc_id", "media"])


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "media", most_bytes=3 << 20):
        images = decode(batch["media"].to_pylist())
        shape = [pa.array([i.rgb.shape[k] for i in images], pa.int32()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *shape, pa.array([i.rgb.tobytes() for i in images], pa.binary())], names=["doc_id", "height", "width", "rgb"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in text_batches(batches, "media", most_bytes=3 << 20):
        rows, media = [], batch["media"].to_pylist()
        for data, image in zip(media, decode(media), strict=True):
            payload, n = payload_of(image)
            sums = ":".join(str(int(image.rgb[:, :, c].sum(dtype=np.int64))) for c in range(3))
            feature = f"{image.rgb.shape[1]}x{image.rgb.shape[0]}:{sums}:{zlib.crc32(image.rgb):08x}"
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, zip(*rows, strict=True))], names=["doc_id", *names])


def stored_as_media(docs: DataFrame) -> DataFrame:
    """Each whole text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as a progressive JPEG file: doc_id, media.

    Null texts are as empty. Repeated rows get a row each, a null doc_id stays null,
    other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, media binary")


def rgb_tensors(media: DataFrame) -> DataFrame:
    """Decodes ``media(doc_id, media)``: doc_id, height, width, rgb (bytes of the full-resolution tensor, row by row)."""
    prepare(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_tensors, "doc_id long, height int, width int, rgb binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads files of ``stored_as_media`` back: the payload's and the file's digests and a feature of the RGB tensor (its size, channel sums and checksum)."""
    prepare(media.sparkSession)
    return media.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
