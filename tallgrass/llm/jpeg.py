"""A progressive JPEG coder and decoder in numpy, for many images at once.

Images are YCbCr with chroma at half resolution (4:2:0), restart intervals of one unit and quantiser steps of 1. Scans:
DC of all components but its lowest bit, that bit, then for each component AC 1-5, AC 6-63 but the lowest bit, and that
bit. Since each restart interval stands for itself, one symbol of every interval of every image is decoded at a time,
by array operations over all of them; images with other tables, intervals or scripts are decoded in groups of their own.

Payload bytes are stored losslessly in the format's unit, the quantised coefficient: byte b is the coefficient
((b + 133) mod 256) - 128, so that bytes which UTF-8 never has fall around zero. All arithmetic is exact in integers
(products in float64 stay below 2^53), so that equal payloads give equal bytes and pixels in any batch.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SHIFT = 133
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
BITS = np.array([int(a).bit_length() for a in range(4096)], np.uint8)
#: Component ids with horizontal and vertical sampling, and the scans: components, first and last index, high, low bit.
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0, 1, 2), 0, 0, 1, 0)] + [
    ((c,), *band) for c in range(3) for band in ((1, 5, 0, 0), (6, 63, 0, 1), (6, 63, 1, 0))
]
RESTART, WIDE = 1, 64
#: Blocks that are coded at a time, which bounds the memory that a long image takes.
CHUNK = 1 << 13


# -- tables ------------------------------------------------------------------------------------------------------------


def huffman_spec(kind: int) -> tuple[list[int], list[int]]:
    """Numbers of codes by length 1 to 16, and symbols. DC: 4 bits each. AC: 4 bits without a run, else 10 bits."""
    if kind == 0:
        return [0, 0, 0, 12] + [0] * 12, list(range(12))
    short = [0, *range(1, 11)]
    rest = [r << 4 | s for r in range(16) for s in range(11) if (r << 4 | s) not in short]
    return [0, 0, 0, 11, 0, 0, 0, 0, 0, len(rest)] + [0] * 6, short + rest


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in order of the codes."""
    out, code, at = [], 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((symbols[at], code, n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def encoder_table(kind: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.uint8)
    for s, c, n in canonical(*huffman_spec(kind)):
        codes[s], sizes[s] = c, n
    return codes, sizes


def decoder_table(counts: list[int], symbols: list[int]) -> np.ndarray:
    """Next 16 bits -> length | run << 8 | size << 16."""
    table = np.zeros(1 << 16, np.int32)
    for s, c, n in canonical(counts, symbols):
        table[c << 16 - n : c + 1 << 16 - n] = n | (s >> 4) << 8 | (s & 15) << 16
    return table


CODES = [encoder_table(0), encoder_table(1)]


# -- layout ------------------------------------------------------------------------------------------------------------


@dataclass
class Layout:
    """Where the blocks of one image are: cols x rows units, luma blocks in raster order, then Cb, then Cr."""

    cols: int
    rows: int
    base: int

    @property
    def units(self) -> int:
        return self.cols * self.rows

    def component(self, c: int) -> np.ndarray:
        n = self.units
        return self.base + (np.arange(4 * n) if c == 0 else np.arange(n) + (3 + c) * n)

    def interleaved(self) -> np.ndarray:
        n = self.units
        y, x = np.divmod(np.arange(n), self.cols)
        luma = [(2 * y + v) * 2 * self.cols + 2 * x + h for v in (0, 1) for h in (0, 1)]
        return self.base + np.stack([*luma, 4 * n + np.arange(n), 5 * n + np.arange(n)], 1).ravel()


def shape_for(blocks: int) -> tuple[int, int]:
    units = -(-blocks // 6)
    cols = min(units, max(WIDE, -(-units // 4095)))
    return cols, -(-units // cols)


# -- coding ------------------------------------------------------------------------------------------------------------


def amplitude(a: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = BITS[a]
    ones = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    return size, np.where(negative, ones - a.astype(np.uint64), a.astype(np.uint64))


def dc_tokens(dc: np.ndarray, comp: np.ndarray, seg: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    v = dc.astype(np.int32) >> low
    if high:
        return (v & 1).astype(np.uint64)[:, None], np.ones((len(v), 1), np.uint8)
    diff = v.copy()
    for c in range(3):
        at = np.flatnonzero(comp == c)
        same = seg[at[1:]] == seg[at[:-1]]
        diff[at[1:]] -= np.where(same, v[at[:-1]], 0)
    size, bits = amplitude(np.abs(diff), diff < 0)
    codes, sizes = CODES[0]
    return ((codes[size] << size.astype(np.uint64)) | bits)[:, None], (sizes[size] + size)[:, None]


def ac_tokens(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """First pass over a band: runs, sizes and amplitudes; a last column for the end of block."""
    n, width = band.shape
    a = np.abs(band.astype(np.int32)) >> low
    some = a > 0
    size, bits = amplitude(a, band < 0)
    codes, sizes = CODES[1]
    run = np.zeros((n, width), np.int32)
    if not some.all():
        at = np.where(some, np.arange(width, dtype=np.int32), -1)
        last = np.maximum.accumulate(at, 1)
        run[:, 0], run[:, 1:] = 0, np.arange(width - 1) - last[:, :-1]
    symbol = (run & 15) << 4 | size
    code, length = np.zeros((n, width + 1), np.uint64), np.zeros((n, width + 1), np.uint8)
    code[:, :width] = (codes[symbol] << size.astype(np.uint64)) | bits
    length[:, :width] = sizes[symbol] + size
    for k in (1, 2, 3):
        far = some & (run >> 4 >= k)
        if far.any():
            i = np.nonzero(far)
            code[i] |= codes[0xF0] << length[i].astype(np.uint64)
            length[i] += sizes[0xF0]
    length[:, :width][~some] = 0
    code[:, width], length[:, width] = codes[0], np.where(some[:, -1], 0, sizes[0])
    return code, length


def refined_row(band: list[int], low: int) -> tuple[int, int]:
    """A block's refinement as one number of `length` bits; the general case."""
    codes, sizes = CODES[1]
    out, length, run, waiting = 0, 0, 0, []

    def put(code: int, n: int) -> None:
        nonlocal out, length
        out, length = out << n | code, length + n

    def flush() -> None:
        for bit in waiting:
            put(bit, 1)
        waiting.clear()

    a = [abs(v) >> low for v in band]
    last = max((k for k, v in enumerate(a) if v == 1), default=-1)
    for k, v in enumerate(a):
        if v == 0:
            run += 1
            if run == 16 and k < last:
                put(int(codes[0xF0]), int(sizes[0xF0]))
                flush()
                run = 0
        elif v > 1:
            waiting.append(v & 1)
        else:
            put(int(codes[run << 4 | 1]), int(sizes[run << 4 | 1]))
            put(int(band[k] > 0), 1)
            flush()
            run = 0
    if last < len(a) - 1:
        put(int(codes[0]), int(sizes[0]))
        flush()
    return out, length


def refined_tokens(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    n, width = band.shape
    a = np.abs(band.astype(np.int32)) >> low
    codes, sizes = CODES[1]
    known, bit = (a > 1).astype(np.uint64), (a & 1).astype(np.uint64)
    code = np.full(n, codes[0], np.uint64)
    for k in range(width):
        code = (code << known[:, k]) | (bit[:, k] & known[:, k])
    length = (sizes[0] + known.sum(1)).astype(np.uint8)
    new = np.flatnonzero((a == 1).any(1))
    if not len(new):
        return code[:, None], length[:, None]
    rows = [refined_row(band[i].tolist(), low) for i in new]
    parts = max(-(-m // 60) for _, m in rows)
    codes_out, sizes_out = np.zeros((n, parts), np.uint64), np.zeros((n, parts), np.uint8)
    codes_out[:, 0], sizes_out[:, 0] = code, length
    codes_out[new], sizes_out[new] = 0, 0
    for i, (bits, m) in zip(new, rows, strict=True):
        for k, at in enumerate(range(0, m, 60)):
            take = min(60, m - at)
            codes_out[i, k], sizes_out[i, k] = bits >> m - at - take & (1 << take) - 1, take
    return codes_out, sizes_out


def packed(code: np.ndarray, length: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each filled up with ones, and the segments' first bytes. starts: first rows of segments."""
    bits = length.sum(1, dtype=np.int64)
    per = np.add.reduceat(bits, starts)
    size = (per + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    before = np.cumsum(bits) - bits
    counts = np.diff(np.append(starts, len(bits)))
    row = before + np.repeat(8 * first[:-1] - before[starts], counts)
    fill = np.zeros(len(bits), np.uint64)
    fill[np.append(starts[1:], len(bits)) - 1] = (8 * size - per).astype(np.uint64)
    code = np.concatenate([code, ((np.uint64(1) << fill) - np.uint64(1))[:, None]], 1)
    length = np.concatenate([length, fill.astype(np.uint8)[:, None]], 1)
    ends = np.cumsum(length, 1, dtype=np.int64)
    real = length > 0
    pos = (row[:, None] + ends - length)[real]
    n = length[real].astype(np.uint64)
    v = code[real] << (np.uint64(64) - n)
    q, o = pos >> 6, (pos & 63).astype(np.uint64)
    words = np.zeros(int(first[-1] * 8 >> 6) + 2, np.uint64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
    words[q[at]] = np.bitwise_or.reduceat(v >> o, at)
    over = np.flatnonzero(o + n > np.uint64(64))
    words[q[over] + 1] |= v[over] << (np.uint64(64) - o[over])
    return np.frombuffer(words.astype(">u8").tobytes(), np.uint8)[: first[-1]], first


def marked(raw: np.ndarray, first: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffs a zero behind each 255 and puts restart markers between segments; also the segments' first bytes."""
    full = raw == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    marks = np.concatenate([[0], np.cumsum(~last)])
    seg = np.repeat(np.arange(len(number)), np.diff(first))
    out = np.zeros(len(raw) + stuffed[-1] + 2 * marks[-1], np.uint8)
    out[np.arange(len(raw)) + stuffed[:-1] + 2 * marks[seg]] = raw
    start = first + stuffed[first] + 2 * marks
    inner = np.flatnonzero(~last)
    out[start[inner + 1] - 2], out[start[inner + 1] - 1] = 255, 0xD0 + number[inner] % 8
    return out, start


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def scan_header(comps: tuple[int, ...], ss: int, se: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(comps)]) + b"".join(bytes([SAMPLING[c][0], 0]) for c in comps) + bytes([ss, se, high << 4 | low]))


def table_bytes(kind: int) -> bytes:
    counts, symbols = huffman_spec(kind)
    return segment(0xC4, bytes([kind << 4, *counts, *symbols]))


def header(cols: int, rows: int, note: bytes) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in SAMPLING)
    return b"".join([
        b"\xff\xd8", segment(0xFE, note), segment(0xDB, bytes([0] + [1] * 64)), segment(0xC2, frame),
        table_bytes(0), table_bytes(1), segment(0xDD, struct.pack(">H", RESTART)),
    ])


def encoded_scan(coefs: np.ndarray, layouts: list[Layout], scan: tuple) -> list[bytes]:
    """The scan's entropy-coded data of every image."""
    comps, ss, se, high, low = scan
    pieces: list[list[bytes]] = [[] for _ in layouts]
    if len(comps) > 1:
        ids = [x.interleaved() for x in layouts]
        step = 6 * RESTART
    else:
        ids = [x.component(comps[0]) for x in layouts]
        step = RESTART
    rows, image = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    place = np.concatenate([np.arange(len(x)) for x in ids])
    whole = np.flatnonzero(place % step == 0)  # first rows of segments
    cuts = np.append(whole[np.unique(np.searchsorted(whole, np.arange(0, len(rows), CHUNK), "right") - 1)], len(rows))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        r, im, pl = rows[a:z], image[a:z], place[a:z]
        number, new = pl // step, pl % step == 0
        seg = np.cumsum(new)
        if ss == 0:
            code, length = dc_tokens(coefs[r, 0], np.array([0, 0, 0, 0, 1, 2])[pl % 6], seg, high, low)
        elif high:
            code, length = refined_tokens(coefs[r, ss : se + 1], low)
        else:
            code, length = ac_tokens(coefs[r, ss : se + 1], low)
        starts = np.flatnonzero(new)
        raw, first = packed(code, length, starts)
        ends = np.append(starts[1:], len(r)) - 1
        total = np.array([len(x) for x in ids])
        last = pl[ends] == total[im[ends]] - 1
        out, start = marked(raw, first, number[starts], last)
        data, owner = out.tobytes(), im[starts]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            pieces[owner[i]].append(data[start[i] : start[j]])
    return [b"".join(p) for p in pieces]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload; a payload's length is a positive multiple of 192."""
    layouts, base = [], 0
    for p in payloads:
        x = Layout(*shape_for(len(p) // 64), base)
        layouts.append(x)
        base += 6 * x.units
    coefs = np.zeros((base, 64), np.int16)
    for p, x in zip(payloads, layouts, strict=True):
        v = np.frombuffer(p, np.uint8).reshape(-1, 64)
        coefs[x.base : x.base + len(v)] = ((v + np.uint8(SHIFT & 255)).astype(np.int16)) - 128
    parts = [[header(x.cols, x.rows, b"payload=%d" % len(p))] for p, x in zip(payloads, layouts, strict=True)]
    for scan in SCRIPT:
        head = scan_header(*scan)
        for part, data in zip(parts, encoded_scan(coefs, layouts, scan), strict=True):
            part += [head, data]
    return [b"".join([*part, b"\xff\xd9"]) for part in parts]


# -- decoding ----------------------------------------------------------------------------------------------------------


@dataclass
class Parsed:
    """One file's layout, quantiser, note and scans: (parameters, table kind and spec, restart, data)."""

    layout: Layout
    steps: np.ndarray
    note: bytes
    scans: list[tuple]


def parse(data: bytes, base: int) -> Parsed:
    at, tables, restart, note, scans, steps, layout = 2, {}, 0, b"", [], {}, None
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]  # markers that end entropy-coded data
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            note = body
        elif marker == 0xDB:
            steps[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC4:
            tables[body[0] >> 4] = body[1:]
        elif marker == 0xC2:
            _, h, w, _ = struct.unpack(">BHHB", body[:6])
            layout = Layout(w // 16, h // 16, base)
        elif marker == 0xDA:
            comps = tuple(body[1 + 2 * k] - 1 for k in range(body[0]))
            ss, se, bits = body[-3:]
            end = int(ends[np.searchsorted(ends, at)])
            kind = int(ss > 0)
            scans.append(((comps, ss, se, bits >> 4, bits & 15), kind, tables[kind], restart, data[at:end]))
            at = end
    return Parsed(layout, steps[0], note, scans)


def windows(raw: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on."""
    padded = np.concatenate([raw, np.full(16, 255, np.uint8)])
    return np.ndarray(len(raw) + 8, ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def segments(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers, each segment's first byte, and each segment's file."""
    raw = np.frombuffer(b"".join(datas), np.uint8)
    sizes = np.array([len(d) for d in datas])
    file_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    nxt = np.append(raw[1:], 0)
    mark = (raw == 255) & (nxt >= 0xD0) & (nxt <= 0xD7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | ((raw[:-1] == 255) & (raw[1:] == 0))
    kept = np.concatenate([[0], np.cumsum(~drop)])
    starts = np.concatenate([file_start, np.flatnonzero(mark) + 2])
    owner = np.concatenate([np.arange(len(datas)), np.searchsorted(file_start, np.flatnonzero(mark), "right") - 1])
    order = np.argsort(starts, kind="stable")
    return raw[~drop], kept[starts[order]], owner[order]


def decode_dc(coefs, raw, bit, rows, comp, count, table, low) -> None:
    w_at, pred, p = windows(raw), np.zeros((len(bit), 3), np.int64), bit.copy()
    lanes = np.arange(len(bit))
    for j in range(int(count.max(initial=0))):
        lanes = lanes[count[lanes] > j]
        w = w_at[p[lanes] >> 3] << (p[lanes] & 7).astype(np.uint64)
        t = table[(w >> np.uint64(48)).astype(np.int64)]
        n, size = t & 255, t >> 16
        v = ((w << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        v = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)
        c = comp[j % len(comp)]
        pred[lanes, c] += v
        coefs[rows[lanes] if rows.ndim == 1 else rows[lanes, j], 0] = pred[lanes, c] << low
        p[lanes] += n + size


def decode_ac(coefs, raw, bit, order, start, stop, table, ss, se, low) -> None:
    """First pass over a band: one symbol of each segment at a time. order[start:stop] are a segment's blocks."""
    w_at, flat = windows(raw), coefs.reshape(-1)
    p, b, e = bit.copy(), start.copy(), stop.copy()
    k = np.full(len(p), ss, np.int64)
    base = order[b] * 64
    while len(p):
        w = w_at[p >> 3] << (p & 7).astype(np.uint64)
        t = table[(w >> np.uint64(48)).astype(np.int64)]
        n, run, size = t & 255, t >> 8 & 255, t >> 16
        w <<= n.astype(np.uint64)
        empty = size == 0
        if empty.any():
            ends = empty & (run < 15)
            extra = np.where(ends, run, size)
            v = (w >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
            k += np.where(ends, 0, run)
            put = ~empty
            value = np.where(v < (1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v) << low
            flat[(base + k)[put]] = value[put]
            k += 1
            p += n + extra
            done = ends | (k > se)
            b += np.where(ends, (1 << np.where(ends, run, 0)) + v, done)
        else:
            v = (w >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            k += run
            flat[base + k] = np.where(v < (1 << (size - 1)), v - (1 << size) + 1, v) << low
            k += 1
            p += n + size
            done = k > se
            b += done
        if done.any():
            k[done] = ss
            live = b < e
            if not live.all():
                p, b, e, k = p[live], b[live], e[live], k[live]
            base = order[b] * 64


def refine_slowly(coefs, raw, p, blocks, table, ss, se, low) -> None:
    """The general refinement of one segment, bit by bit."""

    def bits(n: int) -> int:
        nonlocal p
        out = 0
        for _ in range(n):
            out, p = out << 1 | (int(raw[p >> 3]) >> 7 - (p & 7) & 1 if p >> 3 < len(raw) else 1), p + 1
        return out

    def symbol() -> tuple[int, int]:
        nonlocal p
        now, p = p, p
        ahead = bits(16)
        t = int(table[ahead])
        p = now + (t & 255)
        return t >> 8 & 255, t >> 16

    def correct(i: int, k: int) -> None:
        if bits(1):
            coefs[i, k] += (1 << low) if coefs[i, k] > 0 else -(1 << low)

    waiting = 0
    for i in blocks:
        k = ss
        while k <= se and not waiting:
            run, size = symbol()
            value = 0
            if size:
                value = (1 << low) if bits(1) else -(1 << low)
            elif run < 15:
                waiting = (1 << run) + bits(run)
                break
            while k <= se:
                if coefs[i, k]:
                    correct(i, k)
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if value and k <= se:
                coefs[i, k] = value
            k += 1
        if waiting:
            for j in range(k, se + 1):
                if coefs[i, j]:
                    correct(i, j)
            waiting -= 1


def refine_ac(coefs, raw, bit, order, start, stop, table, ss, se, low) -> None:
    w = windows(raw)[bit >> 3] << (bit & 7).astype(np.uint64)
    t = table[(w >> np.uint64(48)).astype(np.int64)]
    plain = (stop - start == 1) & (t >> 8 == 0)  # one block, whose first symbol ends it: corrections only
    for i in np.flatnonzero(~plain):
        refine_slowly(coefs, raw, int(bit[i]), order[start[i] : stop[i]], table, ss, se, low)
    blocks, begin = order[start[plain]], bit[plain] + (t[plain] & 255)
    band = coefs[blocks, ss : se + 1]
    row, k = np.nonzero(band)
    count = np.bincount(row, minlength=len(blocks))
    pos = begin[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    one = (raw[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1
    v = band[row, k]
    coefs[blocks[row], k + ss] = v + np.sign(v) * (one.astype(np.int16) << low)


def decode_group(coefs: np.ndarray, layouts: list[Layout], scan: tuple, kind: int, spec: bytes, restart: int, datas: list[bytes]) -> None:
    comps, ss, se, high, low = scan
    table = decoder_table(list(spec[:16]), list(spec[16:]))
    ids = [x.interleaved() if len(comps) > 1 else x.component(comps[0]) for x in layouts]
    unit = 6 if len(comps) > 1 else 1
    sizes = np.array([len(x) for x in ids])
    step = np.where(restart > 0, restart * unit, sizes)
    raw, first, owner = segments(datas)
    order, offset = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    start = offset[owner] + number * step[owner]
    stop = np.minimum(start + step[owner], offset[owner] + sizes[owner])
    bit = first.astype(np.int64) * 8
    for a in range(0, len(bit), CHUNK):
        s = slice(a, a + CHUNK)
        lo = int(first[a])
        hi = int(first[a + CHUNK]) if a + CHUNK < len(bit) else len(raw)
        own, at = raw[lo : hi], bit[s] - 8 * lo
        if ss == 0:
            count = (stop - start)[s]
            if high:
                seg = np.repeat(np.arange(len(count)), count)
                j = np.arange(len(seg)) - (np.cumsum(count) - count)[seg]
                pos = at[seg] + j
                one = (own[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1
                coefs[order[start[s][seg] + j], 0] |= one.astype(np.int16) << low
            else:
                widest = int(count.max())
                rows = order[np.minimum(start[s][:, None] + np.arange(widest), len(order) - 1)]
                comp = np.array([0, 0, 0, 0, 1, 2]) if len(comps) > 1 else np.array([comps[0]])
                decode_dc(coefs, own, at, rows, comp, count, table, low)
        elif high:
            refine_ac(coefs, own, at, order, start[s], stop[s], table, ss, se, low)
        else:
            decode_ac(coefs, own, at, order, start[s], stop[s], table, ss, se, low)


def coefficients(files: list[bytes]) -> tuple[np.ndarray, list[Parsed]]:
    """Quantised coefficients in zigzag order of all blocks of all files."""
    parsed, base = [], 0
    for f in files:
        x = parse(f, base)
        parsed.append(x)
        base += 6 * x.layout.units
    coefs = np.zeros((base, 64), np.int16)
    for step in range(max((len(x.scans) for x in parsed), default=0)):
        groups: dict[tuple, list[Parsed]] = {}
        for x in parsed:
            if step < len(x.scans):
                groups.setdefault(x.scans[step][:4], []).append(x)
        for key, own in groups.items():
            decode_group(coefs, [x.layout for x in own], *key, [x.scans[step][4] for x in own])
    return coefs, parsed


def payload_of(coefs: np.ndarray, x: Parsed) -> bytes:
    n = int(x.note.split(b"=")[1])
    v = coefs[x.layout.base : x.layout.base + n // 64]
    return (v + 128 - SHIFT).astype(np.uint8).tobytes()


def _basis() -> np.ndarray:
    """Rows: zigzag coefficients; columns: pixels; in units of 2^-14."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * (1 << 14))


BASIS = _basis()


def pixels(coefs: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Inverse transform of blocks: samples 0 to 255, n x 8 x 8."""
    out = np.empty((len(coefs), 64), np.uint8)
    for a in range(0, len(coefs), CHUNK):
        exact = (coefs[a : a + CHUNK] * steps).astype(np.float64) @ BASIS  # integers below 2^53
        out[a : a + CHUNK] = np.clip((exact.astype(np.int64) + (1 << 13) >> 14) + 128, 0, 255)
    return out.reshape(-1, 8, 8)


def plane(blocks: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return blocks.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)


def rgb_of(blocks: np.ndarray, x: Layout) -> np.ndarray:
    """The image as height x width x 3 bytes, chroma brought to full resolution."""
    own, n = blocks[x.base : x.base + 6 * x.units], x.units
    y = plane(own[: 4 * n], 2 * x.rows, 2 * x.cols).astype(np.int32)
    cb, cr = (plane(own[k * n : (k + 1) * n], x.rows, x.cols).repeat(2, 0).repeat(2, 1).astype(np.int32) - 128 for k in (4, 5))
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + (91881 * cr + half >> 16), 0, 255)
    out[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + half >> 16), 0, 255)
    out[..., 2] = np.clip(y + (116130 * cb + half >> 16), 0, 255)
    return out


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean colour in thousandths, and an average hash of 8 x 8 cells."""
    h, w, _ = rgb.shape
    total = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    cells = rgb.sum(2, dtype=np.int32).reshape(8, h // 8, 8, w // 8).sum((1, 3), dtype=np.int64).ravel()
    bits = np.packbits(64 * cells > cells.sum()).tobytes().hex()
    return f"{w}x{h}:" + ",".join(str(int(t) * 1000 // (h * w)) for t in total) + f":{bits}"
