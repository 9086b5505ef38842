"""Baseline JPEG of 8-bit samples, as GeoTIFF blocks have it: streams with tables of their own or from the directory.

Entropy coding goes symbol by symbol; transforms, colours and sampling are numpy over all blocks at once.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections import Counter
from functools import lru_cache

import numpy as np

# Fixed values of the format: the quantisation tables of ITU-T T.81, annex K, row by row.
_LUMINANCE = """
16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99
"""
_CHROMINANCE = """
17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99
"""


def _zigzag() -> np.ndarray:
    """Row-major places of the coefficients in the order of the stream: diagonal by diagonal, in turn up and down."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


ZIGZAG = _zigzag()
_DCT = np.array([[math.sqrt((1 if k == 0 else 2) / 8) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: length of the code times 256, plus its symbol."""
    out: list[int] = []
    at = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out += [length << 8 | symbol] * (1 << (16 - length))
        at += n
    return out + [0] * (65536 - len(out))


def _segments(data: bytes):
    """(marker, payload) of each segment up to the scan; then (None, what follows its header)."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("damaged JPEG data")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            yield None, data[at:]
            return


def _scan(data: bytes, units: list[tuple[int, int, list[int], list[int]]], n: int, per: int, into: np.ndarray, first: int) -> None:
    """Decode ``n`` MCUs of one restart interval. ``units``: (component, its block within the MCU, DC table, AC table);
    blocks go to rows of ``into`` from ``first`` on, ``per`` an MCU."""
    data += b"\xff" * 16
    held = have = at = 0
    before = [0] * 4
    place, value = [], []
    row = 64 * first
    for _ in range(n):
        for component, _, dc, ac in units:
            if have < 32:
                held = (held & ((1 << have) - 1)) << 32 | int.from_bytes(data[at : at + 4], "big")
                have, at = have + 32, at + 4
            code = dc[held >> (have - 16) & 0xFFFF]
            if not code:
                raise ValueError("damaged JPEG data")
            have -= code >> 8
            if size := code & 255:
                have -= size
                v = held >> have & ((1 << size) - 1)
                before[component] += v if v >> (size - 1) else v - (1 << size) + 1
            place.append(row)
            value.append(before[component])
            k = 1
            while k < 64:
                if have < 32:
                    held = (held & ((1 << have) - 1)) << 32 | int.from_bytes(data[at : at + 4], "big")
                    have, at = have + 32, at + 4
                code = ac[held >> (have - 16) & 0xFFFF]
                have -= code >> 8
                run, size = code >> 4 & 15, code & 15
                if not size:
                    if run < 15:
                        break
                    k += 16
                    continue
                k += run
                have -= size
                v = held >> have & ((1 << size) - 1)
                if k > 63 or at > len(data):
                    raise ValueError("damaged JPEG data")
                place.append(row + k)
                value.append(v if v >> (size - 1) else v - (1 << size) + 1)
                k += 1
            row += 64
    into.reshape(-1)[place] = value


def decode(data: bytes, tables: bytes = b"") -> np.ndarray:
    """Samples (rows, cols, components) as they were coded, without a change of colours."""
    quant: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], list[int]] = {}
    frame, scan, interval, body = None, None, 0, b""
    for part in (tables, data):
        for marker, seg in _segments(part):
            if marker == 0xDB:
                while seg:
                    wide, n = seg[0] >> 4, seg[0] & 15
                    size = 128 if wide else 64
                    quant[n] = np.frombuffer(seg[1 : 1 + size], ">u2" if wide else "u1").astype(float)
                    seg = seg[1 + size :]
            elif marker == 0xC4:
                while seg:
                    n = sum(seg[1:17])
                    codes[seg[0] >> 4, seg[0] & 15] = _lookup(bytes(seg[1:17]), bytes(seg[17 : 17 + n]))
                    seg = seg[17 + n :]
            elif marker in (0xC0, 0xC1):
                if seg[0] != 8:
                    raise NotImplementedError("only 8-bit JPEG is supported")
                height, width, n = struct.unpack(">HHB", seg[1:6])
                frame = height, width, [(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(n)]
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise NotImplementedError("only baseline JPEG is supported")
            elif marker == 0xDD:
                interval = struct.unpack(">H", seg[:2])[0]
            elif marker == 0xDA:
                scan = {seg[1 + 2 * i]: (seg[2 + 2 * i] >> 4, seg[2 + 2 * i] & 15) for i in range(seg[0])}
            elif marker is None:
                body = seg
    if frame is None or scan is None or len(scan) != len(frame[2]):
        raise ValueError("no JPEG image in one scan")
    height, width, components = frame
    if len(components) == 1:
        components = [(components[0][0], 1, 1, components[0][3])]
    across, down = max(c[1] for c in components), max(c[2] for c in components)
    cols, rows = -(-width // (8 * across)), -(-height // (8 * down))
    units = [(i, b, codes[0, scan[c][0]], codes[1, scan[c][1]]) for i, (c, h, v, _) in enumerate(components) for b in range(h * v)]
    coefficients = np.zeros((rows * cols * len(units), 64), np.int32)
    end = re.search(rb"\xff[\x01-\xcf\xd8-\xfe]", body)
    step = interval or rows * cols
    for n, part in enumerate(re.split(rb"\xff[\xd0-\xd7]", body[: end.start()] if end else body)):
        todo = min(step, rows * cols - n * step)
        if todo > 0:
            _scan(part.replace(b"\xff\x00", b"\xff"), units, todo, len(units), coefficients, n * step * len(units))
    out = np.zeros((height, width, len(components)), np.uint8)
    mcus = coefficients.reshape(rows, cols, len(units), 64)
    at = 0
    for i, (_, h, v, q) in enumerate(components):
        natural = np.zeros((rows, cols, h * v, 64))
        natural[..., ZIGZAG] = mcus[:, :, at : at + h * v] * quant[q]
        at += h * v
        blocks = np.einsum("ku,...kl,lv->...uv", _DCT, natural.reshape(rows, cols, v, h, 8, 8), _DCT, optimize=True)
        plane = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, cols * h * 8)
        plane = plane.repeat(down // v, axis=0).repeat(across // h, axis=1)
        out[:, :, i] = plane[:height, :width]
    return out


def to_rgb(a: np.ndarray) -> np.ndarray:
    """Luma and colour differences to red, green and blue."""
    y, b, r = (a[:, :, i].astype(float) - (128 if i else 0) for i in range(3))
    rgb = np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def from_rgb(a: np.ndarray) -> np.ndarray:
    r, g, b = (a[:, :, i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    out = np.stack((y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402), axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def quantisation(quality: int) -> list[np.ndarray]:
    """Luminance and chrominance tables for a quality of 1 to 100, row by row."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip(np.floor((np.array(t.split(), float) * scale + 50) / 100), 1, 255) for t in (_LUMINANCE, _CHROMINANCE)]


def _code_lengths(count: Counter) -> tuple[bytes, bytes]:
    """(codes of each length, symbols) of a Huffman code of at most 16 bits that leaves the code of all ones free."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(count.items()))] + [(0, 1 << 20, (-1,))]
    heapq.heapify(heap)
    depth: Counter = Counter()
    serial = 1 << 21
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, serial, a + b))
        serial += 1
    have = Counter(depth.values())
    for length in range(max(have), 16, -1):  # two leaves that are too deep: one takes their parent's place, the other splits a leaf higher up
        while have[length] > 0:
            up = length - 2
            while not have[up]:
                up -= 1
            have[length] -= 2
            have[length - 1] += 1
            have[up + 1] += 2
            have[up] -= 1
    have[max(k for k, n in have.items() if n)] -= 1  # the reserved code
    order = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], s))
    return bytes(have[k] for k in range(1, 17)), bytes(order)


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = code, length
            code += 1
        at += n
        code <<= 1
    return out


def encode(a: np.ndarray, quality: int = 75, colours: bool = False) -> bytes:
    """A stream with its own tables, without subsampling. ``colours``: three bands are coded as luma and differences."""
    if a.dtype != np.uint8 or not 1 <= a.shape[2] <= 4:
        raise ValueError("JPEG takes one to four bands of 8 bits")
    height, width, bands = a.shape
    a = from_rgb(a) if colours else a
    rows, cols = -(-height // 8), -(-width // 8)
    padded = np.pad(a, ((0, rows * 8 - height), (0, cols * 8 - width), (0, 0)), mode="edge").astype(float) - 128
    blocks = padded.reshape(rows, 8, cols, 8, bands).transpose(0, 2, 4, 1, 3)
    tables = quantisation(quality)
    kind = [1 if colours and i else 0 for i in range(bands)]
    spectrum = np.einsum("ku,...uv,lv->...kl", _DCT, blocks, _DCT, optimize=True).reshape(rows * cols, bands, 64)
    levels = np.rint(spectrum / np.array([tables[k] for k in kind])).astype(int)[..., ZIGZAG]
    levels[..., 1:] = np.clip(levels[..., 1:], -1023, 1023)
    dc = levels[:, :, 0].copy()
    levels[1:, :, 0] -= dc[:-1]
    # Symbols: (table class, table, symbol, extra bits, their number), block by block.
    symbols: list[tuple[int, int, int, int, int]] = []
    for block, k in zip(levels.reshape(-1, 64), kind * (rows * cols), strict=True):
        at = np.flatnonzero(block).tolist()
        v = int(block[0])
        size = abs(v).bit_length()
        symbols.append((0, k, size, v if v >= 0 else v + (1 << size) - 1, size))
        last = 0
        for i in at:
            if not i:
                continue
            zeros = i - last - 1
            while zeros > 15:
                symbols.append((1, k, 0xF0, 0, 0))
                zeros -= 16
            v = int(block[i])
            size = abs(v).bit_length()
            symbols.append((1, k, zeros << 4 | size, v if v > 0 else v + (1 << size) - 1, size))
            last = i
        if last < 63:
            symbols.append((1, k, 0, 0, 0))
    made = {}
    for c, k in {(s[0], s[1]) for s in symbols} | {(c, k) for c in (0, 1) for k in set(kind)}:
        made[c, k] = _code_lengths(Counter(s[2] for s in symbols if s[:2] == (c, k)) or Counter([0]))
    codes = {key: _codes(*t) for key, t in made.items()}
    out = bytearray()
    held = have = 0
    for c, k, symbol, extra, size in symbols:
        code, length = codes[c, k][symbol]
        held, have = (held << length | code) << size | extra, have + length + size
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
        held &= (1 << have) - 1
    if have:
        out.append((held << (8 - have) | (1 << (8 - have)) - 1) & 255)

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    head = b"\xff\xd8" + b"".join(segment(0xDB, bytes([k]) + tables[k][ZIGZAG].astype(np.uint8).tobytes()) for k in sorted(set(kind)))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, bands) + b"".join(bytes([i + 1, 0x11, k]) for i, k in enumerate(kind)))
    head += b"".join(segment(0xC4, bytes([c << 4 | k]) + counts + order) for (c, k), (counts, order) in sorted(made.items()))
    head += segment(0xDA, bytes([bands]) + b"".join(bytes([i + 1, k << 4 | k]) for i, k in enumerate(kind)) + b"\x00\x3f\x00")
    return head + bytes(out).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
