"""Decoding of JPEG 2000 (ITU-T T.800): code streams and the files that hold them, whole, by windows, or at 1 / 2**n.

A tile's packet headers are read once; then only those code blocks are decoded that a window needs, with a margin for the
wavelet's reach. Wavelets and colours are numpy over whole subbands; the arithmetic decoder goes bit by bit, so time follows
the number of code blocks. Each is independent: spread windows over tasks.

Not supported, and said so: arithmetic bypass and vertically causal contexts, progression changes and packed headers,
components of different sizes or depths.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the arithmetic decoder: probability of the less probable symbol, next states, whether its sense turns.
_STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
# Fixed values of the 9/7 wavelet.
_ALPHA, _BETA, _GAMMA, _DELTA, _K = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001
_RUN, _UNIFORM = 17, 18


class Arithmetic:
    """The decoder of one segment; ``bit(context)``. Contexts live in lists that segments of a block may share."""

    def __init__(self, data: bytes, state: list[int], sense: list[int]):
        self.data, self.state, self.sense = data + b"\xff\xff", state, sense
        self.at, self.a = 0, 0x8000
        self.c = self.data[0] << 16
        self.ct = 0
        self._byte()
        self.c <<= 7
        self.ct -= 7

    def _byte(self) -> None:
        if self.data[self.at] == 0xFF:
            if self.data[self.at + 1] > 0x8F:
                self.c += 0xFF00
                self.ct = 8
                return
            self.at += 1
            self.c += self.data[self.at] << 9
            self.ct = 7
        else:
            self.at += 1
            self.c += self.data[self.at] << 8
            self.ct = 8

    def bit(self, context: int) -> int:
        probability, likely, unlikely, turn = _STATES[self.state[context]]
        out = self.sense[context]
        self.a -= probability
        if self.c >> 16 < probability:
            less = self.a >= probability
            self.a = probability
        else:
            self.c -= probability << 16
            if self.a & 0x8000:
                return out
            less = self.a < probability
        if less:
            out ^= 1
            if turn:
                self.sense[context] ^= 1
            self.state[context] = unlikely
        else:
            self.state[context] = likely
        while True:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if self.a & 0x8000:
                return out


def _zero_contexts(band: str) -> list[int]:
    """Context of a coefficient not yet significant, by 15 * horizontal + 5 * vertical + diagonal neighbours."""
    out = []
    for h in range(3):
        for v in range(3):
            for d in range(5):
                if band == "HH":
                    n = h + v
                    out.append(8 if d > 2 else (7 if n else 6) if d == 2 else 3 + min(n, 2) if d == 1 else min(n, 2))
                else:
                    a, b = (v, h) if band == "HL" else (h, v)
                    out.append(8 if a == 2 else (7 if b else 6 if d else 5) if a == 1 else 2 + b if b else min(d, 2))
    return out


_ZERO = {b: _zero_contexts(b) for b in ("LL", "HL", "LH", "HH")}
#: Context and sign flip by the clamped signs of horizontal and vertical neighbours, at 3 * (h + 1) + v + 1.
_SIGN = [(13, 1), (12, 1), (11, 1), (10, 1), (9, 0), (10, 0), (11, 0), (12, 0), (13, 0)]


def decode_block(segments: list[tuple[int, bytes]], width: int, height: int, band: str, planes: int, style: int) -> tuple[np.ndarray, int]:
    """Signed coefficients (rows, cols) of a code block and the lowest bit plane that was decoded.

    ``segments``: (coding passes, bytes), one unless passes end their segments. ``planes``: bit planes that aren't zero.
    """
    stride = width + 2
    size = stride * (height + 2)
    found, minus, near, seen, refined = bytearray(size), bytearray(size), bytearray(size), bytearray(size), bytearray(size)
    value = [0] * size
    zero = _ZERO[band]
    state, sense = [], []

    def reset() -> None:
        state[:] = [4] + [0] * 16 + [3, 46]
        sense[:] = [0] * 19

    def context(p: int) -> int:
        h = found[p - 1] + found[p + 1]
        v = found[p - stride] + found[p + stride]
        return zero[15 * h + 5 * v + found[p - stride - 1] + found[p - stride + 1] + found[p + stride - 1] + found[p + stride + 1]]

    def signed(q: int) -> int:
        return (1 - 2 * minus[q]) if found[q] else 0

    def appear(p: int, one: int) -> None:
        h, v = signed(p - 1) + signed(p + 1), signed(p - stride) + signed(p + stride)
        h, v = (h > 0) - (h < 0), (v > 0) - (v < 0)
        c, flip = _SIGN[3 * (h + 1) + v + 1]
        minus[p] = bit(c) ^ flip
        found[p], value[p] = 1, one
        for q in (p - stride - 1, p - stride, p - stride + 1, p - 1, p + 1, p + stride - 1, p + stride, p + stride + 1):
            near[q] = 1

    columns = [[(y + 1) * stride + x + 1 for y in range(top, min(top + 4, height))] for top in range(0, height, 4) for x in range(width)]
    reset()
    kind, plane, last = 2, planes - 1, planes
    for passes, data in segments:
        coder = Arithmetic(data, state, sense)
        bit = coder.bit
        for _ in range(passes):
            if plane < 0:
                break
            one = 1 << plane
            if kind == 0:
                for column in columns:
                    for p in column:
                        if near[p] and not found[p]:
                            seen[p] = 1
                            if bit(context(p)):
                                appear(p, one)
            elif kind == 1:
                for column in columns:
                    for p in column:
                        if found[p] and not seen[p]:
                            if bit(16 if refined[p] else 15 if near[p] else 14):
                                value[p] |= one
                            refined[p] = 1
            else:
                for column in columns:
                    k = 0
                    if len(column) == 4 and not any(near[p] or found[p] or seen[p] for p in column):
                        if not bit(_RUN):
                            continue
                        k = bit(_UNIFORM) << 1 | bit(_UNIFORM)
                        appear(column[k], one)
                        k += 1
                    for p in column[k:]:
                        if not found[p] and not seen[p] and bit(context(p)):
                            appear(p, one)
                seen = bytearray(size)
                if style & 32:
                    for _ in range(4):
                        bit(_UNIFORM)
            # A coefficient that appeared in this plane's first pass was seen, so the refinement leaves it alone.
            last = plane
            kind += 1
            if kind == 3:
                kind, plane = 0, plane - 1
            if style & 2:
                reset()
    a = np.array(value).reshape(height + 2, stride)[1:-1, 1:-1]
    s = np.frombuffer(bytes(minus), np.uint8).reshape(height + 2, stride)[1:-1, 1:-1]
    return np.where(s, -a, a), last


class _Header:
    """Bits of a packet's header: after a byte of ones a byte has seven."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.left = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            self.left = 7 if self.held == 0xFF else 8
            self.held = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
        self.left -= 1
        return self.held >> self.left & 1

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def end(self) -> int:
        if self.held == 0xFF:
            self.at += 1
        return self.at


class _TagTree:
    """A quadtree of minima that packet headers reveal step by step."""

    def __init__(self, width: int, height: int):
        self.levels = []
        while True:
            self.levels.append([[0, False] for _ in range(width * height)])  # lower bound, whether it is the value
            self.width = [*getattr(self, "width", []), width]
            if width * height <= 1:
                break
            width, height = -(-width // 2), -(-height // 2)

    def below(self, x: int, y: int, limit: int, header: _Header) -> bool:
        """Whether the value at (x, y) is below ``limit``; reads what it takes to know."""
        low = 0
        for k in range(len(self.levels) - 1, -1, -1):
            node = self.levels[k][(y >> k) * self.width[k] + (x >> k)]
            node[0] = max(node[0], low)
            while not node[1] and node[0] < limit:
                if header.bit():
                    node[1] = True
                else:
                    node[0] += 1
            low = node[0]
        return node[1] and node[0] < limit


@dataclass
class _Block:
    """A code block: its place in its subband, and what the packets brought."""

    x0: int
    y0: int
    x1: int
    y1: int
    column: int
    row: int
    included: bool = False
    planes: int = 0
    length_bits: int = 3
    segments: list = field(default_factory=list)


@dataclass
class _Precinct:
    blocks: list
    inclusion: _TagTree
    zero_planes: _TagTree


@dataclass
class _Band:
    kind: str
    level: int
    x0: int
    y0: int
    x1: int
    y1: int
    planes: int
    step: float
    precincts: list = field(default_factory=list)


@dataclass
class _Coding:
    """Coding parameters of a component."""

    levels: int
    cb_width: int
    cb_height: int
    style: int
    reversible: bool
    precincts: list[tuple[int, int]]


def _up(a: int, b: int) -> int:
    return -(-a // b)


class Image:
    """A JPEG 2000 image in memory. ``read`` gives samples (rows, cols, components) of a window."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\x4f":
            at = data.find(b"jp2c")
            if at < 0:
                raise ValueError("no JPEG 2000 code stream")
            size = struct.unpack(">I", data[at - 4 : at])[0]
            at += 12 if size == 1 else 4
            data = data[at:]
            if data[:2] != b"\xff\x4f":
                raise ValueError("no JPEG 2000 code stream")
        self.data = data
        self.parts: dict[int, list[tuple[int, int, list]]] = {}
        self._cache: dict[int, list] = {}
        self._parse()

    # Headers.

    def _parse(self) -> None:
        d, at = self.data, 2
        self.main: list[tuple[int, bytes]] = []
        while at + 4 <= len(d):
            marker, size = struct.unpack(">HH", d[at : at + 4])
            if marker == 0xFF90:
                break
            if marker == 0xFFD9:
                return
            body = d[at + 4 : at + 2 + size]
            if marker == 0xFF51:
                self._size(body)
            elif marker in (0xFF5F, 0xFF60):
                raise NotImplementedError("progression changes and packed headers are not supported")
            self.main.append((marker, body))
            at += 2 + size
        while at + 12 <= len(d) and d[at : at + 2] == b"\xff\x90":
            tile, length, _, _ = struct.unpack(">HIBB", d[at + 4 : at + 12])
            end = at + length if length else len(d) - 2
            own, p = [], at + 12
            while d[p : p + 2] != b"\xff\x93":
                marker, size = struct.unpack(">HH", d[p : p + 4])
                if marker in (0xFF5F, 0xFF61):
                    raise NotImplementedError("progression changes and packed headers are not supported")
                own.append((marker, d[p + 4 : p + 2 + size]))
                p += 2 + size
            self.parts.setdefault(tile, []).append((p + 2, min(end, len(d)), own))
            at = end

    def _size(self, b: bytes) -> None:
        self.x1, self.y1, self.x0, self.y0, self.tw, self.th, self.tx, self.ty, n = struct.unpack(">8IH", b[2:36])
        components = [tuple(b[36 + 3 * i : 39 + 3 * i]) for i in range(n)]
        if len(set(components)) != 1 or components[0][1:] != (1, 1):
            raise NotImplementedError("components of different sizes or depths are not supported")
        self.components, depth = n, components[0][0]
        self.bits, self.signed = (depth & 127) + 1, bool(depth & 128)
        if self.bits > 16:
            raise NotImplementedError("more than 16 bits are not supported")
        self.width, self.height = self.x1 - self.x0, self.y1 - self.y0
        self.across = _up(self.x1 - self.tx, self.tw)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(("i" if self.signed else "u") + ("1" if self.bits <= 8 else "2"))

    @property
    def levels(self) -> int:
        """How often the image can be halved: the fewest wavelet levels of any component of the first tile."""
        return min(c.levels for c in self._parameters(0)[2])

    def size(self, reduce: int = 0) -> tuple[int, int]:
        n = 1 << reduce
        return _up(self.x1, n) - _up(self.x0, n), _up(self.y1, n) - _up(self.y0, n)

    def _parameters(self, tile: int):
        """(general, quantisation, coding) of a tile: its own markers override those of the main header."""
        general, coding, steps = None, {}, {}
        own = [m for part in self.parts.get(tile, []) for m in part[2]]
        for marker, b in [*self.main, *own]:
            if marker == 0xFF52:
                general = b[0], b[1], struct.unpack(">H", b[2:4])[0], b[4]
                coding = {None: self._coding(b[0], b[5:])}
            elif marker == 0xFF53:
                wide = self.components > 256
                c, rest = (struct.unpack(">H", b[:2])[0], b[2:]) if wide else (b[0], b[1:])
                coding[c] = self._coding(rest[0], rest[1:])
            elif marker == 0xFF5C:
                steps = {None: b}
            elif marker == 0xFF5D:
                wide = self.components > 256
                c, rest = (struct.unpack(">H", b[:2])[0], b[2:]) if wide else (b[0], b[1:])
                steps[c] = rest
        if general is None or not steps:
            raise ValueError("a JPEG 2000 header lacks its coding parameters")
        every = range(self.components)
        return general, [steps.get(c, steps.get(None)) for c in every], [coding.get(c, coding.get(None)) for c in every]

    @staticmethod
    def _coding(flags: int, b: bytes) -> _Coding:
        levels, style = b[0], b[3]
        if style & 9:
            raise NotImplementedError("arithmetic bypass and vertically causal contexts are not supported")
        sizes = [(p & 15, p >> 4) for p in b[5 : 6 + levels]] if flags & 1 else [(15, 15)] * (levels + 1)
        return _Coding(levels, (b[1] & 15) + 2, (b[2] & 15) + 2, style, b[4] == 1, sizes)

    def _quantised(self, b: bytes, kind: str, level: int, coding: _Coding, index: int) -> tuple[int, float]:
        """(bit planes, step) of a subband."""
        guard, style = b[0] >> 5, b[0] & 31
        if style == 0:
            exponent, mantissa = b[1 + index] >> 3, 0
        else:
            v = struct.unpack(">H", b[1:3] if style == 1 else b[1 + 2 * index : 3 + 2 * index])[0]
            exponent, mantissa = v >> 11, v & 2047
            if style == 1:
                exponent -= coding.levels - level
        gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[kind]
        step = 1.0 if coding.reversible else 2.0 ** (self.bits + gain - exponent) * (1 + mantissa / 2048)
        return guard + exponent - 1, step

    # Packets.

    def _tile(self, tile: int) -> list:
        """For each component: (coding, bounds, resolutions), a resolution being (bounds, bands); packets read."""
        if tile in self._cache:
            return self._cache[tile]
        general, steps, codings = self._parameters(tile)
        p, q = tile % self.across, tile // self.across
        x0, x1 = max(self.tx + p * self.tw, self.x0), min(self.tx + (p + 1) * self.tw, self.x1)
        y0, y1 = max(self.ty + q * self.th, self.y0), min(self.ty + (q + 1) * self.th, self.y1)
        out, order = [], []
        for c, coding in enumerate(codings):
            resolutions, index = [], 0
            for r in range(coding.levels + 1):
                n = 1 << (coding.levels - r)
                rx0, ry0, rx1, ry1 = _up(x0, n), _up(y0, n), _up(x1, n), _up(y1, n)
                pw, ph = coding.precincts[r]
                bands = []
                for kind in ("LL",) if r == 0 else ("HL", "LH", "HH"):
                    level = coding.levels if r == 0 else coding.levels - r + 1
                    half = 1 << (level - 1) if level and kind != "LL" else 0
                    ox, oy = (half if kind in ("HL", "HH") else 0), (half if kind in ("LH", "HH") else 0)
                    whole = 1 << level
                    planes, step = self._quantised(steps[c], kind, level, coding, index)
                    index += 1
                    bands.append(_Band(kind, level, *(_up(v - o, whole) for v, o in ((x0, ox), (y0, oy), (x1, ox), (y1, oy))), planes, step))
                columns = range(rx0 >> pw, _up(rx1, 1 << pw)) if rx1 > rx0 and ry1 > ry0 else range(0)
                rows = range(ry0 >> ph, _up(ry1, 1 << ph)) if rx1 > rx0 and ry1 > ry0 else range(0)
                k = 0
                for py in rows:
                    for px in columns:
                        for band in bands:
                            band.precincts.append(self._precinct(band, px, py, pw - (r > 0), ph - (r > 0), coding))
                        order.append((r, c, k, max(y0, (py << ph) * n), max(x0, (px << pw) * n), bands, coding))
                        k += 1
                resolutions.append(((rx0, ry0, rx1, ry1), bands))
            out.append((coding, (x0, y0, x1, y1), resolutions))
        flags, progression, layers, self.transform = general
        key = {2: lambda t: (t[0], t[3], t[4], t[1], t[2]), 3: lambda t: (t[3], t[4], t[1], t[0], t[2]), 4: lambda t: (t[1], t[3], t[4], t[0], t[2])}.get(progression, lambda t: t[:3])
        order.sort(key=key)
        if progression == 0:
            sequence = [(t, layer) for layer in range(layers) for t in order]
        elif progression == 1:
            sequence = [(t, layer) for r in sorted({t[0] for t in order}) for layer in range(layers) for t in order if t[0] == r]
        else:
            sequence = [(t, layer) for t in order for layer in range(layers)]
        data = b"".join(self.data[a:b] for a, b, _ in self.parts.get(tile, []))
        at = 0
        for t, layer in sequence:
            if at >= len(data):
                break
            at = self._packet(data, at, [b.precincts[t[2]] for b in t[5]], [b.planes for b in t[5]], layer, t[6].style)
        self._cache = {tile: out} if len(self._cache) > 8 else self._cache | {tile: out}
        return out

    @staticmethod
    def _precinct(band: _Band, px: int, py: int, pw: int, ph: int, coding: _Coding) -> _Precinct:
        x0, x1 = max(band.x0, px << pw), min(band.x1, (px + 1) << pw)
        y0, y1 = max(band.y0, py << ph), min(band.y1, (py + 1) << ph)
        if x1 <= x0 or y1 <= y0:
            return _Precinct([], _TagTree(0, 0), _TagTree(0, 0))
        cw, ch = min(coding.cb_width, pw), min(coding.cb_height, ph)
        columns, rows = range(x0 >> cw, _up(x1, 1 << cw)), range(y0 >> ch, _up(y1, 1 << ch))
        blocks = [
            _Block(max(x0, i << cw), max(y0, j << ch), min(x1, (i + 1) << cw), min(y1, (j + 1) << ch), i - columns[0], j - rows[0]) for j in rows for i in columns
        ]
        return _Precinct(blocks, _TagTree(len(columns), len(rows)), _TagTree(len(columns), len(rows)))

    @staticmethod
    def _packet(data: bytes, at: int, precincts: list[_Precinct], planes: list[int], layer: int, style: int) -> int:
        if data[at : at + 2] == b"\xff\x91":
            at += 6
        h = _Header(data, at)
        brought = []
        if h.bit():
            for precinct, most in zip(precincts, planes, strict=True):
                for b in precinct.blocks:
                    if b.included:
                        if not h.bit():
                            continue
                    elif not precinct.inclusion.below(b.column, b.row, layer + 1, h):
                        continue
                    else:
                        b.included = True
                        zeros = 0
                        while not precinct.zero_planes.below(b.column, b.row, zeros + 1, h):
                            zeros += 1
                        b.planes = most - zeros
                    passes = 1
                    if h.bit():
                        passes = 2
                        if h.bit():
                            passes = 3 + (v := h.bits(2))
                            if v == 3:
                                passes = 6 + (v := h.bits(5))
                                if v == 31:
                                    passes = 37 + h.bits(7)
                    while h.bit():
                        b.length_bits += 1
                    if style & 4:
                        brought += [(b, 1, h.bits(b.length_bits)) for _ in range(passes)]
                    else:
                        brought.append((b, passes, h.bits(b.length_bits + passes.bit_length() - 1)))
        at = h.end()
        if data[at : at + 2] == b"\xff\x92":
            at += 2
        for b, passes, size in brought:
            b.segments.append((passes, data[at : at + size]))
            at += size
        return at

    # Samples.

    def _band(self, band: _Band, coding: _Coding, window: tuple[int, int, int, int]) -> np.ndarray:
        """Coefficients of a subband; zero in code blocks outside the window, which nothing inside depends on."""
        out = np.zeros((band.y1 - band.y0, band.x1 - band.x0), np.int64 if coding.reversible else float)
        wx0, wy0, wx1, wy1 = window
        for precinct in band.precincts:
            for b in precinct.blocks:
                if not b.segments or b.planes <= 0 or b.x1 <= wx0 or b.x0 >= wx1 or b.y1 <= wy0 or b.y0 >= wy1:
                    continue
                segments = b.segments if coding.style & 4 else [(sum(n for n, _ in b.segments), b"".join(s for _, s in b.segments))]
                a, last = decode_block(segments, b.x1 - b.x0, b.y1 - b.y0, band.kind, b.planes, coding.style)
                half = (1 << last) / 2
                if coding.reversible:
                    a = a + np.sign(a) * int(half)
                else:
                    a = (a + np.sign(a) * half) * band.step
                out[b.y0 - band.y0 : b.y1 - band.y0, b.x0 - band.x0 : b.x1 - band.x0] = a
        return out

    def _component(self, component, reduce: int, window: tuple[int, int, int, int]) -> np.ndarray:
        """A tile component at 1 / 2**reduce, right within the window (in coordinates of that size)."""
        coding, _, resolutions = component
        last = max(0, coding.levels - reduce)
        a = None
        for r in range(last + 1):
            (x0, y0, x1, y1), bands = resolutions[r]
            halvings = last - r
            scaled = [(v >> halvings) - 4 if k < 2 else _up(v, 1 << halvings) + 4 for k, v in enumerate(window)]
            if r:
                scaled = [(v >> 1) - 2 if k < 2 else _up(v, 2) + 2 for k, v in enumerate(scaled)]
            got = [self._band(b, coding, tuple(scaled)) for b in bands]
            a = got[0] if r == 0 else _join(a, *got, x0, y0, x1, y1, coding.reversible)
        for _ in range(max(0, reduce - coding.levels)):
            a = a[::2, ::2]
        return a

    def read(self, col: int, row: int, width: int, height: int, reduce: int = 0) -> np.ndarray:
        """Samples of a window of the image at 1 / 2**reduce, of whose tiles only those that it touches are read."""
        whole = self.size(reduce)
        if col < 0 or row < 0 or width <= 0 or height <= 0 or col + width > whole[0] or row + height > whole[1]:
            raise ValueError("the window goes beyond the image")
        n = 1 << reduce
        ox, oy = _up(self.x0, n), _up(self.y0, n)
        want = col + ox, row + oy, col + ox + width, row + oy + height
        out = np.zeros((height, width, self.components), self.dtype)
        for tile in range(self.across * _up(self.y1 - self.ty, self.th)):
            p, q = tile % self.across, tile // self.across
            tx0, tx1 = (_up(v, n) for v in (max(self.tx + p * self.tw, self.x0), min(self.tx + (p + 1) * self.tw, self.x1)))
            ty0, ty1 = (_up(v, n) for v in (max(self.ty + q * self.th, self.y0), min(self.ty + (q + 1) * self.th, self.y1)))
            x0, y0, x1, y1 = max(want[0], tx0), max(want[1], ty0), min(want[2], tx1), min(want[3], ty1)
            if x0 >= x1 or y0 >= y1:
                continue
            components = self._tile(tile)
            planes = [self._component(c, reduce, (x0, y0, x1, y1))[y0 - ty0 : y1 - ty0, x0 - tx0 : x1 - tx0] for c in components]
            if self.transform and len(planes) >= 3:
                planes[:3] = _colours(*planes[:3], components[0][0].reversible)
            a = np.stack([np.rint(v) for v in planes], axis=2)
            low, high = (-(1 << (self.bits - 1)), (1 << (self.bits - 1)) - 1) if self.signed else (0, (1 << self.bits) - 1)
            a = np.clip(a + (0 if self.signed else 1 << (self.bits - 1)), low, high)
            out[y0 - want[1] : y1 - want[1], x0 - want[0] : x1 - want[0]] = a
        return out


def _colours(a: np.ndarray, b: np.ndarray, c: np.ndarray, reversible: bool) -> list[np.ndarray]:
    if reversible:
        green = a - ((b + c) >> 2)
        return [c + green, green, b + green]
    return [a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b]


def _join(ll: np.ndarray, hl: np.ndarray, lh: np.ndarray, hh: np.ndarray, x0: int, y0: int, x1: int, y1: int, reversible: bool) -> np.ndarray:
    """The resolution that four subbands make."""
    a = np.zeros((y1 - y0, x1 - x0), ll.dtype)
    for part, ox, oy in ((ll, 0, 0), (hl, 1, 0), (lh, 0, 1), (hh, 1, 1)):
        a[(oy - y0) % 2 :: 2, (ox - x0) % 2 :: 2] = part
    return _synthesise(_synthesise(a.T, x0, reversible).T, y0, reversible)


def _synthesise(a: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    """Undo the wavelet along the first axis; ``start`` is the first sample's coordinate."""
    n = len(a)
    if n == 0:
        return a
    if n == 1:
        return a if start % 2 == 0 else a >> 1 if reversible else a / 2
    x = np.pad(a, ((4, 4), (0, 0)), mode="reflect")
    even, odd = start % 2, 1 - start % 2

    def lift(first: int, change) -> None:
        at = slice(first if first else 2, len(x) - 1, 2)
        size = len(range(*at.indices(len(x))))
        x[at] += change(x[at.start - 1 :: 2][:size], x[at.start + 1 :: 2][:size])

    if reversible:
        lift(even, lambda p, q: -((p + q + 2) >> 2))
        lift(odd, lambda p, q: (p + q) >> 1)
    else:
        x[even::2] *= _K
        x[odd::2] /= _K
        for first, factor in ((even, _DELTA), (odd, _GAMMA), (even, _BETA), (odd, _ALPHA)):
            lift(first, lambda p, q, f=factor: -f * (p + q))
    return x[4:-4]


def halvings(scale: int, most: int = 4) -> int:
    """How many halvings a scale holds, up to ``most``."""
    return min((scale & -scale).bit_length() - 1, most) if scale > 0 else 0


REGION = 1024


def regions(width: int, height: int, window: tuple[int, int, int, int] | None = None, size: int = REGION) -> list[tuple[int, int, int, int]]:
    """Windows (col, row, width, height) of a grid of ``size`` that cover an image or a window of it; one a task can decode."""
    col, row, w, h = window or (0, 0, width, height)
    columns, rows = range(col // size, -(-(col + w) // size)), range(row // size, -(-(row + h) // size))
    out = []
    for j in rows:
        for i in columns:
            x0, y0, x1, y1 = max(col, i * size), max(row, j * size), min(col + w, (i + 1) * size), min(row + h, (j + 1) * size)
            out.append((x0, y0, x1 - x0, y1 - y0))
    return out


def decode_regions(spark, path: str, window: tuple[int, int, int, int] | None = None, reduce: int = 0, size: int = REGION):
    """A row per region of a file: raster_id, layer (the reduction), row_off, col_off, rows, cols, bands, dtype, data.

    Regions are spread over tasks, each of which reads the file and decodes the code blocks of its own.
    """
    from gridloom.sources import tiff

    with tiff.open_file(path) as f:
        image = Image(f.read())
    found = regions(*image.size(reduce), window, size)

    def run(batches):
        import pandas as pd

        with tiff.open_file(path) as f:
            own = Image(f.read())
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = own.read(r.col_off, r.row_off, r.cols, r.rows, reduce)
                kind = {"u": "uint", "i": "int"}[a.dtype.kind]
                rows.append((path, reduce, r.row_off, r.col_off, r.rows, r.cols, a.shape[2], f"{kind}{8 * a.dtype.itemsize}", a.astype(a.dtype.newbyteorder("<")).tobytes()))
            yield pd.DataFrame(rows, columns=["raster_id", "layer", "row_off", "col_off", "rows", "cols", "bands", "dtype", "data"])

    parts = min(len(found), 4 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame(found, "col_off int, row_off int, cols int, rows int").repartition(parts)
    return table.mapInPandas(run, "raster_id string, layer int, row_off int, col_off int, rows int, cols int, bands int, dtype string, data binary")
