"""A plain JPEG 2000 encoder for tests: one layer, one quality, any tiles, levels and precincts, both wavelets."""

import math
import struct

import numpy as np

from gridloom.sources import jpeg2000 as j2


class Arithmetic:
    """The encoder that belongs to the standard's decoder."""

    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray(b"\0")
        self.state, self.sense = [4] + [0] * 16 + [3, 46], [0] * 19

    def put(self, context: int, bit: int) -> None:
        q, likely, unlikely, turn = j2._STATES[self.state[context]]
        self.a -= q
        if bit == self.sense[context]:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            self.state[context] = likely
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            if turn:
                self.sense[context] ^= 1
            self.state[context] = unlikely
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()

    def _byte(self) -> None:
        if self.out[-1] == 0xFF:
            self._seven()
        elif self.c < 0x8000000:
            self._eight()
        else:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
                self._seven()
            else:
                self._eight()

    def _seven(self) -> None:
        self.out.append(self.c >> 20 & 0xFF)
        self.c &= 0xFFFFF
        self.ct = 7

    def _eight(self) -> None:
        self.out.append(self.c >> 19 & 0xFF)
        self.c &= 0x7FFFF
        self.ct = 8

    def end(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        return bytes(self.out[1:] if self.out[-1] != 0xFF else self.out[1:-1])


def block(a: np.ndarray, band: str) -> tuple[bytes, int, int]:
    """(bytes, passes, bit planes) of a code block, coefficient by coefficient as the standard's flow charts have it."""
    h, w = a.shape
    planes = int(np.abs(a).max(initial=0)).bit_length()
    if not planes:
        return b"", 0, 0
    m, zero = Arithmetic(), j2._ZERO[band]
    known, refined = np.zeros((h + 2, w + 2), int), np.zeros((h, w), bool)
    sign = np.pad(np.where(a < 0, -1, 1), 1)

    def around(y, x):
        k = known[y : y + 3, x : x + 3]
        return k[1, 0] + k[1, 2], k[0, 1] + k[2, 1], k[0, 0] + k[0, 2] + k[2, 0] + k[2, 2]

    def appear(y, x):
        s = (known * sign)[y : y + 3, x : x + 3]
        c, flip = j2._SIGN[3 * (int(np.sign(s[1, 0] + s[1, 2])) + 1) + int(np.sign(s[0, 1] + s[2, 1])) + 1]
        m.put(c, int(a[y, x] < 0) ^ flip)
        known[y + 1, x + 1] = 1

    def code(y, x, bit):
        i, v, d = around(y, x)
        m.put(zero[15 * i + 5 * v + d], bit)
        if bit:
            appear(y, x)

    passes = 0
    for plane in range(planes - 1, -1, -1):
        bits, seen = np.abs(a) >> plane & 1, np.zeros((h, w), bool)
        scan = [(y, x) for top in range(0, h, 4) for x in range(w) for y in range(top, min(top + 4, h))]
        if plane < planes - 1:
            for y, x in scan:
                if not known[y + 1, x + 1] and sum(around(y, x)):
                    seen[y, x] = True
                    code(y, x, int(bits[y, x]))
            for y, x in scan:
                if known[y + 1, x + 1] and not seen[y, x]:
                    m.put(16 if refined[y, x] else 15 if sum(around(y, x)) else 14, int(bits[y, x]))
                    refined[y, x] = True
            passes += 2
        for top in range(0, h, 4):
            for x in range(w):
                ys = list(range(top, min(top + 4, h)))
                if len(ys) == 4 and not any(known[y + 1, x + 1] or seen[y, x] or sum(around(y, x)) for y in ys):
                    first = next((k for k, y in enumerate(ys) if bits[y, x]), None)
                    m.put(17, int(first is not None))
                    if first is None:
                        continue
                    m.put(18, first >> 1)
                    m.put(18, first & 1)
                    appear(ys[first], x)
                    ys = ys[first + 1 :]
                for y in ys:
                    if not known[y + 1, x + 1] and not seen[y, x]:
                        code(y, x, int(bits[y, x]))
        passes += 1
    return m.end(), passes, planes


def _analyse(a: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    """One level of the wavelet along the first axis, coefficients left in place."""
    n = len(a)
    if n == 1:
        return a if start % 2 == 0 else a * 2
    x = a.astype(int if reversible else float).copy()
    steps = [(1, None), (0, None)] if reversible else [(1, j2._ALPHA), (0, j2._BETA), (1, j2._GAMMA), (0, j2._DELTA)]
    mirror = lambda i: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    for parity, factor in steps:
        for i in range(n):
            if (i + start) % 2 == parity:
                s = x[mirror(i - 1)] + x[mirror(i + 1)]
                x[i] = x[i] + (factor * s if factor is not None else -(s >> 1) if parity else (s + 2) >> 2)
    if not reversible:
        at = (np.arange(n) + start) % 2 == 0
        x[at] /= j2._K
        x[~at] *= j2._K
    return x


class Bits:
    def __init__(self):
        self.out, self.held, self.left = bytearray(), 0, 8

    def put(self, value: int, n: int = 1) -> None:
        for k in range(n - 1, -1, -1):
            self.left -= 1
            self.held |= (value >> k & 1) << self.left
            if not self.left:
                self._flush()

    def _flush(self) -> None:
        self.out.append(self.held)
        self.left, self.held = 7 if self.held == 0xFF else 8, 0

    def end(self) -> bytes:
        if self.left < 8 and not (self.left == 7 and self.out[-1:] == b"\xff"):
            self._flush()
        if self.out[-1:] == b"\xff":
            self.out.append(0)
        return bytes(self.out)


class Tree:
    """A tag tree's encoder: the values are known from the start."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while self.levels[-1].size > 1:
            v = self.levels[-1]
            h, w = -(-v.shape[0] // 2), -(-v.shape[1] // 2)
            self.levels.append(np.array([[v[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].min() for x in range(w)] for y in range(h)]))
        self.low = [np.zeros(v.shape, int) for v in self.levels]
        self.told = [np.zeros(v.shape, bool) for v in self.levels]

    def put(self, x: int, y: int, limit: int, bits: Bits) -> None:
        low = 0
        for k in range(len(self.levels) - 1, -1, -1):
            at = y >> k, x >> k
            self.low[k][at] = max(self.low[k][at], low)
            while not self.told[k][at] and self.low[k][at] < limit:
                if self.levels[k][at] <= self.low[k][at]:
                    bits.put(1)
                    self.told[k][at] = True
                else:
                    bits.put(0)
                    self.low[k][at] += 1
            low = self.low[k][at]


def _passes(bits: Bits, n: int) -> None:
    if n == 1:
        bits.put(0)
    elif n == 2:
        bits.put(0b10, 2)
    elif n < 6:
        bits.put(0b1100 + n - 3, 4)
    elif n < 37:
        bits.put(0b1111, 4)
        bits.put(n - 6, 5)
    else:
        bits.put(0b111111111, 9)
        bits.put(n - 37, 7)


def encode(image: np.ndarray, bits: int = 8, levels: int = 3, tile: int | None = None, reversible: bool = True, colours: bool = False, block_size: int = 4, precinct: int | None = None,
           progression: int = 0, step: float = 1 / 64, origin: tuple[int, int] = (0, 0), boxes: bool = True) -> bytes:
    """``block_size`` and ``precinct`` are exponents; ``step`` the quantisation step of the 9/7 wavelet."""
    signed = image.dtype.kind == "i"
    h, w, n = image.shape
    x0, y0 = origin
    size = tile or max(x0 + w, y0 + h)
    siz = struct.pack(">H8IH", 0, x0 + w, y0 + h, x0, y0, size, size, 0, 0, n) + bytes([bits - 1 | 128 * signed, 1, 1]) * n
    style = 0 if precinct is None else 1
    cod = struct.pack(">BBHBBBBBB", style, progression, 1, int(colours), levels, block_size - 2, block_size - 2, 0, int(reversible))
    cod += bytes([precinct | precinct << 4] * (levels + 1)) if precinct else b""
    exponent = bits + 3
    guard = 3
    fine = int(round(math.log2(1 / step)))
    if reversible:
        qcd = bytes([guard << 5]) + bytes([exponent << 3] * (3 * levels + 1))
    else:
        # The step of a subband is 2 ** (bits + gain - exponent): the exponents make it ``step`` in each.
        gains = [0] + [1, 1, 2] * levels
        qcd = bytes([guard << 5 | 2]) + b"".join(struct.pack(">H", (bits + g + fine) << 11) for g in gains)
    out = b"\xff\x4f" + b"".join(struct.pack(">HH", m, len(b) + 2) + b for m, b in ((0xFF51, siz), (0xFF52, cod), (0xFF5C, qcd)))
    a = image.astype(int) - (0 if signed else 1 << (bits - 1))
    across, down = -(-(x0 + w) // size), -(-(y0 + h) // size)
    parser = j2.Image.__new__(j2.Image)
    coding = j2._Coding(levels, block_size, block_size, 0, reversible, [(precinct, precinct) if precinct else (15, 15)] * (levels + 1))
    up = lambda v, k: -(-v // k)
    for t in range(across * down):
        tx0, tx1 = max(t % across * size, x0), min((t % across + 1) * size, x0 + w)
        ty0, ty1 = max(t // across * size, y0), min((t // across + 1) * size, y0 + h)
        part = [a[ty0 - y0 : ty1 - y0, tx0 - x0 : tx1 - x0, c].astype(int if reversible else float) for c in range(n)]
        if colours and reversible:
            r, g, b = part[:3]
            part[:3] = [(r + 2 * g + b) >> 2, b - g, r - g]
        elif colours:
            r, g, b = part[:3]
            y = 0.299 * r + 0.587 * g + 0.114 * b
            part[:3] = [y, (b - y) / 1.772, (r - y) / 1.402]
        packets = []
        for c in range(n):
            low = part[c]
            bands: dict[int, dict[str, np.ndarray]] = {}
            for r in range(levels, 0, -1):
                k = 1 << (levels - r)
                bx, by = up(tx0, k), up(ty0, k)
                low = _analyse(_analyse(low, by, reversible).T, bx, reversible).T
                cut = lambda ox, oy: low[(oy - by) % 2 :: 2, (ox - bx) % 2 :: 2]  # noqa: B023, E731
                bands[r] = {"HL": cut(1, 0), "LH": cut(0, 1), "HH": cut(1, 1)}
                low = cut(0, 0)
            bands[0] = {"LL": low}
            for r in range(levels + 1):
                k = 1 << (levels - r)
                rx0, ry0, rx1, ry1 = up(tx0, k), up(ty0, k), up(tx1, k), up(ty1, k)
                p = coding.precincts[r][0]
                if rx1 <= rx0 or ry1 <= ry0:
                    continue
                made = []
                for kind, v in bands[r].items():
                    level = levels if r == 0 else levels - r + 1
                    half = 1 << (level - 1) if level and kind != "LL" else 0
                    bx, by = up(tx0 - half * (kind in ("HL", "HH")), 1 << level), up(ty0 - half * (kind in ("LH", "HH")), 1 << level)
                    q = v if reversible else (np.sign(v) * (np.abs(v) / step)).astype(int)
                    planes = guard - 1 + (exponent if reversible else bits + {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[kind] + fine)
                    made.append((j2._Band(kind, level, bx, by, bx + v.shape[1], by + v.shape[0], planes, 1.0), q))
                number = 0
                for py in range(ry0 >> p, up(ry1, 1 << p)):
                    for px in range(rx0 >> p, up(rx1, 1 << p)):
                        head, body = Bits(), b""
                        head.put(1)
                        for band, q in made:
                            blocks = parser._precinct(band, px, py, p - (r > 0), p - (r > 0), coding).blocks
                            if not blocks:
                                continue
                            coded = [block(q[b.y0 - band.y0 : b.y1 - band.y0, b.x0 - band.x0 : b.x1 - band.x0], band.kind) for b in blocks]
                            shape = max(b.row for b in blocks) + 1, max(b.column for b in blocks) + 1
                            there = Tree(np.array([int(not d[1]) for d in coded]).reshape(shape))
                            zeros = Tree(np.array([band.planes - d[2] for d in coded]).reshape(shape))
                            for b, (data, passes, _) in zip(blocks, coded, strict=True):
                                there.put(b.column, b.row, 1, head)
                                if not passes:
                                    continue
                                for limit in range(1, int(zeros.levels[0][b.row, b.column]) + 2):
                                    zeros.put(b.column, b.row, limit, head)
                                _passes(head, passes)
                                extra = passes.bit_length() - 1
                                more = max(0, len(data).bit_length() - 3 - extra)
                                head.put((1 << more + 1) - 2, more + 1)
                                head.put(len(data), 3 + more + extra)
                                body += data
                        packets.append((r, c, number, max(ty0, (py << p) * k), max(tx0, (px << p) * k), head.end() + body))
                        number += 1
        key = {2: lambda s: (s[0], s[3], s[4], s[1], s[2]), 3: lambda s: (s[3], s[4], s[1], s[0], s[2]), 4: lambda s: (s[1], s[3], s[4], s[0], s[2])}.get(progression, lambda s: s[:3])
        data = b"".join(s[5] for s in sorted(packets, key=key))
        out += b"\xff\x90" + struct.pack(">HHIBB", 10, t, len(data) + 14, 0, 1) + b"\xff\x93" + data
    out += b"\xff\xd9"
    if not boxes:
        return out
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    ihdr = struct.pack(">IIHBBBB", h, w, n, bits - 1 | 128 * signed, 7, 0, 0)
    colour = struct.pack(">BBBI", 1, 0, 0, 16 if n >= 3 else 17)
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + box(b"jp2h", box(b"ihdr", ihdr) + box(b"colr", colour)) + box(b"jp2c", out)
