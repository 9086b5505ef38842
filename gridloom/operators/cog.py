"""Writing cloud-optimised GeoTIFF, and converting files to it.

A file is written front to back: header, structural metadata, all directories, then overview blocks from the smallest
level up, and the base image last. Overviews are sub-directories of the base; with a mask, all directories are in one
chain: base, its mask, overviews, their masks.

Nothing holds a whole image. Each layer is encoded some blocks at a time into a part of its own beside the target; an
overview is made from the part before it, read back by windows; then the parts are joined under a unique name, and the file
gets its own name only when it is complete. Overviews and masks that the source has are taken from it, and blocks that are
the same in the output are copied as they are.
"""

from __future__ import annotations

import io
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.operators import layout, resample, windows
from gridloom.sources import jpeg, jpeg2000, sidecar, tiff

_CODES = {"none": 1, "lzw": 5, "jpeg": 7, "deflate": 8, "zstd": 50000}
_CLASSIC_LIMIT = 3_500_000_000


@dataclass
class Options:
    codec: str = "deflate"
    level: int = 6
    quality: int = 75  # of JPEG
    block: int = 512
    resampling: str = "average"
    overviews: list[int] | None = None  # None: as many as the size asks for
    bands: list[int] | None = None
    window: tuple[int, int, int, int] | None = None  # col, row, width, height
    mask_from_alpha: bool = True
    black_rgb: bool = False
    planar: bool = False
    fresh: bool = False  # make overviews anew even where the source has them


def shrink(a: np.ndarray, scale: int, method: str, nodata: float | None = None) -> np.ndarray:
    """(rows, cols, bands) at 1 / scale, by the rules of operators.resample; integers are rounded half away from zero."""
    method = resample.method_of(method)
    h, w = max(1, a.shape[0] // scale), max(1, a.shape[1] // scale)
    if method == "nearest":
        return a[::scale, ::scale][:h, :w]
    v = a.astype(float)
    hole = np.zeros(a.shape, bool) if nodata is None else (np.isnan(v) if nodata != nodata else v == nodata)
    if method == "average":
        hh, ww = min(h * scale, a.shape[0]), min(w * scale, a.shape[1])
        r, c = np.arange(0, hh, scale), np.arange(0, ww, scale)
        total = np.add.reduceat(np.add.reduceat(np.where(hole, 0, v)[:hh, :ww], r, 0), c, 1)
        n = np.add.reduceat(np.add.reduceat((~hole)[:hh, :ww].astype(float), r, 0), c, 1)
    else:
        down, across = (_taps(size, scale, "bilinear" if method == "bilinear" else "cubic") for size in a.shape[:2])
        total = np.einsum("oi,ijb,pj->opb", down, np.where(hole, 0, v), across, optimize=True)
        n = np.einsum("oi,ijb,pj->opb", down, (~hole).astype(float), across, optimize=True)
    out = np.where(np.abs(n) > 1e-12, total / np.where(np.abs(n) > 1e-12, n, 1), 0 if nodata is None else nodata)
    if a.dtype.kind in "iu":
        top = np.iinfo(a.dtype)
        out = np.clip(np.trunc(out + np.copysign(0.5, out)), top.min, top.max)
    return out.astype(a.dtype)


def _taps(size: int, scale: int, method: str) -> np.ndarray:
    out = np.zeros((max(1, size // scale), size))
    for o in range(len(out)):
        centre = min(o * scale + (scale - 1) / 2, size - 1)
        lo, hi = (0, 1) if method == "bilinear" else (-1, 2)
        for k in range(lo, hi + 1):
            src = min(max(int(centre) + k, 0), size - 1)
            part = centre - int(centre)
            if method == "bilinear":
                w = part if k else 1 - part
            else:
                x = abs(centre - src)
                w = (1.5 * x - 2.5) * x * x + 1 if x <= 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0
            out[o, src] += w
    return out


def mask_maker(photometric: str, extra: list[str], bands: int, dtype: np.dtype, options: Options):
    """A function from samples (rows, cols, all bands) to 255 where valid, from alpha or from black; or None."""
    alpha = next((i for i, e in enumerate(extra) if "alpha" in e), None)
    if options.mask_from_alpha and alpha is not None:
        band = bands - len(extra) + alpha
        return lambda a: np.where(a[:, :, band : band + 1] > 0, 255, 0).astype(np.uint8)
    if options.black_rgb and bands == 3 and photometric == "rgb" and not extra and dtype == np.uint8:
        return lambda a: np.where((a != 0).any(axis=2, keepdims=True), 255, 0).astype(np.uint8)
    return None


def encode_predictor(codec: str, dtype: np.dtype) -> int:
    return 2 if codec not in ("none", "jpeg") and dtype.kind in "iu" else 1


def codec_of(options: Options, mask: bool) -> str:
    """A mask must come out as it went in."""
    return "deflate" if mask and options.codec == "jpeg" else options.codec


class Scratch:
    """Where encoded layers wait for their file: beside the target, or in memory for a stream of one's own."""

    def __init__(self, target: str | None = None):
        self.system, name = tiff.file_system(target) if target else (None, "")
        self.stem, self.made = f"{name}.{uuid.uuid4().hex}", []

    def create(self):
        self.made.append(f"{self.stem}.{len(self.made)}.part" if self.system else io.BytesIO())
        return len(self.made) - 1, self.system.open_output_stream(self.made[-1]) if self.system else self.made[-1]

    def open(self, n: int):
        return self.system.open_input_file(self.made[n]) if self.system else io.BytesIO(self.made[n].getvalue())

    def clear(self) -> None:
        from pyarrow import fs

        if self.system:
            for name in self.made:
                if self.system.get_file_info(name).type != fs.FileType.NotFound:
                    self.system.delete_file(name)


class Pixels:
    """A layer that is an array (rows, cols, bands)."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.height, self.width, self.bands = a.shape
        self.dtype = a.dtype.newbyteorder("=")

    def read(self, col: int, row: int, width: int, height: int) -> np.ndarray:
        return self.a[row : row + height, col : col + width]

    def copy(self, plane: int, row: int, col: int) -> bytes | None:
        return None


class FromFile:
    """A window of a file's layer, some of its bands. Of a mask, 255 where it isn't 0.

    ``copy`` gives a compressed block where it is the output's as it stands: codec, predictor, block size, layout and byte
    order alike, the window aligned, the block whole. Planes are renumbered; chunky blocks have all bands or are coded anew.
    """

    def __init__(self, f, layer: tiff.Layer, window: tuple[int, int, int, int], bands: list[int] | None = None, options: Options | None = None, mask: bool = False):
        self.f, self.layer, self.mask = f, layer, mask
        self.col, self.row, self.width, self.height = window
        self.chosen = [1] if mask else bands or list(range(1, layer.bands + 1))
        self.bands, self.dtype = len(self.chosen), np.dtype(np.uint8) if mask else layer.dtype.newbyteorder("=")
        self.size, whole = options.block if options else 0, self.chosen == list(range(1, layer.bands + 1))
        self.alike = bool(
            options and layer.tiled and layer.block == (self.size, self.size) and layer.codec == codec_of(options, mask) and layer.order == "<" and self.col % self.size == 0 and self.row % self.size == 0
            and (layer.planar and options.planar and not mask or whole and not layer.planar and (mask or not options.planar))
            and layer.predictor == (1 if mask else encode_predictor(options.codec, layer.dtype)) and (not mask or layer.bits == 8)
        )
        if self.alike and layer.codec == "jpeg":  # colours must be stored alike, too
            coloured = self.bands == 3 and not layer.planar
            self.alike = (layer.photometric == "ycbcr") == coloured and (not coloured or layer.tags.get(530, (2, 2)) == (1, 1))

    def read(self, col: int, row: int, width: int, height: int) -> np.ndarray:
        a = tiff.read_window(self.f, self.layer, self.col + col, self.row + row, width, height, self.chosen)
        return np.where(a > 0, 255, 0).astype(np.uint8) if self.mask else a

    def copy(self, plane: int, row: int, col: int) -> bytes | None:
        row, col = self.row + row, self.col + col
        # A block at the source's own edge was filled up by its writer, and may be at the output's edge only.
        whole = row + self.size <= self.layer.height and col + self.size <= self.layer.width
        if not self.alike or not whole:
            return None
        index = row // self.size * self.layer.across + col // self.size
        return tiff.payload(self.f, self.layer, index + ((self.chosen[plane] - 1) * self.layer.across * self.layer.down if self.layer.planar else 0))


class FromJp2:
    """A window of a JPEG 2000 image at 1 / 2 ** reduce, some of its bands."""

    def __init__(self, image: jpeg2000.Image, window: tuple[int, int, int, int], bands: list[int] | None = None, reduce: int = 0):
        self.image, self.reduce = image, reduce
        self.col, self.row, self.width, self.height = window
        self.chosen = [b - 1 for b in bands or range(1, image.components + 1)]
        self.bands, self.dtype = len(self.chosen), image.dtype

    def read(self, col: int, row: int, width: int, height: int) -> np.ndarray:
        return self.image.read(self.col + col, self.row + row, width, height, self.reduce)[:, :, self.chosen]

    def copy(self, plane: int, row: int, col: int) -> bytes | None:
        return None


class Smaller:
    """A layer at 1 / scale of another. A window is made from the window behind it and a margin that covers all taps."""

    MARGIN = 2

    def __init__(self, source, scale: int, method: str, nodata: float | None = None):
        self.source, self.scale, self.method, self.nodata = source, scale, method, nodata
        self.width, self.height = max(1, source.width // scale), max(1, source.height // scale)
        self.bands, self.dtype = source.bands, source.dtype

    def read(self, col: int, row: int, width: int, height: int) -> np.ndarray:
        (c0, c1, x0, x1), (r0, r1, y0, y1) = (self._behind(at, n, size, whole) for at, n, size, whole in ((col, width, self.width, self.source.width), (row, height, self.height, self.source.height)))
        a = shrink(self.source.read(x0, y0, x1 - x0, y1 - y0), self.scale, self.method, self.nodata)
        return a[row - r0 : row - r0 + height, col - c0 : col - c0 + width]

    def _behind(self, at: int, n: int, size: int, whole: int) -> tuple[int, int, int, int]:
        lo, hi = max(0, at - self.MARGIN), min(size, at + n + self.MARGIN)
        return lo, hi, lo * self.scale, whole if hi == size else hi * self.scale

    def copy(self, plane: int, row: int, col: int) -> bytes | None:
        return None


class Synthesised:
    """The mask of an image with alpha, or of a colour image whose black is nothing."""

    def __init__(self, source, make):
        self.source, self.make = source, make
        self.width, self.height, self.bands, self.dtype = source.width, source.height, 1, np.dtype(np.uint8)

    def read(self, col: int, row: int, width: int, height: int) -> np.ndarray:
        return self.make(self.source.read(col, row, width, height))

    def copy(self, plane: int, row: int, col: int) -> bytes | None:
        return None


@dataclass
class Encoded:
    """A layer whose blocks are in the scratch: its tags, the sizes of its blocks, and where they are."""

    place: int
    width: int
    height: int
    bands: int
    dtype: np.dtype
    counts: list[int]
    reduced: bool
    mask: bool
    planar: bool
    predictor: int
    options: Options

    @property
    def coloured(self) -> bool:
        """Whether blocks are stored as luma and colour differences."""
        return not self.mask and self.options.codec == "jpeg" and self.bands == 3 and not self.planar

    def layer(self) -> tiff.Layer:
        """As a directory of the scratch file, so that it can be read like any other."""
        offsets = np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(int).tolist()
        return tiff.Layer({
            256: (self.width,), 257: (self.height,), 258: (self.dtype.itemsize * 8,) * self.bands, 259: (_CODES[codec_of(self.options, self.mask)],), 262: (6 if self.coloured else 1,), 277: (self.bands,), 284: (2 if self.planar else 1,), 317: (self.predictor,),
            322: (self.options.block,), 323: (self.options.block,), 324: tuple(o + 1 for o in offsets), 325: tuple(self.counts), 339: ({"u": 1, "i": 2, "f": 3}[self.dtype.kind],) * self.bands,
        }, "<")

    def source(self, scratch: Scratch, keep: list) -> FromFile:
        keep.append(scratch.open(self.place))
        return FromFile(_Shifted(keep[-1]), self.layer(), (0, 0, self.width, self.height))


class _Shifted:
    """A file whose offsets count from 1, as an offset of 0 stands for a block that isn't there."""

    def __init__(self, f):
        self.f = f

    def seek(self, at: int) -> None:
        self.f.seek(at - 1)

    def read(self, n: int) -> bytes:
        return self.f.read(n)


SAMPLES = 16 << 20  # of a layer that are decoded at once, at most, but for one row of blocks in one column


def block_bytes(part: np.ndarray, options: Options, predictor: int, mask: bool = False) -> bytes:
    """A compressed block; at the edge it is filled up with 0, or for JPEG with its last row and column.

    JPEG blocks of three bands are colours.
    """
    size, codec = options.block, codec_of(options, mask)
    if codec == "jpeg":
        part = np.pad(part, ((0, size - part.shape[0]), (0, size - part.shape[1]), (0, 0)), mode="edge")
        return jpeg.encode(part, options.quality, part.shape[2] == 3)
    part = np.pad(part, ((0, size - part.shape[0]), (0, size - part.shape[1]), (0, 0)))
    part = tiff.predict(part, predictor)
    return tiff.compress(codec, part.astype(part.dtype.newbyteorder("<")).tobytes(), options.level)


def encode(source, options: Options, scratch: Scratch, reduced: bool, mask: bool) -> Encoded:
    """Encode a layer into the scratch, some blocks of a row at a time."""
    size, planar = options.block, options.planar and not mask
    if options.codec == "jpeg" and not mask and (source.dtype != np.uint8 or source.bands > 4 and not planar):
        raise ValueError("JPEG takes bands of 8 bits, and more than four only as planes")
    predictor = 1 if mask else encode_predictor(options.codec, source.dtype)
    wide = max(1, SAMPLES // (size * size * source.bands)) * size
    counts: list[int] = []
    place, out = scratch.create()
    for plane in range(source.bands) if planar else [0]:
        for r in range(0, source.height, size):
            for lo in range(0, source.width, wide):
                held = None
                for c in range(lo, min(source.width, lo + wide), size):
                    data = source.copy(plane, r, c) if r + size <= source.height and c + size <= source.width else None
                    if data is None:
                        if held is None:
                            held = source.read(lo, r, min(wide, source.width - lo), min(size, source.height - r))
                            held = held[:, :, plane : plane + 1] if planar else held
                        data = block_bytes(held[:, c - lo : c - lo + size], options, predictor, mask)
                    out.write(data)
                    counts.append(len(data))
    if scratch.system:
        out.close()
    return Encoded(place, source.width, source.height, source.bands, source.dtype, counts, reduced, mask, planar, predictor, options)


def encode_all(base, mask, options: Options, scratch: Scratch, nodata: float | None, scales: list[int], given=None, given_mask=None, first: Encoded | None = None) -> list[Encoded]:
    """The base, its mask, overviews and their masks. ``given(scale)`` is a source's own overview of a scale, or None;
    ``first`` the base, where it is encoded already. A level that is twice the one before is made from it."""
    keep: list = []

    def levels(top, is_mask: bool, own) -> list[Encoded]:
        out = [first if first and not is_mask else encode(top, options, scratch, False, is_mask)]
        readable, before = top, 1
        for s in scales:
            chained = before > 0 and s == 2 * before
            method = "nearest" if is_mask else options.resampling
            layer = (own and own(s)) or Smaller(readable if chained else top, 2 if chained else s, method, None if is_mask else nodata)
            out.append(encode(layer, options, scratch, True, is_mask))
            readable, before = out[-1].source(scratch, keep), s
        return out

    try:
        images = levels(base, False, given)
        masks = levels(mask, True, given_mask) if mask is not None else []
    finally:
        for f in keep:
            f.close()
    return [images[0], *masks[:1], *images[1:], *masks[1:]]


def write(out, image: np.ndarray, options: Options, *, mask: np.ndarray | None = None, nodata: str | None = None, **tags) -> None:
    """Write an array (rows, cols, bands) with its overviews, and a mask's, to an open stream."""
    options.codec = layout.check_options(options.block, options.codec, options.level, options.quality)
    _encoder(options)
    scales = resample.overview_levels(image.shape[1], image.shape[0], options.block) if options.overviews is None else options.overviews
    scratch = Scratch()
    layers = encode_all(Pixels(image), None if mask is None else Pixels(mask), options, scratch, _hole(nodata), scales)
    join(out, layers, scratch, nodata=nodata, **tags)


def _hole(nodata: str | None) -> float | None:
    return float(nodata) if nodata not in (None, "") else None


def _encoder(options: Options) -> None:
    if options.codec not in _CODES:
        raise NotImplementedError(f"no {options.codec} encoder is installed")


def join(out, layers: list[Encoded], scratch: Scratch, *, photometric: str = "minisblack", extra: list[str] | None = None, nodata: str | None = None, epsg: int | None = None,
         affine: tuple | None = None, tiepoints: list[tuple] | None = None, extra_tags: dict | None = None) -> None:
    """Write a file of encoded layers: the header, all directories, then blocks, a megabyte at a time."""
    extra, options = extra or [], layers[0].options
    big = sum(sum(x.counts) for x in layers) + sum(16 * len(x.counts) for x in layers) + (1 << 20) > _CLASSIC_LIMIT
    word, slot = ("Q", 8) if big else ("I", 4)

    def directory(x: Encoded, offsets: list[int], subs: list[int]) -> list[tuple[int, int, tuple]]:
        kind = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
        tags: list[tuple[int, int, tuple]] = [
            (254, 4, (x.reduced | 4 * x.mask,)), (256, 4, (x.width,)), (257, 4, (x.height,)), (258, 3, (x.dtype.itemsize * 8,) * x.bands), (259, 3, (_CODES[codec_of(options, x.mask)],)),
            (262, 3, (4 if x.mask else 6 if x.coloured else {v: k for k, v in tiff.PHOTOMETRIC.items()}.get(photometric, 1),)), (277, 3, (x.bands,)), (284, 3, (2 if x.planar else 1,)),
            (317, 3, (x.predictor,)), (322, 4, (options.block,)), (323, 4, (options.block,)), (324, 16 if big else 4, tuple(offsets)), (325, 4, tuple(x.counts)), (339, 3, (kind,) * x.bands),
        ]
        if x.coloured:
            tags.append((530, 3, (1, 1)))
        if subs:
            tags.append((330, 18 if big else 13, tuple(subs)))
        if extra and not x.mask:
            tags.append((338, 3, tuple({v: k for k, v in tiff.EXTRA.items()}[e] for e in extra)))
        if not x.reduced and not x.mask:
            if affine:
                ox, pw, skx, oy, sky, ph = affine
                if skx or sky:
                    tags.append((34264, 12, (pw, skx, 0.0, ox, sky, ph, 0.0, oy, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
                else:
                    tags += [(33550, 12, (pw, -ph, 0.0)), (33922, 12, (0.0, 0.0, 0.0, ox, oy, 0.0))]
            elif tiepoints:
                tags.append((33922, 12, tuple(v for t in tiepoints for v in t)))
            if epsg:
                geographic = 4000 <= epsg < 5000
                tags.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)))
            tags += [(t, k, v) for t, (k, v) in (extra_tags or {}).items()]
        if nodata not in (None, "") and not x.mask:
            tags.append((42113, 2, (nodata,)))
        return sorted(tags)

    def packed(tags: list, at: int, following: int) -> bytes:
        """A directory at offset ``at``, with its long values right behind it."""
        entry = 12 + (8 if big else 0)
        head = struct.pack("<Q" if big else "<H", len(tags))
        behind, body = [], b""
        base = at + len(head) + entry * len(tags) + slot
        for tag, kind, values in tags:
            if kind == 2:
                data, count = values[0].encode("latin-1") + b"\0", len(values[0]) + 1
            else:
                data, count = struct.pack(f"<{len(values)}{tiff._TYPES[kind]}", *values), len(values)
            body += struct.pack("<HH" + word, tag, kind, count)
            if len(data) <= slot:
                body += data.ljust(slot, b"\0")
            else:
                body += struct.pack("<" + word, base)
                behind.append(data + b"\0" * (len(data) % 2))
                base += len(behind[-1])
        return head + body + struct.pack("<" + word, following) + b"".join(behind)

    text = b"LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\n"
    ghost = tiff.GHOST + f"{len(text):06d} bytes\n".encode() + text
    start = (16 if big else 8) + len(ghost)
    start += start % 2
    chained = any(x.mask for x in layers)

    def lay(offsets: list[list[int]]) -> tuple[bytes, list[int]]:
        places, data = [start] * len(layers), b""
        for _ in range(2):  # the second time, the places of the others are known
            parts, at, new = [], start, []
            for i, (x, o) in enumerate(zip(layers, offsets, strict=True)):
                subs = places[1:] if not chained and not i else []
                following = (places[i + 1] if i + 1 < len(layers) else 0) if chained else 0
                new.append(at)
                parts.append(packed(directory(x, o, subs), at, following))
                at += len(parts[-1])
            places, data = new, b"".join(parts)
        return data, places

    empty, _ = lay([[0] * len(x.counts) for x in layers])
    at = start + len(empty)
    offsets: list[list[int]] = [[] for _ in layers]
    order = sorted(range(len(layers)), key=lambda i: (layers[i].width, layers[i].mask))
    for i in order:
        offsets[i] = (at + np.concatenate(([0], np.cumsum(layers[i].counts)[:-1])).astype(int)).tolist()
        at += sum(layers[i].counts)
    directories, places = lay(offsets)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, places[0]) if big else struct.pack("<2sHI", b"II", 42, places[0])
    out.write((head + ghost).ljust(start, b"\0") + directories)
    for i in order:
        with scratch.open(layers[i].place) as f:
            while data := f.read(1 << 20):
                out.write(data)


def publish(target: str, layers: list[Encoded], scratch: Scratch, **tags) -> None:
    """Join the layers under a name of their own, then give the file its name: nobody ever sees half of it."""
    system, name = tiff.file_system(target)
    held = f"{name}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(held) as out:
            join(out, layers, scratch, **tags)
        system.move(held, name)
    except BaseException:
        scratch.made.append(held)
        raise


def convert(source: str, target: str, options: Options | None = None) -> None:
    """Read a GeoTIFF, take the window and bands asked for, and write it anew with overviews and, if it has one, a mask.

    Overviews and mask overviews are the source's own where it has them in the size asked for (with ``fresh`` they are made
    anew); with neither window nor list of overviews, all that it has. Blocks that are the same in the output are copied
    compressed; the others are encoded. Memory is bounded by SAMPLES, not by the image.
    """
    options = options or Options()
    options.codec = layout.check_options(options.block, options.codec, options.level, options.quality)
    _encoder(options)
    scratch = Scratch(target)
    try:
        with tiff.open_file(source) as f:
            file = tiff.parse(f)
            base = file.images[0]
            window = windows.Window(*(options.window or (0, 0, base.width, base.height)))
            windows.by_pixels(base.width, base.height, *_tuple(window))

            def reduced(among: list[tiff.Layer], s: int) -> tuple[tiff.Layer, tuple] | None:
                """A layer at 1 / s of the base, and the window in it; sizes may have been rounded either way."""
                for d in among:
                    if all(size in (max(1, whole // s), -(-whole // s)) for size, whole in ((d.width, base.width), (d.height, base.height))):
                        if options.window is None:
                            return d, (0, 0, d.width, d.height)
                        small = window.scaled(s)
                        if window.fits(s) and small.col_off + small.width <= d.width and small.row_off + small.height <= d.height:
                            return d, _tuple(small)
                return None

            overviews = [] if options.fresh else file.images[1:]
            masks = file.masks
            scales = options.overviews
            if scales is None:
                own = sorted({s for d in overviews for s in [round(base.width / d.width)] if reduced([d], s)}) if options.window is None else []
                scales = own or resample.overview_levels(window.width, window.height, options.block)

            def layer(found, is_mask: bool):
                return found and FromFile(f, *found, None if is_mask else options.bands, options, is_mask)

            top = FromFile(f, base, _tuple(window), options.bands, options)
            full = next((m for m in masks if (m.width, m.height) == (base.width, base.height)), None)
            if full is not None:
                mask = FromFile(f, full, _tuple(window), None, options, True)
            else:
                make = mask_maker(base.photometric, base.extra_samples, base.bands, base.dtype, options)
                mask = make and Synthesised(FromFile(f, base, _tuple(window)), make)
            extra, photometric = base.extra_samples, "rgb" if base.photometric == "ycbcr" else base.photometric
            if options.bands:
                first_extra = base.bands - len(extra)
                extra = [extra[b - 1 - first_extra] for b in options.bands if b > first_extra]
                photometric = "rgb" if len(options.bands) - len(extra) == 3 else "minisblack" if photometric == "rgb" else photometric
            small_masks = [] if full is None or options.fresh else [m for m in masks if m is not full]
            layers = encode_all(
                top, mask, options, scratch, _hole(base.nodata), scales,
                lambda s: layer(reduced(overviews, s), False), lambda s: layer(reduced(small_masks, s), True),
            )
            col, row = window.col_off, window.row_off
            affine = base.affine
            if affine:
                ox, pw, skx, oy, sky, ph = affine
                affine = (ox + col * pw + row * skx, pw, skx, oy + col * sky + row * ph, sky, ph)
            ties = [(c - col, r - row, *rest) for c, r, *rest in base.tiepoints]
            tags = {50844: (12, tuple(base.rpc))} if base.rpc else {}
            publish(target, layers, scratch, photometric=photometric, extra=extra, nodata=base.nodata, epsg=base.epsg, affine=affine, tiepoints=ties, extra_tags=tags)
    finally:
        scratch.clear()


def convert_jp2(source: str, target: str, options: Options, georef: dict | None = None) -> None:
    """A JPEG 2000 image as a file of planes, with overviews and, of four bands with colours, a mask from the fourth.

    An overview of a scale that holds halvings is decoded at that size and shrunk by what is left, unless its window doesn't
    fit or ``options.fresh``; then it is made from the level before. ``georef``: affine and epsg, from whatever is beside the
    image or in it.
    """
    options.codec = layout.check_options(options.block, options.codec, options.level, options.quality)
    options.planar = True
    _encoder(options)
    georef = georef or {}
    with tiff.open_file(source) as f:
        data = f.read()
    head, image = sidecar.jp2_header(data), jpeg2000.Image(data)
    window = windows.by_pixels(image.width, image.height, *(options.window or (0, 0, image.width, image.height)))
    scales = options.overviews
    if scales is None:
        scales = resample.overview_levels(window.width, window.height, options.block)

    def reduced(s: int):
        halvings = min(jpeg2000.halvings(s), image.levels)
        if options.fresh or not halvings or not (window.fits(1 << halvings) or options.window is None):
            return None
        small = window.scaled(1 << halvings)
        small = FromJp2(image, _tuple(small), options.bands, halvings)
        rest = s >> halvings
        return small if rest == 1 else Smaller(small, rest, options.resampling)

    extra, photometric = head["extra_samples"], head["photometric"]
    make = mask_maker(photometric, extra, image.components, image.dtype, options)
    mask = make and Synthesised(FromJp2(image, _tuple(window)), make)
    if options.bands:
        first_extra = image.components - len(extra)
        extra = [extra[b - 1 - first_extra] for b in options.bands if b > first_extra]
        photometric = "rgb" if len(options.bands) - len(extra) == 3 else "minisblack"
    affine = georef.get("affine")
    if affine:
        ox, pw, skx, oy, sky, ph = affine
        affine = (ox + window.col_off * pw + window.row_off * skx, pw, skx, oy + window.col_off * sky + window.row_off * ph, sky, ph)
    scratch = Scratch(target)
    try:
        layers = encode_all(FromJp2(image, _tuple(window), options.bands), mask, options, scratch, None, scales, reduced)
        publish(target, layers, scratch, photometric=photometric, extra=extra, affine=affine, epsg=georef.get("epsg"))
    finally:
        scratch.clear()


def _tuple(w: windows.Window) -> tuple[int, int, int, int]:
    return w.col_off, w.row_off, w.width, w.height


def write_tiles(tiles: DataFrame, folder: str, options: Options | None = None, **tags) -> DataFrame:
    """Write a file per raster from a table of tiles (raster_id, row_off, col_off, rows, cols, bands, dtype, data).

    Tiles are the blocks of a grid of ``options.block``, chunky, little endian. A raster's tiles come to one task in the
    order of its file, as a file is one sequence of bytes, and go through it one at a time; the task then makes the
    overviews from what it has written. Returns raster_id, path, width, height, error: a raster with a tile missing has an
    error and no file. Null ids are no raster and are left out; an empty table gives no file. A task that runs again gives
    the same file.
    """
    options = options or Options()
    options.codec = layout.check_options(options.block, options.codec, options.level, options.quality)
    _encoder(options)
    schema = "raster_id string, path string, width int, height int, error string"

    def one(raster: str, rows) -> tuple:
        import hashlib

        name = f"{raster.rsplit('/', 1)[-1].rsplit('.', 1)[0]}-{hashlib.sha256(raster.encode()).hexdigest()[:12]}.tif"
        target, scratch = f"{folder.rstrip('/')}/{name}", Scratch(f"{folder.rstrip('/')}/{name}")
        size, counts, width, height, dtype, bands = options.block, [], 0, 0, None, 0
        try:
            place, out = scratch.create()
            across, wrong = 0, ""
            for t in rows:
                if dtype is None:
                    dtype, bands = sample_type(t["dtype"]), t["bands"]
                if t["row_off"] == 0:
                    across, width = across + 1, t["col_off"] + t["cols"]
                n = len(counts)
                if wrong or (t["row_off"], t["col_off"]) != (n // max(across, 1) * size if t["row_off"] else 0, n % max(across, 1) * size if t["row_off"] else n * size):
                    wrong = wrong or f"no tile in the place of number {n}"
                    continue
                height = t["row_off"] + t["rows"]
                a = np.frombuffer(t["data"], dtype.newbyteorder("<")).reshape(-1, size if len(t["data"]) == size * size * bands * dtype.itemsize else t["cols"], bands)
                data = block_bytes(a[: t["rows"], : t["cols"]].astype(dtype), options, encode_predictor(options.codec, dtype))
                out.write(data)
                counts.append(len(data))
            if scratch.system:
                out.close()
            if wrong or len(counts) != -(-width // size) * -(-height // size):
                return raster, None, None, None, wrong or "tiles are missing"
            first = Encoded(place, width, height, bands, dtype, counts, False, False, False, encode_predictor(options.codec, dtype), options)
            scales = resample.overview_levels(width, height, size) if options.overviews is None else options.overviews
            keep: list = []
            layers = encode_all(first.source(scratch, keep), None, options, scratch, _hole(tags.get("nodata")), scales, first=first)
            for f in keep:
                f.close()
            publish(target, layers, scratch, **tags)
            return raster, target, width, height, None
        finally:
            scratch.clear()

    def run(batches):
        import itertools

        import pandas as pd

        system, base = tiff.file_system(folder)
        system.create_dir(base, recursive=True)
        rows = (r for b in batches for r in b.to_dict("records"))
        for raster, mine in itertools.groupby(rows, key=lambda r: r["raster_id"]):
            yield pd.DataFrame([one(raster, mine)], columns=["raster_id", "path", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    one_by_one = tiles.where(F.col("raster_id").isNotNull()).select("raster_id", *[F.col(c).cast("int") for c in ("row_off", "col_off", "rows", "cols", "bands")], "dtype", "data")
    return one_by_one.repartition("raster_id").sortWithinPartitions("raster_id", "row_off", "col_off").mapInPandas(run, schema)


def sample_type(name: str) -> np.dtype:
    """The numpy type of a name such as uint16."""
    kind = name.rstrip("0123456789")
    return np.dtype({"uint": "u", "int": "i", "float": "f"}[kind] + str(int(name.removeprefix(kind)) // 8))


def assemble(tiles: DataFrame, by: str = "raster_id") -> DataFrame:
    """Tiles (row_off, col_off, rows, cols, bands, dtype, data) to a row per raster: width, height, bands, dtype, image.

    For rasters that fit a row; ``write_tiles`` is for any size. A raster's tiles meet in one task.
    """

    def run(pdf):
        import pandas as pd

        first = pdf.iloc[0]
        w, h = int((pdf["col_off"] + pdf["cols"]).max()), int((pdf["row_off"] + pdf["rows"]).max())
        dtype = sample_type(first["dtype"])
        image = np.zeros((h, w, int(first["bands"])), dtype)
        for t in pdf.itertuples():
            a = np.frombuffer(t.data, dtype).reshape(t.rows, t.cols, image.shape[2])
            image[t.row_off : t.row_off + t.rows, t.col_off : t.col_off + t.cols] = a
        return pd.DataFrame([{by: first[by], "width": w, "height": h, "bands": image.shape[2], "dtype": first["dtype"], "image": image.tobytes()}])

    kind = dict(tiles.dtypes)[by]
    return tiles.groupBy(by).applyInPandas(run, f"{by} {kind}, width int, height int, bands int, dtype string, image binary")


def image_to_pixels(images: DataFrame) -> DataFrame:
    """Pixel rows of assembled images, for small rasters and tests."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                dtype = sample_type(r.dtype)
                a = np.frombuffer(r.image, dtype).reshape(r.height, r.width, r.bands)
                row, col, band = np.indices(a.shape)
                yield pd.DataFrame({"raster_id": r.raster_id, "row": row.ravel(), "col": col.ravel(), "band": band.ravel() + 1, "value": a.ravel().astype(float)})

    return images.mapInPandas(run, "raster_id string, row long, col long, band int, value double").withColumn("band", F.col("band").cast("int"))
