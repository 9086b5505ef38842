"""GeoTIFF and BigTIFF: header parsing, block codecs, window reads, and the data source ``geotiff``.

Read without decoding, a block is its compressed payload; decoded, a numpy array (rows, cols, bands). LERC blocks need a
codec registered in gridloom.sources.sidecar.DECODERS; one for JPEG there takes the place of the baseline codec here.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources import jpeg, sidecar

# Fixed numbers of the format.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODECS = {1: "none", 5: "lzw", 7: "jpeg", 8: "deflate", 32946: "deflate", 32773: "packbits", 34887: "lerc", 50000: "zstd"}
FORMATS = {1: "uint", 2: "int", 3: "float"}
PHOTOMETRIC = {0: "miniswhite", 1: "minisblack", 2: "rgb", 3: "palette", 4: "mask", 5: "separated", 6: "ycbcr"}
EXTRA = {0: "unspecified", 1: "associatedalpha", 2: "unassociatedalpha"}
GHOST = b"GDAL_STRUCTURAL_METADATA_SIZE="
#: A compressed block is no larger than this; a larger count is taken for damage.
BLOCK_CAP = 64 << 20


@dataclass
class Layer:
    """One directory of a file."""

    tags: dict
    order: str
    subdirectories: list = field(default_factory=list)

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return v[0] if v else default

    @property
    def width(self) -> int:
        return self.one(256)

    @property
    def height(self) -> int:
        return self.one(257)

    @property
    def bands(self) -> int:
        return self.one(277, 1)

    @property
    def bits(self) -> int:
        return self.one(258, 1)

    @property
    def sample_format(self) -> str:
        return FORMATS.get(self.one(339, 1), "uint")

    @property
    def dtype(self) -> np.dtype:
        kind = {"uint": "u", "int": "i", "float": "f"}[self.sample_format]
        if self.bits not in (8, 16, 32, 64) or (kind == "f" and self.bits < 32):
            raise ValueError(f"{self.sample_format}{self.bits} samples are not supported")
        return np.dtype(f"{self.order}{kind}{self.bits // 8}")

    @property
    def planar(self) -> bool:
        return self.one(284, 1) == 2

    @property
    def codec(self) -> str:
        return CODECS.get(self.one(259, 1), "unknown")

    @property
    def predictor(self) -> int:
        return self.one(317, 1)

    @property
    def tiled(self) -> bool:
        return 322 in self.tags

    @property
    def block(self) -> tuple[int, int]:
        """Width and height of a block; a strip is as wide as the image."""
        return (self.one(322), self.one(323)) if self.tiled else (self.width, min(self.one(278, self.height), self.height))

    @property
    def photometric(self) -> str:
        return PHOTOMETRIC.get(self.one(262, 1), "other")

    @property
    def extra_samples(self) -> list[str]:
        return [EXTRA.get(v, "unspecified") for v in self.tags.get(338, ())]

    @property
    def is_mask(self) -> bool:
        return bool(self.one(254, 0) & 4) or self.one(255) == 4 or (self.bands == 1 and self.one(262) == 4)

    @property
    def is_reduced(self) -> bool:
        return bool(self.one(254, 0) & 1) or self.one(255) == 2

    @property
    def across(self) -> int:
        return -(-self.width // self.block[0])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[1])

    def blocks(self) -> list[tuple[int, int]]:
        return list(zip(self.tags.get(324, self.tags.get(273, ())), self.tags.get(325, self.tags.get(279, ())), strict=True))

    @property
    def nodata(self) -> str | None:
        v = self.tags.get(42113)
        return v[0].rstrip("\0 ").strip() if v else None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(34735, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return next((found[k] for k in (3072, 2048) if 0 < found.get(k, 0) < 32767), None)

    @property
    def tiepoints(self) -> list[tuple]:
        v = self.tags.get(33922, ())
        return [tuple(v[i : i + 6]) for i in range(0, len(v) - 5, 6)]

    @property
    def affine(self) -> tuple | None:
        """(ox, pw, skx, oy, sky, ph): the matrix, else scale and first tie point."""
        m = self.tags.get(34264)
        if m and len(m) >= 8:
            return m[3], m[0], m[1], m[7], m[4], m[5]
        scale, ties = self.tags.get(33550), self.tiepoints
        if scale and ties:
            c, r, _, x, y, _ = ties[0]
            return x - c * scale[0], scale[0], 0.0, y + r * scale[1], 0.0, -scale[1]
        return None

    @property
    def rpc(self) -> list[float] | None:
        v = self.tags.get(50844, ())
        return list(v[:92]) if len(v) >= 92 else None


@dataclass
class File:
    layers: list[Layer]
    ghost: bool

    @property
    def images(self) -> list[Layer]:
        """The base image and its overviews, largest first."""
        base, *rest = [d for d in self.layers if not d.is_mask]
        return [base, *sorted([d for d in rest + base.subdirectories if not d.is_mask and d.width <= base.width], key=lambda d: -d.width)]

    @property
    def masks(self) -> list[Layer]:
        return [d for d in self.layers + [s for x in self.layers for s in x.subdirectories] if d.is_mask]


def parse(f) -> File:
    """All directories of an open, seekable file."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("no TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise ValueError(f"TIFF magic {magic}")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    start = 16 if big else 8
    f.seek(start)
    ghost = f.read(len(GHOST)) == GHOST

    def directory(at: int) -> tuple[Layer, int]:
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        width = 20 if big else 12
        raw = f.read(n * width + (8 if big else 4))
        tags = {}
        for i in range(n):
            entry = raw[i * width : (i + 1) * width]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
            if kind not in _TYPES:
                continue
            size, value = _TYPE_SIZE[kind] * count, entry[12 if big else 8 :]
            if size > len(value):
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(size)
            value = value[:size]
            tags[tag] = (value.decode("latin-1"),) if kind == 2 else struct.unpack(order + str(count * len(_TYPES[kind])) + _TYPES[kind][0], value)
        return Layer(tags, order), struct.unpack(order + ("Q" if big else "I"), raw[n * width :])[0]

    layers, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        layer, at = directory(at)
        layer.subdirectories = [directory(s)[0] for s in layer.tags.get(330, ()) if s]
        layers.append(layer)
    if not layers:
        raise ValueError("no directory")
    return File(layers, ghost)


# Codecs.


def lzw_decode(data: bytes) -> bytes:
    table: list[bytes] = []
    out, previous, width, held, have = [], b"", 9, 0, 0
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        if have < width:
            continue
        code = (held >> (have - width)) & ((1 << width) - 1)
        have -= width
        held &= (1 << have) - 1
        if code == 256:
            table, previous, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code == 257:
            break
        if not table:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, have
        held, have = (held << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((held >> have) & 255)
            held &= (1 << have) - 1

    table, width, current = {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    put(256, 9)
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if longer in table:
            current = longer
            continue
        put(table[current], width)
        table[longer] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            put(256, width)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        current = data[i : i + 1]
    if current:
        put(table[current], width)
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
    put(257, width)
    if have:
        out.append((held << (8 - have)) & 255)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def decompress(codec: str, data: bytes) -> bytes:
    if codec == "none":
        return data
    if codec == "deflate":
        return zlib.decompress(data)
    if codec == "lzw":
        return lzw_decode(data)
    if codec == "packbits":
        return packbits_decode(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 30)
    return sidecar.decode(codec, data)


def compress(codec: str, data: bytes, level: int = 6) -> bytes:
    if codec == "none":
        return data
    if codec == "deflate":
        return zlib.compress(data, level)
    if codec == "lzw":
        return lzw_encode(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(data)
    raise NotImplementedError(f"no {codec} encoder is installed")


def unpredict(a: np.ndarray, predictor: int) -> np.ndarray:
    """Undo horizontal differences of (rows, cols, bands)."""
    if predictor == 2:
        return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    return a


def predict(a: np.ndarray, predictor: int) -> np.ndarray:
    if predictor != 2:
        return a
    out = a.copy()
    out[:, 1:] = a[:, 1:] - a[:, :-1]
    return out


def decode_block(layer: Layer, data: bytes, rows: int, bands: int) -> np.ndarray:
    """A block's samples; codecs with a codec of their own give an array themselves."""
    if layer.codec == "jpeg" and "jpeg" not in sidecar.DECODERS:
        a = jpeg.decode(data)
        return (jpeg.to_rgb(a) if layer.photometric == "ycbcr" and a.shape[2] == 3 else a)[:rows]
    raw = decompress(layer.codec, data)
    if isinstance(raw, np.ndarray):
        return raw
    dtype, cols = layer.dtype, layer.block[0]
    need = rows * cols * bands * dtype.itemsize
    raw = raw[:need].ljust(need, b"\0")
    if layer.predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * bands)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, bands).astype(dtype.newbyteorder("="))
    a = np.frombuffer(raw, dtype).reshape(rows, cols, bands).astype(dtype.newbyteorder("="))
    return unpredict(a, layer.predictor)


def payload(f, layer: Layer, index: int) -> bytes | None:
    """Compressed bytes of a block; None for a sparse one."""
    offset, count = layer.blocks()[index]
    if not offset or not count:
        return None
    if count > BLOCK_CAP:
        raise ValueError(f"block {index} has {count} bytes")
    f.seek(offset)
    data = f.read(count)
    if layer.codec == "jpeg" and (tables := bytes(layer.tags.get(347, ()))):
        data = data[:2] + tables[2:-2] + data[2:]  # with the directory's tables it can stand alone
    return data


def read_block(f, layer: Layer, index: int) -> np.ndarray:
    """Block ``index`` as (rows, cols, bands), whole; of a strip at the lower edge, the rows there are."""
    cols, rows = layer.block
    per_plane = layer.across * layer.down
    in_plane = index % per_plane
    if not layer.tiled:
        rows = min(rows, layer.height - in_plane // layer.across * rows)
    bands = 1 if layer.planar else layer.bands
    data = payload(f, layer, index)
    if data is None:
        fill = float(layer.nodata) if layer.nodata not in (None, "") else 0
        return np.full((rows, cols, bands), fill, dtype=layer.dtype.newbyteorder("="))
    return decode_block(layer, data, rows, bands)


def read_window(f, layer: Layer, col: int, row: int, width: int, height: int, bands: list[int] | None = None) -> np.ndarray:
    """A window of a layer, only from the blocks and planes that it needs; bands count from 1."""
    bands = bands or list(range(1, layer.bands + 1))
    if col < 0 or row < 0 or col + width > layer.width or row + height > layer.height:
        raise ValueError("the window goes beyond the image")
    out = np.zeros((height, width, len(bands)), dtype=layer.dtype.newbyteorder("="))
    bw, bh = layer.block
    for tr in range(row // bh, -(-(row + height) // bh)):
        for tc in range(col // bw, -(-(col + width) // bw)):
            r0, r1 = max(row, tr * bh), min(row + height, (tr + 1) * bh)
            c0, c1 = max(col, tc * bw), min(col + width, (tc + 1) * bw)
            tile = tr * layer.across + tc
            part = (slice(r0 - tr * bh, r1 - tr * bh), slice(c0 - tc * bw, c1 - tc * bw))
            to = (slice(r0 - row, r1 - row), slice(c0 - col, c1 - col))
            if layer.planar:
                for i, b in enumerate(bands):
                    out[(*to, i)] = read_block(f, layer, (b - 1) * layer.across * layer.down + tile)[(*part, 0)]
            else:
                out[to] = read_block(f, layer, tile)[part][:, :, [b - 1 for b in bands]]
    return out


# The data source.


class RangeReader:
    """A file behind HTTP, read by ranges; a server without ranges is read whole, once."""

    def __init__(self, url: str, ahead: int = 65_536):
        self.url, self.ahead, self.at, self.held, self.start, self.whole = url, ahead, 0, b"", 0, False

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.held = b""

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int = -1) -> bytes:
        from urllib.request import Request, urlopen

        inside = self.start <= self.at and (self.whole or (n >= 0 and self.at + n <= self.start + len(self.held)))
        if not inside:
            end = "" if n < 0 else str(self.at + max(n, self.ahead) - 1)
            with urlopen(Request(self.url, headers={"Range": f"bytes={self.at}-{end}"})) as reply:
                self.whole = reply.status == 200
                self.held, self.start = reply.read(), 0 if self.whole else self.at
        lo = self.at - self.start
        out = self.held[lo:] if n < 0 else self.held[lo : lo + n]
        self.at += len(out)
        return out


def file_system(path: str):
    """(Arrow file system, name in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_file(path: str):
    """Any file system that Arrow knows; reads are ranged."""
    if path.startswith(("http://", "https://")):
        return RangeReader(path)
    system, name = file_system(path)
    return system.open_input_file(name)


def profile(path: str, file: File) -> dict:
    """The catalogue row of a file."""
    base = file.images[0]
    names = ("ox", "pw", "skx", "oy", "sky", "ph")
    return {
        "raster_id": path, "path": path, "driver": "GTiff", "width": base.width, "height": base.height, "bands": base.bands, "bits": base.bits, "sample_format": base.sample_format,
        "photometric": base.photometric, "planar": "planar" if base.planar else "chunky", "extra_samples": base.extra_samples, "compression": base.codec, "predictor": base.predictor, "tiled": base.tiled,
        "block_x": base.block[0], "block_y": base.block[1], "nodata": base.nodata, "epsg": base.epsg, "affine": dict(zip(names, base.affine, strict=True)) if base.affine else None,
        "matrix": list(base.tags.get(34264, ())) or None, "tiepoints": [dict(zip(("col", "row", "z", "x", "y", "h"), t, strict=True)) for t in base.tiepoints], "rpc": next((d.rpc for d in file.layers if d.rpc), None),
        "overviews": [{"idx": i, "width": d.width, "height": d.height, "block_x": d.block[0], "block_y": d.block[1], "compression": d.codec, "tiled": d.tiled} for i, d in enumerate(file.images[1:], 1)],
        "mask_ifds": [{"idx": i, "width": d.width, "height": d.height, "reduced": d.is_reduced, "tiled": d.tiled} for i, d in enumerate(file.masks)], "ghost": file.ghost,
    }


PROFILE = (
    "raster_id string, path string, driver string, width int, height int, bands int, bits int, sample_format string, photometric string, planar string, extra_samples array<string>, compression string, "
    "predictor int, tiled boolean, block_x int, block_y int, nodata string, epsg int, affine struct<ox:double,pw:double,skx:double,oy:double,sky:double,ph:double>, matrix array<double>, "
    "tiepoints array<struct<col:double,row:double,z:double,x:double,y:double,h:double>>, rpc array<double>, "
    "overviews array<struct<idx:int,width:int,height:int,block_x:int,block_y:int,compression:string,tiled:boolean>>, mask_ifds array<struct<idx:int,width:int,height:int,reduced:boolean,tiled:boolean>>, ghost boolean"
)


def profiles(paths: DataFrame) -> DataFrame:
    """A catalogue row per file of ``paths`` (column path), from the headers alone; a file that can't be read has an error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with open_file(path) as f:
                        rows.append(profile(path, parse(f)) | {"error": None})
                except (ValueError, OSError, struct.error) as e:
                    rows.append({"path": path, "error": str(e)})
            names = [c.split()[0] for c in _top_level(PROFILE)] + ["error"]
            yield pd.DataFrame([[r.get(k) for k in names] for r in rows], columns=names, dtype=object)

    return paths.select("path").mapInPandas(run, PROFILE + ", error string")


def _top_level(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


@dataclass
class _Blocks(InputPartition):
    paths: list[str]
    layer: int | None = None  # of one path, whose blocks lo to hi are meant; else all layers and blocks of the paths
    lo: int = 0
    hi: int = 0


def every_layer(file: File) -> list[tuple[Layer, str]]:
    """Layers as the data source numbers them: the base image and its overviews, then masks, each with its kind."""
    base, *reduced = file.images
    return [(base, "image"), *[(d, "overview") for d in reduced], *[(d, "mask") for d in file.masks]]


class GeoTiffReader(DataSourceReader):
    """Blocks of files: filters on layer, block_index, col_off and row_off choose what is read at all.

    Of up to LISTED files the driver reads the headers and splits each into ranges of blocks; more files are dealt to tasks
    unread, FILES_A_TASK each, and their headers are read there.
    """

    LISTED, FILES_A_TASK = 64, 4

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.decode = options.get("decode", "true").lower() == "true"
        self.per_task = int(options.get("blocksPerTask", "64"))
        self.tests: list[tuple[str, str, int]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in kinds and name in ("layer", "block_index", "col_off", "row_off") and isinstance(f.value, int):
                self.tests.append((name, kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, **values: int) -> bool:
        ops = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(ops[op](values[name], v) for name, op, v in self.tests if name in values)

    def partitions(self):
        if len(self.paths) > self.LISTED:
            return [_Blocks(self.paths[i : i + self.FILES_A_TASK]) for i in range(0, len(self.paths), self.FILES_A_TASK)]
        out = []
        for path in self.paths:
            with open_file(path) as f:
                for n, (layer, _) in enumerate(every_layer(parse(f))):
                    if self._wanted(layer=n):
                        total = len(layer.blocks())
                        out += [_Blocks([path], n, lo, min(total, lo + self.per_task)) for lo in range(0, total, self.per_task)]
        return out or [_Blocks([])]

    def read(self, part):
        for path in part.paths:
            with open_file(path) as f:
                for n, (layer, kind) in enumerate(every_layer(parse(f))):
                    if part.layer is not None and n != part.layer or not self._wanted(layer=n):
                        continue
                    bw, bh = layer.block
                    for i in range(part.lo, part.hi) if part.layer is not None else range(len(layer.blocks())):
                        plane, tile = divmod(i, layer.across * layer.down)
                        row, col = divmod(tile, layer.across)
                        if not self._wanted(block_index=i, col_off=col * bw, row_off=row * bh):
                            continue
                        data = payload(f, layer, i)
                        sparse = data is None
                        if self.decode:
                            data = read_block(f, layer, i).astype(layer.dtype.newbyteorder("<")).tobytes()
                        yield (path, n, kind, i, col * bw, row * bh, min(bw, layer.width - col * bw), min(bh, layer.height - row * bh),
                               plane + 1 if layer.planar else None, f"{layer.sample_format}{layer.bits}", layer.codec if not self.decode else "none", data, sparse)


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff")``: a row per block of images, overviews and masks, by the file's whole path.

    Options: path or paths (comma-separated), decode, blocksPerTask.
    """

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "raster_id string, layer int, kind string, block_index int, col_off int, row_off int, cols int, rows int, band int, dtype string, compression string, data binary, sparse boolean"

    def reader(self, schema):
        return GeoTiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
