"""What lies beside and around pixels: format signatures, world files, projections, and JPEG 2000 boxes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, functions as F

EXTENSIONS = ("tif", "tiff", "jp2", "j2k", "j2c")
WORLD_EXTENSIONS = ("j2w", "jp2w", "wld", "tfw")


def sniff(content: Column, path: Column) -> Column:
    """GTiff or JP2OpenJPEG, from the first bytes, else from the extension."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("49492A00") | head.startswith("4D4D002A") | head.startswith("49492B00") | head.startswith("4D4D002B"), "GTiff")
        .when(F.substring(head, 9, 8).isin("6A502020", "66747970"), "JP2OpenJPEG")
        .otherwise(sniff_name(path))
    )


def sniff_name(path: Column) -> Column:
    """By the extension of a path or URL, without its query."""
    plain = F.lower(F.split(path, "\\?")[0])
    return F.when(plain.rlike(r"\.(jp2|j2k|j2c)$"), "JP2OpenJPEG").otherwise("GTiff")


def listing(files: DataFrame) -> DataFrame:
    """Raster files of a directory listing, in order of path; an empty one is an error."""
    found = files.where(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")).orderBy("path")
    if not found.limit(1).count():
        raise ValueError("no raster files")
    return found


def world_file(text: Column) -> Column:
    """Affine struct of a world file's six numbers, from pixel centres to corners; null if it hasn't six."""
    v = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.try_cast("double")), lambda x: x.isNotNull())
    a, d, b, e, c, f = (F.get(v, F.lit(i)) for i in range(6))
    half = F.lit(0.5)
    return F.when(F.size(v) >= 6, F.struct(
        (c - half * a - half * b).alias("ox"), a.alias("pw"), b.alias("skx"), (f - half * d - half * e).alias("oy"), d.alias("sky"), e.alias("ph")
    ))


def prj_epsg(text: Column) -> Column:
    return F.regexp_extract(text, r'EPSG",\s*"?(\d+)', 1).try_cast("int")


def gml_georef(xml: Column) -> Column:
    """Struct (epsg, affine) of a GML grid: origin and two offset vectors, centres to corners; null without them."""
    number = r"(-?[0-9.eE+]+)[ ,]+(-?[0-9.eE+]+)"
    pos = lambda i: F.regexp_extract(xml, r"(?s)<gml:origin>.*?<gml:pos[^>]*>\s*" + number, i).try_cast("double")
    vectors = lambda i: F.regexp_extract(xml, r"(?s)<gml:offsetVector[^>]*>\s*" + number + r"\s*</gml:offsetVector>.*?<gml:offsetVector[^>]*>\s*" + number, i).try_cast("double")
    epsg = F.regexp_extract(xml, r"EPSG:+(\d+)", 1).try_cast("int")
    a, d, b, e = (vectors(i) for i in range(1, 5))
    affine = F.struct((pos(1) - (a + b) / 2).alias("ox"), a.alias("pw"), b.alias("skx"), (pos(2) - (d + e) / 2).alias("oy"), d.alias("sky"), e.alias("ph"))
    return F.when(pos(1).isNotNull() & e.isNotNull(), F.struct(epsg.alias("epsg"), affine.alias("affine")))


_CONTAINERS = (b"jp2h", b"asoc", b"uinf", b"rreq", b"list")


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """(type, start, end) of the JPEG 2000 boxes, those within container boxes too."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack(">I4s", data[start : start + 8])
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack(">Q", data[body : body + 8])[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield kind, body, stop
        if kind in _CONTAINERS:
            yield from boxes(data, body, stop)
        start = stop


def jp2_xml(data: bytes) -> str | None:
    return next((data[a:b].rstrip(b"\0").decode("utf-8", "replace") for kind, a, b in boxes(data) if kind == b"xml "), None)


def jp2_header(data: bytes) -> dict:
    """Size, bands, bits and colour of a JPEG 2000 file or bare codestream; no codec is needed."""
    found = [(k, a, b) for k, a, b in boxes(data) if k in (b"jp2c", b"colr")] if data[4:8] == b"jP  " else []
    at = next((a for k, a, _ in found if k == b"jp2c"), 0)
    siz = data.find(b"\xff\x51", at, at + 64)
    if siz < 0:
        raise ValueError("no SIZ segment")
    _, _, x1, y1, x0, y0 = struct.unpack(">HHIIII", data[siz + 2 : siz + 22])
    bands = struct.unpack(">H", data[siz + 38 : siz + 40])[0]
    depths = {data[siz + 40 + 3 * i] for i in range(bands)}
    if len(depths) != 1:
        raise ValueError("components differ in depth")
    depth = depths.pop()
    bits = (depth & 127) + 1
    if bits not in (8, 12, 16):
        raise ValueError(f"{bits} bits are not supported")
    colour = next((struct.unpack(">I", data[a + 3 : a + 7])[0] for k, a, _ in found if k == b"colr" and data[a] == 1), None)
    rgb = bands >= 3 and colour in (16, 18, None)
    return {
        "width": x1 - x0, "height": y1 - y0, "bands": bands, "bits": bits, "sample_format": "int" if depth & 128 else "uint",
        "photometric": "rgb" if rgb else "minisblack", "extra_samples": ["associatedalpha"] if rgb and bands == 4 else [],
    }


#: Back-ends for pixel codecs that the library has none of: name -> function(bytes) -> array (rows, cols, bands).
DECODERS: dict = {}


def decode(codec: str, data: bytes):
    if codec not in DECODERS:
        raise NotImplementedError(f"no {codec} codec is installed; register one in gridloom.sources.sidecar.DECODERS")
    return DECODERS[codec](data)


def read_headers(files: DataFrame) -> DataFrame:
    """A catalogue row per JPEG 2000 file (columns path, content), with its GML text; errors stay in their row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                row = {"path": path, "error": None, "xml": None, "width": None, "height": None, "bands": None, "bits": None, "sample_format": None, "photometric": None, "extra_samples": []}
                try:
                    row |= jp2_header(bytes(content)) | {"xml": jp2_xml(bytes(content))}
                except (ValueError, struct.error) as e:
                    row["error"] = str(e)
                out.append(row)
            yield pd.DataFrame(out)

    return files.select("path", "content").mapInPandas(
        run, "path string, error string, xml string, width int, height int, bands int, bits int, sample_format string, photometric string, extra_samples array<string>"
    )


def georef_of(path: str, data: bytes, beside=None) -> dict:
    """affine (ox, pw, skx, oy, sky, ph) and epsg of one JPEG 2000 file: from its GML, else a world file and a projection.

    ``beside(extension)`` gives the text of the file of that extension next to it, or None. Neither: both are None.
    """
    import re

    number = r"(-?[0-9.eE+-]+)[ ,]+(-?[0-9.eE+-]+)"
    xml = jp2_xml(data) or ""
    origin = re.search(r"(?s)<gml:origin>.*?<gml:pos[^>]*>\s*" + number, xml)
    vectors = re.findall(r"(?s)<gml:offsetVector[^>]*>\s*" + number, xml)
    if origin and len(vectors) >= 2:
        (a, d), (b, e) = (tuple(map(float, v)) for v in vectors[:2])
        x, y = float(origin[1]), float(origin[2])
        code = re.search(r"EPSG:+(\d+)", xml)
        return {"affine": (x - (a + b) / 2, a, b, y - (d + e) / 2, d, e), "epsg": int(code[1]) if code else None}
    for extension in WORLD_EXTENSIONS:
        text = beside(extension) if beside else None
        try:
            v = [float(t) for t in text.split()[:6]] if text else []
        except ValueError:
            v = []
        if len(v) == 6:
            a, d, b, e, x, y = v
            code = re.search(r'EPSG",\s*"?(\d+)', beside("prj") or "")
            return {"affine": (x - (a + b) / 2, a, b, y - (d + e) / 2, d, e), "epsg": int(code[1]) if code else None}
    return {"affine": None, "epsg": None}


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def georeference(rasters: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``rasters`` (path, xml) with epsg and affine: from the GML, else a world file and a projection, by common stem."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    order = F.array_position(F.array(*[F.lit(e) for e in WORLD_EXTENSIONS]), ext)
    worlds = sidecars.where(ext.isin(*WORLD_EXTENSIONS)).groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("text", order).alias("world"))
    prjs = sidecars.where(ext == "prj").groupBy(stem(F.col("path")).alias("stem")).agg(F.max("text").alias("prj"))
    joined = rasters.withColumn("stem", stem(F.col("path"))).join(worlds, "stem", "left").join(prjs, "stem", "left")
    gml, world = gml_georef(F.col("xml")), world_file(F.col("world"))
    return joined.withColumns({"affine": F.coalesce(gml.affine, world), "epsg": F.coalesce(gml.epsg, F.when(world.isNotNull(), prj_epsg(F.col("prj"))))}).drop("stem", "world", "prj")

