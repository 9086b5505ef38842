"""Whole-file operations: info, validate, convert, crop, select bands, footprint; and their batches over a directory.

Each works on one file, so a batch spreads files over the cluster. The same rules, over catalogues and pixels as
DataFrames, are in gridloom.operators.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.functions import geo
from gridloom.operators import cog, footprint as fp, layout, windows
from gridloom.sources import jpeg2000, sidecar, tiff

Options = cog.Options


@dataclass
class FootprintOptions:
    source: str = "auto"  # auto, mask, alpha, nodata, nonzero, full
    georef: str = "auto"  # a key of geo.GEOREF_CHOICES
    threshold: float = 0.0
    outer_only: bool = False
    all_rings: bool = False
    mask_from_alpha: bool = True
    nonzero: bool = True
    black_rgb: bool = False
    simplify: float = 0.0  # in map units, before reprojection, where simplify_degrees is not given
    simplify_degrees: float = 0.0
    to_wgs84: bool = True
    spline_points: int = 400
    height: float | None = None
    dem: str | None = None
    window: tuple[int, int, int, int] | None = None
    format: str = "geojson"  # geojson, wkt, flat
    compat: bool = False


def is_jp2(path: str) -> bool:
    """Whether a file is JPEG 2000: by its first bytes, or where they tell nothing, by its name."""
    with tiff.open_file(path) as f:
        head = f.read(12)
    if head[4:8] in (b"jP  ", b"ftyp") or head[:4] == b"\xff\x4f\xff\x51":
        return True
    return head[:2] not in (b"II", b"MM") and path.split("?")[0].lower().endswith((".jp2", ".j2k", ".j2c"))


def jp2_georef(path: str, data: bytes) -> dict:
    """affine and epsg of a JPEG 2000 file, from itself or the files beside it."""

    def beside(extension: str) -> str | None:
        try:
            with tiff.open_file(path.rsplit(".", 1)[0] + "." + extension) as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None

    return sidecar.georef_of(path, data, None if path.startswith(("http://", "https://")) else beside)


def info(path: str) -> dict:
    """The catalogue row of a file, from its header."""
    if is_jp2(path):
        with tiff.open_file(path) as f:
            data = f.read()
        where = jp2_georef(path, data)
        affine = where["affine"] and dict(zip(("ox", "pw", "skx", "oy", "sky", "ph"), where["affine"], strict=True))
        row = {"raster_id": path, "path": path, "driver": "JP2OpenJPEG", "compression": "jpeg2000", "tiled": True, "overviews": [], "gml": sidecar.jp2_xml(data), "affine": affine, "epsg": where["epsg"], "nodata": None}
        return row | sidecar.jp2_header(data)
    with tiff.open_file(path) as f:
        return tiff.profile(path, tiff.parse(f))


def validate(path: str) -> list[tuple[str, str]]:
    """(level, message) findings of a GeoTIFF; valid if none is an error."""
    p = info(path)
    if p["driver"] != "GTiff":
        raise ValueError("only GeoTIFF files have a layout to validate")
    x, y, out = p["block_x"], p["block_y"], []
    if not p["tiled"]:
        out.append(("error", "the base image is striped, not tiled"))
    if not p["overviews"]:
        out.append(("error", "no overviews"))
    if p["compression"] not in layout.WEB_CODECS:
        out.append(("warning", f"compression {p['compression']} is unusual on the web"))
    if p["tiled"] and (x % 16 or y % 16):
        out.append(("warning", f"tile size {x}x{y} is not a multiple of 16"))
    if p["tiled"] and (x & (x - 1) or y & (y - 1)):
        out.append(("warning", f"tile size {x}x{y} is not a power of two"))
    if p["affine"] is None:
        out.append(("warning", "no georeferencing"))
    before = p["width"], p["height"]
    for n, o in enumerate(p["overviews"]):
        if not o["tiled"]:
            out.append(("error", f"overview {n} is not tiled"))
        if o["compression"] != p["compression"]:
            out.append(("warning", f"overview {n} is compressed otherwise than the base image"))
        if o["width"] >= before[0] or o["height"] >= before[1]:
            out.append(("warning", f"overview {n} is not smaller than the level before"))
        before = o["width"], o["height"]
    full = [m for m in p["mask_ifds"] if (m["width"], m["height"]) == (p["width"], p["height"])]
    reduced = [m for m in p["mask_ifds"] if m not in full]
    if len(full) > 1:
        out.append(("error", f"{len(full)} masks of full size"))
    out += [("error", f"mask {m['idx']} is not tiled") for m in p["mask_ifds"] if not m["tiled"]]
    if p["mask_ifds"]:
        if len(reduced) != len(p["overviews"]):
            out.append(("warning", f"{len(reduced)} mask overviews for {len(p['overviews'])} overviews"))
        sizes = {(m["width"], m["height"]) for m in p["mask_ifds"]}
        out += [("warning", f"no mask of size {o['width']}x{o['height']}") for o in p["overviews"] if (o["width"], o["height"]) not in sizes]
    if not p["ghost"]:
        out.append(("warning", "no structural metadata"))
    return out


def is_valid(path: str) -> bool:
    return not any(level == "error" for level, _ in validate(path))


def convert(source: str, target: str, options: Options | None = None) -> None:
    """A GeoTIFF or JPEG 2000 file as a cloud-optimised GeoTIFF."""
    if is_jp2(source):
        with tiff.open_file(source) as f:
            georef = jp2_georef(source, f.read())
        cog.convert_jp2(source, target, replace(options or Options()), georef)
    else:
        cog.convert(source, target, options)


def crop(source: str, target: str, *, pixels: tuple[int, int, int, int] | None = None, coordinates: tuple[float, float, float, float] | None = None, options: Options | None = None) -> None:
    """Crop by (col, row, width, height) or by (ulx, uly, lrx, lry); exactly one of them."""
    if (pixels is None) == (coordinates is None):
        raise ValueError("give either pixels or coordinates")
    p = info(source)
    if pixels:
        w = windows.by_pixels(p["width"], p["height"], *pixels)
    else:
        if p["affine"] is None:
            raise ValueError("the file has no georeferencing")
        w = windows.by_map(windows.Affine(**p["affine"]), p["width"], p["height"], *coordinates)
    convert(source, target, replace(options or Options(), window=(w.col_off, w.row_off, w.width, w.height)))


def select_bands(source: str, target: str, bands: list[int], options: Options | None = None) -> None:
    from gridloom.operators.bands import check

    convert(source, target, replace(options or Options(), bands=check(bands, info(source)["bands"])))


def validity(f, file: tiff.File, o: FootprintOptions) -> tuple[np.ndarray, str]:
    """Mask of valid pixels in the window, and what it follows from."""
    base = file.images[0]
    window = o.window or (0, 0, base.width, base.height)
    full = next((m for m in file.masks if (m.width, m.height) == (base.width, base.height)), None)
    alpha = next((i for i, e in enumerate(base.extra_samples) if "alpha" in e), None)
    nodata = None
    if base.nodata and not (base.sample_format != "float" and base.bits == 64):
        try:
            nodata = float(base.nodata)
        except ValueError:
            nodata = None
    single = base.bands == 1 and base.photometric == "minisblack"
    black = o.black_rgb and base.bands == 3 and base.photometric == "rgb" and not base.extra_samples and base.bits == 8
    have = {"mask": full is not None, "alpha": alpha is not None, "nodata": nodata is not None, "nonzero": True, "full": True}
    kind = o.source
    if kind == "auto":
        kind = "mask" if have["mask"] else "alpha" if o.mask_from_alpha and have["alpha"] else "nodata" if have["nodata"] else "nonzero" if o.nonzero and single else "black_rgb" if black else "full"
    elif not have[kind]:
        raise ValueError(f"{kind} was asked for, but there is none")
    read = lambda layer, bands: tiff.read_window(f, layer, *window, bands)
    if kind == "full":
        return np.ones((window[3], window[2]), bool), kind
    if kind == "mask":
        return read(full, [1])[:, :, 0] != 0, kind
    if kind == "alpha":
        return read(base, [base.bands - len(base.extra_samples) + alpha + 1])[:, :, 0] > 0, kind
    if kind == "black_rgb":
        return (read(base, [1, 2, 3]) != 0).any(axis=2), kind
    first = read(base, [1])[:, :, 0]
    if kind == "nonzero":
        return first > o.threshold, kind
    if nodata != nodata:
        return ~np.isnan(first), kind
    return (np.abs(first - nodata) >= np.finfo(first.dtype).eps) if first.dtype.kind == "f" else first != nodata, kind


def jp2_validity(image: jpeg2000.Image, head: dict, o: FootprintOptions) -> tuple[np.ndarray, str]:
    """Mask of valid pixels in the window of a JPEG 2000 image, and what it follows from; decoded region by region.

    One grey band of 8 bits or fewer is a mask itself, and goes before all else. Images of 12 bits are valid throughout where
    the samples of a band would decide. There is no no-data value in these files.
    """
    window = o.window or (0, 0, image.width, image.height)
    single = head["bands"] == 1 and head["photometric"] == "minisblack"
    alpha = next((head["bands"] - len(head["extra_samples"]) + i for i, e in enumerate(head["extra_samples"]) if "alpha" in e), None)
    black = o.black_rgb and head["bands"] == 3 and head["photometric"] == "rgb" and head["bits"] == 8
    have = {"mask": single and head["bits"] <= 8, "alpha": alpha is not None, "nodata": False, "nonzero": True, "full": True}
    kind = o.source
    if kind == "auto":
        kind = "mask" if have["mask"] else "alpha" if o.mask_from_alpha and have["alpha"] else "nonzero" if o.nonzero and single else "black_rgb" if black else "full"
    elif not have[kind]:
        raise ValueError(f"{kind} was asked for, but there is none")
    out = np.ones((window[3], window[2]), bool)
    if kind == "full" or kind == "nonzero" and head["bits"] == 12:
        return out, kind
    test = {
        "mask": lambda a: a[:, :, 0] != 0, "alpha": lambda a: a[:, :, alpha] > 0, "nonzero": lambda a: a[:, :, 0] > o.threshold, "black_rgb": lambda a: (a[:, :, :3] != 0).any(axis=2),
    }[kind]
    for col, row, width, height in jpeg2000.regions(image.width, image.height, window):
        part = test(image.read(col, row, width, height))
        out[row - window[1] : row - window[1] + height, col - window[0] : col - window[0] + width] = part
    return out, kind


def trace(valid: np.ndarray, compat: bool = False) -> list[list[tuple[float, float]]]:
    """Rings of a mask in pixels, without their closing point."""
    if valid.all():
        h, w = map(float, valid.shape)
        return [[(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)]]
    a = np.pad(valid, 1).astype(np.uint8)
    code = 8 * a[:-1, :-1] + 4 * a[:-1, 1:] + 2 * a[1:, 1:] + a[1:, :-1]
    middle = [fp.edge_middle(k) for k in range(4)]
    shapes = [fp.pieces(fp.straight(k) if compat else k) for k in range(16)]
    pieces = []
    for r, c in np.argwhere((code > 0) & (code < 15)).tolist():
        for i, j in shapes[code[r, c]]:
            pieces.append((c + middle[i][0], r + middle[i][1], c + middle[j][0], r + middle[j][1]))
    return fp.join_rings(sorted(pieces), compat)


def georeference(f, file: tiff.File, o: FootprintOptions):
    """(function from pixel arrays to coordinates, name of the model, EPSG)."""
    base = file.images[0]
    ties = [(t[0], t[1], t[3], t[4]) for t in base.tiepoints]
    rpc = next((d.rpc for d in file.layers if d.rpc), None)
    choice = geo.GEOREF_CHOICES[o.georef]

    def by_affine():
        a = base.affine
        return a and (lambda c, r: (a[0] + c * a[1] + r * a[2], a[3] + c * a[4] + r * a[5]))

    def by_rpc():
        if not rpc:
            return None
        model = geo.Rpc(rpc)
        if o.dem:
            with tiff.open_file(o.dem) as g:
                terrain = tiff.parse(g).images[0]
                grid = tiff.read_window(g, terrain, 0, 0, terrain.width, terrain.height, [1])[:, :, 0].astype(float)
                place = windows.Affine(*terrain.affine)

            def height_at(lon, lat):
                det = place.pw * place.ph - place.skx * place.sky
                dx, dy = lon - place.ox, lat - place.oy
                return geo.bilinear_lookup(grid, (place.ph * dx - place.skx * dy) / det - 0.5, (place.pw * dy - place.sky * dx) / det - 0.5)

            return lambda c, r: model.on_terrain(c, r, height_at)
        return lambda c, r: model.inverse(c, r, o.height)

    def by_least_squares():
        if len(ties) < 3:
            return None
        p = np.array(ties)
        a = np.column_stack((np.ones(len(p)), p[:, :2]))
        if np.linalg.matrix_rank(a) < 3:
            return None
        w = np.linalg.lstsq(a, p[:, 2:], rcond=None)[0]
        return lambda c, r: tuple(w[0, k] + c * w[1, k] + r * w[2, k] for k in (0, 1))

    models = {
        "affine": by_affine, "rpc": by_rpc, "tps": lambda: geo.Spline.of(ties, o.spline_points), "gcp_grid": lambda: geo.Grid.of(ties), "gcp_affine": by_least_squares, "pixel": lambda: (lambda c, r: (c, r)),
    }
    for name in models if choice == "auto" else [choice]:
        if (model := models[name]()) is not None:
            return model, name, base.epsg if name == "affine" else 4326 if name == "rpc" else base.epsg
    raise ValueError(f"{choice} was asked for, but the file has none")


def footprint(path: str, options: FootprintOptions | None = None) -> dict:
    """Outline of the valid area: body (in the format asked for), rings, validity, georef, epsg, ring_count, vertex_count."""
    o = options or FootprintOptions()
    if is_jp2(path):
        with tiff.open_file(path) as f:
            data = f.read()
        valid, kind = jp2_validity(jpeg2000.Image(data), sidecar.jp2_header(data), o)
        where = jp2_georef(path, data)
        if place := where["affine"] and windows.Affine(*where["affine"]):
            model, name, epsg = place.to_map, "affine", where["epsg"]
        else:
            model, name, epsg = (lambda c, r: (c, r)), "pixel", None
    else:
        with tiff.open_file(path) as f:
            file = tiff.parse(f)
            valid, kind = validity(f, file, o)
            model, name, epsg = georeference(f, file, o)
    rings = trace(valid, o.compat) if valid.any() else []
    if len(rings) > 1 and (o.outer_only or (kind == "nonzero" and not o.all_rings)):
        rings = [max(enumerate(rings), key=lambda r: (fp.area(r[1]), r[0]))[1]]
    dc, dr = (o.window or (0, 0))[:2]
    out = []
    for ring in rings:
        c, r = np.array(ring).T
        x, y = (np.asarray(v, float) for v in model(c + dc, r + dr))
        if o.simplify > 0 and o.simplify_degrees <= 0:
            x, y = np.array(fp.simplify_ring(list(zip(x.tolist(), y.tolist(), strict=True)), o.simplify)).T
        if o.to_wgs84 and name != "pixel":
            x, y, _ = geo.to_lonlat(epsg, x, y)
        points = list(zip(np.asarray(x).tolist(), np.asarray(y).tolist(), strict=True))
        out.append(fp.simplify_ring(points, o.simplify_degrees) if o.simplify_degrees > 0 else points)
    label = "gcp_tps" if name == "tps" else name
    properties = {"crs": "EPSG:4326" if o.to_wgs84 and name != "pixel" else None, "epsg": 4326 if o.to_wgs84 and name != "pixel" else epsg, "georef_source": label, "native_epsg": epsg, "validity_source": kind}
    return {"body": serialise(out, o.format, properties, o.compat), "rings": out, "validity": kind, "georef": label, "epsg": epsg, "ring_count": len(out), "vertex_count": sum(map(len, out))}


def serialise(rings: list, kind: str, properties: dict, compat: bool = False) -> str:
    closed = [[*r, r[0]] for r in rings]
    if kind == "geojson":
        geometry = {"type": "MultiPolygon", "coordinates": [[[list(p) for p in r]] for r in closed]} if closed else None
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": geometry, "properties": properties | ({} if closed else {"empty": True})}]})
    if kind == "flat":
        return " ".join(f"{v!r}" for r in closed for p in r for v in p)
    if kind != "wkt":
        raise ValueError(f"unknown format {kind!r}")
    texts = [", ".join(f"{x!r} {y!r}" for x, y in r) for r in closed]
    if not texts:
        return "POLYGON EMPTY"
    if len(texts) == 1:
        return f"POLYGON({texts[0]})" if compat else f"POLYGON(({texts[0]}))"
    return "MULTIPOLYGON(" + ", ".join(f"(({t}))" for t in texts) + ")"


def metrics_of_geojson(text: str) -> dict | None:
    """``ring_metrics`` of the first ring of a footprint's GeoJSON; None of an empty one."""
    rings = fp.rings_of_geojson(text)
    return ring_metrics(rings[0]) if rings else None


def ring_metrics(ring: list[tuple[float, float]]) -> dict:
    """Area, box, centroid (the first vertex counts twice, as the closing one) and vertices of a ring."""
    closed = np.array([*ring, ring[0]])
    (x0, y0), (x1, y1) = closed.min(axis=0).tolist(), closed.max(axis=0).tolist()
    cx, cy = closed.mean(axis=0).tolist()
    return {"n_vertices": len(ring), "area": fp.area(ring), "min_x": x0, "min_y": y0, "max_x": x1, "max_y": y1, "centroid_x": cx, "centroid_y": cy}


def batch(spark: SparkSession, paths: DataFrame, folder: str, kind: str = "cog", options=None, overwrite: bool = False) -> DataFrame:
    """A row per file (path, output, status, error, seconds); files that have an output are skipped unless ``overwrite``.

    ``paths`` has a column path; ``folder`` is one that all executors share. Kinds: cog, footprint.
    """
    from pyarrow import fs

    extension = ".tif" if kind == "cog" else {"geojson": ".geojson", "wkt": ".wkt", "flat": ".wkt.txt"}[(options or FootprintOptions()).format]
    system, base = tiff.file_system(folder)
    system.create_dir(base, recursive=True)
    # Files get their names when they are complete; what an executor left unfinished is a .part and counts for nothing.
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File and not i.base_name.endswith(".part")]
    existing = spark.createDataFrame([(n,) for n in names], "output string")

    def job(path: str, output: str) -> None:
        if kind == "cog":
            convert(path, f"{folder}/{output}", options)
        else:
            write_text(f"{folder}/{output}", footprint(path, options)["body"])

    return layout.run_batch(layout.batch_plan(sidecar.listing(paths), existing, extension, overwrite), job)


def write_text(target: str, text: str) -> None:
    """Write a text file under a name of its own, then give it its name."""
    import uuid

    system, name = tiff.file_system(target)
    held = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(held) as out:
        out.write(text.encode())
    system.move(held, name)
