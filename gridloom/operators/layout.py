"""Metadata reports, layout validation, the choice of a conversion path, and batches, over a catalogue of rasters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names of codecs and their aliases, of conversion paths, and further down the words of findings and reports,
# which consumers match.
WEB_CODECS = ("none", "lzw", "deflate", "jpeg", "zstd", "lerc")
CODECS = {"none": "none", "raw": "none", "lzw": "lzw", "deflate": "deflate", "zip": "deflate", "zstd": "zstd", "jpeg": "jpeg", "jpg": "jpeg", "lerc": "lerc"}
PATHS = ("identity", "transcode", "planar_permute", "chunky_permute", "hybrid_crop", "strip_encode", "full_encode")


def check_options(block: int = 512, codec: str = "deflate", deflate_level: int = 6, jpeg_quality: int = 75, lerc_error: float = 0.0) -> str:
    """The codec's own name; an error for options out of range."""
    if codec.lower() not in CODECS:
        raise ValueError(f"unknown compression {codec!r}")
    if block <= 0 or block % 16:
        raise ValueError("the block size must be a multiple of 16")
    if not 0 <= deflate_level <= 9:
        raise ValueError("the deflate level is 0 to 9")
    if not 1 <= jpeg_quality <= 100:
        raise ValueError("the JPEG quality is 1 to 100")
    if lerc_error < 0:
        raise ValueError("the LERC error can't be negative")
    return CODECS[codec.lower()]


def _rule(when: Column, level: str, rule: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), text.alias("message")))


def _power_of_two(c: Column) -> Column:
    return (c > 0) & (c.bitwiseAND(c - 1) == 0)


def issues(catalog: DataFrame, levels: DataFrame) -> DataFrame:
    """raster_id, rule, level, message: a row per finding of the GeoTIFF rasters."""
    tiff = catalog.where("driver = 'GTiff'")
    overviews = levels.where("not is_mask")
    masks = levels.where("is_mask")
    n_overviews = overviews.groupBy("raster_id").agg(F.count("*").alias("n_overviews"))
    base = tiff.join(n_overviews, "raster_id", "left").withColumn("n_overviews", F.coalesce("n_overviews", F.lit(0)))
    x, y = F.col("block_x"), F.col("block_y")
    size = F.concat(x.cast("string"), F.lit("x"), y.cast("string"))
    tiled = F.col("tiled")
    own = base.select("raster_id", F.explode(F.array_compact(F.array(
        _rule(~tiled, "error", "V1", "the base image is striped, not tiled"),
        _rule(F.col("n_overviews") == 0, "error", "V2", "no overviews"),
        _rule(~F.col("compression").isin(*WEB_CODECS), "warning", "V3", F.concat(F.lit("compression "), "compression", F.lit(" is unusual on the web"))),
        _rule(tiled & ((x % 16 != 0) | (y % 16 != 0)), "warning", "V4", F.concat(F.lit("tile size "), size, F.lit(" is not a multiple of 16"))),
        _rule(tiled & ~(_power_of_two(x) & _power_of_two(y)), "warning", "V5", F.concat(F.lit("tile size "), size, F.lit(" is not a power of two"))),
        _rule(~F.col("has_affine"), "warning", "V6", "no georeferencing"),
        _rule(~F.col("ghost"), "warning", "V14", "no structural metadata"),
    ))).alias("i")).select("raster_id", "i.*")

    in_order = Window.partitionBy("raster_id").orderBy("idx")
    stepped = overviews.join(tiff.select("raster_id", F.col("width").alias("w"), F.col("height").alias("h"), F.col("compression").alias("codec")), "raster_id").select(
        "*", (F.row_number().over(in_order) - 1).cast("string").alias("n"),
        F.coalesce(F.lag("width").over(in_order), F.col("w")).alias("before_w"), F.coalesce(F.lag("height").over(in_order), F.col("h")).alias("before_h"),
    )
    name = lambda text: F.concat(F.lit("overview "), "n", F.lit(text))
    levels_found = stepped.select("raster_id", F.explode(F.array_compact(F.array(
        _rule(~F.col("tiled"), "error", "V7", name(" is not tiled")),
        _rule(F.col("compression") != F.col("codec"), "warning", "V8", name(" is compressed otherwise than the base image")),
        _rule((F.col("width") >= F.col("before_w")) | (F.col("height") >= F.col("before_h")), "warning", "V9", name(" is not smaller than the level before")),
    ))).alias("i")).select("raster_id", "i.*")

    sized = masks.join(tiff.select("raster_id", F.col("width").alias("w"), F.col("height").alias("h")), "raster_id")
    full = (F.col("width") == F.col("w")) & (F.col("height") == F.col("h"))
    per = sized.groupBy("raster_id").agg(F.count_if(full).alias("n_full"), F.count_if(~full).alias("n_reduced"))
    per = per.join(base.select("raster_id", "n_overviews"), "raster_id")
    mask_sets = per.select("raster_id", F.explode(F.array_compact(F.array(
        _rule(F.col("n_full") > 1, "error", "V10", F.concat(F.col("n_full").cast("string"), F.lit(" masks of full size"))),
        _rule(F.col("n_reduced") != F.col("n_overviews"), "warning", "V12", F.concat(F.col("n_reduced").cast("string"), F.lit(" mask overviews for "), F.col("n_overviews").cast("string"), F.lit(" overviews"))),
    ))).alias("i")).select("raster_id", "i.*")
    striped = sized.where("not tiled").select("raster_id", F.lit("V11").alias("rule"), F.lit("error").alias("level"), F.concat(F.lit("mask "), F.col("idx").cast("string"), F.lit(" is not tiled")).alias("message"))
    lonely = overviews.join(masks.select("raster_id").distinct(), "raster_id", "left_semi").join(masks.select("raster_id", "width", "height"), ["raster_id", "width", "height"], "left_anti")
    lonely = lonely.join(tiff.select("raster_id"), "raster_id", "left_semi").select(
        "raster_id", F.lit("V13").alias("rule"), F.lit("warning").alias("level"), F.concat(F.lit("no mask of size "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("message"),
    )
    out = own
    for more in (levels_found, mask_sets, striped, lonely):
        out = out.unionByName(more)
    return out


def of_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, levels), as the rules here take them, from files' profiles (``sources.tiff.profiles``)."""
    read = profiles.where("error is null")
    n = F.size(F.coalesce("tiepoints", F.array().cast("array<struct<col:double,row:double,z:double,x:double,y:double,h:double>>")))
    catalog = read.withColumns({
        "has_affine": F.col("affine").isNotNull(), "has_matrix": F.col("matrix").isNotNull(), "has_scale": F.lit(False), "n_tiepoints": n, "grid_complete": F.lit(False), "has_rpc": F.col("rpc").isNotNull(),
    })
    each = lambda column, names: read.select("raster_id", F.inline(column)).select("raster_id", "idx", "width", "height", *names)
    own = each("overviews", [F.col("block_x").alias("block"), "compression", "tiled", F.lit(False).alias("is_mask")])
    masks = each("mask_ifds", [F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("compression"), "tiled", F.lit(True).alias("is_mask")])
    return catalog, own.unionByName(masks)


def verdicts(catalog: DataFrame, issue: DataFrame) -> DataFrame:
    """raster_id, n_errors, n_warnings, valid: no error."""
    n = issue.groupBy("raster_id").agg(F.count_if(F.col("level") == "error").alias("e"), F.count_if(F.col("level") == "warning").alias("w"))
    zero = F.lit(0)
    return catalog.where("driver = 'GTiff'").select("raster_id").join(n, "raster_id", "left").select(
        "raster_id", F.coalesce("e", zero).alias("n_errors"), F.coalesce("w", zero).alias("n_warnings"), (F.coalesce("e", zero) == 0).alias("valid")
    )


def validation_text(catalog: DataFrame, issue: DataFrame) -> DataFrame:
    """A report per GeoTIFF raster: the verdict, the file, and a line per finding, errors first."""
    tag = F.when(F.col("level") == "error", "ERROR").otherwise("WARN")
    line = F.struct((F.col("level") != "error").alias("later"), "rule", F.concat(F.lit("  ["), tag, F.lit("] "), "message").alias("text"))
    found = issue.groupBy("raster_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x.text).alias("lines"))
    head = F.when(F.col("errors") > 0, "FAILED").when(F.size("lines") > 0, "PASSED (with warnings)").otherwise("PASSED")
    name = F.coalesce("path", "raster_id") if "path" in catalog.columns else F.col("raster_id")
    files = catalog.where("driver = 'GTiff'").select("raster_id", name.alias("file"))
    all_of = files.join(found, "raster_id", "left").withColumns({"errors": F.coalesce("errors", F.lit(0)), "lines": F.coalesce("lines", F.array().cast("array<string>"))})
    text = F.array_join(F.concat(F.array(F.concat(F.lit("COG validation: "), head), F.concat(F.lit("File: "), "file")), F.col("lines")), "\n")
    return all_of.select("raster_id", text.alias("report"))


def validation_report(path: str, found: list[tuple[str, str]]) -> str:
    """The same report of one file's (level, message) findings."""
    errors = [m for level, m in found if level == "error"]
    rest = [m for level, m in found if level != "error"]
    head = "FAILED" if errors else "PASSED (with warnings)" if rest else "PASSED"
    return "\n".join([f"COG validation: {head}", f"File: {path}", *(f"  [ERROR] {m}" for m in errors), *(f"  [WARN] {m}" for m in rest)])


def info_report(p: dict) -> str:
    """What ``api.info`` says of a file, as lines of text in a fixed form."""
    block = f", block {p['block_x']}x{p['block_y']}" if p.get("block_x") else ""
    lines = [
        f"Driver: {p['driver']}", f"Files: {p['path']}", f"Size is {p['width']}, {p['height']}", f"Band count: {p['bands']} ({p['bits']}-bit {p['sample_format']})",
        f"Photometric: {p['photometric']}", f"Layout: {'tiled' if p['tiled'] else 'striped'}{block}", f"Compression: {p['compression']}",
    ]
    lines += [f"{name}: {p[key]}" for name, key in (("NoData", "nodata"), ("EPSG", "epsg")) if p.get(key) not in (None, "")]
    if a := p.get("affine"):
        xs = [a["ox"] + c * a["pw"] + r * a["skx"] for c in (0, p["width"]) for r in (0, p["height"])]
        ys = [a["oy"] + c * a["sky"] + r * a["ph"] for c in (0, p["width"]) for r in (0, p["height"])]
        lines.append("Bounds: (" + ", ".join(f"{v:.6f}" for v in (min(xs), min(ys), max(xs), max(ys))) + ")")
        lines.append("GeoTransform: [" + ", ".join(f"{a[k]:.10f}" for k in ("ox", "pw", "skx", "oy", "sky", "ph")) + "]")
    own = p.get("overviews") or []
    lines.append(f"Overviews: {len(own) or 'none'}")
    lines += [f"  {o['idx']}: {o['width']}x{o['height']}, block {o['block_x']}x{o['block_y']}" for o in own]
    return "\n".join(lines)


def info(catalog: DataFrame, levels: DataFrame) -> DataFrame:
    """What the files say of themselves: a row per raster, with its overviews. JPEG 2000 has no blocks or overviews."""
    jp2 = F.col("driver") == "JP2OpenJPEG"
    ov = levels.where("not is_mask").groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("idx", "width", "height", "block", "compression"))).alias("overviews"))
    n = F.when(jp2, 0).otherwise(F.coalesce(F.size("overviews"), F.lit(0)))
    return catalog.join(ov, "raster_id", "left").select(
        "raster_id", "driver", "width", "height", "bands", F.concat("sample_format", F.col("bits").cast("string")).alias("dtype"), "compression",
        (jp2 | F.col("tiled")).alias("tiled"), F.when(~jp2, F.col("block_x")).alias("block_x"), F.when(~jp2, F.col("block_y")).alias("block_y"), "nodata", "epsg",
        n.cast("int").alias("n_overviews"), F.when(~jp2, F.col("overviews")).alias("overviews"),
    )


def info_text(report: DataFrame) -> DataFrame:
    size = F.format_string("Size: %d x %d, %d band(s), %s", "width", "height", "bands", "dtype")
    block = F.when(F.col("block_x").isNotNull(), F.format_string("Block: %d x %d", "block_x", "block_y"))
    ov = F.array_join(F.transform(F.coalesce("overviews", F.array().cast("array<struct<idx:int,width:int,height:int,block:int,compression:string>>")), lambda o: F.format_string("Overview %d: %d x %d", o.idx, o.width, o.height)), "\n")
    lines = F.array(
        F.format_string("Driver: %s", "driver"), size, F.format_string("Compression: %s", "compression"), block,
        F.when(F.col("epsg").isNotNull(), F.format_string("EPSG: %d", "epsg")), F.when(F.col("nodata").isNotNull(), F.format_string("No data: %s", "nodata")), F.when(ov != "", ov),
    )
    return report.select("raster_id", F.array_join(F.array_compact(lines), "\n").alias("report"))


def bounds(ox: Column, pw: Column, skx: Column, oy: Column, sky: Column, ph: Column, width: Column, height: Column) -> dict[str, Column]:
    xs = [ox, ox + width * pw, ox + height * skx, ox + width * pw + height * skx]
    ys = [oy, oy + width * sky, oy + height * ph, oy + width * sky + height * ph]
    return {"min_x": F.least(*xs), "min_y": F.least(*ys), "max_x": F.greatest(*xs), "max_y": F.greatest(*ys)}


def conversion_path(codec: str, block: int, bands: list[int] | None = None, window: bool = False) -> Column:
    """The cheapest way to make the output: copy blocks, recode them, renumber planes, or encode anew.

    Needs ``n_overviews`` and ``overviews_alike`` (all overviews tiled in the base's block size) beside the catalogue.
    """
    identity = F.lit(True) if bands is None else F.transform(F.sequence(F.lit(1), F.col("bands")), lambda i: i.cast("int")) == F.array(*[F.lit(b) for b in bands])
    alike = (F.col("block_x") == block) & (F.col("block_y") == block)
    same_codec = F.col("compression") == codec
    has = F.col("n_overviews") > 0
    return (
        F.when(F.col("driver") != "GTiff", "strip_encode")
        .when(~F.col("tiled"), F.when(identity, "strip_encode").otherwise("full_encode"))
        .when(~alike, "full_encode")
        .when(F.lit(window), "hybrid_crop")
        .when(identity & same_codec, F.when(F.col("overviews_alike"), "identity").otherwise(F.when(has, "transcode").otherwise("full_encode")))
        .when(identity, F.when(has, "transcode").otherwise("full_encode"))
        .when(same_codec & (F.col("planar") == "planar"), "planar_permute")
        .when(F.col("planar") == "chunky", "chunky_permute")
        .otherwise("full_encode")
    )


def output_name(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit(extension))


def batch_plan(inputs: DataFrame, existing: DataFrame, extension: str = ".tif", overwrite: bool = False) -> DataFrame:
    """path, output, status: todo, skipped (the output is there), or collision (two inputs would write one output)."""
    named = inputs.select("path", output_name(F.col("path"), extension).alias("output"))
    rank = F.row_number().over(Window.partitionBy("output").orderBy("path"))
    have = existing.select("output").distinct().withColumn("there", F.lit(True))
    skip = F.lit(False) if overwrite else F.coalesce("there", F.lit(False))
    return named.withColumn("k", rank).join(have, "output", "left").select("path", "output", F.when(F.col("k") > 1, "collision").when(skip, "skipped").otherwise("todo").alias("status"))


def run_batch(plan: DataFrame, job: Callable[[str, str], None], partitions: int | None = None) -> DataFrame:
    """Run ``job(path, output)`` for each file that is to do; a failure is a row, and never ends the batch."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, output, status in zip(pdf["path"], pdf["output"], pdf["status"], strict=True):
                began, error = time.time(), None
                if status == "todo":
                    try:
                        job(path, output)
                        status = "ok"
                    except Exception as e:  # noqa: BLE001  reported in the row
                        status, error = "failed", f"{type(e).__name__}: {e}"
                rows.append((path, output, status, error, time.time() - began))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "output", "status", "error", "seconds"])

    todo = plan.repartition(partitions, "path") if partitions else plan
    return todo.mapInPandas(run, "path string, output string, status string, error string, seconds double")


def batch_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def stats_json(results: DataFrame) -> DataFrame:
    """A JSON text a file; error is left out where there is none."""
    return results.select("path", F.to_json(F.struct(F.col("path").alias("input"), "output", (F.col("status") == "ok").alias("success"), "seconds", "error")).alias("stats"))
