"""Down-sampling of pixels, and overview pyramids.

A pixel frame has row, col, band, value; null is no data. Sizes are floors, so ragged last rows and columns belong to no
output pixel. Nearest and block average are one filter or one aggregation on ``row div s``. The kernels join the pixels
with two small tables of taps (out, src, w), one for each axis, and sum weights again over what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

METHODS = ("nearest", "average", "bilinear", "cubic", "lanczos")
ALIASES = {"avg": "average", "mean": "average", "linear": "bilinear"}


def method_of(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in METHODS:
        raise ValueError(f"unknown resampling {name!r}")
    return name


def overview_levels(width: int, height: int, block: int) -> list[int]:
    """Factors 2, 4, 8... while the larger side is beyond a block; 1024 is the last."""
    out, level, size = [], 2, max(width, height)
    while size > block and level <= 1024:
        out.append(level)
        size //= 2
        level *= 2
    return out


def overview_size(width: int, height: int, level: int) -> tuple[int, int]:
    return max(1, width // level), max(1, height // level)


def cubic_kernel(t: Column) -> Column:
    """Catmull-Rom: a = -1/2."""
    x = F.abs(t)
    near = (1.5 * x - 2.5) * x * x + 1.0
    far = ((-0.5 * x + 2.5) * x - 4.0) * x + 2.0
    return F.when(x <= 1.0, near).when(x < 2.0, far).otherwise(0.0)


def taps(spark, size: int, scale: int, method: str) -> DataFrame:
    """out, src, w along one axis of ``size`` pixels."""
    outs = spark.range(max(1, size // scale)).select(F.col("id").alias("out"))
    centre = F.least(F.col("out") * scale + (scale - 1) / 2.0, F.lit(float(size - 1)))
    spans = {"bilinear": (0, 1), "cubic": (-1, 2)}[method]
    base = outs.withColumn("centre", centre).withColumn("k", F.explode(F.sequence(F.lit(spans[0]), F.lit(spans[1]))))
    src = F.least(F.greatest(F.floor("centre") + F.col("k"), F.lit(0)), F.lit(size - 1))
    rows = base.withColumn("src", src.cast("long"))
    if method == "bilinear":
        part = F.col("centre") - F.floor("centre")
        rows = rows.withColumn("w", F.when(F.col("k") == 0, 1.0 - part).otherwise(part))
    else:
        rows = rows.withColumn("w", cubic_kernel(F.col("centre") - F.col("src")))
    return rows.groupBy("out", "src").agg(F.sum("w").alias("w")).where("w <> 0")


def downsample(pixels: DataFrame, scale: int, method: str, width: int, height: int) -> DataFrame:
    """``pixels`` of a width x height raster at 1 / scale; an output without data is null."""
    method = method_of(method)
    if method == "lanczos":  # the same as cubic here
        method = "cubic"
    if scale < 1:
        raise ValueError("scale must be at least 1")
    out_w, out_h = overview_size(width, height, scale)
    if method in ("bilinear", "cubic") and scale % 2:  # the centre falls on a pixel
        half = scale // 2
        at = pixels.where((F.col("row") % scale == half) & (F.col("col") % scale == half))
        return _inside(at.select(F.expr(f"row div {scale}").alias("row"), F.expr(f"col div {scale}").alias("col"), "band", "value"), out_w, out_h)
    if method == "nearest":
        at = pixels.where((F.col("row") % scale == 0) & (F.col("col") % scale == 0))
        return _inside(at.select(F.expr(f"row div {scale}").alias("row"), F.expr(f"col div {scale}").alias("col"), "band", "value"), out_w, out_h)
    if method == "average" or (method == "bilinear" and scale == 2):
        blocks = _inside(pixels.select(F.expr(f"row div {scale}").alias("row"), F.expr(f"col div {scale}").alias("col"), "band", "value"), out_w, out_h)
        return blocks.groupBy("row", "col", "band").agg(F.avg("value").alias("value"))
    spark = pixels.sparkSession
    # The tap tables have a few rows for each output row or column; Spark broadcasts them while they are small.
    down = taps(spark, height, scale, method).select(F.col("out").alias("r"), F.col("src").alias("row"), F.col("w").alias("wr"))
    across = taps(spark, width, scale, method).select(F.col("out").alias("c"), F.col("src").alias("col"), F.col("w").alias("wc"))
    w = F.when(F.col("value").isNotNull(), F.col("wr") * F.col("wc"))
    summed = (
        pixels.join(down, "row").join(across, "col").groupBy(F.col("r").alias("row"), F.col("c").alias("col"), "band")
        .agg(F.sum(F.col("value") * w).alias("s"), F.sum(w).alias("w"))
    )
    return summed.select("row", "col", "band", F.when(F.abs("w") > 0, F.col("s") / F.col("w")).alias("value"))


def _inside(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.where((F.col("row") < height) & (F.col("col") < width))


def pyramid(pixels: DataFrame, width: int, height: int, levels: list[int], method: str = "average", folder: str | None = None) -> DataFrame:
    """All levels in one frame with a column ``layer`` (0: base). A level that is twice the one before is made from it,
    any other from the base. Each level is written once, below ``folder`` or in the session's shared one, so level n
    doesn't repeat the n - 1 before it."""
    from gridloom.session import scratch

    spark = pixels.sparkSession
    folder = folder or scratch(spark, "pyramid")
    out = pixels.withColumn("layer", F.lit(0))
    before, frame, size = 1, pixels, (width, height)
    for n, level in enumerate(levels, 1):
        if level == 2 * before:
            frame = downsample(frame, 2, method, *size)
        else:
            frame = downsample(pixels, level, method, width, height)
        frame.write.mode("overwrite").parquet(f"{folder}/{n}")
        frame = spark.read.schema(frame.schema).parquet(f"{folder}/{n}")
        size = overview_size(width, height, level)
        before = level
        out = out.unionByName(frame.withColumn("layer", F.lit(n)).select(out.columns))
    return out


def source_level(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The stored overview to read a wanted level from: the largest factor that divides it, else the base (factor 1).

    Both frames have raster_id and level; an equi-join on the raster, then one row a wanted level by a maximum.
    """
    pairs = wanted.join(have.select("raster_id", F.col("level").alias("source")), "raster_id", "left")
    fits = F.when((F.col("source") <= F.col("level")) & (F.col("level") % F.col("source") == 0), F.col("source"))
    return pairs.groupBy("raster_id", "level").agg(F.coalesce(F.max(fits), F.lit(1)).alias("source"))
