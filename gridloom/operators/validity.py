"""Which pixels are valid: predicates, the choice among them, transparency, and mask directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Types whose no-data value can be matched; 64-bit integers can't.
NODATA_TYPES = (("uint", 8), ("uint", 16), ("uint", 32), ("int", 8), ("int", 16), ("int", 32), ("float", 32), ("float", 64))
#: Types the nonzero rule knows; pixels of others all count as valid.
NONZERO_TYPES = (("uint", 8), ("uint", 16), ("int", 16), ("float", 32), ("float", 64))
_EPSILON = {32: 1.1920928955078125e-07, 64: 2.220446049250313e-16}


def by_nodata(value: Column, nodata: float, sample_format: str = "float", bits: int = 64) -> Column:
    """Valid unless it is the no-data value; NaN no-data matches NaN. Null pixels are invalid."""
    if sample_format == "float":
        if nodata != nodata:
            hit = F.isnan(value)
        else:
            hit = F.abs(value - F.lit(nodata)) < _EPSILON[bits]
    else:
        hit = value == F.lit(nodata)
    return value.isNotNull() & ~F.coalesce(hit, F.lit(False))


def by_nonzero(value: Column, threshold: float = 0.0, sample_format: str = "float", bits: int = 64) -> Column:
    """Valid above the threshold, so negative values are not."""
    if (sample_format, bits) not in NONZERO_TYPES:
        return F.lit(True)
    return F.coalesce((value > threshold) & ~F.isnan(value), F.lit(False))  # Spark orders NaN above all numbers


def by_alpha(alpha: Column) -> Column:
    return F.coalesce(alpha > 0, F.lit(False))


def by_mask(mask: Column) -> Column:
    return F.coalesce(mask != 0, F.lit(False))


def by_black(r: Column, g: Column, b: Column) -> Column:
    """Valid unless all three are 0."""
    return F.coalesce(~((r == 0) & (g == 0) & (b == 0)), F.lit(False))


def synthesise(valid: Column) -> Column:
    """The mask band written to a file."""
    return F.when(valid, 255).otherwise(0)


def summary(mask: DataFrame, *by: str) -> DataFrame:
    """Valid pixels, all valid, none valid."""
    n = F.count_if("valid").cast("long")
    return mask.groupBy(*by).agg(n.alias("n_valid"), (n == F.count("*")).alias("all_valid"), (n == 0).alias("none_valid"))


def alpha_band() -> Column:
    """Number of the alpha band, or null: after the colour bands, at its place among the extra samples."""
    extra = F.col("extra_samples")
    first = F.filter(F.transform(extra, lambda x, i: F.when(x.isin("associatedalpha", "unassociatedalpha"), i)), lambda i: i.isNotNull())
    colour = F.when(F.col("photometric") == "rgb", 3).when(F.col("photometric").isin("minisblack", "palette"), 1).otherwise(
        F.greatest(F.col("bands") - F.size(extra), F.lit(0))
    )
    return colour + F.get(first, F.lit(0)) + 1


def black_rgb_candidate() -> Column:
    return (F.col("bands") == 3) & (F.col("photometric") == "rgb") & (F.size("extra_samples") == 0) & (F.col("bits") == 8) & (F.col("sample_format") == "uint")


def nonzero_candidate() -> Column:
    return (F.col("bands") == 1) & (F.col("photometric") == "minisblack")


def usable_nodata() -> Column:
    kind = F.concat_ws("", "sample_format", "bits")
    return F.col("nodata").isNotNull() & kind.isin([f"{f}{b}" for f, b in NODATA_TYPES]) & F.expr("try_cast(nodata as double)").isNotNull()


def choose(catalog: DataFrame, choice: str = "auto", mask_from_alpha: bool = True, nonzero: bool = True, black_rgb: bool = False) -> DataFrame:
    """``validity``: what a raster's valid pixels follow from. Needs has_mask beside the catalogue's columns.

    Automatic: mask, alpha, nodata, nonzero, black_rgb, full. An 8-bit single-band JPEG 2000 counts as a mask of its own.
    A choice that is forced and can't be had gives an error for that row in ``validity_error``.
    """
    bitmask = (F.col("driver") == "JP2OpenJPEG") & nonzero_candidate() & (F.col("bits") <= 8)
    mask = F.col("has_mask") | bitmask
    has = {"mask": mask, "alpha": alpha_band().isNotNull(), "nodata": usable_nodata(), "nonzero": F.lit(True), "full": F.lit(True)}
    if choice != "auto":
        return catalog.withColumns({"validity": F.when(has[choice], choice), "validity_error": F.when(~has[choice], f"{choice} was asked for, but there is none")})
    got = F.when(mask, "mask")
    if mask_from_alpha:
        got = got.when(has["alpha"], "alpha")
    got = got.when(has["nodata"], "nodata")
    if nonzero:
        got = got.when(nonzero_candidate(), "nonzero")
    if black_rgb:
        got = got.when(black_rgb_candidate(), "black_rgb")
    return catalog.withColumns({"validity": got.otherwise("full"), "validity_error": F.lit(None).cast("string")})


def transparency(mask_from_alpha: bool = True, black_rgb: bool = False) -> Column:
    """What the mask of a converted file is made from."""
    got = F.when(F.col("has_mask"), "dataset_mask")
    if mask_from_alpha:
        got = got.when(alpha_band().isNotNull(), "alpha")
    if black_rgb:
        got = got.when(black_rgb_candidate(), "black_rgb")
    return got.otherwise("none")


def is_mask_directory(subfile: Column, old_subfile: Column, samples: Column, photometric: Column) -> Column:
    return (subfile.bitwiseAND(4) != 0) | (old_subfile == 4) | ((samples == 1) & (photometric == 4))


def is_reduced_directory(subfile: Column, old_subfile: Column) -> Column:
    return (subfile.bitwiseAND(1) != 0) | (old_subfile == 2)


def match_masks(catalog: DataFrame, levels: DataFrame) -> DataFrame:
    """raster_id, has_mask, and for each overview the directory of its mask.

    A raster has a mask if exactly one mask has its size, and each overview has a mask of its own size, each used once:
    the n-th overview of a size takes the n-th mask of it.
    """
    sized = levels.join(catalog.select("raster_id", F.col("width").alias("w"), F.col("height").alias("h")), "raster_id")
    full = F.col("is_mask") & (F.col("width") == F.col("w")) & (F.col("height") == F.col("h"))
    nth = Window.partitionBy("raster_id", "is_mask", "width", "height").orderBy("idx")
    rest = sized.where(~full).withColumn("nth", F.row_number().over(nth))
    overviews = rest.where("not is_mask").select("raster_id", "width", "height", "nth", F.col("idx").alias("overview"))
    masks = rest.where("is_mask").select("raster_id", "width", "height", "nth", F.col("idx").alias("mask"))
    matched = overviews.join(masks, ["raster_id", "width", "height", "nth"], "left")
    base = sized.groupBy("raster_id").agg(F.count_if(full).alias("n_full"), F.min(F.when(full, F.col("idx"))).alias("base_mask"))
    pairs = matched.groupBy("raster_id").agg(F.bool_and(F.col("mask").isNotNull()).alias("complete"), F.sort_array(F.collect_list(F.struct("overview", "mask"))).alias("pairs"))
    found = base.join(pairs, "raster_id", "left").select("raster_id", ((F.col("n_full") == 1) & F.coalesce("complete", F.lit(True))).alias("has_mask"), "base_mask", "pairs")
    return catalog.select("raster_id").join(found, "raster_id", "left").select(
        "raster_id", F.coalesce("has_mask", F.lit(False)).alias("has_mask"), F.when(F.col("has_mask"), F.col("base_mask")).alias("base_mask"), F.when(F.col("has_mask"), F.col("pairs")).alias("pairs")
    )
