"""Rasters derived from ordinary tables, in pixel form: (row, col, band, value), value null where there is no data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector, a column per component, one band."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select(
        "row", "col", F.lit(1).alias("band"), F.col("v").cast("double").alias("value")
    )


def activity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user, a column per hour: count, total and largest value, and alpha (255 where there was a purchase)."""
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))) / 3600).cast("int")
    amount = F.col("value").cast("decimal(18,2)")
    return e.groupBy(F.col("user_id").alias("row"), hour.alias("col")).agg(
        F.count("*").cast("double").alias("b1"),
        F.sum(amount).cast("double").alias("b2"),
        F.max(amount).cast("double").alias("b3"),
        F.max(F.when(F.col("event_type") == "purchase", 255.0).otherwise(0.0)).alias("b4"),
    )


def sales_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier, a column per part number modulo 64: quantity, price, mean discount, count."""
    li = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("decimal(18,2)")
    return li.groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(
        F.sum(d("l_quantity")).cast("double").alias("b1"),
        F.sum(d("l_extendedprice")).cast("double").alias("b2"),
        (F.sum(d("l_discount")).cast("double") / F.count("*")).alias("b3"),
        F.count("*").cast("double").alias("b4"),
    )


def bands_to_pixels(cells: DataFrame, bands: int = 4) -> DataFrame:
    """Band columns b1.. to a row per pixel and band."""
    return cells.select("row", "col", F.posexplode(F.array(*[f"b{i + 1}" for i in range(bands)])).alias("i", "value")).select(
        "row", "col", (F.col("i") + 1).alias("band"), "value"
    )


#: A catalogue of rasters that meets every rule of layout, validity and georeferencing at least once.
CATALOG_COLUMNS = (
    "raster_id string, driver string, width int, height int, bands int, bits int, sample_format string, photometric string, planar string, "
    "extra_samples array<string>, compression string, predictor int, tiled boolean, block_x int, block_y int, nodata string, epsg int, "
    "has_affine boolean, has_matrix boolean, has_scale boolean, n_tiepoints int, grid_complete boolean, has_rpc boolean, ghost boolean"
)
_CATALOG = [
    ("striped", "GTiff", 1024, 768, 3, 8, "uint", "rgb", "chunky", "", "deflate", 2, False, 1024, 1, None, 4326, True, False, False, 0, False, False, False),
    ("good_cog", "GTiff", 2048, 2048, 3, 8, "uint", "rgb", "chunky", "", "deflate", 2, True, 512, 512, None, 3857, True, False, False, 0, False, False, True),
    ("tile_48", "GTiff", 960, 960, 1, 16, "uint", "minisblack", "chunky", "", "lzw", 2, True, 48, 48, None, 32632, True, False, False, 0, False, False, True),
    ("tile_100", "GTiff", 1000, 1000, 1, 8, "uint", "minisblack", "chunky", "", "none", 1, True, 100, 100, "0", 4326, True, False, False, 0, False, False, True),
    ("mixed_codec", "GTiff", 2048, 1024, 3, 8, "uint", "rgb", "planar", "", "zstd", 2, True, 256, 256, None, 4326, True, False, False, 0, False, False, True),
    ("not_smaller", "GTiff", 1024, 1024, 3, 8, "uint", "rgb", "chunky", "", "deflate", 1, True, 256, 256, None, 4326, True, False, False, 0, False, False, True),
    ("two_masks", "GTiff", 1024, 1024, 3, 8, "uint", "rgb", "chunky", "", "jpeg", 1, True, 256, 256, None, 4326, True, False, False, 0, False, False, True),
    ("mask_gap", "GTiff", 2048, 2048, 3, 8, "uint", "rgb", "chunky", "", "deflate", 2, True, 512, 512, None, 4326, True, False, False, 0, False, False, True),
    ("masked", "GTiff", 1024, 1024, 3, 8, "uint", "rgb", "chunky", "", "deflate", 2, True, 256, 256, None, 4326, True, False, False, 0, False, False, True),
    ("no_georef", "GTiff", 512, 512, 1, 8, "uint", "palette", "chunky", "", "deflate", 1, True, 256, 256, None, None, False, False, False, 0, False, False, False),
    ("odd_codec", "GTiff", 512, 512, 1, 8, "uint", "minisblack", "chunky", "", "packbits", 1, True, 256, 256, None, None, False, False, False, 5, False, False, False),
    ("rgba", "GTiff", 1024, 512, 4, 8, "uint", "rgb", "chunky", "associatedalpha", "deflate", 2, True, 256, 256, None, 4326, False, True, False, 0, False, False, True),
    ("gray_alpha", "GTiff", 512, 512, 2, 16, "uint", "minisblack", "chunky", "unassociatedalpha", "deflate", 2, True, 256, 256, None, None, False, False, True, 1, False, False, True),
    ("sar", "GTiff", 800, 600, 1, 16, "uint", "minisblack", "chunky", "", "lzw", 2, True, 256, 256, None, None, False, False, False, 4, True, False, True),
    ("dem", "GTiff", 512, 512, 1, 32, "float", "minisblack", "chunky", "", "deflate", 3, True, 256, 256, "-9999", None, False, False, False, 9, True, True, True),
    ("gcp_three", "GTiff", 300, 200, 1, 8, "uint", "minisblack", "chunky", "", "none", 1, False, 300, 8, None, None, False, False, False, 3, False, False, False),
    ("jp2_gray", "JP2OpenJPEG", 512, 512, 1, 8, "uint", "minisblack", "chunky", "", "jpeg2000", 1, True, None, None, None, 4326, True, False, False, 0, False, False, False),
    ("jp2_rgb", "JP2OpenJPEG", 10980, 10980, 3, 8, "uint", "rgb", "chunky", "", "jpeg2000", 1, True, None, None, None, 32633, True, False, False, 0, False, False, False),
    ("cmyk_extra", "GTiff", 256, 256, 6, 8, "uint", "separated", "planar", "unspecified,unassociatedalpha", "lerc", 1, True, 128, 128, None, None, False, False, False, 0, False, False, True),
]
#: (raster_id, directory index, width, height, block, compression, tiled, is_mask): overviews and mask directories.
_LEVELS = [
    ("good_cog", 1, 1024, 1024, 512, "deflate", True, False), ("good_cog", 2, 512, 512, 512, "deflate", True, False),
    ("tile_48", 1, 480, 480, 48, "lzw", True, False), ("tile_100", 1, 500, 500, 100, "none", True, False),
    ("mixed_codec", 1, 1024, 512, 256, "deflate", True, False), ("mixed_codec", 2, 512, 256, 256, "zstd", False, False),
    ("not_smaller", 1, 512, 512, 256, "deflate", True, False), ("not_smaller", 2, 512, 512, 256, "deflate", True, False),
    ("two_masks", 1, 1024, 1024, 256, "deflate", True, True), ("two_masks", 2, 1024, 1024, 256, "deflate", False, True), ("two_masks", 3, 512, 512, 256, "jpeg", True, False),
    ("mask_gap", 1, 2048, 2048, 512, "deflate", True, True), ("mask_gap", 2, 1024, 1024, 512, "deflate", True, False), ("mask_gap", 3, 512, 512, 512, "deflate", True, False), ("mask_gap", 4, 1024, 1024, 512, "deflate", True, True),
    ("masked", 1, 1024, 1024, 256, "deflate", True, True), ("masked", 2, 512, 512, 256, "deflate", True, False), ("masked", 3, 512, 512, 256, "deflate", True, True), ("masked", 4, 256, 256, 256, "deflate", True, False), ("masked", 5, 256, 256, 256, "deflate", True, True),
    ("rgba", 1, 512, 256, 256, "deflate", True, False), ("sar", 1, 400, 300, 256, "lzw", True, False), ("dem", 1, 256, 256, 256, "deflate", True, False),
]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)


def catalog_sql() -> str:
    """The catalogue as VALUES in plain SQL; extra samples as comma-joined text."""
    names = [c.split()[0] for c in CATALOG_COLUMNS.split(", ")]
    rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _CATALOG)
    return f"SELECT * FROM (VALUES {rows}) AS c({', '.join(names)})"


def levels_sql() -> str:
    rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _LEVELS)
    return f"SELECT * FROM (VALUES {rows}) AS l(raster_id, idx, width, height, block, compression, tiled, is_mask)"


def catalog(spark: SparkSession) -> DataFrame:
    return spark.sql(catalog_sql()).withColumn("extra_samples", F.filter(F.split("extra_samples", ","), lambda x: x != ""))


def levels(spark: SparkSession) -> DataFrame:
    return spark.sql(levels_sql())
