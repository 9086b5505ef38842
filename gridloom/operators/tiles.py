"""Tile grids, re-tiling, padding, and the arithmetic of block numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def grid(spark: SparkSession, width: int, height: int, tile: int) -> DataFrame:
    """block_index, tile_row, tile_col, col_off, row_off, cols, rows; row-major, edge tiles clipped."""
    across, down = -(-width // tile), -(-height // tile)
    i = F.col("id")
    g = spark.range(across * down).select(i.alias("block_index"), F.expr(f"id div {across}").alias("tile_row"), (i % across).alias("tile_col"))
    return g.select(
        "*", (F.col("tile_col") * tile).alias("col_off"), (F.col("tile_row") * tile).alias("row_off"),
        F.least(F.lit(tile), width - F.col("tile_col") * tile).alias("cols"), F.least(F.lit(tile), height - F.col("tile_row") * tile).alias("rows"),
    )


def tile_of(pixels: DataFrame, width: int, tile: int) -> DataFrame:
    """Pixels with their tile: block_index, and the position within it."""
    across = -(-width // tile)
    return pixels.select(
        "*", F.expr(f"row div {tile} * {across} + col div {tile}").alias("block_index"), (F.col("row") % tile).alias("in_row"), (F.col("col") % tile).alias("in_col")
    )


def overlap(spark: SparkSession, width: int, height: int, out_tile: int, src_tile: int) -> DataFrame:
    """Which source tiles each output tile needs: the range of tile numbers is computed, exploded, and joined on equality."""
    out = grid(spark, width, height, out_tile)
    src = grid(spark, width, height, src_tile)
    need = (
        out.withColumn("src_row", F.explode(F.sequence(F.expr(f"row_off div {src_tile}"), F.expr(f"(row_off + rows - 1) div {src_tile}"))))
        .withColumn("src_col", F.explode(F.sequence(F.expr(f"col_off div {src_tile}"), F.expr(f"(col_off + cols - 1) div {src_tile}"))))
        .select(F.col("block_index").alias("out_block"), "src_row", "src_col", *[F.col(c).alias(f"o_{c}") for c in ("col_off", "row_off", "cols", "rows")])
    )
    have = src.select(F.col("block_index").alias("src_block"), F.col("tile_row").alias("src_row"), F.col("tile_col").alias("src_col"), "col_off", "row_off", "cols", "rows")
    wide = F.least(F.expr("o_col_off + o_cols"), F.expr("col_off + cols")) - F.greatest("o_col_off", "col_off")
    high = F.least(F.expr("o_row_off + o_rows"), F.expr("row_off + rows")) - F.greatest("o_row_off", "row_off")
    return need.join(have, ["src_row", "src_col"]).select("out_block", "src_block", (wide * high).alias("n_pixels"))


def pad(pixels: DataFrame, width: int, height: int, tile: int, fill: float = 0.0) -> DataFrame:
    """Pixels of a raster whose edge tiles are filled up to whole tiles."""
    full_w, full_h = -(-width // tile) * tile, -(-height // tile) * tile
    spark = pixels.sparkSession
    bands = pixels.select("band").distinct()
    right = spark.range(height).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(width), F.lit(full_w - 1)))) if full_w > width else None
    below = spark.range(height, full_h).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(full_w - 1)))) if full_h > height else None
    out = pixels.select("row", "col", "band", "value")
    for extra in (right, below):
        if extra is not None:
            # The bands of a raster are few: this is a list, not a join of tables that grow.
            out = out.unionByName(extra.join(F.broadcast(bands)).select("row", "col", "band", F.lit(fill).alias("value")))
    return out


def planar_index(band: Column, tile: Column, tiles_per_plane: int) -> Column:
    """Block number in a band-sequential file; bands count from 1."""
    return (band - 1) * tiles_per_plane + tile


def permute_planar(blocks: DataFrame, bands: list[int], tiles_per_plane: int) -> DataFrame:
    """Band selection without decoding: only block numbers change. ``blocks`` has block_index and any payload."""
    old = F.expr(f"block_index div {tiles_per_plane}") + 1
    wanted = F.array(*[F.lit(b) for b in bands])
    places = F.filter(F.transform(wanted, lambda b, i: F.when(b == F.col("band"), i + 1)), lambda x: x.isNotNull())
    numbered = blocks.withColumn("band", old).withColumn("new_band", F.explode(places))
    return numbered.select(
        (F.col("block_index") % tiles_per_plane + (F.col("new_band") - 1) * tiles_per_plane).alias("block_index"),
        F.col("new_band").alias("band"), F.col("block_index").alias("source_block"),
    )


def layer_order(layer: Column, is_mask: Column) -> list[Column]:
    """Order of layers in a masked file: base, base mask, overviews, overview masks."""
    return [(layer > 0).cast("int"), is_mask.cast("int"), layer]


def blocks(pixels: DataFrame, width: int, height: int, size: int, bands: int = 1, dtype: str = "float64") -> DataFrame:
    """Tiles (row_off, col_off, rows, cols, bands, dtype, data) of pixels (row, col, band, value): what a writer takes.

    Samples that are missing or null are 0. A tile's pixels meet in one task; a tile without any pixel has none.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        r, c = int(pdf["row"].iloc[0]) // size * size, int(pdf["col"].iloc[0]) // size * size
        kind = dtype.rstrip("0123456789")
        a = np.zeros((min(size, height - r), min(size, width - c), bands), {"uint": "u", "int": "i", "float": "f"}[kind] + str(int(dtype.removeprefix(kind)) // 8))
        have = pdf[pdf["value"].notna()]
        a[have["row"] - r, have["col"] - c, have["band"] - 1] = have["value"]
        return pd.DataFrame([{"row_off": r, "col_off": c, "rows": a.shape[0], "cols": a.shape[1], "bands": bands, "dtype": dtype, "data": a.tobytes()}])

    tile = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("band").cast("int"), F.col("value").cast("double"))
    tile = tile.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return tile.groupBy(F.floor(F.col("row") / size).alias("_r"), F.floor(F.col("col") / size).alias("_c")).applyInPandas(run, "row_off int, col_off int, rows int, cols int, bands int, dtype string, data binary")


def samples(blocks: DataFrame, size: int) -> DataFrame:
    """Pixels (layer, row, col, band, value) of decoded chunky blocks as the data source gives them, without their filling."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for b in pdf.itertuples():
                kind = b.dtype.rstrip("0123456789")
                a = np.frombuffer(b.data, "<" + {"uint": "u", "int": "i", "float": "f"}[kind] + str(int(b.dtype.removeprefix(kind)) // 8)).reshape(size, size, -1)[: b.rows, : b.cols]
                row, col, band = np.indices(a.shape)
                yield pd.DataFrame({"layer": b.layer, "row": row.ravel() + b.row_off, "col": col.ravel() + b.col_off, "band": band.ravel() + 1, "value": a.ravel().astype(float)})

    return blocks.select("layer", "row_off", "col_off", "rows", "cols", "dtype", "data").mapInPandas(run, "layer int, row long, col long, band int, value double")
