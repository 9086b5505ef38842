"""Band selection and reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def check(bands: list[int], count: int) -> list[int]:
    """Bands count from 1 and may repeat."""
    if not bands:
        raise ValueError("no band is named")
    for b in bands:
        if not 1 <= b <= count:
            raise ValueError(f"band {b} is not among 1 to {count}")
    return list(bands)


def is_identity(bands: list[int] | None, count: int) -> bool:
    return bands is None or list(bands) == list(range(1, count + 1))


def select(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """Pixels of the bands named, renumbered in that order; a band named twice comes twice."""
    places: dict[int, list[int]] = {}
    for new, old in enumerate(bands, 1):
        places.setdefault(old, []).append(new)
    if all(len(v) == 1 for v in places.values()):
        number = F.create_map(*[F.lit(x) for old, new in places.items() for x in (old, new[0])])
        return pixels.where(F.col("band").isin(list(places))).withColumn("band", number[F.col("band")])
    number = F.create_map(*[x for old, new in places.items() for x in (F.lit(old), F.array(*[F.lit(n) for n in new]))])
    return pixels.where(F.col("band").isin(list(places))).withColumn("band", F.explode(number[F.col("band")]))


def select_schema(catalog: DataFrame, bands: list[int]) -> DataFrame:
    """What a selection does to the catalogue row: three bands are RGB, and alpha stays only if its band does."""
    alpha = F.when(F.col("alpha_band").isNotNull(), F.array_contains(F.array(*[F.lit(b) for b in bands]), F.col("alpha_band"))).otherwise(False)
    return catalog.withColumns({
        "photometric": F.when(F.lit(len(bands) == 3), "rgb").when(F.lit(len(bands) == 1), F.when(F.col("photometric") == "rgb", "minisblack").otherwise(F.col("photometric"))).otherwise(F.col("photometric")),
        "extra_samples": F.when(alpha, F.col("extra_samples")).otherwise(F.array().cast("array<string>")),
        "bands": F.lit(len(bands)),
    })
