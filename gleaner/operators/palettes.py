"""Colours of a whole collection: a merged palette, counts by hue and by saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.colour import NEAR, distance_squared
from gleaner.session import materialise

MERGE = 625  # squared RGB distance below which two colours of a palette are one
VIVID, MODERATE = 0.6, 0.25


def merged_palette(colours: DataFrame, size: int = 25, batch: int = 1000) -> DataFrame:
    """``r, g, b, n, weight``: the most frequent colours of which no two are near, with weights that sum to 1.

    ``colours``: ``r, g, b`` with one row for each use. Colours are taken by frequency (ties: the smaller r, g, b) unless near a taken one. The driver
    sees ``batch`` distinct colours at a time; if these do not fill the palette, the next are those of the rest that are not near a taken one.
    """
    counts = materialise(colours.groupBy("r", "g", "b").agg(F.count("*").alias("n")), "palette-counts")
    chosen: list = []
    while True:
        far = F.lit(True)
        for c in chosen:
            far &= distance_squared(F.struct("r", "g", "b"), F.struct(*(F.lit(v).alias(k) for k, v in zip("rgb", c[:3], strict=True)))) >= MERGE
        found = counts.where(far).orderBy(F.desc("n"), "r", "g", "b").limit(batch).collect()
        for c in map(tuple, found):
            if len(chosen) < size and all(sum((x - y) ** 2 for x, y in zip(c[:3], o[:3], strict=True)) >= MERGE for o in chosen):
                chosen.append(c)
        if len(chosen) >= size or len(found) < batch:
            break
    total = sum(c[3] for c in chosen) or 1
    return colours.sparkSession.createDataFrame([(*c, c[3] / total) for c in chosen], "r int, g int, b int, n long, weight double")


def pure_hue(hue: float) -> tuple[int, int, int]:
    """The full colour of a hue in degrees."""
    x = 1 - abs(hue / 60 % 2 - 1)
    parts = [(1, x, 0), (x, 1, 0), (0, 1, x), (0, x, 1), (x, 0, 1), (1, 0, x)][int(hue // 60) % 6]
    return tuple(int(255 * p + 0.5) for p in parts)


def hue_counts(items: DataFrame, palette: str, buckets: int = 12) -> DataFrame:
    """``bucket, n``: items with a colour near the middle of each hue bucket. ``palette``: an array of structs with ``r, g, b``."""
    step = 360 / buckets

    def near(b: int) -> Column:
        target = F.struct(*(F.lit(v).alias(k) for k, v in zip("rgb", pure_hue(b * step + step / 2), strict=True)))
        return F.coalesce(F.exists(palette, lambda p: distance_squared(p, target) < NEAR), F.lit(False))

    wide = items.agg(*(F.count_if(near(b)).alias(str(b)) for b in range(buckets)))
    return wide.unpivot([], [f"`{b}`" for b in range(buckets)], "bucket", "n").select(F.col("bucket").cast("int").alias("bucket"), "n")


def saturation_counts(items: DataFrame, palette: str) -> DataFrame:
    """``vivid, moderate, muted``: items with any colour of that saturation (0 to 1); an item may count in several."""
    has = lambda cond: F.count_if(F.coalesce(F.exists(palette, cond), F.lit(False)))
    return items.agg(
        has(lambda p: p["saturation"] >= VIVID).alias("vivid"),
        has(lambda p: (p["saturation"] >= MODERATE) & (p["saturation"] < VIVID)).alias("moderate"),
        has(lambda p: p["saturation"] < MODERATE).alias("muted"),
    )
