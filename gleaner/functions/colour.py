"""Colour expressions: hex, RGB, HSL, distance to palettes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEAR = 10_000  # squared RGB distance below which colours count as alike
NO_COLOUR = 1.7976931348623157e308  # for a palette that is missing


def hex_to_rgb(text: Column) -> Column:
    """``r, g, b`` of three or six hex digits, with or without ``#``; else null."""
    h = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    long = F.when(h.rlike("^[0-9a-f]{3}$"), F.regexp_replace(h, "(.)", "$1$1")).when(h.rlike("^[0-9a-f]{6}$"), h)
    part = lambda at: F.conv(F.substring(long, at, 2), 16, 10).cast("int")
    return F.when(long.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """Hue in whole degrees, saturation and lightness in whole percent."""
    r, g, b = (x / 255.0 for x in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    spread, light = high - low, (high + low) / 2
    hue = F.when(spread == 0, 0.0).when(high == r, ((g - b) / spread + 6) % 6).when(high == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4) * 60
    saturation = F.when(spread == 0, 0.0).otherwise(spread / (1 - F.abs(2 * light - 1)))
    whole = lambda x: F.floor(x + 0.5).cast("int")
    return F.struct((whole(hue) % 360).alias("hue"), whole(saturation * 100).alias("saturation"), whole(light * 100).alias("lightness"))


def distance_squared(a: Column, b: Column) -> Column:
    return (a["r"] - b["r"]) * (a["r"] - b["r"]) + (a["g"] - b["g"]) * (a["g"] - b["g"]) + (a["b"] - b["b"]) * (a["b"] - b["b"])


def palette_distance(colour: Column, palette: Column) -> Column:
    """The smallest squared distance of a colour to a palette; a very large number for a null or empty one."""
    least = F.array_min(F.transform(palette, lambda p: distance_squared(colour, p).cast("double")))
    return F.coalesce(least, F.lit(NO_COLOUR))


def colour_score(squared: Column) -> Column:
    """1 for the same colour down to 0 at a distance of 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(squared) / 100))


def hue_bucket(hue: Column) -> Column:
    """One of 36 buckets of ten degrees."""
    return (F.floor(hue / 10) % 36).cast("int")
