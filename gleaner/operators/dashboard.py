"""Aggregates of a dashboard: profiles, histograms, series, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The standard aperture stops that measured ones snap to.
STOPS = (1, 1.1, 1.2, 1.4, 1.6, 1.8, 2, 2.2, 2.5, 2.8, 3.2, 3.5, 4, 4.5, 5, 5.6, 6.3, 7.1, 8, 9, 10, 11, 13, 14, 16, 18, 20, 22, 25, 29, 32)


def completeness(df: DataFrame, columns: Sequence[str], total: Column | None = None) -> DataFrame:
    """``total`` and, for each column, how many rows miss it (null or blank), all in one pass.

    With ``total`` (rows of the table that details belong to) the rows without details are missing too.
    """
    kinds = dict(df.dtypes)
    blank = {c: F.col(c).isNull() | (F.trim(c) == "") if kinds[c] == "string" else F.col(c).isNull() for c in columns}
    counts = [F.count_if(cond).alias(f"missing_{c}") for c, cond in blank.items()]
    return df.agg(F.count("*").alias("total") if total is None else total.alias("total"), *counts)


def buckets(value: Column, edges: Sequence[tuple[str, float | None]]) -> Column:
    """The label of the first bucket whose upper end (inclusive; None: open) holds the value; null stays null."""
    out = F.lit(None).cast("string")
    for label, top in reversed(edges):
        out = F.when(value.isNotNull() if top is None else value <= top, F.lit(label)).otherwise(out)
    return out


def bucket_counts(df: DataFrame, value: Column, edges: Sequence[tuple[str, float | None]]) -> DataFrame:
    """``bucket, n`` for every bucket, empty ones too: conditional counts in one pass, then unpivoted."""
    label = buckets(value, edges)
    wide = df.select(label.alias("b")).agg(*(F.count_if(F.col("b") == name).alias(name) for name, _ in edges))
    return wide.unpivot([], [f"`{name}`" for name, _ in edges], "bucket", "n")


def dense_hours(df: DataFrame, ts: Column) -> DataFrame:
    """``hour, n`` for all 24 hours."""
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = df.where(ts.isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def series(df: DataFrame, ts: Column, fmt: str) -> DataFrame:
    """``period, n`` by a date pattern."""
    return df.where(ts.isNotNull()).groupBy(F.date_format(ts, fmt).alias("period")).agg(F.count("*").alias("n"))


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, value, n`` over many categorical columns in one pass; nulls and blanks are left out."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "field", "value")
    return long.where("value is not null and trim(value) <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def coverage(covered: Column, total: Column) -> Column:
    """Whole percent, 0 where the total is not positive."""
    return F.when(total > 0, F.floor(100 * covered / total + 0.5)).otherwise(0).cast("long")


def snap(value: Column, stops: Sequence[float] = STOPS, tolerance: float = 0.06) -> Column:
    """The nearest standard stop if it is within ``tolerance`` times the value, else the value itself. Of two as near the smaller wins."""
    options = F.array(*(F.struct(F.abs(value - s).alias("d"), F.lit(float(s)).alias("s")) for s in stops))
    best = F.array_min(options)
    return F.when(best["d"] <= value * tolerance, best["s"]).otherwise(value)


def top_then_by_value(df: DataFrame, value: str, count: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, by value."""
    return df.orderBy(F.desc(count), value).limit(k).orderBy(value)


def years_with_gaps(counts: DataFrame, year: str = "year", n: str = "n") -> DataFrame:
    """``first, last, n``: years that have rows, and each run of years without as one row with 0."""
    w = W.orderBy("first")
    rows = counts.select(F.col(year).cast("int").alias("first"), F.col(year).cast("int").alias("last"), F.col(n).alias("n")).where("n > 0")
    before = rows.withColumn("prev", F.lag("last").over(w)).where("first > prev + 1")  # one row a year: a short table
    gaps = before.select((F.col("prev") + 1).alias("first"), (F.col("first") - 1).alias("last"), F.lit(0).cast("long").alias("n"))
    return rows.unionByName(gaps)


def heat_map(df: DataFrame, day: Column, last_day: str, days: int = 365) -> DataFrame:
    """``day, n, level`` for each of the days up to ``last_day``: level is 0 for none, else ceil(4 n / the largest)."""
    span = df.sparkSession.range(days).select(F.date_sub(F.lit(last_day).cast("date"), F.col("id").cast("int")).alias("day"))
    counts = df.groupBy(day.cast("date").alias("day")).agg(F.count("*").alias("n"))
    dense = span.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    top = dense.agg(F.max("n").alias("top"))
    return dense.crossJoin(F.broadcast(top)).select("day", "n", F.when(F.col("n") > 0, F.ceil(4 * F.col("n") / F.col("top"))).otherwise(0).cast("int").alias("level"))


def guidance(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, place, rule, value`` rows that each profile (``focal, aperture, iso, coverage``: the most frequent focal length and aperture, the mean ISO, the
    whole percent of items with full metadata) gives rise to, in fixed order: one of the focal length where there is one, one of a
    wide or a narrow aperture, one of a high ISO, one of a low coverage."""
    focal, aperture, iso, coverage = (F.col(c) for c in ("focal", "aperture", "iso", "coverage"))
    rules = [
        (1, F.when(focal <= 35, "wideAngle").when(focal >= 85, "telephoto").when(focal.isNotNull(), "standardFocal"), focal),
        (2, F.when((aperture > 0) & (aperture <= 2.8), "wideAperture").when(aperture >= 8, "deepFocus"), aperture),
        (3, F.when(iso >= 1600, "highIso"), F.floor(iso + 0.5)),
        (4, F.when(coverage < 50, "lowMetadataCoverage"), coverage),
    ]
    found = F.array(*(F.struct(F.lit(i).alias("place"), rule.alias("rule"), value.cast("double").alias("value")) for i, rule, value in rules))
    return profile.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*").where("rule is not null")
