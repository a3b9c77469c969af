"""Curated picks: the same day in other years, days around it, themes, rediscovery."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.filters import sample_by_hash


def same_day(items: DataFrame, today: date, around: int = 0) -> DataFrame:
    """Items taken on this day of the year, or up to ``around`` days from it, in earlier years. A day that a year lacks is the last one of its month."""
    day = F.col("taken_at").cast("date")
    of_year = F.when((today.month == 2) & (F.lit(today.day) == 29), F.last_day(F.make_date(F.year(day), F.lit(2), F.lit(1)))).otherwise(F.make_date(F.year(day), F.lit(today.month), F.lit(min(today.day, 28) if today.month == 2 else today.day)))
    gap = F.abs(F.datediff(day, of_year))
    return items.where((F.year(day) < today.year) & (F.least(gap, F.lit(365) - gap) <= around))


def by_theme(links: DataFrame, seed: int, least: int = 4) -> DataFrame:
    """``item`` of one tag with ``least`` items or more; the seed chooses the tag."""
    tags = links.groupBy("tag").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= least)
    one = sample_by_hash(tags, "tag", 1, seed).select("tag")
    return links.join(F.broadcast(one), "tag", "left_semi").select("item").distinct()


def rediscover(items: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    """Items least looked at: never viewed first, then by views, longest unseen (never first), id. ``stats``: ``item, views, last_viewed``."""
    j = items.join(stats, "item", "left").withColumn("views", F.coalesce("views", F.lit(0)))
    return j.orderBy(F.when(F.col("views") == 0, 0).otherwise(1), "views", F.asc_nulls_first("last_viewed"), "item").limit(limit)


def first_filled(*choices: DataFrame, least: int = 2) -> tuple[int, DataFrame]:
    """The first of several picks that has ``least`` rows, and its place; else the last one. Only so many rows of each are counted."""
    for i, df in enumerate(choices[:-1]):
        if len(df.head(least)) >= least:
            return i, df
    return len(choices) - 1, choices[-1]


def album(items: DataFrame, members: DataFrame) -> DataFrame:
    """An album's items by their place, then the newest first."""
    return items.join(members, "item").orderBy(F.asc_nulls_last("place"), F.desc("taken_at"), "item")
