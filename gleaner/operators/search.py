"""Searches put together: one builder for the shapes that a query may take, and a quick look-up."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.colour import NEAR, colour_score, hex_to_rgb, palette_distance
from gleaner.functions.dates import split_query
from gleaner.operators import ranking
from gleaner.operators.filters import between, name_matches
from gleaner.operators.metric import nearest_hashes
from gleaner.operators.similarity import knn
from gleaner.operators.tags import tag_evidence
from gleaner.session import materialise


@dataclass
class Request:
    """What is searched: text, colour, ranges of detail columns (inclusive), and the evidence that vectors gave (``item, prompt, grp, weight, rank, similarity``)."""

    text: str = ""
    colour: str | None = None
    ranges: dict[str, tuple] = field(default_factory=dict)
    semantic: DataFrame | None = None
    intent: str = "unknown"


def quick(items: DataFrame, links: DataFrame, query: str, key: str, columns: Sequence[str], limit: int = 12) -> DataFrame:
    """``key, source``: items by trusted tag (source 0), then by name prefix (1); at most ``limit``, which is what a quick look-up shows.

    ``items`` are live ones; ``links``: ``key, name, trusted``. Where no name has the prefixes, names that contain the query count.
    """
    by_tag = links.where(F.col("trusted") & F.contains(F.lower("name"), F.lit(query.lower()))).join(items.select(key), key, "left_semi").select(key).distinct()
    by_name = ranking.prefix_search(items, query.split(), key, columns)
    if not by_name.head(1):
        by_name = items.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))).select(key)
    return ranking.with_precedence(by_tag, by_name, key=key, limit=limit)


def by_item(queries: DataFrame, items: DataFrame, bits: int = 4, k: int = 20) -> DataFrame:
    """``query, item, stage, score``: what looks like each query: items whose hash differs in up to ``bits`` bits (stage 0, score 64 less the bits), and only for
    queries that have none the ``k`` nearest by vector (stage 1, score the cosine). Both: ``id, hash, v``.
    """
    same = materialise(nearest_hashes(queries, items, radius=bits), "same-by-hash").select("query", "item", F.lit(0).alias("stage"), (64 - F.col("distance")).cast("double").alias("score"))
    rest = queries.join(same.select(F.col("query").alias("id")), "id", "left_anti")
    return same.unionByName(knn(rest, items, k).select("query", "item", F.lit(1).alias("stage"), F.col("similarity").alias("score")))


def compound(items: DataFrame, links: DataFrame, request: Request, today: date) -> DataFrame:
    """``item, score`` of live items, by the first of four shapes that the request has: a colour, a glob, text, or filters alone.

    A date phrase in the text becomes a range of ``taken_at`` and leaves the text. ``items``: ``item, name, taken_at, deleted_at`` and what the request names
    (``palette`` for colours); ``links``: ``item, name, trusted, confidence``. All shapes apply the ranges before anything is ranked. Filters alone
    give the newest first by their day number.
    """
    text, days = split_query(request.text.strip(), today)
    live = items.where("deleted_at is null")
    for name, (low, high) in request.ranges.items():
        live = live.where(between(F.col(name), low, high))
    if days:
        live = live.where(between(F.col("taken_at").cast("date"), F.lit(str(days[0])).cast("date"), F.lit(str(days[1])).cast("date")))
    if request.colour:
        squared = palette_distance(hex_to_rgb(F.lit(request.colour)), F.col("palette"))
        return live.select("item", squared.alias("d")).where(F.col("d") < NEAR).select("item", colour_score(F.col("d")).alias("score"))
    if re.search(r"[*?\[]", text):
        return live.where(name_matches(F.col("name"), text)).select("item", F.lit(1.0).alias("score"))
    if text:
        return _hybrid(live, links, text, request)
    return live.select("item", F.datediff("taken_at", F.lit("1970-01-01").cast("date")).cast("double").alias("score"))


def _hybrid(live: DataFrame, links: DataFrame, text: str, request: Request) -> DataFrame:
    names = ranking.prefix_search(live, text.split(), "item", ["name"]).select("item", F.lit("filename").alias("source"), F.lit(False).alias("exact"))
    if request.semantic is None:
        exact = tag_evidence(links, text, live.select("item").limit(0)).join(live.select("item"), "item", "left_semi").unionByName(names)
        weight: Column = ranking.exact_weight(F.col("source"), F.col("exact"))
        return exact.groupBy("item").agg(F.max(weight).alias("score"))
    fused = ranking.relevant(ranking.fuse(request.semantic.join(live.select("item"), "item", "left_semi")), request.intent)
    exact = tag_evidence(links, text, fused.select("item")).join(live.select("item"), "item", "left_semi").unionByName(names)
    tags = links.where(F.contains(F.lower("name"), F.lit(text.lower()))).select("item", "trusted", "confidence")
    return ranking.gated_fusion(fused, exact, tags, request.intent).select("item", F.col("rank_score").alias("score"))
