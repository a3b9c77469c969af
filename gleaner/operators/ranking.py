"""Ranked evidence: reciprocal rank fusion, penalties, cutoffs, gated hybrid fusion, margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.functions.vector import four_decimals

RRF = 60
PENALTY = 0.25
SEMANTIC_SHARE, TAG_SHARE = 0.7, 0.3
AUTO_LEAST, AUTO_RESCUE = 0.55, 0.75
# Weight of exact evidence by source, for whole and partial matches.
SOURCE_WEIGHTS = {"person": (1.5, 1.2), "tag": (1.25, 1.0), "filename": (0.8, 0.8), "autoTag": (0.25, 0.25)}
# Base, ratio to the top, support floor and ratio by intent.
INTENTS = {"object": (0.055, 0.6, None, None), "composed": (0.045, 0.5, 0.04, 0.9), "scene": (0.035, 0.4, 0.03, 0.85), "unknown": (0.05, 0.55, None, None)}


def ranked(df: DataFrame, by: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add a rank from 0 within ``by``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)


def fuse(evidence: DataFrame, primary: int = 0) -> DataFrame:
    """``item, rank_score, similarity, primary_similarity, n_groups, has_whole``: reciprocal rank fusion of several ranked lists.

    ``evidence``: ``item, prompt, grp, weight, rank, similarity`` (rank from 0). An item's score is the sum over evidence groups of its
    best weight / (60 + rank + 1); several prompts of one group count once. Two grouped sums, no window.
    """
    worth = F.col("weight") / (RRF + F.col("rank") + 1)
    each = evidence.groupBy("item", "grp").agg(
        F.max(worth).alias("score"), F.max("similarity").alias("similarity"), F.max(F.when(F.col("prompt") == primary, F.col("similarity"))).alias("own")
    )
    return each.groupBy("item").agg(
        F.sum("score").alias("rank_score"),
        four_decimals(F.max("similarity")).alias("similarity"),
        four_decimals(F.coalesce(F.max("own"), F.max("similarity"))).alias("primary_similarity"),
        F.count("*").alias("n_groups"),
        F.bool_or(F.col("grp") == "whole-query").alias("has_whole"),
    )


def penalise(positive: DataFrame, negative: DataFrame, weight: float = PENALTY) -> DataFrame:
    """Lower scores of items that negative prompts find: by a share of their best negative rank score and similarity. ``negative``: ``item, rank, similarity``."""
    best = negative.groupBy("item").agg(F.max(1 / (RRF + F.col("rank") + 1)).alias("ns"), F.greatest(F.max("similarity"), F.lit(0.0)).alias("nv"))
    joined = positive.join(best, "item", "left")
    less = lambda c: four_decimals(F.greatest(F.lit(0.0), F.col(c) - weight * F.coalesce("nv", F.lit(0.0)))).alias(c)
    rest = [c for c in positive.columns if c not in ("item", "rank_score", "similarity", "primary_similarity")]
    return joined.select("item", (F.col("rank_score") - weight * F.coalesce("ns", F.lit(0.0))).alias("rank_score"), less("similarity"), less("primary_similarity"), *rest)


def gap_cutoff(scores: DataFrame, score: str, top: int = 100) -> DataFrame:
    """``cutoff``, one row: the middle of the largest gap from the fifth score on among the ``top`` highest.

    Null with fewer than six scores, or where the gap is below 0.006 or 12 % of the span. Only ``top`` rows reach the window.
    """
    w = W.orderBy("i")
    best = scores.where(F.col(score).isNotNull()).select(F.col(score).alias("s")).orderBy(F.desc("s")).limit(top)
    packed = best.agg(F.sort_array(F.collect_list("s"), asc=False).alias("a"))
    gaps = packed.select("a", F.posexplode_outer("a").alias("i", "s")).withColumn("next", F.lead("s").over(w))
    found = gaps.where("i >= 4 and next is not null").groupBy("a").agg(F.max_by(F.struct((F.col("s") - F.col("next")).alias("gap"), ((F.col("s") + F.col("next")) / 2).alias("cut")), F.struct(F.col("s") - F.col("next"), -F.col("i"))).alias("g"))
    span = F.element_at("a", 1) - F.element_at("a", -1)
    kept = found.select(F.when((F.size("a") >= 6) & (F.col("g.gap") >= 0.006) & (F.col("g.gap") >= span * 0.12), F.col("g.cut")).alias("cutoff"))
    return kept.agg(F.max("cutoff").alias("cutoff"))


def relevant(fused: DataFrame, intent: str = "unknown", sensitivity: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Add ``strong_cutoff, support_cutoff, strong, accepted``: what passes by the intent's base, its ratio to the top, the score gap and the user's floor.

    Intents with a support floor also accept items that the whole query and another group support at a lower cutoff.
    """
    base, ratio, support_floor, support_ratio = INTENTS[intent]
    top = fused.agg(F.max("primary_similarity").alias("top"))
    gap = gap_cutoff(fused, "primary_similarity") if intent in ("object", "unknown") else fused.agg(F.lit(None).cast("double").alias("cutoff"))
    strong = F.greatest(F.lit(base * sensitivity), F.col("top") * ratio * sensitivity, F.coalesce("cutoff", F.lit(0.0)) * sensitivity, F.lit(floor))
    limits = top.crossJoin(gap).select(strong.alias("strong_cutoff"))  # one row each
    if support_floor is None:
        consensus, support = F.col("strong_cutoff"), F.greatest(F.lit(0.045 * sensitivity), F.col("strong_cutoff") * 0.85)
    else:
        consensus = F.greatest(F.lit(support_floor * sensitivity), F.col("strong_cutoff") * support_ratio, F.lit(floor))
        support = consensus
    own = F.col("primary_similarity")
    is_strong = own >= F.col("strong_cutoff")
    backed = F.lit(support_floor is not None) & (own >= consensus) & F.col("has_whole") & (F.col("n_groups") >= 2)
    return fused.crossJoin(F.broadcast(limits)).withColumns({"support_cutoff": support, "strong": is_strong, "accepted": is_strong | backed})


def relevant_by_consensus(fused: DataFrame, least: float, ratio: float, candidate_least: float, consensus_ratio: float, groups: int, floor: float = 0.0) -> DataFrame:
    """Add ``accepted``: above an absolute and a relative cutoff, or above a lower one with support of two groups."""
    top = fused.agg(F.max("similarity").alias("top"))
    strong = F.greatest(F.lit(least), F.col("top") * ratio, F.lit(floor))
    consensus = F.greatest(F.lit(candidate_least), strong * consensus_ratio, F.lit(floor))
    ok = (F.col("similarity") >= strong) | (F.lit(groups > 1) & (F.col("n_groups") >= 2) & (F.col("similarity") >= consensus))
    return fused.crossJoin(F.broadcast(top)).withColumn("accepted", ok).drop("top")


def auto_strength(confidence: Column) -> Column:
    """0.5 at a confidence of 0.55 up to 1 at 0.95, to four decimals."""
    return four_decimals(0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (confidence - AUTO_LEAST) / 0.4)))


def exact_weight(source: Column, exact: Column) -> Column:
    out = F.lit(0.0)
    for name, (whole, part) in SOURCE_WEIGHTS.items():
        out = F.when(source == name, F.when(exact, whole).otherwise(part)).otherwise(out)
    return out


def gated_fusion(semantic: DataFrame, exact: DataFrame, tags: DataFrame, intent: str = "unknown", prompt_groups: int = 1) -> DataFrame:
    """``item, rank_score, similarity, exact, rescued, tag_support`` of the items let in, with ``place``.

    Let in are items with exact evidence, strong ones, and ones above the support cutoff that a reliable tag rescues. The score is
    0.7 of the semantic similarity within this query's range, 0.3 of the tag's strength, and the best exact weight.
    ``semantic``: the result of ``relevant``; ``exact``: ``item, source, exact``; ``tags``: ``item, trusted, confidence``.
    """
    t = tags.groupBy("item").agg(
        F.bool_or("trusted").alias("trusted"),
        F.max(F.when(~F.col("trusted") & (F.col("confidence") >= AUTO_LEAST), F.col("confidence"))).alias("auto"),
    )
    e = exact.join(t.select("item", "trusted"), "item", "left").groupBy("item").agg(
        F.bool_or((F.col("source") != "autoTag") & ((F.col("source") != "tag") | (F.col("exact") & F.coalesce("trusted", F.lit(False))))).alias("independent"),
        F.bool_or("exact").alias("exact"),
        F.bool_or(F.col("exact") & F.col("source").isin("tag", "person")).alias("first"),
        F.max(exact_weight(F.col("source"), F.col("exact"))).alias("bonus"),
    )
    s = semantic.withColumn("has", F.lit(True))
    limits = semantic.agg(F.max("primary_similarity").alias("top"), F.max("support_cutoff").alias("support"))
    j = s.join(e, "item", "full").join(t, "item", "left").crossJoin(F.broadcast(limits))
    own = F.coalesce("primary_similarity", F.lit(0.0))
    has = F.coalesce("has", F.lit(False))
    strong = has & F.coalesce(F.col("strong") | F.col("accepted"), F.lit(False))
    trusted, auto = F.coalesce("trusted", F.lit(False)), F.coalesce("auto", F.lit(0.0))
    covered = F.lit(intent != "composed") | (F.coalesce("has_whole", F.lit(False)) & (F.coalesce("n_groups", F.lit(0)) >= max(2, prompt_groups)))
    rescued = has & ~strong & (own >= F.col("support")) & (trusted | (auto >= AUTO_RESCUE)) & covered
    support = F.when(trusted, 1.0).when(auto >= AUTO_LEAST, auto_strength(auto)).otherwise(0.0)
    span = F.greatest(F.lit(0.0001), F.col("top") - F.col("support"))
    normal = F.when(has, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (own - F.col("support")) / span))).otherwise(0.0)
    independent = F.coalesce("independent", F.lit(False))
    out = j.where(independent | strong | rescued).select(
        "item",
        (SEMANTIC_SHARE * normal + TAG_SHARE * support + F.coalesce("bonus", F.lit(0.0))).alias("rank_score"),
        F.coalesce("similarity", F.when(independent, 1.0).otherwise(0.0)).alias("similarity"),
        F.coalesce("exact", F.lit(False)).alias("exact"),
        rescued.alias("rescued"),
        support.alias("tag_support"),
        F.coalesce("first", F.lit(False)).alias("first"),
        F.coalesce("has_whole", F.lit(False)).alias("whole"),
        F.coalesce("n_groups", F.lit(0)).alias("groups"),
        own.alias("own"),
    )
    order = [F.desc("first"), F.desc("rank_score"), F.desc("whole"), F.desc("groups"), F.desc("own"), F.asc("item")]
    return out.withColumn("order_key", F.array(*(F.col(c).cast("double") for c in ("first", "rank_score", "whole", "groups", "own")))).orderBy(*order)


def hybrid_fusion(semantic: DataFrame, exact: DataFrame) -> DataFrame:
    """``item, rank_score, exact, similarity`` by weighted rank fusion. ``semantic``: ``item, rank, similarity``; ``exact``: ``item, source, exact`` (repeats count once)."""
    a = semantic.select("item", (1.0 / (RRF + F.col("rank") + 1)).alias("score"), "similarity", F.lit(False).alias("exact"))
    b = exact.distinct().select("item", (exact_weight(F.col("source"), F.col("exact")) / (RRF + 1)).alias("score"), F.lit(None).cast("double").alias("similarity"), "exact")
    both = a.unionByName(b).groupBy("item").agg(F.sum("score").alias("rank_score"), F.bool_or("exact").alias("exact"), F.max("similarity").alias("best"))
    top = both.agg(F.max("rank_score").alias("top"))
    shown = F.when(F.coalesce("best", F.lit(0.0)) != 0, F.col("best")).when(F.col("exact"), 1.0).otherwise(F.col("rank_score") / F.col("top"))
    return both.crossJoin(F.broadcast(top)).select("item", "rank_score", "exact", four_decimals(shown).alias("similarity"))


def best_with_margin(df: DataFrame, item: str, tag: str, score: str, margin: float = 0.01, per_tag: int | None = 500, alone: bool = True) -> DataFrame:
    """``item, tag, score``: each item's best tag unless the second is within ``margin``; then each tag's ``per_tag`` best items (None: all). An item's only tag counts if ``alone``."""
    s, t = F.col(score), F.col(tag)
    top = df.groupBy(F.col(item).alias("item"), t.alias("tag")).agg(F.max(s).alias("score"))
    w = W.partitionBy("item").orderBy(F.desc("score"), "tag")
    two = top.select("*", F.row_number().over(w).alias("n"), F.lead("score").over(w).alias("second")).where("n = 1")
    clear = two.where((F.lit(alone) & F.col("second").isNull()) | (F.col("score") - F.col("second") >= margin)).select("item", "tag", "score")
    if per_tag is None:
        return clear
    place = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("score"), "item"))
    return clear.withColumn("n", place).where(F.col("n") <= per_tag).drop("n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def with_precedence(*sources: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Union in which an item is taken from the first source that has it; rows keep ``source`` (from 0). Sources have the same columns."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    first = every.groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c != key]), "source").alias("s")).select(key, "s.*")
    return first if limit is None else first.orderBy("source", key).limit(limit)


def select_tags(scores: DataFrame, item: str, least_top: float, from_top: float, most: int = 5) -> DataFrame:
    """``item, tag, similarity``: tags close to the item's best one, if that is good enough; ``least`` is each tag's own minimum (null: ``least_top``)."""
    w = W.partitionBy(item)
    s = scores.where(F.col("similarity").isNotNull() & ~F.isnan("similarity")).withColumn("top", F.max("similarity").over(w))
    ok = s.where((F.col("top") >= least_top) & (F.col("similarity") >= F.greatest(F.col("top") - from_top, F.lit(least_top))) & (F.col("similarity") >= F.coalesce("least", F.lit(least_top))))
    return first_per_key(ok, [item], [F.desc("similarity"), F.asc("tag")], most).select(item, "tag", "similarity")


def time_decay(similarity: Column, age_days: Column, alpha: float = 0.1, half_life: float = 365.0) -> Column:
    """A score raised for recent items: by ``alpha`` at age 0, half of that after each half life; unknown ages add nothing."""
    return similarity * (1 + alpha * F.coalesce(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life), F.lit(0.0)))


def temporal_boost(similarity: Column, ts: Column, start, stop, factor: float = 1.2) -> Column:
    return similarity * F.when((ts >= F.lit(start)) & (ts <= F.lit(stop)), factor).otherwise(1.0)


def prefix_search(items: DataFrame, terms: Sequence[str], key: str, columns: Sequence[str]) -> DataFrame:
    """``key`` of rows in whose columns every term begins some token (letters and digits, without case)."""
    terms = [t.lower() for t in terms]
    text = F.lower(F.concat_ws(" ", *(F.col(c) for c in columns)))
    tokens = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    cond = F.lit(bool(terms))
    begun = lambda term: F.exists(tokens, lambda t: F.startswith(t, F.lit(term)))
    for term in terms:
        cond &= begun(term)
    return items.where(cond).select(key)


def relative_to_top(df: DataFrame, value: str, group: str) -> DataFrame:
    """Add ``relative``: a value over the largest one of its group. Only the groups' maxima meet; rows stay where they are where Spark can broadcast these."""
    top = df.groupBy(F.col(group).alias("__g")).agg(F.max(value).alias("__top"))
    return df.join(top, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("relative", F.col(value) / F.col("__top")).drop("__g", "__top")
