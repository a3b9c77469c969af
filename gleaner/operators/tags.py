"""Tags of items: person counts, coverage, upserts, audits, look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.operators.ranking import first_per_key
from gleaner.session import materialise

# How a tag name tells a number of persons.
PERSONS = r"^(\d+)(\+?)(girl|boy|other)s?$"
MULTIPLE = r"^multiple_(girl|boy|other)s$"


def person_counts(links: DataFrame, item: str = "item", name: str = "name") -> DataFrame:
    """``item, persons``: the largest number that an item's names tell for each category, summed; else 1 if a name is ``solo``, else 0.

    ``multiple_girls`` and the like tell two.
    """
    n = F.lower(F.col(name))
    count = F.when(n.rlike(PERSONS), F.regexp_extract(n, PERSONS, 1).try_cast("int")).when(n.rlike(MULTIPLE), 2)
    kind = F.when(n.rlike(PERSONS), F.regexp_extract(n, PERSONS, 3)).when(n.rlike(MULTIPLE), F.regexp_extract(n, MULTIPLE, 1)).otherwise("")
    each = links.groupBy(F.col(item).alias("item"), kind.alias("kind")).agg(F.max(count).alias("n"), F.bool_or(n == "solo").alias("solo"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return each.groupBy("item").agg(F.when(total > 0, total).when(F.bool_or("solo"), 1).otherwise(0).cast("long").alias("persons"))


def tagging_coverage(items: DataFrame, links: DataFrame, item: str = "item", origin: str | None = None) -> DataFrame:
    """``total, tagged, untagged``: items with a link (of an origin), and without."""
    used = links if origin is None else links.where(F.col("origin") == origin)
    marked = items.select(item).join(used.select(item, F.lit(1).alias("has")).distinct(), item, "left")
    return marked.agg(F.count("*").alias("total"), F.count("has").alias("tagged"), F.count_if(F.col("has").isNull()).alias("untagged"))


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the new ones put in: a new link replaces one of the same item and tag; of repeated new links the surest stays."""
    fresh = new.groupBy("item", "tag").agg(F.max_by(F.struct("origin", "confidence"), F.struct("confidence", "origin")).alias("s")).select("item", "tag", "s.origin", "s.confidence")
    return links.select("item", "tag", "origin", "confidence").join(fresh, ["item", "tag"], "left_anti").unionByName(fresh)


def retag(links: DataFrame, new: DataFrame, items: DataFrame) -> DataFrame:
    """Links after tagging ``items`` again: their unconfirmed links go, the new ones come unless a confirmed link stands. Doing it twice changes nothing."""
    kept = links.join(items.select("item", F.lit(True).alias("redo")).distinct(), "item", "left").where(F.col("redo").isNull() | F.col("confirmed")).select("item", "tag", "confirmed")
    fresh = new.select("item", "tag").distinct().join(kept, ["item", "tag"], "left_anti").withColumn("confirmed", F.lit(False))
    return kept.unionByName(fresh)


def audit_named(links: DataFrame, tags: DataFrame, multi: Sequence[str], single: Sequence[str], root: str) -> DataFrame:
    """``tag, n_items``: items of several persons that are named with exactly one child of ``root``, counted by that child.

    Several persons: a tag of ``multi``, or two link rows or more with tags of ``single``. ``links``: ``item, tag``; ``tags``: ``tag, parent``.
    """
    many = links.groupBy("item").agg(F.count_if(F.col("tag").isin(list(multi))).alias("m"), F.count_if(F.col("tag").isin(list(single))).alias("s")).where("m > 0 or s >= 2").select("item")
    named = links.join(tags.where(F.col("parent") == root).select("tag"), "tag", "left_semi")
    one = named.groupBy("item").agg(F.count("*").alias("n"), F.min("tag").alias("tag")).where("n = 1")
    return one.join(many, "item", "left_semi").groupBy("tag").agg(F.count("*").alias("n_items"))


def role_counts(roles: DataFrame, links: DataFrame) -> DataFrame:
    """Every role with its distinct items, 0 where there are none. ``roles``: ``tag``."""
    n = links.groupBy("tag").agg(F.count_distinct("item").alias("n_items"))
    return roles.select("tag").distinct().join(n, "tag", "left").select("tag", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def typeahead(tags: DataFrame, query: str, limit: int, name: str = "name") -> DataFrame:
    """Names that contain the query, those that begin with it first, then shorter ones, then by name."""
    n, q = F.lower(F.col(name)), F.lit(query.lower())
    found = tags.select(F.col(name).alias("name")).distinct().where(F.contains(F.lower("name"), q))
    n = F.lower("name")
    return found.orderBy(F.desc(F.startswith(n, q)), F.length("name"), "name").limit(limit)


def by_prefix(names: DataFrame, prefix: str, limit: int, name: str = "name") -> DataFrame:
    """Names under a prefix in code-point order."""
    return names.where(F.startswith(F.col(name), F.lit(prefix))).select(name).distinct().orderBy(name).limit(limit)


def category(name: Column, exact: dict[str, Sequence[str]], patterns: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """A name's category: by lists of names, then by the first pattern that fits."""
    out = F.lit(other)
    for label, pattern in reversed(patterns):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    for label, names in reversed(list(exact.items())):
        out = F.when(name.isin(list(names)), label).otherwise(out)
    return out


def above_threshold(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows whose score reaches their category's threshold; unknown categories are left out."""
    least = F.lit(None).cast("double")
    for label, value in thresholds.items():
        least = F.when(F.col("category") == label, value).otherwise(least)
    return scores.where(F.col("score") >= least)


def ngrams(query: str, low: int = 2, high: int = 4, most: int = 12) -> list[str]:
    """Pieces of a query's CJK runs, the longer first; at most ``most``."""
    runs, run = [], ""
    for c in query + " ":
        if "㐀" <= c <= "鿿" or "぀" <= c <= "ヿ":
            run += c
        elif run:
            runs.append(run)
            run = ""
    out = [r[i : i + n] for n in range(high, low - 1, -1) for r in runs for i in range(len(r) - n + 1)]
    return list(dict.fromkeys(out))[:most]


def tag_evidence(links: DataFrame, query: str, semantic: DataFrame) -> DataFrame:
    """``item, source, exact``: trusted links whose name has the query (exact: is the query); others count as ``autoTag`` only for items that the vectors found too.

    ``links``: ``item, name, trusted``; ``semantic``: ``item``.
    """
    n = F.lower(F.col("name"))
    cond = F.contains(n, F.lit(query.lower()))
    for g in ngrams(query):
        cond |= F.contains(n, F.lit(g))
    hit = links.where(cond)
    sure = hit.where("trusted").select("item", F.lit("tag").alias("source"), (n == query.lower()).alias("exact"))
    auto = hit.where("not trusted").join(semantic.select("item"), "item", "left_semi").select("item", F.lit("autoTag").alias("source"), F.lit(False).alias("exact"))
    return sure.union(auto).groupBy("item", "source").agg(F.bool_or("exact").alias("exact"))


def add_to_album(album: DataFrame, new: DataFrame, key: str = "item") -> DataFrame:
    """``item, place``: an album with new items behind the last place; those that it has already are ignored. ``new``: ``item``; places follow the item ids."""
    fresh = new.select(key).distinct().join(album.select(key), key, "left_anti")
    last = album.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))
    return album.select(key, "place").union(numbered(fresh, key, "n").crossJoin(F.broadcast(last)).select(key, (F.col("last") + F.col("n")).cast("int")))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the place of each row by ``key``, from 1. Rows are dealt by ranges of the key, so no task numbers all: each range goes on from what those before it hold."""
    dealt = materialise(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "numbered")
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(key))
    return dealt.withColumn("__own", own).join(sizes, "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def names_of(links: DataFrame, most: int = 3) -> DataFrame:
    """``item, names``: up to ``most`` tag names of each item, in order, joined by commas."""
    few = first_per_key(links.select("item", "name").distinct(), ["item"], [F.asc("name")], most)
    return few.groupBy("item").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def items_of_tag(links: DataFrame, items: DataFrame, tag: str, limit: int = 3000) -> DataFrame:
    """Live items of a tag by id; a listing shows at most ``limit``."""
    hit = links.where(F.col("tag") == tag).select("item").distinct()
    return items.where("deleted_at is null").join(hit, "item", "left_semi").orderBy("item").limit(limit)


def name_group(links: DataFrame, over: DataFrame, members: DataFrame, targets: Sequence[str], most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Links after a group's members got the target tags, and ``node, gained``: how many distinct items every tag's subtree won.

    ``over``: the closure (``ancestor, node``). Links that exist stay as they are. At most ``most`` targets may be given.
    """
    if not 1 <= len(set(targets)) <= most:
        raise ValueError(f"1 to {most} tags may be given at once")
    named = members.select("item").distinct().withColumn("tag", F.explode(F.array(*(F.lit(t) for t in sorted(set(targets))))))
    fresh = named.join(links.select("item", "tag"), ["item", "tag"], "left_anti")
    before = links.join(members.select("item").distinct(), "item", "left_semi").join(over, F.col("tag") == F.col("node")).select("item", F.col("ancestor").alias("node")).distinct()
    after = fresh.join(over, F.col("tag") == F.col("node")).select("item", F.col("ancestor").alias("node")).distinct()
    gained = after.join(before, ["item", "node"], "left_anti").groupBy("node").agg(F.count("*").alias("gained"))
    return links.select("item", "tag").unionByName(fresh), gained


def members_with_persons(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``component, item, persons`` of groups, with the persons that an item's names tell (0 if none)."""
    n = person_counts(links)
    return groups.join(n, "item", "left").select("component", "item", F.coalesce("persons", F.lit(0)).alias("persons"))


def proposals(found: DataFrame, seeds: DataFrame, links: DataFrame, tags_most: int = 300, items_most: int = 300) -> DataFrame:
    """``item, tag, origin, confidence`` of suggestions to write: of the tags with most seeds, each with its best items, without links that exist.

    ``found``: ``item, tag, similarity``; ``seeds``: ``tag, n``. The caps are what one run of suggestions offers.
    """
    best = seeds.orderBy(F.desc("n"), "tag").limit(tags_most).select("tag")
    mean = found.join(F.broadcast(best), "tag", "left_semi").groupBy("item", "tag").agg(F.avg("similarity").alias("s"))
    top = first_per_key(mean, ["tag"], [F.desc("s"), F.asc("item")], items_most)
    fresh = top.join(links.select("item", "tag"), ["item", "tag"], "left_anti")
    return fresh.select("item", "tag", F.lit("auto").alias("origin"), (F.floor(F.col("s") * 10000 + 0.5) / 10000).alias("confidence"))
