"""Duplicate groups: pair evidence, components, keepers, review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gleaner.functions.vector import cosine
from gleaner.operators.graph import connected_components
from gleaner.operators.similarity import copies, hamming_pairs
from gleaner.session import materialise
from gleaner.sources.deltas import KeyedTable


def keeper_order() -> list[Column]:
    """Best first: more pixels, more bytes, older, smaller id."""
    return [F.desc("pixels"), F.desc("n_bytes"), F.asc_nulls_last("taken_at"), F.asc("id")]


def keeper_rank() -> Column:
    """``keeper_order`` as one value, smallest first: a group's best member by a minimum that is combined map-side."""
    down = lambda c: (F.col(c).isNull(), -F.col(c))
    parts = [*down("pixels"), *down("n_bytes"), F.col("taken_at").isNull(), F.col("taken_at"), F.col("id")]
    return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))


def group_pairs(pairs: DataFrame) -> DataFrame:
    """``id, component`` over ``a, b`` pairs."""
    return connected_components(materialise(pairs.select("a", "b"), "duplicate-pairs")).withColumnRenamed("node", "id")


def summarise(pairs: DataFrame, groups: DataFrame, items: DataFrame) -> DataFrame:
    """One row a group: kind, status, members, keeper, bytes to win back, key.

    A group is ``exact`` only if all its pairs are, ``dismissed`` only if all are. ``pairs``: ``a, b, kind, status``; ``items``: ``id, pixels, n_bytes, taken_at``.
    """
    of = pairs.join(groups.withColumnRenamed("id", "a"), "a").groupBy("component").agg(
        F.when(F.bool_and(F.col("kind") == "exact"), "exact").otherwise("similar").alias("kind"),
        F.when(F.bool_and(F.col("status") == "dismissed"), "dismissed").otherwise("open").alias("status"),
        F.count("*").alias("n_pairs"),
    )
    kept = F.min_by(F.struct("id", "n_bytes"), keeper_rank())
    members = groups.join(items, "id").groupBy("component").agg(F.count("*").alias("n_members"), kept.alias("kept"), F.sum("n_bytes").alias("n_bytes"), group_version("id").alias("version"))
    reclaim = F.coalesce(F.col("n_bytes"), F.lit(0)) - F.coalesce("kept.n_bytes", F.lit(0))
    return of.join(members.select("component", "n_members", F.col("kept.id").alias("keeper"), reclaim.alias("reclaim"), "version"), "component")


def group_version(key: str) -> Column:
    """A digest of a group's members that does not depend on their order: the count, and sum and mix of the members' hashes."""
    h = F.xxhash64(F.col(key)).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(":", F.count("*"), F.sum(h), F.bit_xor(F.xxhash64(F.col(key)))), 256)


def keep_best(groups: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``id, component, place, decision``: the best ``n`` of each group are kept; groups of no more than ``n`` are left out."""
    w = W.partitionBy("component")
    ranked = groups.join(items, "id").select("id", "component", F.row_number().over(w.orderBy(*keeper_order())).alias("place"), F.count("*").over(w).alias("size"))
    return ranked.where(F.col("size") > n).select("id", "component", "place", F.when(F.col("place") <= n, "KEEP").otherwise("DELETE").alias("decision"))


def staged_exact(items: DataFrame) -> DataFrame:
    """``a, b`` star pairs of equal content, by stages that each leave fewer rows: size, sample hash, whole hash.

    ``items``: ``id, n_bytes, sample, digest`` (sample: hash of head and tail). Counts are combined map-side; the stages are semi-joins.
    """
    same_size = items.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes")
    some = items.join(same_size, "n_bytes", "left_semi")
    same_sample = some.groupBy("n_bytes", "sample").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "sample")
    return copies(some.join(same_sample, ["n_bytes", "sample"], "left_semi"), "id", "digest")


def carry_reviews(groups: DataFrame, previous: DataFrame) -> DataFrame:
    """``id, component, decision, needs_review``: the latest earlier decision of each item whose content is unchanged.

    ``groups``: ``id, component, revision, version``; ``previous``: ``id, revision, version, decision, updated_at``. A carried DELETE in a group that
    changed is to be reviewed again; an item without an earlier decision is undecided (null).
    """
    latest = previous.groupBy("id", "revision").agg(F.max_by(F.struct("decision", F.col("version").alias("was")), F.struct("updated_at", "version")).alias("p"))
    joined = groups.join(latest, ["id", "revision"], "left")
    changed = F.coalesce(F.col("p.was") != F.col("version"), F.lit(False))
    return joined.select("id", "component", F.col("p.decision").alias("decision"), (changed & (F.col("p.decision") == "DELETE")).alias("needs_review"))


def invalid_selections(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """``component, problem`` of groups whose decisions may not be carried out: undecided or foreign members, nothing kept, nothing deleted.

    ``groups``: ``component, id``; ``decisions``: ``component, id, decision``. A member with both decisions counts as undecided.
    """
    d = decisions.groupBy("component", "id").agg(F.count_distinct("decision").alias("k"), F.first("decision").alias("decision"), F.lit(1).alias("asked"))
    both = groups.select("component", "id", F.lit(1).alias("member")).join(d, ["component", "id"], "full")
    facts = both.groupBy("component").agg(
        F.count_if(F.col("member").isNull()).alias("foreign"),
        F.count_if(F.col("member").isNotNull() & (F.coalesce("k", F.lit(0)) != 1)).alias("undecided"),
        F.count_if((F.col("k") == 1) & (F.col("decision") == "KEEP")).alias("kept"),
        F.count_if((F.col("k") == 1) & (F.col("decision") == "DELETE")).alias("deleted"),
    )
    problem = F.when(F.col("foreign") > 0, "foreign").when(F.col("undecided") > 0, "undecided").when(F.col("kept") == 0, "nothing kept").when(F.col("deleted") == 0, "nothing deleted")
    return facts.select("component", problem.alias("problem")).where("problem is not null")


def still_current(pairs: DataFrame, members: DataFrame, live: DataFrame | None = None, sequenced: DataFrame | None = None) -> DataFrame:
    """``component, current``: whether the components of the pairs that touch the members are still those groups. ``members``: ``component, id``.

    With ``live`` (``id``), pairs to items that are not among them do not count; with ``sequenced`` (``id``), a group that has one of these items is
    not current, as sequences manage them.
    """
    ends = pairs.select("a", "b")
    if live is not None:
        ids = live.select("id").distinct()
        ends = ends.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    by_a = ends.join(members.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
    by_b = ends.join(members.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    touching = by_a.union(by_b).distinct()
    now = group_pairs(touching)
    was = members.groupBy("component").agg(group_version("id").alias("version"), F.min("id").alias("low"))
    is_ = now.groupBy(F.col("component").alias("low")).agg(group_version("id").alias("now"))
    same = was.join(is_, "low", "left").select("component", F.coalesce(F.col("version") == F.col("now"), F.lit(False)).alias("current"))
    if sequenced is None:
        return same
    held = members.join(sequenced.select("id"), "id", "left_semi").select("component", F.lit(True).alias("held")).distinct()
    return same.join(held, "component", "left").select("component", (F.col("current") & F.col("held").isNull()).alias("current"))


def keep_counts(groups: DataFrame, members: DataFrame, items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``component, problem`` for every request (null: carried out), and ``component, id, decision, version, revision`` of the groups that are decided: the best ``count`` members
    are kept, the others deleted, at the next revision.

    ``groups``: ``component, version, revision, ignored``; ``members``: ``component, id``; ``items``: ``id, pixels, n_bytes, taken_at, deleted_at``; ``requests``: ``component, version,
    revision, count``. A request must name the version and revision that the group has. Only the best members of a group meet in one place: as many
    as the largest count that is asked for.
    """
    asked = requests.select("component", F.col("version").alias("asked_version"), F.col("revision").alias("asked_revision"), "count")
    live = items.where("deleted_at is null").select("id", F.lit(1).alias("live"))
    sizes = members.join(requests.select("component"), "component", "left_semi").join(live, "id", "left").groupBy("component").agg(F.count("*").alias("size"), F.count("live").alias("alive"))
    facts = asked.join(groups, "component", "left").join(sizes, "component", "left")
    problem = (
        F.when(F.col("version").isNull(), "missing")
        .when(F.col("version") != F.col("asked_version"), "stale group")
        .when(F.col("revision") != F.col("asked_revision"), "stale review")
        .when(F.col("ignored"), "ignored")
        .when((F.col("count") < 1) | (F.col("count") > F.coalesce("size", F.lit(0))), "bad count")
        .when(F.col("alive") < F.col("size"), "changed")
    )
    checked = materialise(facts.select("component", problem.alias("problem"), "version", "revision", "count"), "keep-checked")
    sound = checked.where("problem is null").select("component", "version", (F.col("revision") + 1).alias("revision"), "count")
    most = sound.agg(F.max("count")).first()[0] or 0
    own = members.join(sound, "component")
    place = F.row_number().over(W.partitionBy("component").orderBy(*keeper_order()))
    best = own.join(items, "id").withColumn("place", place).where(F.col("place") <= most).where("place <= count").select("component", "id", F.lit("KEEP").alias("kept"))
    decided = own.join(best, ["component", "id"], "left").select("component", "id", F.coalesce("kept", F.lit("DELETE")).alias("decision"), "version", "revision")
    return checked.select("component", "problem"), decided


def keep_requests(groups: DataFrame, members: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Requests to keep ``count`` members of all groups that are not ignored, and ``component, problem`` of those that are passed over: groups of one member or of no
    more than ``count``."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    active = groups.where(~F.col("ignored")).join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    small = (F.col("size") < 2) | (F.col("size") <= count)
    requests = active.where(~small).select("component", "version", "revision", F.lit(count).alias("count"))
    return requests, active.where(small).select("component", F.when(F.col("size") < 2, "alone").otherwise("nothing to delete").alias("problem"))


class Reviews:
    """Review states of duplicate groups: groups, decisions and events in one keyed table, so that a change of all three is one version or none.

    A change is made from the version that was read; if another writer has changed the table since, ``Conflict`` is raised and nothing is written.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.table = KeyedTable(spark, root, "key", "at")

    def _rows(self, kind: str, df: DataFrame, *name: Column) -> DataFrame:
        columns = ("component", "id", "version", "revision", "ignored", "decision")
        kinds = {"component": "long", "id": "long", "version": "string", "revision": "long", "ignored": "boolean", "decision": "string"}
        own = [(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]
        return df.select(F.concat_ws("/", F.lit(kind), *(x.cast("string") for x in name)).alias("key"), F.lit(kind).alias("kind"), *own, F.coalesce("revision", F.lit(0)).cast("long").alias("at") if "revision" in df.columns else F.lit(0).cast("long").alias("at"))

    def _of(self, kind: str, version: int | None = None) -> DataFrame:
        return self.table.read(version).where(F.col("kind") == kind)

    def start(self, groups: DataFrame, members: DataFrame) -> int:
        """Put groups (``component, version, revision, ignored``) and their members (``component, id``) in place, undecided."""
        rows = self._rows("group", groups, F.col("component")).unionByName(self._rows("member", members, F.col("component"), F.col("id")))
        return self.table.apply(rows, self.table.version())

    def groups(self, version: int | None = None) -> DataFrame:
        return self._of("group", version).select("component", "version", "revision", "ignored")

    def members(self, version: int | None = None) -> DataFrame:
        return self._of("member", version).select("component", "id", "decision")

    def events(self, version: int | None = None) -> DataFrame:
        """``component, id, version, revision, decision``: every decision that was ever taken."""
        return self._of("event", version).select("component", "id", "version", "revision", "decision")

    def keep(self, requests: DataFrame, items: DataFrame, expected: int | None = None) -> DataFrame:
        """Carry out requests (see ``keep_counts``) as one version and return ``component, problem``; of requests for one group one is taken."""
        version = self.table.version() if expected is None else expected
        groups, members = self.groups(version), self.members(version).select("component", "id")
        outcome, decided = keep_counts(groups, members, items, requests.dropDuplicates(["component"]))
        decided = materialise(decided, "keep-decided")
        if not decided.head(1):
            return outcome
        moved = groups.drop("version", "revision").join(decided.select("component", "version", "revision").distinct(), "component")
        rows = self._rows("group", moved, F.col("component")).unionByName(self._rows("member", decided, F.col("component"), F.col("id")))
        self.table.apply(rows.unionByName(self._rows("event", decided, F.col("component"), F.col("id"), F.col("revision"))), version)
        return outcome

    def keep_all(self, count: int, items: DataFrame) -> DataFrame:
        """``component, problem`` of all groups that are not ignored, after the best ``count`` members of each were kept (null) or the group was passed over."""
        version = self.table.version()
        requests, passed = keep_requests(self.groups(version), self.members(version), count)
        return self.keep(requests, items, version).unionByName(passed)


def dismiss(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with both ends among the members become dismissed. ``pairs``: ``a, b, status``."""
    m = members.select(F.col("id")).distinct()
    a, b = m.select(F.col("id").alias("a"), F.lit(True).alias("in_a")), m.select(F.col("id").alias("b"), F.lit(True).alias("in_b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.withColumn("status", F.when(F.col("in_a") & F.col("in_b"), "dismissed").otherwise(F.col("status"))).drop("in_a", "in_b")


def scan(items: DataFrame, bits: int = 8, least: float = 0.9, same_hash: bool = True) -> DataFrame:
    """``a, b, kind, distance, similarity``: candidate pairs by stages: equal content as stars, then near hashes that their vectors confirm.

    ``items``: ``id, n_bytes, sample, digest, hash, v``. Near pairs are between the smallest ids of their hashes; a pair without two vectors
    is kept unconfirmed (null similarity). Equal contents are not paired again. Other items of equal hash are paired with the smallest id of it where ``same_hash``.
    """
    exact = staged_exact(items).select("a", "b", F.lit("exact").alias("kind"), F.lit(0).alias("distance"), F.lit(None).cast("double").alias("similarity"))
    near = hamming_pairs(items, bits)
    if same_hash:
        near = near.unionByName(copies(items, "id", "hash").join(exact.select("a", "b"), ["a", "b"], "left_anti").withColumn("distance", F.lit(0)))
    sides = [items.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")) for k in ("a", "b")]
    pairs = near.join(sides[0], "a").join(sides[1], "b").withColumn("similarity", cosine(F.col("va"), F.col("vb")))
    confirmed = pairs.where(F.col("similarity").isNull() | (F.col("similarity") >= least))
    return exact.unionByName(confirmed.select("a", "b", F.lit("similar").alias("kind"), F.col("distance").cast("int").alias("distance"), "similarity"))
