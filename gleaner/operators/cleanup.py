"""Cleanup of duplicates: a frozen plan, its check before it runs, soft deletion by batch, and its undoing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.duplicates import invalid_selections

FACTS = ("n_bytes", "content_hash", "revision")


def plan(groups: DataFrame, decisions: DataFrame, items: DataFrame) -> DataFrame:
    """``component, id, decision`` with the facts of each item as they are now, for groups that are decided soundly.

    Groups with an unsound selection, or with a member that is gone or deleted, are left out whole. ``groups``: ``component, id``;
    ``decisions``: ``component, id, decision``; ``items``: ``id, deleted_at`` and the facts.
    """
    bad = invalid_selections(groups, decisions).select("component")
    live = items.where("deleted_at is null").select("id", *FACTS)
    gone = groups.join(live.select("id"), "id", "left_anti").select("component")
    sound = groups.select("component", "id").join(bad.union(gone).distinct(), "component", "left_anti")
    return sound.join(decisions.select("component", "id", "decision"), ["component", "id"]).join(live, "id").select("component", "id", "decision", *FACTS)


def stale(planned: DataFrame, items: DataFrame) -> DataFrame:
    """``component, id, reason`` of planned items that are no longer what the plan froze."""
    now = items.select("id", "deleted_at", *(F.col(c).alias(f"now_{c}") for c in FACTS), F.lit(True).alias("there"))
    j = planned.join(now, "id", "left")
    changed = F.lit(False)
    for c in FACTS:
        changed |= ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    reason = F.when(F.col("there").isNull(), "gone").when(F.col("deleted_at").isNotNull(), "deleted").when(changed, "changed")
    return j.select("component", "id", reason.alias("reason")).where("reason is not null")


def execute(planned: DataFrame, items: DataFrame, batch: str, at: str) -> DataFrame:
    """Items after the plan: those to delete get ``deleted_at`` and ``batch``. Groups with a stale item are not touched."""
    ready = planned.join(stale(planned, items).select("component").distinct(), "component", "left_anti")
    gone = ready.where("decision = 'DELETE'").select("id", F.lit(True).alias("__go")).distinct()
    j = items.join(gone, "id", "left")
    return j.withColumns(
        {"deleted_at": F.when(F.col("__go"), F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at").cast("timestamp")), "batch": F.when(F.col("__go"), batch).otherwise(F.col("batch"))}
    ).drop("__go")


def restore(items: DataFrame, batch: str) -> DataFrame:
    """Items with one batch of deletions undone."""
    mine = F.coalesce(F.col("batch") == batch, F.lit(False))
    return items.withColumns({"deleted_at": F.when(~mine, F.col("deleted_at")), "batch": F.when(~mine, F.col("batch"))})
