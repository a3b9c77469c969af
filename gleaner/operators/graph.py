"""Connected components over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an edge list with the smallest node that it can reach.

    Alternates the large-star and small-star steps until the edge set stays the
    same. Each round is two grouped minima (combined map-side) and two equi-joins;
    no neighbour list is ever gathered, so a hub is only a skewed join key, which
    AQE splits. Each round is written once in the shared folder, which cuts the lineage.

    Returns ``node, component``; nodes without an edge do not appear. Edges with a
    null end and self-loops are ignored, repeated edges count once.
    """
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "components",
    )
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = materialise(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct(),
            "components",
        )
        before, mark = mark, _mark(e)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
