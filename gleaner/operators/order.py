"""Places and running sums over a whole table, dealt by ranges so that no task has all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.session import materialise


def running(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over a row and all rows before it by ``keys``. Rows are dealt by ranges of the keys: each range goes on from the sums of those before it."""
    dealt = materialise(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "running")
    before = F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum(value).over(W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(sums, "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


SPAN = 1 << 16  # places that one task sums


def running_by_place(df: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """``running`` for rows that have dense places (0, 1, 2, ...) already: spans follow from the numbers, so nothing is sampled or written. ``df`` is read twice."""
    dealt = df.withColumn("__part", F.floor(F.col(place) / SPAN))
    before = F.sum("__sum").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))  # a row for each span
    sums = dealt.groupBy(F.col("__part").alias("__p")).agg(F.sum(value).alias("__sum")).select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum(value).over(W.partitionBy("__part").orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(sums, F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__p", "__own", "__before")


def placed(df: DataFrame, by: str, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the place of each row, from 0, within ``by`` in the order of ``keys``. Lists of any length: they are numbered together, by ranges."""
    one = running(df.withColumn("__one", F.lit(1).cast("long")), [by, *keys], "__one", "__upto").drop("__one")
    first = one.groupBy(F.col(by).alias("__by")).agg(F.min("__upto").alias("__first"))
    return one.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col("__upto") - F.col("__first")).drop("__upto", "__first", "__by")
