"""Missing tags suggested from tagged items: centres of the best-known tags, their neighbours, clear winners, proposals to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.operators.ranking import best_with_margin
from gleaner.operators.similarity import centroids, knn
from gleaner.operators.tags import proposals

TAGS, ITEMS = 300, 300  # what one run looks at and offers: the tags with most seeds, and so many items for each
_FIRST = -(1 << 62)  # of the numbers that stand for tags among the queries, below all item ids


def suggest(items: DataFrame, seeds: DataFrame, least: float = 0.0, margin: float = 0.01, least_seeds: int = 3, tags_most: int = TAGS, items_most: int = ITEMS) -> DataFrame:
    """``item, tag, origin, confidence``: proposals for items (``id, v``) by the vectors of tagged ones. ``seeds``: ``item, tag`` links.

    A tag's centre is the mean direction of its seeds. Each of the ``tags_most`` tags with most seeds has its ``items_most`` nearest items of at least the similarity; an item goes to the tag that
    it is nearest to, unless another one is within ``margin``. Links that exist are not proposed. Centres are the queries of one search, so items are read
    once and neither copied nor joined with the tags.
    """
    known = seeds.select(F.col("item").alias("id"), "tag").distinct()
    centres = centroids(items.select("id", "v").join(known, "id"), "tag", least=least_seeds).orderBy(F.desc("n"), "tag").limit(tags_most)
    numbered = centres.withColumn("query", F.lit(_FIRST) + F.row_number().over(W.orderBy(F.desc("n"), "tag")))  # tags_most rows
    hits = knn(numbered.select(F.col("query").alias("id"), F.col("centroid").alias("v")), items, items_most, least=least)
    found = hits.join(F.broadcast(numbered.select("query", "tag")), "query").select("item", "tag", "similarity")
    clear = best_with_margin(found, "item", "tag", "similarity", margin, items_most).withColumnRenamed("score", "similarity")
    return proposals(clear, numbered.select("tag", "n"), known.select(F.col("id").alias("item"), "tag"), tags_most, items_most)
