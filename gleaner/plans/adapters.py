"""The test tables in the shapes that the operators take; each with the same as SQL.

Orders stand for items (customers for folders), line items for frames and for links of items to tags,
parts for tags below brands and types, events for feeds and logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.session import table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("folder"),
        F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("name"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).alias("n_bytes"),
        F.col("o_orderdate").alias("taken_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
        (F.col("o_orderpriority") == "1-URGENT").alias("favourite"),
        F.col("o_orderstatus").alias("status"),
        F.pmod(F.col("o_orderkey"), F.lit(97)).alias("pixels"),
    )


ITEMS = """items AS (
    SELECT o_orderkey AS id, o_custkey AS folder, o_orderpriority || '/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS name,
        CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS n_bytes, o_orderdate AS taken_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at, o_orderpriority = '1-URGENT' AS favourite,
        o_orderstatus AS status, o_orderkey % 97 AS pixels
    FROM orders)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("camera"),
        F.col("l_linestatus").alias("lens"),
        (F.col("l_quantity") * 64).cast("int").alias("iso"),
        (1.4 + F.col("l_discount") * 100).alias("aperture"),
        (10 + F.col("l_tax") * 1000).alias("focal"),
        F.col("l_shipdate").alias("taken_at"),
    )


FRAMES = """frames AS (
    SELECT l_orderkey AS item, l_linenumber AS line, l_returnflag AS camera, l_linestatus AS lens,
        CAST(l_quantity * 64 AS INTEGER) AS iso, 1.4 + l_discount * 100 AS aperture, 10 + l_tax * 1000 AS focal, l_shipdate AS taken_at
    FROM lineitem)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types above brands above parts: ``id, parent_id, name``."""
    p = table(spark, sf_dir, "part")
    kind, brand = F.concat(F.lit("t:"), "p_type"), F.concat(F.lit("b:"), "p_type", F.lit("/"), "p_brand")
    leaf = p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), brand.alias("parent_id"), F.col("p_name").alias("name"))
    middle = p.select(brand.alias("id"), kind.alias("parent_id"), F.col("p_brand").alias("name")).distinct()
    top = p.select(kind.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("p_type").alias("name")).distinct()
    return leaf.union(middle).union(top)


TAGS = """tags AS (
    SELECT 'p:' || CAST(p_partkey AS VARCHAR) AS id, 'b:' || p_type || '/' || p_brand AS parent_id, p_name AS name FROM part
    UNION ALL SELECT DISTINCT 'b:' || p_type || '/' || p_brand, 't:' || p_type, p_brand FROM part
    UNION ALL SELECT DISTINCT 't:' || p_type, NULL, p_type FROM part)"""
CLOSED = """closed(ancestor, node) AS (
    SELECT id, id FROM tags UNION SELECT c.ancestor, t.id FROM closed c JOIN tags t ON t.parent_id = c.node)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with tags: hand-set where the line is returned, else by a classifier with a confidence."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("tag"),
        F.when(F.col("l_returnflag") == "R", "manual").otherwise("auto").alias("origin"),
        (F.col("l_linestatus") == "F").alias("confirmed"),
        (0.4 + F.col("l_discount") * 5).alias("confidence"),
    )


LINKS = """links AS (
    SELECT l_orderkey AS item, 'p:' || CAST(l_partkey AS VARCHAR) AS tag, CASE WHEN l_returnflag = 'R' THEN 'manual' ELSE 'auto' END AS origin,
        l_linestatus = 'F' AS confirmed, 0.4 + l_discount * 5 AS confidence
    FROM lineitem)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63 sign bits of each embedding as a long."""
    bits = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s * 2 + F.when(F.element_at("embedding", i) > 0, 1).otherwise(0))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("hash"), "label", F.col("embedding").alias("v"))


HASHES = """hashes AS (
    SELECT vec_id AS id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(63 - i AS INTEGER) ELSE 0 END)) AS BIGINT) AS hash,
        label, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


FEED = "feed AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
