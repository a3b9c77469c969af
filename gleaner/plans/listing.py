"""Queries of listings: scans, predicates, joins, pages, sets, hierarchies."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import colour
from gleaner.functions.text import rename, replace_prefix
from gleaner.operators import curation, filters, fulltext, hierarchy, itemsets, ranking, rules, tags as tagging
from gleaner.plans.adapters import FRAMES, ITEMS, LINKS, TAGS, CLOSED, frames, items, links, tags
from gleaner.plans.registry import query
from gleaner.session import materialise, shared_dir, table


@query(
    "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE o_orderstatus = 'F' GROUP BY l_returnflag"
)
def inner_join_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).where("o_orderstatus = 'F'").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    )


FLAGSHIP = "inner_join_group_count"


@query(f"WITH {ITEMS} SELECT id, folder, n_bytes FROM items WHERE deleted_at IS NULL AND favourite")
def live_favourites(spark, sf_dir):
    return filters.live(items(spark, sf_dir)).where("favourite").select("id", "folder", "n_bytes")


@query(f"WITH {FRAMES} SELECT item, line, iso FROM frames WHERE iso BETWEEN 640 AND 1280 AND aperture <= 5 AND focal >= 40")
def closed_ranges(spark, sf_dir):
    f = frames(spark, sf_dir)
    cond = filters.between(F.col("iso"), 640, 1280) & filters.between(F.col("aperture"), high=5) & filters.between(F.col("focal"), low=40)
    return f.where(cond).select("item", "line", "iso")


@query(f"WITH {ITEMS} SELECT count(*) AS n FROM items WHERE taken_at >= DATE '1996-01-01' AND taken_at < DATE '1997-01-01'")
def half_open_count(spark, sf_dir):
    cond = filters.half_open(F.col("taken_at"), date(1996, 1, 1), date(1997, 1, 1))
    return items(spark, sf_dir).where(cond).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id, name FROM items WHERE lower(name) LIKE '%-high/12%'")
def name_contains(spark, sf_dir):
    return items(spark, sf_dir).where(filters.name_matches(F.col("name"), "-High/12")).select("id", "name")


@query(f"WITH {ITEMS} SELECT id, name FROM items WHERE regexp_full_match(lower(name), '[1-3].*/1.7\\.jpg')")
def name_glob(spark, sf_dir):
    return items(spark, sf_dir).where(filters.name_matches(F.col("name"), "[1-3]*/1?7.JPG")).select("id", "name")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'utm_source')")
def literal_like(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(filters.contains_literal(F.col("url"), "utm_source")).select("page_id", "url")


@query(f"WITH {ITEMS} SELECT count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM items WHERE folder IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def in_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("folder"))
    return filters.in_keys(items(spark, sf_dir), keys, "folder").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@query(
    f"WITH {ITEMS}, x AS (SELECT CASE WHEN folder % 5 = 0 THEN NULL ELSE folder END AS folder FROM items) "
    "SELECT count(*) AS n, count(folder) AS with_folder FROM x WHERE folder IS NULL OR folder NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
)
def null_safe_not_in(spark, sf_dir):
    x = items(spark, sf_dir).select(F.when(F.col("folder") % 5 != 0, F.col("folder")).alias("folder"))
    hidden = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("folder"))
    return filters.not_in_keys(x, hidden, "folder").agg(F.count("*").alias("n"), F.count("folder").alias("with_folder"))


@query("SELECT count(*) AS n FROM events WHERE month(ts) = 1 AND hour(ts) = 14")
def month_and_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(filters.at_month(F.col("ts"), 1) & filters.at_hour(F.col("ts"), 14)).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '7')")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").where(filters.json_contains(F.col("props"), "$.k", "7")).select("event_id")


@query(f"WITH {FRAMES} SELECT count(*) AS n FROM frames WHERE camera = 'A' AND lens = 'O'")
def dynamic_equals(spark, sf_dir):
    return filters.equals_any(frames(spark, sf_dir), {"camera": "A", "lens": "O"}, ("camera", "lens")).agg(F.count("*").alias("n"))


def _folders(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("n"))
    mid = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(1).cast("long"))
    low = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_custkey") % 7)
    return top.union(mid).union(low)


FOLDERS = """folders AS (
    SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(0 AS BIGINT) AS n FROM region
    UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), 1 FROM nation
    UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), c_custkey % 7 FROM customer)"""
UNDER = "under(ancestor, node) AS (SELECT id, id FROM folders UNION SELECT u.ancestor, f.id FROM under u JOIN folders f ON f.parent_id = u.node)"


@query(f"WITH RECURSIVE {FOLDERS}, {UNDER} SELECT ancestor AS node, CAST(sum(n) AS BIGINT) AS total FROM under JOIN folders ON id = node GROUP BY ancestor")
def folder_totals(spark, sf_dir):
    return hierarchy.subtree_sum(_folders(spark, sf_dir), "n")


@query(
    f"""WITH RECURSIVE {FOLDERS}, {UNDER}, hidden AS (SELECT DISTINCT node FROM under WHERE ancestor IN ('n3', 'n8'))
    SELECT ancestor AS node, CAST(sum(n) AS BIGINT) AS total FROM under JOIN folders ON id = node
    WHERE node NOT IN (SELECT node FROM hidden) AND ancestor NOT IN (SELECT node FROM hidden) GROUP BY ancestor"""
)
def visible_folder_totals(spark, sf_dir):
    f = _folders(spark, sf_dir)
    return hierarchy.visible_totals(f, f.where(F.col("id").isin("n3", "n8")).select(F.col("id").alias("node")), "n")


@query(f"WITH RECURSIVE {TAGS}, {CLOSED} SELECT ancestor, count(*) AS n FROM closed GROUP BY ancestor HAVING count(*) > 1")
def tag_closure(spark, sf_dir):
    return hierarchy.closure(tags(spark, sf_dir)).groupBy("ancestor").agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"""WITH RECURSIVE {TAGS}, {CLOSED}, {LINKS}, c AS (SELECT ancestor, count(DISTINCT item) AS n FROM closed JOIN links ON tag = node GROUP BY ancestor)
    SELECT id AS node, coalesce(n, 0) AS n FROM tags LEFT JOIN c ON ancestor = id"""
)
def subtree_counts(spark, sf_dir):
    return hierarchy.subtree_distinct(tags(spark, sf_dir), links(spark, sf_dir), "item", link_node="tag")


@query(
    f"""WITH RECURSIVE {TAGS}, {CLOSED}, {LINKS}
    SELECT item FROM links JOIN closed ON tag = node WHERE ancestor = 't:ECONOMY'
    INTERSECT SELECT item FROM links JOIN closed ON tag = node WHERE ancestor IN ('t:SMALL', 't:LARGE')"""
)
def items_with_all_tags(spark, sf_dir):
    groups = spark.createDataFrame([(0, "t:ECONOMY"), (1, "t:SMALL"), (1, "t:LARGE")], "grp int, node string")
    return hierarchy.items_below_all(tags(spark, sf_dir), links(spark, sf_dir), groups, "item", link_node="tag")


@query(f"WITH {LINKS} SELECT tag AS node, count(DISTINCT item) AS n FROM links GROUP BY tag")
def items_of_each_tag(spark, sf_dir):
    return itemsets.counts(itemsets.containers(links(spark, sf_dir), "item", "tag"))


SELECTED = [(0, "t:ECONOMY"), (1, "t:SMALL"), (1, "t:LARGE"), (2, "t:PROMO"), (2, "b:MEDIUM/Brand#1")]
SELECTED_ITEMS = "picked(grp, root) AS (VALUES (0, 't:ECONOMY'), (1, 't:SMALL'), (1, 't:LARGE'), (2, 't:PROMO'), (2, 'b:MEDIUM/Brand#1')), hit AS (SELECT DISTINCT grp, item FROM links JOIN closed ON tag = node JOIN picked ON root = ancestor)"


def _bitmaps(spark, sf_dir):
    f = hierarchy.forest(tags(spark, sf_dir))
    index = itemsets.indexed(itemsets.containers(links(spark, sf_dir), "item", "tag"), f)
    return itemsets.below(index, f, spark.createDataFrame(SELECTED, "grp int, node string"))


@query(f"WITH RECURSIVE {TAGS}, {CLOSED}, {LINKS}, {SELECTED_ITEMS} SELECT grp, count(*) AS n FROM hit GROUP BY grp UNION ALL SELECT -1, count(*) FROM (SELECT item FROM hit GROUP BY item HAVING count(*) = 3)")
def bitmap_counts(spark, sf_dir):
    """Items below each selection of tags, and (-1) below all of them."""
    groups = materialise(_bitmaps(spark, sf_dir), "selected-bitmaps")
    each = itemsets.size(groups, "grp")
    return each.unionByName(itemsets.size(itemsets.in_all(groups, 3)).select(F.lit(-1).alias("grp"), F.coalesce("n", F.lit(0)).alias("n")))


@query(f"WITH RECURSIVE {TAGS}, {CLOSED}, {LINKS}, {SELECTED_ITEMS} SELECT item FROM hit GROUP BY item HAVING count(*) = 3")
def bitmap_members(spark, sf_dir):
    return itemsets.members(itemsets.in_all(_bitmaps(spark, sf_dir), 3))


@query(
    f"""WITH RECURSIVE {TAGS}, {CLOSED}, {LINKS}, hidden AS (SELECT node FROM closed WHERE ancestor = 't:ECONOMY')
    SELECT count(*) AS n FROM links WHERE tag NOT IN (SELECT node FROM hidden)"""
)
def hidden_tags(spark, sf_dir):
    t = tags(spark, sf_dir)
    roots = t.where("id = 't:ECONOMY'").select(F.col("id").alias("node"))
    gone = hierarchy.expand(roots, hierarchy.closure(t, roots=roots))
    return filters.not_in_keys(links(spark, sf_dir), gone.withColumnRenamed("node", "tag"), "tag").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id FROM items WHERE folder IS NULL OR folder NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def orphans(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("folder"))
    return filters.not_in_keys(items(spark, sf_dir), known, "folder").select("id")


@query(f"WITH {LINKS} SELECT count(*) AS n FROM links WHERE origin = 'manual' OR confirmed OR confidence >= 0.55")
def trusted_links(spark, sf_dir):
    return links(spark, sf_dir).where(filters.trusted(F.col("origin"), F.col("confirmed"), F.col("confidence"))).agg(F.count("*").alias("n"))


@query(
    f"WITH {ITEMS}, {LINKS}, {TAGS} SELECT t.name, count(*) AS n FROM items i JOIN links l ON l.item = i.id JOIN tags t ON t.id = l.tag WHERE i.favourite GROUP BY t.name"
)
def three_way_join(spark, sf_dir):
    t = tags(spark, sf_dir).select(F.col("id").alias("tag"), F.col("name").alias("tag_name"))
    i = items(spark, sf_dir).where("favourite").select(F.col("id").alias("item"))
    return links(spark, sf_dir).join(i, "item").join(t, "tag").groupBy(F.col("tag_name").alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id, c_name AS folder_name FROM items LEFT JOIN customer ON c_custkey = folder AND c_acctbal > 0 WHERE deleted_at IS NOT NULL")
def trash_with_folder(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("folder"), F.col("c_name").alias("folder_name"))
    return items(spark, sf_dir).where("deleted_at is not null").join(c, "folder", "left").select("id", "folder_name")


@query(
    f"""WITH {ITEMS}, d AS (SELECT l_orderkey AS id, min(l_shipdate) AS shot FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT CAST(year(coalesce(shot, taken_at)) AS INTEGER) AS year, count(*) AS n FROM items LEFT JOIN d USING (id) GROUP BY 1"""
)
def captured_year(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("shot"))
    return items(spark, sf_dir).join(d, "id", "left").groupBy(F.year(F.coalesce("shot", "taken_at")).alias("year")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS}, {LINKS} SELECT id FROM items WHERE EXISTS (SELECT 1 FROM links WHERE item = id AND EXISTS (SELECT 1 FROM part WHERE 'p:' || CAST(p_partkey AS VARCHAR) = tag AND p_size = 7))")
def exists_two_level(spark, sf_dir):
    some = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("tag"))
    hit = links(spark, sf_dir).join(some, "tag", "left_semi").select(F.col("item").alias("id"))
    return items(spark, sf_dir).join(hit, "id", "left_semi").select("id")


@query(f"WITH {ITEMS}, {LINKS} SELECT id FROM items WHERE NOT EXISTS (SELECT 1 FROM links WHERE item = id AND origin = 'auto')")
def without_auto_tag(spark, sf_dir):
    auto = links(spark, sf_dir).where("origin = 'auto'").select(F.col("item").alias("id"))
    return items(spark, sf_dir).join(auto, "id", "left_anti").select("id")


@query(f"WITH {ITEMS} SELECT id, taken_at::DATE AS day, n_bytes FROM items ORDER BY taken_at DESC, id LIMIT 50 OFFSET 100")
def page_by_date(spark, sf_dir):
    return filters.page(items(spark, sf_dir), [F.desc("taken_at"), F.asc("id")], 100, 50).select("id", F.col("taken_at").cast("date").alias("day"), "n_bytes")


@query(f"WITH {ITEMS} SELECT id, n_bytes FROM items WHERE n_bytes < 30000000 OR (n_bytes = 30000000 AND id < 500) ORDER BY n_bytes DESC, id DESC LIMIT 41")
def keyset_page(spark, sf_dir):
    return filters.after(items(spark, sf_dir).select("id", "n_bytes"), "n_bytes", "id", 30_000_000, 500, 40)


@query(f"WITH {ITEMS} SELECT least(count(*), 5000) AS n FROM items WHERE status = 'F'")
def bounded_count(spark, sf_dir):
    return filters.count_up_to(items(spark, sf_dir).where("status = 'F'"), 5000)


@query(
    f"""WITH {ITEMS}, r AS (SELECT id, n_bytes FROM items WHERE id NOT IN (SELECT id FROM items ORDER BY n_bytes DESC, id LIMIT 30))
    SELECT id, n_bytes FROM r ORDER BY n_bytes DESC, id LIMIT 30"""
)
def second_session_page(spark, sf_dir):
    i = items(spark, sf_dir).select("id", "n_bytes")
    order = [F.desc("n_bytes"), F.asc("id")]
    return filters.not_shown(i, i.orderBy(*order).limit(30), "id", 30, order)


@query(f"WITH {ITEMS} SELECT id FROM items ORDER BY md5('7:' || CAST(id AS VARCHAR)), id LIMIT 25")
def stable_sample(spark, sf_dir):
    return filters.sample_by_hash(items(spark, sf_dir), "id", 25, 7).select("id")


@query(
    f"""WITH {ITEMS}, s AS (SELECT item, count(*) AS views, max(last) AS last_viewed FROM (SELECT user_id * 10 AS item, ts AS last FROM events WHERE event_type = 'view') GROUP BY item)
    SELECT id, coalesce(views, 0) AS views FROM items LEFT JOIN s ON item = id ORDER BY CASE WHEN coalesce(views, 0) = 0 THEN 0 ELSE 1 END, coalesce(views, 0), last_viewed NULLS FIRST, id LIMIT 60"""
)
def rediscovery(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    s = e.groupBy((F.col("user_id") * 10).alias("item")).agg(F.count("*").alias("views"), F.max("ts").alias("last_viewed"))
    return curation.rediscover(items(spark, sf_dir).withColumnRenamed("id", "item"), s, 60).select(F.col("item").alias("id"), "views")


@query(f"WITH {ITEMS} SELECT id FROM items WHERE month(taken_at) = 7 AND day(taken_at) = 14 AND year(taken_at) < 1999")
def same_day(spark, sf_dir):
    return curation.same_day(items(spark, sf_dir), date(1999, 7, 14)).select("id")


@query(
    f"""WITH {ITEMS} SELECT id FROM items WHERE year(taken_at) < 1999 AND
    abs(date_diff('day', make_date(CAST(year(taken_at) AS INTEGER), 7, 14), CAST(taken_at AS DATE))) <= 3"""
)
def days_around(spark, sf_dir):
    return curation.same_day(items(spark, sf_dir), date(1999, 7, 14), 3).select("id")


def _ruled(spark, sf_dir):
    i = items(spark, sf_dir).withColumnRenamed("id", "item")
    return i.withColumns({"camera": F.concat(F.lit("Make "), "status"), "lens": F.lit("L_1"), "focal": F.col("pixels").cast("double"), "aperture": F.col("pixels") / 10, "iso": F.col("pixels") * 10, "format": F.lit(None).cast("string")})


@query(
    f"""WITH {ITEMS}, {LINKS}, {TAGS} SELECT id FROM items WHERE taken_at >= TIMESTAMP '1997-01-01' AND taken_at <= TIMESTAMP '1997-08-01 10:00:00' AND lower(name) LIKE '%.jpg'
    AND pixels >= 10 AND pixels / 10.0 <= 8 AND pixels * 10 BETWEEN 100 AND 900 AND 'make ' || lower(status) LIKE '%ke o%'
    AND (SELECT count(*) FROM links l JOIN tags t ON t.id = l.tag WHERE l.item = items.id AND t.name IN ('red widget', 'blue bolt', 'no such name')) >= 1"""
)
def smart_album(spark, sf_dir):
    doc = {
        "rules": [
            {"type": "dateRange", "preset": rules.THIS_YEAR}, {"type": "fileFormat", "value": "JPG"}, {"type": "focalLength", "operator": ">=", "value": 10},
            {"type": "aperture", "operator": "<=", "value": 8}, {"type": "iso", "operator": rules.RANGE, "value": 100, "max": 900}, {"type": "cameraModel", "operator": rules.CONTAINS, "value": "KE o"},
            {"type": "tags", "value": ["red widget", "blue bolt", "no such name"], "operator": rules.ANY},
        ]
    }
    t = tags(spark, sf_dir).select(F.col("id").alias("tag"), "name")
    return rules.evaluate(_ruled(spark, sf_dir), links(spark, sf_dir), t, doc, datetime(1997, 8, 1, 10)).select(F.col("item").alias("id"))


@query(
    f"""WITH {LINKS}, {TAGS}, w AS (SELECT id FROM tags WHERE name IN ('red widget', 'blue bolt', 'no such name') AND id IN ('p:1', 'p:2', 'p:3', 'p:4', 'p:5', 'p:6', 'p:7', 'p:8', 'p:9', 'p:10', 'p:11', 'p:12'))
    SELECT item FROM links JOIN w ON id = tag GROUP BY item HAVING count(DISTINCT tag) >= (SELECT count(*) FROM w)"""
)
def smart_album_all_tags(spark, sf_dir):
    doc = {"rules": [{"type": "tags", "value": ["red widget", "blue bolt", "no such name"], "operator": rules.ALL}]}
    t = tags(spark, sf_dir).select(F.col("id").alias("tag"), "name").where("tag in ('p:1', 'p:2', 'p:3', 'p:4', 'p:5', 'p:6', 'p:7', 'p:8', 'p:9', 'p:10', 'p:11', 'p:12')")
    return rules.evaluate(_ruled(spark, sf_dir), links(spark, sf_dir), t, doc, datetime(1997, 8, 1)).select("item")


@query(
    f"""WITH a AS (SELECT page_id AS id FROM pages WHERE url LIKE '%/en/%'), b AS (SELECT page_id AS id FROM pages WHERE url LIKE '%blog%')
    SELECT id, 0 AS source FROM a UNION ALL SELECT id, 1 FROM b WHERE id NOT IN (SELECT id FROM a)"""
)
def union_with_precedence(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return ranking.with_precedence(p.where("url like '%/en/%'").select("id"), p.where("url like '%blog%'").select("id"), key="id")


@query("SELECT p_partkey FROM part WHERE (p_name LIKE 'red%' OR p_name LIKE '% red%') AND (p_name LIKE 'wid%' OR p_name LIKE '% wid%')")
def prefix_search(spark, sf_dir):
    return ranking.prefix_search(table(spark, sf_dir, "part"), ["RED", "wid"], "p_partkey", ["p_name"])


def _words(spark, sf_dir, name, key, columns):
    """An index of a table's tokens, taken in by two additions, the second of which has the rows of the first again."""
    rows = table(spark, sf_dir, name)
    index = fulltext.TokenIndex(spark, f"{shared_dir(spark)}/words-{uuid.uuid4().hex}", key, columns)
    index.add(rows.where(F.pmod(F.xxhash64(key), F.lit(3)) > 0))
    index.add(rows)
    return index


@query("SELECT p_partkey FROM part WHERE (p_name LIKE 'red%' OR p_name LIKE '% red%') AND (p_name LIKE 'wid%' OR p_name LIKE '% wid%')")
def indexed_prefixes(spark, sf_dir):
    return _words(spark, sf_dir, "part", "p_partkey", ["p_name"]).search(["RED", "wid"])


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])than') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])onhe') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])t')")
def indexed_texts(spark, sf_dir):
    return _words(spark, sf_dir, "documents", "doc_id", ["text"]).search(["t", "than", "ONHE"])


@query(
    "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) WHERE contains(lower(name), 're') ORDER BY CASE WHEN starts_with(lower(name), 're') THEN 0 ELSE 1 END, length(name), name LIMIT 10"
)
def typeahead(spark, sf_dir):
    return tagging.typeahead(table(spark, sf_dir, "part"), "Re", 10, "p_name")


@query("SELECT DISTINCT c_name FROM customer WHERE starts_with(c_name, 'Customer#00000012') ORDER BY c_name LIMIT 8")
def by_prefix(spark, sf_dir):
    return tagging.by_prefix(table(spark, sf_dir, "customer"), "Customer#00000012", 8, "c_name")


@query(
    f"""WITH {ITEMS}, x AS (SELECT id, name, taken_at, status, row_number() OVER (PARTITION BY folder ORDER BY id) AS i FROM items)
    SELECT id, strftime(taken_at, '%Y%m%d') || '_' || status || '_' || lpad(CAST(i AS VARCHAR), 3, '0') || '.jpg' AS new_name FROM x"""
)
def batch_rename(spark, sf_dir):
    from pyspark.sql import Window as W

    x = items(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("folder").orderBy("id")))
    return x.select("id", rename("{yyyy}{mm}{dd}_{status}_{index:3}{ext}", F.col("name"), F.col("i"), F.col("taken_at"), {"status": F.col("status")}).alias("new_name"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'app:/' || substr(url, length('https://m.') + 1) ELSE url END AS path FROM pages")
def prefix_rewrite(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https://m\.", "https://m./").alias("path"))
    moved = p.withColumn("path", replace_prefix(F.col("path"), "https://m.", "app:"))
    return moved


@query(
    """WITH c AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 256 AS INTEGER) AS r, CAST(c_custkey * 101 % 256 AS INTEGER) AS g, CAST(c_nationkey * 10 AS INTEGER) AS b FROM customer)
    SELECT id, CAST(least((r-200)*(r-200)+(g-40)*(g-40)+(b-30)*(b-30), (r-10)*(r-10)+(g-120)*(g-120)+(b-200)*(b-200)) AS DOUBLE) AS distance FROM c
    WHERE least((r-200)*(r-200)+(g-40)*(g-40)+(b-30)*(b-30), (r-10)*(r-10)+(g-120)*(g-120)+(b-200)*(b-200)) < 10000"""
)
def colour_match(spark, sf_dir):
    own = F.struct((F.col("c_custkey") * 37 % 256).cast("int").alias("r"), (F.col("c_custkey") * 101 % 256).cast("int").alias("g"), (F.col("c_nationkey") * 10).cast("int").alias("b"))
    palette = F.array(colour.hex_to_rgb(F.lit("#c8281e")), colour.hex_to_rgb(F.lit("0a78c8")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), colour.palette_distance(own, palette).alias("distance"))
    return c.where(F.col("distance") < colour.NEAR)


@query(
    f"""WITH {LINKS} SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT item FROM links WHERE origin = 'auto')) AS tagged,
    (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT item FROM links WHERE origin = 'auto')) AS untagged"""
)
def auto_tag_coverage(spark, sf_dir):
    return tagging.tagging_coverage(items(spark, sf_dir).withColumnRenamed("id", "item"), links(spark, sf_dir), origin="auto")


@query(
    f"""WITH {LINKS}, {TAGS}, many AS (SELECT item FROM links GROUP BY item HAVING count(*) FILTER (tag IN ('p:1', 'p:2')) > 0 OR count(*) FILTER (tag IN ('p:3', 'p:4', 'p:5', 'p:6')) >= 2),
    one AS (SELECT item, min(tag) AS tag FROM links JOIN tags ON tags.id = tag WHERE parent_id = (SELECT parent_id FROM tags WHERE id = 'p:1') GROUP BY item HAVING count(*) = 1)
    SELECT tag, count(*) AS n_items FROM one WHERE item IN (SELECT item FROM many) GROUP BY tag"""
)
def named_once_of_several(spark, sf_dir):
    t = tags(spark, sf_dir).select(F.col("id").alias("tag"), F.col("parent_id").alias("parent"))
    root = t.where("tag = 'p:1'").first()["parent"]
    return tagging.audit_named(links(spark, sf_dir), t, ["p:1", "p:2"], ["p:3", "p:4", "p:5", "p:6"], root)


@query(
    f"WITH {LINKS}, {TAGS} SELECT id AS tag, count(DISTINCT item) AS n_items FROM tags LEFT JOIN links ON tag = id WHERE parent_id LIKE 'b:SMALL/%' GROUP BY id"
)
def role_counts(spark, sf_dir):
    roles = tags(spark, sf_dir).where("parent_id like 'b:SMALL/%'").select(F.col("id").alias("tag"))
    return tagging.role_counts(roles, links(spark, sf_dir))


@query(
    f"""WITH {LINKS}, {TAGS}, d AS (SELECT DISTINCT item, name FROM links JOIN tags ON id = tag), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY name) AS i FROM d)
    SELECT item, string_agg(name, ',' ORDER BY name) AS names FROM r WHERE i <= 3 GROUP BY item"""
)
def tag_names(spark, sf_dir):
    t = tags(spark, sf_dir).select(F.col("id").alias("tag"), "name")
    return tagging.names_of(links(spark, sf_dir).join(t, "tag"))


@query(
    f"""WITH {LINKS}, old AS (SELECT item, tag, max(confidence) AS confidence FROM links WHERE origin = 'manual' GROUP BY item, tag),
    new AS (SELECT item, tag, max(confidence) AS confidence FROM links WHERE origin = 'auto' AND confirmed GROUP BY item, tag)
    SELECT item, tag, 'manual' AS origin, confidence FROM old WHERE (item, tag) NOT IN (SELECT (item, tag) FROM new) UNION ALL SELECT item, tag, 'auto', confidence FROM new"""
)
def tag_upsert(spark, sf_dir):
    l = links(spark, sf_dir)  # noqa: E741
    old = l.where("origin = 'manual'").groupBy("item", "tag", "origin").agg(F.max("confidence").alias("confidence"))
    return tagging.upsert_links(old, l.where("origin = 'auto' and confirmed"))


@query(
    f"""WITH {LINKS}, old AS (SELECT DISTINCT item, tag, confirmed FROM links WHERE origin = 'manual'), new AS (SELECT DISTINCT item, tag FROM links WHERE origin = 'auto'),
    kept AS (SELECT * FROM old WHERE confirmed OR item NOT IN (SELECT item FROM new))
    SELECT item, tag, confirmed FROM kept UNION ALL SELECT item, tag, false FROM new WHERE (item, tag) NOT IN (SELECT (item, tag) FROM kept)"""
)
def retag(spark, sf_dir):
    l = links(spark, sf_dir)  # noqa: E741
    new = l.where("origin = 'auto'").select("item", "tag").distinct()
    return tagging.retag(l.where("origin = 'manual'").select("item", "tag", "confirmed").distinct(), new, new)


@query(
    f"""WITH {ITEMS}, a AS (SELECT id AS item, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS place FROM items WHERE folder = 7),
    n AS (SELECT id AS item FROM items WHERE folder IN (7, 8) AND id NOT IN (SELECT item FROM a))
    SELECT item, place FROM a UNION ALL SELECT item, CAST((SELECT coalesce(max(place), -1) FROM a) + row_number() OVER (ORDER BY item) AS INTEGER) FROM n"""
)
def album_append(spark, sf_dir):
    from pyspark.sql import Window as W

    i = items(spark, sf_dir).withColumnRenamed("id", "item")
    a = i.where("folder = 7").select("item", (F.row_number().over(W.orderBy("item")) - 1).alias("place"))
    return tagging.add_to_album(a, i.where("folder in (7, 8)"))


@query(
    """SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'size' WHEN p_name LIKE '%bolt' THEN 'fastener' WHEN p_name LIKE 'red%' THEN 'colour' ELSE 'other' END AS category FROM part"""
)
def tag_category(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    by_type = tagging.category(F.col("p_type"), {"size": ["SMALL", "MEDIUM"]}, [], "")
    by_name = tagging.category(F.col("p_name"), {}, [("fastener", "bolt$"), ("colour", "^red")])
    return p.select("p_partkey", F.when(by_type != "", by_type).otherwise(by_name).alias("category"))


@query("SELECT p_partkey FROM part WHERE p_size / 100.0 >= CASE p_type WHEN 'SMALL' THEN 0.15 WHEN 'LARGE' THEN 0.41 END")
def above_threshold(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"), (F.col("p_size") / 100.0).alias("score"))
    return tagging.above_threshold(p, {"SMALL": 0.15, "LARGE": 0.41}).select("p_partkey")
