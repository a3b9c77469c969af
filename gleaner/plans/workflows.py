"""Queries of searches and workflows put together: palettes, look-ups, cleanup plans, edits of sequences and tags."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gleaner.functions.metadata import capture
from gleaner.functions.text import focal_range, shutter_seconds
from gleaner.operators import cleanup, curation, hierarchy, palettes, search, sequences, similarity, tags as tagging
from gleaner.plans.adapters import CLOSED, FRAMES, HASHES, ITEMS, LINKS, TAGS, frames, hashes, items, links, tags
from gleaner.plans.near import STARS, TEXT, MEMBERS, _groups
from gleaner.plans.registry import query
from gleaner.plans.retrieval import CUT, EVIDENCE, _evidence
from gleaner.session import table
from gleaner.sources import files

COLOURS = "colours AS (SELECT CAST(l_suppkey * 37 % 200 AS INTEGER) AS r, CAST(l_linenumber * 40 % 256 AS INTEGER) AS g, CAST(l_suppkey % 7 * 30 AS INTEGER) AS b FROM lineitem)"


@query(f"WITH {COLOURS} SELECT r, g, b, count(*) AS n FROM colours GROUP BY r, g, b ORDER BY n DESC, r, g, b LIMIT 1")
def most_used_colour(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select((F.col("l_suppkey") * 37 % 200).cast("int").alias("r"), (F.col("l_linenumber") * 40 % 256).cast("int").alias("g"), (F.col("l_suppkey") % 7 * 30).cast("int").alias("b"))
    return palettes.merged_palette(c, 1).select("r", "g", "b", "n")


@query()
def merged_palette(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select((F.col("l_suppkey") * 37 % 200).cast("int").alias("r"), (F.col("l_linenumber") * 40 % 256).cast("int").alias("g"), (F.col("l_suppkey") % 7 * 30).cast("int").alias("b"))
    return palettes.merged_palette(c)


def _palettes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    one = lambda k: F.struct((F.col("c_custkey") * k % 256).cast("int").alias("r"), (F.col("c_custkey") * 11 % 256).cast("int").alias("g"), (F.col("c_nationkey") * 10).cast("int").alias("b"), (F.col("c_nationkey") / 25.0 * k / 50).alias("saturation"))
    return c.select(F.col("c_custkey").alias("id"), F.array(one(37), one(41)).alias("palette"))


_PAL = "pal AS (SELECT c_custkey AS id, unnest([c_custkey * 37 % 256, c_custkey * 41 % 256]) AS r, c_custkey * 11 % 256 AS g, c_nationkey * 10 AS b, unnest([c_nationkey / 25.0 * 37 / 50, c_nationkey / 25.0 * 41 / 50]) AS s FROM customer)"
_HUES = "(0, 255, 64, 0), (1, 255, 191, 0), (2, 191, 255, 0), (3, 64, 255, 0), (4, 0, 255, 64), (5, 0, 255, 191), (6, 0, 191, 255), (7, 0, 64, 255), (8, 64, 0, 255), (9, 191, 0, 255), (10, 255, 0, 191), (11, 255, 0, 64)"


@query(
    f"""WITH {_PAL}, h(bucket, tr, tg, tb) AS (VALUES {_HUES})
    SELECT bucket, count(DISTINCT id) FILTER ((r - tr) * (r - tr) + (g - tg) * (g - tg) + (b - tb) * (b - tb) < 10000) AS n FROM h CROSS JOIN pal GROUP BY bucket"""
)
def hue_counts(spark, sf_dir):
    return palettes.hue_counts(_palettes(spark, sf_dir), "palette")


@query(f"WITH {_PAL} SELECT count(DISTINCT id) FILTER (s >= 0.6) AS vivid, count(DISTINCT id) FILTER (s >= 0.25 AND s < 0.6) AS moderate, count(DISTINCT id) FILTER (s < 0.25) AS muted FROM pal")
def saturation_counts(spark, sf_dir):
    return palettes.saturation_counts(_palettes(spark, sf_dir), "palette")


def _named_links(spark, sf_dir):
    t = tags(spark, sf_dir).select(F.col("id").alias("tag"), "name")
    return links(spark, sf_dir).join(t, "tag").select("item", "name", (F.col("origin") == "manual").alias("trusted"), "confidence")


@query(
    f"""WITH {ITEMS}, {LINKS}, {TAGS}, live AS (SELECT * FROM items WHERE deleted_at IS NULL),
    t AS (SELECT DISTINCT item FROM links JOIN tags ON tags.id = tag WHERE origin = 'manual' AND contains(lower(tags.name), 'urgent') AND item IN (SELECT id FROM live)),
    n AS (SELECT id AS item FROM live WHERE name LIKE '%-URGENT%')
    SELECT item, CAST(source AS INTEGER) AS source FROM (SELECT item, 0 AS source FROM t UNION ALL SELECT item, 1 FROM n WHERE item NOT IN (SELECT item FROM t)) ORDER BY source, item LIMIT 12"""
)
def quick_search(spark, sf_dir):
    live = items(spark, sf_dir).where("deleted_at is null").withColumnRenamed("id", "item")
    return search.quick(live, _named_links(spark, sf_dir), "urgent", "item", ["name"])


def _searched(spark, sf_dir):
    rgb = F.struct((F.col("id") * 37 % 256).cast("int").alias("r"), (F.col("id") * 101 % 256).cast("int").alias("g"), (F.col("folder") % 256).cast("int").alias("b"))
    return items(spark, sf_dir).withColumn("palette", F.array(rgb)).withColumnRenamed("id", "item")


@query(
    f"""WITH {ITEMS}, d AS (SELECT id AS item, CAST((id * 37 % 256 - 200) ** 2 + (id * 101 % 256 - 40) ** 2 + (folder % 256 - 30) ** 2 AS DOUBLE) AS d FROM items WHERE deleted_at IS NULL AND n_bytes <= 20000000)
    SELECT item, round(1 - sqrt(d) / 100, 9) AS score FROM d WHERE d < 10000"""
)
def search_by_colour(spark, sf_dir):
    r = search.Request(colour="#c8281e", ranges={"n_bytes": (None, 20_000_000)})
    return search.compound(_searched(spark, sf_dir), _named_links(spark, sf_dir), r, date(1998, 1, 1)).select("item", F.round("score", 9).alias("score"))


@query(f"WITH {ITEMS} SELECT id AS item FROM items WHERE deleted_at IS NULL AND regexp_full_match(lower(name), '3-.*/1.*3\\.jpg') AND year(taken_at) = 1997")
def search_by_glob(spark, sf_dir):
    r = search.Request(text="3-*/1*3.jpg 1997")
    return search.compound(_searched(spark, sf_dir), _named_links(spark, sf_dir), r, date(1998, 1, 1)).select("item")


@query(
    f"""WITH {ITEMS}, {LINKS}, {TAGS}, live AS (SELECT id AS item FROM items WHERE deleted_at IS NULL AND year(taken_at) = 1996),
    h AS (SELECT item, CASE WHEN lower(name) = 'red bolt' THEN 1.25 ELSE 1.0 END AS w FROM links JOIN tags ON tags.id = tag WHERE origin = 'manual' AND contains(lower(name), 'red bolt'))
    SELECT item, CAST(max(w) AS DOUBLE) AS score FROM h WHERE item IN (SELECT item FROM live) GROUP BY item"""
)
def search_by_text(spark, sf_dir):
    return search.compound(_searched(spark, sf_dir), _named_links(spark, sf_dir), search.Request(text="red bolt 1996"), date(1998, 1, 1))


@query(f"WITH {ITEMS} SELECT id AS item FROM items WHERE deleted_at IS NULL AND pixels BETWEEN 90 AND 95")
def search_by_filters(spark, sf_dir):
    r = search.Request(ranges={"pixels": (90, 95)})
    return search.compound(_searched(spark, sf_dir), _named_links(spark, sf_dir), r, date(1998, 1, 1)).select("item")


@query(
    f"""WITH {EVIDENCE}, {CUT} SELECT item FROM sel WHERE is_strong UNION SELECT p_partkey FROM part WHERE p_name LIKE 'blue bolt%'"""
)
def search_with_vectors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("taken_at"))
    none = _named_links(spark, sf_dir).limit(0)
    return search.compound(p, none, search.Request(text="blue bolt", semantic=_evidence(spark, sf_dir)), date(1998, 1, 1)).select("item")


def _facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.lit(None).cast("timestamp").alias("deleted_at"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("content_hash"), F.lit(1).alias("revision"), F.lit(None).cast("string").alias("batch"))


def _plan(spark, sf_dir):
    _, groups, _ = _groups(spark, sf_dir)
    d = groups.select("component", "id", F.when(F.col("id") == F.col("component"), "KEEP").otherwise("DELETE").alias("decision"))
    facts = _facts(spark, sf_dir)
    return cleanup.plan(groups, d, facts), facts


PLAN = f"{TEXT}, {STARS}, {MEMBERS}, plan AS (SELECT component, id, CASE WHEN id = component THEN 'KEEP' ELSE 'DELETE' END AS decision FROM members)"


@query(f"WITH {PLAN} SELECT component, plan.id, decision, CAST(strlen(text) AS BIGINT) AS n_bytes FROM plan JOIN documents ON doc_id = plan.id")
def cleanup_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("component", "id", "decision", "n_bytes")


@query(f"WITH {PLAN} SELECT component, id, 'changed' AS reason FROM plan WHERE id % 11 = 0")
def stale_plan_items(spark, sf_dir):
    p, facts = _plan(spark, sf_dir)
    return cleanup.stale(p, facts.withColumn("revision", F.when(F.col("id") % 11 == 0, 2).otherwise(1)))


@query(f"WITH {PLAN}, bad AS (SELECT component FROM plan WHERE id % 11 = 0) SELECT id FROM plan WHERE decision = 'DELETE' AND component NOT IN (SELECT component FROM bad)")
def executed_plan(spark, sf_dir):
    p, facts = _plan(spark, sf_dir)
    now = facts.withColumn("revision", F.when(F.col("id") % 11 == 0, 2).otherwise(1))
    return cleanup.execute(p, now, "b1", "2024-01-01").where("batch = 'b1' and deleted_at is not null").select("id")


@query(f"WITH {PLAN} SELECT (SELECT count(*) FROM documents) AS n, count(*) AS deleted FROM plan WHERE decision = 'DELETE' AND component % 2 = 1")
def restored_plan(spark, sf_dir):
    p, facts = _plan(spark, sf_dir)
    one = cleanup.execute(p.where("component % 2 = 0"), facts, "b1", "2024-01-01")
    back = cleanup.restore(cleanup.execute(p.where("component % 2 = 1"), one, "b2", "2024-01-02"), "b1")
    return back.agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))


def _members(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("sequence"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item"), (F.col("turn") * 10 + F.col("conv_id")).alias("at"), F.col("turn").cast("int").alias("position"))


MEMBERS2 = "m AS (SELECT conv_id AS sequence, conv_id * 1000 + turn AS item, turn * 10 + conv_id AS t, CAST(turn AS INTEGER) AS position FROM conversations)"


@query(
    f"WITH {MEMBERS2} SELECT sequence, item, position FROM m WHERE sequence NOT IN (0, 1) UNION ALL SELECT 9999, item, CAST(row_number() OVER (ORDER BY t, item) - 1 AS INTEGER) FROM m WHERE sequence IN (0, 1)"
)
def merged_sequences(spark, sf_dir):
    m = _members(spark, sf_dir)
    s = m.groupBy(F.col("sequence").alias("id")).agg(F.count("*").alias("n_frames")).withColumns({"folder": F.lit(1), "kind": F.lit("burst")})
    return sequences.merge_two(s, m, 0, 1, 9999)


@query(
    f"""WITH {MEMBERS2}, big AS (SELECT min(sequence) AS s FROM (SELECT sequence FROM m GROUP BY 1 HAVING count(*) >= 5)), p AS (SELECT item, row_number() OVER (ORDER BY position, item) - 1 AS p FROM m WHERE sequence = (SELECT s FROM big))
    SELECT sequence, item, position FROM m WHERE sequence <> (SELECT s FROM big) UNION ALL SELECT CASE WHEN p < 2 THEN 9001 ELSE 9002 END, item, CAST(CASE WHEN p < 2 THEN p ELSE p - 2 END AS INTEGER) FROM p"""
)
def split_sequence(spark, sf_dir):
    m = _members(spark, sf_dir)
    one = m.groupBy("sequence").agg(F.count("*").alias("n")).where("n >= 5").agg(F.min("sequence")).first()[0]
    return sequences.split_at(m, one, 2, 9001, 9002)


@query(f"WITH {ITEMS} SELECT id, CAST(id % 5 AS INTEGER) AS place FROM items WHERE folder = 7 ORDER BY id % 5, taken_at DESC, id")
def album_listing(spark, sf_dir):
    i = items(spark, sf_dir).withColumnRenamed("id", "item")
    members = i.where("folder = 7").select("item", (F.col("item") % 5).cast("int").alias("place"))
    return curation.album(i, members).select(F.col("item").alias("id"), "place")


@query(f"WITH {ITEMS}, {LINKS} SELECT DISTINCT id AS item FROM items JOIN links ON item = id WHERE deleted_at IS NULL AND tag = 'p:5' ORDER BY id LIMIT 3000")
def items_of_tag(spark, sf_dir):
    return tagging.items_of_tag(links(spark, sf_dir), items(spark, sf_dir).withColumnRenamed("id", "item"), "p:5").select("item")


@query(
    f"""WITH RECURSIVE {TAGS}, {CLOSED}, {ITEMS}, {LINKS}, mem AS (SELECT id AS item FROM items WHERE folder = 7), fresh AS (SELECT item, tag FROM mem CROSS JOIN (VALUES ('p:3'), ('p:4')) v(tag) WHERE (item, tag) NOT IN (SELECT (item, tag) FROM links)),
    a AS (SELECT DISTINCT item, ancestor FROM fresh JOIN closed ON node = tag), b AS (SELECT DISTINCT item, ancestor FROM links JOIN closed ON node = tag WHERE item IN (SELECT item FROM mem))
    SELECT ancestor AS node, count(*) AS gained FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY ancestor"""
)
def named_group_gains(spark, sf_dir):
    over = hierarchy.closure(tags(spark, sf_dir))  # all tags: the members' other links count too
    mem = items(spark, sf_dir).where("folder = 7").select(F.col("id").alias("item"))
    return tagging.name_group(links(spark, sf_dir), over, mem, ["p:3", "p:4"])[1]


@query(
    f"""WITH {HASHES}, f AS (SELECT id AS item, 'l' || CAST(label AS VARCHAR) AS tag, (id % 90) / 100.0 AS s FROM hashes), top AS (SELECT tag FROM (SELECT tag, count(*) AS n FROM f GROUP BY tag ORDER BY n DESC, tag LIMIT 4)),
    r AS (SELECT item, tag, s, row_number() OVER (PARTITION BY tag ORDER BY s DESC, item) AS k FROM f WHERE tag IN (SELECT tag FROM top)) SELECT item, tag, 'auto' AS origin, floor(s * 10000 + 0.5) / 10000 AS confidence FROM r WHERE k <= 20 AND item % 3 > 0"""
)
def proposals(spark, sf_dir):
    f = hashes(spark, sf_dir).select(F.col("id").alias("item"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("tag"), (F.col("id") % 90 / 100.0).alias("similarity"))
    return tagging.proposals(f, f.groupBy("tag").agg(F.count("*").alias("n")), f.where("item % 3 = 0"), 4, 20)


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(epoch_us(date_trunc('second', ts)) // 1000 + CAST(lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS INTEGER) AS BIGINT) END AS captured_ms, CASE WHEN event_id % 7 > 0 THEN event_id % 7 END AS frame, CASE WHEN event_id % 2 = 0 THEN 'b' || event_id END AS burst, event_type IN ('click', 'view') AS continuous FROM events")
def capture_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.create_map(
        F.lit("EXIF:DateTimeOriginal"), F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")), F.lit("SubSec-Time-Original"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
        F.lit("SequenceNumber"), (F.col("event_id") % 7).cast("string"), F.lit("Drive Mode"), F.when(F.col("event_type") == "click", "Continuous").when(F.col("event_type") == "view", "HIGH-Speed").otherwise("On"),
        F.lit("Maker:BurstIdentifier"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("b"), F.col("event_id").cast("string"))), F.lit("BurstID"), F.lit("other"),
    )
    return e.select("event_id", capture(raw).alias("c")).select("event_id", "c.captured_ms", "c.frame", "c.burst", "c.continuous")


@query("SELECT p_partkey, 1.0 / p_size AS seconds, CAST(p_size AS DOUBLE) AS low, CAST(p_size + 20 AS DOUBLE) AS high FROM part")
def camera_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    focal = focal_range(F.concat(size, F.lit("-"), (F.col("p_size") + 20).cast("string"), F.lit(" mm")))
    return p.select("p_partkey", shutter_seconds(F.concat(F.lit("1/"), size, F.lit("s"))).alias("seconds"), focal["low"].alias("low"), focal["high"].alias("high"))


@query(
    f"""WITH {ITEMS}, {FRAMES}, {LINKS}, {TAGS}, asked AS (SELECT id FROM items WHERE favourite UNION SELECT item FROM frames WHERE iso > 3000),
    d AS (SELECT item AS id, min(camera) AS camera, max(iso) AS iso FROM frames GROUP BY item), n AS (SELECT item AS id, string_agg(DISTINCT name, ',' ORDER BY name) AS tags FROM links JOIN tags ON tags.id = tag WHERE origin = 'manual' GROUP BY item)
    SELECT i.id, n_bytes, camera, iso, coalesce(tags, '') AS tags FROM items i JOIN asked USING (id) LEFT JOIN d USING (id) LEFT JOIN n USING (id)"""
)
def exported_items(spark, sf_dir):
    i, f = items(spark, sf_dir), frames(spark, sf_dir)
    asked = i.where("favourite").select("id").unionByName(f.where("iso > 3000").select(F.col("item").alias("id")))  # with repeats
    details = f.groupBy(F.col("item").alias("id")).agg(F.min("camera").alias("camera"), F.max("iso").alias("iso"))
    named = links(spark, sf_dir).where("origin = 'manual'").join(tags(spark, sf_dir).select(F.col("id").alias("tag"), "name"), "tag").select(F.col("item").alias("id"), "name")
    return files.export_rows(asked, i.select("id", "n_bytes"), details, named).withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN folder % 10 = 3 THEN 'b7' END AS missing_batch FROM items")
def missing_files(spark, sf_dir):
    i = items(spark, sf_dir).select("id", "folder", F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.lit("b1").alias("missing_batch"))
    return files.missing_files(i, i.where("folder % 10 <> 3").select("path"), "b7").select("id", "missing_batch")


@query(f"WITH {ITEMS} SELECT count(*) AS n FROM items WHERE id NOT IN (SELECT id FROM items WHERE folder < 300)")
def inserted_if_absent(spark, sf_dir):
    i = items(spark, sf_dir)
    return files.new_rows(i.union(i), i.where("folder < 300"), "id").agg(F.count("*").alias("n"))


@query()
def split_clusters(spark, sf_dir):
    h = hashes(spark, sf_dir)
    edges = similarity.mutual(similarity.knn(h, h, 8, least=0.3))
    return similarity.split_large(edges, largest=20, start=0.3)


@query(
    f"""WITH {LINKS}, t AS (SELECT tag FROM links GROUP BY tag HAVING count(DISTINCT item) >= 4 ORDER BY md5('5:' || tag), tag LIMIT 1) SELECT DISTINCT item FROM links WHERE tag = (SELECT tag FROM t)"""
)
def theme_pick(spark, sf_dir):
    return curation.by_theme(links(spark, sf_dir), 5)
