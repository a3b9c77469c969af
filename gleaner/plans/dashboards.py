"""Queries of dashboards: profiles, histograms, series, calendars."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from gleaner.operators import dashboard, tags as tagging
from gleaner.plans.adapters import FEED, FRAMES, ITEMS, feed, frames, items
from gleaner.plans.registry import query
from gleaner.session import table

ISO = [("<=200", 200), ("201-800", 800), ("801-1600", 1600), ("1601-2400", 2400), (">2400", None)]
SHUTTER = [("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.05), ("e", 0.06), ("f", 0.07), ("g", None)]


@query("SELECT count(*) AS total, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS large FROM events")
def conditional_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("views"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("large"))


@query(
    """WITH d AS (SELECT nullif(l_returnflag, 'N') AS camera, CASE WHEN l_linestatus = 'F' THEN ' ' ELSE l_linestatus END AS lens, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS iso FROM lineitem)
    SELECT count(*) AS total, count(*) FILTER (camera IS NULL OR trim(camera) = '') AS missing_camera, count(*) FILTER (lens IS NULL OR trim(lens) = '') AS missing_lens, count(*) FILTER (iso IS NULL) AS missing_iso FROM d"""
)
def completeness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.select(
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("camera"),
        F.when(F.col("l_linestatus") == "F", " ").otherwise(F.col("l_linestatus")).alias("lens"),
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("iso"),
    )
    return dashboard.completeness(d, ["camera", "lens", "iso"])


@query(
    f"""WITH {ITEMS}, d AS (SELECT l_orderkey AS id, min(nullif(l_returnflag, 'N')) AS camera FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (camera IS NULL) AS missing_camera FROM items LEFT JOIN d USING (id)"""
)
def missing_with_absent_rows(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("camera"))
    return dashboard.completeness(items(spark, sf_dir).join(d, "id", "left"), ["camera"])


@query(f"WITH {FRAMES} SELECT floor(focal + 0.5) AS focal, count(*) AS n FROM frames GROUP BY 1 ORDER BY n DESC, focal LIMIT 50")
def top_rounded(spark, sf_dir):
    f = frames(spark, sf_dir).select(F.floor(F.col("focal") + 0.5).cast("double").alias("focal"))
    return f.groupBy("focal").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "focal").limit(50)


@query(
    f"""WITH {FRAMES}, b AS (SELECT CASE WHEN iso <= 200 THEN '<=200' WHEN iso <= 800 THEN '201-800' WHEN iso <= 1600 THEN '801-1600' WHEN iso <= 2400 THEN '1601-2400' ELSE '>2400' END AS bucket FROM frames)
    SELECT bucket, count(*) AS n FROM b GROUP BY bucket"""
)
def iso_histogram(spark, sf_dir):
    return dashboard.bucket_counts(frames(spark, sf_dir), F.col("iso"), ISO)


@query(
    """WITH b AS (SELECT CASE WHEN l_tax <= 0.01 THEN 'a' WHEN l_tax <= 0.02 THEN 'b' WHEN l_tax <= 0.03 THEN 'c' WHEN l_tax <= 0.05 THEN 'd' WHEN l_tax <= 0.06 THEN 'e' WHEN l_tax <= 0.07 THEN 'f' ELSE 'g' END AS bucket FROM lineitem),
    names AS (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g']) AS bucket) SELECT bucket, count(b.bucket) AS n FROM names LEFT JOIN b USING (bucket) GROUP BY bucket"""
)
def shutter_histogram(spark, sf_dir):
    return dashboard.bucket_counts(table(spark, sf_dir, "lineitem"), F.col("l_tax"), SHUTTER)


@query("SELECT CAST(h AS INTEGER) AS hour, (SELECT count(*) FROM events WHERE hour(ts) = h AND event_type = 'error') AS n FROM range(24) t(h)")
def dense_hours(spark, sf_dir):
    return dashboard.dense_hours(table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("ts"))


@query(f"WITH {ITEMS} SELECT strftime(taken_at, '%Y-%m') AS period, count(*) AS n FROM items GROUP BY 1")
def month_series(spark, sf_dir):
    return dashboard.series(items(spark, sf_dir), F.col("taken_at"), "yyyy-MM")


@query(f"WITH {FRAMES} SELECT min(taken_at)::DATE AS first_day, max(taken_at)::DATE AS last_day, floor(avg(iso) * 100 + 0.5) / 100 AS mean_iso FROM frames")
def min_max_mean(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.agg(F.min("taken_at").cast("date").alias("first_day"), F.max("taken_at").cast("date").alias("last_day"), (F.floor(F.avg("iso") * 100 + 0.5) / 100).alias("mean_iso"))


@query(
    """SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2"""
)
def distributions(spark, sf_dir):
    return dashboard.distributions(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT DISTINCT 'brand' AS field, p_brand AS value FROM part WHERE trim(p_brand) <> '' UNION ALL SELECT DISTINCT 'type', p_type FROM part WHERE trim(p_type) <> ''")
def candidate_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return dashboard.distributions(p, ["brand", "type"]).select("field", "value")


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))


@query(f"WITH {ITEMS} SELECT taken_at::DATE AS day, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT folder) >= 4")
def busy_days(spark, sf_dir):
    d = items(spark, sf_dir).groupBy(F.col("taken_at").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("folder").alias("k"))
    return d.where("n >= 8 and k >= 4").select("day", "n")


@query(f"WITH {ITEMS} SELECT count(*) AS n, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes FROM items WHERE deleted_at IS NOT NULL")
def trash_totals(spark, sf_dir):
    return items(spark, sf_dir).where("deleted_at is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other FROM events GROUP BY user_id")
def status_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.groupBy("user_id").agg(F.count_if(kind == "click").alias("click"), F.count_if(kind == "view").alias("view"), F.count_if(~kind.isin("click", "view")).alias("other"))


@query("SELECT arg_max(event_id, (ts, event_id)) AS event_id, epoch_us(max(ts)) // 1000 AS at FROM events WHERE event_type = 'error'")
def latest_row(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.unix_millis(F.max("ts").cast("timestamp")).alias("at"))


@query(
    """WITH n AS (SELECT p_partkey AS item, CAST(p_size % 4 + 1 AS VARCHAR) || CASE p_type WHEN 'SMALL' THEN 'boys' ELSE 'girls' END AS name FROM part WHERE p_size % 3 > 0
    UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'solo' ELSE 'multiple_boys' END FROM part WHERE p_size < 40),
    k AS (SELECT item, CASE WHEN name LIKE '%boys' THEN 'boy' WHEN name LIKE '%girls' THEN 'girl' ELSE '' END AS kind, max(CASE WHEN name LIKE 'multiple%' THEN 2 WHEN name = 'solo' THEN NULL ELSE CAST(name[1] AS INTEGER) END) AS n, bool_or(name = 'solo') AS solo FROM n GROUP BY 1, 2)
    SELECT item, CAST(CASE WHEN coalesce(sum(n), 0) > 0 THEN sum(n) WHEN bool_or(solo) THEN 1 ELSE 0 END AS BIGINT) AS persons FROM k GROUP BY item"""
)
def person_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_size % 3 > 0").select(F.col("p_partkey").alias("item"), F.concat((F.col("p_size") % 4 + 1).cast("string"), F.when(F.col("p_type") == "SMALL", "boys").otherwise("girls")).alias("name"))
    b = p.where("p_size < 40").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "solo").otherwise("multiple_boys"))
    return tagging.person_counts(a.union(b))


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, median(gap)::DOUBLE AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY user_id"""
)
def median_gap(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_millis(F.col("ts"))
    g = feed(spark, sf_dir).select("user_id", (at - F.lag(at).over(w)).alias("gap")).where("gap is not null")
    return g.groupBy("user_id").agg(F.median("gap").alias("median_gap"))


@query(f"WITH {ITEMS}, y AS (SELECT CAST(year(taken_at) AS INTEGER) AS year, count(*) AS n FROM items WHERE year(taken_at) NOT IN (1994, 1995, 1997) GROUP BY 1), w AS (SELECT year, lag(year) OVER (ORDER BY year) AS p FROM y) SELECT year AS first, year AS last, n FROM y UNION ALL SELECT CAST(p + 1 AS INTEGER), CAST(year - 1 AS INTEGER), 0 FROM w WHERE year > p + 1")
def years_with_gaps(spark, sf_dir):
    y = items(spark, sf_dir).groupBy(F.year("taken_at").alias("year")).agg(F.count("*").alias("n")).where("year not in (1994, 1995, 1997)")
    return dashboard.years_with_gaps(y)


@query(
    f"""WITH {ITEMS}, d AS (SELECT CAST(DATE '1998-06-30' - CAST(i AS INTEGER) AS DATE) AS day FROM range(365) t(i)), c AS (SELECT taken_at::DATE AS day, count(*) AS n FROM items GROUP BY 1), j AS (SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day))
    SELECT day, n, CAST(CASE WHEN n > 0 THEN ceil(4.0 * n / (SELECT max(n) FROM j)) ELSE 0 END AS INTEGER) AS level FROM j"""
)
def heat_map(spark, sf_dir):
    return dashboard.heat_map(items(spark, sf_dir), F.col("taken_at"), "1998-06-30")


@query(f"WITH {FRAMES}, c AS (SELECT focal, count(*) AS n FROM (SELECT floor(focal + 0.5) AS focal FROM frames) GROUP BY focal ORDER BY n DESC, focal LIMIT 4) SELECT focal, n FROM c")
def top_then_by_value(spark, sf_dir):
    c = frames(spark, sf_dir).groupBy(F.floor(F.col("focal") + 0.5).cast("double").alias("focal")).agg(F.count("*").alias("n"))
    return dashboard.top_then_by_value(c, "focal", "n", 4)


@query(
    f"""WITH {FRAMES}, s AS (SELECT unnest([1, 1.1, 1.2, 1.4, 1.6, 1.8, 2, 2.2, 2.5, 2.8, 3.2, 3.5, 4, 4.5, 5, 5.6, 6.3, 7.1, 8, 9, 10, 11, 13, 14, 16, 18, 20, 22, 25, 29, 32])::DOUBLE AS stop), a AS (SELECT DISTINCT aperture FROM frames),
    n AS (SELECT aperture, arg_min(stop, (abs(aperture - stop), stop)) AS stop FROM a CROSS JOIN s GROUP BY aperture)
    SELECT CASE WHEN abs(n.aperture - stop) <= n.aperture * 0.06 THEN stop ELSE n.aperture END AS stop, count(*) AS n FROM frames JOIN n USING (aperture) GROUP BY 1"""
)
def snapped_apertures(spark, sf_dir):
    return frames(spark, sf_dir).groupBy(dashboard.snap(F.col("aperture")).alias("stop")).agg(F.count("*").alias("n"))


@query("SELECT event_type, n, CAST(floor(100.0 * n / (SELECT count(*) FROM events) + 0.5) AS BIGINT) AS percent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def percent_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count("*").alias("total"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("event_type", "n", dashboard.coverage(F.col("n"), F.col("total")).alias("percent"))


@query(f"WITH {FEED} SELECT user_id, count(*) AS n FROM feed GROUP BY user_id ORDER BY n DESC, user_id LIMIT 8")
def top_items(spark, sf_dir):
    return feed(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(8)


@query(
    f"""WITH {FRAMES}, g AS (SELECT camera, CAST(count(*) FILTER (lens = 'F' AND focal <= 55) AS DOUBLE) AS covered, count(*) AS n, avg(iso * CASE camera WHEN 'N' THEN 2 ELSE 0.5 END) AS iso FROM frames GROUP BY camera),
    o AS (SELECT camera, focal * CASE camera WHEN 'A' THEN 0.5 ELSE 1 END AS focal, aperture - CASE camera WHEN 'R' THEN 3 ELSE 0 END AS aperture FROM frames),
    f AS (SELECT camera, arg_max(focal, (n, -focal)) AS focal FROM (SELECT camera, focal, count(*) AS n FROM o GROUP BY ALL) GROUP BY camera),
    a AS (SELECT camera, arg_max(aperture, (n, -aperture)) AS aperture FROM (SELECT camera, aperture, count(*) AS n FROM o GROUP BY ALL) GROUP BY camera),
    p AS (SELECT camera, focal, aperture, iso, floor(100 * covered / n + 0.5) AS coverage FROM g JOIN f USING (camera) JOIN a USING (camera))
    SELECT camera, place, rule, value FROM (
        SELECT camera, 1 AS place, CASE WHEN focal <= 35 THEN 'wideAngle' WHEN focal >= 85 THEN 'telephoto' ELSE 'standardFocal' END AS rule, focal AS value FROM p
        UNION ALL SELECT camera, 2, CASE WHEN aperture <= 2.8 THEN 'wideAperture' ELSE 'deepFocus' END, aperture FROM p WHERE aperture > 0 AND aperture <= 2.8 OR aperture >= 8
        UNION ALL SELECT camera, 3, 'highIso', floor(iso + 0.5) FROM p WHERE iso >= 1600 UNION ALL SELECT camera, 4, 'lowMetadataCoverage', coverage FROM p WHERE coverage < 50)"""
)
def guidance(spark, sf_dir):
    f = frames(spark, sf_dir)
    camera = F.col("camera")
    own = f.select("camera", (F.col("focal") * F.when(camera == "A", 0.5).otherwise(1.0)).alias("focal"), (F.col("aperture") - F.when(camera == "R", 3).otherwise(0)).alias("aperture"))
    top = lambda c: own.groupBy("camera", c).agg(F.count("*").alias("n")).groupBy("camera").agg(F.max_by(c, F.struct("n", (-F.col(c)).alias("low"))).alias(c))
    full = dashboard.coverage(F.count_if((F.col("lens") == "F") & (F.col("focal") <= 55)), F.count("*"))
    facts = f.groupBy("camera").agg(full.alias("coverage"), F.avg(F.col("iso") * F.when(camera == "N", 2).otherwise(0.5)).alias("iso"))
    return dashboard.guidance(facts.join(top("focal"), "camera").join(top("aperture"), "camera"), ["camera"])


@query("SELECT label, count(*) AS n, CAST(max(n_each) AS BIGINT) AS top FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n_each FROM embeddings) GROUP BY label")
def window_max(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return each.select("label", "n", F.col("n").alias("top"))


@query(
    """WITH h AS (SELECT c_custkey AS id, (c_custkey * 7) % 360 AS hue FROM customer) SELECT CAST(floor(hue / 10) % 36 AS INTEGER) AS bucket, count(*) AS n FROM h GROUP BY 1"""
)
def hue_buckets(spark, sf_dir):
    from gleaner.functions.colour import hue_bucket

    return table(spark, sf_dir, "customer").groupBy(hue_bucket((F.col("c_custkey") * 7) % 360).alias("bucket")).agg(F.count("*").alias("n"))
