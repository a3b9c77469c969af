"""Queries of ranked retrieval, ordered sequences, ratings and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import order, ranking, rating, sequences, tags as tagging
from gleaner.plans.adapters import FEED, HASHES, feed, hashes, items
from gleaner.plans.registry import query
from gleaner.session import table
from gleaner.sources import files
from gleaner.streaming import feeds

# Evidence for fusion: three prompts rank parts by different numbers.
EVIDENCE = """e AS (
    SELECT * FROM (SELECT p_partkey AS item, 0 AS prompt, 'whole-query' AS grp, 1.0 AS weight, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank, floor(p_retailprice / 2 + 0.5) / 10000 AS similarity FROM part WHERE p_size < 20)
    UNION ALL SELECT * FROM (SELECT p_partkey, 1, 'part', 0.7, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS rank, p_size / 400.0 FROM part WHERE p_type = 'SMALL')
    UNION ALL SELECT * FROM (SELECT p_partkey, 2, 'part', 0.5, row_number() OVER (ORDER BY p_partkey) - 1 AS rank, (p_partkey % 100) / 800.0 FROM part WHERE p_type = 'LARGE')),
    g AS (SELECT item, grp, max(weight / (60 + rank + 1)) AS score, max(similarity) AS similarity, max(CASE WHEN prompt = 0 THEN similarity END) AS own FROM e GROUP BY item, grp),
    fused AS (SELECT item, sum(score) AS rank_score, floor(max(similarity) * 10000 + 0.5) / 10000 AS similarity, floor(coalesce(max(own), max(similarity)) * 10000 + 0.5) / 10000 AS primary_similarity, count(*) AS n_groups, bool_or(grp = 'whole-query') AS has_whole FROM g GROUP BY item)"""


def _evidence(spark, sf_dir):
    p = table(spark, sf_dir, "part")

    def one(rows, prompt, grp, weight, by, similarity):
        return rows.select(F.col("p_partkey").alias("item"), F.lit(prompt).alias("prompt"), F.lit(grp).alias("grp"), F.lit(weight).alias("weight"), by.cast("double").alias("by"), similarity.alias("similarity"))

    a = one(p.where("p_size < 20"), 0, "whole-query", 1.0, -F.col("p_retailprice"), F.floor(F.col("p_retailprice") / 2 + 0.5) / 10000)
    b = one(p.where("p_type = 'SMALL'"), 1, "part", 0.7, -F.col("p_size"), F.col("p_size") / 400.0)
    c = one(p.where("p_type = 'LARGE'"), 2, "part", 0.5, F.lit(0), (F.col("p_partkey") % 100) / 800.0)
    return order.placed(a.union(b).union(c), "prompt", ["by", "item"])


def _shown(df, *columns):
    """Scores to nine decimals, so that the order of a sum does not show."""
    return df.select(*(F.round(c, 9).alias(c) if c in ("rank_score", "score") else F.col(c) for c in columns))


@query(f"WITH {EVIDENCE} SELECT item, round(rank_score, 9) AS rank_score, similarity, primary_similarity, n_groups, has_whole FROM fused")
def rank_fusion(spark, sf_dir):
    return _shown(ranking.fuse(_evidence(spark, sf_dir)), "item", "rank_score", "similarity", "primary_similarity", "n_groups", "has_whole")


@query(f"WITH {EVIDENCE} SELECT item, round(rank_score, 9) AS rank_score, similarity, primary_similarity, n_groups, has_whole FROM fused")
def rank_fusion_of_whole_lists(spark, sf_dir):
    return _shown(ranking.fuse(_evidence(spark, sf_dir)), "item", "rank_score", "similarity", "primary_similarity", "n_groups", "has_whole")


@query(
    f"""WITH {EVIDENCE}, n AS (SELECT p_partkey AS item, max(1.0 / (61 + r)) AS ns, greatest(max(s), 0) AS nv FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS r, p_size / 100.0 AS s FROM part WHERE p_size > 10) GROUP BY 1)
    SELECT item, round(rank_score - 0.25 * coalesce(ns, 0), 9) AS rank_score, floor(greatest(0, similarity - 0.25 * coalesce(nv, 0)) * 10000 + 0.5) / 10000 AS similarity FROM fused LEFT JOIN n USING (item)"""
)
def negative_penalty(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 10").withColumn("list", F.lit(0))
    n = order.placed(p, "list", ["p_brand", "p_partkey"]).select(F.col("p_partkey").alias("item"), "rank", (F.col("p_size") / 100.0).alias("similarity"))
    return _shown(ranking.penalise(ranking.fuse(_evidence(spark, sf_dir)), n), "item", "rank_score", "similarity")


GAP = """t AS (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS i, lead(s) OVER (ORDER BY s DESC) AS nx, max(s) OVER () - min(s) OVER () AS span, count(*) OVER () AS n FROM (SELECT s FROM scores WHERE s IS NOT NULL ORDER BY s DESC LIMIT 100)),
    gap AS (SELECT CASE WHEN max(n) >= 6 AND max(s - nx) >= 0.006 AND max(s - nx) >= max(span) * 0.12 THEN arg_max((s + nx) / 2, (s - nx, -i)) END AS cutoff FROM t WHERE i >= 4 AND nx IS NOT NULL)"""


@query(f"WITH scores AS (SELECT CASE WHEN o_orderkey < 9 THEN 0.9 - o_orderkey * 0.001 ELSE 0.6 - (o_orderkey % 5000) * 0.0001 END AS s FROM orders), {GAP} SELECT round(cutoff, 9) AS cutoff FROM gap")
def score_gap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.select(F.when(F.col("o_orderkey") < 9, 0.9 - F.col("o_orderkey") * 0.001).otherwise(0.6 - (F.col("o_orderkey") % 5000) * 0.0001).alias("s"))
    return ranking.gap_cutoff(s, "s").select(F.round("cutoff", 9).alias("cutoff"))


CUT = f"""scores AS (SELECT primary_similarity AS s FROM fused), {GAP},
    lim AS (SELECT greatest(0.05, max(primary_similarity) * 0.55, coalesce((SELECT cutoff FROM gap), 0), 0.0) AS strong, max(primary_similarity) AS top FROM fused),
    sel AS (SELECT fused.*, primary_similarity >= strong AS is_strong, strong, top, greatest(0.045, strong * 0.85) AS support FROM fused, lim)"""


@query(f"WITH {EVIDENCE}, {CUT} SELECT item, primary_similarity FROM sel WHERE is_strong")
def relevance_cutoff(spark, sf_dir):
    r = ranking.relevant(ranking.fuse(_evidence(spark, sf_dir)), "unknown")
    return r.where("accepted").select("item", "primary_similarity")


@query(
    f"""WITH {EVIDENCE}, lim AS (SELECT greatest(0.045, max(primary_similarity) * 0.5) AS strong FROM fused)
    SELECT item FROM fused, lim WHERE primary_similarity >= strong OR (primary_similarity >= greatest(0.04, strong * 0.9, 0) AND has_whole AND n_groups >= 2)"""
)
def relevance_composed(spark, sf_dir):
    return ranking.relevant(ranking.fuse(_evidence(spark, sf_dir)), "composed").where("accepted").select("item")


@query(
    f"""WITH {EVIDENCE}, lim AS (SELECT greatest(0.06, max(similarity) * 0.9) AS strong FROM fused)
    SELECT item FROM fused, lim WHERE similarity >= strong OR (n_groups >= 2 AND similarity >= greatest(0.03, strong * 0.6))"""
)
def relevance_by_consensus(spark, sf_dir):
    return ranking.relevant_by_consensus(ranking.fuse(_evidence(spark, sf_dir)), 0.06, 0.9, 0.03, 0.6, 2).where("accepted").select("item")


EXACT = """exact AS (SELECT p_partkey AS item, CASE WHEN p_size % 3 = 0 THEN 'tag' WHEN p_size % 3 = 1 THEN 'filename' ELSE 'autoTag' END AS source, p_partkey % 2 = 0 AS exact FROM part WHERE p_brand = 'Brand#7'),
    tg AS (SELECT p_partkey AS item, p_size % 2 = 0 AS trusted, p_size / 50.0 AS confidence FROM part WHERE p_type IN ('SMALL', 'ECONOMY')),
    w AS (SELECT *, CASE source WHEN 'tag' THEN CASE WHEN exact THEN 1.25 ELSE 1.0 END WHEN 'filename' THEN 0.8 ELSE 0.25 END AS weight FROM exact)"""


def _exact(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    e = p.where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("item"), F.when(size % 3 == 0, "tag").when(size % 3 == 1, "filename").otherwise("autoTag").alias("source"), (F.col("p_partkey") % 2 == 0).alias("exact"))
    t = p.where("p_type in ('SMALL', 'ECONOMY')").select(F.col("p_partkey").alias("item"), (size % 2 == 0).alias("trusted"), (size / 50.0).alias("confidence"))
    return e, t


@query(
    f"""WITH {EVIDENCE}, {CUT}, {EXACT},
    ta AS (SELECT item, bool_or(trusted) AS trusted, max(CASE WHEN NOT trusted AND confidence >= 0.55 THEN confidence END) AS auto FROM tg GROUP BY item),
    ex AS (SELECT w.item, bool_or(source <> 'autoTag' AND (source <> 'tag' OR (exact AND coalesce(trusted, false)))) AS independent, bool_or(exact) AS exact, max(weight) AS bonus FROM w LEFT JOIN ta USING (item) GROUP BY w.item),
    j AS (SELECT item, sel.item IS NOT NULL AND sel.primary_similarity IS NOT NULL AS has, coalesce(primary_similarity, 0) AS own, coalesce(is_strong, false) AS strong, similarity, coalesce(independent, false) AS independent, coalesce(exact, false) AS exact, coalesce(bonus, 0) AS bonus,
        coalesce(trusted, false) AS trusted, coalesce(auto, 0) AS auto, (SELECT max(support) FROM sel) AS support, (SELECT max(top) FROM sel) AS top FROM sel FULL JOIN ex USING (item) LEFT JOIN ta USING (item)),
    k AS (SELECT *, has AND NOT strong AND own >= support AND (trusted OR auto >= 0.75) AS rescued, CASE WHEN trusted THEN 1.0 WHEN auto >= 0.55 THEN floor((0.5 + 0.5 * greatest(0, least(1, (auto - 0.55) / 0.4))) * 10000 + 0.5) / 10000 ELSE 0 END AS tag_support FROM j)
    SELECT item, round(0.7 * CASE WHEN has THEN greatest(0, least(1, (own - support) / greatest(0.0001, top - support))) ELSE 0 END + 0.3 * tag_support + bonus, 9) AS rank_score, coalesce(similarity, CASE WHEN independent THEN 1 ELSE 0 END)::DOUBLE AS similarity, exact, rescued, tag_support::DOUBLE AS tag_support
    FROM k WHERE independent OR strong OR rescued"""
)
def gated_fusion(spark, sf_dir):
    e, t = _exact(spark, sf_dir)
    r = ranking.gated_fusion(ranking.relevant(ranking.fuse(_evidence(spark, sf_dir)), "unknown"), e, t)
    return _shown(r, "item", "rank_score", "similarity", "exact", "rescued", "tag_support")


@query(
    f"""WITH {EXACT}, s AS (SELECT item, 1.0 / (60 + r) AS score, similarity, false AS exact FROM (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, p_size / 100.0 AS similarity FROM part WHERE p_size < 20)),
    u AS (SELECT item, sum(score) AS rank_score, bool_or(exact) AS exact, max(similarity) AS best FROM (SELECT * FROM s UNION ALL SELECT item, weight / 61, NULL, exact FROM (SELECT DISTINCT * FROM w)) GROUP BY item)
    SELECT item, round(rank_score, 9) AS rank_score, exact, floor(CASE WHEN coalesce(best, 0) <> 0 THEN best WHEN exact THEN 1 ELSE rank_score / (SELECT max(rank_score) FROM u) END * 10000 + 0.5) / 10000 AS similarity FROM u"""
)
def hybrid_fusion(spark, sf_dir):
    e, _ = _exact(spark, sf_dir)
    p = table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey", "p_size", F.lit(0).alias("list"), (-F.col("p_retailprice")).alias("by"))
    s = order.placed(p, "list", ["by", "p_partkey"]).select(F.col("p_partkey").alias("item"), "rank", (F.col("p_size") / 100.0).alias("similarity"))
    return _shown(ranking.hybrid_fusion(s, e), "item", "rank_score", "exact", "similarity")


@query(
    """WITH s AS (SELECT l_orderkey AS item, 'p' || CAST(l_partkey % 40 AS VARCHAR) AS tag, max(l_quantity) / 60.0 AS similarity FROM lineitem GROUP BY 1, 2), t AS (SELECT *, max(similarity) OVER (PARTITION BY item) AS top FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, tag) AS n FROM t WHERE top >= 0.5 AND similarity >= greatest(top - 0.2, 0.5)) SELECT item, tag, similarity FROM r WHERE n <= 5"""
)
def selected_tags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("item"), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("tag")).agg((F.max("l_quantity") / 60.0).alias("similarity"))
    return ranking.select_tags(s.withColumn("least", F.lit(None).cast("double")), "item", 0.5, 0.2)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 2")
def best_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.first_per_key(e, ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")], 2).select("user_id", "event_type", "event_id")


@query("SELECT event_id, round(value / max(value) OVER (PARTITION BY event_type), 9) AS relative FROM events")
def relative_to_top(spark, sf_dir):
    return ranking.relative_to_top(table(spark, sf_dir, "events"), "value", "event_type").select("event_id", F.round("relative", 9).alias("relative"))


@query("SELECT o_orderkey AS id, round(o_totalprice * (1 + 0.1 * pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01'), 0) / 365.0)) * CASE WHEN o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' THEN 1.2 ELSE 1 END, 4) AS score FROM orders")
def time_decay(spark, sf_dir):
    from datetime import date

    o = table(spark, sf_dir, "orders")
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    boosted = ranking.temporal_boost(ranking.time_decay(F.col("o_totalprice"), age), F.col("o_orderdate"), date(1997, 1, 1), date(1997, 6, 30))
    return o.select(F.col("o_orderkey").alias("id"), F.round(boosted, 4).alias("score"))


@query(
    """WITH t AS (SELECT l_orderkey AS item, p_name AS name, l_returnflag = 'R' AS trusted FROM lineitem JOIN part ON p_partkey = l_partkey), h AS (SELECT * FROM t WHERE contains(lower(name), 'red'))
    SELECT item, 'tag' AS source, bool_or(lower(name) = 'red') AS exact FROM h WHERE trusted GROUP BY item UNION ALL SELECT DISTINCT item, 'autoTag', false FROM h WHERE NOT trusted AND item IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""
)
def tag_evidence(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    t = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("item"), F.col("p_name").alias("name"), (F.col("l_returnflag") == "R").alias("trusted"))
    return tagging.tag_evidence(t, "Red", items(spark, sf_dir).where("favourite").select(F.col("id").alias("item")))


RUNS = """x AS (SELECT user_id, event_id, ts, value, event_type, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000 > 7200000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    runs AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM x)"""


@query(f"WITH {RUNS} SELECT user_id, run, count(*) AS n FROM runs GROUP BY user_id, run")
def gap_runs(spark, sf_dir):
    r = sequences.gap_runs(feed(spark, sf_dir), ["user_id"], F.unix_millis("ts"), [F.col("ts"), F.col("event_id")], 7_200_000)
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT event_id, run FROM runs")
def gap_runs_of_hot_keys(spark, sf_dir):
    f = feed(spark, sf_dir).select("user_id", "event_id", F.unix_millis("ts").alias("ms"))
    return sequences.gap_runs_split(f, ["user_id"], "ms", ["event_id"], 7_200_000, 86_400_000).select("event_id", "run")


@query(
    """WITH f AS (SELECT l_suppkey AS folder, l_returnflag AS camera, l_linestatus AS lens, l_orderkey * 10 + l_linenumber AS id, epoch_ms(l_shipdate) // 43200 + l_orderkey % 3 AS t, l_partkey % 64 AS hash, l_suppkey % 3 AS burst FROM lineitem),
    x AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 2000 OR bit_count(xor(hash, lag(hash) OVER w)) > 12 OR burst <> lag(burst) OVER w THEN 1 ELSE 0 END AS cut FROM f WHERE t > 0 WINDOW w AS (PARTITION BY folder, camera, lens ORDER BY t, id)),
    r AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY folder, camera, lens ORDER BY t, id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM x)
    SELECT folder, camera, lens, run, min(t) AS started_at, max(t) AS ended_at, count(*) AS n_frames FROM r GROUP BY ALL HAVING count(*) >= 3"""
)
def bursts(spark, sf_dir):
    return sequences.bursts(_frames(spark, sf_dir), ["folder", "camera", "lens"])


def _frames(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = F.expr("unix_millis(cast(l_shipdate as timestamp)) div 43200") + F.col("l_orderkey") % 3
    return li.select(F.col("l_suppkey").alias("folder"), F.col("l_returnflag").alias("camera"), F.col("l_linestatus").alias("lens"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), at.alias("at"), (F.col("l_partkey") % 64).alias("hash"), (F.col("l_suppkey") % 3).alias("burst"))


FITS = "{m} > 0 AND floor({g} / {m} + 0.5) BETWEEN 1 AND 2 AND abs({g} - {m} * floor({g} / {m} + 0.5)) <= greatest(1000, {m} * 0.5)"


@query(
    f"""WITH RECURSIVE x AS (SELECT user_id % 20 AS folder, event_type AS camera, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events WHERE event_type IS NOT NULL),
    r AS (SELECT folder, camera, i, ms, i AS first, CAST([] AS BIGINT[]) AS gaps FROM x WHERE i = 1
        UNION ALL SELECT folder, camera, i, ms, CASE WHEN ok THEN first ELSE i END, CASE WHEN ok THEN list_append(gaps, gap) ELSE CAST([] AS BIGINT[]) END
        FROM (SELECT *, gap BETWEEN 60000 AND 43200000 AND {FITS.format(g="gap", m="m")} AS ok
            FROM (SELECT x.folder, x.camera, x.i, x.ms, r.first, r.gaps, x.ms - r.ms AS gap, CASE WHEN len(r.gaps) = 0 THEN x.ms - r.ms ELSE list_median(r.gaps) END::DOUBLE AS m FROM r JOIN x ON x.folder = r.folder AND x.camera = r.camera AND x.i = r.i + 1))),
    g AS (SELECT folder, camera, min(ms) AS started_at, max(ms) AS ended_at, count(*) AS n_frames, arg_max(gaps, i) AS gaps FROM r GROUP BY folder, camera, first HAVING count(*) >= 3),
    m AS (SELECT *, CAST(list_median(gaps) AS DOUBLE) AS interval FROM g)
    SELECT folder, camera, 'x' AS lens, started_at, ended_at, n_frames, interval FROM m WHERE interval BETWEEN 60000 AND 43200000 AND len(list_filter(gaps, lambda v: NOT ({FITS.format(g="v", m="interval")}))) = 0"""
)
def rhythm_runs(spark, sf_dir):
    f = feed(spark, sf_dir).select((F.col("user_id") % 20).alias("folder"), F.col("event_type").alias("camera"), F.lit("x").alias("lens"), F.col("event_id").alias("id"), F.unix_millis("ts").alias("at"))
    return sequences.rhythm_runs(f, ["folder", "camera", "lens"], least=3, low_ms=60_000, high_ms=43_200_000, tolerance=0.5)


@query(
    f"""WITH {RUNS}, s AS (SELECT user_id, user_id * 1000000 + run AS id, epoch_us(min(ts)) // 1000 AS started_at, epoch_us(max(ts)) // 1000 AS ended_at FROM runs GROUP BY user_id, run),
    n AS (SELECT *, lead(id) OVER w AS next_id, lead(started_at) OVER w - ended_at AS gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY started_at, id)) SELECT user_id, id, next_id, gap FROM n WHERE gap BETWEEN 0 AND 14400000"""
)
def continuations(spark, sf_dir):
    r = sequences.gap_runs(feed(spark, sf_dir), ["user_id"], F.unix_millis("ts"), [F.col("ts"), F.col("event_id")], 7_200_000)
    s = r.groupBy("user_id", "run").agg(F.unix_millis(F.min("ts")).alias("started_at"), F.unix_millis(F.max("ts")).alias("ended_at")).withColumn("id", F.col("user_id") * 1_000_000 + F.col("run"))
    return sequences.continuations(s, ["user_id"], 14_400_000)


@query(
    f"""WITH {RUNS}, v AS (SELECT user_id, run, event_id FROM runs WHERE event_type <> 'error') SELECT r.user_id, r.run, count(*) AS n_members, count(v.event_id) AS n_matched, arg_max(r.event_id, (r.value, -r.event_id)) AS cover
    FROM runs r LEFT JOIN v USING (user_id, run, event_id) GROUP BY r.user_id, r.run HAVING count(v.event_id) > 0 AND count(*) > 1"""
)
def sequence_listing(spark, sf_dir):
    r = sequences.gap_runs(feed(spark, sf_dir), ["user_id"], F.unix_millis("ts"), [F.col("ts"), F.col("event_id")], 7_200_000)
    s = r.groupBy("user_id", "run").agg(
        F.count("*").alias("n_members"), F.count_if(F.col("event_type") != "error").alias("n_matched"), F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("k"))).alias("cover")
    )
    return s.where("n_matched > 0 and n_members > 1")


@query(
    """SELECT l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, (floor((0.34 * least(1, l_quantity / 50) + 0.18 * least(1, l_discount * 10) + 0.18 * least(1, l_tax * 12) + 0.08 + 0.12 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 1000000), l_orderkey * 10 + l_linenumber)) AS best FROM lineitem GROUP BY l_suppkey"""
)
def representatives(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    s = sequences.representative_score(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12, F.lit(1), (F.col("l_returnflag") == "R").cast("int"), F.lit(0), F.lit(0))
    return li.groupBy("l_suppkey").agg(F.max_by("id", F.struct(F.floor(s * 1_000_000), "id")).alias("best"))


def _log(spark, sf_dir):
    e = feed(spark, sf_dir)
    score = F.when(F.col("event_type") == "error", None).when(F.col("k") % 5 == 0, 0.5).otherwise((F.col("k") % 2).cast("double"))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("k") % 7).cast("long").alias("a"), (F.col("k") % 7 + 1 + F.col("k") % 4).cast("long").alias("b"), score.alias("score"), "ts")


@query()
def tournament(spark, sf_dir):
    return rating.tournament(_log(spark, sf_dir))


@query()
def next_pairs(spark, sf_dir):
    log = _log(spark, sf_dir)
    return rating.next_pairs(rating.tournament(log), log.where("score in (0, 1)"), 2)


@query(f"WITH {HASHES} SELECT q.id AS query, h.id AS item, CAST(bit_count(xor(h.hash, q.hash)) AS INTEGER) AS distance FROM hashes q JOIN hashes h ON h.id <> q.id AND h.label = q.label WHERE q.id % 20 = 0 AND bit_count(xor(h.hash, q.hash)) <= 22")
def reject_similar(spark, sf_dir):
    h = hashes(spark, sf_dir).withColumnRenamed("label", "session")
    return sequences.similar_in_session(h.where("id % 20 = 0"), h, 22)


@query(
    f"""WITH RECURSIVE {HASHES}, x AS (SELECT id % 10 AS session, id, hash, row_number() OVER (PARTITION BY id % 10 ORDER BY id) AS i FROM hashes),
    r AS (SELECT session, id, i, CAST(0 AS BIGINT) AS grp, [hash] AS seeds FROM x WHERE i = 1
        UNION ALL SELECT session, id, i, CASE WHEN near IS NULL THEN len(seeds) ELSE near - 1 END, CASE WHEN near IS NULL THEN list_append(seeds, hash) ELSE seeds END
        FROM (SELECT x.session, x.id, x.i, x.hash, r.seeds, list_filter(range(1, len(r.seeds) + 1), lambda j: bit_count(xor(r.seeds[j], x.hash)) <= 20)[1] AS near FROM r JOIN x ON x.session = r.session AND x.i = r.i + 1))
    SELECT session, id, grp, row_number() OVER (PARTITION BY session ORDER BY grp, i) - 1 AS place FROM r"""
)
def similar_first(spark, sf_dir):
    h = hashes(spark, sf_dir).select((F.col("id") % 10).alias("session"), "id", "hash", F.col("id").alias("at"))
    return sequences.similar_first(h, "session", "id", "hash", "at", 20)


# Feeds: the operators of the streaming package over a finished feed.
@query(f"WITH {FEED} SELECT user_id, count(*) AS n, epoch_us(max(ts)) // 1000 AS last FROM feed WHERE event_type = 'view' GROUP BY user_id")
def view_counter(spark, sf_dir):
    c = files.counter(feed(spark, sf_dir).where("event_type = 'view'"), "user_id", "ts")
    return c.withColumn("last", F.unix_millis("last"))


@query(f"WITH {FEED} SELECT user_id AS directory, CAST(epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, count(*) AS n FROM feed GROUP BY 1, 2 HAVING count(*) >= 2")
def removal_bursts(spark, sf_dir):
    b = feeds.unlink_bursts(feed(spark, sf_dir), "user_id", span="1 hour", least=2)
    return b.withColumn("start", F.unix_millis("start"))


@query(
    f"""WITH {FEED}, x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM feed WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x)
    SELECT user_id AS directory, epoch_us(min(ts)) // 1000 AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000 AS "end", count(*) AS n FROM r GROUP BY user_id, run"""
)
def debounced_rescans(spark, sf_dir):
    d = feeds.debounced(feed(spark, sf_dir), "user_id", gap="30 minutes")
    return d.withColumns({"start": F.unix_millis("start"), "end": F.unix_millis("end")})


@query(
    f"""WITH {FEED}, w AS (SELECT CAST(epoch_ms(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * CAST(i AS INTEGER)) AS BIGINT) AS start, epoch_us(ts) // 1000 AS ms FROM feed, range(4) t(i)),
    s AS (SELECT start, count(*) AS n, (start + 4 * 3600000 - min(ms)) / 1000.0 AS span FROM w GROUP BY start) SELECT start, n, CASE WHEN span < 1 THEN 0 ELSE round(n / span, 9) END AS per_second FROM s"""
)
def sliding_rates(spark, sf_dir):
    r = feeds.rates(feed(spark, sf_dir), span="4 hours", slide="1 hour")
    return r.select(F.unix_millis("start").alias("start"), "n", F.round("per_second", 9).alias("per_second"))


@query(f"WITH {FEED} SELECT DISTINCT user_id FROM feed WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def added_once(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return feeds.added(feed(spark, sf_dir), known, "user_id").select("user_id")


@query(
    f"""WITH {FEED} SELECT e.event_id FROM feed e WHERE e.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM feed m WHERE m.event_type = 'view' AND m.user_id = e.user_id AND e.ts >= m.ts AND e.ts <= m.ts + INTERVAL 6 HOUR)"""
)
def suppressed_events(spark, sf_dir):
    f = feed(spark, sf_dir)
    return feeds.suppressed(f.where("event_type = 'click'"), f.where("event_type = 'view'"), "user_id", hold="6 hours").select("event_id")


@query(
    """WITH c AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, epoch_us(s) // 1000 AS start, n FROM c WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def streamed_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = feeds.run_to_table(feeds.windowed_counts(s, "event_type"), "streamed-windows")
    return out.withColumn("start", F.unix_millis("start"))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """WITH x AS (SELECT CAST(user_id AS VARCHAR) AS directory, CAST(event_id % 500 AS VARCHAR) AS path, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 3600000000 AS span FROM events),
    q AS (SELECT directory, span FROM x GROUP BY directory, span HAVING count(*) < 2), e AS (SELECT max(ms) - 600000 AS done FROM x)
    SELECT directory, path, max(ms) AS ms FROM x JOIN q USING (directory, span), e WHERE (span + 1) * 3600000 <= done AND path NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey < 100) GROUP BY directory, span, path"""
)
def missing_after_bursts(spark, sf_dir):
    s = _stream(spark, sf_dir).withColumns({"directory": F.col("user_id").cast("string"), "path": (F.col("event_id") % 500).cast("string")})
    there = table(spark, sf_dir, "customer").where("c_custkey < 100").select(F.col("c_custkey").cast("string").alias("path"))
    with feeds.keyed_state(spark):
        return feeds.run_to_table(feeds.removals(s, there, span_ms=3_600_000, least=2), "missing")
