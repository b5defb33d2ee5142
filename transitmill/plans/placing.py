"""Queries of placement: tracks and stop events on patterns with repeated stops. Suppliers stand for the places of six patterns, events for fixes and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analysis, networks, placement
from ..sources import readers
from ..sources.shared import delete, shared_folder
from .registry import events, query, rounded, table


def pattern_links(spark, d) -> DataFrame:
    """(pat, link_idx, from_stop, to_stop, len_m, link_key) from suppliers in the order of their key; nations are the stops, so most come again."""
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 6).alias("pat"), "s_suppkey", F.col("s_nationkey").cast("int").alias("from_stop"), (100 + F.floor(F.abs("s_acctbal")) % 400).cast("double").alias("len_m"))
    w = Window.partitionBy("pat").orderBy("s_suppkey")
    x = s.select("pat", (F.row_number().over(w) - 1).alias("link_idx"), "from_stop", F.lead("from_stop").over(w).alias("to_stop"), "len_m").filter("to_stop is not null")
    return x.withColumn("link_key", F.concat(F.col("from_stop").cast("string"), F.lit(">"), F.col("to_stop").cast("string")))


def track_fixes(spark, d) -> DataFrame:
    """Events as fixes: a track is a user's week, the point and the distance come from the value."""
    e = events(spark, d)
    v = F.floor("value")
    return e.select("event_id", "t", (F.col("user_id") % 6).alias("pat"), "user_id", F.floor(F.day("service_date") / 8).alias("week"), (v % 25).cast("int").alias("point"), (F.floor(F.col("value") * 10) % 400).cast("double").alias("dist"), "service_date", "hour")


#: The chains with their starts (the last place has no length), and the fixes, as part of a recursive WITH.
_CHAIN = """WITH RECURSIVE sp AS (SELECT s_suppkey % 6 AS pat, (row_number() OVER w - 1)::INT AS idx, s_nationkey::INT AS stop, lead(s_nationkey::INT) OVER w AS nxt, (100 + floor(abs(s_acctbal))::BIGINT % 400)::DOUBLE AS len FROM supplier WINDOW w AS (PARTITION BY s_suppkey % 6 ORDER BY s_suppkey)),
ln AS (SELECT pat, idx, stop, CASE WHEN nxt IS NULL THEN 0 ELSE len END AS len, nxt, max(idx) OVER (PARTITION BY pat) AS last FROM sp),
ch AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY pat ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, count(*) OVER (PARTITION BY pat, stop) AS k FROM ln WHERE last > 0),
fx AS (SELECT event_id, floor(epoch(ts))::BIGINT AS t, user_id % 6 AS pat, user_id, day(ts) // 8 AS week, (floor(value)::BIGINT % 25)::INT AS point, (floor(value * 10)::BIGINT % 400)::DOUBLE AS dist, ts::DATE AS service_date, hour(ts)::INT AS hour FROM events)"""


def _aligned(strict: bool, ob: str = "ob", path: str = "path") -> str:
    """The alignment of observations ob (run, k from 1, event_id, cands) as path (run, k, p, s): all states of a run are kept in a list, and each step adds those of the next observation."""
    reach = "<" if strict else "<="
    return f""",
dp_{ob} AS (SELECT run, 0 AS k, CAST([] AS STRUCT(n INT, f INT, s DOUBLE, k INT, p INT, path STRUCT(k INT, p INT, s DOUBLE)[])[]) AS nodes FROM {ob} WHERE k = 1
UNION ALL SELECT d.run, o.k, d.nodes || list_transform(o.cands, lambda x: list_transform([list_max(list_transform(list_filter(d.nodes, lambda y: y.s {reach} x.s), lambda y: {{'n': y.n, 'f': y.f, 's': -y.s, 'k': -y.k, 'path': y.path}}))],
  lambda b: {{'n': (coalesce(b.n, 0) + 1)::INT, 'f': coalesce(b.f, x.p)::INT, 's': x.s, 'k': o.k, 'p': x.p, 'path': coalesce(b.path, []) || [{{'k': o.k, 'p': x.p, 's': x.s}}]}})[1])
FROM dp_{ob} d JOIN {ob} o ON o.run = d.run AND o.k = d.k + 1),
best_{ob} AS (SELECT run, list_max(list_transform(nodes, lambda y: {{'n': y.n, 'f': y.f - y.p, 's': -y.s, 'k': -y.k, 'path': y.path}})) AS b FROM dp_{ob} WHERE (run, k) IN (SELECT (run, max(k)) FROM {ob} GROUP BY run)),
{path} AS (SELECT run, x.k, x.p, x.s FROM (SELECT run, unnest(b.path) AS x FROM best_{ob} WHERE b IS NOT NULL))"""


_PLACED = _CHAIN + """,
fl AS (SELECT fx.pat, idx, quantile_cont(dist, 0.995) AS flen FROM fx JOIN ch ON ch.pat = fx.pat AND stop = point WHERE k = 1 AND len > 0 GROUP BY fx.pat, idx HAVING count(*) >= 20 AND quantile_cont(dist, 0.995) > 0),
pl AS (SELECT ch.*, coalesce(len / flen, 1.0) AS sc FROM ch LEFT JOIN fl ON fl.pat = ch.pat AND fl.idx = ch.idx),
ob AS (SELECT fx.user_id * 10 + week AS run, row_number() OVER (PARTITION BY fx.user_id, week ORDER BY t, event_id)::INT AS k, event_id, coalesce(cands, []) AS cands
  FROM fx LEFT JOIN (SELECT event_id, list({'p': idx, 's': start + least(len, dist * sc)}) AS cands FROM fx JOIN pl ON pl.pat = fx.pat AND stop = point GROUP BY event_id) c USING (event_id))""" + _aligned(False) + """,
pz AS (SELECT ob.event_id, path.p AS link_idx, path.s AS s_m, path.s - pl.start AS pos_m, coalesce(pl.len > 0 AND path.s > 0, false) AS count FROM ob LEFT JOIN path ON path.run = ob.run AND path.k = ob.k
  LEFT JOIN fx ON fx.event_id = ob.event_id LEFT JOIN pl ON pl.pat = fx.pat AND pl.idx = path.p)"""


def tracks(spark, d) -> DataFrame:
    links, fixes = pattern_links(spark, d), track_fixes(spark, d)
    learned = placement.learned_lengths(fixes, placement.chain(links, ["pat"]), ["pat"])
    return placement.placed(fixes, links, ["pat"], ["user_id", "week"], [F.col("t"), F.col("event_id")], learned)


@query(_PLACED + " SELECT event_id, link_idx, round(s_m, 4) AS s_m, round(pos_m, 4) AS pos_m, count FROM pz")
def placed_tracks(spark, d):
    return rounded(tracks(spark, d).select("event_id", "link_idx", "s_m", "pos_m", "count"))


_FEED = """,
en AS (SELECT fx.*, pz.link_idx, lag(pz.link_idx) OVER (PARTITION BY fx.pat, fx.user_id, fx.week ORDER BY t, fx.event_id) AS before FROM fx JOIN pz USING (event_id) WHERE pz.count),
fd AS (SELECT service_date, hour, pat, stop || '>' || nxt AS link_key, count(*)::DOUBLE AS n_feed FROM (SELECT en.service_date, en.hour, en.pat, ch.stop, ch.nxt FROM en JOIN ch ON ch.pat = en.pat AND ch.idx = en.link_idx WHERE before IS DISTINCT FROM link_idx) GROUP BY ALL)"""


def feed_passages(spark, d) -> DataFrame:
    """Passages from the placed tracks, by pattern and link."""
    held = tracks(spark, d).filter("count").join(pattern_links(spark, d).select("pat", "link_idx", "link_key"), ["pat", "link_idx"])
    run = held.withColumn("track", F.concat_ws("-", "pat", "user_id", "week"))
    x = analysis.passages(run.withColumn("_k", F.col("link_key")), "track", [F.col("t"), F.col("event_id")], ["pat", "link_idx", "link_key"])
    return x.groupBy("service_date", "hour", "pat", "link_key").agg(F.sum("n_feed").alias("n_feed"))


_STOPS = """,
ev AS (SELECT user_id AS trip, service_date, event_id, t, point FROM fx),
cd AS (SELECT ev.trip * 10000 + epoch(service_date)::BIGINT // 86400 % 10000 AS tr, service_date, event_id, t, pat, list({'p': idx, 's': idx::DOUBLE}) AS cands FROM ev JOIN ch ON stop = point GROUP BY ALL),
os AS (SELECT tr * 10 + pat AS run, row_number() OVER (PARTITION BY tr, pat ORDER BY t, event_id)::INT AS k, event_id, t, tr, pat, cands FROM cd)""" + _aligned(True, "os", "way") + """,
ht AS (SELECT DISTINCT ON (run // 10) run FROM (SELECT run, count(*) AS n FROM way GROUP BY run) h JOIN (SELECT pat, count(*) AS size FROM ch GROUP BY pat) z ON z.pat = h.run % 10 ORDER BY run // 10, n DESC, size, pat),
sn AS (SELECT way.run, os.pat, way.p, os.t, lag(way.p) OVER w AS p0, lag(os.t) OVER w AS t0 FROM way JOIN os USING (run, k) WHERE way.run IN (SELECT run FROM ht) WINDOW w AS (PARTITION BY way.run ORDER BY way.p)),
lg AS (SELECT sn.*, ch.idx, ch.stop || '>' || ch.nxt AS link_key, t0 + (t - t0) * ((ch.start - a.start) / (b.start - a.start)) AS mt FROM sn JOIN ch a ON a.pat = sn.pat AND a.idx = p0 JOIN ch b ON b.pat = sn.pat AND b.idx = p JOIN ch ON ch.pat = sn.pat AND ch.idx >= p0 AND ch.idx < p),
es AS (SELECT make_timestamp((floor(mt) * 1000000)::BIGINT) AS c, pat, link_key FROM lg),
ep AS (SELECT c::DATE AS service_date, hour(c)::INT AS hour, pat, link_key, count(*)::DOUBLE AS n_events FROM es GROUP BY ALL)"""


def seen_passages(spark, d) -> DataFrame:
    """Passages from stop events alone: a user's day is a trip, and any of the patterns may be its own."""
    links = pattern_links(spark, d).withColumnRenamed("pat", "pattern_uid").withColumn("net", F.lit(0))
    stops = track_fixes(spark, d).select(F.lit(0).alias("net"), "user_id", "service_date", F.col("point").alias("stop_id"), "t", "event_id")
    trips = stops.withColumnRenamed("service_date", "day")
    return placement.event_passages(trips, links, ["net"], ["user_id", "day"], [F.col("t"), F.col("event_id")]).drop("net")


@query(_CHAIN + _STOPS + " SELECT service_date, hour, pat AS pattern_uid, link_key, n_events FROM ep")
def event_passages(spark, d):
    return seen_passages(spark, d)


@query(_PLACED + _FEED + " SELECT service_date, hour, pat AS pattern_uid, link_key, n_feed FROM fd")
def track_passages(spark, d):
    return feed_passages(spark, d).withColumnRenamed("pat", "pattern_uid")


@query(_PLACED + _FEED + _STOPS + """,
mf AS (SELECT service_date, hour, link_key, arg_min(pat, (-n_feed, pat)) AS pat, sum(n_feed) AS n_feed FROM fd GROUP BY ALL), me AS (SELECT service_date, hour, link_key, arg_min(pat, (-n_events, pat)) AS pat, sum(n_events) AS n_events FROM ep GROUP BY ALL)
SELECT service_date, hour, link_key, coalesce(mf.pat, me.pat) AS pattern_uid, coalesce(n_feed, 0) AS n_feed, coalesce(n_events, 0) AS n_events, greatest(coalesce(n_feed, 0), coalesce(n_events, 0)) AS n FROM mf FULL JOIN me USING (service_date, hour, link_key)""")
def both_passages(spark, d):
    """Passages of tracks and of stop events in one table."""
    feed = feed_passages(spark, d).withColumnRenamed("pat", "pattern_uid")
    return placement.merged_passages(feed, seen_passages(spark, d), ["service_date", "hour", "link_key"])


@query("""WITH sp AS (SELECT s_suppkey % 6 AS pat, s_nationkey::INT AS stop, last_value(s_nationkey::INT) OVER (PARTITION BY s_suppkey % 6 ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS terminus, count(*) OVER (PARTITION BY s_suppkey % 6) AS n FROM supplier),
ps AS (SELECT * FROM sp WHERE n > 1), fx AS (SELECT (user_id % 40)::INT AS code, (floor(value)::BIGINT % 25)::INT AS point FROM events), un AS (SELECT * FROM fx WHERE code NOT IN (SELECT terminus FROM ps)),
sc AS (SELECT code, terminus, count(*) AS n FROM un JOIN (SELECT DISTINCT stop, terminus FROM ps) h ON h.stop = un.point GROUP BY ALL), t AS (SELECT code, count(*) AS every FROM un GROUP BY code),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, terminus) = 1) SELECT code, terminus AS known FROM b JOIN t USING (code) WHERE n >= 0.3 * every""")
def terminus_names(spark, d):
    links = pattern_links(spark, d)
    ends = placement.chain(links, ["pat"])
    last = Window.partitionBy("pat").orderBy("link_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stops = ends.select(F.lit(0).alias("net"), F.col("pat").alias("pattern_uid"), F.col("from_stop").alias("stop_id"), F.last("from_stop").over(last).alias("terminus"))
    fixes = track_fixes(spark, d).select(F.lit(0).alias("net"), (F.col("user_id") % 40).cast("int").alias("terminus"), "point")
    return placement.terminus_aliases(fixes, stops, ["net"], share=0.3).select(F.col("terminus").alias("code"), "known")


#: Two feeds of links: orders of open and of closed line items; a link's track bends away by its line number, 25 m a number.
_TRACKS = "lt AS (SELECT (l_suppkey % 7)::VARCHAR AS from_stop, (l_partkey % 5)::VARCHAR AS to_stop, l_linenumber AS y, l_linestatus AS feed, count(*) AS w FROM lineitem GROUP BY ALL)"
_FOLD = """SELECT from_stop, to_stop, list_reduce(list_transform(list_sort(list({{'w': -w, 'y': y}})), lambda x: [x.y]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) * 25 <= 40)) > 0 THEN acc ELSE list_concat(acc, x) END{start}) AS v FROM {rows} GROUP BY ALL"""


def link_tracks(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("string").alias("from_stop"), (F.col("l_partkey") % 5).cast("string").alias("to_stop"), F.col("l_linenumber").alias("y"), F.col("l_linestatus").alias("feed")).agg(F.count(F.lit(1)).alias("w"))
    up, on = F.col("y") * 25 / F.lit(110540.0), F.lit(1000 / 111320.0)
    zero = F.lit(0.0)
    return li.withColumn("geometry", F.array(F.array(zero, zero), F.array(on / 2, up), F.array(on, zero)))


@query("WITH " + _TRACKS + ", a AS (" + _FOLD.format(start="", rows="lt WHERE feed = 'F'") + """),
b AS (SELECT lt.from_stop, lt.to_stop, any_value(a.v) AS v, list_sort(list({'w': -w, 'y': y})) AS n FROM lt LEFT JOIN a USING (from_stop, to_stop) WHERE feed <> 'F' GROUP BY ALL),
c AS (SELECT coalesce(a.from_stop, b.from_stop) AS from_stop, coalesce(a.to_stop, b.to_stop) AS to_stop,
  list_reduce(list_transform(coalesce(b.n, []), lambda x: [x.y]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) * 25 <= 40)) > 0 THEN acc ELSE list_concat(acc, x) END, coalesce(a.v, [])) AS v FROM a FULL JOIN b ON a.from_stop = b.from_stop AND a.to_stop = b.to_stop),
r AS (SELECT from_stop, to_stop, unnest(range(len(v))) AS k, unnest(v) AS y FROM c),
m AS (SELECT lt.from_stop, lt.to_stop, feed, lt.y, w, (SELECT arg_min(k, (abs(r.y - lt.y), k)) FROM r WHERE r.from_stop = lt.from_stop AND r.to_stop = lt.to_stop) AS k FROM lt)
SELECT feed, from_stop || '>' || to_stop || '~' || k AS link_key, count(*) AS tracks, sum(w)::BIGINT AS w FROM m GROUP BY ALL""")
def lasting_keys(spark, d):
    """Keys of links over two feeds, the second with the registry of the first."""
    x = link_tracks(spark, d)
    first = networks.lasting_variants(None, x.filter("feed = 'F'"), weight="w")
    both = networks.lasting_variants(first, x.filter("feed <> 'F'"), weight="w")
    return networks.with_keys(x, both).groupBy("feed", "link_key").agg(F.count(F.lit(1)).alias("tracks"), F.sum("w").alias("w"))


#: Orders stand for days of feeds: the priority is the feed, the customer's remainder the line and the pattern; candidates are all feeds of the date's quarter by name.
_NET = """WITH pd AS (SELECT DISTINCT left(o_orderpriority, 1) AS sha, (o_custkey % 20)::VARCHAR AS line, (o_custkey % 60)::VARCHAR AS pattern_uid, o_orderdate::DATE AS service_date FROM orders),
ca AS (SELECT service_date, sha, CASE WHEN quarter(service_date) % 2 = 0 THEN sha::INT ELSE 10 - sha::INT END AS rank FROM (SELECT DISTINCT service_date, sha FROM pd)),
pk AS (SELECT line, service_date, arg_min(sha, rank) AS sha FROM (SELECT DISTINCT line, service_date, sha FROM pd) JOIN ca USING (service_date, sha) WHERE year(service_date) = 1996 GROUP BY ALL),
us AS (SELECT line, sha, min(service_date) AS since FROM pk GROUP BY ALL),
lk AS (SELECT left(o_orderpriority, 1) AS sha, (o_custkey % 20)::VARCHAR AS line, (o_custkey % 60)::VARCHAR AS pattern_uid, (o_orderkey % 4)::INT AS link_idx, max(o_totalprice) AS len_m FROM orders GROUP BY ALL),
nl AS (SELECT line, pattern_uid, link_idx, arg_min(len_m, (since, sha)) AS len_m FROM lk JOIN us USING (line, sha) GROUP BY ALL),
nd AS (SELECT pd.line, pd.pattern_uid, count(*) AS days FROM pd JOIN pk USING (line, service_date, sha) GROUP BY ALL)"""


@query(_NET + " SELECT line, pattern_uid, link_idx, len_m, coalesce(days, 0) AS days FROM nl LEFT JOIN nd USING (line, pattern_uid)")
def network_of_dates(spark, d):
    o = table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("sha"), (F.col("o_custkey") % 20).cast("string").alias("line"), (F.col("o_custkey") % 60).cast("string").alias("pattern_uid"), F.to_date("o_orderdate").alias("service_date"), (F.col("o_orderkey") % 4).cast("int").alias("link_idx"), "o_totalprice")
    days = o.select("sha", "line", "pattern_uid", "service_date").distinct()
    number = F.col("sha").cast("int")
    cands = days.select("service_date", "sha").distinct().withColumn("rank", F.when(F.quarter("service_date") % 2 == 0, number).otherwise(10 - number))
    feeds = {
        "pattern_days": days, "patterns": days.select("sha", "line", "pattern_uid").distinct(), "stops": days.select("sha", "line", F.col("pattern_uid").alias("stop_id")).distinct(),
        "links": o.groupBy("sha", "line", "pattern_uid", "link_idx").agg(F.max("o_totalprice").alias("len_m")),
    }
    net = networks.network(feeds, cands, days.filter("year(service_date) = 1996"))
    run = net["pattern_days"].groupBy("line", "pattern_uid").agg(F.count(F.lit(1)).alias("days"))
    return net["links"].join(run, ["line", "pattern_uid"], "left").fillna(0, ["days"])


@query("""WITH t AS (SELECT (o_custkey % 12)::VARCHAR AS line, (o_custkey % 60)::VARCHAR AS pattern_uid, o_orderpriority AS service_id, (o_custkey % 7)::INT AS n_stops FROM orders),
s AS (SELECT DISTINCT o_orderpriority AS service_id, o_orderdate::DATE AS service_date FROM orders),
p AS (SELECT line, pattern_uid, service_id, count(*) AS n, max(n_stops) AS n_stops FROM t GROUP BY ALL),
r AS (SELECT line, pattern_uid, service_date, sum(n)::BIGINT AS n_trips, max(n_stops) AS n_stops FROM p JOIN s USING (service_id) GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY line, service_date ORDER BY n_trips DESC, n_stops DESC, pattern_uid) = 1 AS is_main FROM r)
SELECT line, pattern_uid, is_main, count(*) AS days, sum(n_trips)::BIGINT AS n_trips FROM m GROUP BY ALL""")
def main_patterns(spark, d):
    o = table(spark, d, "orders")
    trips = o.select((F.col("o_custkey") % 12).cast("string").alias("line"), (F.col("o_custkey") % 60).cast("string").alias("pattern_uid"), F.col("o_orderpriority").alias("service_id"), (F.col("o_custkey") % 7).cast("int").alias("n_stops"))
    days = o.select(F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("service_date"))
    return networks.pattern_days(trips, days, ["line"]).groupBy("line", "pattern_uid", "is_main").agg(F.count(F.lit(1)).alias("days"), F.sum("n_trips").alias("n_trips"))


@query()
def hotspots(spark, d):
    """Line items as passages: suppliers are lines, parts places, quantities over 24 the seconds lost."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("line"), (F.col("l_partkey") % 60).alias("place"), F.to_date("l_shipdate").alias("service_date"), (F.col("l_quantity") - 24).alias("value"), F.lit(1.0).alias("weight"))
    return rounded(analysis.hotspots(li, ["line"], "place", "value", "weight", rounds=100))


@query("""WITH o AS (SELECT o_orderdate::DATE AS day, (year(o_orderdate) * 4 + quarter(o_orderdate)) % 20 AS source FROM orders),
s AS (SELECT source, min(day) AS low, max(day) AS high, count(*) AS n FROM o GROUP BY ALL),
w AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem),
x AS (SELECT date, source, greatest(0, low - date, date - high)::INT AS away, n FROM w, s)
SELECT date, arg_min(source, (away, -n, source)) AS source, min(away) AS away FROM x GROUP BY date""")
def source_of_date(spark, d):
    """Orders written as twenty sources, and for each day of shipping the source nearest to it, by the files' footers."""
    path = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), ((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")) % 20).alias("source"))
    o.write.partitionBy("source").parquet(path)
    found = readers.footers(spark, path, "day", "source").collect()  # a row a source
    delete(spark, path)
    sources = spark.createDataFrame([(int(r.source), r.low, r.high, r.n) for r in found], "source bigint, low date, high date, n bigint")
    return readers.nearest_source(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct(), sources, "source")
