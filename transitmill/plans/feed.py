"""Queries of ingest, coverage, stands, cubes and regularity, on tables that stand for the feed's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANDS
from ..operators import coverage, cube, ingest, regularity, windows, zones
from .registry import E, events, query, rounded, table


def times(spark, d) -> DataFrame:
    """Events as stop times: type is the line, user mod 10 the stop, value a delay in minutes."""
    return events(spark, d).select(F.col("event_type").alias("line"), F.lit(0).alias("direction_id"), (F.col("user_id") % 10).cast("string").alias("stop_id"), "service_date", F.col("user_id").cast("string").alias("trip_id"), "t", (F.col("t") - F.floor(F.col("value") * 60)).cast("long").alias("s"))


T = E + """, st AS (SELECT event_type AS line, 0 AS direction_id, (user_id % 10)::VARCHAR AS stop_id, service_date, user_id::VARCHAR AS trip_id, t, (t - floor(value * 60))::BIGINT AS s FROM e)"""

H = T + """, a AS (SELECT *, s - lag(s) OVER o AS dd FROM st WINDOW o AS (PARTITION BY line, direction_id, stop_id, service_date ORDER BY s, t, trip_id)),
b AS (SELECT *, sum(CASE WHEN dd <= 14400 THEN 0 ELSE 1 END) OVER (PARTITION BY line, direction_id, stop_id, service_date ORDER BY s, t, trip_id ROWS UNBOUNDED PRECEDING) AS blk, CASE WHEN dd <= 14400 THEN dd END AS hs FROM a),
c AS (SELECT *, t - lag(t) OVER (PARTITION BY line, direction_id, stop_id, service_date, blk ORDER BY t, s, trip_id) AS h, epoch(service_date)::BIGINT AS m0 FROM b),
r AS (SELECT line, direction_id, stop_id, service_date, floor((t - m0) / 3600)::INT AS hour, count(*) AS n, sum(h)::DOUBLE AS r1, sum(h::DOUBLE * h) AS r2, count(*) FILTER (WHERE hs > 0) AS nc, count(*) FILTER (WHERE hs > 0 AND h < 0.5 * hs) AS bunch, count(*) FILTER (WHERE hs > 0 AND h > 1.5 * hs) AS gap FROM c WHERE h IS NOT NULL GROUP BY ALL),
p AS (SELECT line, direction_id, stop_id, service_date, floor((s - m0) / 3600)::INT AS hour, count(*) AS m, sum(hs)::DOUBLE AS s1, sum(hs::DOUBLE * hs) AS s2 FROM c WHERE hs IS NOT NULL GROUP BY ALL),
hw AS (SELECT line, direction_id, stop_id, service_date, hour, coalesce(n, 0)::BIGINT AS n, coalesce(m, 0)::BIGINT AS m, coalesce(nc, 0)::BIGINT AS nc, coalesce(bunch, 0)::BIGINT AS bunch, coalesce(gap, 0)::BIGINT AS gap, coalesce(r1, 0) AS r1, coalesce(r2, 0) AS r2, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM r FULL JOIN p USING (line, direction_id, stop_id, service_date, hour))"""


def hw(spark, d) -> DataFrame:
    return regularity.headways(times(spark, d), 14400, F.unix_timestamp(F.col("service_date").cast("timestamp_ntz")))


@query(H + " SELECT * FROM hw")
def headways(spark, d):
    return hw(spark, d)


@query(H + """, g AS (SELECT line, sum(n) AS n, sum(m) AS m, sum(nc) AS nc, sum(bunch) AS bunch, sum(gap) AS gap, sum(r1) AS r1, sum(r2) AS r2, sum(s1) AS s1, sum(s2) AS s2 FROM hw GROUP BY line),
w AS (SELECT line, round(r2 / (2 * r1) / 60, 2) AS wr, round(s2 / (2 * s1) / 60, 2) AS ws, round(r1 / n / 60, 1) AS hr, round(s1 / m / 60, 1) AS hs, round((100 * bunch)::DOUBLE / nc, 1) AS bunch, round((100 * gap)::DOUBLE / nc, 1) AS gap, n::BIGINT AS nh FROM g)
SELECT line, wr, ws, round(wr - ws, 2) AS ew, hr, hs, bunch, gap, round(100 - bunch - gap, 1) AS ok, nh FROM w""")
def waits(spark, d):
    return regularity.waits(regularity.summed(hw(spark, d), ["line"]))


@query(T + """, k AS (SELECT line, direction_id, service_date, stop_id, count(DISTINCT trip_id) AS k FROM st GROUP BY ALL),
m AS (SELECT *, median(k) OVER (PARTITION BY line, direction_id, service_date) AS u FROM k)
SELECT st.* FROM st SEMI JOIN (SELECT * FROM m WHERE k >= 0.8 * u) g USING (line, direction_id, service_date, stop_id)""")
def covered_stops(spark, d):
    return regularity.covered_stops(times(spark, d))


@query(T + """, o AS (SELECT *, s - min(s) OVER (PARTITION BY line, trip_id, service_date) AS off FROM st),
x AS (SELECT line, direction_id, stop_id, service_date, median(off)::DOUBLE AS off_s FROM o GROUP BY ALL)
SELECT line, direction_id, stop_id, round(avg(off_s), 4) AS off_s, count(*) AS days FROM x GROUP BY ALL""")
def stop_offsets(spark, d):
    return rounded(regularity.stop_offsets(regularity.offsets(times(spark, d))))


@query(E + """, h AS (SELECT DISTINCT date_trunc('hour', ts) AS p, event_type FROM e),
s AS (SELECT unnest(generate_series(min(p)::TIMESTAMP, max(p)::TIMESTAMP, INTERVAL 1 HOUR)) AS p FROM h),
c AS (SELECT s.p, count(event_type) AS n, coalesce(string_agg(event_type, ',' ORDER BY event_type), '') AS c FROM s LEFT JOIN h ON h.p = s.p GROUP BY s.p)
SELECT p::DATE AS day, epoch(p)::BIGINT AS ts, n::BIGINT AS n_rows, coalesce(c = lag(c) OVER (PARTITION BY p::DATE ORDER BY p), false) AS frozen FROM c""")
def frozen_polls(spark, d):
    """Hours of events as polls, the types in them as their content."""
    rows = events(spark, d).select((F.floor(F.col("t") / 3600) * 3600).alias("ts"), "event_type").distinct()
    spine = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("ts"))
    return ingest.polls(rows, spine.select("ts", F.to_date(F.timestamp_seconds("ts")).alias("day")), ["event_type"])


@query(E + """, w AS (SELECT *, (t - lag(t) OVER o > 43200 OR abs(value - lag(value) OVER o) > 100 OR lag(t) OVER o IS NULL) AS nw FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM w)
SELECT event_id, session, max(t) OVER p - min(t) OVER p >= 86400 AS long FROM s WINDOW p AS (PARTITION BY user_id, session)""")
def stands(spark, d):
    return windows.sessions(events(spark, d), ["user_id"], "t", "value", ["t", "event_id"], 43200, 100, 86400).select("event_id", "session", "long")


@query(E + """, x AS (SELECT CASE WHEN hour < 4 THEN service_date - 1 ELSE service_date END AS service_date, CASE WHEN hour < 4 THEN hour + 24 ELSE hour END AS hour, user_id, event_type FROM e),
g AS (SELECT service_date, hour, user_id, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS n_feed, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS n_events FROM x GROUP BY ALL)
SELECT *, greatest(n_feed, n_events) AS n FROM g""")
def service_hours(spark, d):
    p = events(spark, d).groupBy("service_date", "hour", "user_id").agg(F.count_if(F.col("event_type") == "view").alias("n_feed"), F.count_if(F.col("event_type") == "click").alias("n_events"))
    return cube.on_service_day(p, ["user_id"])


#: Hours of a day with events enough to be usable.
UP = ", up AS (SELECT service_date, hour FROM e GROUP BY ALL HAVING count(*) >= 12)"


def busy(spark, d) -> DataFrame:
    return events(spark, d).groupBy("service_date", "hour").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12").select("service_date", "hour")


def fixes(spark, d) -> DataFrame:
    return events(spark, d).select("service_date", "hour", F.col("user_id").alias("link_key"), F.col("value").alias("w"), (F.col("event_type") == "error").alias("stop"), (F.col("value") > 100).alias("long"))


_SUMS = ", ".join(f"round(coalesce(sum(w) FILTER (WHERE hour >= {a} AND hour < {b} AND {'stop' if z == 's' else 'NOT stop'}{' AND long' if p == 'l' else ''}), 0), 4) AS {p}_{n}_{z}" for n, (a, b) in BANDS.items() for z in "rs" for p in ("ol" if n in ("day", "eve") else "o"))
_PASS = ", ".join(f"coalesce(sum(n) FILTER (WHERE hour >= {a} AND hour < {b}), 0)::DOUBLE AS p_{n}" for n, (a, b) in BANDS.items())
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [x.rsplit(" AS ", 1)[1] for part in (_SUMS, _PASS) for x in part.split(", ") if " AS " in x])
FX = E + ", fx AS (SELECT service_date, hour, user_id AS link_key, value AS w, event_type = 'error' AS stop, value > 100 AS long FROM e), ps AS (SELECT service_date, hour, user_id AS link_key, count(*)::DOUBLE AS n, count(*) FILTER (WHERE event_type <> 'view')::DOUBLE AS n_feed FROM e GROUP BY ALL)"


def passages(spark, d) -> DataFrame:
    return events(spark, d).groupBy("service_date", "hour", F.col("user_id").alias("link_key")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("event_type") != "view").cast("double").alias("n_feed"))


@query(FX + UP + f", o AS (SELECT service_date, link_key, {_SUMS} FROM fx GROUP BY ALL), p AS (SELECT service_date, link_key, {_PASS} FROM ps SEMI JOIN up USING (service_date, hour) GROUP BY ALL) SELECT service_date, link_key, {_FILLED} FROM o FULL JOIN p USING (service_date, link_key)")
def band_cube(spark, d):
    return rounded(cube.cube(fixes(spark, d), passages(spark, d), busy(spark, d), ["service_date", "link_key"]))


HL = FX + UP + """, o AS (SELECT service_date, hour, link_key, sum(w) FILTER (WHERE NOT stop) AS o_r, sum(w) FILTER (WHERE stop) AS o_s, sum(w) FILTER (WHERE NOT stop AND long) AS l_r, sum(w) FILTER (WHERE stop AND long) AS l_s FROM fx SEMI JOIN up USING (service_date, hour) GROUP BY ALL),
x AS (SELECT service_date, hour, link_key, coalesce(n, 0) AS n, coalesce(n_feed, 0) AS f, coalesce(o_r, 0) AS o_r, coalesce(o_s, 0) AS o_s, coalesce(l_r, 0) AS l_r, coalesce(l_s, 0) AS l_s, u IS NOT NULL AS ok FROM o FULL JOIN ps USING (service_date, hour, link_key) LEFT JOIN (SELECT *, 1 AS u FROM up) USING (service_date, hour)),
h AS (SELECT service_date, hour, link_key, n, o_r, o_s, l_r, l_s, ok, ok AND sum(f) OVER g >= 0.6 * sum(n) OVER g AS spd_ok FROM x WINDOW g AS (PARTITION BY service_date, hour))"""


def hourly(spark, d) -> DataFrame:
    hours = busy(spark, d)
    return cube.hourly(fixes(spark, d).join(hours, ["service_date", "hour"], "left_semi"), passages(spark, d), hours)


@query(HL + " SELECT service_date, hour, link_key, n, round(o_r, 4) AS o_r, round(o_s, 4) AS o_s, round(l_r, 4) AS l_r, round(l_s, 4) AS l_s, ok, spd_ok FROM h")
def hourly_links(spark, d):
    return rounded(hourly(spark, d))


LK = ", lk AS (SELECT DISTINCT user_id AS link_key, (200 + user_id % 400)::DOUBLE AS len_m, (user_id % 3)::INT AS term, user_id % 7 = 0 AS reg, user_id % 11 = 0 AS reg_r FROM events)"


def links(spark, d) -> DataFrame:
    u = F.col("user_id")
    return events(spark, d).select(u.alias("link_key"), (200 + u % 400).cast("double").alias("len_m"), (u % 3).cast("int").alias("term"), (u % 7 == 0).alias("reg"), (u % 11 == 0).alias("reg_r")).distinct()


@query(HL + LK + """, y AS (SELECT h.*, len_m, greatest(len_m - 75, 0) AS run, coalesce(spd_ok AND term <> 1, false) AND NOT coalesce(reg, false) AS whole, coalesce(spd_ok AND term <> 1, false) AND NOT coalesce(reg_r, false) AS inn FROM h LEFT JOIN lk USING (link_key))
SELECT service_date, hour, round(coalesce(sum(n * len_m), 0) / 1000, 4) AS km, round(coalesce(sum(n * len_m) FILTER (WHERE whole), 0), 4) AS d_s, round(coalesce(sum((o_r + o_s) * 20) FILTER (WHERE whole), 0), 4) AS t_s, round(coalesce(sum(n * run) FILTER (WHERE inn), 0), 4) AS d_r, round(coalesce(sum(o_r * 20) FILTER (WHERE inn), 0), 4) AS t_r FROM y GROUP BY ALL""")
def line_hours(spark, d):
    return rounded(cube.line_hours(hourly(spark, d), links(spark, d)))


@query(FX + f", o AS (SELECT service_date, link_key, {_SUMS} FROM fx GROUP BY ALL), p AS (SELECT service_date, link_key, {_PASS} FROM ps GROUP BY ALL)," + """
g AS (SELECT link_key, sum(o_day_r) AS a, sum(o_day_s) AS b, sum(o_eve_r) AS c, sum(o_eve_s) AS f, sum(l_day_r) AS la, sum(l_day_s) AS lb, sum(l_eve_r) AS lc, sum(l_eve_s) AS lf, sum(p_day) AS pd, sum(p_eve) AS pe FROM o JOIN p USING (service_date, link_key) WHERE isodow(service_date) <= 5 AND service_date <> DATE '2024-01-03' GROUP BY ALL)
SELECT link_key, (a + b) / pd - (c + f) / pe > 0 AND (la + lb) / pd - (lc + lf) / pe >= 0.5 * ((a + b) / pd - (c + f) / pe) AS reg, a / pd - c / pe > 0 AND la / pd - lc / pe >= 0.5 * (a / pd - c / pe) AS reg_r FROM g WHERE pd > 0 AND pe > 0""")
def regulation(spark, d):
    import datetime as dt

    hours = events(spark, d).select("service_date", "hour").distinct()
    return cube.regulated(rounded(cube.cube(fixes(spark, d), passages(spark, d), hours, ["service_date", "link_key"])), ["link_key"], [dt.date(2024, 1, 3)])


AB = E + """, g AS (SELECT t.event_type, d.service_date, h.hour::INT AS hour FROM (SELECT DISTINCT event_type FROM e) t, (SELECT DISTINCT service_date FROM e) d, (SELECT unnest(range(4, 28)) AS hour) h),
n AS (SELECT g.*, count(e.event_id) AS n FROM g LEFT JOIN e USING (event_type, service_date, hour) GROUP BY ALL),
u AS (SELECT event_type, hour FROM n GROUP BY ALL HAVING median(n) >= 3), ab AS (SELECT event_type, service_date, hour FROM n SEMI JOIN u USING (event_type, hour) WHERE n = 0)"""


@query(AB + " SELECT * FROM ab")
def line_absent(spark, d):
    e = events(spark, d)
    return coverage.absent_hours(coverage.hour_counts(e, ["event_type"]), e, ["event_type"], present=3)


CV = """, cv AS (SELECT service_date, hour, least(count(*) / 12.0, 1.0)::DOUBLE AS coverage, (CASE WHEN count(*) % 17 = 0 THEN 1 ELSE 0 END)::INT AS flags, (count(*) * 60)::DOUBLE AS covered_s, count(*)::BIGINT AS n_snapshots FROM e GROUP BY ALL)"""


def cov(spark, d) -> DataFrame:
    n = F.count(F.lit(1))
    return events(spark, d).groupBy("service_date", "hour").agg(F.least(n / 12.0, F.lit(1.0)).alias("coverage"), F.when(n % 17 == 0, 1).otherwise(0).alias("flags"), (n * 60).cast("double").alias("covered_s"), n.alias("n_snapshots"))


@query(AB + CV + ", a2 AS (SELECT DISTINCT service_date, hour, true AS a FROM ab WHERE event_type = 'click') SELECT service_date, hour, coverage, (CASE WHEN a THEN flags | 4 ELSE flags END)::INT AS flags FROM cv LEFT JOIN a2 USING (service_date, hour)")
def absence_flags(spark, d):
    e = events(spark, d)
    absent = coverage.absent_hours(coverage.hour_counts(e, ["event_type"]), e, ["event_type"], present=3).filter("event_type = 'click'")
    return coverage.with_absence(cov(spark, d), absent).select("service_date", "hour", "coverage", "flags")


@query(FX + CV + ", q AS (SELECT service_date, hour, sum(n_feed) < 0.6 * sum(n) AS p FROM ps GROUP BY ALL) SELECT service_date, hour, coverage, (CASE WHEN p THEN flags | 256 ELSE flags END)::INT AS flags FROM cv LEFT JOIN q USING (service_date, hour)")
def partial_feed(spark, d):
    return coverage.with_partial_feed(cov(spark, d), passages(spark, d)).select("service_date", "hour", "coverage", "flags")


DQ = E + CV + """, q AS (SELECT service_date, avg(coverage) AS coverage, count(*) FILTER (WHERE coverage < 0.8 OR flags & 3 <> 0) AS bad, count(*) FILTER (WHERE flags & 4 <> 0) AS absent, count(*) FILTER (WHERE coverage < 0.8 OR flags & 7 <> 0) AS unusable FROM cv WHERE hour BETWEEN 6 AND 20 GROUP BY ALL)"""


@query(DQ + " SELECT service_date, round(coverage, 4) AS coverage, bad, absent, unusable, CASE WHEN day(service_date) % 9 = 0 THEN 'not_ingested' WHEN day(service_date) % 11 = 0 THEN 'not_derived' WHEN bad > 3.75 + 1e-9 THEN 'low_coverage' WHEN unusable > 3.75 + 1e-9 THEN 'line_absent' ELSE 'ok' END AS status FROM q")
def coverage_days(spark, d):
    q = coverage.day_quality(cov(spark, d)).withColumns({"ingested": F.day("service_date") % 9 != 0, "derived": F.day("service_date") % 11 != 0, "obs": F.lit(1)})
    return rounded(coverage.day_status(q).drop("ingested", "derived", "obs"))


@query(DQ + ", d AS (SELECT service_date FROM cv WHERE hour BETWEEN 6 AND 20 GROUP BY ALL HAVING count(*) FILTER (WHERE NOT (coverage >= 0.8 AND flags & 7 = 0)) / 15.0 <= 0.25 + 1e-9) SELECT service_date, hour FROM cv SEMI JOIN d USING (service_date) WHERE coverage >= 0.8 AND flags & 7 = 0")
def usable_hours(spark, d):
    return coverage.usable_hours(cov(spark, d))[0]


@query(E + CV + " SELECT service_date, hour, CASE WHEN n_snapshots > 0 THEN covered_s / n_snapshots / 20 ELSE 1.0 END AS w FROM cv")
def report_weight(spark, d):
    return coverage.report_weight(cov(spark, d))


@query(E + """, s AS (SELECT service_date, hour, t, event_type = 'error' AS frozen FROM e), l AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY service_date ORDER BY t) - t, 900), 900) AS s FROM s WHERE NOT frozen),
a AS (SELECT service_date, hour, sum(s)::DOUBLE AS covered_s, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT service_date, hour, count(*) FILTER (WHERE frozen) AS f FROM s GROUP BY ALL)
SELECT service_date, hour, least(coalesce(covered_s, 0) / 3600, 1.0)::DOUBLE AS coverage, ((n IS NULL)::INT + 2 * (f > 0)::INT)::INT AS flags, coalesce(covered_s, 0) AS covered_s, coalesce(n, 0)::BIGINT AS n_snapshots FROM f LEFT JOIN a USING (service_date, hour)""")
def feed_coverage(spark, d):
    return coverage.feed_coverage(events(spark, d).select("service_date", "hour", F.col("t").alias("ts"), (F.col("event_type") == "error").alias("frozen")), 900)


@query("""WITH c AS (SELECT p_brand, p_size AS mark_m, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 60 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM c)
SELECT p_brand, mark_m, n, round(share::DOUBLE, 6) AS share FROM s WHERE mark_m % 2 = 0 AND n >= 3 AND share >= 0.04""")
def marks(spark, d):
    return rounded(zones.marks(table(spark, d, "part"), ["p_brand"], "p_size", least=3, share=0.04), 6)


@query("""WITH c AS (SELECT p_brand, p_size AS m, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 60 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM c)
SELECT p_brand, (max(m) + 1)::DOUBLE AS head_m FROM s WHERE m % 2 = 0 AND n >= 3 AND share >= 0.04 GROUP BY ALL""")
def heads(spark, d):
    return zones.heads(zones.marks(table(spark, d, "part"), ["p_brand"], "p_size", least=3, share=0.04), ["p_brand"])


@query(E + """, w AS (SELECT event_id, (user_id % 5 = lag(user_id % 5) OVER o AND hour = lag(hour) OVER o + 1) OR row_number() OVER o = 1 AS dep, event_type FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t)) SELECT event_id FROM w WHERE coalesce(dep, false) AND event_type <> 'error'""")
def departures(spark, d):
    x = events(spark, d).select("event_id", F.col("user_id").alias("track_id"), F.col("t").alias("ts"), F.col("hour").alias("link_idx"), (F.col("user_id") % 5).alias("pattern_uid"), (F.col("event_type") == "error").alias("at_stop"))
    return zones.departures(x, tie=["event_id"]).select("event_id")


@query(FX + LK + """, m AS (SELECT DISTINCT link_key FROM fx WHERE link_key % 4 = 0) SELECT event_id, value <= h OR value > len_m - 36 AS stop FROM (SELECT e.event_id, e.value, lk.len_m, CASE WHEN m.link_key IS NOT NULL THEN 55.0 ELSE 39.0 END AS h FROM e JOIN lk ON lk.link_key = e.user_id LEFT JOIN m ON m.link_key = e.user_id)""")
def stop_zone(spark, d):
    ln = links(spark, d).select("link_key", F.col("link_key").alias("pattern_uid"), F.lit(0).alias("link_idx"), "len_m")
    x = events(spark, d).select("event_id", F.col("user_id").alias("link_key"), F.col("user_id").alias("pattern_uid"), F.lit(0).alias("link_idx"), F.col("value").alias("pos_m")).join(ln.select("link_key"), "link_key", "left_semi")
    head = ln.filter("link_key % 4 = 0").select("link_key", F.lit(55.0).alias("head_m"))
    return zones.with_zone(x, ln.drop("link_key"), head).select("event_id", "stop")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) - 1 AS m FROM lineitem),
x AS (SELECT l.*, o_orderpriority = '1-URGENT' AS main, o_orderstatus = 'P' AS short FROM l JOIN orders ON o_orderkey = l_orderkey),
ends AS (SELECT DISTINCT l_partkey AS s FROM x WHERE i = 0 AND short)
SELECT l_suppkey AS link_key, median(l_quantity) AS len_m, (CASE WHEN bool_or(main AND (i = 0 OR i = m)) THEN 1 WHEN bool_or(l_partkey IN (SELECT s FROM ends)) THEN 2 ELSE 0 END)::INT AS term FROM x GROUP BY ALL""")
def link_roles(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderpriority") == "1-URGENT").alias("is_main"), (F.col("o_orderstatus") == "P").alias("short"))
    x = table(spark, d, "lineitem").withColumn("link_idx", F.row_number().over(w) - 1).join(o, "l_orderkey")
    stop = F.col("l_partkey")
    ln = x.select(F.col("l_orderkey").alias("pattern_uid"), "link_idx", F.col("l_suppkey").alias("link_key"), stop.alias("from_stop"), stop.alias("to_stop"), F.lit("a").alias("from_name"), F.lit("b").alias("to_name"), F.col("l_quantity").alias("len_m"))
    pats = x.filter("link_idx = 0 and short").select(F.array(stop, stop).alias("stop_ids"))
    return cube.link_roles(ln, pats, o.withColumnRenamed("l_orderkey", "pattern_uid")).select("link_key", "len_m", "term")


@query(E + """, dd AS (SELECT service_date, count(DISTINCT user_id) AS lines FROM e GROUP BY ALL), k AS (SELECT *, greatest(isodow(service_date) - 1, 4) AS k FROM dd),
p AS (SELECT a.service_date, a.lines, b.lines AS past, row_number() OVER (PARTITION BY a.service_date ORDER BY b.service_date DESC) AS r FROM k a LEFT JOIN k b ON a.k = b.k AND b.service_date < a.service_date AND b.service_date >= a.service_date - 28),
g AS (SELECT service_date, lines, count(past) AS c, list_sort(list(past) FILTER (WHERE r <= 10 AND past IS NOT NULL)) AS v FROM p GROUP BY ALL)
SELECT service_date AS date, lines, CASE WHEN c >= 3 THEN v[len(v) // 2 + 1] ELSE -1 END AS ref, coalesce(c >= 3 AND lines < 0.6 * v[len(v) // 2 + 1], false) AS partial FROM g""")
def partial_sources(spark, d):
    days = events(spark, d).groupBy(F.col("service_date").alias("date")).agg(F.count_distinct("user_id").alias("lines"))
    return ingest.partial_sources(days).fillna(-1, ["ref"])


IV = "WITH iv AS (SELECT o_orderkey AS k, o_custkey % 50 AS g, epoch(o_orderdate)::BIGINT // 86400 AS start, epoch(o_orderdate)::BIGINT // 86400 + (o_custkey % 7) AS fin FROM orders)"


def intervals(spark, d) -> DataFrame:
    """Every order as an interval of up to six days, of the group that its customer is in."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("g"), day.alias("start"), (day + F.col("o_custkey") % 7).alias("end"))


@query(IV + ", r AS (SELECT *, max(fin) OVER (PARTITION BY g ORDER BY start, fin DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv) SELECT g, start, fin AS \"end\" FROM r WHERE reach IS NULL OR fin > reach")
def chosen_parts(spark, d):
    return ingest.chosen_parts(intervals(spark, d), keys=["g"]).select("g", "start", "end")


@query(IV + ", s AS (SELECT g, start AS day, 0 AS side, fin FROM iv UNION ALL SELECT l_suppkey % 50, epoch(l_shipdate)::BIGINT // 86400, 1, NULL FROM lineitem), r AS (SELECT *, max(fin) OVER (PARTITION BY g ORDER BY day, side ROWS UNBOUNDED PRECEDING) AS reach FROM s) SELECT g, day, count(*) AS n FROM r WHERE side = 1 AND (reach IS NULL OR day >= reach) GROUP BY ALL")
def uncovered_polls(spark, d):
    pt = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), F.floor(F.unix_timestamp("l_shipdate") / 86400).alias("day"))
    return ingest.uncovered(pt, intervals(spark, d), ["g"], "day").groupBy("g", "day").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT k, n, row_number() OVER (ORDER BY k) AS r FROM s) SELECT k, n, pack FROM (WITH RECURSIVE w AS (SELECT k, n, r, 0 AS pack, n AS held FROM f WHERE r = 1 UNION ALL SELECT f.k, f.n, f.r, w.pack + (w.held > 0 AND w.held + f.n > (SELECT sum(n) FROM f) * 0.5)::INT, CASE WHEN w.held > 0 AND w.held + f.n > (SELECT sum(n) FROM f) * 0.5 THEN f.n ELSE w.held + f.n END FROM w JOIN f ON f.r = w.r + 1) SELECT k, n, pack::BIGINT AS pack FROM w)")
def bin_pack(spark, d):
    s = events(spark, d).groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.packed_groups(s, "k", "n", int(s.agg(F.sum("n")).first()[0] * 0.5))


@query(E + " SELECT event_type, sha256(string_agg(event_id::VARCHAR || ':' || user_id::VARCHAR, chr(10) ORDER BY event_id::VARCHAR || ':' || user_id::VARCHAR)) AS sha256 FROM e GROUP BY ALL")
def content_sha(spark, d):
    return windows.digest(events(spark, d), ["event_type"], ["event_id", "user_id"])


@query(E + " SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM e) WHERE i % 3 = 1")
def shard_rows(spark, d):
    return ingest.shard(events(spark, d), "event_id", 1, 3, ["user_id"]).select("event_id")


@query("SELECT event_id AS ts, user_id::VARCHAR AS line, event_type AS dir, 'p' AS point, floor(value)::INT AS dist FROM events")
def json_polls(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("ts"), F.to_json(F.struct(F.array(F.struct(F.col("user_id").cast("string").alias("lineId"), F.col("event_type").alias("directionId"), F.lit("p").alias("pointId"), F.floor("value").cast("int").alias("distanceFromPoint"))).alias("results"))).alias("payload"))
    return ingest.rows_from_json(e)


@query(E + """, x AS (SELECT service_date, hour, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT (service_date - DATE '2024-01-01') * 24 + hour AS ts, n, row_number() OVER (ORDER BY service_date, hour) - 1 AS i, count(*) OVER () AS c FROM x),
p AS (SELECT *, greatest(1, c // 7) AS st FROM f), q AS (SELECT * FROM p WHERE i % st = st - 1 OR st = 1 ORDER BY ts LIMIT 6)
SELECT count(*) AS sampled, count(*) FILTER (WHERE n > 1.05 * (n - 4 * (ts % 2)) + 3) AS short, count(*) FILTER (WHERE n > 1.05 * (n - 4 * (ts % 2)) + 3) >= least(2, count(*)) AS incomplete FROM q""")
def bulk_check(spark, d):
    ts = F.datediff("service_date", F.lit("2024-01-01").cast("date")) * 24 + F.col("hour")
    full = events(spark, d).groupBy(ts.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.short_samples(full, full.withColumn("n", F.col("n") - 4 * (F.col("ts") % 2)))


@query(E + ", x AS (SELECT event_id % 5000 AS ts, CASE WHEN event_id < 5000 THEN 0 ELSE 1 END AS p, event_type = 'error' AND event_id % 2 = 0 AS frozen FROM e) SELECT ts, arg_min(frozen, p) AS frozen FROM x GROUP BY ALL")
def snapshot_union(spark, d):
    e = events(spark, d).select((F.col("event_id") % 5000).alias("ts"), "event_id", ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("frozen"))
    return ingest.snapshots([e.filter("event_id < 5000").drop("event_id"), e.filter("event_id >= 5000").drop("event_id")]).select("ts", "frozen")
