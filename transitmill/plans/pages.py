"""Queries of the pages: composite answers, on tables that stand for the feed's."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BANDS
from ..operators import analysis, pages, ranking, regularity, timetable
from . import answers, build
from .answers import DAYS, RK, RT, order_days, rank_links
from .feed import H, HL, T, hourly, hw, times
from .registry import E, events, query, rounded, table
from .requests import NetQuery, RankQuery

_SUMS = "sum(n)::BIGINT AS n, sum(m)::BIGINT AS m, sum(nc)::BIGINT AS nc, sum(bunch)::BIGINT AS bunch, sum(gap)::BIGINT AS gap, sum(r1) AS r1, sum(r2) AS r2, sum(s1) AS s1, sum(s2) AS s2"


@query(H + f""", day AS (SELECT * FROM hw WHERE hour >= 6 AND hour < 21), u AS (SELECT line, 'total' AS scope, -1 AS hour, '' AS stop_id, {_SUMS} FROM day GROUP BY line
UNION ALL SELECT line, 'hour', hour, '', {_SUMS} FROM hw GROUP BY line, hour UNION ALL SELECT line, 'stop', -1, stop_id, {_SUMS} FROM day GROUP BY line, direction_id, stop_id)
SELECT line, scope, hour, stop_id, n, m, nc, bunch, gap, r1, s1, round(coalesce(r2 / nullif(2 * r1, 0), -1), 4) AS real_s, round(coalesce(s2 / nullif(2 * s1, 0), -1), 4) AS plan_s FROM u""")
def line_regularity(spark, d):
    x = pages.regularity_scopes(hw(spark, d), BANDS["day"])
    wait = lambda a, b: F.round(F.coalesce(F.try_divide(b, F.col(a) * 2), F.lit(-1.0)), 4)
    count = [F.col(c).cast("long").alias(c) for c in regularity.COUNTS]
    return x.select("line", "scope", F.coalesce("hour", F.lit(-1)).alias("hour"), F.coalesce("stop_id", F.lit("")).alias("stop_id"), *count, "r1", "s1", wait("r1", F.col("r2")).alias("real_s"), wait("s1", F.col("s2")).alias("plan_s"))


@query(T + """, o AS (SELECT *, s - min(s) OVER (PARTITION BY line, trip_id, service_date) AS off FROM st), x AS (SELECT line, direction_id, stop_id, service_date, median(off)::DOUBLE AS off_s FROM o GROUP BY ALL),
p AS (SELECT line, direction_id, stop_id, day(service_date) // 10 AS part, avg(off_s) AS off_s, count(*) AS days FROM x GROUP BY ALL), g AS (SELECT line, direction_id, stop_id, sum(off_s * days) / sum(days) AS off_s, sum(days) AS days FROM p GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, max(days) OVER (PARTITION BY line, direction_id) AS most FROM g WHERE stop_id <> '3') WHERE days >= 0.5 * most)
SELECT line, direction_id, stop_id, round(off_s, 3) AS off_s, days::BIGINT AS days, row_number() OVER (PARTITION BY line, direction_id ORDER BY round(off_s, 3), stop_id)::INT AS place FROM k""")
def route_stops(spark, d):
    st = times(spark, d)
    daily = regularity.offsets(st)
    parts = daily.groupBy("line", "direction_id", "stop_id", F.floor(F.day("service_date") / 10).alias("part")).agg(F.avg("off_s").alias("off_s"), F.count(F.lit(1)).alias("days"))
    return rounded(pages.route_stops(st.filter("stop_id <> '3'"), parts), 3)


@query(DAYS + ", m AS (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM dd WHERE month(date) <> 6), w AS (SELECT m FROM m WHERE last_day(m) <= (SELECT max(date) FROM dd) ORDER BY m DESC LIMIT 3) SELECT min(m) AS first, last_day(max(m)) AS last FROM w")
def default_window(spark, d):
    days = order_days(spark, d)
    return pages.default_window(days.filter("month(date) <> 6").select(F.trunc("date", "month").alias("month")), days, 3)


@query("SELECT line, arg_max(o_orderpriority, (dt, -o_orderkey)) AS mode, max(dt) AS since, max(dt) < (SELECT max(o_orderdate)::DATE FROM orders) AS gone FROM (SELECT o_custkey % 400 AS line, o_orderdate::DATE AS dt, o_orderkey, o_orderpriority FROM orders) GROUP BY ALL")
def current_lines(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("line"), F.col("o_orderpriority").alias("mode"), F.to_date("o_orderdate").alias("since"), "o_orderkey")
    return pages.newest_lines(o, tie=["o_orderkey"]).select("line", "mode", "since", "gone")


@query(RK + """, g AS (SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'flagged' END AS list, link_key, sum(veh_s_day) AS v, sum(passages_day) AS p, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM z WHERE reason IS NULL OR veh_s_day > 0 GROUP BY ALL HAVING sum(veh_s_day) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY v DESC, link_key) AS rank FROM g) SELECT list, rank, link_key, round(v / 3600, 4) AS veh_h_day, round(v / 3600 * 261, 4) AS veh_h_year, round(v / p, 4) AS s_per_passage, reasons FROM r WHERE rank <= CASE list WHEN 'kept' THEN 20 ELSE 10 END""")
def ranking_lists(spark, d):
    return rounded(pages.ranked_lists(rank_links(spark, d), 261, 20))


@query(RT + """, cd AS (SELECT DATE '1996-01-01' AS date, 1 AS p, 'holiday' AS reason UNION ALL SELECT date, 2, 'reduced_service' FROM rt WHERE isodow(date) > 5 AND ratio < 0.75 UNION ALL SELECT date::DATE, 3, 'user_period' FROM (SELECT unnest(generate_series(TIMESTAMP '1996-04-25', TIMESTAMP '1996-06-05', INTERVAL 1 DAY)) AS date)),
x AS (SELECT date, arg_min(reason, p) AS reason FROM cd WHERE date IN (SELECT date FROM rt) GROUP BY ALL) SELECT reason, count(*) AS n FROM x WHERE isodow(date) <= 6 AND date IN (SELECT date FROM dd) GROUP BY ALL""")
def days_excluded(spark, d):
    r = timetable.service_ratios(order_days(spark, d))
    off = spark.createDataFrame([(dt.date(1996, 1, 1),)], "date date")
    mine = spark.createDataFrame([(dt.date(1996, 4, 25), dt.date(1996, 6, 5))], "first date, last date")
    out = timetable.exclusions(r, off, timetable.day_classes(r).filter(F.weekday("date") >= 5), mine)
    return pages.excluded_days(out, order_days(spark, d), range(6))


@query(DAYS + """, x AS (SELECT date FROM dd WHERE date BETWEEN DATE '1995-03-10' AND DATE '1996-02-29') SELECT date_trunc('month', date)::DATE AS month, count(*) FILTER (WHERE isodow(date) <= 5) AS days, count(*) AS days_all, day(last_day(date_trunc('month', date)))::BIGINT AS days_in_month, count(*) = day(last_day(date_trunc('month', date))) AS complete FROM x GROUP BY date_trunc('month', date)""")
def month_days(spark, d):
    return pages.month_days(order_days(spark, d), dt.date(1995, 3, 10), dt.date(1996, 2, 29))


@query(E + """, c AS (SELECT user_id % 50 AS link_key, floor(value)::INT % 6 AS seg, hour, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT link_key, sum(n) FILTER (WHERE hour >= 6 AND hour < 21) AS a, sum(n) FILTER (WHERE hour >= 20 AND hour < 24) AS b FROM (SELECT user_id % 50 AS link_key, hour, count(DISTINCT service_date) AS n FROM e GROUP BY ALL) GROUP BY ALL),
x AS (SELECT link_key, seg, a AS pa, coalesce(sum(n) FILTER (WHERE hour >= 6 AND hour < 21), 0) * 20 / a AS s, coalesce(sum(n) FILTER (WHERE hour >= 20 AND hour < 24), 0) * 20 / b AS r FROM c JOIN p USING (link_key) WHERE a > 0 AND b > 0 GROUP BY link_key, seg, a, b)
SELECT link_key, seg, round(s, 4) AS s_passage, round(r, 4) AS ref_s, round(s - r, 4) AS excess_s, round((s - r) * pa / 3600, 4) AS excess_h FROM x""")
def segment_excess(spark, d):
    e = events(spark, d).withColumn("link_key", F.col("user_id") % 50)
    cube = e.groupBy("link_key", (F.floor("value").cast("int") % 6).alias("seg"), "hour").agg(F.count(F.lit(1)).alias("n"))
    passages = e.groupBy("link_key", "hour").agg(F.count_distinct("service_date").alias("n"))
    return rounded(pages.segment_excess(cube, passages, BANDS["day"]))


@query(H + """, ea AS (SELECT line, stop_id, sum(r2) / nullif(2 * sum(r1), 0) - sum(s2) / nullif(2 * sum(s1), 0) AS ew_a FROM hw WHERE service_date < DATE '2024-01-15' GROUP BY ALL), eb AS (SELECT line, stop_id, sum(r2) / nullif(2 * sum(r1), 0) - sum(s2) / nullif(2 * sum(s1), 0) AS ew_b FROM hw WHERE service_date >= DATE '2024-01-15' GROUP BY ALL)
SELECT line, stop_id, round(ew_a, 4) AS ew_a, round(ew_b, 4) AS ew_b, round(ew_b - ew_a, 4) AS change FROM ea JOIN eb USING (line, stop_id) WHERE ew_a IS NOT NULL AND ew_b IS NOT NULL""")
def wait_change(spark, d):
    x, keys, cut = hw(spark, d), ["line", "stop_id"], F.lit(dt.date(2024, 1, 15))
    side = lambda keep: regularity.summed(x.filter(keep), keys)
    return rounded(pages.wait_change(side(F.col("service_date") < cut), side(F.col("service_date") >= cut), keys))


LENGTHS = (10.0, 20.0, 30.0, 50.0, 100.0)


def lengths_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("link_key"), (100 + F.col("user_id") % 200).cast("double").alias("len_m")).distinct()


@query(E + """, lk AS (SELECT DISTINCT user_id AS link_key, (100 + user_id % 200)::DOUBLE AS len_m FROM e), fx AS (SELECT link_key, len_m, floor(value) AS m FROM e JOIN lk ON link_key = user_id WHERE value < len_m), l AS (SELECT unnest([10.0, 20.0, 30.0, 50.0, 100.0])::DOUBLE AS length),
k AS (SELECT length, link_key, len_m, greatest(round(len_m / length)::INT, 1) AS n FROM lk, l), s AS (SELECT length, sum(n)::BIGINT AS segments FROM k GROUP BY ALL),
h AS (SELECT length, link_key, least(greatest(floor(m * n / len_m)::INT, 0), n - 1) AS seg, count(*) AS c FROM fx JOIN k USING (link_key, len_m) GROUP BY ALL), g AS (SELECT length, sum(c) AS c, count(*) FILTER (WHERE c >= 5) AS f FROM h GROUP BY ALL),
x AS (SELECT length, segments, coalesce(c, 0) / segments AS fixes, 1 - coalesce(f, 0) / segments AS sparse FROM s LEFT JOIN g USING (length))
SELECT length, segments, round(fixes, 4) AS fixes, round(sparse, 4) AS sparse, coalesce(length = (SELECT min(length) FROM x WHERE sparse <= 0.1), false) AS recommended FROM x""")
def segment_lengths(spark, d):
    e = events(spark, d)
    links = lengths_of(e)
    fixes = e.select(F.col("user_id").alias("link_key"), F.col("value").alias("pos_m")).join(links, "link_key").filter("pos_m < len_m").drop("len_m")
    return rounded(pages.segment_lengths(fixes, links, LENGTHS))


@query(E + """, c AS (SELECT event_type AS k, service_date < DATE '2024-01-15' AS early, sum(value) AS a, sum(hour) AS b FROM e GROUP BY ALL)
SELECT a.k AS event_type, round(a.a / a.b - b.a / b.b, 4) AS est FROM c a JOIN c b ON a.k = b.k AND a.early AND NOT b.early""")
def compared_estimates(spark, d):
    """The difference of a ratio between two periods; its interval is checked in the tests."""
    e = events(spark, d)
    cut = F.lit(dt.date(2024, 1, 15))
    x = analysis.bootstrap_difference(e.filter(F.col("service_date") < cut), e.filter(F.col("service_date") >= cut), ["event_type"], "value", "hour", rounds=20)
    return rounded(x.select("event_type", "est"))


_HOURS = {"day": (9, 17)} | {b: x for b, x in BANDS.items() if b != "day"}


@query(HL + ", k AS (SELECT link_key, service_date, " + ", ".join(f"coalesce(sum({c}) FILTER (WHERE hour >= {a} AND hour < {z}), 0) AS {n}" for b, (a, z) in _HOURS.items() for c, n in [("o_r", f"o_{b}_r"), ("o_s", f"o_{b}_s"), ("n", f"p_{b}"), *([("l_r", f"l_{b}_r"), ("l_s", f"l_{b}_s")] if b in ("day", "eve") else [])]) + """ FROM h WHERE spd_ok GROUP BY ALL),
g AS (SELECT link_key, count(*) FILTER (WHERE p_day > 0) AS n_days, sum(o_day_r + o_day_s) AS od, sum(o_eve_r + o_eve_s) AS oe, sum(p_day) AS pd, sum(p_eve) AS pe, sum(l_day_r + l_day_s) AS ld, sum(l_eve_r + l_eve_s) AS le FROM k GROUP BY ALL HAVING count(*) FILTER (WHERE p_day > 0) >= 2)
SELECT link_key, n_days, round((od / pd - oe / pe) * 20, 4) AS ex, round((ld / pd - le / pe) * 20, 4) AS ex_long FROM g WHERE pd > 0 AND pe > 0""")
def ranking_hours(spark, d):
    own = ranking.hour_cube(hourly(spark, d), (9, 17), ["link_key", "service_date"])
    return rounded(ranking.excess(ranking.window_sums(own, F.lit(True), ["link_key"], 2).withColumn("D", F.lit(1.0)), stops=True).select("link_key", "n_days", "ex", "ex_long"))


_DIFF = "WITH v AS (SELECT l_partkey AS link_key, sum(CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN l_quantity ELSE -l_quantity END) AS dv FROM lineitem GROUP BY ALL)"


@query(_DIFF + ", u AS (SELECT link_key, dv, row_number() OVER (ORDER BY dv DESC, link_key) AS rank, 'up' AS side FROM v WHERE dv > 0 UNION ALL SELECT link_key, dv, row_number() OVER (ORDER BY dv, link_key), 'down' FROM v WHERE dv < 0) SELECT * FROM u WHERE rank <= 12")
def two_sided(spark, d):
    early = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    v = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("link_key")).agg(F.sum(F.when(early, F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("dv"))
    return pages.two_sided(v, "dv", 12)


@query("SELECT line, row_number() OVER (ORDER BY length(line), line)::INT AS place FROM (SELECT DISTINCT (c_custkey % 130)::VARCHAR AS line FROM customer)")
def line_order(spark, d):
    return pages.in_line_order(table(spark, d, "customer").select((F.col("c_custkey") % 130).cast("string").alias("line")).distinct())


def request_tables(spark, d) -> dict[str, DataFrame]:
    """Line items as the tables that a ranking reads: return flags are lines, suppliers links, ship dates days."""
    cube = answers.rank_cube(spark, d)
    roles = table(spark, d, "supplier").select(F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("line"), F.col("s_suppkey").alias("link_key"), (F.col("s_suppkey") % 3).cast("int").alias("term"), F.col("s_name").alias("from_name"), F.col("s_name").alias("to_name"), F.col("s_acctbal").alias("len_m"))
    modes = spark.createDataFrame([("A", "tram"), ("N", "bus"), ("R", "tram")], "line string, mode string")
    return {"cube": cube, "days": cube.select("line", "service_date").distinct(), "roles": roles, "modes": modes}


def request() -> RankQuery:
    return RankQuery(dt.date(1996, 3, 1), dt.date(1997, 2, 28), mode="tram", stops=True, exclude=((dt.date(1996, 6, 10), dt.date(1996, 6, 14)), (dt.date(1996, 6, 13), dt.date(1996, 6, 21))))


_RQ = RK.replace("FROM lineitem WHERE isodow(l_shipdate) <= 5)", """FROM lineitem WHERE isodow(l_shipdate) <= 5 AND l_returnflag IN ('A', 'R') AND l_shipdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' AND l_shipdate::DATE NOT BETWEEN DATE '1996-06-10' AND DATE '1996-06-21'
AND l_shipdate::DATE NOT IN (DATE '1996-04-08', DATE '1996-05-01', DATE '1996-05-16', DATE '1996-05-27', DATE '1996-07-21', DATE '1996-08-15', DATE '1996-11-01', DATE '1996-11-11', DATE '1996-12-25', DATE '1997-01-01')), dn AS (SELECT line, count(DISTINCT sd::DATE)::DOUBLE AS D FROM c GROUP BY ALL)""").replace(" AS n_days, 100.0 AS D FROM c GROUP BY ALL", " AS n_days, any_value(D) AS D FROM c JOIN dn USING (line) GROUP BY line, link_key")


@query(_RQ + """, l AS (SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'flagged' END AS list, * FROM z WHERE reason IS NULL OR veh_s_day > 0),
g AS (SELECT list, link_key, sum(veh_s_day) AS v, sum(veh_s_day_run) AS r, sum(passages_day) AS p, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, string_agg(line || ':' || peak || ':' || n_days, ',' ORDER BY veh_s_day DESC, line) AS lines FROM l GROUP BY ALL HAVING sum(veh_s_day) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY v DESC, link_key) AS rank FROM g)
SELECT list, rank, link_key, round(v / 3600, 4) AS veh_h_day, round(v / 3600 * 261, 4) AS veh_h_year, round(r / 3600, 4) AS veh_h_day_run, round(p, 4) AS passages_day, round(v / p, 4) AS s_per_passage, reasons, lines FROM k WHERE rank <= CASE list WHEN 'kept' THEN 50 ELSE 10 END""")
def ranking_stretches(spark, d):
    """A request for trams on working days of a year, without public holidays and two periods of its own."""
    x = build.ranking_page(request_tables(spark, d), request())["stretches"]
    entry = F.array_join(F.transform("lines", lambda e: F.concat_ws(":", e["line"], e["peak"], e["n_days"].cast("string"))), ",")
    return rounded(x.select("list", "rank", "link_key", "veh_h_day", "veh_h_year", "veh_h_day_run", "passages_day", "s_per_passage", F.array_join("reasons", ",").alias("reasons"), entry.alias("lines")))


@query(_RQ + " SELECT line, round(sum(veh_s_day) / 3600, 4) AS veh_h_day FROM z WHERE reason IS NULL AND veh_s_day > 0 GROUP BY ALL")
def ranking_lines(spark, d):
    return rounded(build.ranking_page(request_tables(spark, d), request())["lines"])


@query(_RQ + """, a AS (SELECT reason IS NULL AS kept, link_key, sum(veh_s_day) AS v FROM z WHERE reason IS NULL OR veh_s_day > 0 GROUP BY ALL HAVING sum(veh_s_day) > 0)
SELECT count(*) FILTER (WHERE kept) AS total_n, round(sum(v) FILTER (WHERE kept) / 3600, 4) AS total_veh_h_day, count(*) FILTER (WHERE NOT kept) AS excluded_n, round(sum(v) FILTER (WHERE NOT kept) / 3600, 4) AS excluded_veh_h_day, (SELECT count(DISTINCT line) FROM z) AS lines_used, 261 AS days_per_year FROM a""")
def ranking_envelope(spark, d):
    return rounded(build.ranking_page(request_tables(spark, d), request())["envelope"])


def network_tables(spark, d) -> dict[str, DataFrame]:
    """Orders as hours of lines, run and planned: market segments are lines, customers spread over the hours."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("line")), "o_custkey")
    km, status = F.col("o_totalprice"), F.col("o_orderstatus")
    o = o.withColumns({"service_date": F.to_date("o_orderdate"), "hour": (F.col("o_custkey") % 24).cast("int")})
    part = F.when(status == "F", 0.7).when(status == "O", 0.95).otherwise(0.8)
    run = o.select("line", "service_date", "hour", (km * part).alias("km"), (status != "P").alias("feed_ok"), (km / 7).alias("d_s"), (km / 50).alias("t_s"), (km / 9).alias("d_r"), (km / 40).alias("t_r"))
    plan = o.select("line", "service_date", "hour", km.alias("km"), ((status != "P") | (F.col("o_custkey") % 2 == 0)).alias("feed_ok"))
    modes = spark.createDataFrame([("BUILDING", "metro"), ("AUTOMOBILE", "tram"), ("MACHINERY", "bus"), ("FURNITURE", "bus"), ("HOUSEHOLD", "bus")], "line string, mode string")
    return {"linehours": run, "plan": plan, "modes": modes}


def year_query() -> NetQuery:
    return NetQuery(dt.date(1996, 1, 1), dt.date(1996, 12, 31), lines=("MACHINERY", "AUTOMOBILE"), exclude=((dt.date(1996, 2, 5), dt.date(1996, 2, 20)),))


_NW = """WITH o AS (SELECT c_mktsegment AS line, o_orderdate::DATE AS dt, strftime(o_orderdate, '%Y-%m') AS month, (o_custkey % 24)::INT AS hour, o_totalprice AS k, o_orderstatus AS st, o_custkey AS cu FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'),
b AS (SELECT line, dt, month, hour, k * CASE st WHEN 'F' THEN 0.7 WHEN 'O' THEN 0.95 ELSE 0.8 END AS r, st <> 'P' AS rok, k AS p, st <> 'P' OR cu % 2 = 0 AS pok, CASE line WHEN 'BUILDING' THEN 'metro' WHEN 'AUTOMOBILE' THEN 'tram' ELSE 'bus' END AS mode FROM o),
dy AS (SELECT dt, sum(p) AS p, coalesce(sum(p) FILTER (WHERE pok), 0) AS q, coalesce(sum(r) FILTER (WHERE rok), 0) AS r FROM b GROUP BY ALL),
an AS (SELECT dt, CASE WHEN q < 0.5 * p THEN 'nofeed' WHEN r < 0.75 * q THEN 'strike' END AS why, CASE WHEN q < 0.5 * p THEN -1 ELSE round(100 * r / q) END::INT AS pct FROM dy WHERE q < 0.5 * p OR r < 0.75 * q),
w AS (SELECT b.*, isodow(dt) <= 5 AND dt NOT BETWEEN DATE '1996-02-05' AND DATE '1996-02-20' AND dt NOT IN (DATE '1996-01-01', DATE '1996-04-08', DATE '1996-05-01', DATE '1996-05-16', DATE '1996-05-27', DATE '1996-07-21', DATE '1996-08-15', DATE '1996-11-01', DATE '1996-11-11', DATE '1996-12-25') AS day FROM b ANTI JOIN an USING (dt)),
c AS (SELECT *, day AND hour >= 6 AND hour < 21 AS sel, mode <> 'metro' AS quick FROM w), g AS (SELECT *, unnest(['all', mode] || CASE WHEN line IN ('MACHINERY', 'AUTOMOBILE') THEN ['sel'] ELSE [] END) AS grp FROM c)"""
_NWV = """CASE WHEN sum(p) FILTER (WHERE sel AND quick) > 0 THEN round(sum(p / 7) FILTER (WHERE sel AND quick) / sum(p / 50) FILTER (WHERE sel AND quick) * 3.6, 2) END AS v, CASE WHEN sum(p) FILTER (WHERE sel AND quick) > 0 THEN round(sum(p / 9) FILTER (WHERE sel AND quick) / sum(p / 40) FILTER (WHERE sel AND quick) * 3.6, 2) END AS vr,
round(coalesce(sum(p) FILTER (WHERE sel), 0), 4) AS plan, round(coalesce(sum(r) FILTER (WHERE sel), 0), 4) AS real, CASE WHEN sum(p) FILTER (WHERE sel AND pok) > 0 THEN round(100 * coalesce(sum(r) FILTER (WHERE sel AND rok), 0) / sum(p) FILTER (WHERE sel AND pok), 1) END AS pct,
round(sum(p), 4) AS plan_all, round(sum(r), 4) AS real_all, CASE WHEN sum(p) FILTER (WHERE pok) > 0 THEN round(100 * coalesce(sum(r) FILTER (WHERE rok), 0) / sum(p) FILTER (WHERE pok), 1) END AS pct_all, count(DISTINCT line) AS n_lines FROM g"""


@query(_NW + " SELECT month, grp, " + _NWV + " GROUP BY month, grp")
def network_months(spark, d):
    return rounded(build.network_page(network_tables(spark, d), year_query())["months"])


@query(_NW + " SELECT grp, " + _NWV + " GROUP BY grp")
def network_total(spark, d):
    return rounded(build.network_page(network_tables(spark, d), year_query())["total"])


@query(_NW + " SELECT month, count(DISTINCT dt) AS days_all, count(DISTINCT dt) FILTER (WHERE day) AS days FROM w GROUP BY ALL")
def network_days(spark, d):
    return build.network_page(network_tables(spark, d), year_query())["days"]


@query(_NW + " SELECT dt AS service_date, why, pct, true AS out FROM an")
def network_left_out(spark, d):
    return build.network_page(network_tables(spark, d), year_query())["left_out"].fillna(-1, ["pct"])
