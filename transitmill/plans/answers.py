"""Queries of timetables, ranking, network, routes and comparison, on tables that stand for the feed's."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analysis, network, ranking, routes, stretches, timetable, windows
from .registry import E, events, query, rounded, table

DAYS = "WITH dd AS (SELECT o_orderdate::DATE AS date, count(*) AS trips FROM orders GROUP BY ALL)"


def order_days(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("trips"))


@query("""WITH t AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS a, max(epoch(l_shipdate)::BIGINT // 86400) AS b, o_totalprice AS km FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
x AS (SELECT *, unnest(range(a // 30, CASE WHEN b > a THEN (b - 1) // 30 ELSE a // 30 END + 1)) AS hour FROM t)
SELECT hour, round(sum(km * CASE WHEN b > a THEN (least(b, (hour + 1) * 30) - greatest(a, hour * 30))::DOUBLE / (b - a) ELSE 1 END), 2) AS km, sum((hour = a // 30)::INT)::BIGINT AS trips FROM x GROUP BY ALL""")
def trip_hours(spark, d):
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(day("l_shipdate")).alias("end_s"))
    t = table(spark, d, "orders").join(last, "o_orderkey").select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("start_s"), "end_s", F.col("o_totalprice").alias("km"))
    return rounded(timetable.trip_hours(t, unit=30).groupBy("hour").agg(F.sum("km").alias("km"), F.sum("trips").alias("trips")), 2)


CAL = """WITH cal AS (SELECT n_nationkey::VARCHAR AS service_id, DATE '2024-01-01' + n_regionkey * 7 AS a, DATE '2024-02-15' + n_nationkey AS b, n_nationkey AS k FROM nation),
ex AS (SELECT n_nationkey::VARCHAR AS service_id, DATE '2024-01-10' + n_nationkey AS date, 1 + n_regionkey % 2 AS kind FROM nation),
spread AS (SELECT service_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date, k FROM cal),
sv AS ((SELECT service_id, date FROM spread WHERE (k + isodow(date) - 1) % 3 = 0 UNION SELECT service_id, date FROM ex WHERE kind = 1) EXCEPT SELECT service_id, date FROM ex WHERE kind = 2)"""


def active(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    day = lambda text, k: F.date_add(F.lit(text).cast("date"), k)
    key = F.col("n_nationkey")
    cal = n.select(key.cast("string").alias("service_id"), day("2024-01-01", F.col("n_regionkey") * 7).alias("start_date"), day("2024-02-15", key).alias("end_date"), *[((key + i) % 3 == 0).cast("int").alias(w) for i, w in enumerate(timetable.WEEK)])
    ex = n.select(key.cast("string").alias("service_id"), day("2024-01-10", key).alias("date"), (1 + F.col("n_regionkey") % 2).alias("exception_type"))
    return timetable.services(cal, ex)


@query(CAL + " SELECT * FROM sv")
def feed_services(spark, d):
    return active(spark, d)


@query(CAL + ", c AS (SELECT c_nationkey::VARCHAR AS service_id, count(*) AS n FROM customer GROUP BY ALL) SELECT date, sum(n)::BIGINT AS trips FROM sv JOIN c USING (service_id) GROUP BY ALL")
def feed_trips(spark, d):
    return timetable.trips_by_date(active(spark, d), table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("service_id")))


@query(CAL + ", c AS (SELECT c_nationkey::VARCHAR AS service_id, c_mktsegment AS line, (c_custkey % 24)::INT AS hour, c_acctbal AS km, 1 AS trips FROM customer) SELECT line, date, hour, round(sum(km), 4) AS km, sum(trips)::BIGINT AS trips FROM sv JOIN c USING (service_id) GROUP BY ALL")
def plan_hours(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("service_id"), F.col("c_mktsegment").alias("line"), (F.col("c_custkey") % 24).cast("int").alias("hour"), F.col("c_acctbal").alias("km"), F.lit(1).alias("trips"))
    return rounded(timetable.plan_hours(active(spark, d), c, ["line"]))


@query(E + """, p AS (SELECT user_id, t, 4 + value / 500 AS lon, 50 + hour / 24.0 AS lat FROM e), s AS (SELECT user_id, 6371.0088 * sqrt(pow(radians(lon - lag(lon) OVER o) * cos(radians(lat)), 2) + pow(radians(lat - lag(lat) OVER o), 2)) AS s FROM p WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(coalesce(sum(s), 0), 4) AS km FROM s GROUP BY ALL""")
def shape_length(spark, d):
    p = events(spark, d).select("user_id", "t", "event_id", (4 + F.col("value") / 500).alias("lon"), (50 + F.col("hour") / 24.0).alias("lat"))
    return rounded(timetable.path_length(p, ["user_id"], ["t", "event_id"], "lon", "lat"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l), e AS (SELECT y, make_date(y, 3, 1) + (h + l - 7 * m + 21)::INT AS e FROM m)
SELECT e + k AS date FROM e, (VALUES (1), (39), (50)) v(k) UNION ALL SELECT make_date(y, mo, da) FROM y, (VALUES (1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)) f(mo, da)""")
def holidays(spark, d):
    return timetable.holidays(order_years(spark, d))


def order_years(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


RT = DAYS + """, k AS (SELECT date, trips::DOUBLE AS trips, CASE WHEN isodow(date) <= 5 THEN 0 ELSE isodow(date) - 1 END AS kd FROM dd),
s AS (SELECT *, list_sort(list(trips) OVER (PARTITION BY kd ORDER BY date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)) AS l, list_sort(list(trips) OVER (PARTITION BY kd ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 90 DAY FOLLOWING)) AS r FROM k),
f AS (SELECT date, trips, kd, least(l[floor(0.9 * (len(l) - 1) + 0.5)::INT + 1], r[floor(0.9 * (len(r) - 1) + 0.5)::INT + 1]) AS ref FROM s WHERE len(l) >= 5 AND len(r) >= 5),
g AS (SELECT *, list(trips) OVER (PARTITION BY kd ORDER BY date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 90 DAY FOLLOWING) AS ar FROM f WHERE ref > 0),
rt AS (SELECT date, trips, ref, trips / ref AS ratio FROM g WHERE kd <> 0 OR len(list_filter(ar, lambda x: x < 0.94 * ref)) <= 0.6 * len(ar))"""


@query(RT + " SELECT date, trips, ref, round(ratio, 6) AS ratio FROM rt")
def service_ratios(spark, d):
    return rounded(timetable.service_ratios(order_days(spark, d)), 6)


@query(RT + """, lo AS (SELECT date, ratio, (date - DATE '1970-01-05')::BIGINT // 7 * 5 + isodow(date) - 1 AS k FROM rt WHERE isodow(date) <= 5 AND ratio < 0.94),
nw AS (SELECT *, coalesce(k - lag(k) OVER (ORDER BY k) > 1, true) AS nw FROM lo), n AS (SELECT *, sum(nw::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM nw),
v AS (SELECT run, list_sort(list(ratio)) AS v FROM (SELECT run, ratio FROM n) GROUP BY run), x AS (SELECT rt.date, rt.ratio, v.v FROM rt LEFT JOIN n ON n.date = rt.date LEFT JOIN v ON v.run = n.run),
c AS (SELECT date, CASE WHEN ratio < 0.75 AND (isodow(date) > 5 OR len(v) < 5 OR ratio < 0.85 * v[len(v) // 2 + 1]) THEN 'reduced_service' WHEN isodow(date) <= 5 AND ratio < 0.94 THEN 'school_holiday' END AS service FROM x)
SELECT * FROM c WHERE service IS NOT NULL""")
def day_classes(spark, d):
    return timetable.day_classes(timetable.service_ratios(order_days(spark, d)))


@query(E + """, dd AS (SELECT DISTINCT user_id, service_date AS d FROM e), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d)::INT AS g FROM dd) SELECT user_id, min(d) AS first, max(d) AS last, count(*) AS n_days FROM g GROUP BY user_id, g""")
def islands(spark, d):
    return windows.islands(events(spark, d), ["user_id"], "service_date")


@query(E + """, i AS (SELECT DISTINCT user_id, greatest(service_date, DATE '2024-01-03') AS a, least(service_date + 1, DATE '2024-01-28') AS b FROM e WHERE event_type = 'purchase'), j AS (SELECT * FROM i WHERE a <= b),
m AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS n FROM j), s AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(a) AS first, max(b) AS last FROM s GROUP BY user_id, s""")
def norm_periods(spark, d):
    p = events(spark, d).filter("event_type = 'purchase'").select("user_id", F.col("service_date").alias("first"), F.date_add("service_date", 1).alias("last"))
    return windows.merged_periods(p, ["user_id"], "first", "last", F.lit(dt.date(2024, 1, 3)), F.lit(dt.date(2024, 1, 28)))


@query(RT + """, hd AS (SELECT DATE '1996-01-01' AS date UNION ALL SELECT DATE '1996-05-01'), sp AS (SELECT date FROM rt WHERE year(date) = 1996),
cd AS (SELECT date, 1 AS p, 'holiday' AS reason FROM hd UNION ALL SELECT date, 2, 'reduced_service' FROM rt WHERE isodow(date) > 5 AND ratio < 0.75 UNION ALL SELECT date::DATE, 3, 'user_period' FROM (SELECT unnest(generate_series(TIMESTAMP '1996-04-25', TIMESTAMP '1996-05-05', INTERVAL 1 DAY)) AS date))
SELECT date, arg_min(reason, p) AS reason FROM cd SEMI JOIN sp USING (date) GROUP BY ALL""")
def exclusions(spark, d):
    r = timetable.service_ratios(order_days(spark, d))
    classes = timetable.day_classes(r).filter(F.weekday("date") >= 5)
    off = spark.createDataFrame([(dt.date(1996, 1, 1),), (dt.date(1996, 5, 1),)], "date date")
    mine = spark.createDataFrame([(dt.date(1996, 4, 25), dt.date(1996, 5, 5))], "first date, last date")
    return timetable.exclusions(r.filter("year(date) = 1996"), off, classes, mine)


def rank_cube(spark, d) -> DataFrame:
    """Line items as a cube: status is the line, supplier the link, ship month the day."""
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    col = lambda c, n: F.when(c, q).otherwise(0.0).alias(n)
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("line"), F.col("l_suppkey").alias("link_key"), F.to_date("l_shipdate").alias("service_date"), col(k % 2 == 0, "o_day_r"), col(k % 3 == 0, "o_day_s"), col(k % 4 == 1, "o_eve_r"), col(k % 5 == 1, "o_eve_s"), col(k % 6 == 0, "l_day_r"), col(k == 6, "l_day_s"), col(k % 7 == 1, "l_eve_r"), col(k == 8, "l_eve_s"), col(k == 2, "o_am_r"), col(k == 3, "o_am_s"), col(k == 4, "o_pm_r"), col(k == 5, "o_pm_s"), F.when(k <= 4, 1.0).otherwise(0.0).alias("p_day"), F.when(k >= 3, 1.0).otherwise(0.0).alias("p_eve"), F.when(k == 2, 1.0).otherwise(0.0).alias("p_am"), F.when(k == 4, 1.0).otherwise(0.0).alias("p_pm"))


_C = {"o_day_r": "k % 2 = 0", "o_day_s": "k % 3 = 0", "o_eve_r": "k % 4 = 1", "o_eve_s": "k % 5 = 1", "l_day_r": "k % 6 = 0", "l_day_s": "k = 6", "l_eve_r": "k % 7 = 1", "l_eve_s": "k = 8", "o_am_r": "k = 2", "o_am_s": "k = 3", "o_pm_r": "k = 4", "o_pm_s": "k = 5"}
_P = {"p_day": "k <= 4", "p_eve": "k >= 3", "p_am": "k = 2", "p_pm": "k = 4"}
RK = "WITH c AS (SELECT l_returnflag AS line, l_suppkey AS link_key, l_quantity AS q, l_linenumber AS k, l_shipdate AS sd FROM lineitem WHERE isodow(l_shipdate) <= 5), s AS (SELECT line, link_key, " + ", ".join(f"coalesce(sum(q) FILTER (WHERE {c}), 0) AS {n}" for n, c in _C.items()) + ", " + ", ".join(f"(count(*) FILTER (WHERE {c}))::DOUBLE AS {n}" for n, c in _P.items()) + """, count(*) FILTER (WHERE k <= 4) AS n_days, 100.0 AS D FROM c GROUP BY ALL HAVING count(*) FILTER (WHERE k <= 4) >= 5),
x AS (SELECT *, ((o_day_r + o_day_s) / p_day - (o_eve_r + o_eve_s) / p_eve) * 20 AS ex, (o_day_r / p_day - o_eve_r / p_eve) * 20 AS ex_r, ((l_day_r + l_day_s) / p_day - (l_eve_r + l_eve_s) / p_eve) * 20 AS ex_long, ((o_am_r + o_am_s) / nullif(p_am, 0) - (o_eve_r + o_eve_s) / p_eve) * 20 AS ex_am, ((o_pm_r + o_pm_s) / nullif(p_pm, 0) - (o_eve_r + o_eve_s) / p_eve) * 20 AS ex_pm, p_day / D AS passages_day FROM s WHERE p_day > 0 AND p_eve > 0),
y AS (SELECT *, ex * passages_day AS veh_s_day, ex_r * passages_day AS veh_s_day_run, CASE WHEN ex > 0 THEN ex_long / ex END AS reg_share, link_key % 3 AS term FROM x),
z AS (SELECT *, CASE WHEN term = 1 THEN 'terminus' WHEN coalesce(reg_share, 0) >= 0.5 AND term = 2 THEN 'short_terminus' WHEN coalesce(reg_share, 0) >= 0.5 THEN 'holding' END AS reason, CASE WHEN coalesce(ex_am, 0) > 1.25 * coalesce(ex_pm, 0) THEN 'am' WHEN coalesce(ex_pm, 0) > 1.25 * coalesce(ex_am, 0) THEN 'pm' ELSE 'day' END AS peak FROM y)"""


def rank_links(spark, d) -> DataFrame:
    from ..functions.exprs import chosen_day

    sums = ranking.window_sums(rank_cube(spark, d), chosen_day("service_date", [0, 1, 2, 3, 4]), ["line", "link_key"]).withColumn("D", F.lit(100.0))
    roles = sums.select("line", "link_key", (F.col("link_key") % 3).alias("term"))
    return ranking.reasons(ranking.excess(sums, stops=True), roles)


@query(RK + " SELECT line, link_key, n_days, round(ex, 4) AS ex, round(passages_day, 4) AS passages_day, round(veh_s_day, 4) AS veh_s_day, round(veh_s_day_run, 4) AS veh_s_day_run, round(reg_share, 4) AS reg_share, reason, peak FROM z")
def ranking_links(spark, d):
    return rounded(rank_links(spark, d).select("line", "link_key", "n_days", "ex", "passages_day", "veh_s_day", "veh_s_day_run", "reg_share", "reason", "peak"))


@query(RK + """, g AS (SELECT link_key % 40 AS stretch, sum(veh_s_day) AS v, sum(passages_day) AS p, string_agg(DISTINCT link_key::VARCHAR, ',' ORDER BY link_key::VARCHAR) AS link_keys, string_agg(line, ',' ORDER BY veh_s_day DESC, line) AS lines FROM z GROUP BY ALL)
SELECT stretch, round(v, 4) AS veh_s_day, round(p, 4) AS passages_day, link_keys, lines, row_number() OVER (ORDER BY v DESC, stretch) AS rank FROM g WHERE v > 0 ORDER BY v DESC, stretch LIMIT 20""")
def ranking_topk(spark, d):
    x = rank_links(spark, d).withColumn("link_key", F.col("link_key").cast("string"))
    groups = x.select("link_key", (F.col("link_key").cast("long") % 40).alias("stretch")).distinct()
    return rounded(ranking.ranked(x, groups, 20))


@query(RK + " SELECT coalesce(reason, 'kept') AS reason, round(coalesce(sum(veh_s_day) FILTER (WHERE veh_s_day > 0), 0), 4) AS lost, count(*) FILTER (WHERE veh_s_day > 0) AS n FROM z GROUP BY ALL")
def ranking_totals(spark, d):
    return rounded(ranking.totals(rank_links(spark, d).withColumn("reason", F.coalesce("reason", F.lit("kept"))), ["reason"]))


NT = """WITH ru AS (SELECT c_mktsegment AS line, o_orderdate::DATE AS service_date, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS km, o_orderstatus <> 'P' AS feed_ok, o_totalprice / 7 AS d_s, o_totalprice / 50 AS t_s, o_totalprice / 9 AS d_r, o_totalprice / 40 AS t_r FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'O'),
pl AS (SELECT c_mktsegment AS line, o_orderdate::DATE AS service_date, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS km, o_orderstatus <> 'P' OR o_custkey % 2 = 0 AS feed_ok FROM orders JOIN customer ON c_custkey = o_custkey)"""


def run_and_plan(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("line")), "o_custkey")
    km, p = F.col("o_totalprice"), F.col("o_orderstatus") == "P"
    o = o.withColumns({"service_date": F.to_date("o_orderdate"), "month": F.date_format("o_orderdate", "yyyy-MM"), "km": km})
    run = o.filter("o_orderstatus <> 'O'").select("line", "service_date", "month", "km", (~p).alias("feed_ok"), (km / 7).alias("d_s"), (km / 50).alias("t_s"), (km / 9).alias("d_r"), (km / 40).alias("t_r"))
    return run, o.select("line", "service_date", "month", "km", (~p | (F.col("o_custkey") % 2 == 0)).alias("feed_ok"))


@query(NT + """, r AS (SELECT line, month, sum(km) AS real, coalesce(sum(km) FILTER (WHERE feed_ok), 0) AS real_ok, sum(d_s) AS d_s, sum(t_s) AS t_s, sum(d_r) AS d_r, sum(t_r) AS t_r FROM ru GROUP BY ALL), p AS (SELECT line, month, sum(km) AS plan, coalesce(sum(km) FILTER (WHERE feed_ok), 0) AS plan_ok FROM pl GROUP BY ALL),
m AS (SELECT line, month, coalesce(real, 0) AS real, coalesce(real_ok, 0) AS real_ok, coalesce(plan, 0) AS plan, coalesce(plan_ok, 0) AS plan_ok, CASE WHEN line = 'BUILDING' THEN 0 ELSE coalesce(d_s, 0) END AS d_s, CASE WHEN line = 'BUILDING' THEN 0 ELSE coalesce(t_s, 0) END AS t_s, CASE WHEN line = 'BUILDING' THEN 0 ELSE coalesce(d_r, 0) END AS d_r, CASE WHEN line = 'BUILDING' THEN 0 ELSE coalesce(t_r, 0) END AS t_r FROM r FULL JOIN p USING (line, month))
SELECT month, CASE WHEN grouping(line) = 1 THEN 'all' ELSE line END AS grp, CASE WHEN sum(t_s) > 0 THEN round(sum(d_s) / sum(t_s) * 3.6, 2) END AS v, CASE WHEN sum(t_r) > 0 THEN round(sum(d_r) / sum(t_r) * 3.6, 2) END AS vr, round(sum(plan), 2) AS plan, round(sum(real), 2) AS real, CASE WHEN sum(plan_ok) > 0 THEN round(100 * sum(real_ok) / sum(plan_ok), 1) END AS pct FROM m GROUP BY GROUPING SETS ((month, line), (month))""")
def network_groups(spark, d):
    rows = network.line_month(*run_and_plan(spark, d), ["line", "month"])
    return rounded(network.group_values(rows, "line", ["month"], speedless=("BUILDING",)), 2)


@query(NT + """, p AS (SELECT service_date, sum(km) AS p, coalesce(sum(km) FILTER (WHERE feed_ok), 0) AS q FROM pl GROUP BY ALL), r AS (SELECT service_date, coalesce(sum(km) FILTER (WHERE feed_ok), 0) AS r FROM ru GROUP BY ALL),
x AS (SELECT service_date, coalesce(r, 0) AS r, q, CASE WHEN q < 0.5 * p THEN 'nofeed' WHEN coalesce(r, 0) < 0.75 * q THEN 'strike' END AS why FROM p LEFT JOIN r USING (service_date) WHERE p > 0)
SELECT service_date, why, (CASE WHEN why = 'strike' THEN round(100 * r / q) ELSE -1 END)::INT AS pct FROM x WHERE why IS NOT NULL""")
def anomalies(spark, d):
    return network.anomalies(*run_and_plan(spark, d)).fillna(-1, ["pct"])


@query(E + " SELECT event_id, service_date FROM e WHERE service_date <= DATE '2024-01-20' AND (service_date < DATE '2024-01-15' AND hour < 12 OR hour >= 12)")
def month_spill(spark, d):
    e = events(spark, d).select("event_id", "service_date", "hour")
    return network.spill(e.filter("service_date < '2024-01-15' and hour < 12"), e.filter("hour >= 12"), F.lit(dt.date(2024, 1, 20))).select("event_id", "service_date")


@query("""WITH x AS (SELECT l_partkey AS link_key, l_returnflag AS line, l_quantity AS n, l_extendedprice AS d, l_extendedprice * l_discount * 2 AS t, l_linenumber AS n_days, n_name LIKE '%A' AS metro, l_linenumber = 1 AS term, s_acctbal AS len_m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
g AS (SELECT link_key, sum(n) AS n, coalesce(sum(d) FILTER (WHERE NOT metro), 0) AS d, coalesce(sum(t) FILTER (WHERE NOT metro), 0) AS t, max(n_days) AS n_days, bool_and(metro) AS metro, bool_or(term) AS term, median(len_m) AS len_m, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM x GROUP BY ALL HAVING sum(n) >= max(n_days))
SELECT link_key, n, n_days, metro, term, round(len_m, 4) AS len_m, lines, CASE WHEN d > 0 AND t > 0 AND d / t * 3.6 <= 70 THEN round(d / t * 3.6, 2) END AS v FROM g""")
def map_links(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    x = table(spark, d, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    price = F.col("l_extendedprice")
    return rounded(network.map_links(x.select(F.col("l_partkey").alias("link_key"), F.col("l_returnflag").alias("line"), F.col("l_quantity").alias("n"), price.alias("d"), (price * F.col("l_discount") * 2).alias("t"), F.col("l_linenumber").alias("n_days"), F.col("n_name").endswith("A").alias("metro"), (F.col("l_linenumber") == 1).alias("term"), F.col("s_acctbal").alias("len_m"))))


@query(E + """, st AS (SELECT event_type AS line, user_id AS stop_id, sum(value) AS r1, sum(value * value) * 50 AS r2, sum(hour)::DOUBLE AS s1, sum(hour * hour)::DOUBLE * 90 AS s2 FROM e GROUP BY ALL HAVING sum(hour) > 0),
lk AS (SELECT DISTINCT event_type AS line, user_id AS a, (user_id * 7 + 3) % 150 AS b, user_id % 40 AS link_key FROM e),
x AS (SELECT link_key, sb.r1, sb.r2, sb.s1, sb.s2, CASE WHEN sa.r1 IS NOT NULL AND sb.r1 IS NOT NULL THEN 1 ELSE 0 END AS k, sa.r1 AS ar1, sa.r2 AS ar2, sa.s1 AS as1, sa.s2 AS as2 FROM lk LEFT JOIN st sb ON sb.line = lk.line AND sb.stop_id = lk.b LEFT JOIN st sa ON sa.line = lk.line AND sa.stop_id = lk.a)
SELECT link_key, round(sum(r2) / nullif(sum(r1) * 120, 0) - sum(s2) / nullif(sum(s1) * 120, 0), 2) AS ew, round((sum(r2) FILTER (WHERE k = 1) / nullif(sum(r1) FILTER (WHERE k = 1) * 120, 0) - sum(s2) FILTER (WHERE k = 1) / nullif(sum(s1) FILTER (WHERE k = 1) * 120, 0)) - (sum(ar2) FILTER (WHERE k = 1) / nullif(sum(ar1) FILTER (WHERE k = 1) * 120, 0) - sum(as2) FILTER (WHERE k = 1) / nullif(sum(as1) FILTER (WHERE k = 1) * 120, 0)), 2) AS dew FROM x GROUP BY ALL""")
def link_regularity(spark, d):
    e = events(spark, d)
    st = e.groupBy(F.col("event_type").alias("line"), F.col("user_id").alias("stop_id")).agg(F.sum("value").alias("r1"), (F.sum(F.col("value") * F.col("value")) * 50).alias("r2"), F.sum("hour").cast("double").alias("s1"), (F.sum(F.col("hour") * F.col("hour")).cast("double") * 90).alias("s2")).filter("s1 > 0")
    st = st.select("*", *[F.lit(0).alias(c) for c in ("n", "m", "nc", "bunch", "gap")])
    lk = e.select(F.col("event_type").alias("line"), F.col("user_id").alias("from_stop"), ((F.col("user_id") * 7 + 3) % 150).alias("to_stop"), (F.col("user_id") % 40).alias("link_key")).distinct()
    return network.link_regularity(lk, st)


@query(E + ", dr AS (SELECT DISTINCT user_id, true AS dr FROM e WHERE user_id % 6 = 0) SELECT user_id, round(coalesce(sum(value) FILTER (WHERE dr IS NULL), 0), 4) AS value, sum(hour)::DOUBLE AS hour, count(DISTINCT service_date) AS days FROM e LEFT JOIN dr USING (user_id) GROUP BY ALL")
def month_totals(spark, d):
    e = events(spark, d)
    return rounded(network.month_totals(e, ["user_id"], ["value", "hour"], drop=e.filter("user_id % 6 = 0").select("user_id").distinct(), dropped=("value",)))


@query(E + " SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id FROM e GROUP BY ALL")
def keep_first(spark, d):
    return windows.first_of(events(spark, d), ["user_id"], ["t", "event_id"]).select("user_id", "event_id")


@query(E + ", n AS (SELECT event_id, service_date, event_type FROM e WHERE hour < 6 AND service_date < DATE '2024-01-10') SELECT event_id, service_date, event_type FROM e WHERE hour >= 6 AND service_date NOT IN (SELECT service_date FROM n) UNION ALL SELECT * FROM n")
def merge_days(spark, d):
    e = events(spark, d).select("event_id", "service_date", "event_type", "hour")
    return routes.merge_days(e.filter("hour >= 6").drop("hour"), e.filter("hour < 6 and service_date < '2024-01-10'").drop("hour"))


@query(E + """, w AS (SELECT DISTINCT service_date AS date FROM e), c AS (SELECT date, k AS rank, 'f' || ((day(date) + k) % 4) AS sha FROM w, (VALUES (0), (1), (2)) v(k)), h AS (SELECT DISTINCT service_date AS date, 'f' || (user_id % 4) AS sha FROM e WHERE hour = 5 AND event_type = 'click'),
f AS (SELECT c.* FROM c SEMI JOIN h USING (date, sha)) SELECT date, arg_min(sha, rank) AS sha FROM f GROUP BY ALL""")
def candidate_feed(spark, d):
    e = events(spark, d)
    wanted = e.select(F.col("service_date").alias("date")).distinct()
    cand = wanted.select("date", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rank")).withColumn("sha", F.concat(F.lit("f"), ((F.day("date") + F.col("rank")) % 4).cast("string")))
    held = e.filter("hour = 5 and event_type = 'click'").select(F.col("service_date").alias("date"), F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string")).alias("sha"))
    return windows.first_candidate(wanted, cand, held, ["date"], "sha", "rank")


@query(E + ", s AS (SELECT user_id, t, max(event_id) AS f FROM e WHERE event_type = 'signup' GROUP BY ALL) SELECT r.event_id, coalesce(s.f, -1) AS feed FROM (SELECT * FROM e WHERE event_type = 'error') r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.t >= s.t")
def feed_in_force(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "t")
    signups = e.filter("event_type = 'signup'").groupBy("user_id", F.col("t").alias("since")).agg(F.max("event_id").alias("f"))
    return windows.as_of(e.filter("event_type = 'error'"), signups, ["user_id"], "t", "since", "f", "feed").select("event_id", F.coalesce("feed", F.lit(-1)).alias("feed"))


@query(E + """, i AS (SELECT DISTINCT 'f' || (day(service_date) // 7) AS sha, service_date FROM e WHERE service_date < DATE '2024-01-25'), l AS (SELECT sha, max(service_date) AS m FROM i GROUP BY ALL)
SELECT sha, service_date FROM i UNION SELECT l.sha, x.service_date FROM l JOIN (SELECT DISTINCT service_date FROM i) x ON x.service_date > l.m AND x.service_date <= l.m + 7""")
def feed_dates(spark, d):
    i = events(spark, d).filter("service_date < '2024-01-25'").select(F.concat(F.lit("f"), F.floor(F.day("service_date") / 7).cast("string")).alias("sha"), "service_date").distinct()
    return routes.feed_dates(i)


RUNS = """WITH o AS (SELECT o_custkey % 60 AS k, o_orderkey, o_orderdate::DATE AS dt, left(o_orderpriority, 1) AS st FROM orders), n AS (SELECT *, (st IS DISTINCT FROM lag(st) OVER w OR row_number() OVER w = 1)::INT AS nw FROM o WINDOW w AS (PARTITION BY k ORDER BY dt, o_orderkey)),
u AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY dt, o_orderkey ROWS UNBOUNDED PRECEDING) AS r FROM n), rn AS (SELECT k, st, min(dt) AS first, max(dt) AS last, count(*) AS n_days, min(o_orderkey) AS ok FROM u GROUP BY k, r, st)"""


def route_runs(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 60).alias("k"), "o_orderkey", F.to_date("o_orderdate").alias("dt"), F.substring("o_orderpriority", 1, 1).alias("st"))
    return windows.runs(o, ["k"], ["dt", "o_orderkey"], "st", "dt")


@query(RUNS + " SELECT k, st, first, last, n_days FROM rn")
def pattern_runs(spark, d):
    return route_runs(spark, d)


@query(RUNS + """, g AS (SELECT k, st, sum(n_days)::BIGINT AS n_days, min(first) AS first, max(last) AS last, st::INT AS n_stops FROM rn GROUP BY ALL)
SELECT k, st, n_days, first, last, row_number() OVER (PARTITION BY k ORDER BY n_days DESC, n_stops DESC, last DESC, st) = 1 AS ref FROM g""")
def versions(spark, d):
    v = routes.versions(route_runs(spark, d).withColumn("n_stops", F.col("st").cast("int")), ["k"], "st")
    return v.select("k", "st", "n_days", "first", "last", "ref")


@query(RUNS + """, g AS (SELECT k, st, sum(n_days) AS n, max(last) AS last FROM rn GROUP BY ALL), f AS (SELECT k, st AS rs FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, st DESC, last DESC) AS r FROM g) WHERE r = 1),
q AS (SELECT rn.*, rs FROM rn JOIN f USING (k)), b AS (SELECT k, max(first) AS f FROM q WHERE st <> rs AND n_days >= 3 GROUP BY ALL), t AS (SELECT k, max(f) AS f, (SELECT max(st) FROM q z WHERE z.k = b.k AND z.first = b.f AND z.st <> z.rs AND n_days >= 3) AS before FROM b GROUP BY k, f)
SELECT * FROM (SELECT t.k, before, (SELECT min(first) FROM q z WHERE z.k = t.k AND z.st = z.rs AND z.first > t.f) AS since FROM t) WHERE since IS NOT NULL""")
def lasting_change(spark, d):
    r = route_runs(spark, d)
    ref = routes.versions(r.withColumn("n_stops", F.col("st").cast("int")), ["k"], "st").filter("ref")
    return routes.lasting_change(r, ref, ["k"], "st", 3).select("k", "before", "since").filter("since is not null")


@query("""WITH a AS (SELECT l_partkey AS link_key, sum(l_quantity) / 10 AS v, count(*)::DOUBLE AS pd FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL), b AS (SELECT l_partkey AS link_key, sum(l_quantity) / 10 AS v, count(*)::DOUBLE AS pd FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL)
SELECT a.link_key, round(a.v - b.v, 4) AS dv, round(p_retailprice * 3.6 / a.v - p_retailprice * 3.6 / b.v, 4) AS ds, round((p_retailprice * 3.6 / a.v - p_retailprice * 3.6 / b.v) * a.pd / 3600, 4) AS dh FROM a JOIN b USING (link_key) JOIN part ON p_partkey = a.link_key WHERE a.pd >= 5 AND b.pd >= 5""")
def compare_periods(spark, d):
    li = table(spark, d, "lineitem")
    size = table(spark, d, "part").select(F.col("p_partkey").alias("link_key"), F.col("p_retailprice").alias("len_m"))
    side = lambda keep: li.filter(keep).groupBy(F.col("l_partkey").alias("link_key")).agg((F.sum("l_quantity") / 10).alias("v"), F.count(F.lit(1)).cast("double").alias("pd"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return rounded(analysis.compared(side(F.col("l_shipdate") < cut).join(size, "link_key"), side(F.col("l_shipdate") >= cut)))


@query(E + " SELECT user_id AS link_key, least(greatest(floor(value * greatest(round((100 + user_id) / 30.0)::INT, 1) / (100 + user_id))::INT, 0), greatest(round((100 + user_id) / 30.0)::INT, 1) - 1)::INT AS seg, count(*) AS n FROM e WHERE value < 100 + user_id GROUP BY ALL")
def segment_counts(spark, d):
    e = events(spark, d)
    size = e.select(F.col("user_id").alias("link_key"), (100 + F.col("user_id")).cast("double").alias("len_m")).distinct()
    fx = e.select(F.col("user_id").alias("link_key"), F.col("value").alias("pos_m")).join(size, "link_key").filter("pos_m < len_m").drop("len_m")
    return analysis.segment_counts(fx, size)


@query("WITH p AS (SELECT p_partkey AS link_key, p_retailprice AS len_m, greatest(ceil(p_retailprice / 200)::INT, 1) AS n FROM part), s AS (SELECT *, unnest(range(0, n))::INT AS seg FROM p) SELECT link_key, seg, round(len_m * seg / n, 4) AS a_m, round(len_m * (seg + 1) / n, 4) AS b_m FROM s")
def segments(spark, d):
    return rounded(analysis.segments(table(spark, d, "part").select(F.col("p_partkey").alias("link_key"), F.col("p_retailprice").alias("len_m")), 200.0, grid="equal"))


@query(E + ", w AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1 AS en FROM e) SELECT service_date, hour, event_type, count(*)::DOUBLE AS n_feed FROM w WHERE en GROUP BY ALL")
def link_passages(spark, d):
    return analysis.passages(events(spark, d), "user_id", ["t", "event_id"], ["event_type"])


@query(E + " SELECT event_type, round(quantile_cont(value, 0.995), 4) AS flen, count(*) AS n FROM e GROUP BY ALL")
def feed_lengths(spark, d):
    return rounded(analysis.feed_lengths(events(spark, d), ["event_type"], "value"))


@query(E + ", dy AS (SELECT user_id, count(*) AS n, avg(value) AS flen FROM e WHERE hour < 12 GROUP BY ALL), mo AS (SELECT user_id, count(*) AS n, max(value) AS flen FROM e GROUP BY ALL) SELECT user_id, dy.n, round(coalesce(CASE WHEN mo.n >= 67 THEN mo.flen END, dy.flen), 4) AS flen FROM dy LEFT JOIN mo USING (user_id)")
def incremental_lengths(spark, d):
    e = events(spark, d)
    day = e.filter("hour < 12").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("flen"))
    month = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("flen"))
    return rounded(routes.with_feed_lengths(day, month, ["user_id"], 67))


@query("WITH m AS (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT seg, month, n, CASE WHEN lag(month) OVER w + INTERVAL 1 MONTH = month THEN lag(n) OVER w ELSE -1 END AS prev FROM m WINDOW w AS (PARTITION BY seg ORDER BY month)")
def month_tiles(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return analysis.month_delta(o.groupBy(F.col("c_mktsegment").alias("seg"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n")), ["seg"], "month", "n").fillna(-1, ["prev"])


@query()
def bootstrap(spark, d):
    return rounded(analysis.bootstrap(events(spark, d), ["event_type"], "value", "hour"))


@query()
def stretch_merge(spark, d):
    """Parts as links: brand and type name them, and parts of even size lie beside each other."""
    p = table(spark, d, "part")
    y = F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 0.00001).otherwise(F.col("p_size") * 0.01) + 50.0
    geo = F.array(F.array(F.lit(4.30), y), F.array(F.lit(4.31), y), F.array(F.lit(4.32), y))
    return stretches.merge(p.select(F.col("p_partkey").alias("link_key"), F.col("p_brand").alias("from_name"), F.col("p_type").alias("to_name"), F.col("p_retailprice").alias("cost"), geo.alias("geometry")))


@query()
def route_order(spark, d):
    e = events(spark, d)
    times = e.groupBy(F.col("event_type").alias("line"), (F.col("user_id") % 30).cast("string").alias("stop_id")).agg(F.avg("value").alias("off_s"))
    edges = e.select(F.col("event_type").alias("line"), (F.col("user_id") % 30).cast("string").alias("from_stop"), ((F.col("user_id") * 3 + 1) % 30).cast("string").alias("to_stop")).distinct()
    return network.route_order(edges, times, ["line"])


@query()
def route_changes(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w))
    g = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("l_quantity") * 10).alias("a"), (F.col("l_quantity") * 10 + F.when(F.col("l_tax") > 0.06, 200).otherwise(0)).alias("b")))).alias("v"))
    names = F.transform(F.sequence(F.lit(0), F.size("v")), lambda i: i.cast("string"))
    return routes.route_changes(g.select("l_orderkey", F.transform("v", lambda s: s["a"]).alias("ref"), F.transform("v", lambda s: s["b"]).alias("own"), names.alias("names")), ["l_orderkey"])


@query("SELECT p_name, string_agg(upper(left(w, 1)) || lower(w[2:]), ' ' ORDER BY i) AS title FROM (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY ALL")
def title_names(spark, d):
    from ..functions.exprs import title_case

    return table(spark, d, "part").select("p_name", title_case(F.upper("p_name")).alias("title")).distinct()


@query(E + """, i AS (SELECT DISTINCT service_date, 'f' || (day(service_date) // 4 % 2) AS sha FROM e), n AS (SELECT *, (sha IS DISTINCT FROM lag(sha) OVER (ORDER BY service_date))::INT AS nw FROM i), r AS (SELECT *, sum(nw) OVER (ORDER BY service_date) AS r FROM n)
SELECT sha, min(service_date) AS first, max(service_date) AS last, count(*) AS n_days FROM r GROUP BY r, sha""")
def feed_runs(spark, d):
    i = events(spark, d).select("service_date", F.concat(F.lit("f"), (F.floor(F.day("service_date") / 4) % 2).cast("string")).alias("sha")).distinct()
    return routes.feed_runs(i)


@query("""WITH s AS (SELECT l_orderkey AS trip, l_linenumber AS q, min(l_suppkey % 20) AS st FROM lineitem GROUP BY ALL), t AS (SELECT o_orderstatus AS line, l.trip, string_agg(st::VARCHAR, '>' ORDER BY q) AS stops FROM s l JOIN orders ON o_orderkey = l.trip GROUP BY ALL)
SELECT line, count(*) AS trips, count(DISTINCT stops) AS patterns FROM t GROUP BY ALL""")
def trip_patterns(spark, d):
    st = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")).agg(F.min(F.col("l_suppkey") % 20).cast("string").alias("stop_id"))
    tr = table(spark, d, "orders").select(F.col("o_orderstatus").alias("line"), F.lit(0).alias("direction_id"), F.col("o_orderkey").alias("trip_id"))
    return routes.patterns(st, tr).groupBy("line").agg(F.count(F.lit(1)).alias("trips"), F.count_distinct("pattern_uid").alias("patterns"))


@query("""WITH s AS (SELECT l_orderkey AS trip, l_linenumber AS q, min(l_suppkey % 20) AS st FROM lineitem GROUP BY ALL), x AS (SELECT DISTINCT string_agg(st::VARCHAR, '>' ORDER BY q) AS stops FROM s JOIN orders ON o_orderkey = s.trip GROUP BY trip),
l AS (SELECT string_split(stops, '>') AS v FROM x), p AS (SELECT v, unnest(range(1, len(v))) AS i FROM l) SELECT v[i] || '>' || v[i + 1] || '~0' AS link_key, count(*) AS n FROM p GROUP BY ALL""")
def pattern_links(spark, d):
    st = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")).agg(F.min(F.col("l_suppkey") % 20).cast("string").alias("stop_id"))
    tr = table(spark, d, "orders").select(F.lit("x").alias("line"), F.lit(0).alias("direction_id"), F.col("o_orderkey").alias("trip_id"))
    return routes.pattern_links(routes.patterns(st, tr)).groupBy("link_key").agg(F.count(F.lit(1)).alias("n"))


@query("WITH i AS (SELECT o_orderkey AS date, o_totalprice AS w FROM orders), d AS (SELECT o_orderkey AS date, o_totalprice - (o_custkey % 3 - 1) AS p FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT i.date, w AS written_at FROM i LEFT JOIN d USING (date) WHERE p IS NULL OR w > p")
def stale_days(spark, d):
    o = table(spark, d, "orders")
    derived = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    done = o.join(derived, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("date"), (F.col("o_totalprice") - (F.col("o_custkey") % 3 - 1)).alias("placed_at"))
    return routes.stale_days(o.select(F.col("o_orderkey").alias("date"), F.col("o_totalprice").alias("written_at")), done)


@query("""WITH g AS (SELECT o_custkey % 200 AS k, left(o_orderstatus, 1) AS st, list_sort(list(DISTINCT left(o_orderpriority, 1))) AS s, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT k, arg_max(s, (n, st)) AS rs, arg_max(st, (n, st)) AS f FROM g GROUP BY ALL)
SELECT k, st, array_to_string(list_sort(list_filter(rs, lambda x: NOT list_contains(s, x))), ',') AS removed, array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(rs, x))), ',') AS added FROM g JOIN r USING (k) WHERE st <> f""")
def stop_changes(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("k"), F.col("o_orderstatus").alias("st")).agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("stops"), F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("k").orderBy(F.col("n").desc(), F.col("st").desc())
    x = routes.stop_changes(o.withColumn("ref", F.row_number().over(best) == 1), ["k"])
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return x.filter("not ref").select("k", "st", joined("removed"), joined("added"))


@query(E + """, f AS (SELECT event_type AS source, floor(value)::INT % 10 * 10 AS dist, hour % 4 AS k FROM e), l AS (SELECT k, 100.0 + k * 20 AS len_m FROM (VALUES (0), (1), (2), (3)) v(k))
SELECT source, k, count(*) AS n, round(avg(least(len_m, dist * CASE WHEN k < 3 THEN len_m / 80.0 ELSE 1 END)), 4) AS pos FROM f JOIN l USING (k) GROUP BY ALL""")
def placed_fixes(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("source"), (F.floor("value").cast("int") % 10 * 10).alias("dist"), (F.col("hour") % 4).alias("k"))
    size = e.select("k").distinct().withColumn("len_m", 100.0 + F.col("k") * 20)
    x = analysis.placed(e, size, size.filter("k < 3").withColumn("flen", F.lit(80.0)), ["k"])
    return rounded(x.groupBy("source", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("pos_m").alias("pos")))
