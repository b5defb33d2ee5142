"""Month tables of all lines at once, and answers from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BANDS
from ..functions.exprs import chosen_day, in_band, tally, total
from ..operators import coverage, cube, network, pages, ranking, regularity, timetable, zones
from ..operators.windows import first_of
from ..session import empty
from .requests import Days, NetQuery, RankQuery

LINE, CELL, AT = ["line"], ["line", "service_date", "hour"], ["line", "service_date", "link_key"]


def month_tables(fixes: DataFrame, passages: DataFrame, links: DataFrame, patterns: DataFrame, pattern_days: DataFrame, cover: DataFrame, skip: list | None = None, hold: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """The tables of a month, for all lines in one plan: cube, days, roles, marks, hourly and linehours.

    fixes: line, track_id, ts, service_date, hour, pattern_uid, link_idx, link_key, pos_m, s_m, raw_dist_m, at_stop. passages: line,
    service_date, hour (of the clock), link_key, n_feed, n_events. links, patterns and pattern_days have a line; `cover` has each
    line's coverage and flags by hour. `skip`: days that the regulation test leaves out. A track belongs to one line.
    What several tables are made from goes through `hold`, which may write it and give it back as read, so that it is made once.
    """
    hours, days = coverage.usable_hours(cover, LINE)
    marks = hold("marks", zones.marks(zones.departures(fixes), ["line", "link_key"], "raw_dist_m"))
    head = zones.heads(marks, ["line", "link_key"])
    held = zones.with_zone(zones.stands(zones.prepared(fixes, marks, head, LINE)), links, head, LINE)
    fx = hold("fixes", zones.usable_fixes(held, hours, coverage.report_weight(cover, LINE), LINE).select(*AT, "hour", "w", "stop", "long"))
    filed = cube.on_service_day(passages, ["line", "link_key"])
    hourly = hold("hourly", cube.hourly(fx, filed, hours, scope=LINE))
    # hours that are usable but in which positions miss too many passages don't count in the cube
    unseen = hourly.filter("ok and not spd_ok").select(*CELL).distinct()
    seen = hours.join(unseen, CELL, "left_anti")
    own = hold("cube", cube.cube(fx.join(seen, CELL, "left_semi"), filed, seen, AT, LINE))
    roles = hold("roles", cube.link_roles(links, patterns, pattern_days, LINE).join(cube.regulated(own, ["line", "link_key"], skip), ["line", "link_key"], "left").fillna(False, ["reg", "reg_r"]))
    feed = cover.groupBy("service_date", "hour").agg(F.max("coverage").alias("coverage"), F.min("flags").alias("flags"))
    run = cube.with_feed(cube.line_hours(hourly, roles, head, scope=LINE), feed)
    return {"cube": own, "days": days, "roles": roles, "marks": marks, "hourly": hourly, "linehours": run}


def regularity_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Of stop events: headways, reglines and regstops."""
    seen = regularity.covered_stops(regularity.stop_times(events))
    hw = regularity.headways(seen)
    return {"headways": hw, "reglines": regularity.summed(hw, ["line", "service_date", "hour"]), "regstops": regularity.stop_offsets(regularity.offsets(seen))}


def run_and_plan(tables: dict[str, DataFrame], q: Days) -> tuple[DataFrame, DataFrame]:
    """`linehours` and `plan` in a request's dates, with their month; the plan of a line counts in months in which it has hours."""
    inside = F.col("service_date").between(q.first, q.last)
    run, plan = [tables[n].filter(inside).withColumn("month", F.date_format("service_date", "yyyy-MM")) for n in ("linehours", "plan")]
    return run, plan.join(run.select("line", "month").distinct(), ["line", "month"], "left_semi")


def days_out(spark: SparkSession, q: Days, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """((date, reason) of the days that a request names, the network's anomalies): public holidays, service classes of `daytrips`
    and its own periods; days without a feed and strikes, found in `linehours` and `plan`. Tables that aren't given find nothing."""
    span = spark.range(1).select(F.explode(F.sequence(F.lit(q.first), F.lit(q.last))).alias("date"))
    off = timetable.holidays(span.select(F.explode(F.array(F.year("date") - 1, F.year("date"), F.year("date") + 1)).alias("year")).distinct())
    classes = timetable.categories(tables["daytrips"], off, q.first, q.last) if "daytrips" in tables else empty(spark, "date date, service string")
    named = tuple(c for c, asked in (("school_holiday", q.school), ("reduced_service", q.reduced)) if asked == "exclude")
    mine = spark.createDataFrame([list(p) for p in q.exclude], "first date, last date")
    out = timetable.exclusions(span, off, classes, mine, q.holidays == "exclude", named)
    if "linehours" not in tables or "plan" not in tables:
        return out, None
    return out, network.anomalies(*run_and_plan(tables, q), classes.filter("service = 'reduced_service'"))


def unusual(found: DataFrame, q: Days) -> DataFrame:
    """(date, reason) of the anomalies that a request leaves out: days without a feed, and strikes if reduced days are out."""
    return found.filter(F.col("why").isin(["nofeed", "strike"] if q.reduced == "exclude" else ["nofeed"])).select(F.col("service_date").alias("date"), F.col("why").alias("reason"))


def left_out(spark: SparkSession, q: Days, tables: dict[str, DataFrame]) -> DataFrame:
    """(date, reason): the days that a request leaves out, one reason a day; there are no more rows than days asked for."""
    out, found = days_out(spark, q, tables)
    if found is None:
        return out
    return first_of(out.withColumn("_p", F.lit(0)).unionByName(unusual(found, q).withColumn("_p", F.lit(1))), ["date"], ["_p"]).drop("_p")


def network_page(tables: dict[str, DataFrame], q: NetQuery) -> dict[str, DataFrame]:
    """A request's network answer from the month tables `linehours`, `plan`, `modes` (line, mode) and, if given, `reglines`:

    months: a row a month and group (all lines, each mode, and `sel`, the lines asked for or those of the mode asked for): speeds, kilometres planned and run on
    the chosen days and hours, the same of the whole month (*_all), and the sums of headways. total: the same of all months.
    days: chosen and present days a month. left_out: the anomalies, and whether they are out.
    """
    q.check()
    spark = tables["linehours"].sparkSession
    run, plan = run_and_plan(tables, q)
    named, found = days_out(spark, q, tables)
    odd = unusual(found, q)
    date = lambda df: F.broadcast(df.select(F.col("date").alias("service_date")).distinct())
    whole = lambda df: df.join(date(odd), "service_date", "left_anti")
    chosen = lambda df: whole(df).join(date(named), "service_date", "left_anti").filter(chosen_day("service_date", list(q.dow)))
    hours = lambda df: chosen(df).filter(in_band("hour", q.hours))
    keys = ["line", "month"]
    every = network.line_month(whole(run), whole(plan), keys).select(*keys, *[F.col(c).alias(f"{c}_all") for c in ("real", "real_ok", "plan", "plan_ok")])
    rows = every.join(network.line_month(hours(run), hours(plan), keys), keys, "left")
    if "reglines" in tables:
        reg = tables["reglines"].filter(F.col("service_date").between(q.first, q.last)).withColumn("month", F.date_format("service_date", "yyyy-MM"))
        rows = rows.join(regularity.summed(hours(reg), keys), keys, "full")
    rows = rows.fillna(0).join(F.broadcast(tables["modes"]), "line", "left")
    asked = F.col("line").isin(list(q.lines)) if q.lines else F.col("mode") == q.mode
    sel = F.when(asked, F.lit("sel")) if q.lines or q.mode != "all" else F.lit(None).cast("string")
    rows = rows.withColumn("grp", F.explode(F.array_compact(F.array(F.lit("all"), F.col("mode"), sel))))
    present = run.select("service_date", "month").union(plan.select("service_date", "month")).distinct()
    days = whole(present).groupBy("month").agg(F.count(F.lit(1)).alias("days_all")).join(chosen(present).groupBy("month").agg(F.count(F.lit(1)).alias("days")), "month", "left").fillna(0, ["days"])
    return {
        "months": network.selected_values(rows, ["month", "grp"]), "total": network.selected_values(rows, ["grp"]), "days": days,
        "left_out": found.join(odd.select(F.col("date").alias("service_date"), F.lit(True).alias("out")), "service_date", "left").fillna(False, ["out"]),
    }


def asked_lines(q: RankQuery, tables: dict[str, DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the lines of a request: those it lists, else those of its mode."""
    if q.lines:
        return lambda df: df.filter(F.col("line").isin(list(q.lines)))
    if q.mode != "all":
        own = tables["modes"].filter(F.col("mode") == q.mode).select("line").distinct()
        return lambda df: df.join(F.broadcast(own), "line", "left_semi")
    return lambda df: df


def lost_time(tables: dict[str, DataFrame], q: RankQuery, out: DataFrame | None = None) -> DataFrame:
    """What each line and link loses in a request's days, hours and lines, with the reason to flag it, from the month tables: the
    cube, or the hourly table for hours other than the whole day. `out`: days that are left out, by default left_out()."""
    q.check()
    out = left_out(tables["days"].sparkSession, q, tables) if out is None else out
    lines = asked_lines(q, tables)
    off = F.broadcast(out.select(F.col("date").alias("service_date")))
    kept = lambda df: lines(df.filter(F.col("service_date").between(q.first, q.last) & chosen_day("service_date", list(q.dow)))).join(off, "service_date", "left_anti")
    own = kept(tables["cube"]) if q.hours == BANDS["day"] else ranking.hour_cube(kept(tables["hourly"]), q.hours, AT)
    usable = kept(tables["days"]).select("line", "service_date").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("D"))
    sums = ranking.window_sums(own, F.lit(True), ["line", "link_key"]).join(F.broadcast(usable), "line")
    named = [c for c in ("from_name", "to_name", "len_m") if c in tables["roles"].columns]
    lost = ranking.reasons(ranking.excess(sums, stops=q.stops), ranking.best_role(tables["roles"]).select("line", "link_key", "term", *named))
    return lost.withColumn("reason", F.lit(None).cast("string")) if q.terminus else lost


def ranking_answer(tables: dict[str, DataFrame], q: RankQuery, out: DataFrame | None = None) -> DataFrame:
    """The ranked lists of a request, by link."""
    return pages.ranked_lists(lost_time(tables, q, out), round(365.25 / 7 * len(set(q.dow))), q.shown)


def ranking_page(tables: dict[str, DataFrame], q: RankQuery, out: DataFrame | None = None) -> dict[str, DataFrame]:
    """A request's whole answer: `stretches` (kept and flagged, with the entries of their lines), `lines` (what each loses), and
    `envelope`, one row of totals. Links of equal names that run along each other (by `geometry`, if given) are one stretch."""
    lost, year = lost_time(tables, q, out), round(365.25 / 7 * len(set(q.dow)))
    geometry = tables.get("geometry")
    kept, flagged = lost.filter("reason is null"), lost.filter("reason is not null and veh_s_day > 0")
    main, other = pages.stretch_sums(kept, geometry), pages.stretch_sums(flagged, geometry)
    both = [pages.stretch_rows(x, n, year).withColumn("list", F.lit(name)) for x, n, name in ((main, q.shown, "kept"), (other, 10, "flagged"))]
    per_line = kept.filter("veh_s_day > 0").groupBy("line").agg((F.sum("veh_s_day") / 3600).alias("veh_h_day"))
    lose = main.withColumn("kept", F.lit(True)).unionByName(other.withColumn("kept", F.lit(False))).filter("veh_s_day > 0")
    sums = [x for p, here in (("total_", F.col("kept")), ("excluded_", ~F.col("kept"))) for x in (tally(here).alias(f"{p}n"), (total("veh_s_day", here) / 3600).alias(f"{p}veh_h_day"))]
    top = lose.agg(*sums).withColumns({"lines_used": lost.agg(F.count_distinct("line")).scalar(), "days_per_year": F.lit(year)})
    return {"stretches": both[0].unionByName(both[1]), "lines": per_line, "envelope": top}
