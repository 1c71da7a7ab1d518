"""Queries on ``events``: a user is a session key, props' k a message id, value a counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import activity as A
from tallymark.operators import concurrency, counting, joins, ledger, profile, scans, scoring
from tallymark.session import table

USER = ["user_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a whole counter ``v`` (hundredths of value) and message id ``k``."""
    return table(spark, sf_dir, "events").withColumns({"v": F.floor(F.col("value") * 100).cast("long"), "k": F.get_json_object("props", "$.k").cast("long")})


def today(df: DataFrame):
    """The latest day of the table, as a plan: rows with it attached by a one-row cross join."""
    return df.crossJoin(F.broadcast(df.agg(F.max(F.to_date("ts")).alias("today"))))


def user_profile(spark, sf_dir):
    """Each user's active time, streaks and days: the flagship."""
    e = events(spark, sf_dir)
    days = A.streaks(today(e), ["user_id", "today"], F.to_date("ts"), F.col("today")).drop("today")
    return A.capped_minutes(e, USER, "ts").join(days, "user_id").join(A.span(e, USER, "ts"), "user_id")


def active_time_by_user(spark, sf_dir):
    return A.capped_minutes(events(spark, sf_dir), USER, "ts")


def active_minutes_thr15(spark, sf_dir):
    return A.threshold_micros(events(spark, sf_dir), USER, "ts", 15)


def active_minutes_tight(spark, sf_dir):
    return A.threshold_micros(events(spark, sf_dir), USER, "ts", 1)


def _streaks(spark, sf_dir, column):
    e = today(events(spark, sf_dir).where("event_type = 'purchase'"))
    return A.streaks(e, ["user_id", "today"], F.to_date("ts"), F.col("today")).select("user_id", column)


def streak_longest(spark, sf_dir):
    return _streaks(spark, sf_dir, "longest")


def streak_current_grace(spark, sf_dir):
    return _streaks(spark, sf_dir, "current_grace")


def streak_current_strict(spark, sf_dir):
    return _streaks(spark, sf_dir, "current_strict")


def hour_histogram(spark, sf_dir):
    return A.hour_histogram(events(spark, sf_dir), "ts")


def weekend_ratio_bp(spark, sf_dir):
    return A.weekend_ratio(events(spark, sf_dir), USER, "ts")


def night_minutes_by_month(spark, sf_dir):
    return A.night_minutes(events(spark, sf_dir), USER, "ts")


def active_days_by_user(spark, sf_dir):
    return A.span(events(spark, sf_dir), USER, "ts")


def calendar_strip(spark, sf_dir):
    return A.calendar_strip(events(spark, sf_dir), F.to_date("ts")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events")


def gap_sessions(spark, sf_dir):
    return A.gap_sessions(events(spark, sf_dir), USER, "ts", 15)


def _intervals(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("day", "user_id").agg(F.min(A.micros("ts")).alias("st"), F.max(A.micros("ts")).alias("en"))


def concurrency_peak(spark, sf_dir):
    return concurrency.sweep(_intervals(spark, sf_dir), ["day"], "st", "en").select("day", "peak")


def concurrency_weighted(spark, sf_dir):
    return concurrency.sweep(_intervals(spark, sf_dir), ["day"], "st", "en").select("day", "covered", "multi", "integral")


def usage_max_dedup_total(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("id", F.concat_ws("-", "user_id", "k"))
    return counting.max_per_id(e, "id", ["v"]).agg(F.count(F.lit(1)).alias("ids"), F.sum("v").cast("long").alias("total"))


def usage_running_credit(spark, sf_dir):
    e = scans.even_segments(events(spark, sf_dir), "event_id")
    e = counting.running_credit(e, "k", ["event_id"], "v", ["segment"])
    return e.groupBy("user_id").agg(F.sum("credit").cast("long").alias("credit"), F.count_if(F.col("credit") > 0).alias("raises"))


def last_wins_counter(spark, sf_dir):
    return counting.last_wins(events(spark, sf_dir), USER, F.col("event_id"), ["v", "k", "event_type"])


def first_wins_uuid(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "k", "user_id", "v")
    return counting.first_wins(e.withColumn("uuid", F.concat_ws("-", "user_id", "k")), "uuid", F.col("event_id")).select("uuid", "event_id", "v")


def session_id_ffill(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("sid", F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")))
    filled = counting.forward_fill(e, USER, ["event_id"], "sid", F.concat(F.lit("file-"), "user_id"))
    return filled.groupBy("user_id", "sid").agg(F.count(F.lit(1)).alias("events"), F.sum("v").cast("long").alias("v"))


def whole_log_scan(spark, sf_dir):
    """All events as one log: the last purchase before each signup, and the log's running total and maximum there."""
    e = scans.even_segments(events(spark, sf_dir).select("event_id", "event_type", "v").withColumn("log", F.lit("log")), "event_id")
    taken = {"bought": ("last", F.when(F.col("event_type") == "purchase", F.col("event_id"))), "total": ("sum", F.col("v")), "most": ("max", F.col("v"))}
    return scans.prefix_scan(e, ["log"], ["segment"], ["event_id"], taken).where("event_type = 'signup'").select("event_id", "bought", "total", "most")


def as_of_click(spark, sf_dir):
    """Each purchase with the user's last click at or before it, and the last one of all users in the half hour before it."""
    e = events(spark, sf_dir).withColumn("us", A.micros("ts")).select("event_id", "user_id", "event_type", "us", "v")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("us").alias("clicked"), F.col("event_id").alias("click_id"))
    own = joins.as_of(e.where("event_type = 'purchase'"), clicks, ["user_id"], "us", "clicked", ["click_id"], tie="click_id")
    any_ = clicks.select(F.col("clicked").alias("any_clicked"), F.col("click_id").alias("any_id"))
    both = joins.as_of(own, any_, [], "us", "any_clicked", ["any_id"], tie="any_id", strictly=True, within=30 * 60_000_000)
    return both.select("event_id", "user_id", "v", "clicked", "click_id", "any_clicked", "any_id")


def overlapping_sessions(spark, sf_dir):
    """With how many other users' sessions of the same k each session overlaps; a session ends an hour after its last event."""
    s = A.gap_sessions(events(spark, sf_dir).withColumn("kind", F.col("user_id") % 5), ["kind", "user_id"], "ts", 60)
    s = s.select("kind", "user_id", "start_micros", (F.col("end_micros") + 3_600_000_000).alias("end_micros"))
    return joins.overlap_counts(s, ["kind"], "user_id", "start_micros", "end_micros", 600_000_000).select("user_id", "start_micros", "others", "last_start")


def subset_split(spark, sf_dir):
    fresh, cached = counting.subset_split(F.col("v"), F.col("k") * 100)
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(fresh).cast("long").alias("fresh"), F.sum(cached).cast("long").alias("cached"))


def _ledger(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("cli"), F.col("user_id").alias("session_id"), F.concat(F.lit("v"), F.col("k") % 7).alias("version"), F.col("event_id").alias("pos"), F.col("v").alias("total"), "k")


def ledger_lifetime(spark, sf_dir):
    return ledger.lifetime(_ledger(spark, sf_dir), ["total", "k"])


def ledger_by_cli(spark, sf_dir):
    return ledger.lifetime(_ledger(spark, sf_dir), ["total"]).groupBy("cli").agg(F.count(F.lit(1)).alias("sessions"), F.sum("total").cast("long").alias("total"))


def ledger_compare(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    return ledger.compare(rows, rows.where("total > 20000"))


def ledger_append_plan(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    half = F.col("k") < 50
    return ledger.append_plan(rows.where(half), rows.where(~half)).select("cli", "session_id", "version", "pos", "total")


def tool_mix_top8(spark, sf_dir):
    return profile.top_k(events(spark, sf_dir), "k", 8)


def dominant_tool_by_user(spark, sf_dir):
    return profile.dominant(events(spark, sf_dir), USER, "event_type")


def busiest_day(spark, sf_dir):
    return profile.busiest_day(events(spark, sf_dir), USER, F.to_date("ts"), F.col("v")).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "value")


def _sessions(spark, sf_dir):
    """Sessions that close after an hour's gap."""
    s = A.gap_sessions(events(spark, sf_dir), USER, "ts", 60)
    return s.withColumns({"sid": F.concat_ws("-", "user_id", "start_micros"), "elapsed": F.col("end_micros") - F.col("start_micros")})


def session_records(spark, sf_dir):
    return profile.records(_sessions(spark, sf_dir), USER, ["elapsed", "events"], "start_micros", "sid")


def median_session(spark, sf_dir):
    return profile.median_of(_sessions(spark, sf_dir), USER, "elapsed")


def first_last_seen(spark, sf_dir):
    return profile.first_last_seen(events(spark, sf_dir), "event_type", A.micros("ts"))


def tool_relationship(spark, sf_dir):
    """Weeks stand for months: the table spans one month."""
    week = F.date_format(F.date_sub(F.to_date("ts"), F.weekday("ts")), "yyyy-MM-dd")
    return profile.tool_relationship(events(spark, sf_dir), USER, week, "event_type")


def _measured(spark, sf_dir):
    e = events(spark, sf_dir)
    inputs = e.groupBy("user_id").agg(
        (F.sum("v") / 1e5).alias("tokens_m"),
        F.count_distinct("k").cast("double").alias("projects"),
        F.count_distinct("event_type").cast("double").alias("langs"),
        F.count(F.lit(1)).cast("double").alias("tool_calls"),
        F.count_distinct(F.to_date("ts")).cast("double").alias("active_days"),
    )
    night = A.night_minutes(e, USER, "ts").groupBy("user_id").agg((F.sum("night_minutes") / 60).alias("night_hours"))
    runs = A.islands(e, USER, F.to_date("ts")).groupBy("user_id").agg(F.max("days").cast("double").alias("streak"))
    return scoring.long_form(inputs.join(night, "user_id", "left").join(runs, "user_id", "left"), USER)


def _levels(spark, sf_dir):
    return scoring.levels(_measured(spark, sf_dir), USER)


def levels_by_user(spark, sf_dir):
    return _levels(spark, sf_dir)


def levels_explain(spark, sf_dir):
    return scoring.explain(_measured(spark, sf_dir), USER).select("user_id", "axis", "input", "measured", F.floor(F.col("worth") * 100 + 0.5).cast("long").alias("worth"))


def rating_tier(spark, sf_dir):
    return scoring.ratings(_levels(spark, sf_dir), USER)


def archetype_pair(spark, sf_dir):
    return scoring.archetypes(_levels(spark, sf_dir), USER)


def month_vs_lifetime(spark, sf_dir):
    """The last ten days' tool calls and days against the whole table's."""
    e = today(events(spark, sf_dir))

    def of(rows):
        return scoring.levels(scoring.long_form(rows.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("tool_calls"), F.count_distinct(F.to_date("ts")).cast("double").alias("active_days")), USER), USER)

    return scoring.against(of(e.where(F.datediff("today", F.to_date("ts")) < 10)), of(e), USER)


QUERIES = {f.__name__: f for f in (user_profile, active_time_by_user, active_minutes_thr15, active_minutes_tight, streak_longest, streak_current_grace, streak_current_strict, hour_histogram, weekend_ratio_bp, night_minutes_by_month, active_days_by_user, calendar_strip, gap_sessions, concurrency_peak, concurrency_weighted, usage_max_dedup_total, usage_running_credit, last_wins_counter, first_wins_uuid, session_id_ffill, whole_log_scan, as_of_click, overlapping_sessions, subset_split, ledger_lifetime, ledger_by_cli, ledger_compare, ledger_append_plan, tool_mix_top8, dominant_tool_by_user, busiest_day, session_records, median_session, first_last_seen, tool_relationship, levels_by_user, levels_explain, rating_tier, archetype_pair, month_vs_lifetime)}

_E = "e AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us, CAST(ts AS DATE) AS d FROM events)"
_MIN = """m AS (SELECT DISTINCT user_id, us // 60000000 AS mi FROM e),
g AS (SELECT user_id, mi - lag(mi) OVER (PARTITION BY user_id ORDER BY mi) AS gap FROM m),
active AS (SELECT user_id, CAST(CASE WHEN count(*) = 1 THEN 1 ELSE coalesce(sum(least(gap, 15)) FILTER (WHERE gap IS NOT NULL), 0) END AS BIGINT) AS active_minutes FROM g GROUP BY user_id)"""
_SPAN = "spans AS (SELECT user_id, min(us) AS first_micros, max(us) AS last_micros, count(*) AS events, count(DISTINCT us // 60000000) AS minutes, count(DISTINCT d) AS days FROM e GROUP BY user_id)"


def _streak_sql(where: str = "") -> str:
    return f"""t AS (SELECT max(d) AS today FROM e {where}),
dd AS (SELECT DISTINCT user_id, d FROM e {where}),
n AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS run FROM dd),
i AS (SELECT user_id, min(d) AS a, max(d) AS b, count(*) AS days FROM n GROUP BY user_id, run),
s AS (SELECT user_id, max(days) AS longest, CASE WHEN max(today) - max(b) <= 1 THEN max_by(days, b) ELSE 0 END AS current_grace,
  CAST(coalesce(max(CASE WHEN b >= today THEN today - a + 1 END), 0) AS BIGINT) AS current_strict FROM i, t GROUP BY user_id)"""


def _thr(minutes: int) -> str:
    return f"WITH {_E}, g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e) SELECT user_id, CAST(sum(CASE WHEN gap > 0 AND gap <= {minutes * 60000000} THEN gap ELSE 0 END) AS BIGINT) AS active_micros FROM g GROUP BY user_id"


_SWEEP = f"""WITH {_E},
iv AS (SELECT strftime(d, '%Y-%m-%d') AS day, user_id, min(us) AS st, max(us) AS en FROM e GROUP BY ALL),
pt AS (SELECT day, st AS t, 1 AS dl FROM iv UNION ALL SELECT day, greatest(en, st + 60000000), -1 FROM iv),
lv AS (SELECT day, sum(dl) OVER (PARTITION BY day ORDER BY t, dl DESC ROWS UNBOUNDED PRECEDING) AS level, lead(t) OVER (PARTITION BY day ORDER BY t, dl DESC) - t AS held FROM pt),
r AS (SELECT day, CAST(max(level) AS BIGINT) AS peak, CAST(coalesce(sum(held) FILTER (WHERE level >= 1), 0) AS BIGINT) AS covered,
  CAST(coalesce(sum(held) FILTER (WHERE level >= 2), 0) AS BIGINT) AS multi, CAST(coalesce(sum(level * held), 0) AS BIGINT) AS integral FROM lv GROUP BY day)"""
_LEDGER = f"{_E}, l AS (SELECT event_type AS cli, user_id AS session_id, 'v' || CAST(k % 7 AS VARCHAR) AS version, event_id AS pos, v AS total, k FROM e)"
_LIFE = f"""{_LEDGER}, nv AS (SELECT version, max(pos) AS rk FROM l GROUP BY version),
j AS (SELECT l.*, rk, max(rk) OVER (PARTITION BY cli, session_id) AS best FROM l JOIN nv USING (version)),
life AS (SELECT cli, session_id, max(total) AS total, max(k) AS k FROM j WHERE rk = best GROUP BY cli, session_id)"""


def _gap_sql(minutes: int) -> str:
    gap = minutes * 60000000
    return f"""{_E}, q AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < {gap} THEN 0 ELSE 1 END AS new FROM e),
w AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nth FROM q),
gs AS (SELECT user_id, min(us) AS start_micros, max(us) AS end_micros, count(*) AS events FROM w GROUP BY user_id, nth),
ss AS (SELECT *, user_id || '-' || start_micros AS sid, end_micros - start_micros AS elapsed FROM gs)"""


_SPEC = ", ".join(f"({a}, '{n}', '{i}', {m}e0, {w}e0)" for a, n, i, m, w in scoring.AXES)
_INPUTS = f"""{_E}, b AS (SELECT user_id, sum(v) / 1e5 AS tokens_m, count(DISTINCT k)::DOUBLE AS projects, count(DISTINCT event_type)::DOUBLE AS langs, count(*)::DOUBLE AS tool_calls, count(DISTINCT d)::DOUBLE AS active_days FROM e GROUP BY user_id),
nm AS (SELECT user_id, count(DISTINCT us // 60000000) / 60.0 AS night_hours FROM e WHERE hour(ts) < 6 GROUP BY user_id),
{_streak_sql()},
w AS (SELECT b.*, night_hours, longest::DOUBLE AS streak FROM b LEFT JOIN nm USING (user_id) LEFT JOIN s USING (user_id)),
x AS (SELECT user_id, unnest(['tokens_m','projects','langs','tool_calls','night_hours','streak','active_days']) AS input, unnest([tokens_m, projects, langs, tool_calls, night_hours, streak, active_days]) AS value FROM w)"""
_TERMS = f"""spec(axis, name, input, mid, weight) AS (VALUES {_SPEC}),
term AS (SELECT u.user_id, axis, name, spec.input, x.value, coalesce(5 * ln(1 + greatest(x.value, 0)) / ln(1 + mid * 10) * weight, 0) AS worth
  FROM (SELECT DISTINCT user_id FROM x) u CROSS JOIN spec LEFT JOIN (SELECT * FROM x WHERE value IS NOT NULL) x ON x.user_id = u.user_id AND x.input = spec.input),
lev AS (SELECT user_id, axis, name, CAST(floor(least(7, greatest(0, sum(worth))) * 1000 + 0.5) AS BIGINT) AS level FROM term GROUP BY user_id, axis, name)"""
_LEV = f"WITH {_INPUTS}, {_TERMS}"
_PAIRS = ", ".join(f"({a}, {b}, '{n}')" for (a, b), n in scoring.PAIRS.items())


def _short_levels(alias: str, where: str) -> str:
    return f"""{alias}x AS (SELECT user_id, unnest(['tool_calls', 'active_days']) AS input, unnest([count(*)::DOUBLE, count(DISTINCT d)::DOUBLE]) AS value FROM e, t {where} GROUP BY user_id),
{alias} AS (SELECT user_id, axis, name, CAST(floor(least(7, greatest(0, sum(worth))) * 1000 + 0.5) AS BIGINT) AS level FROM (
  SELECT u.user_id, axis, name, coalesce(5 * ln(1 + greatest(y.value, 0)) / ln(1 + mid * 10) * weight, 0) AS worth FROM (SELECT DISTINCT user_id FROM {alias}x) u CROSS JOIN spec LEFT JOIN {alias}x y ON y.user_id = u.user_id AND y.input = spec.input) GROUP BY user_id, axis, name)"""


_REL = f"""WITH {_E}, wk AS (SELECT user_id, strftime(date_trunc('week', d), '%Y-%m-%d') AS month, event_type, count(*) AS n FROM e GROUP BY ALL),
bt AS (SELECT user_id, month, event_type AS dom FROM wk QUALIFY row_number() OVER (PARTITION BY user_id, month ORDER BY n DESC, event_type) = 1),
r AS (SELECT user_id, month, dom, first_value(dom) OVER (PARTITION BY user_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
  last_value(dom) OVER (PARTITION BY user_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, lag(dom) OVER (PARTITION BY user_id ORDER BY month) AS before FROM bt),
k AS (SELECT user_id, f, l, count(*) AS months, count(DISTINCT dom) AS tools, max(CASE WHEN dom = l AND before <> l THEN month END) AS taken FROM r GROUP BY user_id, f, l),
z AS (SELECT *, CASE WHEN f <> l THEN 'switch' WHEN tools = 1 THEN 'loyalist' ELSE 'polyglot' END AS kind FROM k)
SELECT user_id, kind, months, CASE WHEN kind <> 'polyglot' THEN f END AS from_tool, CASE WHEN kind <> 'polyglot' THEN l END AS to_tool, CASE WHEN kind = 'switch' THEN taken END AS switch_month FROM z"""

ORACLES = {
    "user_profile": f"WITH {_E}, {_MIN}, {_SPAN}, {_streak_sql()} SELECT * FROM active JOIN s USING (user_id) JOIN spans USING (user_id)",
    "active_time_by_user": f"WITH {_E}, {_MIN} SELECT * FROM active",
    "active_minutes_thr15": _thr(15),
    "active_minutes_tight": _thr(1),
    **{f"streak_{c}": f"WITH {_E}, {_streak_sql(chr(32) + 'WHERE event_type = ' + chr(39) + 'purchase' + chr(39))} SELECT user_id, {c} FROM s" for c in ("longest", "current_grace", "current_strict")},
    "hour_histogram": "SELECT h.hour, count(e.ts) AS events FROM range(24) h(hour) LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY h.hour",
    "weekend_ratio_bp": "SELECT user_id, count(ts) AS events, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend_events, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) * 10000 // count(ts) AS weekend_bp FROM events GROUP BY user_id",
    "night_minutes_by_month": f"WITH {_E} SELECT user_id, strftime(ts, '%Y-%m') AS month, count(DISTINCT us // 60000000) AS night_minutes FROM e WHERE hour(ts) < 6 GROUP BY ALL",
    "active_days_by_user": f"WITH {_E}, {_SPAN} SELECT * FROM spans",
    "calendar_strip": f"WITH {_E}, l AS (SELECT max(d) AS last FROM e), s AS (SELECT unnest(range(90)) AS i), c AS (SELECT d, count(*) AS n FROM e GROUP BY d) SELECT strftime(last - CAST(i AS INT), '%Y-%m-%d') AS day, coalesce(n, 0) AS events FROM l CROSS JOIN s LEFT JOIN c ON c.d = last - CAST(i AS INT)",
    "gap_sessions": f"WITH {_gap_sql(15)} SELECT user_id, start_micros, end_micros, events FROM gs",
    "concurrency_peak": f"{_SWEEP} SELECT day, peak FROM r",
    "concurrency_weighted": f"{_SWEEP} SELECT day, covered, multi, integral FROM r",
    "usage_max_dedup_total": f"WITH {_E}, m AS (SELECT user_id, k, greatest(0, max(v)) AS v FROM e GROUP BY user_id, k) SELECT count(*) AS ids, CAST(sum(v) AS BIGINT) AS total FROM m",
    "usage_running_credit": f"WITH {_E}, c AS (SELECT user_id, greatest(v - coalesce(max(v) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS credit FROM e) SELECT user_id, CAST(sum(credit) AS BIGINT) AS credit, count(*) FILTER (WHERE credit > 0) AS raises FROM c GROUP BY user_id",
    "last_wins_counter": f"WITH {_E} SELECT user_id, max_by(v, event_id) AS v, max_by(k, event_id) AS k, max_by(event_type, event_id) AS event_type FROM e GROUP BY user_id",
    "whole_log_scan": f"WITH {_E}, w AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS bought, CAST(sum(v) OVER (ORDER BY event_id) AS BIGINT) AS total, max(v) OVER (ORDER BY event_id) AS most FROM e) SELECT event_id, bought, total, most FROM w WHERE event_type = 'signup'",
    "as_of_click": f"""WITH {_E}, p AS (SELECT event_id, user_id, v, us FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us AS clicked, max(event_id) AS click_id FROM e WHERE event_type = 'click' GROUP BY ALL),
g AS (SELECT clicked AS any_clicked, max(click_id) AS any_id FROM c GROUP BY 1),
o AS (SELECT p.*, clicked, click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.clicked),
b AS (SELECT o.*, any_clicked, any_id, any_clicked IS NOT NULL AND us - any_clicked <= 1800000000 AS near FROM o ASOF LEFT JOIN g ON o.us > g.any_clicked)
SELECT event_id, user_id, v, clicked, click_id, CASE WHEN near THEN any_clicked END AS any_clicked, CASE WHEN near THEN any_id END AS any_id FROM b""",
    "overlapping_sessions": f"""WITH {_E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM g),
s AS (SELECT user_id, user_id % 5 AS kind, min(us) AS a, max(us) + 3600000000 AS z FROM n GROUP BY user_id, nth)
SELECT x.user_id, x.a AS start_micros, count(*) AS others, max(y.a) AS last_start FROM s x JOIN s y ON x.kind = y.kind AND x.user_id <> y.user_id AND x.a <= y.z AND y.a <= x.z GROUP BY 1, 2""",
    "first_wins_uuid": f"WITH {_E} SELECT user_id || '-' || k AS uuid, event_id, v FROM e QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1",
    "session_id_ffill": f"WITH {_E}, f AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'file-' || user_id) AS sid FROM e) SELECT user_id, sid, count(*) AS events, CAST(sum(v) AS BIGINT) AS v FROM f GROUP BY ALL",
    "subset_split": f"WITH {_E} SELECT event_type, CAST(sum(greatest(0, v - k * 100)) AS BIGINT) AS fresh, CAST(sum(least(k * 100, v)) AS BIGINT) AS cached FROM e GROUP BY event_type",
    "ledger_lifetime": f"WITH {_LIFE} SELECT * FROM life",
    "ledger_by_cli": f"WITH {_LIFE} SELECT cli, count(*) AS sessions, CAST(sum(total) AS BIGINT) AS total FROM life GROUP BY cli",
    "ledger_compare": f"WITH {_LEDGER}, a AS (SELECT DISTINCT cli, session_id FROM l), b AS (SELECT DISTINCT cli, session_id, 1 AS there FROM l WHERE total > 20000) SELECT CASE WHEN there = 1 THEN 'both' ELSE 'ledger_only' END AS place, cli, count(*) AS sessions FROM a LEFT JOIN b USING (cli, session_id) GROUP BY ALL",
    "ledger_append_plan": f"WITH {_LEDGER}, had AS (SELECT cli, session_id, version, max(total) AS had FROM l WHERE k < 50 GROUP BY ALL), b AS (SELECT *, max(total) OVER (PARTITION BY cli, session_id, version ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM l WHERE k >= 50) SELECT cli, session_id, version, pos, total FROM b LEFT JOIN had USING (cli, session_id, version) WHERE total > 0 AND total > coalesce(bef, 0) AND total > coalesce(had, 0)",
    "tool_mix_top8": f"WITH {_E} SELECT k, count(*) AS n FROM e WHERE k IS NOT NULL GROUP BY k ORDER BY n DESC, k LIMIT 8",
    "dominant_tool_by_user": f"WITH {_E}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, event_type AS dominant, n, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "busiest_day": f"WITH {_E}, c AS (SELECT user_id, d, CAST(sum(v) AS BIGINT) AS value FROM e GROUP BY ALL) SELECT user_id, strftime(d, '%Y-%m-%d') AS day, value FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, d) = 1",
    "session_records": f"WITH {_gap_sql(60)}, x AS (SELECT user_id, sid, start_micros, 'elapsed' AS record, elapsed AS value FROM ss UNION ALL SELECT user_id, sid, start_micros, 'events', events FROM ss) SELECT user_id, record, sid, value FROM x QUALIFY row_number() OVER (PARTITION BY user_id, record ORDER BY value DESC, start_micros, sid) = 1",
    "median_session": f"WITH {_gap_sql(60)} SELECT user_id, median(elapsed) AS median, count(elapsed) AS n FROM ss GROUP BY user_id",
    "first_last_seen": f"WITH {_E} SELECT event_type, min(us) AS first_seen, max(us) AS last_seen, count(*) AS n FROM e GROUP BY event_type",
    "tool_relationship": _REL,
    "levels_by_user": f"{_LEV} SELECT * FROM lev",
    "levels_explain": f"{_LEV} SELECT user_id, axis, input, value IS NOT NULL AS measured, CAST(floor(worth * 100 + 0.5) AS BIGINT) AS worth FROM term",
    "rating_tier": f"{_LEV} SELECT user_id, CAST(sum(level) AS BIGINT) AS total, CASE WHEN sum(level) >= 30000 THEN 'MASTERWORK' WHEN sum(level) >= 25000 THEN 'TEMPERED' WHEN sum(level) >= 20000 THEN 'FORGED' WHEN sum(level) >= 12500 THEN 'CAST' ELSE 'RAW' END AS tier FROM lev GROUP BY user_id",
    "archetype_pair": f"{_LEV}, pairs(lo, hi, nm) AS (VALUES {_PAIRS}), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level DESC, axis) AS nth FROM lev), tp AS (SELECT user_id, sum(level) AS total, max(level) - min(level) AS spread, min(axis) FILTER (WHERE nth <= 2) AS lo, max(axis) FILTER (WHERE nth <= 2) AS hi FROM rk GROUP BY user_id) SELECT user_id, CASE WHEN total <= 0 THEN 'Unforged' WHEN spread < 1500 THEN 'The Generalist' ELSE nm END AS archetype FROM tp LEFT JOIN pairs USING (lo, hi)",
    "month_vs_lifetime": f"WITH {_E}, t AS (SELECT max(d) AS today FROM e), spec(axis, name, input, mid, weight) AS (VALUES {_SPEC}), {_short_levels('mo', 'WHERE today - d < 10')}, {_short_levels('li', '')}, j AS (SELECT coalesce(mo.user_id, li.user_id) AS user_id, coalesce(mo.axis, li.axis) AS axis, coalesce(mo.level, 0) AS level, coalesce(li.level, 0) AS base FROM mo FULL JOIN li ON mo.user_id = li.user_id AND mo.axis = li.axis) SELECT user_id, axis, level, base, level - base AS delta, CASE WHEN level - base >= 50 THEN 1 WHEN level - base <= -50 THEN -1 ELSE 0 END AS sign FROM j",
}
