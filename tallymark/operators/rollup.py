"""A whole corpus in one row: the roll-up of a scan, and the profile of a person.

``events`` and ``sessions`` are those of message logs. Parts are aggregations of
their own, one row each, put side by side; lists are as long as stated.
Shares are in basis points, rounded down, and null where there is nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import activity, profile, scoring
from tallymark.session import kept

TOKENS = ["input", "output", "cache_read", "cache_write"]
# Sources of code work, tools of hands-on work, of operating and of orchestration.
CODE_SOURCES = ["claude_code", "codex"]
HANDS_ON = ["Edit", "Write", "NotebookEdit"]
OPERATOR = ["Bash", "shell", "local_shell_call", "exec_command"]
ORCHESTRATION = ["Task"]
#: Hours of the night for a profile, and the share of them that makes an owl.
NIGHT, OWL_BP = [22, 23, 0, 1, 2, 3, 4], 3500
#: Fixed value: minutes before this hour are of the night for a scan.
EARLY = 6
#: Projects, tools and models listed.
TOP_PROJECTS, TOP_TOOLS = 20, 8


def code_source(source: Column) -> Column:
    """Whether a source's sessions are code work, and not other knowledge work."""
    return source.isin(CODE_SOURCES)


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row tables as one row."""
    return reduce(lambda a, b: a.crossJoin(b), parts)


def share(part: Column, whole: Column) -> Column:
    """Basis points, rounded down; null of nothing."""
    return F.floor(F.try_divide(part * 10000, whole)).cast("long")


def ranked(df: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """One row: the k most frequent values with their counts as an array, most first, then by value."""
    top = profile.top_k(df, value, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col(value).alias("name")))).alias("top"))
    return top.select(F.transform("top", lambda x: F.struct(x["name"].alias("name"), (-x["order"]).alias("n"))).alias(name))


def touched(events: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Every path that a tool's input names, excluded ones left out: session_id, ts, path. All count, however many."""
    paths = events.select("session_id", "ts", F.explode("tools").alias("t")).select("session_id", "ts", F.explode("t.paths").alias("path"))
    return paths.where(~T.excluded(F.col("path"), excluded or []))


def by_minute(events: DataFrame) -> DataFrame:
    """Events and user turns of each minute that has any, kept: what days, hours, nights and streaks are read off, in one scan of the events."""
    return kept(events.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("events"), F.count_if("user_turn").alias("turns")), "minutes")


def tallied(events: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """How often each tool was called, and each language touched by a path, kept, in one scan of the events: kind, value, n."""
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    paths = F.filter("t.paths", lambda p: ~T.excluded(p, excluded or []))
    items = F.concat(F.array(item("tool", F.col("t.name"))), F.transform(paths, lambda p: item("language", T.counted_language(p))))
    seen = events.select(F.explode("tools").alias("t")).select(F.explode(items).alias("i"))
    return kept(seen.groupBy("i.kind", "i.value").agg(F.count(F.lit(1)).alias("n")), "tallies")


def listed(tallies: DataFrame, kind: str, name: str, k: int | None = None) -> DataFrame:
    """One row: the values of a kind with their counts as an array, most first, then by value."""
    rows = tallies.where((F.col("kind") == kind) & F.col("value").isNotNull())
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col("value").alias("name"))))
    top = F.slice(order, 1, k) if k else order
    return rows.agg(F.transform(top, lambda x: F.struct(x["name"].alias("name"), (-x["order"]).alias("n"))).alias(name))


def corpus(events: DataFrame, sessions: DataFrame, projects: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """The roll-up of a scan, one row.

    ``projects`` are the distinct projects of sessions and folders. The list of
    projects is cut for display; ``projects_count`` is not. Events are scanned
    twice, for their times and for their tools; everything else reads what these
    two left.
    """
    times, tallies = by_minute(events), tallied(events, excluded)
    at = F.col("minute")
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    runs = activity.islands(times.withColumn("k", F.lit(1)), ["k"], F.to_date(at))
    return side_by_side([
        sessions.agg(F.count(F.lit(1)).alias("total_sessions"), F.coalesce(F.sum("active_minutes"), F.lit(0)).alias("active_minutes"), *(number(c).alias(f"total_{c}") for c in TOKENS)),
        times.agg(
            number("turns").alias("user_turns"),
            F.count_distinct(F.to_date(at)).alias("active_days"),
            share(F.sum(F.when(F.dayofweek(at).isin(1, 7), F.col("events")).otherwise(F.lit(0))), F.sum("events")).alias("weekend_bp"),
            F.array(*(number(F.when(F.hour(at) == h, F.col("events"))) for h in range(24))).alias("hour_buckets"),
            F.count_if(F.hour(at) < EARLY).alias("night_minutes"),
        ),
        listed(tallies, "tool", "tool_calls"),
        ranked(sessions.select("project"), "project", TOP_PROJECTS, "projects"),
        projects.agg(F.count_distinct("project").alias("projects_count")),
        ranked(sessions.select("model"), "model", 1 << 30, "models"),
        tallies.where("kind = 'language'").agg(number("n").alias("file_paths_touched")),
        listed(tallies, "language", "languages"),
        runs.agg(F.coalesce(F.max("days"), F.lit(0)).alias("longest_streak_days")),
    ])


def months(events: DataFrame, sessions: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """A row per month: what sessions brought goes to the month they began in, days and nights to their own.

    So a month may have days and no session. Scores of a month need nothing of
    any other month.
    """
    begun = sessions.select("session_id", F.date_format("start", "yyyy-MM").alias("month"))
    volume = sessions.withColumn("month", F.date_format("start", "yyyy-MM")).groupBy("month").agg(F.count(F.lit(1)).alias("sessions"), F.sum("active_minutes").alias("active_minutes"), F.sum("tool_calls").cast("long").alias("tool_calls"), F.count_distinct(F.when(~F.col("project").startswith("["), F.col("project"))).alias("projects_count"), *(F.sum(c).cast("long").alias(c) for c in TOKENS))
    # A path is looked at once a session; what has days and hours is read off minutes.
    paths = touched(events, excluded).select("session_id", "path").distinct()
    spoken = paths.select("session_id", T.language(F.col("path")).alias("language")).where("language is not null").distinct()
    languages = spoken.join(begun, "session_id").groupBy("month").agg(F.count_distinct("language").alias("languages"))
    times = by_minute(events).withColumn("month", F.date_format("minute", "yyyy-MM"))
    day = F.to_date("minute")
    days = times.groupBy("month").agg(F.count_distinct(day).alias("active_days"))
    streak = activity.islands(times, ["month"], day).groupBy("month").agg(F.max("days").alias("longest_streak_days"))
    night = times.where(F.hour("minute") < EARLY).groupBy("month").agg(F.count(F.lit(1)).alias("night_minutes"))
    out = days
    for part in (volume, languages, streak, night):
        out = out.join(part, "month", "full")
    numbers = [c for c in out.columns if c != "month"]
    return out.select("month", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))


def person(events: DataFrame, sessions: DataFrame, today: Column) -> DataFrame:
    """The profile of a person, one row: conversation, delegation, models, cadence, rhythm, tokens, records, gauges.

    ``today`` is a date. A session counts on the day it begins. Of equals the
    first session, day or name counts.
    """
    total = sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))
    s = sessions.withColumns({"total": total, "day": F.to_date("start")})
    talk = profile.prompt_metrics(events.where("user_turn").withColumn("k", F.lit(1)), ["k"], "prompt").drop("k")
    empty = sessions.agg(F.lit(0).cast("long").alias("prompts_"))
    talk = empty.join(talk, F.lit(True), "left").select(F.coalesce("prompts", "prompts_").alias("prompts"), "question_bp", "correction_bp", "mean_chars", profile.prompt_style(F.col("chars") / F.when(F.col("prompts") > 0, F.col("prompts"))).alias("prompt_style"))
    times, tallies = by_minute(events), tallied(events)
    calls = tallies.where("kind = 'tool'")
    all_calls = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    of = lambda names: F.coalesce(F.sum(F.when(F.col("value").isin(names), F.col("n"))), F.lit(0))
    work = calls.agg(all_calls.alias("tool_calls"), share(of(HANDS_ON), all_calls).alias("hands_on_bp"), share(of(ORCHESTRATION), all_calls).alias("orchestration_bp"), share(of(OPERATOR), all_calls).alias("operator_bp"))
    vendors = s.where("model is not null").agg(*(F.count_if(T.vendor_class(F.col("model")) == v).alias(f"{v}_sessions") for v in ("anthropic", "openai", "other")))
    cadence = s.agg(F.count(F.lit(1)).alias("sessions"), F.median("active_minutes").alias("median_minutes"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(F.when((F.col("day") > F.date_sub(today, 30)) & (F.col("day") <= today), F.col("active_minutes"))), F.lit(0)).alias("minutes_30d"))
    at = F.col("minute")
    here = lambda c: F.coalesce(F.sum(F.when(c, F.col("events"))), F.lit(0)).cast("long")
    days = times.agg(F.count_distinct(F.to_date(at)).alias("active_days"), (F.datediff(F.max(F.to_date(at)), F.min(F.to_date(at))) + 1).alias("elapsed_days"), here(F.dayofweek(at).isin(1, 7)).alias("weekend_events"), here(F.hour(at).isin(NIGHT)).alias("night_events"), here(F.lit(True)).alias("events"))
    hours = times.groupBy(F.hour(at).cast("long").alias("hour")).agg(F.sum("events").alias("events")).agg(F.min_by("hour", F.struct(-F.col("events"), "hour")).alias("peak_hour"))
    streak = activity.streaks(times.withColumn("k", F.lit(1)), ["k"], F.to_date(at), today).agg(F.coalesce(F.max("longest"), F.lit(0)).alias("longest_streak"), F.coalesce(F.max("current_strict"), F.lit(0)).alias("current_streak"))
    of_day = s.groupBy("day").agg(F.sum("total").cast("long").alias("tokens"), F.sum("active_minutes").alias("minutes"))
    rhythm = of_day.agg(F.min_by(F.struct("day", "tokens"), F.struct(-F.col("tokens"), "day")).alias("busiest_day"), F.min_by(F.struct("day", "minutes"), F.struct(-F.col("minutes"), "day")).alias("longest_day"))
    record = lambda c: F.min_by(F.struct("session_id", F.col(c).cast("long").alias("value")), F.struct(-F.col(c), "start", "session_id"))
    records = s.agg(record("active_minutes").alias("longest_session"), record("total").alias("most_tokens_session"), record("turns").alias("most_turns_session"))
    craft = tallies.where("kind = 'language'").agg(F.count_distinct("value").alias("languages"))
    row = side_by_side([talk, work, listed(tallies, "tool", "tool_mix", TOP_TOOLS), vendors, cadence, days, hours, streak, rhythm, records, craft])
    row = row.withColumns({"weekend_bp": share(F.col("weekend_events"), F.col("events")), "night_bp": share(F.col("night_events"), F.col("events")), "delegation": F.try_divide(F.col("tool_calls"), F.col("prompts"))})
    row = row.withColumns({"night_owl": F.col("night_bp") >= OWL_BP, "peak_hour": F.when(F.col("events") > 0, F.col("peak_hour")), **{f"{c}_bp": share(F.col(c), F.col("total")) for c in TOKENS}, "new_content": F.col("input") + F.col("cache_write") + F.col("output")})
    row = row.withColumns({"hours_30d": F.col("minutes_30d") / 60, "total_m": F.col("total") / 1e6, "streak": F.col("longest_streak"), "langs": F.col("languages"), "hands_on_pct": F.col("hands_on_bp") / 100, "k": F.lit(1)})
    return row.join(scoring.gauges(row, ["k"]), "k").drop("k", "total_m", "streak", "langs", "hands_on_pct", "hours_30d", "weekend_events", "night_events", "delegation")


def concurrency_verdicts(person_row: DataFrame, peak: Column) -> DataFrame:
    """What a person's numbers say, in words of the reports: hours, hour of most events, sessions at once, streak."""
    return person_row.select(
        scoring.peak_verdict(F.col("peak_hour"), F.col("night_owl")).alias("peak"),
        scoring.fan_verdict(peak).alias("fan"),
        scoring.streak_verdict(F.col("current_streak"), F.col("longest_streak")).alias("streak"),
    )
