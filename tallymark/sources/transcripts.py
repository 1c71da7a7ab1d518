"""Session transcripts: message logs with streamed usage, and rollouts with cumulative counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import activity, counting, scans
from tallymark.session import kept
from tallymark.sources.lines import get, instant, log_lines, objects, string

#: Usage fields of a message, by the name of the counter.
USAGE = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
TOKENS = list(USAGE)
SENTINEL = "[excluded]"


#: What is taken of a message's line: all of it in one step, for a path of its own that is absent costs Spark an exception.
LINE = "struct<timestamp: variant, sessionId: variant, type: variant, cwd: variant, uuid: variant, message: struct<id: variant, model: variant, content: variant, usage: variant>>"
BLOCKS = "array<struct<type: string, name: string, input: struct<file_path: string, path: string, notebook_path: string>>>"


def _timed(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    rows = objects(log_lines(spark, roots, glob))
    return rows.withColumn("ts", instant(string("j", "$.timestamp"))).where("ts is not null")


def message_events(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, home: str | None = None, user: str | None = None, glob: str = "*.jsonl", lines: DataFrame | None = None) -> DataFrame:
    """Rows of message logs, typed, or of ``lines`` read already: a row is kept if it is an object with a parsable timestamp string.

    A row without session id inherits the last one seen in its file, else the
    file's last two path segments. A folder that names nothing (one segment at
    most) leaves the label to the encoded project folder.

    Rows are parsed once and kept, so that ids are filled in by splits of files
    and a file of any size stays many tasks. Only files with a row that lacks an
    id are scanned for it.
    """
    read = objects(log_lines(spark, roots, glob) if lines is None else lines, LINE)
    # Of a generator, as in ``objects``: the filter is not pushed below it, and the stamp is read once.
    timed = read.withColumn("ts", F.explode(F.array(instant(string("j.timestamp", "$"))))).where("ts is not null")
    message = F.col("j.message")
    typed = timed.select("path", "split", "line_no", "ts", string("j.sessionId", "$").alias("session_id"), string("j.type", "$").alias("type"), string("j.cwd", "$").alias("cwd"), string("j.uuid", "$").alias("uuid"), message.alias("message"))
    said, assistant = F.col("type") == "user", F.col("type") == "assistant"
    rows = typed.select(
        "path",
        "split",
        "line_no",
        "ts",
        "session_id",
        "type",
        "cwd",
        "uuid",
        F.when(said, string("message.content", "$")).alias("prompt"),
        F.when(assistant, string("message.id", "$")).alias("msg_id"),
        F.when(assistant, string("message.model", "$")).alias("model_raw"),
        F.when(assistant, get("message.content", "$", BLOCKS)).alias("content"),
        F.when(assistant, get("message.usage", "$", f"struct<{', '.join(f'{f}: string' for f in USAGE.values())}>")).alias("usage"),
        F.col("message.usage").isNotNull().alias("has_usage"),
    )
    parts = F.split("path", "/")
    fallback = F.regexp_replace(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)), r"\.jsonl$", "")
    dir_key = T.project_dir(F.col("path"))
    dir_label = T.decoded_dir(dir_key)
    excluded = exclude or []
    label = F.when(T.excluded(F.col("cwd"), excluded) | T.excluded(dir_key, excluded), SENTINEL).otherwise(F.coalesce(F.when(~T.uninformative(F.col("cwd")), T.project_label(F.col("cwd"), home, user)), dir_label))
    tool = lambda c: F.transform(F.filter(c, lambda x: x["type"] == "tool_use"), lambda x: F.struct(x["name"].alias("name"), F.array_compact(F.array(*(x["input"][p] for p in ("file_path", "path", "notebook_path")))).alias("paths")))
    typed = rows.select(
        "path",
        "split",
        "line_no",
        "ts",
        "session_id",
        "uuid",
        dir_key.alias("dir_key"),
        label.alias("project"),
        (said & F.col("prompt").isNotNull()).alias("user_turn"),
        "prompt",
        "msg_id",
        F.when(assistant & T.real_model(F.col("model_raw")), T.model_name(F.col("model_raw"))).alias("model"),
        *(F.when(assistant & F.col("has_usage"), counting.finite(F.col("usage")[f]).cast("long")).alias(c) for c, f in USAGE.items()),
        F.coalesce(F.when(assistant, tool(F.col("content"))), F.array().cast("array<struct<name:string,paths:array<string>>>")).alias("tools"),
    )
    columns = typed.columns
    return counting.forward_fill(kept(typed, "events"), ["path"], ["line_no"], "session_id", fallback, ["split"]).select(*columns)


def usage_by_session(events: DataFrame) -> DataFrame:
    """Tokens of each session: a message counts its maximum, each raise to the session that brought it."""
    used = events.where(" or ".join(f"{c} is not null" for c in TOKENS))
    return counting.credits_by(used, "msg_id", "session_id", ["path", "line_no"], TOKENS, ["path", "split"])


def sessions(events: DataFrame) -> DataFrame:
    """A row per session: span, active minutes, turns, tools, project and tokens.

    Rows are summed up by minute, and by file, project and model, where they are
    read; what is ordered after that are minutes and names, not rows.
    """
    minutes = events.groupBy("session_id", activity.minute("ts").alias("m")).agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("events"),
        F.count_if("user_turn").alias("turns"),
        F.sum(F.size("tools")).alias("tool_calls"),
    )
    in_order = Window.partitionBy("session_id").orderBy("m")
    day = F.to_date("start")
    # Days rise with minutes: a day is new where it is not the one of the minute before.
    minutes = minutes.select("*", (F.col("m") - F.lag("m").over(in_order)).alias("gap"), F.lag(day).over(in_order).eqNullSafe(day).alias("same_day"))
    base = minutes.groupBy("session_id").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("events").alias("events"),
        F.sum("turns").alias("turns"),
        F.sum("tool_calls").cast("long").alias("tool_calls"),
        F.count_if(~F.col("same_day")).alias("days"),
        activity.capped(F.col("gap")).alias("active_minutes"),
    )
    at = F.struct("path", "line_no")
    named = F.when(F.col("project").isNotNull(), at)
    seen = events.groupBy("session_id", "path", "project", "model").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    votes = seen.groupBy("session_id", "model").agg(F.sum("n").alias("n"), F.min(at).alias("first"), F.min_by("project", named).alias("project"), F.min(named).alias("named"))
    names = votes.groupBy("session_id").agg(F.min_by("project", "named").alias("project"), F.min_by("model", F.when(F.col("model").isNotNull(), F.struct(-F.col("n"), "first"))).alias("model"))
    out = base.join(names, "session_id", "left").join(usage_by_session(events), "session_id", "left")
    return out.select("session_id", "start", "end", "events", "turns", "tool_calls", "project", "days", "active_minutes", "model", *(F.coalesce(c, F.lit(0)).alias(c) for c in TOKENS))


def distinct_projects(events: DataFrame) -> DataFrame:
    """Projects of sessions and of folders (a folder's label is its last informative one), without excluded ones."""
    at = F.struct("path", "line_no")
    of_dirs = events.where("dir_key is not null").groupBy("dir_key").agg(F.max_by("project", F.when(F.col("project").isNotNull(), at)).alias("project")).select("project")
    of_sessions = events.groupBy("session_id").agg(F.min_by("project", F.when(F.col("project").isNotNull(), at)).alias("project")).select("project")
    return of_sessions.union(of_dirs).where((F.col("project") != SENTINEL) & F.col("project").isNotNull()).distinct()


def first_sights(events: DataFrame) -> DataFrame:
    """Usage rows with copies dropped: of equal uuids, over all profiles, the first counts; without uuid every row."""
    return counting.first_wins(events.where(F.col("input").isNotNull()), "uuid", F.struct("path", "line_no"))


def rollout_events(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Rows of rollouts: id and model stay as the last session_meta said; counters are cumulative."""
    j = _timed(spark, roots, glob)
    meta = string("j", "$.type") == "session_meta"
    rows = j.select(
        "path",
        "split",
        "line_no",
        "ts",
        F.when(meta, string("j", "$.payload.id")).alias("session_id"),
        F.when(meta, F.struct(T.model_name(string("j", "$.payload.model")).alias("m"))).alias("model"),
        F.when(meta, string("j", "$.payload.cwd")).alias("cwd"),
        string("j", "$.type").alias("type"),
        string("j", "$.payload.type").alias("kind"),
        string("j", "$.payload.role").alias("role"),
        string("j", "$.payload.name").alias("name"),
        *(counting.finite(get("j", f"$.payload.info.total_token_usage.{f}", "string")).cast("long").alias(c) for c, f in (("total_in", "input_tokens"), ("cached", "cached_input_tokens"))),
        counting.finite(get("j", "$.payload.info.total_token_usage.output_tokens", "string")).cast("long").alias("total_out"),
        get("j", "$.payload.info.total_token_usage.output_tokens", "variant").isNotNull().alias("has_out"),
        get("j", "$.payload.info.total_token_usage", "variant").isNotNull().alias("has_usage"),
    )
    # A session_meta without a usable model puts it back to none: the struct is there, the name is null.
    seen = {"seen_id": ("last", F.col("session_id")), "seen_model": ("last", F.col("model"))}
    rows = scans.prefix_scan(kept(rows, "rollouts"), ["path"], ["split"], ["line_no"], seen)
    rows = rows.withColumns({"session_id": F.coalesce("seen_id", F.element_at(F.split("path", "/"), -1)), "model": F.col("seen_model.m")})
    item = F.col("type") == "response_item"
    call = item & F.col("kind").isin("function_call", "local_shell_call")
    return rows.select("path", "line_no", "ts", "session_id", "model", "cwd", F.when(F.col("type") == "event_msg", F.col("has_usage")).otherwise(F.lit(False)).alias("has_usage"), "total_in", "cached", F.when(F.col("has_out"), F.col("total_out")).alias("total_out"), F.when(call, F.coalesce("name", F.lit("shell"))).alias("tool"), (item & ~call & (F.col("role") == "user")).alias("user_turn"))


def rollout_sessions(events: DataFrame) -> DataFrame:
    """A row per rollout session; the last counters count."""
    at = F.struct("path", "line_no")
    used = F.when(F.col("has_usage"), at)
    fresh, cached = counting.subset_split(F.col("total_in"), F.col("cached"))
    return events.groupBy("session_id").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count_if("user_turn").alias("turns"),
        F.count("tool").alias("tool_calls"),
        F.coalesce(F.max_by(fresh, used), F.lit(0)).alias("input"),
        F.coalesce(F.max_by("total_out", F.when(F.col("has_usage") & F.col("total_out").isNotNull(), at)), F.lit(0)).alias("output"),
        F.coalesce(F.max_by(cached, used), F.lit(0)).alias("cache_read"),
        F.lit(0).cast("long").alias("cache_write"),
        F.max_by("model", used).alias("model"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("cwd"),
    )
