"""Other tools' stores, each to the same provider sessions.

Every reader gives root_seq, session_id, start, end, turns, input, output,
cache_read, cache_write, model; :func:`union` takes a session from the first
root that has it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators.counting import finite, strict_int
from tallymark.sources.lines import epoch, files, get, instant, lines, log_lines, objects, string, walked_lines

TOKENS = ["input", "output", "cache_read", "cache_write"]
COLUMNS = ["root_seq", "session_id", "start", "end", "turns", "input", "output", "cache_read", "cache_write", "model"]


def whole(j: Column, path: str) -> Column:
    """A whole JSON number, else 0."""
    return F.coalesce(strict_int(get(j, path, "variant")), F.lit(0))


def _base(path: str = "path") -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _sessions(rows: DataFrame, turns: Column | None = None) -> DataFrame:
    """Sum rows (root_seq, session_id, ts, model, tokens) to sessions; the model of most rows wins, of equals the first by name.

    ``turns`` is an aggregate that adds up over models.
    """
    keys = ["root_seq", "session_id"]
    tokens = ("input", "output", "cache_read", "cache_write")
    # One pass over the store, by model first: small files cost most in being opened.
    by_model = rows.groupBy(*keys, "model").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), (turns if turns is not None else F.count(F.lit(1))).alias("turns"), *(F.sum(c).cast("long").alias(c) for c in tokens))
    model = F.min_by("model", F.when(F.col("model").isNotNull(), F.struct(-F.col("n"), F.col("model"))))
    sums = by_model.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("turns").alias("turns"), *(F.sum(c).cast("long").alias(c) for c in tokens), model.alias("model"))
    return sums.select(*COLUMNS)


def gemini(spark: SparkSession, roots: list[str], glob: str = "*.jsonl", documents: str = "*.json") -> DataFrame:
    """One document a file, or lines of documents, or lines of messages; sessions go over files.

    ``cached`` is part of ``input``; thoughts are output, tool tokens input; only
    messages with tokens are turns.
    """
    read = files(spark, roots, documents)
    doc = F.try_parse_json("content")
    single = read.withColumn("j", doc).where("j is not null").select("root_seq", "path", "j")
    many = objects(lines(read.where(doc.isNull())).unionByName(log_lines(spark, roots, glob))).select("root_seq", "path", "j")
    docs = single.unionByName(many)
    sid = F.coalesce(string("j", "$.sessionId"), _base())
    listed = docs.select("root_seq", sid.alias("session_id"), F.explode(get("j", "$.messages", "array<variant>")).alias("m"))
    bare = docs.where(get("j", "$.messages", "variant").isNull() & get("j", "$.tokens", "variant").isNotNull()).select("root_seq", sid.alias("session_id"), F.col("j").alias("m"))
    m = listed.unionByName(bare).where(F.schema_of_variant(get("m", "$.tokens", "variant")).startswith("OBJECT"))
    n = {k: whole(F.col("m"), f"$.tokens.{k}") for k in ("input", "cached", "output", "thoughts", "tool")}
    rows = m.select("root_seq", "session_id", instant(string("m", "$.timestamp")).alias("ts"), string("m", "$.model").alias("model"), (F.greatest(F.lit(0), n["input"] - n["cached"]) + n["tool"]).alias("input"), (n["output"] + n["thoughts"]).alias("output"), F.least(n["cached"], n["input"]).alias("cache_read"), F.lit(0).cast("long").alias("cache_write"))
    return _sessions(rows)


def copilot(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Usage stands in ``session.shutdown`` by model and in compactions; sessions without either are absent.

    A log is a file, or a folder with ``events.jsonl``.
    """
    j = objects(log_lines(spark, roots, glob, many=True))
    parts = F.split("path", "/")
    sid = F.when(F.element_at(parts, -1) == "events.jsonl", F.element_at(parts, -2)).otherwise(_base())
    rows = j.select("root_seq", sid.alias("session_id"), instant(string("j", "$.timestamp")).alias("ts"), string("j", "$.type").alias("type"), "j")
    u = lambda v, k: whole(v, f"$.usage.{k}")
    c = lambda *names: sum((whole(F.col("j"), f"$.data.compactionTokensUsed.{n}") for n in names), F.lit(0))
    part = lambda shut, model, *n: F.struct(F.lit(shut).alias("shut"), model.cast("string").alias("model"), *(x.cast("long").alias(t) for x, t in zip(n, TOKENS, strict=True)))
    shut = F.transform(F.map_entries(get("j", "$.data.modelMetrics", "map<string,variant>")), lambda e: part(True, e["key"], u(e["value"], "inputTokens"), u(e["value"], "outputTokens") + u(e["value"], "reasoningTokens"), u(e["value"], "cacheReadTokens"), u(e["value"], "cacheWriteTokens")))
    compact = F.array(part(False, F.lit(None), c("input", "inputTokens"), c("output", "outputTokens"), c("cachedInput", "cacheReadTokens"), c("cacheWriteTokens")))
    parts_of = F.when(F.col("type") == "session.shutdown", shut).when(F.col("type") == "session.compaction_complete", compact)
    # One pass over the store, by model first: a row without usage is one of no model and of no part.
    flat = rows.select("root_seq", "session_id", "ts", "type", F.explode_outer(parts_of).alias("p")).select("root_seq", "session_id", "ts", "type", "p.*")
    keys = ["root_seq", "session_id"]
    asked = F.count_if(F.col("type") == "user.message")
    by_model = flat.groupBy(*keys, "shut", "model").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), asked.alias("turns"), *(F.sum(x).cast("long").alias(x) for x in TOKENS))
    total = sum((F.col(x) for x in TOKENS[1:]), F.col(TOKENS[0]))
    named = F.when(F.col("shut"), F.struct(-total, F.col("model")))
    sums = by_model.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("turns").alias("turns"), *(F.sum(x).cast("long").alias(x) for x in TOKENS), F.min_by("model", named).alias("model"), F.count("shut").alias("used"))
    return sums.where("used > 0").select(*COLUMNS)


def grok(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Only completed turns count; the breakdown by model wins over the top-level usage."""
    # The store is a folder a session: tasks list and read it, for Spark's reader takes milliseconds a file and the driver holds each.
    j = objects(walked_lines(spark, roots, glob)).where(get("j", "$.params.update.sessionUpdate", "string") == "turn_completed")
    stamp = get("j", "$.timestamp", "string")
    ts = F.coalesce(F.when(stamp.rlike(r"^[0-9.]+$"), epoch(stamp)), instant(stamp))
    usage = get("j", "$.params.update.usage", "variant")
    by_model = get("j", "$.params.update.usage.modelUsage", "map<string,variant>")
    entries = F.when(F.size(by_model) > 0, F.transform(F.map_entries(by_model), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))).otherwise(F.array(F.struct(F.coalesce(get("j", "$.params.update.model", "string"), F.lit("grok")).alias("key"), usage.alias("value"))))
    rows = j.where(usage.isNotNull()).select("root_seq", F.element_at(F.split("path", "/"), -2).alias("session_id"), ts.alias("ts"), F.posexplode(entries).alias("nth", "e"))
    n = {k: whole(F.col("e.value"), f"$.{k}") for k in ("inputTokens", "cachedReadTokens", "outputTokens")}
    out = rows.select("root_seq", "session_id", "ts", "nth", F.col("e.key").alias("model"), F.greatest(F.lit(0), n["inputTokens"] - n["cachedReadTokens"]).alias("input"), n["outputTokens"].alias("output"), F.least(n["cachedReadTokens"], n["inputTokens"]).alias("cache_read"), F.lit(0).cast("long").alias("cache_write"))
    return _sessions(out, F.count_if(F.col("nth") == 0))


def kilo(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Requests are JSON inside JSON; cache reads and writes are part of ``tokensIn``; placeholders of zero do not count.

    The model is the first that the sibling file of the task's folder names, wherever in it that stands.
    """
    read = files(spark, roots, "*.json")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    # One pass over the store: a task's folder has its requests' rows, or a row that names the model.
    message = F.filter(F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>"), lambda m: get(m, "$.say", "string") == "api_req_started")
    asked = F.transform(message, lambda m: F.struct(get(m, "$.ts", "string").alias("at"), F.try_parse_json(get(m, "$.text", "string")).alias("t"), F.lit(None).cast("string").alias("model")))
    named = F.element_at(F.split(F.regexp_extract("content", r"<model>([^<]+)</model>", 1), "/"), -1)
    sibling = F.array(F.struct(F.lit(None).cast("string").alias("at"), F.lit(None).cast("variant").alias("t"), named.alias("model")))
    found = F.when(name == "ui_messages.json", asked).when(name == "api_conversation_history.json", sibling)
    rows = read.select("root_seq", folder.alias("session_id"), F.explode(found).alias("r")).select("root_seq", "session_id", "r.*")
    n = {k: finite(get("t", f"$.{k}", "string")).cast("long") for k in ("tokensIn", "tokensOut", "cacheReads", "cacheWrites")}
    used = F.coalesce((n["tokensIn"] > 0) | (n["tokensOut"] > 0), F.lit(False)) & F.col("t").isNotNull()
    counted = lambda value: F.when(used, value)
    counters = {"input": F.greatest(F.lit(0), n["tokensIn"] - n["cacheReads"] - n["cacheWrites"]), "output": n["tokensOut"], "cache_read": n["cacheReads"], "cache_write": n["cacheWrites"]}
    ts = epoch(F.col("at"))
    sums = rows.groupBy("root_seq", "session_id").agg(F.min(counted(ts)).alias("start"), F.max(counted(ts)).alias("end"), F.count_if(used).alias("turns"), *(F.sum(counted(v)).cast("long").alias(c) for c, v in counters.items()), F.min(F.when(F.col("model") != "", F.col("model"))).alias("model"))
    return sums.where("turns > 0").select(*COLUMNS)


def stats_counter(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Vendors' frozen counters: sums of the four fields over models, and the date up to which they hold."""
    read = files(spark, roots, "stats-cache.json").withColumn("j", F.try_parse_json("content")).where("j is not null")
    used = read.select("path", string("j", "$.lastComputedDate").alias("last_computed"), F.explode_outer(F.map_values(get("j", "$.modelUsage", "map<string,variant>"))).alias("v"))
    fields = {"input": "inputTokens", "output": "outputTokens", "cache_read": "cacheReadInputTokens", "cache_write": "cacheCreationInputTokens"}
    return used.groupBy("path", "last_computed").agg(*(F.sum(whole(F.col("v"), f"$.{f}")).cast("long").alias(c) for c, f in fields.items()))


def union(readers: dict[str, DataFrame]) -> DataFrame:
    """All tools' sessions; a session in several roots (a copied profile) counts for the first.

    With what follows from them: tokens sent, received and in total, the model's
    vendor, whether it is billed, and the minutes from start to end (one decimal).
    """
    every = reduce(DataFrame.unionByName, (df.withColumn("cli", F.lit(cli)) for cli, df in readers.items()))
    first = every.groupBy("cli", "session_id").agg(F.min_by(F.struct(*(c for c in every.columns if c not in ("cli", "session_id"))), "root_seq").alias("s")).select("cli", "session_id", "s.*").select(*every.columns)
    sent = F.col("input") + F.col("cache_read") + F.col("cache_write")
    model = F.coalesce("model", F.lit("unknown"))
    vendor = T.vendor(model, T.SCANNED_VENDORS)
    minutes = (F.unix_micros("end") - F.unix_micros("start")) / 60e6
    return first.withColumns({"sent": sent, "received": F.col("output"), "total": sent + F.col("output"), "provider": vendor, "billed": T.billed(F.col("cli"), vendor), "elapsed_min": F.when(minutes >= 0, F.floor(minutes * 10 + 0.5) / 10)})


def rollup(sessions: DataFrame, installed: DataFrame) -> DataFrame:
    """By tool: sessions, tokens, and whether it is there: presence is not usage."""
    used = sessions.groupBy("cli").agg(F.count(F.lit(1)).alias("sessions"), F.sum("total").cast("long").alias("tokens"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen"))
    state = F.when(~F.col("installed"), "not installed").when(F.col("sessions").isNull(), "installed, no usage").when(F.col("tokens") == 0, "zero").otherwise("used")
    return installed.join(used, "cli", "left").select("cli", state.alias("state"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "first_seen", "last_seen")
