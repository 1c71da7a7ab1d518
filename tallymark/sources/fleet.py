"""Folders of machines, the ledger as a log, and accounts of profiles.

A machine's folder holds generated JSON files, in one of three layouts. What
cannot be read is a warning, never a zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import counting
from tallymark.session import kept
from tallymark.sources.lines import files, get, instant, listed, log_lines, objects, plain, resolved, string
from tallymark.sources.walk import heads, walk

# Folders of the two newer layouts, and names that are no machine.
MACHINE, HUMAN = "machine-readable", "human-readable"
NO_MACHINE = [HUMAN, MACHINE, "archive", "corpus", "merged", "digests", "dist", "docker", "__pycache__", "testing-archive", ".git"]
#: Usage fields of a message by counter.
USAGE = {"input": "input_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens", "output": "output_tokens"}


def generated(spark: SparkSession, root: str) -> DataFrame:
    """Each machine folder's generated files: machine, name, layout (0 to 2, the newest first), content.

    A file is looked for in the machine-readable, then in the human-readable
    folder, then beside them; absent and moved must not look the same.
    """
    read = files(spark, [root], "*.json", depth=3)
    parts = F.slice(F.split(plain(F.col("path")), "/"), -3, 3)
    deep = F.element_at(parts, 2).isin(MACHINE, HUMAN)
    machine = F.when(deep, F.element_at(parts, 1)).otherwise(F.element_at(parts, 2))
    layout = F.when(~deep, 2).when(F.element_at(parts, 2) == HUMAN, 1).otherwise(0)
    # Only files of the root's own folders: <machine>/<name> or <machine>/<layout>/<name>.
    below = F.regexp_replace(plain(F.col("path")), r"^\Q" + _path(root) + r"\E/*", "")
    levels = F.size(F.split(below, "/"))
    rows = read.select(machine.alias("machine"), F.element_at(parts, 3).alias("name"), layout.alias("layout"), levels.alias("levels"), deep.alias("deep"), "content")
    rows = rows.where(((F.col("levels") == 2) & ~F.col("deep")) | ((F.col("levels") == 3) & F.col("deep"))).where(~F.col("machine").isin(NO_MACHINE))
    return rows.groupBy("machine", "name").agg(F.min_by(F.struct("layout", "content"), "layout").alias("f")).select(F.col("machine").alias("folder"), "name", "f.layout", "f.content")


def _path(root: str) -> str:
    head, mark, tail = root.partition(":/")
    return "/" + (tail if mark else head).strip("/")


def _valid(found: DataFrame) -> DataFrame:
    # Out of a generator, below which no filter is pushed: a document is parsed once.
    totals = found.where(F.col("name") == "totals.json").withColumn("j", F.explode(F.array(F.try_parse_json("content")))).drop("content")
    number = F.schema_of_variant(get("j", "$.grand_total_tokens", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    # Not by its schema, which would be made of every day in it.
    listed_ = get("j", "$.accounts", "array<variant>").isNotNull()
    named = F.coalesce(string("j", "$.machine"), F.lit("")) != ""
    return totals.withColumn("ok", F.coalesce(number & listed_ & named, F.lit(False)))


def warnings(found: DataFrame) -> DataFrame:
    """Machine folders whose totals cannot be read or lack a field: they are left out, and named."""
    return _valid(found).where(~F.col("ok")).select("folder", F.lit("totals.json unreadable or missing required fields").alias("warning"))


def machines(found: DataFrame) -> DataFrame:
    """Machines: folder, machine, grand_total, and their hardware file's model if there is one."""
    hardware = found.where(F.col("name") == "hardware.json").select("folder", string(F.try_parse_json("content"), "$.model").alias("hardware"))
    return _valid(found).where("ok").select("folder", string("j", "$.machine").alias("machine"), get("j", "$.grand_total_tokens", "double").cast("long").alias("grand_total")).join(hardware, "folder", "left")


def account_days(found: DataFrame) -> DataFrame:
    """Usage of machines by account and day: machine, account, grand_total, day, value; a day's numbers are summed."""
    accounts = _valid(found).where("ok").select(string("j", "$.machine").alias("machine"), F.posexplode(get("j", "$.accounts", "array<variant>")).alias("place", "a"))
    # An account's own fields are taken before its days are dealt out, or each day would carry and search the whole account.
    own = accounts.select("machine", "place", string("a", "$.account").alias("account"), counting.finite(get("a", "$.grand_total", "string")).cast("long").alias("grand_total"), F.map_entries(get("a", "$.by_day", "map<string,variant>")).alias("days"))
    rows = own.select("machine", "place", "account", "grand_total", F.explode_outer("days").alias("d"))
    # A day is a number, or an object of counters.
    flat = F.aggregate(F.map_values(get("d.value", "$", "map<string,variant>")), F.lit(0.0), lambda s, v: s + counting.finite(F.try_variant_get(v, "$", "string")))
    value = F.when(F.schema_of_variant(F.col("d.value")).startswith("OBJECT"), flat).otherwise(counting.finite(get("d.value", "$", "string")))
    return rows.select("machine", "place", "account", "grand_total", F.col("d.key").alias("day"), F.coalesce(value, F.lit(0.0)).cast("long").alias("value"))


def ledger(spark: SparkSession, path: str, counters: list[str], glob: str = "*.jsonl") -> DataFrame:
    """The ledger's rows, oldest first by ``pos``; a line that is no object costs that line."""
    j = objects(log_lines(spark, [path], glob))
    return j.select(string("j", "$.cli").alias("cli"), string("j", "$.session_id").alias("session_id"), string("j", "$.version").alias("version"), F.col("line_no").alias("pos"), *(counting.whole(get("j", f"$.{c}", "string")).alias(c) for c in ["total", *counters]))


def account_name(config: Column, folder: Column) -> Column:
    """Who a profile belongs to, the strongest sign first: an e-mail address, a user id cut to 12, else unknown by its folder.

    ``config`` is the profile's configuration as VARIANT, null if unreadable.
    """
    email, uid = string(config, "$.oauthAccount.emailAddress"), string(config, "$.userID")
    return F.when(email != "", email).when(uid != "", F.concat(F.lit("user:"), F.substring(uid, 1, 12))).otherwise(F.concat(F.lit("unknown ("), folder, F.lit(")")))


def profile_accounts(spark: SparkSession, roots: list[str], depth: int = 6) -> DataFrame:
    """profile (folder) and account of each profile below the roots.

    A profile is a folder with ``projects`` in it. Its configuration stands in
    it, but that of the default profile ``.claude`` stands beside it.
    """
    found = reduce(DataFrame.unionByName, (walk(spark, root, depth) for root in resolved(roots)))
    profiles = found.where(F.col("path").endswith(".jsonl")).select(_profile(F.col("path")).alias("profile")).where("profile is not null").distinct()
    configs = heads(found.where(F.col("path").endswith("/.claude.json")), MOST_CONFIG).select(F.regexp_replace("path", "/[^/]*$", "").alias("at"), F.try_parse_json(F.col("head").cast("string")).alias("config"))
    name = F.element_at(F.split("profile", "/"), -1)
    at = F.when(name == ".claude", F.regexp_replace("profile", "/[^/]*$", "")).otherwise(F.col("profile"))
    return profiles.withColumn("at", at).join(configs, "at", "left").select("profile", account_name(F.col("config"), name).alias("account"))


def _profile(path: Column) -> Column:
    found = F.regexp_extract(plain(path), "^(.*)/projects/", 1)
    return F.when(found != "", found)


def _main(path: Column) -> Column:
    """Whether a transcript is no sub-agent's or workflow's."""
    below = F.regexp_extract(plain(path), "^.*/projects/(.*)$", 1)
    return ~F.exists(F.split(below, "/"), lambda p: p.isin("workflows", "subagents"))


def profile_usage(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Usage rows of all profiles' transcripts, a copied row (by uuid, over all profiles) at its first sight only.

    Columns: profile, path, main (no sub-agent's or workflow's transcript), ts,
    day (of the stamp as written), model, and the counters; a counter that is no
    whole number is 0, rows without uuid all count.
    """
    j = objects(log_lines(spark, roots, glob, many=True).where(F.col("line").contains('"usage"')))
    usage = get("j", "$.message.usage", "variant")
    stamp = F.coalesce(string("j", "$.timestamp"), F.lit(""))
    rows = j.where(F.schema_of_variant(usage).startswith("OBJECT")).select(
        "root_seq",
        F.col("path"),
        "line_no",
        F.when(get("j", "$.uuid", "string") != "", get("j", "$.uuid", "string")).alias("uuid"),
        F.when(stamp != "", stamp).alias("stamp"),
        F.coalesce(T.model_name(string("j", "$.message.model")), F.lit("unknown")).alias("model"),
        *(F.coalesce(counting.strict_int(get("j", f"$.message.usage.{f}", "variant")), F.lit(0)).alias(c) for c, f in USAGE.items()),
    )
    # Kept, for sessions, their models and totals each use it, and copies are told apart by a shuffle of all rows.
    first = kept(counting.first_wins(rows, "uuid", F.struct("root_seq", "path", "line_no")), "usage")
    return first.select(_profile(F.col("path")).alias("profile"), "path", _main(F.col("path")).alias("main"), "line_no", instant(F.col("stamp")).alias("ts"), F.substring("stamp", 1, 10).alias("day"), "model", *USAGE).where("profile is not null")


def profile_files(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """All transcript files of profiles, read or not: profile, path, main."""
    found = listed(spark, roots, glob)
    return kept(found.select(_profile(F.col("path")).alias("profile"), "path", _main(F.col("path")).alias("main")).where("profile is not null"), "files")


def _session_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


def profile_sessions(usage: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row per transcript file with usage: turns, span, minutes on the clock (one decimal), the model of most turns, counters.

    With ``files`` a main transcript that brought no usage is a session too, of
    zeros, without a span or a model.
    """
    sums = usage.groupBy("profile", "path", "main").agg(F.count(F.lit(1)).alias("turns"), F.min("ts").alias("start"), F.max("ts").alias("end"), *(F.sum(c).cast("long").alias(c) for c in USAGE))
    votes = usage.groupBy("path", "model").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first")).groupBy("path").agg(F.min_by("model", F.struct(-F.col("n"), "first")).alias("model"))
    minutes = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 60e6 * 10 + 0.5) / 10
    used = sums.join(votes, "path").select("profile", "path", "main", "turns", "start", "end", F.coalesce(minutes, F.lit(0.0)).alias("duration_min"), "model", *USAGE)
    if files is not None:
        none = files.where("main").join(used.select("path"), "path", "left_anti")
        zero = none.select("profile", "path", "main", F.lit(0).cast("long").alias("turns"), F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit(0.0).alias("duration_min"), F.lit(None).cast("string").alias("model"), *(F.lit(0).cast("long").alias(c) for c in USAGE))
        used = used.unionByName(zero)
    return used.select("profile", _session_name(F.col("path")).alias("session_id"), "main", "turns", "start", "end", "duration_min", "model", *USAGE)


def profile_totals(usage: DataFrame, files: DataFrame) -> DataFrame:
    """A row per profile: its sessions (main transcripts, with usage or without) and its counters, also those of nested transcripts."""
    seen = files.groupBy("profile").agg(F.count_if("main").alias("sessions"))
    sums = usage.groupBy("profile").agg(*(F.sum(c).cast("long").alias(c) for c in USAGE))
    return seen.join(sums, "profile", "left").select("profile", "sessions", *(F.coalesce(c, F.lit(0)).alias(c) for c in USAGE))


# Where each tool keeps transcripts to search below a home folder, and their names.
SEARCHED = [("claude", ".claude/projects", r"\.jsonl$"), ("codex", ".codex/sessions", r"\.json$"), ("gemini", ".gemini/tmp", r"^session-.*\.jsonl?$")]


def searched_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Transcripts to search below home folders: cli, path."""
    found = reduce(DataFrame.unionByName, (walk(spark, root, 8).withColumn("root", F.lit(root.rstrip("/"))) for root in resolved(roots)))
    cli = F.lit(None).cast("string")
    for name, folder, pattern in SEARCHED:
        cli = F.when(F.col("path").startswith(F.concat("root", F.lit(f"/{folder}/"))) & F.element_at(F.split("path", "/"), -1).rlike(pattern), name).otherwise(cli)
    return found.select(cli.alias("cli"), "path").where("cli is not null")


# Keys of a row that accounts for usage, words for tables of records, and where tools' folders stand.
USAGE_KEYS = ["usage", "tokens", "token_count", "tokenCount", "input_tokens", "output_tokens", "prompt_tokens", "completion_tokens", "total_tokens", "totalTokens", "cache_read_input_tokens", "inputTokens", "outputTokens"]
RECORD_WORDS = ["session", "sessions", "conversation", "conversations", "chat", "chats", "history", "transcript", "transcripts", "messages", "thread", "threads", "rollout", "rollouts", "checkpoints"]
TOOL_BASES = ["", ".config", ".local/share", "Library/Application Support", "Library/Containers", "AppData/Roaming", "AppData/Local"]
# Files of a folder, lines of a log, bytes of a database and of a log that are looked at, and how deep.
MOST_FILES, MOST_LINES, MOST_HEAD, MOST_LOG, MOST_CONFIG, MOST_DEPTH = 40, 31, 65536, 262144, 1 << 24, 4
# Folders in which no tool keeps records of its own.
SKIPPED = [".git", "node_modules", "__pycache__", ".cache", ".npm", ".cargo", ".rustup", "venv", ".venv", "site-packages", "dist-packages", "Trash", ".Trash", "snap", ".steam", "Steam", ".wine", "go", ".gradle", ".m2"]


def tool_root(folder: Column, home: str) -> Column:
    """The tool's own folder above a folder: the first one below home or below a base for applications."""
    rest = F.when(folder.startswith(home + "/"), F.substring(folder, len(home) + 2, 1 << 20)).otherwise(F.lit(""))
    out = folder
    for base in sorted(TOOL_BASES, key=len):  # the longest base that holds it counts
        start = f"{base}/" if base else ""
        own = F.element_at(F.split(F.substring(rest, len(start) + 1, 1 << 20), "/"), 1)
        out = F.when(rest.startswith(start) & (own != ""), F.concat(F.lit(f"{home}/{start}"), own)).otherwise(out)
    return F.when(rest == "", folder).otherwise(out)


def stores_by_content(spark: SparkSession, home: str, known: list[str], archives: list[str] | None = None) -> DataFrame:
    """Tools' folders that hold records of conversations, told by content: tool, path, status.

    A folder is a hit if one of its logs' first lines has a key of usage, or one
    of its databases a table of records; it is ambiguous if a file of it could
    not be told. KNOWN beats UNKNOWN beats AMBIGUOUS for one tool. Files in the
    home folder itself are no tool's; ``archives`` names folders of copies, which
    are left out too.
    """
    low = F.lower(F.element_at(F.split("path", "/"), -1))
    log, store = low.rlike(r"\.jsonl?$"), low.rlike(r"\.(db|sqlite3?)$")
    every = walk(spark, home, MOST_DEPTH, [*SKIPPED, *(archives or [])]).where("size is not null").where(log | store).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), store.alias("store")).where(F.col("folder") != home.rstrip("/"))
    nth = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    looked = every.withColumn("nth", nth).where(F.col("nth") <= MOST_FILES).drop("nth")
    read = heads(looked, MOST_LOG)
    first = F.slice(F.split(F.decode("head", "ISO-8859-1"), "\n"), 1, MOST_LINES)
    keys = lambda j: F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))
    usage = F.exists(first, lambda line: F.arrays_overlap(F.array_union(keys(line), keys(F.get_json_object(line, "$.message"))), F.array(*map(F.lit, USAGE_KEYS))))
    text = F.decode(F.substring("head", 1, MOST_HEAD), "ISO-8859-1")
    tables = F.transform(F.regexp_extract_all(text, F.lit("(?i)CREATE TABLE\\s+[\"'`\\[]?(\\w+)"), F.lit(1)), F.lower)
    met = looked.join(read.select("path", F.col("head").isNull().alias("lost"), usage.alias("hit"), text.startswith("SQLite format 3").alias("readable"), F.arrays_overlap(tables, F.array(*map(F.lit, RECORD_WORDS))).alias("found")), "path")
    hit = F.coalesce(F.when(F.col("store"), F.col("readable") & F.col("found")).otherwise(F.col("hit")), F.lit(False))
    unread = F.col("lost") | (F.col("store") & ~F.coalesce("readable", F.lit(False)))
    folders = met.groupBy("folder").agg(F.max(hit).alias("hit"), F.max(unread).alias("unread")).where("hit or unread")
    root = tool_root(F.col("folder"), home.rstrip("/"))
    covers = F.lit(False)
    for k in (x.rstrip("/") for x in known):
        covers = covers | (F.col("folder") == k) | F.col("folder").startswith(k + "/") | (F.lit(k) == root) | F.lit(k + "/").startswith(F.concat(root, F.lit("/")))
    rank = F.when(covers, 3).when(F.col("hit"), 2).otherwise(1)
    best = folders.groupBy(root.alias("path")).agg(F.max(rank).alias("rank"))
    status = F.element_at(F.array(F.lit("AMBIGUOUS"), F.lit("UNKNOWN"), F.lit("KNOWN")), F.col("rank"))
    return best.select(F.element_at(F.split("path", "/"), -1).alias("tool"), "path", status.alias("status"))
