"""Folders of machines, profiles, stores found by content, rules, and streams of documents; hand-checkable."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from test_streaming_and_sinks import field, run

from tallymark.functions import trees
from tallymark.operators import quality, scoring
from tallymark.sources import binary, fleet, lines, providers, sinks
from tallymark.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


def test_machine_folders_in_three_layouts(spark, tmp_path):
    totals = lambda m, n: {"machine": m, "grand_total_tokens": n, "accounts": [{"account": "a", "grand_total": n, "by_day": {"2026-01-01": {"in": n - 1, "x": "1"}, "2026-01-02": 4}}]}
    write(tmp_path / "one/machine-readable/totals.json", totals("M1", 10))
    write(tmp_path / "one/human-readable/totals.json", totals("stale", 1))
    write(tmp_path / "one/totals.json", totals("older", 1))
    write(tmp_path / "two/human-readable/totals.json", totals("M2", 20))
    write(tmp_path / "two/hardware.json", {"model": "X1"})
    write(tmp_path / "three/totals.json", totals("M3", 30))
    write(tmp_path / "archive/totals.json", totals("no", 99))
    write(tmp_path / "deep/er/still/totals.json", totals("no", 99))
    write(tmp_path / "broken/totals.json", "{")
    write(tmp_path / "lacking/totals.json", {"machine": "L", "grand_total_tokens": "7", "accounts": []})
    found = fleet.generated(spark, str(tmp_path))
    assert {(r.folder, r.machine, r.grand_total, r.hardware) for r in fleet.machines(found).collect()} == {("one", "M1", 10, None), ("two", "M2", 20, "X1"), ("three", "M3", 30, None)}
    assert {r.folder for r in fleet.warnings(found).collect()} == {"broken", "lacking"}
    assert {(r.machine, r.day, r.value) for r in fleet.account_days(found).collect()} >= {("M1", "2026-01-01", 10), ("M1", "2026-01-02", 4)}


def test_profiles_and_their_accounts(spark, tmp_path):
    row = lambda uuid, out, **more: json.dumps({"uuid": uuid, "timestamp": "2026-01-01T23:30:00-02:00", "message": {"model": "claude-x", "usage": {"input_tokens": 1, "output_tokens": out, "cache_read_input_tokens": "9"}}} | more)
    write(tmp_path / ".claude/projects/p/s1.jsonl", "\n".join([row("u1", 5), row("u2", 6.5), row(None, 7), row(None, 7), '{"usage": torn']))
    write(tmp_path / ".claude/projects/p/subagents/s2.jsonl", row("u1", 50) + "\n" + row("u3", 8, timestamp="2026-01-02T00:00:00Z"))
    write(tmp_path / "other/projects/q/s3.jsonl", row("u2", 60))
    write(tmp_path / ".claude.json", {"oauthAccount": {"emailAddress": "me@x.org"}, "userID": "1"})
    write(tmp_path / "other/.claude.json", {"userID": "0123456789abcdef"})
    write(tmp_path / "third/projects/r/s4.jsonl", "{}")
    got = {r.profile.rsplit("/", 1)[1]: r.account for r in fleet.profile_accounts(spark, [str(tmp_path)]).collect()}
    assert got == {".claude": "me@x.org", "other": "user:0123456789ab", "third": "unknown (third)"}
    usage = fleet.profile_usage(spark, [str(tmp_path / ".claude"), str(tmp_path / "other")])
    sums = {(r.day, r.output, r.input, r.cache_read) for r in usage.groupBy("day").agg(F.sum("output").alias("output"), F.sum("input").alias("input"), F.sum("cache_read").alias("cache_read")).collect()}
    assert sums == {("2026-01-01", 5 + 0 + 7 + 7, 4, 0), ("2026-01-02", 8, 1, 0)}
    rows = {r.session_id: (r.main, r.turns, r.duration_min, r.output) for r in fleet.profile_sessions(usage).collect()}
    assert rows == {"s1": (True, 4, 0.0, 19), "s2": (False, 1, 0.0, 8)}


def test_a_torn_ledger_line_costs_one_row(spark, tmp_path):
    write(tmp_path / "l.jsonl", '{"cli": "a", "session_id": "s", "total": "5"}\n{"cli": "a", "sess\n\n{"cli": "a", "session_id": "s", "total": 5.5}\n7\n')
    got = fleet.ledger(spark, str(tmp_path), []).orderBy("pos").collect()
    assert [r.total for r in got] == [5, 0] and got[0].pos < got[1].pos


def test_lines_keep_their_order_when_a_file_is_split(spark, tmp_path):
    write(tmp_path / "big.jsonl", "\n".join(json.dumps({"i": i, "pad": "x" * 90}) for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        read = lines.log_lines(spark, [str(tmp_path), str(tmp_path) + "/"])
        assert read.rdd.getNumPartitions() > 4
        got = [json.loads(r.line)["i"] for r in read.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(20_000))


def test_nested_and_linked_roots_count_once(spark, tmp_path):
    write(tmp_path / "a/x.jsonl", "{}")
    write(tmp_path / "a/b/y.jsonl", "{}")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    roots = [str(tmp_path / "a/b"), str(tmp_path / "a"), str(tmp_path / "link")]
    assert {(r.root_seq, r.path.rsplit("/", 1)[1]) for r in lines.log_lines(spark, roots).collect()} == {(0, "y.jsonl"), (1, "x.jsonl")}
    assert lines.log_lines(spark, [str(tmp_path)], depth=2).count() == 2 and lines.log_lines(spark, []).count() == 0


def test_stores_are_told_by_content(spark, tmp_path):
    write(tmp_path / ".known/deep/sessions/a.jsonl", {"message": {"usage": {}}})
    write(tmp_path / ".config/newtool/x/b.json", {"total_tokens": 1})
    write(tmp_path / ".boring/c.json", {"name": 1})
    write(tmp_path / ".late/d.jsonl", "{}\n" * 40 + '{"usage": 1}')
    write(tmp_path / ".odd/e.db", "no database")
    con = sqlite3.connect(tmp_path / "f.db")
    con.execute("create table chats (x)")
    con.commit()
    con.close()
    (tmp_path / ".talk").mkdir()
    (tmp_path / "f.db").rename(tmp_path / ".talk/f.db")
    got = {r.tool: r.status for r in fleet.stores_by_content(spark, str(tmp_path), [str(tmp_path / ".known/deep")]).collect()}
    assert got == {".known": "KNOWN", "newtool": "UNKNOWN", ".odd": "AMBIGUOUS", ".talk": "UNKNOWN"}


def test_files_to_search(spark, tmp_path):
    for path in (".claude/projects/p/a.jsonl", ".claude/other/b.jsonl", ".codex/sessions/2026/c.json", ".codex/sessions/c.jsonl", ".gemini/tmp/h/session-1.json", ".gemini/tmp/h/session-2.jsonl", ".gemini/tmp/h/log.json"):
        write(tmp_path / path, "{}")
    got = {(r.cli, r.path.rsplit("/", 1)[1]) for r in fleet.searched_files(spark, [str(tmp_path)]).collect()}
    assert got == {("claude", "a.jsonl"), ("codex", "c.json"), ("gemini", "session-1.json"), ("gemini", "session-2.jsonl")}


def test_antigravity_sessions(spark, tmp_path):
    key = b"0123456789abcdef0123456789abcdef"
    usage = lambda n, req: field(2, n) + field(3, 30) + field(9, 20) + field(10, 10) + field(11, req)
    stamp = lambda s: field(1, s) + field(2, 5)
    plain = field(9, usage(100, b"r1")) + field(9, usage(100, b"r1")) + field(9, usage(50, b"r2")) + field(4, field(7, stamp(1_760_000_000)) + field(8, stamp(1_760_000_600))) + field(6, b"gemini-2.5-pro. gemini-cli gemini-2.5-pro")
    sealed = spark.createDataFrame([(bytearray(plain),)], "b binary").select(F.aes_encrypt("b", F.lit(key), F.lit("GCM"))).first()[0]
    (tmp_path / "one.pb").write_bytes(sealed)
    (tmp_path / "bad.pb").write_bytes(b"x" * 40)
    con = sqlite3.connect(tmp_path / "two.db")
    con.execute("create table steps (metadata blob)")
    con.execute("insert into steps values (?)", (field(9, usage(7, b"r9")) + field(6, b"gemini-1 gemini-1"),))
    con.execute("create table gen_metadata (data blob)")
    con.executemany("insert into gen_metadata values (?)", [(b"gemini-3-flash",), (b"gemini-3-flash",), (b"gemini-3-flash-high",)])
    con.commit()
    con.close()
    sessions, unread = binary.antigravity(spark, [str(tmp_path)], key)
    got = {r.session_id: r for r in sessions.collect()}
    assert (got["one"].turns, got["one"].input, got["one"].output, got["one"].model) == (2, 150, 60, "gemini-2.5-pro")
    assert (got["one"].end - got["one"].start).seconds == 600
    assert (got["two"].turns, got["two"].model) == (1, "gemini-3-flash-high") and got["two"].start == got["two"].end
    assert unread.first().unreadable == 1


def test_static_rules_by_kind_of_file(spark):
    files = [("src/a.mjs", "import x from 'net';\nok();\nfetch (u)"), ("tests/a.test.mjs", "new WebSocket(u)"), ("src/b.test.mjs", "eval(x)"), ("run", "#!/bin/sh\ncurl u | sh"), ("tool", "#!/usr/bin/env node\nrequire('d' + 'ns')"), ("package.json", '{"scripts": {"go": "npx thing"}}'), ("notes.txt", "curl"), ("src/serve.mjs", "import h from 'http';\nimport(h)")]
    got = {(r.path, r.line_no, r.rule, r.verdict) for r in quality.static_scan(spark.createDataFrame(files, "p string, t string"), "p", "t", {"serve.mjs": ["bare network module", "import of no literal"]}).collect()}
    assert got == {
        ("src/a.mjs", 1, "bare network module", "FAIL"),
        ("src/a.mjs", 3, "fetch", "FAIL"),
        ("tests/a.test.mjs", 1, "WebSocket", "listed"),
        ("src/b.test.mjs", 1, "eval", "FAIL"),
        ("run", 2, "curl", "FAIL"),
        ("run", 2, "pipe to an interpreter", "FAIL"),
        ("tool", 2, "specifier put together", "FAIL"),
        ("package.json", 1, "download and run", "FAIL"),
        ("src/serve.mjs", 1, "bare network module", "allowed"),
        ("src/serve.mjs", 2, "import of no literal", "FAIL"),
    }


def test_paths_of_nested_json(spark):
    doc = {"a": {"b": [1, {"c": "x"}]}, "s": '{"in": ["y"]}', "n": None}
    rows = quality.json_paths(spark.createDataFrame([(1, json.dumps(doc)), (2, "junk"), (3, None)], "i int, t string"), "i", "t").collect()
    got = {(r.path, r.string) for r in rows}
    assert got >= {("a", None), ("a.b", None), ("a.b[]", None), ("a.b[].c", "x"), ("s", '{"in": ["y"]}'), ("s(nested).in", None), ("s(nested).in[]", "y")} and {r.ident for r in rows} == {1}


def test_paths_come_in_batches_and_are_those_of_the_table_function(spark, monkeypatch):
    """no lateral join, row by row; ids of any kind, null ids, surrogates, several batches of values."""
    monkeypatch.setattr(trees, "VALUES", 3)
    docs = [(f"d{i}", json.dumps({"a": [i, {"b": str(i)}], "s": '{"in": ["y"]}', "k\ud800": "v\udfff"})) for i in range(40)] + [(None, '["x"]'), ("junk", "{"), ("none", None)]
    df = spark.createDataFrame(docs, "i string, t string").repartition(3)
    got = quality.json_paths(df, "i", "t")
    want = trees.walked(df.where("t is not null").select(F.col("i").alias("ident"), "t"), "t").select("ident", "path", "string")
    assert "UDTF" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_longest_text_and_keys_of_one_value(spark):
    """a value may be both a long text and at a long key; documents are walked once for both."""
    files = spark.createDataFrame([("a.json", json.dumps({"k" * 70: "x" * 71, "b": {"c": "y"}}))], "path string, text string")
    assert list(map(tuple, quality.longest_texts(files, "path", "text").collect())) == [("data", "k" * 70, 71)]
    assert quality.longest_texts(files, "path", "text")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.key for r in quality.key_vocabulary(files, "path", "text").collect()} == {"k" * 70, "b", "b.c"}


def test_documents_of_one_file_are_many_tasks(spark):
    """A table that is read by one task is walked by all cores."""
    df = spark.createDataFrame([(i, '{"project": "secret/app"}') for i in range(64)], "i int, t string").coalesce(1)
    for out, column in ((quality.map_labels(df, "t"), "masked"), (quality.json_paths(df, "i", "t"), "path")):
        assert out.select(column, F.spark_partition_id().alias("at")).select("at").distinct().count() == trees.DEALT * spark.sparkContext.defaultParallelism


def test_labels_are_masked_wherever_they_stand(spark):
    doc = {"project": "secret/app", "projects": [{"name": "other", "n": 1}, {"name": "[excluded]"}], "x": ["secret/app", "not secret/app"], "other": "other"}
    (r,) = quality.map_labels(spark.createDataFrame([(json.dumps(doc),)], "t string"), "t").collect()
    out = json.loads(r.masked)
    assert out["project"].startswith("proj-") and out["x"] == [out["project"], "not secret/app"] and out["projects"][0]["name"] == out["other"] != "other" and out["projects"][1]["name"] == "[excluded]"


def test_documents_are_written_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.json", "x"), ("c.json", None or "y")], "path string, content string")
    assert sinks.write_documents(df, str(tmp_path)) == 2 and sinks.write_documents(df, "file://" + str(tmp_path)) == 2
    assert (tmp_path / "a/b.json").read_text() == "x" and (tmp_path / "c.json").read_text() == "y"


def test_logs_of_very_many_files_are_written_and_read_by_tasks(spark, tmp_path):
    """a file a session, each written by one task in one go, listed and read by tasks as Spark's reader reads them."""
    rows = spark.range(2000).repartition(7).withColumn("s", F.when(F.col("id") % 100 != 99, F.col("id") % 37))
    for root in ("one", "two"):
        assert sinks.write_logs(rows, F.concat(F.lit("k="), "s", F.lit("/t.txt")), F.when(F.col("id") != 5, F.col("id").cast("string")), f"file://{tmp_path}/{root}") == 37
    assert sinks.write_logs(rows.limit(0), F.lit("none"), F.lit("x"), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
    want = sorted((f"k={i % 37}", str(i)) for i in range(2000) if i % 100 != 99 and i != 5)
    assert sorted((f.parent.name, x) for f in (tmp_path / "one").glob("*/t.txt") for x in f.read_text().splitlines()) == want
    for name in ("one/_temporary/t.txt", "one/.sub/t.txt", "one/k=1/t.json", "one/k=1/_t.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("no")
    (tmp_path / "one/k=1/gone.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "one/link").symlink_to(tmp_path / "two/k=0")
    read = lines.walked_lines(spark, [str(tmp_path / "one"), f"file://{tmp_path}/two", f"{tmp_path}/one/k=3/"], "*.txt")
    got = [[(*r.path.split("/")[-3:-1], r.line) for r in read.where(F.col("root_seq") == i).collect()] for i in (0, 1, 2)]
    assert sorted(x[1:] for x in got[0] if x[1] != "link") == want == sorted(x[1:] for x in got[1]) and got[2] == []
    assert sorted(x[2] for x in got[0] if x[1] == "link") == sorted(x for k, x in want if k == "k=0")
    logs = lines.log_lines(spark, [str(tmp_path / "one")], "*.txt")
    assert sorted(r.line for r in logs.collect()) == sorted(x[2] for x in got[0])
    plan = providers.grok(spark, [str(tmp_path / "one")], "*.txt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("] parquet"), plan
    with pytest.raises(Exception, match="cannot be listed"):
        lines.walked_lines(spark, [str(tmp_path / "absent")]).collect()


def test_a_run_taken_out_shows(spark, tmp_path):
    run_ = spark.createDataFrame([("x", 1)], "argv string, reads long")
    path = str(tmp_path / "runs")
    assert [sinks.append_run(run_, path, s) for s in ("1", "2", "3")] == [0, 1, 2]
    assert sinks.run_breaks(spark, path).count() == 0
    log = sinks.read_runs(spark, path).where("run_index <> 1")
    (r,) = quality.chain_breaks(log, ["log"], "stamp", F.col("raw"), "stated", "run_index").collect()
    assert (r.hash_ok, r.index_ok) == (False, False)


def test_reports_have_a_line_a_row(spark):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert [r.json for r in sinks.report(df).collect()] == ['{"b":1,"a":null}']


def test_four_stars(spark):
    full = {"tokens_m": 50.0, "projects": 4.0, "langs": 2.0, "tool_calls": 500.0, "models": 1.0, "night_hours": 5.0, "streak": 3.0, "active_days": 8.0}
    corpus = spark.createDataFrame([("x", *full.values())], ["k", *full])
    part = spark.createDataFrame([("x", 50.0, 4.0, 8.0)], ["k", "tokens_m", "projects", "active_days"])
    rows = scoring.sources({("corpus", "lifetime"): corpus, ("fleet", "lifetime"): part}, ["k"]).collect()
    got = {(r.source, r.axis): (r.measured, r.level > 0, r.floor) for r in rows}
    assert all(got["corpus", a] == (True, True, False) for a in range(5))
    assert [got["fleet", a][0] for a in range(5)] == [True, True, False, False, False] and not got["fleet", 4][1] and got["fleet", 0][2]


def test_verdicts(spark):
    df = spark.range(1)
    of = lambda *cs: list(df.select(*cs).first())
    lit = F.lit
    assert of(scoring.hours_verdict(lit(80.0), lit(10)), scoring.hours_verdict(lit(1.0), lit(0)), scoring.hours_verdict(lit(15.0), lit(10))) == ["full days", "short bursts", "a habit"]
    assert of(scoring.peak_verdict(lit(23), lit(True)), scoring.peak_verdict(lit(18), lit(False)), scoring.peak_verdict(lit(8), lit(False)), scoring.peak_verdict(lit(None).cast("int"), lit(False))) == ["night owl", "after work", "early", "own hours"]
    assert of(scoring.fan_verdict(lit(10)), scoring.fan_verdict(lit(9))) == ["wide", "deep"]
    assert of(*(scoring.streak_verdict(lit(c), lit(n)) for c, n in ((5, 5), (8, 10), (0, 4), (1, 30), (1, 9)))) == ["record", "near", "broken", "stands", "steady"]


def test_streams_of_packets_folders_and_scans(spark, tmp_path):
    stamp = "2026-01-01T10:00:0"
    rows = [("announce", "m", "1", stamp + "1"), ("announce", "m", "1", stamp + "1"), ("announce", "m", "2", stamp + "4"), ("hello", "n", "1", stamp + "1"), ("announce", "z", "1", "2026-01-01T11:00:00")]
    spark.createDataFrame(rows, "kind string, machine string, sentAt string, at string").withColumn("ts", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, machine string, sentAt string, at string, ts timestamp").parquet(str(tmp_path / "in"))
    got = run(incremental.announced(stream, "ts"), "append", "announced", spark, tmp_path).collect()
    assert [(r.machine, r.packets) for r in got] == [("m", 2)]
    write(tmp_path / "pushed/a.json", {"folderName": " My Mac ", "total": 5})
    write(tmp_path / "pushed/b.json", {"machine": "..", "total": 6})
    got = run(incremental.pushed_folders(spark, str(tmp_path / "pushed"), "total long"), "append", "pushed", spark, tmp_path).collect()
    assert [(r.folder, r.total) for r in got] == [("my-mac", 5)]
    once = run(incremental.first_sights(stream.where("kind = 'announce'"), ["machine", "sentAt"], "ts"), "append", "once", spark, tmp_path)
    assert once.count() == 3
    wide = run(incremental.hourly(stream, "ts", "1 minute", "10 minutes", "5 minutes"), "append", "wide", spark, tmp_path)
    assert sum(r.events for r in wide.collect()) == 2 * 4
    incremental.rescored(stream, lambda kept: kept.groupBy("machine").count(), str(tmp_path / "scan"), str(tmp_path / "at")).awaitTermination(120)
    assert {(r.machine, r["count"]) for r in spark.read.parquet(str(tmp_path / "scan/result")).collect()} == {("m", 3), ("n", 1), ("z", 1)}


def test_membership(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("m",), ("m",), ("n",)], "machine string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("machine string").parquet(str(tmp_path / "in"))
    got = run(incremental.membership(stream), "update", "members", spark, tmp_path).where("event = 'join'").collect()
    assert {(r.machine, r.packets) for r in got} == {("m", 2), ("n", 1)}


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from tallymark import session

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    with pytest.raises(ValueError):
        session.shared_dir(Session(**{"spark.master": "spark://host:7077"}))
    assert session.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"


def test_a_transcript_without_usage_is_a_session(spark, tmp_path):
    row = json.dumps({"timestamp": "2026-02-01T00:00:00Z", "uuid": "u", "message": {"model": "m", "usage": {"input_tokens": 5}}})
    for path, text in (("a/projects/p/used.jsonl", row), ("a/projects/p/empty.jsonl", '{"type":"user"}'), ("a/projects/p/subagents/none.jsonl", "{}"), ("b/projects/p/copy.jsonl", row), ("b/other.jsonl", row)):
        write(tmp_path / path, text)
    files, usage = fleet.profile_files(spark, [str(tmp_path)]), fleet.profile_usage(spark, [str(tmp_path)])
    name = lambda p: p.rsplit("/", 1)[1]
    rows = {(name(r.profile), r.session_id): (r.turns, r.input, r.model) for r in fleet.profile_sessions(usage, files).collect()}
    # The copied row counts once; the file it was copied to is a session of zeros.
    assert rows == {("a", "used"): (1, 5, "m"), ("a", "empty"): (0, 0, None), ("b", "copy"): (0, 0, None)}
    assert {name(r.profile): (r.sessions, r.input) for r in fleet.profile_totals(usage, files).collect()} == {"a": (2, 5), "b": (1, 0)}


def test_tool_roots(spark):
    at = lambda p: spark.range(1).select(fleet.tool_root(F.lit(p), "/h/a.b")).first()[0]
    assert at("/h/a.b/.config/x/y") == "/h/a.b/.config/x" and at("/h/a.b/.tool/s") == "/h/a.b/.tool" and at("/h/a.b/Library/Application Support/T/z") == "/h/a.b/Library/Application Support/T"
    assert at("/h/a.b/.config") == "/h/a.b/.config" and at("/elsewhere/x") == "/elsewhere/x" and at("/h/a.b") == "/h/a.b"


def test_rollouts_of_many_files_keep_heads_with_their_sessions(spark):
    """with partitions that Spark merges by their size, each session's head stays before its counters."""
    import duckdb

    from tallymark.plans import stores

    sf = "/root/testdata/sf0.01"
    merged = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in merged}
    try:
        for k, v in merged.items():
            spark.conf.set(k, v)
        got = {r.session_id: tuple(r) for r in stores.rollout_sessions(spark, sf).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    duckdb.sql(f"create or replace temp view events as select * from '{sf}/events.parquet'")
    want = {r[0]: r for r in duckdb.sql(stores.ORACLES["rollout_sessions"]).fetchall()}
    assert got == want and got


def test_days_of_an_account_do_not_carry_it(spark, tmp_path):
    """a document is parsed once, and no day is dealt out together with its whole account."""
    write(tmp_path / "one/totals.json", {"machine": "M", "grand_total_tokens": 5, "accounts": [{"account": "a", "grand_total": "5", "by_day": {"2026-01-01": 3, "2026-01-02": {"x": 2}}}, {"account": "b"}]})
    write(tmp_path / "two/totals.json", {"machine": "N", "grand_total_tokens": 5, "accounts": {}})
    found = fleet.generated(spark, str(tmp_path))
    days = fleet.account_days(found)
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 1
    assert sorted((r.account, r.grand_total, r.day or "", r.value) for r in days.collect()) == [("a", 5, "2026-01-01", 3), ("a", 5, "2026-01-02", 2), ("b", 0, "", 0)]
    assert [r.folder for r in fleet.warnings(found).collect()] == ["two"]


def test_usage_of_profiles_is_worked_out_once(spark, tmp_path):
    """files and usage rows are kept, so that sessions and totals list and read the transcripts once."""
    row = {"type": "assistant", "uuid": "u", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": "m", "model": "claude-x", "usage": {"input_tokens": 3}}}
    write(tmp_path / "p/projects/x/t.jsonl", row)
    write(tmp_path / "q/projects/x/t.jsonl", row)
    files, usage = fleet.profile_files(spark, [str(tmp_path)]), fleet.profile_usage(spark, [str(tmp_path)])
    for df in (files, usage):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and "text" not in plan and "binaryFile" not in plan
    assert sorted((r.profile.rpartition("/")[2], r.sessions, r.input) for r in fleet.profile_totals(usage, files).collect()) == [("p", 1, 3), ("q", 1, 0)]
