"""Hand-checkable logs of every tool."""

import json

from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import rollup
from tallymark.session import kept
from tallymark.sources import providers as P
from tallymark.sources import transcripts as S


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def usage(**k):
    return k


def assistant(ts, mid, out, **extra):
    return {"type": "assistant", "timestamp": ts, "message": {"id": mid, "model": extra.pop("model", "claude-x"), "usage": {"input_tokens": 10, "output_tokens": out}, "content": extra.pop("content", [])}} | extra


def test_messages_count_their_maximum_and_junk_costs_a_line(spark, tmp_path):
    write(
        tmp_path / "p/projects/-home-me-code-app/s1.jsonl",
        {"type": "user", "timestamp": "2026-01-01T10:00:00Z", "sessionId": "A", "cwd": "/home/me/code/app", "message": {"content": "please do it"}},
        "null",
        "[1]",
        "not json",
        {"type": "user", "timestamp": 5, "message": {"content": "no string stamp"}},
        assistant("2026-01-01T10:01:00Z", "m1", 5, content=[{"type": "tool_use", "name": "Edit", "input": {"file_path": "/a.py"}}]),
        assistant("2026-01-01T10:01:30Z", "m1", 50),
        assistant("2026-01-01T10:40:00Z", "m1", 20),
        {"type": "user", "timestamp": "2026-01-01T10:41:00Z", "message": {"content": [{"type": "tool_result"}]}},
    )
    e = S.message_events(spark, [str(tmp_path)])
    (r,) = S.sessions(e).collect()
    assert (r.session_id, r.events, r.turns, r.tool_calls, r.input, r.output, r.project, r.model) == ("A", 5, 1, 1, 10, 50, "code/app", "claude-x")
    # 10:00 -> 10:01 -> 10:40 (39 minutes count 15) -> 10:41
    assert r.active_minutes == 1 + 15 + 1


def test_fallback_id_synthetic_models_and_exclusion(spark, tmp_path):
    write(tmp_path / "projects/-x-secret/abc.jsonl", assistant("2026-01-01T10:00:00Z", "m", 1, model="<synthetic>", cwd="/x/secret/deep"))
    (r,) = S.sessions(S.message_events(spark, [str(tmp_path)], exclude=["SECRET"])).collect()
    assert (r.session_id, r.model, r.project) == ("-x-secret/abc", None, "[excluded]")


def test_uuid_first_wins(spark, tmp_path):
    for d in ("a", "b"):
        write(tmp_path / d / "projects/-p/x.jsonl", assistant("2026-01-01T10:00:00Z", "m", 7, uuid="u1"), assistant("2026-01-01T10:00:01Z", "m2", 7))
    e = S.first_sights(S.message_events(spark, [str(tmp_path)]))
    assert e.count() == 3  # one of the copied uuid, both without


def test_rollout_counters_are_cumulative(spark, tmp_path):
    t = lambda i, c, o: {"type": "event_msg", "timestamp": "2026-01-01T10:00:00Z", "payload": {"info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c} | ({"output_tokens": o} if o else {})}}}
    write(
        tmp_path / "r.jsonl",
        {"type": "session_meta", "timestamp": "2026-01-01T09:59:00Z", "payload": {"id": "S", "model": "gpt-5", "cwd": "/a/b/c"}},
        t(100, 40, 10),
        t(300, 100, 30),
        t(500, 200, None),
        {"type": "response_item", "timestamp": "2026-01-01T10:00:00Z", "payload": {"type": "local_shell_call"}},
        {"type": "response_item", "timestamp": "2026-01-01T10:00:00Z", "payload": {"type": "message", "role": "user"}},
    )
    (r,) = S.rollout_sessions(S.rollout_events(spark, [str(tmp_path)])).collect()
    assert (r.session_id, r.input, r.cache_read, r.output, r.turns, r.tool_calls, r.model) == ("S", 300, 200, 30, 1, 1, "gpt-5")


def test_gemini(spark, tmp_path):
    tok = lambda **k: {"timestamp": "2026-01-02T00:00:00Z", "model": "gemini-2", "tokens": k}
    write(tmp_path / "1.json", {"sessionId": "s1", "messages": [tok(input=100, cached=40, output=20, thoughts=5, tool=3), {"model": "x"}]})
    write(tmp_path / "2.jsonl", {"sessionId": "s1", "messages": [tok(input=50, cached=50, output=10)]})
    write(tmp_path / "loose.jsonl", tok(input=10, output=2))
    r = {x.session_id: x for x in P.gemini(spark, [str(tmp_path)]).collect()}
    assert len(r) == 2 and r["s1"].turns == 2
    assert [sum(getattr(x, c) for x in r.values()) for c in ("input", "cache_read", "output")] == [73, 90, 37]
    twice = P.union({"gemini": P.gemini(spark, [str(tmp_path), str(tmp_path)])})
    assert twice.count() == 2


def test_copied_profile_counts_once(spark, tmp_path):
    doc = {"sessionId": "s", "messages": [{"tokens": {"input": 100}}]}
    write(tmp_path / "a/1.json", doc)
    write(tmp_path / "b/1.json", doc)
    (r,) = P.union({"gemini": P.gemini(spark, [str(tmp_path / "a"), str(tmp_path / "b")])}).collect()
    assert r.input == 100


def test_copilot(spark, tmp_path):
    shut = {"type": "session.shutdown", "timestamp": "2026-01-01T00:00:00Z", "data": {"modelMetrics": {"claude-sonnet-4.5": {"usage": {"inputTokens": 1000, "outputTokens": 200, "reasoningTokens": 50, "cacheReadTokens": 400, "cacheWriteTokens": 300}}}}}
    compact = {"type": "session.compaction_complete", "timestamp": "2026-01-01T00:00:00Z", "data": {"compactionTokensUsed": {"input": 100, "output": 20, "cachedInput": 30, "duration": 99999}}}
    write(tmp_path / "sess/events.jsonl", compact, shut)
    write(tmp_path / "flat.jsonl", {"type": "session.shutdown", "timestamp": "2026-01-01T00:00:00Z", "data": {"modelMetrics": {"gpt": {"usage": {"inputTokens": 10, "outputTokens": 5}}}}})
    write(tmp_path / "crashed.jsonl", {"type": "user.message", "timestamp": "2026-01-01T00:00:00Z"})
    r = {x.session_id: x for x in P.copilot(spark, [str(tmp_path)]).collect()}
    assert set(r) == {"sess", "flat"} and r["sess"].model == "claude-sonnet-4.5"
    assert [sum(getattr(x, c) for x in r.values()) for c in ("input", "output", "cache_read", "cache_write")] == [1110, 275, 430, 300]


def test_grok(spark, tmp_path):
    turn = lambda u: {"timestamp": 1767225600, "params": {"update": {"sessionUpdate": "turn_completed", "usage": u}}}
    write(
        tmp_path / "s/updates.jsonl",
        {"timestamp": 1, "params": {"update": {"sessionUpdate": "snapshot", "usage": {"inputTokens": 5}}}},
        turn({"inputTokens": 999, "modelUsage": {"grok-4": {"inputTokens": 300, "cachedReadTokens": 120, "outputTokens": 80}}}),
        turn({"inputTokens": 50, "cachedReadTokens": 10, "outputTokens": 5}),
    )
    (r,) = P.grok(spark, [str(tmp_path)]).collect()
    assert (r.input, r.cache_read, r.output, r.turns, str(r.start)[:4]) == (220, 130, 85, 2, "2026")


def test_kilo(spark, tmp_path):
    ask = lambda **k: {"ts": 1739000000000, "say": "api_req_started", "text": json.dumps(k)}
    write(tmp_path / "task/ui_messages.json", json.dumps([ask(tokensIn=1000, tokensOut=50, cacheReads=600, cacheWrites=200), ask(tokensIn=0, tokensOut=0), {"say": "text"}]))
    write(tmp_path / "task/api_conversation_history.json", "<model>vendor/kimi-k2</model>")
    (r,) = P.kilo(spark, [str(tmp_path)]).collect()
    assert (r.input, r.cache_read, r.cache_write, r.output, r.turns, r.model, str(r.start)[:7]) == (200, 600, 200, 50, 1, "kimi-k2", "2025-02")


def test_kilo_models_are_found_at_any_place(spark, tmp_path):
    """a history is read to its end, also where the model comes after hundreds of thousands of characters."""
    ask = {"ts": 1739000000000, "say": "api_req_started", "text": json.dumps({"tokensIn": 7})}
    for name, before in (("early", 10), ("edge", 399_990), ("late", 2_000_000)):
        write(tmp_path / name / "ui_messages.json", json.dumps([ask]))
        write(tmp_path / name / "api_conversation_history.json", "é" * before + f"<model>vendor/{name}</model> <model>vendor/other</model>")
    assert {r.session_id: r.model for r in P.kilo(spark, [str(tmp_path)]).collect()} == {n: n for n in ("early", "edge", "late")}


def test_stats_counter_ignores_daily_tokens(spark, tmp_path):
    write(tmp_path / "stats-cache.json", {"lastComputedDate": "2026-01-10", "dailyModelTokens": [{"tokens": 7}], "modelUsage": {"a": {"inputTokens": 400, "outputTokens": 100}, "b": {"cacheReadInputTokens": 400, "costUSD": 1.5}}})
    (r,) = P.stats_counter(spark, [str(tmp_path)]).collect()
    assert (r.input, r.output, r.cache_read, r.cache_write, r.last_computed) == (400, 100, 400, 0, "2026-01-10")


def test_rollup_tells_presence_from_usage(spark, tmp_path):
    write(tmp_path / "1.json", {"sessionId": "s", "messages": [{"tokens": {"input": 1}}]})
    used = P.union({"gemini": P.gemini(spark, [str(tmp_path)])})
    there = spark.createDataFrame([("gemini", True), ("grok", True), ("kilo", False)], "cli string, installed boolean")
    assert {r.cli: r.state for r in P.rollup(used, there).collect()} == {"gemini": "used", "grok": "installed, no usage", "kilo": "not installed"}


def test_a_store_is_read_once_for_sums_and_models(spark, tmp_path):
    """F1, F8: of many small files the opening costs most, so sums and models come from one scan, and few tasks list them."""
    from tallymark.sources import lines, providers

    for s in ("a", "b"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "t.jsonl").write_text("".join('{"timestamp": "2026-01-01T00:00:0%dZ", "params": {"update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 5, "outputTokens": 1, "modelUsage": {"m": {"inputTokens": 2}, "n": {"inputTokens": 3}}}}}}\n' % i for i in range(3)))
    before = spark.conf.get(lines.LISTING)
    found = providers.grok(spark, [str(tmp_path)])
    assert spark.conf.get(lines.LISTING) == before
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted((r.session_id, r.turns, r.input, r.model) for r in found.collect()) == [("a", 3, 15, "m"), ("b", 3, 15, "m")]


def _relations(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_copilot_and_kilo_stores_are_read_once(spark, tmp_path):
    """of many small files the opening costs most; logs are read by one scan for each size of file, tasks by one."""
    row = lambda kind, **data: {"type": kind, "timestamp": "2026-01-01T00:00:00Z", "data": data}
    metrics = {m: {"usage": {"inputTokens": n, "outputTokens": 1}} for m, n in (("b", 10), ("a", 10), ("c", 3))}
    write(tmp_path / "log/one.jsonl", row("user.message"), row("session.shutdown", modelMetrics=metrics), row("session.compaction_complete", compactionTokensUsed={"input": 99}))
    write(tmp_path / "log/none.jsonl", row("user.message"), row("session.shutdown", modelMetrics={}))
    logs = P.copilot(spark, [str(tmp_path / "log")])
    assert _relations(logs) == 2
    assert [(r.session_id, r.turns, r.input, r.output, r.model) for r in logs.collect()] == [("one", 1, 122, 3, "a")]
    ask = {"ts": 1739000000000, "say": "api_req_started", "text": json.dumps({"tokensIn": 7})}
    write(tmp_path / "kilo/t/ui_messages.json", json.dumps([ask, {"say": "api_req_started", "text": "{torn"}]))
    write(tmp_path / "kilo/lone/api_conversation_history.json", "<model>m</model>")
    tasks = P.kilo(spark, [str(tmp_path / "kilo")])
    assert _relations(tasks) == 1
    assert [(r.session_id, r.turns, r.input, r.model) for r in tasks.collect()] == [("t", 1, 7, None)]


def test_small_and_large_logs_have_the_same_lines(spark, tmp_path):
    """however a log is read, its lines and their order are the same."""
    from tallymark.sources import lines

    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbfone\r\n\n  \ntwo\rthree \xc3\xa9\n")
    (tmp_path / "b.jsonl").write_text("\n".join(f"row {i}" for i in range(9000)))
    (tmp_path / "empty.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = [[(r.path, r.line) for r in lines.log_lines(spark, [str(tmp_path)], many=many).orderBy("path", "line_no").collect()] for many in (False, True)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] and len(got[0]) == 9003 and got[0][2][1] == "three é"


def test_projects_need_no_whole_sessions(spark, tmp_path):
    """a session's project is one grouping, without its times, votes and credits."""
    row = assistant("2026-01-01T00:00:00Z", "m", 1, sessionId="s", cwd="/home/x/work/a")
    write(tmp_path / "projects/home/log.jsonl", row, row | {"cwd": "/home/x/work/b"}, row | {"sessionId": "t", "cwd": None})
    found = S.distinct_projects(S.message_events(spark, [str(tmp_path)]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
    assert {r.project for r in found.collect()} >= {"work/a"}


def test_only_files_that_lack_an_id_are_scanned_for_it(spark, tmp_path):
    """rows that name their session take no window; shared messages are credited in order, others at their maximum."""
    line = lambda i, sid, ident, n: json.dumps({"type": "assistant", "timestamp": f"2024-01-0{1 + i // 2}T00:{i:02d}:00Z", "message": {"id": ident, "model": "claude-3", "usage": {"input_tokens": n}, "content": [{"type": "tool_use", "name": "Edit", "input": {"path": 7}}, {"type": "text"}, 5]}} | ({"sessionId": sid} if sid else {}))
    (tmp_path / "named.jsonl").write_text("\n".join([line(0, "a", "m", 5), line(1, "b", "m", 3), line(2, "b", "m", 9), line(3, "b", "n", 4), line(4, "b", "n", 2), line(5, "a", None, 1), line(5, "a", None, 1)]))
    named = S.message_events(spark, [str(tmp_path)])
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan, plan
    (tmp_path / "other.jsonl").write_text("\n".join([line(0, None, "x", 1), line(1, "c", "x", 3), line(2, None, "x", 7)]))
    rows = S.message_events(spark, [str(tmp_path)])
    assert sorted(r.session_id.split("/")[-1] for r in rows.collect()) == ["a"] * 3 + ["b"] * 4 + ["c"] * 2 + ["other"]
    got = {r.session_id.split("/")[-1]: r for r in S.sessions(rows).collect()}
    assert {k: (r.input, r.days, r.active_minutes, r.tool_calls, r.model) for k, r in got.items()} == {"a": (7, 2, 15, 3, "claude-3"), "b": (8, 3, 31, 4, "claude-3"), "c": (6, 2, 15, 2, "claude-3"), "other": (1, 1, 1, 1, "claude-3")}
    assert {tuple(t.paths) for r in rows.collect() for t in r.tools} == {("7",)}


def test_labels_of_folders_with_any_separators(spark):
    paths = ["/a//b\\c/", "a/b", "//a", "", "/x/y\n/z", "\\\\h\\s\\d"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(T.project_label(F.col("p")).alias("l"), T.uninformative(F.col("p")).alias("u")).collect()
    assert [r.l for r in got] == ["b/c", "a/b", "//a", None, "y\n/z", "s/d"] and [r.u for r in got] == [False, False, True, True, False, False]


def test_months_look_at_events_once_beside_their_minutes(spark, tmp_path):
    """days, streaks and nights are read off minutes."""
    edit = lambda p: [{"type": "tool_use", "name": "Edit", "input": {"path": p}}]
    write(tmp_path / "s.jsonl", *(assistant(ts, None, 1, sessionId="A", content=edit(p)) for ts, p in [("2026-01-31T23:59:10Z", "/a.py"), ("2026-02-01T02:00:00Z", "/a.py"), ("2026-02-01T02:00:30Z", "/b.rs"), ("2026-02-02T12:00:00Z", "/c")]))
    events = S.message_events(spark, [str(tmp_path)])
    found = rollup.months(events, kept(S.sessions(events), "sessions"))
    assert {r.month: (r.sessions, r.active_days, r.longest_streak_days, r.night_minutes, r.languages, r.tool_calls) for r in found.collect()} == {"2026-01": (1, 1, 1, 0, 2, 4), "2026-02": (0, 2, 2, 1, 0, 0)}
    scans = found._jdf.queryExecution().sparkPlan().toString().count("/tallymark/events-")
    assert scans == 1, scans
