"""Prefix scans in segments give what one window gives, and no task holds a part."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.operators import counting, scans
from tallymark.sources import transcripts

SCHEMA = "part string, segment int, pos int, v long"


def some(seed, n=400):
    """One part with most rows, one with few, a null part, nulls in between and in front."""
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "a", "b", None]), i // 37, i, rng.choice([None, rng.randint(-50, 50)])) for i in range(n)]


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_equals_one_window(spark, seed, inclusive):
    df = spark.createDataFrame(some(seed), SCHEMA).repartition(5)
    w = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumns({"last": F.last("v", ignorenulls=True).over(w), "max": F.max("v").over(w), "min": F.min("v").over(w), "sum": F.sum("v").over(w)})
    got = scans.prefix_scan(df, ["part"], ["segment"], ["pos"], {k: (k, F.col("v")) for k in ("last", "max", "min", "sum")}, inclusive)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r.pos) == sorted(want.collect(), key=lambda r: r.pos)
    assert scans.prefix_scan(df.limit(0), ["part"], ["segment"], ["pos"], {"x": ("max", F.col("v"))}).count() == 0


def test_no_window_takes_a_part(spark):
    df = scans.even_segments(spark.range(10_000).select(F.concat(F.lit("one"), F.col("id") % 1).alias("part"), F.col("id").alias("pos"), F.col("id").alias("v")), "pos", pieces=50)
    sizes = [r["count"] for r in df.groupBy("part", "segment").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 500
    out = scans.prefix_scan(df, ["part"], ["segment"], ["pos"], {"total": ("sum", F.col("v"))})
    assert out.where("total <> pos * (pos + 1) / 2").count() == 0
    # Every window over rows is by part and segment; only the one over outcomes is by part.
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert sorted(x.partition("windowspecdefinition")[2].partition(" ASC")[0].count("#") for x in windows) == [2, 3]


def test_even_segments_rise_with_the_order(spark):
    df = spark.createDataFrame([(i * i,) for i in range(-20, 90)], "pos long")
    rows = sorted((r.pos, r.segment) for r in scans.even_segments(df, "pos", pieces=7).collect())
    assert [s for _, s in rows] == sorted(s for _, s in rows) and {s for _, s in rows} <= set(range(7))
    assert scans.even_segments(df.limit(0), "pos").count() == 0


def test_a_burst_makes_more_segments_not_a_larger_one(spark):
    df = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.col("id") * 1000).otherwise(4_000_000 + F.col("id") % 3).alias("at"), F.col("id").alias("nth"))
    cut = scans.even_segments(df, "at", "nth", pieces=20)
    assert max(r["count"] for r in cut.groupBy("segment").count().collect()) < 1000
    rows = sorted((r.at, r.nth, r.segment) for r in cut.collect())
    assert [s for *_, s in rows] == sorted(s for *_, s in rows)


def test_credits_of_one_hot_message(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["x", None]), i // 50, i, rng.choice([None, rng.randint(-3, 400)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, segment int, pos int, v long")
    plain = counting.running_credits(df, "id", ["pos"], ["v"])
    cut = counting.running_credits(df, "id", ["pos"], ["v"], ["segment"])
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
    assert cut.columns == df.columns


def test_rows_without_identity_stay_apart_in_one_scan(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 1, 5), ("a", 2, 3), ("a", 3, -1)], "id string, pos int, v long")
    assert sorted((r.id or "", r.v) for r in counting.max_per_id(df, "id", ["v"]).collect()) == [("", 5), ("", 5), ("a", 3)]
    assert sorted((r.id or "", r.pos) for r in counting.first_wins(df, "id", F.col("pos")).collect()) == [("", 1), ("", 1), ("a", 2)]
    for out in (counting.max_per_id(df, "id", ["v"]), counting.first_wins(df, "id", F.col("pos")), counting.running_credits(df, "id", ["pos"], ["v"])):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_one_file_is_many_tasks(spark, tmp_path):
    """Ids, stated now and then, are filled across splits of one file; junk and untimed rows change nothing."""
    rng = random.Random(9)
    lines, want, session = [], [], None
    for i in range(3000):
        kind = rng.random()
        if kind < 0.01:
            lines.append("{junk")
            continue
        row = {"timestamp": f"2026-02-03T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z", "type": "assistant", "cwd": "/home/x/work/p", "message": {"id": f"m{i // 700}", "model": "claude-x", "usage": {"input_tokens": rng.randint(0, 9000), "output_tokens": i}}}
        if kind < 0.02:
            lines.append(json.dumps(row | {"timestamp": 5, "sessionId": "never"}))
            continue
        if kind < 0.04:
            session = f"s{rng.randint(0, 9)}"
            row["sessionId"] = session
        lines.append(json.dumps(row))
        want.append((session or "home/log", row["message"]["id"], row["message"]["usage"]["input_tokens"]))
    folder = tmp_path / "projects" / "home"
    folder.mkdir(parents=True)
    (folder / "log.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        read = transcripts.message_events(spark, [str(tmp_path)])
        got = [(r.session_id, r.msg_id, r.input) for r in read.orderBy("split", "line_no").collect()]
        assert read.select("split").distinct().count() > 10
        assert got == want
        tokens, best = {}, {}
        for session, message, v in want:
            tokens[session] = tokens.get(session, 0) + max(0, v - best.get(message, 0))
            best[message] = max(best.get(message, 0), v)
        assert {r.session_id: r.input for r in transcripts.usage_by_session(read).collect()} == tokens
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_rollout_file_is_many_tasks(spark, tmp_path):
    meta = lambda i, model: json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": i, "model": model, "cwd": "/w"}})
    count = lambda k: json.dumps({"timestamp": "2026-01-01T00:00:01Z", "type": "event_msg", "payload": {"info": {"total_token_usage": {"input_tokens": k, "cached_input_tokens": 0, "output_tokens": k}}}})
    rows = [meta("a", "gpt-5"), *map(count, range(1, 900)), meta("b", None), *map(count, range(1, 700))]
    (tmp_path / "r.jsonl").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        out = {r.session_id: (r.model, r.input, r.output) for r in transcripts.rollout_sessions(transcripts.rollout_events(spark, [str(tmp_path)])).collect()}
        assert out == {"a": ("gpt-5", 899, 899), "b": (None, 699, 699)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
