"""Tables of several writers, kept roll-ups, and the ledger of a stream."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.operators import fleet, ledger, partials
from tallymark.operators.partials import Kept, Measure
from tallymark.sources import sinks
from tallymark.sources.commits import Committed, Version
from tallymark.streaming import incremental

SCAN = "cli string, session_id string, version string, pos long, total long"


def test_of_two_writers_the_second_begins_again(spark, tmp_path):
    table = Committed(spark, str(tmp_path / "t"))
    assert table.latest() == Version() and table.read() is None
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    calls = []

    def late(base):
        calls.append(base.number)
        if len(calls) == 1:  # another writer comes first
            assert table.change(lambda b: b.folders + table.stage(one))
        return base.folders + table.stage(two)

    assert table.change(late) and calls == [0, 1]
    assert sorted(r.x for r in table.read().collect()) == [1, 2] and table.latest().number == 2
    assert table.vacuum() == 0  # what the first try wrote is gone
    assert not table.commit(Version(1, []), [], {})


def test_a_tag_counts_once_and_parts_are_replaced(spark, tmp_path):
    table = Committed(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", 1), ("b/c", 2), (None, 3)], "k string, x int")
    assert table.change(lambda b: table.stage(df, by="k"), ("batch", 0)) and not table.change(lambda b: [], ("batch", 0))
    new = spark.createDataFrame([("b/c", 9)], "k string, x int")
    assert table.change(lambda b: b.without("rows", ["b/c"]) + table.stage(new, by="k"), ("batch", 1))
    assert sorted((r.k or "", r.x) for r in table.read().collect()) == [("", 3), ("a", 1), ("b/c", 9)]
    assert [r.x for r in table.read(parts=["b/c"]).collect()] == [9] and table.latest().tags == {"batch": 1}
    staged = table.stage(new)
    assert not table.add(staged, ("batch", 1)) and table.add(table.stage(new), ("batch", 2)) and table.read().count() == 4


def test_two_writers_of_snapshots_ledger_and_log(spark, tmp_path, monkeypatch):
    """Whatever a writer does between another's reading and its commit, nothing of either is lost."""
    between = []
    commit = Committed.commit

    def slow(self, base, folders, tags):
        if between:
            between.pop()()
        return commit(self, base, folders, tags)

    monkeypatch.setattr(Committed, "commit", slow)
    months = lambda *rows: spark.createDataFrame(list(rows), "month string, host string, volume long")
    path = str(tmp_path / "months")
    between.append(lambda: sinks.write_snapshots(months(("2026-01", "a", 7), ("2026-02", "a", 1)), path, ["volume"]))
    sinks.write_snapshots(months(("2026-01", "b", 3), ("2026-01", "a", 5)), path, ["volume"])
    assert {(r.month, r.host, r.volume) for r in sinks.read_snapshots(spark, path).collect()} == {("2026-01", "a", 7), ("2026-01", "b", 3), ("2026-02", "a", 1)}

    path, scan = str(tmp_path / "ledger"), spark.createDataFrame([("c", "s", "v", 1, 10), ("c", "s", "v", 2, 12)], SCAN)
    between.append(lambda: sinks.append_ledger(scan, path))
    assert sinks.append_ledger(scan, path) == 0 and sinks.read_ledger(spark, path).count() == 2

    path, run = str(tmp_path / "runs"), spark.createDataFrame([("x",)], "argv string")
    sinks.append_run(run, path, "1")
    between.append(lambda: sinks.append_run(run, path, "2"))
    assert sinks.append_run(run, path, "3") == 2 and sinks.run_breaks(spark, path).count() == 0


def scans_of(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["c", "d", None]), rng.choice(["s", "t", "u", None]), f"v{i // 100}", i, rng.choice([None, 0, rng.randint(1, 90)])) for i in range(n)]


def test_compaction_changes_nothing_that_the_ledger_says(spark, tmp_path):
    rows = spark.createDataFrame(scans_of(1), SCAN)
    path = str(tmp_path / "ledger")
    sinks.append_ledger(rows.where("pos < 150"), path)
    sinks.append_ledger(rows.where("pos >= 150"), path)
    before = sinks.read_ledger(spark, path)
    said, n = sorted(map(tuple, ledger.lifetime(before, ["total"]).collect()), key=str), before.count()
    assert sinks.compact_ledger(spark, path)
    after = sinks.read_ledger(spark, path)
    assert sorted(map(tuple, ledger.lifetime(after, ["total"]).collect()), key=str) == said and after.count() < n
    assert after.count() == after.select("cli", "session_id", "version").distinct().count()
    assert sinks.append_ledger(rows, path) == 0 or sinks.compact_ledger(spark, path)
    assert not sinks.compact_ledger(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("ttl_ms", [None, 60_000])
def test_a_stream_knows_the_ledger_without_reading_it(spark, tmp_path, ttl_ms):
    known = [r for r in scans_of(2) if r[0] and r[1]]
    rows = spark.createDataFrame(known, SCAN)
    path, source = str(tmp_path / "ledger"), str(tmp_path / "in")
    sinks.append_ledger(rows.where("pos % 3 = 0"), path)
    for part in range(3):
        rows.where(F.floor(F.col("pos") / 100) == part).coalesce(1).write.parquet(f"{source}/p{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)

    def through(at):
        query = incremental.ledger_sink(stream, path, str(tmp_path / at), ttl_ms, "1 second")
        until = time.time() + 90
        while query.isActive and time.time() < until and (not ttl_ms or sum(p["numInputRows"] for p in query.recentProgress) < len(known)):
            time.sleep(0.5)
        progress = query.recentProgress
        query.stop()
        return progress

    progress = through("at")
    batches = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert len(batches) == 3 and sum(batches) == rows.count()
    got = sinks.read_ledger(spark, path)
    want = defaultdict(int)
    for cli, session, version, _, total in rows.collect():
        want[cli, session, version] = max(want[cli, session, version], total or 0)
    assert {tuple(r)[:3]: r.total for r in got.groupBy("cli", "session_id", "version").agg(F.max("total").alias("total")).collect()} == {k: v for k, v in want.items() if v}
    # Again from the beginning, with another checkpoint: the state is the ledger's, so nothing is new.
    n = got.count()
    through("again")
    assert sinks.read_ledger(spark, path).count() == n


MEASURES = {"volume": Measure("sum", "v"), "n": Measure("count", "v"), "most": Measure("max", "v"), "least": Measure("min", "v"), "names": Measure("set", "name"), "about": Measure("sketch", "name")}


def test_a_kept_roll_up_equals_the_full_one_after_every_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["m1", "m2", "m3", None]), rng.choice(["h", "i"]), rng.choice([None, *range(-9, 99)]), rng.choice([None, *"abcdefgh"])) for _ in range(240)]
    kept = Kept(spark, str(tmp_path / "kept"), ["month", "host"], "month", MEASURES)
    assert kept.result() is None and not kept.add(spark.createDataFrame([], "month string, host string, v long, name string"))
    for batch in range(3):
        part = rows[batch * 80 : batch * 80 + 80]
        part = [r for r in part if r[0] != "m2"] if batch == 1 else part
        rows[batch * 80 : batch * 80 + 80] = part + [part[0]] * (80 - len(part))
        df = spark.createDataFrame(rows[batch * 80 : batch * 80 + 80], "month string, host string, v long, name string")
        assert kept.add(df, ("scan", batch)) and not kept.add(df, ("scan", batch))
        seen = spark.createDataFrame(rows[: batch * 80 + 80], df.schema)
        for keys in (["month", "host"], ["host"], []):
            got = kept.result(keys)
            group = seen.groupBy(*keys)
            want = group.agg(F.count("*").alias("n_rows"), F.sum("v").alias("volume"), F.count("v").alias("n"), F.max("v").alias("most"), F.min("v").alias("least"), F.count_distinct("name").alias("names"))
            assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
            assert got.where("about <> names").count() == 0  # few values: a sketch is exact
    table = kept.table
    assert len({f["folder"] for f in table.latest().folders if f["part"] == "m2" and f["name"] == "numbers"}) == 1


def test_only_touched_parts_are_written_anew(spark, tmp_path):
    kept = Kept(spark, str(tmp_path / "kept"), ["month", "host"], "month", MEASURES)
    schema = "month string, host string, v long, name string"
    kept.add(spark.createDataFrame([(f"m{i}", "h", i, "x") for i in range(6)], schema))
    before = {(f["name"], f["part"]): f["folder"] for f in kept.table.latest().folders}
    kept.add(spark.createDataFrame([("m3", "h", 1, "y"), ("new", "h", 1, "y")], schema))
    after = {(f["name"], f["part"]): f["folder"] for f in kept.table.latest().folders}
    assert {k for k in after if after[k] != before.get(k)} == {(n, p) for n in ("numbers", "members") for p in ("m3", "new")}


def test_a_stream_keeps_a_roll_up(spark, tmp_path):
    schema, source = "month string, host string, v long, name string", str(tmp_path / "in")
    df = spark.createDataFrame([(f"m{i % 4}", f"h{i % 3}", i, f"n{i % 7}") for i in range(90)], schema)
    for part in range(3):
        df.where(F.col("v") % 3 == part).coalesce(1).write.json(f"{source}/p{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(source)
    kept = Kept(spark, str(tmp_path / "kept"), ["month", "host"], "month", MEASURES)
    incremental.partials_sink(stream, kept, str(tmp_path / "at")).awaitTermination(180)
    got = {(r.month, r.host): (r.n_rows, r.volume, r.names) for r in kept.result().collect()}
    want = df.groupBy("month", "host").agg(F.count("*"), F.sum("v"), F.count_distinct("name")).collect()
    assert got == {(r[0], r[1]): (r[2], r[3], r[4]) for r in want}


def test_sketches_of_machines_add_up_to_the_fleet(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(f"2026-{1 + i % 12:02d}", f"m{i % 9}", rng.randint(0, 6000), 1) for i in range(20_000)], "month string, machine string, project long, tokens long")
    measures = {"project": Measure("sketch", F.col("project"), 13), "tokens": Measure("sum", F.col("tokens"))}
    by_month = partials.numbers(rows, ["month", "machine"], measures)
    exact = fleet.distinct_over(rows, ["project"], ["tokens"]).first()
    got = partials.finished(by_month, None, [], measures).first()
    assert got["tokens"] == exact["tokens"] and abs(got["project"] - exact["n_project"]) <= 4 * partials.standard_error(13) * exact["n_project"]
    assert partials.finished(by_month.limit(0), None, ["month"], measures).count() == 0
