"""Streams give what the batch operators give; sinks are safe to run again."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tallymark.operators import activity, counting
from tallymark.sources import binary, sinks
from tallymark.streaming import incremental as I


def run(df, mode, name, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


@pytest.fixture
def parts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumns({"ts": F.col("ts").cast("timestamp"), "v": F.floor(F.col("value") * 100).cast("long")})
    for i in range(2):
        e.where(F.col("event_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return e, stream


def test_running_totals_match_batch(spark, parts, tmp_path):
    e, stream = parts
    got = run(I.running_totals(stream, "user_id", "v"), "complete", "totals", spark, tmp_path)
    want = counting.max_per_id(e, "user_id", ["v"])
    assert {(r.user_id, r.v) for r in got.collect()} == {(r.user_id, r.v) for r in want.collect()}


def test_sessions_match_batch_up_to_the_watermark(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(I.sessions(stream, "user_id", "ts"), "append", "sess", spark, tmp_path).collect()}
    want = {tuple(r) for r in activity.gap_sessions(e, ["user_id"], "ts").select("user_id", "start_micros", "end_micros", "events").collect()}
    assert got <= want and len(want) - len(got) < 20


def test_credits_sum_to_maxima(spark, parts, tmp_path):
    e, stream = parts
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select((F.col("user_id") % 3).alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("owner"), "v")
    got = run(I.credits(rows), "append", "credits", spark, tmp_path)
    want = counting.max_per_id(e.withColumn("id", F.col("user_id") % 3), "id", ["v"]).agg(F.sum("v")).first()[0]
    assert got.agg(F.sum("credit")).first()[0] == want and got.count() == e.count()


def test_packets(spark):
    df = spark.createDataFrame([('{"v":1,"kind":"hi","machine":"m"}',), ('{"v":2,"kind":"hi","machine":"m"}',), ("junk",), ('{"v":1,"kind":"hi","machine":"' + "m" * 9000 + '"}',)], "value string")
    assert I.valid_packets(df).count() == 1


def test_ledger_appends_once(spark, tmp_path):
    scan = spark.createDataFrame([("c", "s", "v", 1, 10), ("c", "s", "v", 2, 12)], "cli string, session_id string, version string, pos int, total long")
    path = str(tmp_path / "ledger")
    assert sinks.append_ledger(scan, path) == 2
    assert sinks.append_ledger(scan, path) == 0
    assert sinks.read_ledger(spark, path).count() == 2


def test_snapshots_never_shrink(spark, tmp_path):
    path, schema = str(tmp_path / "snap"), "month string, host string, volume long"
    sinks.write_snapshots(spark.createDataFrame([("2026-01", "h", 18), ("2025-12", "h", 4)], schema), path, ["volume"])
    sinks.write_snapshots(spark.createDataFrame([("2026-01", "h", 3), ("2026-01", "g", 5)], schema), path, ["volume"])
    rows = sinks.read_snapshots(spark, path).collect()
    assert {(r.month, r.host, r.volume) for r in rows} == {("2026-01", "h", 18), ("2026-01", "g", 5), ("2025-12", "h", 4)}


def test_machine_folder_is_gated(spark, tmp_path):
    acc = spark.createDataFrame([("a", 10)], "account string, total long")
    good = spark.createDataFrame([("a", 4), ("a", 6)], "account string, total long")
    sinks.write_machine_folder(good, acc, good, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        sinks.write_machine_folder(good.limit(1), acc, good, str(tmp_path / "n"))


def test_archive_keeps_changes_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "arch")
    assert sinks.archive(df, path, "1", []) and not sinks.archive(df.orderBy(F.desc("x")), path, "2", []) and sinks.archive(df.limit(1), path, "3", [])


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_sqlite_and_protobuf(spark, tmp_path):
    usage = field(2, 100) + field(3, 30) + field(5, 40) + field(9, 20) + field(10, 10) + field(11, b"req-1")
    blob = field(1, b"text that is no message") + field(9, usage) + field(9, usage)
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("create table steps (metadata blob)")
    con.executemany("insert into steps values (?)", [(blob,), (None,)])
    con.commit()
    con.close()
    (tmp_path / "bad.db").write_bytes(b"no database")
    rows = binary.sqlite_column(spark, [str(tmp_path)], "steps", "metadata")
    assert sorted(r.readable for r in rows.collect()) == [False, True, True]
    (r,) = binary.blob_usage(rows, "path", "value").collect()
    assert (r.request, r.input, r.output, r.cache_read) == ("req-1", 100, 30, 40)
    assert binary.fields(b"\xff\xff") is None


def test_decrypt(spark):
    key = "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([("secret",)], "t string").select(F.aes_encrypt("t", F.lit(key), F.lit("GCM")).alias("c"))
    (r,) = df.select(binary.decrypted(F.col("c"), F.lit(key)).cast("string").alias("ok"), binary.decrypted(F.lit(b"junk"), F.lit(key)).alias("bad")).collect()
    assert r.ok == "secret" and r.bad is None
