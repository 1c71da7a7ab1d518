"""Streaming counterparts: counts that stay right while rows keep coming.

Each function takes a streaming DataFrame and gives a streaming DataFrame, or
starts a query. The batch operators give the same results on the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymark.operators.activity import micros
from tallymark.operators.ledger import KEY
from tallymark.operators.partials import Kept
from tallymark.sources.sinks import add_to_ledger, read_ledger, write_snapshots

# The worker that sets up a stream's state on the driver does not look into files that were added to the session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_totals(stream: DataFrame, ident: str, counter: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each message's counter at its maximum so far (update mode); with a watermark old messages leave the state."""
    rows = stream.withWatermark(*watermark) if watermark else stream
    return rows.groupBy(ident).agg(F.max(counter).alias(counter), F.count(F.lit(1)).alias("sights"))


def hourly(stream: DataFrame, ts: str, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window of event time, final once the watermark has passed (append mode)."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.unix_micros("w.start").alias("start_micros"), "events")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that a gap closes, given out once they are closed (append mode)."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(micros(ts)).alias("end_micros")).select(key, F.unix_micros("w.start").alias("start_micros"), "end_micros", "events")


def first_sights(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first of equal announcements within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class Credits(StatefulProcessor):
    """State by message id: the greatest counter so far. Gives each raise to the row that brought it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "v long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.best.get()[0] if self.best.exists() else 0
        for frame in rows:
            frame = frame.sort_values("seq")
            top = frame["v"].cummax().clip(lower=best)
            raised = top - top.shift(1, fill_value=best)
            best = max(best, int(top.iloc[-1]))
            yield pd.DataFrame({"owner": frame["owner"], "seq": frame["seq"], "credit": raised.astype("int64")})
        self.best.update((best,))

    def close(self) -> None:
        pass


def credits(stream: DataFrame) -> DataFrame:
    """Raises of running maxima: the stream has id, seq, owner, v (all long). Needs the RocksDB state store."""
    return stream.groupBy("id").transformWithStateInPandas(Credits(), "owner long, seq long, credit long", "append", "none")


class Members(StatefulProcessor):
    """State by machine: joined on its first packet, left after ``quiet_ms`` without one (processing time)."""

    quiet_ms = 15_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(frame) for frame in rows)
        joined = not self.seen.exists()
        before = 0 if joined else self.seen.get()[0]
        self.seen.update((before + n,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        if joined:
            yield pd.DataFrame({"machine": [key[0]], "event": ["join"], "packets": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.clear()
        yield pd.DataFrame({"machine": [key[0]], "event": ["leave"], "packets": [n]})

    def close(self) -> None:
        pass


def valid_packets(stream: DataFrame, most_bytes: int = 8192) -> DataFrame:
    """Packets (column ``value``, JSON) of version 1, a kind, and bounded size, parsed."""
    j = F.from_json("value", "v int, kind string, machine string, label string, sentAt string")
    rows = stream.where(F.octet_length("value") <= most_bytes).select(j.alias("p")).select("p.*")
    return rows.where("v = 1 and kind is not null and machine is not null")


def membership(packets: DataFrame) -> DataFrame:
    """Joins and leaves of machines. Needs the RocksDB state store."""
    return packets.groupBy("machine").transformWithStateInPandas(Members(), "machine string, event string, packets long", "update", "processingTime")


class Raises(StatefulProcessor):
    """State by session and version: the greatest total so far. Gives the rows that exceed it.

    ``ttl_ms`` bounds the state: a key not seen for so long is forgotten, and a
    row of it may be given once more, which changes no maximum.
    """

    def __init__(self, total: int, ttl_ms: int | None = None):
        self.total, self.ttl_ms = total, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "total long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = best = self.best.get()[0] if self.best.exists() else 0
        for row in rows:
            if row[self.total] is not None and row[self.total] > best:
                best = row[self.total]
                yield row
        if best > before or self.ttl_ms:
            self.best.update((best,))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if initialState["total"] is not None and initialState["total"] > 0:
            self.best.update((initialState["total"],))

    def close(self) -> None:
        pass


def exceeding(stream: DataFrame, ledger: DataFrame | None, ttl_ms: int | None = None) -> DataFrame:
    """Rows of a stream of scans whose total exceeds all before them of the same session and version.

    What the ledger has is loaded as state when the stream begins, and not read
    again, so that a batch costs what its own rows cost. Needs the RocksDB state
    store.
    """
    keys = [*KEY, "version"]
    initial = ledger.groupBy(*keys).agg(F.max("total").cast("long").alias("total")).groupBy(*keys) if ledger is not None else None
    raises = Raises(stream.columns.index("total"), ttl_ms)
    return stream.groupBy(*keys).transformWithState(raises, stream.schema, "append", "processingTime" if ttl_ms else "none", initial)


def ledger_sink(stream: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None, every: str = "10 seconds") -> StreamingQuery:
    """Append what exceeds the ledger, batch by batch; a batch that comes again appends nothing.

    It ends when all there is has been read. With ``ttl_ms`` it goes on, a batch
    ``every`` so long, for state can only run out while a query runs.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fresh = exceeding(stream, read_ledger(spark, path), ttl_ms)
    trigger = {"processingTime": every} if ttl_ms else {"availableNow": True}
    step = lambda batch, number: add_to_ledger(batch, path, (checkpoint, number)) and None
    return fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def partials_sink(stream: DataFrame, kept: Kept, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a roll-up up to date: each batch is merged into the parts it touches, and counts once."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        kept.add(batch, (checkpoint, number))
        batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def announced(packets: DataFrame, ts: str, listen: str = "8 seconds") -> DataFrame:
    """Machines heard in each window of listening, a repeated announcement once: window start, machine, packets (append mode)."""
    once = packets.where("kind = 'announce'").withWatermark(ts, listen).dropDuplicates(["machine", "sentAt", ts])
    return once.groupBy(F.window(ts, listen).alias("w"), "machine").agg(F.count(F.lit(1)).alias("packets")).select(F.unix_micros("w.start").alias("start_micros"), "machine", "packets")


def snapshot_sink(stream: DataFrame, path: str, measures: list[str], checkpoint: str) -> StreamingQuery:
    """Keep monthly snapshots up to date with scans that come in: a month never shrinks, a batch that comes again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_snapshots(batch, path, measures, (checkpoint, number))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pushed_folders(spark, folder: str, schema: str) -> DataFrame:
    """Machine documents as they are put into a folder, a JSON document a line or file; those without a usable name are left out.

    The name is the first of folderName, machine and label, made a folder's name.
    """
    from tallymark.functions import text as T

    rows = spark.readStream.schema(f"folderName string, machine string, label string, {schema}").option("recursiveFileLookup", True).json(folder)
    return rows.withColumn("folder", T.slug(F.coalesce("folderName", "machine", "label"))).where("folder is not null")


def rescored(stream: DataFrame, finalise, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """An incremental scan: each batch is kept, and ``finalise`` of all kept so far is written to ``path``.

    ``every`` is the least time between two results, such as ``80 milliseconds``;
    without it all there is is read once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/kept/batch={batch_id}")
        finalise(batch.sparkSession.read.parquet(f"{path}/kept").drop("batch")).write.mode("overwrite").parquet(f"{path}/result")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
