"""Incremental ingest: roll-ups of arriving rows, first-wins dedup, record shards.

State is bounded by time: a roll-up's by its watermark, a name's by how long it
is remembered.  What a sink already holds decides beyond that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from ..schemas import RECORD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def monthly(stream: DataFrame, keys: list[str], ts: str, now: str | None = None) -> DataFrame:
    """Rows and sum by key and calendar month; state is one row a group.
    T6: with `now` ('yyyy-MM') rows of later months are clocks gone wrong and go."""
    ym = F.date_format(ts, "yyyy-MM")
    rows = stream if now is None else stream.where(ym <= now)
    return rows.groupBy(*keys, ym.alias("ym")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def dedup(stream: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """A key within the watermark arrives once."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def shards(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """Records of shards as they appear in a folder, so many files a batch;
    a batch that is not done holds back the next.  A file is read once, so shards
    must appear whole: sinks.write_records renames them when they are."""
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "records-*.jsonl").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.where(~(F.col("_corrupt").isNotNull() & F.col("name").isNull() & F.col("provider").isNull()))


def first_records(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """A provider and name once within `delay` of its first arrival, in
    whatever batches it comes; missing ones are a value.  State is a row for each
    name of that time; append_new keeps out what came before it."""
    key = lambda c: F.coalesce(F.col(c), F.lit("None")).alias(c)
    rows = stream.withColumns({"_provider": key("provider"), "_name": key("name"), "_arrived": F.current_timestamp()})
    return rows.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["_provider", "_name"]).drop("_provider", "_name", "_arrived")


class First(StatefulProcessor):
    """The first row of a key, by `order` within a batch; a timer lets the key be forgotten."""

    def __init__(self, order: list[str], ts: str, ttl: int) -> None:
        self.order, self.ts, self.ttl = order, ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]))

    def remember(self, row: pd.DataFrame) -> None:
        self.seen.update((True,))
        self.handle.registerTimer(int(row[self.ts].iloc[0].timestamp() * 1000) + self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.seen.exists(), None
        for some in rows:
            if not known:
                best = pd.concat([x for x in (best, some) if x is not None]).sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.remember(best)
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.remember(initialState)

    def close(self) -> None:
        pass


def first_of(stream: DataFrame, keys: list[str], order: list[str], ts: str, ttl_s: float, delay: str = "0 seconds", known: DataFrame | None = None) -> DataFrame:
    """The first row of each key as rows arrive, of one batch by `order`.

    A key is remembered, in RocksDB beside the executors, until the watermark
    (the latest ts less delay) is ttl_s seconds past its row's ts, so state holds
    the keys of that time only.  Rows that are not later than the watermark when
    they arrive do not come, nor do rows of keys in `known` (key and ts of what was
    written before the query first began).  Columns go through Arrow, so they
    should be few."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seeds = None if known is None else known.groupBy(*keys).agg(F.max(ts).alias(ts)).groupBy(*keys)
    return stream.withWatermark(ts, delay).groupBy(*keys).transformWithStateInPandas(First(order, ts, int(ttl_s * 1000)), stream.schema, "Append", "EventTime", seeds)


def daily(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Rows and sum by key and day, as updates of the days that a batch has
    changed; a day's state goes once the watermark is past it.  Days are those of UTC."""
    day = F.window(ts, "1 day").alias("_w")
    return stream.withWatermark(ts, delay).groupBy(*keys, day).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.to_date("_w.start").alias("day"), "n", "total")


def append_updates(updates: DataFrame, folder: str, checkpoint: str) -> list[dict]:
    """Everything that is there now, each batch's updates under its number, so
    that a batch that is done again replaces what it wrote; a folder is one
    checkpoint's.  What a query reports of its batches is returned."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    q = updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """What append_updates wrote, of each key the last update."""
    rows = spark.read.parquet(folder)
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch"))), "batch")
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def append_new(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> None:
    """Everything that is there now, appended to a Parquet folder but for rows
    whose key it already holds; a batch that is done again replaces what it wrote.
    Batches are numbered within their checkpoint, so a new one replaces nothing."""
    query = "q" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        try:
            done = spark.read.parquet(folder).where((F.col("query") != query) | (F.col("batch") != batch)).select(*(F.col(k).alias(f"_{k}") for k in keys))
        except AnalysisException as e:  # nothing is written yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            rows = rows.join(done, same, "left_anti")
        rows.write.mode("overwrite").parquet(f"{folder}/query={query}/batch={batch}")

    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def month_guard(ym: Column, floor: str, now: str) -> Column:
    """A month from the floor to the present."""
    return ym.between(floor, now)


def run_available(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, into a table of this name in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def append_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Everything that is there now, appended to a Parquet folder; a second run
    with the same checkpoint takes up where this one ended."""
    stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
