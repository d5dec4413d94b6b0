"""Recent searches kept up from a search stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenlake.functions.text import casefold, strip
from lumenlake.operators.history import MAX_STORED, recent_searches
from lumenlake.session import ship_package

DELTA_FIELDS = "user_id long, position int, text string, ts timestamp_ntz, event_id long"


def start_history(searches: DataFrame, target: str, keep: int = MAX_STORED, available_now: bool = True) -> StreamingQuery:
    """Write each batch's own recent searches per user to a folder of the batch number.

    A search outside the newest `keep` of its batch has `keep` newer ones and can
    never come back, so the batch results are all that is needed, in any order of
    arrival. Repeating a batch overwrites its folder with the same rows.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        recent_searches(batch, keep=keep).write.mode("overwrite").parquet(f"{target}/deltas/batch_{number}")

    writer = searches.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{target}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_history(spark: SparkSession, target: str, keep: int = MAX_STORED, fields: str = DELTA_FIELDS) -> DataFrame:
    """Current recent searches per user, merged from the batch results."""
    deltas = spark.read.schema(fields).option("recursiveFileLookup", True).parquet(f"{target}/deltas")
    return recent_searches(deltas, keep=keep)


def compact_history(spark: SparkSession, target: str, new_target: str, keep: int = MAX_STORED) -> None:
    """Write the merged history as the first delta of a new folder."""
    stored_history(spark, target, keep).write.mode("overwrite").parquet(f"{new_target}/deltas/merged")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SPELLINGS = "spellings"


class _Spellings(StatefulProcessor):
    """Newest spelling of each search of one user, at most `keep` of them."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState(_SPELLINGS, "key string", "text string, ts timestamp_ntz, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = {k[0]: (ts, event, text) for k, (text, ts, event) in self.kept.iterator()}
        now = dict(old)
        for batch in rows:
            for name, text, ts, event in zip(batch["key"], batch["text"], batch["ts"], batch["event_id"]):
                row = (ts.to_pydatetime(), int(event), text)
                if name not in now or now[name] < row:
                    now[name] = row
            if len(now) > 2 * self.keep:
                now = self._newest(now)
        now = self._newest(now)
        for name in old.keys() - now.keys():
            self.kept.removeKey((name,))
        for name, row in now.items():
            if old.get(name) != row:
                self.kept.updateValue((name,), (row[2], row[0], row[1]))
        return iter(())

    def _newest(self, rows: dict) -> dict:
        return dict(sorted(rows.items(), key=lambda item: item[1], reverse=True)[: self.keep])

    def close(self) -> None:
        pass


def _combine(user: str, keep: int):
    """Newest spelling per user and search, and the newest `keep` per user, of each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            newest = batch.sort_values(["ts", "event_id", "text"], ascending=False).drop_duplicates([user, "key"])
            yield newest.groupby(user, sort=False, dropna=False).head(keep)

    return run


def start_state_history(
    searches: DataFrame, checkpoint: str, keep: int = MAX_STORED, user: str = "user_id", available_now: bool = True
) -> StreamingQuery:
    """Keep the recent searches of each user as state of the stream: at most `keep` spellings, whatever its length.

    A spelling outside the newest `keep` of its user has `keep` newer ones and can never
    come back, so it leaves the state, in any order of arrival. Equal times are ordered
    by `event_id`. A user with very many searches is combined before the shuffle, Arrow
    batch by Arrow batch. Blank searches and those without a time or an event id are left
    out. A restart goes on from `checkpoint`, which must be a folder every executor
    reaches; `state_history` reads the result from there, no other table is written.
    """
    spark = searches.sparkSession
    ship_package(spark)
    cleaned = (
        searches.withColumn("text", strip("text")).where("text <> '' AND ts IS NOT NULL AND event_id IS NOT NULL")
        .select(user, casefold("text").alias("key"), "text", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    )
    kept = cleaned.mapInPandas(_combine(user, keep), cleaned.schema).groupBy(user).transformWithStateInPandas(
        _Spellings(keep), outputStructType=f"{user} string", outputMode="Update", timeMode="None")
    writer = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    # A query takes the settings of its session as they are when it starts.
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def state_history(spark: SparkSession, checkpoint: str, user: str = "user_id") -> DataFrame:
    """(user, position, text, ts, event_id) as of the last finished batch of `start_state_history`, newest first."""
    state = spark.read.format("statestore").option("stateVarName", _SPELLINGS).load(checkpoint)
    rows = state.select(f"key.{user}", "user_map_value.*")
    newest = Window.partitionBy(user).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return rows.withColumn("position", F.row_number().over(newest)).select(user, "position", "text", "ts", "event_id")
