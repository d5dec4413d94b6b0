"""Streams: state that stays bounded, restarts, out-of-order batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lumenlake.operators.history import recent_searches
from lumenlake.streaming import history as history_stream

SEARCHES = "user_id long, text string, ts timestamp_ntz, event_id long"
START = dt.datetime(2024, 1, 1)


def test_state_history_equals_batch_after_restarts(spark, tmp_path):
    draw = random.Random(1)
    words = ["Cat", "cat", "CAT ", " dog", "Dog", "Straße", "STRASSE", "bird", "fish", "", "  ", None, "ant", "bee"]
    rows = [(draw.choice([None, 0, 1, 2, 3]), draw.choice(words), START + dt.timedelta(seconds=draw.randrange(50)), i) for i in range(400)]
    draw.shuffle(rows)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for end in (200, 400):
        spark.createDataFrame(rows[end - 200:end], SEARCHES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SEARCHES).parquet(f"{tmp_path}/in")
        history_stream.start_state_history(stream, f"{tmp_path}/state", keep=4).awaitTermination()
        got = history_stream.state_history(spark, f"{tmp_path}/state")
        want = recent_searches(spark.createDataFrame(rows[:end], SEARCHES), keep=4).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    # What the state holds does not depend on the length of the stream.
    state = spark.read.format("statestore").option("stateVarName", "spellings").load(f"{tmp_path}/state")
    assert state.groupBy("key").count().agg(F.max("count")).first()[0] == 4


def test_state_history_leaves_out_rows_without_text_time_or_id(spark, tmp_path):
    rows = [(1, None, START, 1), (1, " ", START, 2), (1, "a", None, 3), (1, "b", START, None), (1, "c", START, 5)]
    spark.createDataFrame(rows, SEARCHES).write.parquet(f"{tmp_path}/in")
    history_stream.start_state_history(spark.readStream.schema(SEARCHES).parquet(f"{tmp_path}/in"), f"{tmp_path}/state").awaitTermination()
    assert [r["text"] for r in history_stream.state_history(spark, f"{tmp_path}/state").collect()] == ["c"]
