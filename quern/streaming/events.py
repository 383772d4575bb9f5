"""Structured Streaming: incremental file sources, usage counters, deduplication, windows with late data."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files: int | None = 100) -> DataFrame:
    """New Parquet files of a folder or path pattern, at most `files` a trigger; None: all that are there."""
    rows = spark.readStream.schema(schema)
    return (rows if files is None else rows.option("maxFilesPerTrigger", files)).parquet(path)


def usage_counters(events: DataFrame) -> DataFrame:
    """n and value of each event type, as a running aggregation."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


def without_repeats(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: state of older keys is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and event type; rows later than the watermark are dropped once their window is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_once(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there to a Parquet folder and ends; the checkpoint remembers what was read.

    Complete results replace one another; updates are appended with their `batch`, and the last of a key holds.
    """
    if mode == "append":
        df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return

    def write(rows: DataFrame, batch: int) -> None:
        if mode == "complete":
            rows.write.mode("overwrite").parquet(sink)
        else:
            rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(sink)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def lasting_boosts(events: DataFrame, hours: float = 24.0) -> DataFrame:
    """node_id, boost of events (node_id, boost, ts) with a watermark on ts: the sum of a node's boosts of the last hours.

    A node's state holds its boosts that still last, and goes when the last of them has.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "boost": [0.0]})
            return
        times, sizes = state.get if state.exists else ([], [])
        for b in batches:
            times, sizes = times + [t.timestamp() for t in b["ts"]], sizes + b["boost"].tolist()
        newest = max(times)
        kept = [(t, s) for t, s in zip(times, sizes, strict=True) if t > newest - hours * 3600]
        state.update(([t for t, _ in kept], [s for _, s in kept]))
        ends = int((max(t for t, _ in kept) + hours * 3600) * 1000)
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"node_id": [key[0]], "boost": [round(sum(s for _, s in kept), 6)]})

    return events.groupBy("node_id").applyInPandasWithState(run, "node_id long, boost double", "times array<double>, sizes array<double>", "update", GroupStateTimeout.EventTimeTimeout)


#: Settings of a session that runs last_turns(): lists with a time to live need this store, and a run that ends when all is read must
#: not wait for their ends in batches without rows.
KEEPING = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextlib.contextmanager
def keeping(spark: SparkSession) -> Iterator[None]:
    """The settings of KEEPING while streams are started within it, then those of before."""
    before = {k: spark.conf.get(k) for k in KEEPING}
    for k, v in KEEPING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def last_turns(turns: DataFrame, keep: int = 5, hours: float = 24.0) -> DataFrame:
    """conv_id, turn, context of a stream of turns (conv_id, turn, text): after each batch, a conversation's last `keep` turns as one text.

    For output mode update. A conversation's state is a list of its last turns by number, which end `hours` after they were
    written. Rows that come late take their place among them, or none if `keep` later turns are there; of one number the text that came last
    holds. Start it within keeping().
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ttl = max(1, int(hours * 3_600_000))

    class LastTurns(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.turns = handle.getListState("turns", "turn long, text string", ttlDurationMs=ttl)

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            held = dict(self.turns.get()) if self.turns.exists() else {}
            for batch in rows:
                held.update(zip(batch["turn"].tolist(), batch["text"].tolist(), strict=True))
            last = sorted(held.items())[-keep:]
            self.turns.put([(int(n), t) for n, t in last])
            yield pd.DataFrame({"conv_id": [key[0]], "turn": [last[-1][0]], "context": ["\n".join(t for _, t in last)]})

        def close(self) -> None:
            pass

    return turns.groupBy("conv_id").transformWithStateInPandas(LastTurns(), "conv_id long, turn long, context string", "update", "processingTime")
