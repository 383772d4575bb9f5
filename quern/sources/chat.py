"""A chat service as a stream whose offset is how far each channel was read, and its threads as documents."""

from __future__ import annotations

import importlib
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Where a channel begins: times of messages are seconds with six decimals, as text.
BEGINNING = "0"


class _Span(InputPartition):
    def __init__(self, channel: str, after: str, upto: str):
        self.channel, self.after, self.upto = channel, after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        module, name = options["api"].split(":")
        self.api = getattr(importlib.import_module(module), name)
        self.channels = [c.strip().lstrip("#") for c in options["channels"].split(",")]

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.channels, BEGINNING)

    def latestOffset(self) -> dict:
        return {c: self.api.latest(c) or BEGINNING for c in self.channels}

    def partitions(self, start: dict, end: dict):
        spans = [_Span(c, start.get(c, BEGINNING), end[c]) for c in self.channels]
        return [s for s in spans if Decimal(s.after) < Decimal(s.upto)] or [_Span("", BEGINNING, BEGINNING)]

    def read(self, partition: _Span):
        cursor = None
        while partition.channel:
            messages, cursor = self.api.history(partition.channel, partition.after, partition.upto, cursor)
            for m in messages:
                # a span is open at its beginning, so that no message is read twice
                if Decimal(partition.after) < Decimal(m["ts"]) <= Decimal(partition.upto):
                    yield (partition.channel, m["ts"], m.get("thread_ts"), m.get("user"), m.get("text") or "")
            if not cursor:
                return


class ChatSource(DataSource):
    """spark.dataSource.register(ChatSource); spark.readStream.format("chat").option("api", "module:object").option("channels", "a,b")

    The object has latest(channel), the time of the newest message or None, and history(channel, after, upto, cursor), which
    gives some messages of that span, replies too, and the next cursor or None; a message is a dict of ts, thread_ts, user, text. A
    batch reads each channel's new span in a task of its own, page by page. The offset is in the stream's checkpoint, so a restart goes on
    after the last message that was read.
    """

    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> str:
        return "channel string, ts string, thread_ts string, user string, text string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def growing_threads(messages: DataFrame) -> DataFrame:
    """channel, thread_ts, n, participants, text of a stream of messages, for output mode update: a thread comes again when it has grown.

    A thread is a message and its replies, one line each in the order of time; the state holds the messages of each.
    """
    line = F.concat(F.lit("["), "ts", F.lit("] "), F.coalesce("user", F.lit("unknown")), F.lit(": "), "text")
    said = F.struct(F.col("ts").cast("decimal(20,6)").alias("at"), line.alias("line"))
    grouped = messages.groupBy("channel", F.coalesce("thread_ts", "ts").alias("thread_ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("user")).alias("participants"), F.sort_array(F.collect_list(said)).alias("lines")
    )
    return grouped.select("channel", "thread_ts", "n", "participants", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("text"))


def latest_threads(spark: SparkSession, sink: str) -> DataFrame:
    """Each thread as it was last written by run_once(growing_threads(...), sink, checkpoint, "update")."""
    rows = spark.read.parquet(sink)
    last = rows.groupBy("channel", "thread_ts").agg(F.max_by(F.struct("n", "participants", "text"), "batch").alias("t"))
    return last.select("channel", "thread_ts", "t.*")
