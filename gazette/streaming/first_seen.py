"""T2 with a horizon: a page whose URL was seen within the horizon before is dropped; late pages are told apart.

One state per lower-cased URL holds the time span of its current run of sightings.  A sighting less than the horizon away
from the span extends it and is dropped; one further off opens a new span, and its page is seen first again.  Spans are
compared by event times alone, so the rows do not depend on when Spark purges a state, nor on the order of rows in a batch.
A state goes by a timer once the watermark (latest time of the batches before, less the horizon) has passed its end by the horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

LATE = "older than the watermark"
NO_TIME = "no time"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Emits (row, reject_reason): the first row of each span, without a reason, and every late row, with one."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "begin long, end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        known = tuple(self.span.get()) if self.span.exists() else None
        spans = [[*known, None, None]] if known else []  # [begin, end, tie, first row]; few: their gaps span a horizon
        for part in rows:
            late = (part["at"] < mark).to_numpy()
            if late.any():
                reasons = [NO_TIME if at < 0 else LATE for at in part["at"][late]]
                yield pd.DataFrame({"row": part["row"][late].to_list(), "reject_reason": reasons})
            for at, tie, row in part.loc[~late, ["at", "tie", "row"]].itertuples(index=False, name=None):
                self._place(spans, at, tie, row)
        if not spans:
            return
        first = [s[3] for s in spans if s[3] is not None]
        if first:
            yield pd.DataFrame({"row": first, "reject_reason": [None] * len(first)})
        begin, end = spans[-1][:2]
        if known is None or (begin, end) != known:
            if known is not None:
                self.handle.deleteTimer(known[1] + self.horizon)
            self.handle.registerTimer(end + self.horizon)
            self.span.update((begin, end))

    def _place(self, spans: list[list], at: int, tie: int, row) -> None:
        """Puts a sighting into the span it is near, or into a new one; spans stay sorted and apart by the horizon."""
        near = [s for s in spans if s[0] - self.horizon < at < s[1] + self.horizon]
        if not near:
            spans.append([at, at, tie, row])
            spans.sort(key=lambda s: s[0])
            return
        head = near[0]
        # a span from the state has its first row out already (tie None)
        if head[2] is not None and (at, tie) < (head[0], head[2]):
            head[2], head[3] = tie, row
        head[0], head[1] = min(head[0], at), max(head[1], at, near[-1][1])
        spans[:] = [s for s in spans if s is head or s not in near]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.span.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_seen_within(pages: DataFrame, horizon_seconds: int, time_col: str | None = None) -> DataFrame:
    """The columns of the stream ``pages`` and ``reject_reason``: null for a page whose URL was not seen in the
    ``horizon_seconds`` before; a reason for every page older than the watermark, or without a time.  Repeats go.

    ``time_col`` is a timestamp; without one the file's modification time counts.  Pages without a URL (null or blank) count
    as one URL.  Of the first rows of one time one stays, by a hash of its values.  The session needs the RocksDB
    state store (``ROCKSDB``) when the stream starts."""
    at = F.col(time_col) if time_col else F.col("_metadata.file_modification_time")
    timed = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), at.cast("timestamp").alias("_seen_at"),
                         F.coalesce(F.lower(F.trim(F.col("url"))), F.lit("")).alias("url_key"))
    # the watermark moves with _seen_at; the processor reads a plain copy, so that late rows reach it
    keyed = timed.withWatermark("_seen_at", f"{horizon_seconds} seconds").select(
        "url_key", F.coalesce(F.unix_millis("_seen_at"), F.lit(-1)).alias("at"), F.xxhash64(F.to_json("row")).alias("tie"), "row")
    out = StructType([StructField("row", keyed.schema["row"].dataType), StructField("reject_reason", StringType())])
    return keyed.groupBy("url_key").transformWithStateInPandas(
        FirstSeen(horizon_seconds * 1000), out, "Append", "EventTime").select("row.*", "reject_reason")


def write_first_seen(pages: DataFrame, sink: str, checkpoint: str, horizon_seconds: int, time_col: str | None = None,
                     name: str = "first_seen", available_now: bool = True):
    """Starts T2 with a horizon into Parquet under ``sink``; both folders are shared, and a stream restarted on them goes
    on where it stopped.  Only this stream gets the RocksDB state store.  Returns the StreamingQuery."""
    w = (first_seen_within(pages, horizon_seconds, time_col).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return start_with_rocksdb(pages.sparkSession, w.queryName(name))


def start_with_rocksdb(spark: SparkSession, writer: DataStreamWriter):
    """Starts the stream with the RocksDB state store; the session's own setting stays as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
