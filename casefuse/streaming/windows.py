"""Event-time windows and a join of two streams, both bounded by watermarks.

A watermark is the newest event time seen less an allowed delay. Windows that ended before it are
closed, and a call whose deadline lies before it can get no reply any more. So state holds only what
may still change.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casefuse.functions.rules import failure_cause
from casefuse.streaming.live import newest

FAILURES = "window_start timestamp, window_end timestamp, engine string, cause string, n long"
_SEEN = "failed_calls"


def failures_by_window(calls: DataFrame, at: str, width: str, slide: str = None) -> DataFrame:
    """`window_start, window_end, engine, cause, n` of failed calls (those with a `status`).

    The same expression serves a table and a stream with a watermark on `at`. A null time is in no
    window.
    """
    failed = calls.where(F.col("status").isNotNull())
    return failed.groupBy(F.window(at, width, slide).alias("w"), "engine", failure_cause(
        F.col("status")).alias("cause")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "engine",
        "cause", "n")


def _started(rows: DataFrame, mode: str, path: str, checkpoint: str, trigger) -> StreamingQuery:
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(handle)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def start_failure_windows(stream: DataFrame, state: str, checkpoint: str, at: str = "at",
                          width: str = "1 hour", slide: str = None, delay: str = "10 minutes",
                          trigger=None) -> StreamingQuery:
    """Failed calls per window, engine and cause; `state/epoch=n` holds what an epoch changed.

    A row that comes when its window has closed changes no tally; `late_failures` tells how many did.
    """
    failed = stream.where(F.col("status").isNotNull() & F.col(at).isNotNull())
    counted = failed.observe(_SEEN, F.count(F.lit(1)).alias("n")).withWatermark(at, delay)
    return _started(failures_by_window(counted, at, width, slide), "update", state, checkpoint, trigger)


def current_failures(spark: SparkSession, state: str) -> DataFrame:
    """The newest tally of every window, engine and cause."""
    return newest(spark, state, FAILURES, ["window_start", "window_end", "engine", "cause"])


def failed_rows(query: StreamingQuery) -> int:
    """Failed calls a run of the stream has read, whether in time or late."""
    return sum(p.observedMetrics[_SEEN].n for p in query.recentProgress if _SEEN in p.observedMetrics)


def late_failures(runs: list, tallies: DataFrame, windows_per_row: int = 1) -> int:
    """Rows that came after their window had closed: read by the runs, but in no tally."""
    return sum(map(failed_rows, runs)) - (tallies.agg(F.sum("n")).first()[0] or 0) // windows_per_row


def start_reply_join(calls: DataFrame, replies: DataFrame, out: str, checkpoint: str,
                     within: str = "5 minutes", delay: str = "1 minute",
                     trigger=None) -> StreamingQuery:
    """`call_id, case_id, called_at, replied_at` to `out/epoch=n`: replies of calls, or null for none.

    `calls(call_id, case_id, called_at)`, `replies(call_id, replied_at)`. A reply counts from the call
    to `within` later, both included; a call may have several. A call without one comes out once the
    watermark has passed its deadline, so both sides are kept for that long only.
    """
    left = calls.select("call_id", "case_id", "called_at").withWatermark("called_at", delay)
    right = replies.select(F.col("call_id").alias("of"), "replied_at").withWatermark(
        "replied_at", delay)
    met = left.join(right, (F.col("call_id") == F.col("of")) & (F.col("replied_at") >= F.col(
        "called_at")) & (F.col("replied_at") <= F.col("called_at") + F.expr(f"INTERVAL {within}")),
        "leftOuter")
    return _started(met.select("call_id", "case_id", "called_at", "replied_at"), "append", out,
                    checkpoint, trigger)


def call_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """All rows that the join has put out."""
    return spark.read.parquet(out).select("call_id", "case_id", "called_at", "replied_at")
