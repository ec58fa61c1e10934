"""Streams over the events file, and the batch form of the change feed."""

from pyspark.sql import functions as F

from bindings.common import PLANTED, cte, query, table
from bindings.filling import REPLAY_SQL
from casefuse.session import shared_dir
from casefuse.streaming import live

_SNAPS = ["user_id as case_id", "event_id as seq", "event_type as snapshot"]
_CHANGES = f"""
WITH s AS (SELECT {', '.join(_SNAPS)} FROM events),
p AS (SELECT *, lag(snapshot) OVER (PARTITION BY case_id ORDER BY seq) AS prev FROM s)
SELECT case_id, seq, snapshot FROM p WHERE prev IS NULL OR prev <> snapshot"""


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("changed_snapshots", _CHANGES)
def changed_snapshots(spark, sf):
    return live.changed_rows(table(spark, sf, "events").selectExpr(*_SNAPS))


@query("change_feed_stream", _CHANGES)
def change_feed_stream(spark, sf):
    root = shared_dir(spark, "change-feed")
    live.start_change_feed(_stream(spark, sf).selectExpr(*_SNAPS), f"{root}/out", f"{root}/state",
                           f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("case_id", "seq", "snapshot")


@query("edit_replay_stream", REPLAY_SQL)
def edit_replay_stream(spark, sf):
    root = shared_dir(spark, "edit-replay")
    rows = _stream(spark, sf).selectExpr(*PLANTED["edits"][1])
    linked = F.when(F.col("linked_field").isNotNull(), F.create_map("linked_field", F.concat(F.lit("l"), "value")))
    live.start_edit_replay(rows.withColumn("linked", linked), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return live.current_fields(spark, f"{root}/state")


@query("live_votes_stream", f"""WITH {cte('votes')}
SELECT case_id, field, value, string_agg(DISTINCT engine, '|' ORDER BY engine) AS engines, min(seq) AS first_seq
FROM votes GROUP BY ALL""")
def live_votes_stream(spark, sf):
    root = shared_dir(spark, "live-votes")
    live.start_live_votes(_stream(spark, sf).selectExpr(*PLANTED["votes"][1]), f"{root}/state",
                          f"{root}/checkpoint").awaitTermination()
    return live.current_votes(spark, f"{root}/state")
