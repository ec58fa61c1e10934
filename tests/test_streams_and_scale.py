import os
import random

import pandas as pd
from pyspark.sql import functions as F

from casefuse.operators import edits as ed
from casefuse.operators import voting
from casefuse.session import shared_dir
from casefuse.streaming import live
from tests.test_ordered import EDITS, _log, _replay

ONE_FILE = {"availableNow": True}


def _files(spark, rows, schema, n):
    """The rows as n files, oldest first, read back one file per micro-batch."""
    path = shared_dir(spark, "stream-in")
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_change_feed_over_batches_equals_batch(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 2]), s, rnd.choice("ab")) for s in range(60)]
    rows += rows[5:9]
    schema = "case_id long, seq long, snapshot string"
    root = shared_dir(spark, "feed")
    live.start_change_feed(_files(spark, rows, schema, 4), f"{root}/out", f"{root}/state", f"{root}/cp",
                           ONE_FILE).awaitTermination()
    got = {(r.case_id, r.seq) for r in spark.read.parquet(f"{root}/out").collect()}
    want, last = set(), {}
    for case, seq, snap in sorted(set(rows), key=lambda r: r[1]):
        if last.get(case) != snap:
            want.add((case, seq))
        last[case] = snap
    assert got == want
    assert len([d for d in os.listdir(f"{root}/out") if d.startswith("epoch=")]) == 4
    late = spark.read.parquet(f"{root}/state/late").collect()
    assert {(r.case_id, r.seq, r.snapshot) for r in late} == set(rows[5:9])


def test_rows_out_of_order_are_accounted_for_after_a_restart(spark):
    """Files out of order, the stream stopped and started again: each row is used or in `late`."""
    schema, root, path = "case_id long, seq long, snapshot string", shared_dir(spark, "restart"), shared_dir(spark, "in")
    batches = [[(1, 5, "a"), (2, 1, "x")], [(1, 3, "b"), (3, 1, "y")], [(1, 5, "a"), (2, 2, "x")],
               [(2, 3, "z"), (1, 6, "a"), (1, 7, "c")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        if i % 2:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            live.start_change_feed(stream, f"{root}/out", f"{root}/state", f"{root}/cp", ONE_FILE).awaitTermination()
    got = {(r.case_id, r.seq) for r in spark.read.parquet(f"{root}/out").collect()}
    late = {(r.case_id, r.seq, r.why) for r in spark.read.parquet(f"{root}/state/late").collect()}
    assert got == {(1, 5), (2, 1), (3, 1), (2, 3), (1, 7)}
    assert late == {(1, 3, "late"), (1, 5, "repeated")}


def test_small_frames_of_many_cases_share_one_class_and_keep_their_values():
    frames = [pd.DataFrame([(1, 2 ** 60 + i, None, {"f": "x"})], columns=["case_id", "seq", "value", "linked"]) for i in range(30)]
    fresh, late = live.in_order(iter(reversed(frames)), 2 ** 60 + 1)
    assert len({type(r) for r in fresh}) == 1
    assert [r.seq for r in fresh] == [2 ** 60 + i for i in range(2, 30)]
    assert [(r.seq, why) for r, why in late] == [(2 ** 60, "late"), (2 ** 60 + 1, "repeated")]
    assert {(r.value, r.linked["f"]) for r in fresh} == {(None, "x")}


def test_edit_stream_over_batches_equals_brute_force(spark):
    log = _log(11, 120, .45)
    root = shared_dir(spark, "edit-stream")
    live.start_edit_replay(_files(spark, log, EDITS, 4), f"{root}/state", f"{root}/cp", ONE_FILE,
                           depth=4).awaitTermination()
    got = live.current_fields(spark, f"{root}/state").collect()
    assert {(r.case_id, r.field): (r.value, r.state, r.origin) for r in got} == _replay(log, [], 4)


def test_edit_stream_goes_on_after_a_restart_and_keeps_late_edits(spark):
    log = [e for e in _log(12, 90, .4)]
    root, path = shared_dir(spark, "edit-restart"), shared_dir(spark, "in")
    parts = [log[:30], log[30:60] + [log[3]], log[60:]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, EDITS).coalesce(1).write.mode("append").parquet(path)
        if i != 1:
            stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(path)
            live.start_edit_replay(stream, f"{root}/state", f"{root}/cp", ONE_FILE, depth=3).awaitTermination()
    got = live.current_fields(spark, f"{root}/state").collect()
    assert {(r.case_id, r.field): (r.value, r.state, r.origin) for r in got} == _replay(log, [], 3)
    late = spark.read.parquet(f"{root}/state/late").collect()
    assert [(r.case_id, r.seq, r.why) for r in late] == [(log[3][0], log[3][1], "late")]


def test_live_votes_over_batches_equal_batch_votes(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice("AB"), rnd.choice(["x", "y", None]), rnd.choice("pqr"), s)
            for s in range(80)]
    root = shared_dir(spark, "votes")
    schema = "case_id long, field string, value string, engine string, seq long"
    live.start_live_votes(_files(spark, rows, schema, 4), f"{root}/state", f"{root}/cp", ONE_FILE).awaitTermination()
    want = {}
    for case, field, value, engine, seq in rows:
        engines, first = want.get((case, field, value), (set(), seq))
        want[case, field, value] = (engines | {engine}, min(first, seq))
    got = live.current_votes(spark, f"{root}/state").collect()
    assert {(r.case_id, r.field, r.value): (set(r.engines), r.first_seq) for r in got} == want
    assert len(got) == len(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_case_is_spread_by_the_lookup(spark):
    """One case holds two thirds of the rows; no task of the big join sees more than a bucket."""
    rows = spark.range(0, 60000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("case_id"), F.col("id").alias("seq"))
    cut = rows.groupBy("case_id").agg((F.max("seq") - 30000).alias("cut_seq"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        kept = voting.stop_when_covered(rows, cut)
        sizes = [r["count"] for r in kept.where("case_id = -1").groupBy(
            F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 20000 and len(sizes) > 15 and max(sizes) < 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_no_window_over_a_whole_case(spark):
    """Every window over raw rows is keyed by the bucketed struct, never by the case alone."""
    df = spark.createDataFrame(_log(1, 30, .3), EDITS)
    plan = ed.replay_edits(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    raw = [w for w in windows if "_k#" in w.rsplit("], [", 2)[-2]]
    carried = [w for w in windows if w not in raw]
    assert raw and carried and all("struct(" in w or "_groupingexpression" in w or "_w" in w for w in carried)


def test_scan_reads_only_needed_columns(spark, sf):
    import bindings
    plan = _plan(bindings.QUERIES["consensus_prefill"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in plan
