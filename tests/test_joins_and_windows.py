import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.operators import audit, joins, sketches
from casefuse.session import shared_dir
from casefuse.streaming import windows

LEFT, RIGHT = "id long, k string, at long, extra string", "k string, at long, seq long, value string"


def as_of(left, right, forward=False, max_gap=None):
    out = {}
    for i, k, at, _ in left:
        found = None
        for rk, rat, seq, value in right:
            if k is None or at is None or rk != k or rat is None or (rat < at if forward else rat > at):
                continue
            if max_gap is not None and abs(rat - at) > max_gap:
                continue
            order = (-rat if forward else rat, seq)
            if found is None or order > found[0]:
                found = order, value, seq
        out[i] = found[1:] if found else (None, None)
    return out


@pytest.mark.parametrize("forward,max_gap,rows", [(False, None, 10), (True, None, 7), (False, 40, 1000), (True, 25, 3)])
def test_asof_join_equals_brute_force_with_a_hot_key(spark, forward, max_gap, rows):
    rnd = random.Random(8)
    keys = ["hot", "hot", "a", "b", "only left", None]
    left = [(i, rnd.choice(keys), rnd.choice([None, *range(0, 3000, 7)]), "x") for i in range(300)]
    right = [(rnd.choice(["hot", "hot", "a", "b", "only right", None]), rnd.choice([None, *range(0, 3000, 5)]), s,
              rnd.choice([None, f"v{s}"])) for s in range(300)]
    got = joins.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "at",
                          ["value", "seq"], tie="seq", forward=forward, max_gap=max_gap, rows=rows)
    assert got.columns == ["id", "k", "at", "extra", "value", "seq"]
    assert {r.id: (r.value, r.seq) for r in got.collect()} == as_of(left, right, forward, max_gap)
    assert got.count() == 300


def test_asof_join_of_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", 5, "x")], LEFT)
    right = spark.createDataFrame([], RIGHT)
    assert [r.value for r in joins.asof_join(left, right, ["k"], "at", ["value"]).collect()] == [None]
    assert joins.asof_join(left.limit(0), right, ["k"], "at", ["value"]).count() == 0


A, B = "id long, k string, s double, e double", "id long, k string, s double, e double"


def overlapping(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (
        *x[2:], *y[2:]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])


def spans(rnd, n, first):
    out = []
    for i in range(n):
        start = rnd.uniform(-500, 1500)
        length = rnd.choice([0, 0.5, 3, 3, 10, 200, 5000])
        out.append((first + i, rnd.choice(["hot", "hot", "a", None]), start, start + length))
    return out + [(first + n, "a", None, 4.0), (first + n + 1, "a", 4.0, None), (first + n + 2, "hot", 9.0, 3.0),
                  (first + n + 3, "a", 16.0, 32.0), (first + n + 4, "a", 32.0, 256.0), (first + n + 5, "a", 16.0, 16.0)]


@pytest.mark.parametrize("width", [None, 1.0, 64.0])
def test_interval_join_equals_brute_force_once_a_pair(spark, width):
    rnd = random.Random(9)
    a, b = spans(rnd, 120, 0), spans(rnd, 150, 1000)
    got = joins.interval_join(spark.createDataFrame(a, A), spark.createDataFrame(b, B), ["k"], ("s", "e"), ("s", "e"),
                              width=width)
    assert sorted((r.l.id, r.r.id) for r in got.collect()) == overlapping(a, b)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" in plan
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_interval_join_bins_are_bounded(spark):
    """However long an interval is, it lies in few bins."""
    rows = [(i, "a", 0.0, float(10 ** i)) for i in range(10)]
    binned = joins._binned(spark.createDataFrame(rows, A), ["k"], "s", "e", 1.0, 9, "l")
    assert max(r["count"] for r in binned.groupBy("l.id").count().collect()) <= joins.FAN + 1 + 2 * 9
    none = spark.createDataFrame([], A)
    assert joins.interval_join(none, none, ["k"], ("s", "e"), ("s", "e")).count() == 0


def test_merged_sketches_equal_the_whole(spark):
    rows = spark.range(200000).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("g"),
                                      (F.col("id") * 7919 % 60000).alias("user"), (F.col("id") % 1000).alias("v"))
    parts = sketches.part_sketches(rows, ["day", "g"], F.col("user"), F.col("v"))
    one = sketches.part_sketches(rows, ["g"], F.col("user"), F.col("v"))
    merged = {r.g: r for r in sketches.merged(parts, ["g"]).select(
        "g", "n_rows", sketches.distinct_count().alias("d"), sketches.quantiles(0.1, 0.5, 0.9).alias("q")).collect()}
    whole = {r.g: r for r in one.select("g", "n_rows", sketches.distinct_count().alias("d")).collect()}
    exact = {r.g: r.d for r in rows.groupBy("g").agg(F.count_distinct("user").alias("d")).collect()}
    for g in (0, 1):
        assert merged[g].n_rows == 100000 == whole[g].n_rows
        assert abs(merged[g].d - whole[g].d) <= 0.01 * exact[g] and abs(merged[g].d - exact[g]) <= 0.03 * exact[g]
        assert all(abs(x - 1000 * p) < 10 for x, p in zip(merged[g].q, (0.1, 0.5, 0.9)))


def test_state_cube_counts_cases_without_repeating_rows(spark):
    rnd, fields = random.Random(3), ["NIE", "CP", "CP_2", "Teléfono", "Fecha", "other", None]
    rows = [(rnd.choice([1, 1, 1, *range(40), None]), rnd.choice(fields), rnd.choice(["AI", "WARN", "own", None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "case_id long, field string, state string")
    sections = {row[0]: row[2] for row in fv.FIELD_CATALOG}
    want = {}
    for case, field, state in rows:
        section = sections.get(field)
        for key in ((0, section, state), (1, section, None), (2, None, state), (3, None, None)):
            cell = want.setdefault(key, [0, set()])
            cell[0] += 1
            cell[1] |= {case} - {None}
    got = audit.state_cube(df)
    assert {(r.level, r.section, r.state): (r.n_fields, r.n_cases) for r in got.collect()} == {
        k: (n, len(cases)) for k, (n, cases) in want.items()}
    assert got.count() == len(want) and "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert audit.state_cube(df.where("false")).count() == 0


def test_pass_rates_by_level_in_one_expand(spark):
    rows = [(1, "CP", True), (2, "CP", False), (1, "NIE", None), (1, "no such field", True)]
    df = spark.createDataFrame(rows, "case_id long, field string, ok boolean")
    got = audit.pass_rates_by_level(df)
    assert {(r.level, r.field): (r.n_checked, r.n_ok, r.n_failed) for r in got.collect() if r.level != "section"} == {
        ("field", "CP"): (2, 1, 1), ("field", "NIE"): (0, 0, 0), ("field", "no such field"): (1, 1, 0),
        ("all", None): (3, 2, 1)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Expand [") == 1


T0 = dt.datetime(2024, 5, 1, 12, 0)


def _minutes(n):
    return T0 + dt.timedelta(minutes=n)


def test_failures_by_window_and_late_rows(spark):
    """Each file is a micro-batch; rows behind the watermark change nothing and are counted."""
    schema, root, path = "at timestamp, engine string, status string", shared_dir(spark, "win"), shared_dir(spark, "in")
    files = [[(1, "a"), (2, "a"), (59, "b"), (30, None)], [(61, "a"), (130, "a")], [(200, "b"), (119, "b")],
             [(5, "a"), (58, "b"), (199, "a")]]
    runs = []
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(_minutes(m), e or "a", "HTTP 429" if e else None) for m, e in rows], schema)
        df.coalesce(1).write.mode("append").parquet(path)
        if i in (1, 3):     # stopped and started again in between
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            query = windows.start_failure_windows(stream, f"{root}/s", f"{root}/cp", delay="10 minutes")
            query.awaitTermination()
            runs.append(query)
    tallies = windows.current_failures(spark, f"{root}/s")
    got = {(r.window_start, r.engine): r.n for r in tallies.collect()}
    # The window of 119 has closed at the watermark of 130 less 10; those of 5 and 58 long before.
    assert got == {(_minutes(0), "a"): 2, (_minutes(0), "b"): 1, (_minutes(60), "a"): 1, (_minutes(120), "a"): 1,
                   (_minutes(180), "b"): 1, (_minutes(180), "a"): 1}
    assert sum(map(windows.failed_rows, runs)) == 10
    assert windows.late_failures(runs, tallies) == 3


def test_calls_and_replies_with_a_restart(spark):
    calls_schema, replies_schema = "call_id long, case_id long, called_at timestamp", "call_id long, replied_at timestamp"
    root, a, b = shared_dir(spark, "join"), shared_dir(spark, "calls"), shared_dir(spark, "replies")
    calls = [[(1, 1, _minutes(0)), (2, 1, _minutes(1))], [(3, 2, _minutes(30)), (4, 2, _minutes(31))],
             [(9, 9, _minutes(90))]]
    replies = [[(1, _minutes(2)), (8, _minutes(3))], [(3, _minutes(34)), (3, _minutes(35)), (4, _minutes(37)),
                                                     (2, _minutes(33))], [(9, _minutes(91)), (0, _minutes(99))]]
    for c, r in zip(calls, replies):
        spark.createDataFrame(c, calls_schema).coalesce(1).write.mode("append").parquet(a)
        spark.createDataFrame(r, replies_schema).coalesce(1).write.mode("append").parquet(b)
        windows.start_reply_join(spark.readStream.schema(calls_schema).parquet(a),
                                 spark.readStream.schema(replies_schema).parquet(b), f"{root}/out", f"{root}/cp",
                                 "5 minutes", "1 minute").awaitTermination()
    got = sorted(((r.call_id, r.replied_at) for r in windows.call_outcomes(spark, f"{root}/out").collect()), key=str)
    assert got == sorted([(1, _minutes(2)), (2, None), (3, _minutes(34)), (3, _minutes(35)), (4, None),
                          (9, _minutes(91))], key=str)
