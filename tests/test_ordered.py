import random

import pytest
from pyspark.sql import functions as F

from casefuse.operators import edits as ed
from casefuse.operators import ordered


def _rows(seed, cases, n):
    rnd = random.Random(seed)
    return [(rnd.choice(cases), seq, rnd.choice("abc")) for seq in range(n)]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_row_number_and_total_across_ranges(spark, rows):
    data = _rows(1, [1, 1, 1, 2, None], 60)
    df = spark.createDataFrame(data, "case_id long, seq long, v string")
    got = ordered.row_number(df, ["case_id"], ["seq"], F.col("seq"), "rn", "n",
                             rows=rows).collect()
    for case in (1, 2, None):
        seqs = sorted(s for c, s, _ in data if c == case)
        mine = {r.seq: (r.rn, r.n) for r in got if r.case_id == case}
        assert mine == {s: (i + 1, len(seqs)) for i, s in enumerate(seqs)}


@pytest.mark.parametrize("rows", [1, 3, 1000])
@pytest.mark.parametrize("following", [False, True])
def test_neighbour_across_ranges(spark, rows, following):
    data = _rows(2, [1, 1, 1, 2, None], 60)
    data = [(c, s, None if s % 7 == 0 else v) for c, s, v in data]
    df = spark.createDataFrame(data, "case_id long, seq long, v string")
    got = ordered.neighbour(df, ["case_id"], "seq", F.col("v"), "near", following, rows).collect()
    for case in (1, 2, None):
        seen = sorted(((s, v) for c, s, v in data if c == case), reverse=following)
        want = {s: (seen[i - 1][1] if i else "edge") for i, (s, _) in enumerate(seen)}
        mine = {r.seq: ("edge" if r.near is None else r.near.v) for r in got if r.case_id == case}
        assert mine == want


def test_a_hot_case_with_sparse_order_is_cut_by_rows(spark):
    """Epoch micros far apart, a third of all rows in one case: ranges hold about equal rows."""
    df = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("case_id"),
        (F.lit(1700000000000000) + F.pow(F.col("id").cast("double"), 2.5).cast("long")).alias("seq"))
    cuts = ordered.cut_points(df, ["case_id"], F.col("seq"), 1000)
    assert [r.case_id for r in cuts.collect()] == [-1]
    ranges = ordered._ranged(df, ["case_id"], F.col("seq"), cuts).groupBy(
        "case_id", "_range").count().where("case_id = -1").collect()
    sizes = sorted(r["count"] for r in ranges)
    assert len(sizes) == 20 and sum(sizes) == 20000
    assert sizes[-1] < 2 * sizes[len(sizes) // 2] and sizes[-1] < 2000
    got = ordered.row_number(df, ["case_id"], ["seq"], F.col("seq"), "rn", rows=1000)
    wrong = got.withColumn("want", F.expr("row_number() over (partition by case_id order by seq)"))
    assert wrong.where("rn <> want").count() == 0 and wrong.count() == 60000


def test_equal_and_null_order_values(spark):
    data = [(1, s, i) for i, s in enumerate([5] * 40 + [None] * 20 + list(range(30)))]
    df = spark.createDataFrame(data, "case_id long, seq long, tie long")
    got = ordered.row_number(df, ["case_id"], ["seq", "tie"], F.col("seq"), "rn", rows=4).collect()
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert [r.tie for r in sorted(got, key=lambda r: r.rn)] == [r[2] for r in want]


def test_lookup_keeps_every_row(spark):
    data = _rows(4, [1, 2, 3, None], 40)
    df = spark.createDataFrame(data, "case_id long, seq long, v string")
    table = spark.createDataFrame([(1, "x"), (2, None), (9, "z")], "case_id long, t string")
    got = ordered.lookup(df, table, ["case_id"], F.col("seq"), 3).collect()
    assert sorted((r.seq, r.t) for r in got) == sorted(
        ((s, {1: "x"}.get(c)) for c, s, _ in data), key=lambda x: x[0])


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_running_height_never_below_zero(spark, rows):
    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, 2]), s, rnd.choice([1, -1, -1])) for s in range(80)]
    df = spark.createDataFrame(data, "case_id long, seq long, step int")
    got = ordered.running_height(df, ["case_id"], "seq", F.col("step"), "h", rows).collect()
    for case in (1, 2):
        h, want = 0, {}
        for c, s, step in data:
            if c == case:
                h = max(0, h + step)
                want[s] = h
        assert {r.seq: r.h for r in got if r.case_id == case} == want


EDITS = ("case_id long, seq long, action string, field string, value string, "
         "linked map<string,string>, origin string")
INITIAL = "case_id long, field string, value string, state string, origin string"


def _log(seed, n, p_undo, cases=(1, 1, 2)):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        action = "undo" if rnd.random() < p_undo else rnd.choice(["set", "clear", "choose", "dismiss"])
        linked = {"B": f"l{seq}"} if action == "choose" and rnd.random() < .5 else None
        value = rnd.choice([f"v{seq}", " "]) if action == "set" else f"v{seq}"
        out.append((rnd.choice(cases), seq, action, rnd.choice("AB"), value, linked, f"o{seq}"))
    return out


def _replay(log, initial, depth):
    """Brute force: keep the stack of previous values, as an app would."""
    cells, stacks = {}, {}
    for case, field, value, state, origin in initial:
        cells[(case, field)] = (value, state, origin)
    for case, _, action, field, value, linked, origin in sorted(log, key=lambda e: e[1]):
        stack = stacks.setdefault(case, [])
        if action == "undo":
            if stack:
                for key, old in stack.pop().items():
                    cells[key] = old
            continue
        delta = {field: value, **(linked or {})} if action == "choose" else {field: value}
        stack.append({(case, f): cells.get((case, f)) for f in delta})
        del stack[:-depth]
        for f, v in delta.items():
            old = cells.get((case, f)) or (None, None, None)
            if action == "choose":
                cells[(case, f)] = (v, "USER", origin)
            elif action == "set" and v.strip():
                cells[(case, f)] = (v, "USER", old[2])
            elif action == "dismiss":
                cells[(case, f)] = (None, "EMPTY", None)
            else:
                cells[(case, f)] = (None, "EMPTY", old[2])
    return {k: v for k, v in cells.items() if v is not None}


@pytest.mark.parametrize("seed,p_undo,depth,rows", [
    (1, .3, 20, 1000), (2, .5, 3, 5), (3, .6, 2, 1), (4, .45, 1, 7), (5, .48, 4, 16)])
def test_edit_replay_equals_brute_force(spark, seed, p_undo, depth, rows):
    log = _log(seed, 150, p_undo)
    initial = [(1, "A", "start", "AI", "doc"), (2, "B", "start", "AI", "doc")]
    got = ed.replay_edits(spark.createDataFrame(log, EDITS), spark.createDataFrame(initial, INITIAL),
                          depth, rows).collect()
    assert {(r.case_id, r.field): (r.value, r.state, r.origin) for r in got} == _replay(
        log, initial, depth)


def test_only_the_last_twenty_edits_are_undone(spark):
    log = [(1, s, "set", f"f{s}", f"v{s}", None, None) for s in range(21)]
    log += [(1, 21 + s, "undo", None, None, None, None) for s in range(21)]
    got = ed.replay_edits(spark.createDataFrame(log, EDITS)).collect()
    assert [(r.field, r.value) for r in got] == [("f0", "v0")]


def test_last_edits_without_undo(spark):
    log = [(1, 1, "set", "A", "x", None, None), (1, 2, "choose", "B", "y", {"A": "z"}, "doc"),
           (1, 3, "clear", "B", None, None, None)]
    got = {r.field: (r.value, r.state, r.origin) for r in ed.last_edits(
        spark.createDataFrame(log, EDITS)).collect()}
    assert got == {"A": ("z", "USER", "doc"), "B": (None, "EMPTY", "doc")}
