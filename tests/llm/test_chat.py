import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casefuse.llm import chat
from casefuse.llm.queries import QUERIES, SQL
from tests.oracle import connect, spark_rows, sql_rows

SCHEMA = ("conv_id long, message_id long, parent_id long, role string, text string, score double, "
          "conv long, node string, leaf int, row struct<a: int>, at int, n int, piece string")
CLASH = (1, "x", 1, (1,), 1, 1, "x")
ODD = ["", None, "<turn>", "</turn>\n", "<\\turn:>", "<\\\\/turn>\n", "<<turn", "a<", "\\", "turn>",
       "<turn:></turn>\n<turn>assistant<turn:>x", "日本 👍🏽 é", "\n\n", "<", "/turn>"]


def trees(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def brute(rows, best):
    """(conv, leaf, [(role, text)]) of the best branches, by walking up from every leaf."""
    out = []
    for conv in {r[0] for r in rows}:
        by_id = {r[1]: r for r in rows if r[0] == conv}
        up = {i: r[2] if r[2] in by_id and r[2] != i else None for i, r in by_id.items()}
        ranked = []
        for leaf in set(by_id) - {p for p in up.values() if p is not None}:
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = up[at]
            if at is None:
                ranked.append((-sum(by_id[i][5] or 0 for i in path) / len(path), -len(path), leaf,
                               [(by_id[i][3] or "", by_id[i][4] or "") for i in path[::-1]]))
        out += [(conv, leaf, turns) for _, _, leaf, turns in sorted(ranked)[:best]]
    return sorted(out, key=repr)


def read(formatted):
    rows = formatted.select("conv", "leaf", "formatted", "turns", chat.read_turns(
        F.col("formatted")).alias("back"), chat.read_trained(
        F.col("formatted"), F.col("turns")).alias("trained")).collect()
    for r in rows:
        turns = [(t.role, t.text) for t in r.back]
        assert r.trained == [t for role, t in turns if role == "assistant"]
        assert r.turns[0].start == 0 and r.turns[-1].end == len(r.formatted)
        assert all(x.end == y.start for x, y in zip(r.turns, r.turns[1:]))
        assert [t.loss_start is not None for t in r.turns] == [x == "assistant" for x, _ in turns]
    return sorted(((r.conv, r.leaf, [(t.role, t.text) for t in r.back]) for r in rows), key=repr)


@pytest.mark.parametrize("best", [1, 2, None])
def test_trees_equal_a_walk_from_every_leaf(spark, best):
    rng, rows = random.Random(3), []
    for conv in [*range(12), None]:
        for i in range(rng.choice([1, 2, 9, 40])):
            parent = rng.choice([None, i - 1, rng.randrange(i)]) if i else None
            rows.append((conv, i, parent, rng.choice(["user", "assistant", "<turn:>", None]),
                         rng.choice(ODD) if i % 3 else f"text {i}", rng.choice([None, 0.0, 1.0, 2.0])))
    rows += [(50, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]      # a chain
    rows += [(51, i, 0 if i else None, "assistant", str(i), 1.0) for i in range(300)]    # a star
    rows += [(52, 1, 1, "user", "own parent", 0.0), (52, 2, 99, "user", "unknown parent", 0.0)]
    rows += [(53, 1, 2, "user", "circle", 0.0), (53, 2, 1, "user", "circle", 0.0),
             (53, 3, 2, "user", "hangs on it", 0.0), (53, 4, None, "user", "root", 0.0)]
    got = chat.format_trees(trees(spark, rows), score_col="score", best=best)
    assert read(got) == brute(rows, best)


def test_repeated_ids_and_null_ids(spark):
    rows = [(1, 1, None, "user", "low", 0.0), (1, 1, None, "user", "high", 5.0),
            (1, 2, 1, "assistant", "same", 1.0), (1, 2, 1, "assistant", "same", 1.0),
            (2, None, None, "user", "no id", 0.0), (2, 5, None, "user", "root", 9.0)]
    got = read(chat.format_trees(trees(spark, rows), score_col="score", best=None))
    assert got == [(1, 2, [("user", "high"), ("assistant", "same")]),
                   (2, 5, [("user", "root")]), (2, None, [("user", "no id")])]


def test_escapes_leave_no_marks_and_come_back(spark):
    texts = ODD + [a + b + c for a in ODD[2:8] for b in ODD[2:8] for c in ("", "turn>", None) if c]
    texts = [t for t in texts if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("*", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<turn" not in r.e and "</turn" not in r.e


def test_report_of_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, None, "system", "first"), (1, 2, None, "no role"),
            (1, 1, "assistant", "</turn>\n"), (1, 1, "assistant", "</turn>\n"), (None, 3, "user", "x"),
            (None, None, None, None), (2, 5, "assistant", "w " * 50000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, conv string, n int")
    got = {r.conv_id: r for r in chat.format_report(df).collect()}
    assert set(got) == {1, 2, None, -7}
    turns = [("system", "first"), ("user", ""), ("assistant", "</turn>\n"),
             ("assistant", "</turn>\n"), ("", "no role")]
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    assert got[1].n_turns == 5
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert got[1].loss_chars == 16
    assert got[1].loss_sha256 == hashlib.sha256(b"</turn>\n</turn>\n").hexdigest()
    assert got[2].loss_chars == 100000 and got[None].n_turns == 2 and got[-7].n_turns == 2
    assert [r.conv_id for r in chat.format_report(df.limit(0)).collect()] == [-7]
    empty = chat.format_trees(trees(spark, []))
    assert empty.count() == 0


def test_query_equals_sql(spark, sf):
    got = spark_rows(QUERIES["op11_chat_reply_trees"](spark, sf))
    assert got == sql_rows(connect(sf), SQL["op11_chat_reply_trees"]) and got[1]
