from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from casefuse.llm import quality
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents, words


def plain(text):
    t = text or ""
    w = words(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup,
            len(covered))


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text").collect()}
    rows = QUERIES["op10_quality_decision_list"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert tuple(r)[1:6] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_held_out_accuracy(spark):
    """Learned at one scale, judged on the labels of another."""
    train, test = "/root/testdata/sf0.01", "/root/testdata/sf0.1"

    def counted(sf):
        return spark.read.parquet(f"{sf}/documents.parquet").select(
            "doc_id", quality.stats(F.col("text")).alias("stats"))
    rules = quality.learn_rules(counted(train), spark.read.parquet(f"{train}/labels.parquet"))
    s = F.col("stats")
    judged = counted(test).where(~quality.base_failed(s)).join(
        spark.read.parquet(f"{test}/labels.parquet"), "doc_id")
    got = judged.groupBy("quality", quality.verdict(rules, s).alias("kept")).count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.002 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.05 * n[(0, False)]


def test_awkward_rows_and_empty_tables(spark):
    rows = awkward(3000)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (9, None), (2, 1)],
                                   "doc_id long, quality int")
    got = quality.judge(documents(spark, rows), labels).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in got) == sorted(
        (str(i), *plain(t)) for i, t, _ in rows)
    none = labels.limit(0)
    assert quality.judge(documents(spark, []), none).count() == 0
    kept = quality.keep_good(documents(spark, rows), none)
    assert kept.schema == documents(spark, rows).schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "9", "None"]


def test_rules_are_grown_pruned_and_ordered():
    rng = np.random.default_rng(0)
    a, b, noise = rng.random(3000), rng.random(3000), rng.random(3000)
    bad = (a > 0.8) & (b < 0.5) | (b > 0.95)
    rules = quality.learn({"a": a, "b": b, "noise": noise}, bad, np.arange(3000) % 3 != 0)
    got = np.zeros(3000, bool)
    for rule in rules:
        got |= quality._covers(rule, {"a": a, "b": b, "noise": noise}, 3000)
    assert (got == bad).mean() > 0.98
    assert all(t.feature != "noise" for rule in rules for t in rule)


def test_nothing_is_learned_from_noise():
    rng = np.random.default_rng(1)
    assert quality.learn({"x": rng.random(900)}, rng.random(900) < 0.3,
                         np.arange(900) % 3 != 0) == []


def test_repeated_words():
    assert quality.repeated_words(np.array([0, 1, 2, 0, 1, 2])) == 6
    assert quality.repeated_words(np.array([0, 0, 0, 0])) == 4
    assert quality.repeated_words(np.array([0, 1, 2])) == 0
    assert quality.repeated_words(np.array([], int)) == 0
