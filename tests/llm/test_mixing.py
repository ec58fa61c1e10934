from collections import defaultdict

from pyspark.sql import functions as F

from casefuse.llm import mixing
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents, words


def targets(sizes):
    """Sources share by weight; one that is full stops, until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        share = left / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return {**{s: share * weight[s] for s in free}, **full}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def check(rows, docs):
    """Report rows against documents (id, text, source)."""
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(words(t))
    want = targets(sizes)
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted(
        (str(i), len(words(t))) for i, t, _ in docs)
    source = {i: s for i, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text", "source").collect()]
    rows = QUERIES["op3_mixing_block_slots"](spark, sf).collect()
    check(rows, docs)
    again = QUERIES["op3_mixing_block_slots"](spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_full_sources_and_awkward_rows(spark):
    rows = [(i + 100, " ".join("w" * (1 + k % 3) for k in range(i)), s)
            for i, s in zip(range(1, 60), ["a", "b", "b", "b", "", "é", None, "zz"] * 8)]
    check(mixing.mix_report(documents(spark, rows), block=8).collect(), rows)
    odd = [(i, *r[1:]) for i, r in enumerate(awkward())]
    check(mixing.mix_report(documents(spark, odd)).collect(), odd)
    assert mixing.mix_report(documents(spark, [])).count() == 0
    blank = [(1, None, "a"), (2, " ", None)]
    check(mixing.mix_report(documents(spark, blank)).collect(), blank)
    assert mixing.mixed_documents(documents(spark, blank)).count() == 0


def test_permutations(spark):
    for n in (1, 2, 3, 7, 64, 100, 1000):
        got = [r.x for e in (0, 1) for r in spark.range(n).select(mixing.permuted(
            F.col("id"), F.lit(n).cast("long"), F.lit(e), seed=1).alias("x")).collect()]
        assert sorted(got[:n]) == list(range(n)) == sorted(got[n:])
        assert n < 64 or got[:n] != got[n:]


def test_blocks_and_documents_hold_the_words_taken(spark):
    rows = [(i, "\n".join(f"d{i}w{k}" for k in range(3 + i * 5 % 40)), "abc"[i % 3] * (i % 2 + 1))
            for i in range(60)]
    docs = documents(spark, rows)
    report = {r.doc_id: r for r in mixing.mix_report(docs, block=16).collect()}
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    count, seen = defaultdict(int), defaultdict(list)
    for r in mixed.collect():
        count[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text) and r.row.a == 1
        assert set(words(r.text)) <= set(words(rows[r.doc_id][1]))
        assert len(set(words(r.text))) == len(words(r.text))
    assert all(count[i] == report[i].taken for i in report)
    blocks = mixing.mixed_blocks(docs, block=16).collect()
    for b in blocks:
        for w in words(b.text):
            seen[int(w.split(b"w")[0][1:])].append(w)
    assert {i: len(w) for i, w in seen.items()} == {i: r.taken for i, r in report.items() if r.taken}
    places = sorted((b.shard, b.slot) for b in blocks)
    assert places == [(i // mixing.SHARD_SLOTS, i % mixing.SHARD_SLOTS) for i in range(len(blocks))]


def test_counts_of_a_shard_vary_about_their_share(spark):
    sources = spark.createDataFrame([("a", 0, 64000, 5, 64000.0), ("b", 1, 64000, 2, 25600.0)],
                                    "source string, sid long, source_size long, weight int, target double")
    got = mixing.slots(sources, block=16, shard_slots=100).groupBy("shard").agg(
        F.count_if(F.col("sid") == 0).alias("a"), F.count("*").alias("n")).collect()
    full = [r for r in got if r.n == 100]
    share = 64000 / 89600
    assert len(full) == 56 and len({r.a for r in full}) > 5
    # Multinomial up to the last shards, where draws over a target are settled.
    early = sorted(full, key=lambda r: r.shard)[:50]
    assert all(abs(r.a - 100 * share) < 25 for r in early)
    spread = sum((r.a - 100 * share) ** 2 for r in early) / (100 * share * (1 - share))
    assert 25 < spread < 85
