import random

import corpus_pipeline as P
from casefuse.llm import jaccard
from tests.llm.common import awkward, documents, groups, words


def plain_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def near_pairs(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j]
            or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]


def kept(ids, texts):
    group = groups(len(texts), near_pairs(plain_sets(texts)))
    low = {}
    for i, g in zip(ids, group):
        low[g] = min(low.get(g, i), i)
    return sorted(low.values())


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_stage_equals_brute_force_jaccard(spark, sf):
    """Copies with some words changed, at similarities on both sides of 0.8."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200)))
        texts += [base] + [edited(rng, base, rng.randrange(6)) for _ in range(3)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = kept(ids, texts)
    assert 40 < len(want) < 160
    docs = documents(spark, [(i, t, "s") for i, t in zip(ids, texts)])
    got = dict(P.STAGES)["near dedup"](spark, docs, sf)
    assert got.schema == docs.schema
    assert sorted(r.doc_id for r in got.collect()) == want


def test_a_group_over_several_tiles(spark):
    rng = random.Random(6)
    base = " ".join(f"w{i}" for i in range(150))
    texts = [edited(rng, base, 3) for _ in range(90)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    from pyspark.sql import functions as F

    from casefuse.llm.common import written
    rows = written(docs.select("text", F.col("doc_id").alias("at"), jaccard.sketch(
        F.col("text")).alias("s")).select("text", "at", "s.*"), "rows")
    links = jaccard.jaccard_links(rows, F.col("text"), size=8).collect()
    at = {r.whole: r.at for r in rows.collect()}
    pairs = near_pairs(plain_sets(texts))
    assert {(max(at[a], at[b]), min(at[a], at[b])) for a, b in links} <= set(pairs)
    assert groups(90, [(at[a], at[b]) for a, b in links]) == groups(90, pairs)


def test_awkward_rows(spark):
    rows = awkward()
    got = jaccard.drop_near_duplicates(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 6, 7, 8, 9, 9]
    assert jaccard.drop_near_duplicates(documents(spark, [])).count() == 0
