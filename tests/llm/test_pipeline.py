import corpus_pipeline as P
from casefuse.llm import quality
from casefuse.llm.common import written
from tests.llm.common import documents, words
from tests.llm.test_mixing import targets
from tests.llm.test_quality import plain
from tests.llm.test_jaccard import kept


def test_every_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), "stage")
        rows[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == columns
    before, after = rows["quality rules"]
    good = {r.doc_id for r in after}
    for r in before:
        n, _, symbols, _, repeated = plain(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in good
        elif not symbols:
            assert r.doc_id in good
    before, after = rows["line dedup"]
    old = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(old)
    for r in after:
        left = iter(old[r.doc_id].split("\n"))
        assert not r.text or all(line in left for line in r.text.split("\n"))
    before, after = rows["near dedup"]
    assert sorted(r.doc_id for r in after) == kept(
        [r.doc_id for r in before], [r.text for r in before])
    before, after = rows["mix"]
    sizes, got, size = {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
        size[r.doc_id] = len(words(r.text))
    taken = {}
    for r in after:
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    assert all(abs(got.get(s, 0) - t) <= 0.5 + 1e-6 for s, t in targets(sizes).items())
    assert all(n <= 3 * size[i] for i, n in taken.items())
    before, after = rows["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    tokens = {}
    for r in after:
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
    assert max(tokens.values()) <= 4096
    assert len(tokens) <= sum(tokens.values()) / 4096 * 1.02 + 1


def test_stages_keep_extra_columns_and_take_empty_tables(spark, sf):
    docs = documents(spark, [(i, " ".join(f"w{i}x{k}" for k in range(60)), "a") for i in range(5)])
    assert docs.count() and quality.STATS
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                        "sequence_id", "offset"]
