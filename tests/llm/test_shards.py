import zlib
from collections import defaultdict

from casefuse.llm import shards
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents


def check(rows, docs, n, slack):
    """Rows against documents (id, text); shard sizes within `slack` of their mean."""
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                  for i, t in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / n
    assert all(abs(size[k] - mean) <= slack * mean for k in range(n))
    return where


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text").collect()]
    check(QUERIES["op2_sharding_kd_tree"](spark, sf).collect(), docs, 40, 0.15)


def test_equal_rows_and_hot_values(spark):
    """A third of all rows in one source, and one text that outweighs a shard."""
    rows = [(i, f"text {i} " + "x" * (i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    rows += [(1000 + i, "the same text again", "hot") for i in range(300)]
    rows += [(7, "pair", "a")] * 2
    got = shards.kd_shards(documents(spark, rows), 8).collect()
    where = check(got, [r[:2] for r in rows], 8, 0.03)
    assert len(where[zlib.crc32(b"pair")]) == 1


def test_awkward_rows(spark):
    rows = awkward(50)
    check(shards.kd_shards(documents(spark, rows), 1).collect(), [r[:2] for r in rows], 1, 0)
    got = shards.kd_shards(documents(spark, rows), 5, dimensions=["source", "no_such"]).collect()
    check(got, [r[:2] for r in rows], 5, 4)
    assert shards.kd_shards(documents(spark, []), 4).count() == 0


def test_leaves_reach_the_target(spark):
    rows = [(i, "x" * 84, "a") for i in range(200)]
    got = shards.kd_shards(documents(spark, rows), target_bytes=2500).collect()
    check(got, [r[:2] for r in rows], 8, 0.1)


def test_a_cut_separates_values(spark):
    """With two shards and one dimension, all of one shard lies below all of the other."""
    docs = documents(spark, [(i, f"{i:05}" + "y" * (i % 17), f"{i:03}") for i in range(400)])
    got = {r.doc_id: r.shard for r in shards.kd_shards(docs, 2, dimensions=["source"]).collect()}
    assert max(i for i, s in got.items() if s == 0) < min(i for i, s in got.items() if s == 1)


def test_values_that_begin_alike_are_told_apart(spark):
    """One source a shard, whatever their names share, as with eight equal sources."""
    rows = [(i, f"{i:06}", f"https://www.site{i % 8}.example") for i in range(4000)]
    got = shards.kd_shards(documents(spark, rows), 8, dimensions=["source"]).collect()
    held = {(r.shard, rows[r.doc_id][2]) for r in got}
    assert len(held) == 8


def test_null_metadata_come_first_also_before_negative_numbers(spark):
    df = spark.createDataFrame([(i, f"{i:03}", None if i < 100 else float(-i)) for i in range(200)],
                               "doc_id long, text string, at double")
    got = shards.kd_shards(df, 2, dimensions=["at"]).collect()
    assert {r.doc_id < 100 for r in got if r.shard == 0} == {True}


def test_share_of_a_shard_that_equal_texts_may_fill(spark):
    rows = [(i, f"{i % 20:02}" * 40, "a") for i in range(400)]

    def most(share):
        where = {}
        for r in shards.kd_shards(documents(spark, rows), 5, group_share=share).collect():
            where.setdefault(r.text_crc32, set()).add(r.shard)
        return max(map(len, where.values()))
    assert most(None) == 1 and most(0.5) == 1 and most(0.02) > 1
