import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casefuse.llm import simhash
from casefuse.llm.components import components
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents, groups, words


def plain_simhash(text):
    w = [x.lower() for x in words(text)]
    runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fp = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    near = [(i, int(j)) for i in range(len(fp))
            for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2)]
    group = groups(len(fp), near)
    low = {}
    for (i, _), g in zip(rows, group):
        low[g] = min(filter(lambda x: x is not None, (low.get(g), i)), default=None)
    return sorted(((i, f"{int(f):016x}", low[g]) for (i, _), f, g in zip(rows, fp, group)), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = collected(QUERIES["op5_simhash_bit_sliced"](spark, sf))
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    rows = awkward()
    got = collected(simhash.near_duplicates(documents(spark, rows)))
    assert got == expected([r[:2] for r in rows])


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_one_row_of_each_component_stays_whole(spark):
    rows = awkward()
    docs = documents(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    got = kept.select("doc_id", "text", "row").collect()
    want = {(c, f) for _, f, c in expected([r[:2] for r in rows])}  # none links two fingerprints
    assert sorted(r.doc_id for r in got) == sorted(c for c, _ in want)
    assert all(r.row.a == 1 for r in got)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 8, np.uint64)
    lanes = np.array([base[i % 8] ^ np.uint64(sum(1 << int(b) for b in rng.choice(
        64, i % 6, replace=False))) for i in range(192)], np.uint64)
    q, w = (x.ravel() for x in np.meshgrid(np.arange(192), np.arange(3), indexing="ij"))
    hit = simhash.close_lanes(lanes, simhash.planes_of(lanes), q, w, radius)
    bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    want = np.bitwise_count(lanes[:, None] ^ lanes[None, :]) <= radius
    assert np.array_equal(bits.reshape(192, 192).astype(bool), want)


def test_hot_bucket_is_cut_into_tiles(spark):
    """Fingerprints that share most blocks, with tiles far smaller than the bucket."""
    rng = np.random.default_rng(3)
    fps = sorted({int(rng.integers(0, 1 << 14)) for _ in range(600)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.close_links(df, size=32)
    found = {r.node: r.component for r in components(links).collect()}
    near = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps)
            if i < j and (a ^ b).bit_count() <= 2]
    want = groups(len(fps), near)
    assert all(found.get(f, f) == fps[want[i]] for i, f in enumerate(fps))


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7)]
    df = spark.createDataFrame(links, "b long, a long").withColumn("a", F.col("a"))
    got = {r.node: r.component for r in components(df.select("a", "b")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(300)}}
