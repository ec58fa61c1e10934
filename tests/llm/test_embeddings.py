import numpy as np

from casefuse.llm.embeddings import Hashing, hadamard, link_vectors, verified
from casefuse.llm.queries import QUERIES
from tests.llm.common import groups


def brute(ids, vectors, threshold=0.95):
    good = [i for i, v in enumerate(vectors) if v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for a, i in enumerate(good) for j in good[a + 1:]
             if len(vectors[i]) == len(vectors[j]) and np.dot(vectors[i], vectors[j]) / (
                 np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])) >= threshold]
    group = groups(len(ids), links)
    low = {}
    for i, g in zip(ids, group):
        low[g] = min(filter(lambda x: x is not None, (low.get(g), i)), default=None)
    n = np.bincount(np.array(links, int).ravel(), minlength=len(ids))
    return sorted(((i, int(k), low[g], None if i is None or low[g] is None else i == low[g])
                   for i, k, g in zip(ids, n, group)), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near(rng, base, cosine):
    side = rng.normal(size=len(base))
    side -= side @ base * base / (base @ base)
    side *= np.linalg.norm(base) / np.linalg.norm(side)
    return cosine * base + np.sqrt(1 - cosine ** 2) * side


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = collected(QUERIES["op7_embedding_cross_polytope"](spark, sf))
    assert got == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_planted_links_of_every_kind(spark):
    """Pairs close to the threshold on both sides, chains, copies, a large group, odd vectors."""
    rng = np.random.default_rng(2)
    vectors = []
    for i in range(120):
        base = rng.normal(size=24)
        vectors += [base, near(rng, base, 0.951 + 0.0004 * i), near(rng, base, 0.9495)]
    hub = rng.normal(size=24)
    vectors += [hub * 3] * 4 + [near(rng, hub, 0.99) for _ in range(200)]
    vectors = [v.tolist() for v in vectors]
    vectors += [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] + [1.0] * 23,
                [1.0, 2.0], [2.0, 4.0], [1.0], [-1.0], [3.0], [1e-300] * 24, [1e300] * 24]
    ids = list(range(len(vectors)))[::-1]
    ids[5] = ids[6] = None
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vectors)],
                               "vec_id long, embedding array<double>, cid int, key string")
    got, want = collected(link_vectors(df)), brute(ids, [
        None if v is None else [x / 1e300 if x and abs(x) > 1e290 else x * 1e300 if x and abs(
            x) < 1e-290 else x for x in v] for v in vectors])
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= true and found >= 0.999 * true
    assert sum(a == b for a, b in zip(got, want)) >= len(want) - 4
    assert link_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([near(rng, v, 0.95) for v in x])
    (s, a), (t, b) = Hashing().codes(x), Hashing().codes(y)
    met = (a == t[:, :, None]).any(2) | (b == s[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.999


def test_hadamard_keeps_lengths():
    y = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(hadamard(y), axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(hadamard(hadamard(y)), y)


def test_settings_follow_the_count_and_keep_recall():
    settings = [Hashing.for_count(n, 64) for n in (0, 1, 1 << 17, 1 << 18, 1 << 24, 1 << 26, 1 << 33)]
    assert [(h.rotations, h.tables) for h in settings] == [
        (3, 10), (3, 10), (3, 10), (4, 17), (4, 17), (5, 25), (6, 36)]
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for how in (settings[0], settings[3], settings[5]):
        (held_a, asked_a), (held_b, asked_b) = how.codes(a), how.codes(b)
        met = (asked_a == held_b[:, :, None]).any((1, 2)) | (asked_b == held_a[:, :, None]).any((1, 2))
        assert met.mean() >= 0.999


def test_keys_do_not_depend_on_the_batch():
    """One row is transformed, many are multiplied by a matrix; ties and odd widths included."""
    rng = np.random.default_rng(4)
    for dim in (1, 2, 5, 64):
        x = np.concatenate([rng.normal(size=(300, dim)), np.ones((1, dim)), np.eye(dim)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for how in (Hashing(), Hashing.for_count(1 << 20, 64)):
            stored, asked = how.codes(x)
            for i in (0, 7, 300, len(x) - 1):
                home, probes = how.table(x[i:i + 1], 2)
                assert home[0] == stored[i, 2] and (probes[0] == asked[i, 2]).all()
            assert (asked[:, :, 0] == stored).all()


def test_classes_are_hashed_once_and_shuffled_by_bucket_without_vectors(spark):
    rows = [(i, [float(i), 1.0], 1) for i in range(20)]
    classes = spark.createDataFrame(rows, "cid long, vector array<float>, members long")
    plan = verified(classes, 0.95, Hashing())._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    assert sum("MapInArrow" in line for line in lines) == 2  # the keys, and the links of tiles
    by_key = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(key#" in line
              and "lo#" not in line]
    assert len(by_key) == 1
    made = next(line for line in lines[by_key[0]:] if "MapInArrow" in line)
    assert "seeker" in made and "vector" not in made.rsplit("[", 1)[1]


def test_only_copies_are_joined_by_vector(spark):
    """Rows of a vector of its own come from its class, which is read without vectors."""
    vectors = [[1.0, 2.0], [1.0, 2.0], [2.0, -1.0], [3.0, 3.0]]
    ids = [1, 2, 3, None]
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")
    out = link_vectors(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema: ")[1] for line in plan.split("\n") if "ReadSchema: " in line]
    assert any("first:" in x and "vector:" not in x for x in read)
    assert all("array<double>" not in x for x in read)
    assert collected(out) == brute(ids, vectors)


def test_links_do_not_depend_on_the_size_of_tiles(spark):
    """Buckets of several chunks, of one large and of one small tile; two lengths of vectors."""
    rng = np.random.default_rng(6)
    hubs = [rng.normal(size=dim) for dim in (24, 24, 8)]
    vectors = [near(rng, hub, 0.985).tolist() for hub in hubs for _ in range(70)]
    vectors += rng.normal(size=(30, 24)).tolist()
    want = {i: n for i, n, _, _ in brute(list(range(len(vectors))), vectors) if n}
    classes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)],
                                    "cid long, vector array<double>, members long")
    for size in (8, 512):
        rows = verified(classes, 0.95, Hashing(), size).where("b IS NULL").groupBy("a").sum("add")
        assert {r[0]: r[1] for r in rows.collect()} == want
