import zlib
from hashlib import sha256

from casefuse.llm import merkle
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    texts = [None if v is None else str(v) for v in values]
    return h(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def tree(nodes):
    """(root, proof of every node as a list of sibling lists and own place)."""
    proofs, at, layer = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(layer) > 1:
        for i, place in enumerate(at):
            first = place - place % 3
            run = layer[first:first + 3]
            proofs[i].append((run[:place - first], run[place - first + 1:]))
            at[i] = place // 3
        layer = [h(*layer[i:i + 3]) for i in range(0, len(layer), 3)]
    return layer[0] if layer else None, proofs


def expected(rows):
    """Rows of the report, sorted; `rows` holds (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((leaf_of(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, found in by_source.items():
        found.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = tree([d for d, _ in found])
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for place, s in enumerate(order):
        subroot, proofs = trees[s]
        for (leaf, r), proof in zip(by_source[s], proofs):
            i, text = r[0], r[4]
            whole = proof + upper[place]
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf_of(*r[:4], text)
            for left, right in whole:
                at = h(*left, at, *right)
            siblings = h(*[d for left, right in whole for d in left + right])
            out.append((i, leaf, subroot, root, siblings, at, at == root))
    return sorted(out, key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def report(df):
    return sorted(map(tuple, merkle.manifest_report(df).collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    want = expected(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))
    got = QUERIES["op12_merkle_superblocks"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_many_superblocks_hot_and_many_groups(spark, monkeypatch):
    rows = [(i, f"line {i}\nmore", "hot") for i in range(1, 200)]
    rows += [(1000 + i, f"t{i}\n", f"s{i % 60}") for i in range(85)]
    rows += [(2000, "one\n", None), (2001, None, None), (2002, "é\n", "é"), (2003, "z", "z")]
    docs = documents(spark, rows)
    want = expected(rows_of(docs))
    for levels in (1, 2, 3):    # from a superblock of one run to three levels of superblocks
        monkeypatch.setattr(merkle.manifest, "__defaults__",
                            (*merkle.manifest.__defaults__[:-1], levels))
        assert report(docs) == want


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    assert report(docs) == expected(rows_of(docs))
    assert merkle.manifest_report(docs.limit(0)).count() == 0
    one = documents(spark, [(5, "alone\n", "s")])
    assert report(one) == expected(rows_of(one))
    assert merkle.manifest(one).collect()[0].proof == ""


def test_other_columns_and_proofs(spark):
    docs = documents(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(7)])
    rows = merkle.manifest(docs, columns=("doc_id", "line"), group="lang").collect()
    assert sorted(r.id for r in rows) == list(range(7))
    for r in rows:
        assert r.leaf == leaf_of(r.id, "x") == r.claim
        assert merkle.folded(r.leaf, r.proof) == r.root == r.subroot
