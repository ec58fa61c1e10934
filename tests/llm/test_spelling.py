import random
import re
import zlib
from collections import Counter

from casefuse.llm import spelling
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, least=5, length=6):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts):
    by_length, out = {}, {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        close = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 5 * n else None
        out[w] = (form, n, len(close), counts[form] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_spelling_q_chunks"](spark, sf))
    want = expected(counted(docs))
    assert got == want and any(r[1] for r in want)


def test_every_edit_of_words_of_every_length(spark):
    rng, letters = random.Random(5), "abàÿ"
    counts = {}
    for length in range(1, 16):
        for _ in range(6):
            w = "".join(rng.choice(letters) for _ in range(length))
            for i in range(length + 1):
                for x in (w, w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:],
                          w[:i] + rng.choice(letters) + w[i + 1:]):
                    if x:
                        counts[x] = rng.choice([1, 2, 5, 10, 50, 250, 1250])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.group_variants(df)) == expected(counts)


def test_chains_of_forms_and_ties(spark):
    counts = {"abcdef" + "x" * i: 5 ** (i + 1) for i in range(9)}
    counts |= {"qqqqqq": 5, "qqqqqr": 25, "qqqqqs": 25, "éqqqqq": 25, "alone!": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.group_variants(df))
    assert got == expected(counts)
    assert {r[2] for r in got if r[0].startswith("abcdef")} == {"abcdef" + "x" * 8}


def test_one_hot_chunk(spark):
    rng = random.Random(1)
    counts = {"gemeinsam" + "".join(rng.choice("abcdefgh") for _ in range(9)): rng.choice([5, 30])
              for _ in range(3000)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.group_variants(df)) == expected(counts)


def test_awkward_texts(spark):
    rows = [(i, t, s) for i, t, s in awkward()] + [
        (20, "ÉTUDES Études études ×÷×÷×÷ straße_strasse", "a")] * 6 + [(21, "w" * 50000, None)]
    docs = documents(spark, rows)
    want = expected(counted([(i, t) for i, t, _ in rows]))
    assert rows_of(spelling.spelling_variants(docs, one_in=199)) == want and want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    none = documents(spark, [(1, None, "a"), (2, "", "a"), (3, "12345", None)])
    assert spelling.spelling_variants(none, one_in=199).count() == 0
