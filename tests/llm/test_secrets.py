import hashlib
import random
import re
import string

from casefuse.llm import secrets
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents

KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]


def plain(text):
    """Base spans, matched step by step instead of by one pattern."""
    t, found, i = text or "", [], 0
    safe = set(string.ascii_letters + string.digits + "+/_.=-")
    while i < len(t):
        word = next((k for k in KEYWORDS if t[i:i + len(k)].isascii()
                     and t[i:i + len(k)].lower() == k), None)
        j = i + len(word) if word else i
        if word:
            j += j < len(t) and t[j] in "\"'"
            while j < len(t) and t[j] == " ":
                j += 1
            if j < len(t) and t[j] in ":=":
                j += 1
                while j < len(t) and t[j] == " ":
                    j += 1
                j += j < len(t) and t[j] in "\"'"
                k = j
                while k < len(t) and t[k] in safe:
                    k += 1
                if k > j:
                    if k - j >= 6:
                        found.append((i, 0, k))
                    i = k
                    continue
        i += 1
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t)
              if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(found)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        base = plain(t)
        line = secrets.span_list(base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == (line.split(",") if line else [])


def test_query_equals_brute_force(spark, sf):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op4_secret_randomness"](spark, sf).collect()
    check(rows, [docs[r.doc_id] for r in rows])


def test_awkward_texts(spark):
    texts = ["Token: 'abcdef'", "SECRET=ab password = hunter2x", "secret: token: abcdefgh",
             "apı_key=abcdefgh api_key\"  :  \"k9-_/+=.z", "ſecret=abcdefg", "token==abcdef",
             "x" * 50 + "AKIA" + "Z" * 16 + " AKIASHORT", "f" * 24 + "F" + "0" * 23, "é" * 9 + "a" * 30,
             "password=" * 3 + "abcdefg", None, ""] + [t for _, t, _ in awkward()]
    rows = secrets.find_secrets(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    check(sorted(rows.collect(), key=lambda r: r.doc_id), texts)
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_random_strings_are_found_and_ordinary_ones_left(spark):
    rng = random.Random(4)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
                 string.ascii_uppercase + "234567"]
    planted = ["".join(rng.choices(alphabets[i % 3], k=40 + i % 20)) for i in range(300)]
    plain_words = ["internationalisation", "com/library/articles/bridges", "SomeVeryLongClassName",
                   "user-2024-01-02-0003", "aaaaaaaaaaaaaaaaaaaa1", "01234567890123456789a",
                   "CONTENT_LENGTH_EXCEEDED", "path/to/some/file/name"]
    texts = [f"see {s} here" for s in planted] + [f"the {w} of" for w in plain_words * 40]
    rows = secrets.find_secrets(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    hit = {r.doc_id for r in rows.collect() if "random" in r.spans}
    assert len([i for i in hit if i < 300]) >= 270
    assert not [texts[i] for i in hit if i >= 300]


def test_random_values_behind_signs_and_quotes(spark):
    rng = random.Random(7)
    alnum = string.ascii_letters + string.digits
    forms = ["aws_secret_access_key={}", "DB_PWD={} x", "https://x.y/?sig={}&z", "key: {}", "k:{}",
             "a = '{}'", 'a="{}"', "x=={}"]
    values = ["".join(rng.choices(alnum, k=40)) for _ in range(160)]
    texts = [forms[i % 8].format(v) for i, v in enumerate(values)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    for form in range(8):
        hit = [f"random:{texts[i].index(v)}:{texts[i].index(v) + 40}" in found[i]
               for i, v in enumerate(values) if i % 8 == form]
        assert sum(hit) >= 18, forms[form]


def test_random_segments_of_paths(spark):
    rng = random.Random(8)
    alnum = string.ascii_letters + string.digits
    forms = ["https://hooks.example.com/my-app/{}", "https://example.com/library/articles/{}/view",
             "get a_b/c-d/{}/some-name now", "one-two+three_four-{}"]
    values = ["".join(rng.choices(alnum, k=36)) for _ in range(160)]
    texts = [forms[i % 4].format(v) for i, v in enumerate(values)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    for form in range(4):
        hit = [f"random:{texts[i].index(v)}:{texts[i].index(v) + 36}" in found[i]
               for i, v in enumerate(values) if i % 4 == form]
        assert sum(hit) >= 36, forms[form]


def test_noncentral_distribution():
    """Against a simulated sum of squared normals."""
    rng = random.Random(1)
    draws = [sum(rng.gauss(3 if i == 0 else 0, 1) ** 2 for i in range(8)) for _ in range(20000)]
    for x in (8, 14, 20, 30):
        assert abs(sum(d <= x for d in draws) / 20000 - secrets._normal_cdf(
            secrets.noncentral_score(x, 8, 9.0))) < 0.02
