"""Small awkward tables, and a plain union-find."""

CLASHING = ("row struct<a: int>, fp long, at long, size long, start long, key long, source2 string, "
            "stats int, shard int, text_crc32 string, FROM_WORD int, line string, host string")


def documents(spark, rows):
    """`documents` with columns whose names clash with working columns of the operators.

    `rows` holds (doc_id, text, source); every one is given a language and its length.
    """
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    extra = ((1,), 1, 1, 1, 1, 1, "x", 1, 1, "x", 1, "x", "x")
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), *extra) for i, t, s in rows], schema)


def awkward(long_words: int = 30000):
    """Nulls in any column, empty, blank, odd and very long texts, repeated rows."""
    prose = " ".join(f"word{i % 97} more{i % 13}" for i in range(60))
    return [
        (1, prose, "a"), (1, prose, "a"), (2, prose, "b"), (None, prose, None), (3, None, "a"),
        (4, "", "a"), (5, " \n\t ", "b"), (6, "one", None), (7, "one two three four", "b"),
        (8, "é è ß\x85x 日本語 👍🏽", "c"), (9, " ".join(f"w{i}" for i in range(long_words)), "c"),
        (9, "another text of the same id", "c"), (None, None, None)]


def groups(n, links):
    """Smallest member reachable from each of n nodes."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(text):
    return (text or "").encode().split()
