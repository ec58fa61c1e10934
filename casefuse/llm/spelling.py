"""Groups of spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words one edit apart the shorter one (either, if they are of one length) is cut into two
disjoint chunks; the other contributes positional grams of the chunks' lengths. The edit falls into
one chunk, so the other chunk is one of these grams: left of the edit at its own place, right of it
shifted by the difference in length, which is one at most. A gram farther away cannot meet a chunk,
so only those within that shift are made, and they join on the chunk, its place and the length. The
half that holds the edit is cut in two again and one part of it is joined on likewise, so that a
common chunk does not bring half the vocabulary together. What meets is verified by its distance.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, written

RUN = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """Letter runs of at least `min_length`, whole, with A-Z in small letters."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN % min_length),
                                F.lit(0))


def damaged(key: Column, run: Column, one_in: int) -> Column:
    """The run, in one of about `one_in` (key, run) pairs without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                one_in: int = None) -> DataFrame:
    """`word, n` of all texts, for words of `min_count` and more; counts are combined before they
    are shuffled. With `one_in`, runs are damaged first."""
    found = docs.select(F.col(f"`{id_col}`").alias("key"), F.explode(
        runs(F.col(f"`{text_col}`"), min_length)).alias("word"))
    if one_in:
        found = found.select(damaged(F.col("key"), F.col("word"), one_in).alias("word")).where(
            F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _pieces(length: Column) -> list:
    """(start, end) of the four quarters of a word; the first two and the last two are its chunks."""
    at = [F.lit(0), *[F.floor(length * i / 4).cast("int") for i in (1, 2, 3)], length]
    return list(zip(at, at[1:]))


def _keys(word: Column, length: Column, longer: int) -> list:
    """For words of the given length, the four keys of a word that is `longer` by 0 or 1.

    Key i leaves out quarter i: it is the whole chunk without the edit and the unedited part of the
    other one. Chunks and parts right of the quarter are looked for `longer` places on.
    """
    keys = []
    for i, (start, end) in enumerate(_pieces(length)):
        left = F.substring(word, F.lit(1), start)
        right = F.substring(word, end + 1 + longer, F.length(word))
        keys.append(mix64(F.lit(i), length, left, right, seed=13))
    return keys


def near_words(words: DataFrame) -> DataFrame:
    """`a, a_n, b, b_n`: every pair of words one edit apart, once; `words` holds distinct `word, n`.

    The distance is checked inside the join, so no other pair leaves it.
    """
    size = F.length("word")
    chunks = words.select(F.explode(F.array(*_keys(F.col("word"), size, 0))).alias("key"),
                          "word", "n")
    grams = words.select(F.explode(F.concat(
        F.array(*_keys(F.col("word"), size, 0)), F.array(*_keys(F.col("word"), size - 1, 1)))).alias(
            "key"), "word", "n")
    chunks, grams = written(chunks, "chunks"), written(grams, "grams")
    a, b = F.col("a.word"), F.col("b.word")
    ahead = (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a < b))
    return chunks.alias("a").join(
        grams.alias("b"), (F.col("a.key") == F.col("b.key")) & ahead
        & (F.levenshtein(a, b, 1) == 1)).select(
        a.alias("a"), F.col("a.n").alias("a_n"), b.alias("b"), F.col("b.n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """`word, root` for `word, form`: the end of the chain of forms, which must not run in a circle.

    Each round doubles the reach; only the number of words that moved reaches the driver.
    """
    count = F.count(F.lit(1))
    at, seen = written(forms.select("word", F.col("form").alias("root")), "roots", n=count)
    while seen["n"]:
        step, seen = written(at.alias("l").join(
            at.alias("r"), F.col("l.root") == F.col("r.word"), "left").select(
            "l.word", F.coalesce("r.root", "l.root").alias("root"),
            F.col("r.root").isNotNull().alias("moved")), "roots", n=F.count_if("moved"))
        at = step.drop("moved")
    return at


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for distinct `word, n`.

    A word's form is the word one edit away with the largest n (ties: the smallest word) if that is
    `ratio` times its own or more, else null; `root` is the end of the chain of forms.
    """
    words = written(words, "words")
    pairs = written(near_words(words), "near_words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"),
                                          F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("b_n"), "b")).alias("best"))
    rows = words.join(best, words["word"] == best["a"], "left")
    accepted = -F.col("best.col1") >= ratio * F.col("n")
    rows = written(rows.select(
        "word", F.when(accepted, F.col("best.b")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, -F.col("best.col1")).alias("form_n")), "forms")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return rows.join(ends, rows["word"] == ends["of"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, one_in: int = None) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of all words of the texts, as in `group_variants`.

    A null or empty text has no words, a null id counts as an empty one where runs are damaged.
    Repeated rows count each, an empty table gives no rows, further columns are ignored.
    """
    return group_variants(count_words(docs, id_col, text_col, min_length, min_count, one_in), ratio)
