"""Match names against a large catalogue table, without comparing every name to every entry.

The score is that of `matching.name_score`. A pair that reaches the wanted score is equal, or one name
is inside the other, or most of their tokens agree. Each case has an index of its own:

- One inside the other: the shorter one's rarest piece of three letters is a piece of the longer one.
- Most tokens agree: with tokens in order of rarity, the first few of both sets share one (with a
  Jaccard similarity of t or more, a set of n tokens needs only its first n - ceil(t n) + 1).

Only pairs that meet in an index are scored, inside the join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.functions.text import fold
from casefuse.operators.matching import MIN_SCORE, name_score
from casefuse.sources.tables import written

GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """Distinct pieces of `size` letters of a text; none where it is shorter."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(text, i, size)))).otherwise(
        F.array().cast("array<string>"))


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs `inner, outer` of folded names of which the first is part of the second.

    A name shorter than a piece is its own piece, so the longer ones give pieces of 1 to 3 letters.
    """
    long = F.col("folded")
    pieces = outer.select(long.alias("outer"), F.explode(F.concat(
        *[grams(long, F.lit(n)) for n in range(1, GRAM + 1)])).alias("piece"))
    pieces = written(pieces, "pieces")
    often = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.lit(GRAM), F.length("folded"))
    mine = inner.select(F.col("folded").alias("inner"), F.explode(grams(F.col("folded"), size)).alias("piece"))
    rarest = mine.join(often, "piece").groupBy("inner").agg(
        F.min(F.struct("n", "piece")).alias("best")).select("inner", F.col("best.piece").alias("piece"))
    return written(rarest, "rarest").join(pieces, "piece").where(
        F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def _alike(names: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Pairs `name, entry` of folded names whose token sets have a Jaccard similarity of `least`."""
    sets = names.select(F.lit(0).alias("side"), "folded").unionByName(
        entries.select(F.lit(1).alias("side"), "folded")).select(
        "side", "folded", F.array_distinct(F.split("folded", " ")).alias("tokens"))
    tokens = written(sets.select("side", "folded", "tokens", F.explode("tokens").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(written(often, "token_counts"), "token").groupBy("side", "folded").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    size = F.size("t")
    prefix = F.slice("t", F.lit(1), (size - F.ceil(F.lit(least) * size - 1e-9) + 1).cast("int"))
    keyed = written(ranked.select("side", "folded", size.alias("size"), F.explode(prefix).alias("k")).select(
        "side", "folded", "size", F.col("k.token").alias("token")), "prefixes")
    a = keyed.where("side = 0").alias("a")
    b = keyed.where("side = 1").alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (
        F.least("a.size", "b.size") >= F.lit(least - 1e-9) * F.greatest("a.size", "b.size")))
    return met.select(F.col("a.folded").alias("name"), F.col("b.folded").alias("entry")).distinct()


def match_catalogue(fields: DataFrame, catalogue: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The columns of `fields` with `canonical, score`: the best entry for each `field_name`.

    `catalogue(canonical, ord)` may be of any size. Entries below `min_score` count as none (null and
    0); ties go to the smallest `ord`. Blank names and entries match nothing, repeated names are
    matched once. A hot token or piece is split by the runtime, as both sides are plain tables.
    """
    entries = written(catalogue.select("canonical", "ord", fold(F.col("canonical")).alias("folded")).where(
        "folded <> ''"), "entries")
    entries_ = entries.select("folded").distinct()
    named = fields.withColumn("_folded", fold(F.col("field_name")))
    names = written(named.select(F.col("_folded").alias("folded")).where("folded <> ''").distinct(), "names")
    pairs = _inside(names, entries_).select(F.col("inner").alias("name"), F.col("outer").alias("entry")).unionByName(
        _inside(entries_, names).select(F.col("outer").alias("name"), F.col("inner").alias("entry")))
    least = min_score / 0.7
    if least <= 1:
        pairs = pairs.unionByName(_alike(names, entries_, least))
    first = entries.groupBy("folded").agg(F.min(F.struct("ord", "canonical")).alias("first"))
    score = name_score(F.col("name"), F.col("entry"))
    scored = pairs.distinct().withColumn("score", score).where(F.col("score") >= min_score)
    best = scored.join(first, scored["entry"] == first["folded"]).groupBy("name").agg(F.max(F.struct(
        "score", (-F.col("first.ord")).alias("ord"), F.col("first.canonical").alias("canonical"))).alias("best"))
    best = written(best, "best")
    return named.join(best, named["_folded"] == best["name"], "left").select(
        *fields.columns, F.col("best.canonical").alias("canonical"),
        F.coalesce("best.score", F.lit(0.0)).alias("score"))
