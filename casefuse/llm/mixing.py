"""Mixing sources to target weights, in DataFrame functions only.

The words of each source form one stream, cut into fixed-length blocks. The mix is a sequence of
slots dealt to output shards. Every shard draws multinomial counts of its sources, by target, and
deals its slots to them at random. A source drawn more often than its target allows gives its last slots up, and
sources drawn too seldom take them, so totals meet the targets to the word. A source's slots take
its blocks through a pseudorandom permutation of its own, a new one each time the source is used up.
Documents and slots meet on (source, block).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse.llm.common import WORD, mix64, numbered, row_order, unpacked, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block, blocks of an output shard, and the parts a source is numbered in.
BLOCK, SHARD_SLOTS, PARTS = 256, 4096, 1024
#: Tickets of a bin in which draws look for their source.
BIN = 64


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(i: Column, n: Column, *key: Column, seed: int) -> Column:
    """A pseudorandom permutation of 0 .. n-1, chosen by the key, at position i.

    A Feistel network on a grid of a x b >= n cells; an image outside 0 .. n-1 is put through again,
    which ends inside. Fewer than a cells lie outside, so that is needed for about one in sqrt(n).
    """
    a = F.floor(F.sqrt(n.cast("double"))) + 1
    b = F.greatest(F.lit(1), F.ceil(n / a)).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for turn in range(2):
            left = F.pmod(left + F.pmod(mix64(right, *key, seed=seed + 2 * turn), a), a)
            right = F.pmod(right + F.pmod(mix64(left, *key, seed=seed + 2 * turn + 1), b), b)
        return left * b + right

    x = once(i)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(200)), x,
                        lambda y, _: F.when(y >= n, once(y)).otherwise(y))
    return F.when(x < n, x).otherwise(again)


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """`source, sid, source_size, weight, target` of every source.

    Sources in code-point order, null last, get the weights in turn and share all words by weight; a
    target is at most `most` times its source, and what is over goes to the others by weight, again
    and again until none is above. Each such round is one aggregate over the sources, of which three
    numbers reach the driver; sources themselves are numbered by ranges, however many there are.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = numbered(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"])
    turn = F.array(*[F.lit(w) for w in weights])
    named = written(named.select(
        "source", F.col("pos").alias("sid"), "source_size",
        F.element_at(turn, (F.pmod("pos", F.lit(len(weights))) + 1).cast("int")).alias("weight")),
        "sources")
    size, weight = F.col("source_size"), F.col("weight")
    level, full_before = 0.0, -1
    while True:
        full = most * size < F.lit(level) * weight
        seen = named.agg(F.sum(size).alias("all"), F.count_if(full).alias("full"), F.sum(
            F.when(full, most * size).otherwise(0)).alias("taken"), F.sum(
            F.when(full, 0).otherwise(weight)).alias("left")).first()
        if seen["full"] == full_before or not seen["left"]:
            break
        level, full_before = (seen["all"] - seen["taken"]) / seen["left"], seen["full"]
    return named.select("source", "sid", "source_size", "weight", F.least(
        most * size.cast("double"), F.lit(level) * weight).alias("target"))


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """Working rows: id, source, size, two hashes that order the stream, and a row number."""
    both = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       n_words(F.col(f"`{text_col}`")).alias("size"),
                       mix64(F.col(f"`{id_col}`"), both, seed=17).alias("h"),
                       mix64(F.col(f"`{id_col}`"), both, seed=18).alias("h2"),
                       row_order(docs).alias("at"), *more)


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """`at, sid, size, start`: where each document begins in the stream of its source.

    The order is that of a hash, so reruns agree. A source is numbered in PARTS parts and the parts
    in turn, so a large source is spread over many tasks.
    """
    s = sources.select(F.col("source").alias("s"), "sid")
    rows = sized.join(s, F.col("source").eqNullSafe(F.col("s"))).where("size > 0").select(
        "at", "sid", "size", "h", "h2", "doc_id", F.pmod("h", F.lit(PARTS)).alias("part"))
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")
    parts = written(parts.select("sid", "part", before.alias("before")), "parts")
    inside = Window.partitionBy("sid", "part").orderBy("h", "h2", "doc_id", "at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("inner", F.sum("size").over(inside) - F.col("size"))
    return inner.join(parts, ["sid", "part"]).select(
        "at", "sid", "size", (F.col("before") + F.col("inner")).alias("start"))


def draws(sources: DataFrame, total: int, shard_slots: int, seed: int = 0) -> DataFrame:
    """`shard, sid, c`: multinomial counts, of `total` slots that draw their source by its `n`.

    A slot draws one of `total` tickets, and source s holds the `n` tickets from its `pos` on. Both
    meet in bins of BIN tickets, so no pair is looked at that lies farther apart. Draws are counted
    before they are shuffled.
    """
    slots_ = sources.sparkSession.range(total).select(
        F.floor(F.col("id") / F.lit(shard_slots)).alias("shard"), F.pmod(
            mix64(F.col("id"), seed=seed + 211), F.lit(total)).alias("ticket"))
    slots_ = slots_.withColumn("bin", F.floor(F.col("ticket") / F.lit(BIN)))
    first, last = F.floor(F.col("pos") / F.lit(BIN)), F.floor((F.col("pos") + F.col("n") - 1) / F.lit(BIN))
    held = sources.select("sid", "pos", "n", F.explode(F.sequence(first, last)).alias("bin"))
    # Written first: a plan can't tell how many bins come out of a few sources.
    return slots_.join(written(held, "tickets"), "bin").where(
        (F.col("ticket") >= F.col("pos")) & (F.col("ticket") < F.col("pos") + F.col("n"))).groupBy(
        "shard", "sid").agg(F.count(F.lit(1)).alias("c"))


def settled(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """`shard, sid, k, kept, place`: `kept` slots of a shard from place `place` on, which take the
    source's blocks from `k` on.

    Draws of a source beyond its `n` are given up, the last shards first; they go in order to the
    sources that lack some. A shard's places are dealt in the order of its sources.
    """
    in_shard = Window.partitionBy("shard").orderBy("sid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = numbered(drawn, ["sid"], ["shard"], "c").withColumnRenamed("n", "got").join(
        sources.select("sid", "n"), "sid")
    kept = F.greatest(F.lit(0), F.least("c", F.col("n") - F.col("pos")))
    rows = written(rows.select("shard", "sid", F.col("pos").alias("k"), "c", kept.alias("kept"), (
        F.sum("c").over(in_shard) - F.col("c")).alias("place"), "got"), "drawn")
    got = rows.groupBy("sid").agg(F.max("got").alias("got"))
    lacking = sources.select("sid", "n").join(got, "sid", "left").select(
        "sid", F.coalesce("got", F.lit(0)).alias("got"), "n").where("got < n")
    lacking = lacking.select("sid", F.explode(F.sequence("got", F.col("n") - 1)).alias("k"))
    free = rows.where("kept < c").select("shard", F.explode(F.sequence(
        F.col("place") + F.col("kept"), F.col("place") + F.col("c") - 1)).alias("place"))
    free = numbered(free, [], ["shard", "place"])
    taken = numbered(lacking, [], ["sid", "k"]).select("sid", "k", F.col("pos").alias("at"))
    moved = free.join(taken, F.col("pos") == F.col("at")).select(
        "shard", "sid", "k", F.lit(1).cast("long").alias("kept"), "place")
    return rows.where("kept > 0").select("shard", "sid", "k", "kept", "place").unionByName(moved)


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS,
          seed: int = 0) -> DataFrame:
    """`shard, slot, sid, epoch, block, words`: every slot of the mix and the block it takes.

    A source is used up in epochs; the last one stops at the target, to the word. A last block that
    is not full stays last in its epoch.
    """
    size, goal = F.col("source_size"), F.round("target").cast("long")
    s = sources.where(size > 0).select(
        "sid", size.alias("words_all"), F.ceil(size / F.lit(block)).cast("long").alias("blocks"),
        F.floor(size / F.lit(block)).cast("long").alias("full"),
        F.floor(goal / size).cast("long").alias("epochs"), goal.alias("goal"))
    s = s.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("words_all"))
    s = s.withColumn("n_slots", F.col("epochs") * F.col("blocks") + F.ceil(
        F.col("rest") / F.lit(block)).cast("long")).where("n_slots > 0")
    s = numbered(s, [], ["sid"], "n_slots").drop("n").withColumnRenamed("n_slots", "n")
    s, seen = written(s, "sources", total=F.sum("n"))
    total = seen["total"] or 0
    counts = settled(draws(s, total, shard_slots, seed), s).join(s.drop("pos", "n"), "sid")
    each = counts.repartition("shard").withColumn("i", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("kept") - 1)))
    each = each.withColumn("k", F.col("k") + F.col("i")).withColumn("place", permuted(
        F.col("place") + F.col("i"), F.least(F.lit(shard_slots), F.lit(total) - F.col(
            "shard") * F.lit(shard_slots)).cast("long"), F.col("shard"), seed=seed + 307))
    each = each.withColumn("epoch", F.floor(F.col("k") / F.col("blocks")).cast("long")).withColumn(
        "q", F.col("k") - F.col("epoch") * F.col("blocks"))
    own = F.when(F.col("q") < F.col("full"), permuted(
        F.col("q"), F.col("full"), F.col("sid"), F.col("epoch"), seed=seed + 101)).otherwise(
        F.col("q"))
    until = F.when(F.col("epoch") < F.col("epochs"), F.col("words_all")).otherwise(F.col("rest"))
    return each.select(
        "shard", F.col("place").alias("slot"), "sid", "epoch", own.alias("block"),
        F.least(F.lit(block).cast("long"), until - F.col("q") * F.lit(block)).alias("words"))


def pieces(sized: DataFrame, sources: DataFrame, block: int = BLOCK,
           shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """`at, epoch, from_word, words, shard, slot, offset`: what the mix takes of each document.

    Words of a document count from 0; `offset` is the place inside the slot. A document meets a
    block once for each epoch, so no key has more rows than a block has words.
    """
    first = F.floor(F.col("start") / F.lit(block)).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / F.lit(block)).cast("long")
    parts = streams(sized, sources).select("at", "sid", "size", "start", F.explode(
        F.sequence(first, last)).alias("block"))
    # Written first: a plan can't tell how many slots come out of a few sources.
    taken = written(slots(sources, block, shard_slots, seed), "slots")
    met = parts.join(taken, ["sid", "block"])
    base = F.col("block") * F.lit(block)
    low = F.greatest("start", base)
    high = F.least(F.col("start") + F.col("size"), base + F.col("words"))
    return met.where(high > low).select(
        "at", "epoch", (low - F.col("start")).alias("from_word"), (high - low).alias("words"),
        "shard", "slot", (low - base).alias("offset"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of every row.

    A null or blank text has no words and is never taken. Null sources are one source. A null id is
    kept. Repeated rows are separate documents of their source; an empty table gives no rows;
    further columns are ignored. No document is taken more than three times over.
    """
    sized = written(sized_rows(docs, id_col, text_col, source_col), "sized")
    sources = written(source_targets(sized), "sources")
    taken = pieces(sized, sources, block, seed=seed).groupBy("at").agg(
        F.sum("words").alias("taken"))
    known = sources.select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s")))
    return rows.join(written(taken, "taken"), "at", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def _text_parts(text: Column, spans: Column) -> Column:
    """The words of each (from_word, words) span, with the white space inside and between spans
    that touch; other spans are joined by a new line. The text is cut into words once."""
    cut = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def part(words, p, i):
        piece = F.array_join(F.slice(words, (p["from_word"] + 1).cast("int"),
                                     p["words"].cast("int")), "")
        following = F.get(spans, i + 1)["from_word"]
        ended = F.regexp_replace(piece, r"[\x20\x09-\x0D]+$", "")
        return F.when(following.isNull(), ended).when(
            following == p["from_word"] + p["words"], piece).otherwise(F.concat(ended, F.lit("\n")))

    return F.transform(F.array(cut), lambda words: F.array_join(F.transform(
        spans, lambda p, i: part(words, p, i)), ""))[0]


def _with_text(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, seed: int):
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = written(sized_rows(docs, id_col, text_col, source_col, whole), "sized")
    sized = rows.drop("row")
    sources = written(source_targets(sized), "sources")
    return rows.select("at", "size", "row"), pieces(sized, sources, block, seed=seed)


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """`shard, slot, doc_ids, text`: the blocks of the mix in their output places."""
    rows, taken = _with_text(docs, id_col, text_col, source_col, block, seed)
    part = taken.join(rows, "at").select("shard", "slot", F.struct(
        "offset", "at", F.col(f"row.`{id_col}`").alias("doc_id"), _text_parts(
            F.col(f"row.`{text_col}`"), F.array(F.struct("from_word", "words"))).alias(
            "text")).alias("p"))
    parts = F.array_sort(F.collect_list("p"))
    return part.groupBy("shard", "slot").agg(parts.alias("p")).select(
        "shard", "slot", F.col("p.doc_id").alias("doc_ids"),
        F.array_join(F.col("p.text"), "\n").alias("text"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents: a row of `docs` for each time it is taken, cut to the words taken.

    A document taken whole keeps its text as it is; of one taken in part, the parts of one epoch
    follow each other in one row, joined by a new line where they do not touch. `n_chars` follows.
    """
    rows, taken = _with_text(docs, id_col, text_col, source_col, block, seed)
    spans = F.array_sort(F.collect_list(F.struct("from_word", "words")))
    times = taken.groupBy("at", "epoch").agg(spans.alias("spans"), F.sum("words").alias("n"))
    joined = rows.join(written(times, "times"), "at")
    old = F.col(f"row.`{text_col}`")
    text = F.when(F.col("n") == F.col("size"), old).otherwise(_text_parts(old, F.col("spans")))
    joined = joined.select("row", text.alias("new"))
    new = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return unpacked(joined, docs.columns, **new)
