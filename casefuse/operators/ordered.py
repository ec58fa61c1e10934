"""Ordered per-key work that never puts a whole key into one task.

A plain window keeps all rows of a key in one task. Here a key of more than `rows` rows is cut into
ranges along its order, at quantiles of a sketch that is merged from all tasks; so ranges hold about
`rows` rows each, whether the order values are dense or sparse. A window runs inside each (key,
range), one summary row per range is made with a map-side combined aggregate, a second window runs
over the summaries, and each row adds its range's carry. Results do not depend on the cuts.

The key and range travel as one struct column, so that the window and the carry join share one
shuffle and null keys still meet.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse.sources.tables import written

#: Rows of a key from which on it is cut, and about as many in a range.
ROWS = 1 << 18
#: Ranges of a key at most, the grid of quantiles they are taken from, and the sketch's accuracy
#: (its error in rank is below 0.1 % of the key's rows).
RANGES, GRID, ACCURACY = 1 << 10, 1 << 12, 1 << 13
#: Parts that a key's rows are dealt into by hash where their order does not matter.
PARTS = 32
#: Rows in a partition where the rows of a key are brought together.
EACH = 1 << 17


def cut_points(df: DataFrame, keys: list, seq: Column, rows: int = ROWS) -> DataFrame:
    """`<keys>, cuts`: the order values at which hot keys are cut; None where no key is hot.

    `seq` is a whole number; a null lies before all others. Rows are counted first, and only those
    of hot keys are sketched. There is at most one hot key for every `rows` rows of the input; the
    table is written, so that all its readers see the same cuts.
    """
    sized = df.select(*keys, seq.cast("long").alias("_seq"))
    hot = written(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > rows), "hot-keys")
    if hot.isEmpty():
        return None
    sketch = F.kll_sketch_agg_bigint("_seq", ACCURACY).alias("sketch")
    sketched = _met(sized, hot, keys, "inner").groupBy(*keys).agg(sketch, F.max("_n").alias("_n"))
    grid = F.kll_sketch_get_quantile_bigint(
        "sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    parts = F.least(F.lit(RANGES), F.ceil(F.col("_n") / F.lit(rows))).cast("int")
    inner = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get(
        "grid", F.floor(i * GRID / F.col("parts")).cast("int")))
    return written(sketched.select(*keys, grid.alias("grid"), parts.alias("parts")).select(
        *keys, F.array_distinct(inner).alias("cuts")), "cuts")


def _met(df: DataFrame, table: DataFrame, keys: list, how: str) -> DataFrame:
    """Join with a written table of one row per key; null keys meet, the key stands once."""
    other = table.select(*[F.col(k).alias(f"_{k}") for k in keys],
                         *[c for c in table.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(other, on, how).drop(*[f"_{k}" for k in keys])


def _ranged(df: DataFrame, keys: list, seq: Column, cuts: DataFrame) -> DataFrame:
    """Add `_range`: how many cuts of the row's key are at or before it (0 for keys without cuts).

    The cuts are searched by halving. Their table is small and plain: it is broadcast, or the
    runtime splits the rows of a hot key that meet it.
    """
    if cuts is None:
        return df.withColumn("_range", F.lit(0))
    at = seq.cast("long")
    steps = F.array(*[F.lit(1 << i) for i in range(RANGES.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(
        F.get("cuts", n + step - 1) <= at, step).otherwise(0))
    return _met(df, cuts, keys, "left").withColumn(
        "_range", F.when(F.col("cuts").isNull(), 0).otherwise(found)).drop("cuts")


def _tagged(df, keys, buckets):
    df = df.withColumns({f"_b{i}": b for i, b in enumerate(buckets)})
    names = [f"_b{i}" for i in range(len(buckets))]
    return df.withColumn("_k", F.struct(*keys, *names)), names


def _carry_window(keys, names, descending=False):
    order = [F.col(f"_k.{n}").desc() if descending else F.col(f"_k.{n}") for n in names]
    return Window.partitionBy(F.struct(*[F.col(f"_k.{k}") for k in keys])).orderBy(*order)


def row_number(df: DataFrame, keys: list, order: list, seq: Column, out: str,
               total: str = None, lead: Column = None, rows: int = ROWS) -> DataFrame:
    """Row number per key, and its row count as `total`.

    `seq` is a whole number that agrees with `order`: sorting by it first never changes the
    sequence. With `lead`, that comes before `seq` and cuts a key on its own.
    """
    cuts = cut_points(df, keys, seq, rows)
    df = _ranged(df, keys, seq, cuts)
    df, names = _tagged(df, keys, [F.col("_range")] if lead is None else [lead, F.col("_range")])
    sizes = df.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    w = _carry_window(keys, names)
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    carry = sizes.select("_k", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    inner = F.row_number().over(Window.partitionBy("_k").orderBy(*order))
    numbered = df.withColumn("_rn", inner).join(carry, "_k")
    numbered = numbered.withColumn(out, F.col("_rn") + F.col("_before"))
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_k", "_rn", "_before", "_total", "_range", *names)


def lookup(df: DataFrame, table: DataFrame, keys: list, seq: Column, parts: int = PARTS,
           source: DataFrame = None) -> DataFrame:
    """Left join to a table with one row per key, a hot key's rows spread over parts.

    A plain join on the key would send all its rows to one task, and the runtime's own skew split
    does not apply where the table is an aggregate over that key. Here rows are dealt into parts by
    a hash of `seq`, so dense and sparse numbers spread alike; only the distinct (key, part) pairs,
    at most `parts` of a key, meet the table on the key, and the rows meet the pairs.

    The pairs come from `df` itself, which is then computed twice. Where `df` is costly, `source`
    names cheaper rows (the keys and `seq`) that hold at least the same pairs.
    """
    def part_of(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(parts))

    df, names = _tagged(df, keys, [part_of(seq)])
    pairs = df if source is None else _tagged(source, keys, [part_of(F.col("seq"))])[0]
    pairs = pairs.select("_k", *keys).distinct().join(table, keys, "left").drop(*keys)
    return df.join(pairs, "_k").drop("_k", *names)


def hot_keys(sizes: DataFrame, keys: list, rows: int = ROWS) -> DataFrame:
    """Keys of more than `rows` rows from `<keys>, n`, written; None where there is none."""
    hot = written(sizes.where(F.col("n") > rows).select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def _part(df: DataFrame, keys: list, seq: Column, hot: DataFrame, parts: int) -> DataFrame:
    """Add `part`: 0, for rows of hot keys a hash of `seq`."""
    dealt = F.pmod(F.xxhash64(seq.cast("long")), F.lit(parts)).cast("int")
    marked = _met(df, hot.withColumn("_hot", F.lit(True)), keys, "left")
    return marked.withColumn("part", F.when(F.col("_hot"), dealt).otherwise(0)).drop("_hot")


def together(df: DataFrame, keys: list, seq: Column, rows: int = ROWS, each: int = EACH,
             parts: int = PARTS) -> tuple[DataFrame, int]:
    """Deal rows by the keys and `part`, which is 0 but for the rows of hot keys; and the partitions.

    Rows of a key then lie together, those of a hot key in up to `parts` tasks, and later aggregates
    over the key combine nearly all before they shuffle. Rows are counted first; a partition holds
    about `each` of them.
    """
    hot, many = _dealing(df, keys, rows, each)
    df = df.withColumn("part", F.lit(0)) if hot is None else _part(df, keys, seq, hot, parts)
    return df.repartition(many, *keys, "part"), many


def _dealing(df: DataFrame, keys: list, rows: int, each: int) -> tuple:
    """Hot keys (None where there is none) and the partitions that rows are dealt into."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hot_keys(sizes, keys, rows), max(least, -(-df.count() // each))


def by_key(df: DataFrame, keys: list, seq: Column, rows: int = ROWS, each: int = EACH,
           parts: int = PARTS) -> tuple[DataFrame, int, list]:
    """As `together`, with the columns by which rows are dealt: the keys alone where none is hot.

    Each key is then whole in one partition, and in buckets of the keys later aggregates and joins
    of finer keys need no shuffle. With a hot key, rows are dealt by the keys and `part`.
    """
    hot, many = _dealing(df, keys, rows, each)
    if hot is None:
        return df.withColumn("part", F.lit(0)).repartition(many, *keys), many, list(keys)
    return _part(df, keys, seq, hot, parts).repartition(many, *keys, "part"), many, [*keys, "part"]


def meet(df: DataFrame, table: DataFrame, keys: list, rows: int = ROWS,
         parts: int = PARTS) -> DataFrame:
    """Left join of rows with `part`, as from `together`, to a table with one row per key.

    `n` in the table is the number of rows of the key, by which `together` judged it hot. The table's rows are repeated for all parts, and the join keeps each part of a hot key in a task
    of its own. Rows in buckets of the keys and `part` are not shuffled for it.
    """
    every = table.select("*", F.explode(F.when(F.col("n") > rows, F.sequence(
        F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))).alias("part")).drop("n")
    return df.join(every.hint("shuffle_hash"), [*keys, "part"], "left")


def neighbour(df: DataFrame, keys: list, seq: str, value: Column, out: str,
              following: bool = False, rows: int = ROWS, cut: tuple = None) -> DataFrame:
    """STRUCT<v> with the value of the previous (or following) row of the key, null at the edge.

    `cut` gives keys and their cut points where rows of a coarser key are known to be cut well.
    """
    cut = cut or (keys, cut_points(df, keys, F.col(seq), rows))
    df = _ranged(df.withColumn("_v", F.struct(value.alias("v"))), cut[0], F.col(seq), cut[1])
    df, names = _tagged(df, keys, [F.col("_range")])
    edge = F.min_by("_v", seq) if following else F.max_by("_v", seq)
    carry = df.groupBy("_k").agg(edge.alias("_edge")).select(
        "_k", F.lag("_edge").over(_carry_window(keys, names, following)).alias("_carry"))
    order = F.col(seq).desc() if following else F.col(seq)
    near = F.lag("_v").over(Window.partitionBy("_k").orderBy(order))
    joined = df.withColumn("_near", near).join(carry, "_k")
    return joined.withColumn(out, F.coalesce("_near", "_carry")).drop(
        "_k", "_v", "_near", "_carry", "_range", *names)


def running_height(df: DataFrame, keys: list, seq: str, step: Column, out: str,
                   rows: int = ROWS, cut: tuple = None) -> DataFrame:
    """Running sum of +1/-1 steps that never falls below zero (a stack height), after each row."""
    cut = cut or (keys, cut_points(df, keys, F.col(seq), rows))
    df = _ranged(df.withColumn("_s", step.cast("long")), cut[0], F.col(seq), cut[1])
    df, names = _tagged(df, keys, [F.col("_range")])
    inner = Window.partitionBy("_k").orderBy(seq)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.withColumn("_sum", F.sum("_s").over(upto))
    sums = sums.withColumn("_low", F.min("_sum").over(upto))
    parts = sums.groupBy("_k").agg(F.sum("_s").alias("_sum"), F.min("_sum").alias("_low"))
    before = _carry_window(keys, names).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    parts = parts.select("_k", "_base", F.least(F.lit(0), F.coalesce(F.min(
        F.col("_base") + F.col("_low")).over(before), F.lit(0))).alias("_floor"))
    joined = sums.join(parts, "_k")
    low = F.least("_floor", F.col("_base") + F.col("_low"))
    return joined.withColumn(out, F.col("_base") + F.col("_sum") - low).drop(
        "_k", "_s", "_sum", "_low", "_base", "_floor", "_range", *names)


def carried(df: DataFrame, keys: list, seq: str, ties: list, value: str, out: str,
            rows: int = ROWS) -> DataFrame:
    """The last non-null `value` (a struct) up to each row of its key, in the order of (seq, ties)."""
    order = [seq, *ties]
    df = _ranged(df, keys, F.col(seq), cut_points(df, keys, F.col(seq), rows))
    df, names = _tagged(df, keys, [F.col("_range")])
    upto = Window.partitionBy("_k").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = df.withColumn("_near", F.last(value, ignorenulls=True).over(upto))
    edge = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_edge")
    before = _carry_window(keys, names).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy("_k").agg(edge).select(
        "_k", F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    return near.join(carry, "_k").withColumn(out, F.coalesce("_near", "_carry")).drop(
        "_k", "_near", "_carry", "_range", *names)
