"""Joins on order instead of equality: the last value before a time, and intervals that overlap.

Neither compares rows of a key pair by pair. The as-of join sorts both sides into one sequence, cut
into ranges where a key is hot, and carries the last value forward. The interval join lays bins over
the line, coarser ones for longer intervals, so that an interval lies in a bounded number of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.operators import ordered
from casefuse.sources.tables import written

#: Bins a finer bin's width goes into the next coarser one, which is also how many an interval spans.
FAN = 16


def _whole(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def asof_join(left: DataFrame, right: DataFrame, keys: list, at: str, values: list, tie: str = None,
              forward: bool = False, max_gap: int = None, rows: int = ordered.ROWS) -> DataFrame:
    """Every row of `left` with `values` of the last row of `right` of its key at or before it.

    `at` is a timestamp or a whole number on both sides; with `forward` the first row at or after
    counts. Of right rows with equal `at` that of the largest `tie` counts. `max_gap` (in
    microseconds or numbers) leaves matches farther away null. Null keys and times match nothing;
    every left row stays once. No name in `values` may be a column of `left`.
    """
    sign = -1 if forward else 1
    found = F.struct((sign * _whole(right, at)).alias("_at"), *values)
    usable = F.lit(True)
    for c in (*keys, at):
        usable = usable & F.col(c).isNotNull()
    theirs = right.where(usable).select(
        *keys, (sign * _whole(right, at)).alias("_t"), F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(0)).alias("_tie"), found.alias("_v"))
    mine = left.select(*keys, (sign * _whole(left, at)).alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*left.columns).alias("_row"))
    both = ordered.carried(theirs.unionByName(mine, allowMissingColumns=True), keys, "_t",
                           ["_side", "_tie"], "_v", "_found", rows)
    near = F.col("_found").isNotNull()
    if max_gap is not None:
        near = near & (F.col("_t") - F.col("_found._at") <= max_gap)
    return both.where("_side = 1").select(
        "_row.*", *[F.when(near, F.col(f"_found.{v}")).alias(v) for v in values])


def _level(length: Column, width: float) -> Column:
    """The smallest level at which an interval spans at most FAN + 1 bins."""
    ratio = F.greatest(F.lit(1.0), length / F.lit(width * FAN))
    level = F.ceil(F.log(ratio) / F.log(F.lit(float(FAN)))).cast("int")
    # The logarithm may be off by a hair at exact powers.
    return F.when(F.pow(F.lit(float(FAN)), level.cast("double")) < ratio, level + 1).otherwise(level)


def _binned(df: DataFrame, keys: list, start: str, end: str, width: float, top: int,
            side: str) -> DataFrame:
    """A row per bin of each interval: its own level's bins and those of every coarser level."""
    low, high = F.col(start).cast("double"), F.col(end).cast("double")
    usable = low <= high
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    own = df.where(usable).select(F.struct(*df.columns).alias(side), *keys, low.alias("_low"),
                                  high.alias("_high"), _level(high - low, width).alias(f"_{side}"))
    levels = own.withColumn("_level", F.explode(F.sequence(F.col(f"_{side}"), F.lit(top))))
    size = F.lit(width) * F.pow(F.lit(float(FAN)), F.col("_level").cast("double"))
    first, last = F.floor(F.col("_low") / size), F.floor(F.col("_high") / size)
    return levels.withColumn(f"_first_{side}", first).withColumn(
        "_bin", F.explode(F.sequence(first, last))).drop("_low", "_high")


def interval_join(left: DataFrame, right: DataFrame, keys: list, left_range: tuple,
                  right_range: tuple, also: Column = None, width: float = None) -> DataFrame:
    """Pairs of rows whose closed intervals overlap and whose keys are equal.

    `left_range` and `right_range` name start and end columns; points have both equal. `also` is a
    further condition on the pair, written with `l.` and `r.` before column names. Gives the keys and
    the structs `l` and `r`. Intervals with a null or with start above end, and null keys, match
    nothing. `width` is the finest bin, by default the mean length of both sides' intervals.

    An interval is put into bins of the level that fits its length and of all coarser ones, at most
    FAN + 1 and then 2 a level. Two intervals meet at the coarser of their levels, in the first bin
    that holds both, so each pair comes once. Both sides are written first: the planner knows their
    size, and the runtime splits a bin with very many rows.
    """
    spans = [df.agg(F.avg((F.col(e) - F.col(s)).cast("double")).alias("mean"), F.max(
        (F.col(e) - F.col(s)).cast("double")).alias("most")).first()
        for df, (s, e) in ((left, left_range), (right, right_range))]
    means = [s["mean"] for s in spans if s["mean"] and s["mean"] > 0]
    width = float(width or (sum(means) / len(means) if means else 1.0))
    most, top = max([s["most"] or 0.0 for s in spans]), 0
    while width * FAN ** (top + 1) < most:
        top += 1
    sides = [written(_binned(df, keys, s, e, width, top + 1, side), "bins") for df, (s, e), side in (
        (left, left_range, "l"), (right, right_range, "r"))]
    met = sides[0].join(sides[1], [*keys, "_level", "_bin"]).where(
        (F.col("_level") == F.greatest("_l", "_r"))
        & (F.col("_bin") == F.greatest("_first_l", "_first_r"))
        & (F.col(f"l.{left_range[0]}") <= F.col(f"r.{right_range[1]}"))
        & (F.col(f"r.{right_range[0]}") <= F.col(f"l.{left_range[1]}")))
    return (met if also is None else met.where(also)).select(*keys, "l", "r")
