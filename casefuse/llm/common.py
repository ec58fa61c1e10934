"""What several operators share: words, row packing, written intermediates and checks of columns."""

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from casefuse.session import shared_dir
from casefuse.sources.tables import read_table  # noqa: F401  (used by the operators)

# The one definition of a word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed or shipped with the job."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, _ROOT]))
    return spark


def utf8(values) -> list:
    """An Arrow string column as bytes; `bytes.split()` cuts exactly at the white space of WORD."""
    return values.cast("large_binary").to_pylist()


def written(df: DataFrame, name: str, **watched: Column):
    """The rows read back from a new table in the shared folder: lineage cut, work done once.

    With `watched` aggregates, (rows, their values); they are taken while the rows are written.
    """
    path, seen = shared_dir(df.sparkSession, name), Observation()
    if watched:
        df = df.observe(seen, *[c.alias(k) for k, c in watched.items()])
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return (rows, seen.get) if watched else rows


def packed(df: DataFrame, *columns) -> DataFrame:
    """Named working columns beside the whole input row in `row`: no input name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def unpacked(df: DataFrame, columns, **replaced) -> DataFrame:
    """The columns of `row` again, some of them replaced."""
    return df.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def numbered(rows: DataFrame, group: list, order: list, weight: str = None) -> DataFrame:
    """Add `pos`, a gapless number from 0 in the order within the group, and `n`, its rows.

    With `weight`, `pos` is the weight of the group's rows before and `n` that of all. The rows are
    dealt by ranges of (group, order), so one group may fill many tasks; each range learns from a
    table of range sizes how much of its group comes before it.
    """
    dealt = rows.select(F.struct(*[F.col(c) for c in group] or [F.lit(0)]).alias("group"), *order,
                        F.struct("*").alias("row"))
    dealt = dealt.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    dealt = written(dealt.select("group", "row", F.monotonically_increasing_id().alias("at")),
                    "ordered").withColumn("part", F.shiftright("at", 33))
    held = F.sum(f"row.{weight}") if weight else F.count(F.lit(1))
    ranges = dealt.groupBy("group", "part").agg(F.min("at").alias("first"), held.alias("held"))
    before = Window.partitionBy("group").orderBy("part")
    ranges = ranges.withColumn("before", F.sum("held").over(before) - F.col("held")).withColumn(
        "n", F.sum("held").over(Window.partitionBy("group")))
    inner = F.col("at") - F.col("first")
    if weight:
        inside = Window.partitionBy("group", "part").orderBy("at").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        dealt = dealt.withColumn("upto", F.sum(f"row.{weight}").over(inside))
        inner = F.col("upto") - F.col(f"row.{weight}")
    return dealt.join(written(ranges, "ranges"), ["group", "part"]).select(
        "row.*", (inner + F.col("before")).alias("pos"), "n")


def mix64(*columns: Column, seed: int) -> Column:
    """A 64-bit hash of the columns that depends on the seed."""
    return F.xxhash64(F.lit(seed), *columns)


def row_order(df: DataFrame) -> Column:
    """A number that tells repeated rows apart; write the rows before relying on it twice."""
    return F.monotonically_increasing_id()
