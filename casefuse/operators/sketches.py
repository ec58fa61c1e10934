"""Approximate aggregates that are kept per part and merged later.

A sketch of each part (a day, a file, a region) is written once; any span of parts is answered by
merging sketches, without reading rows again. Distinct counts use HyperLogLog with a standard error
of about 0.8 % at the default size, quantiles a KLL sketch with a rank error of about 0.2 %.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct-count sketch, and the accuracy of a quantile sketch.
REGISTERS, ACCURACY = 14, 2048


def part_sketches(rows: DataFrame, parts: list, distinct: Column, measure: Column = None,
                  registers: int = REGISTERS, accuracy: int = ACCURACY) -> DataFrame:
    """`<parts>, n_rows, distinct_sketch[, quantile_sketch]` of each part.

    `measure` is a number; null values enter no sketch. Sketches are built by every task for itself
    and merged, so a part may be any share of the rows.
    """
    made = [F.count(F.lit(1)).alias("n_rows"),
            F.hll_sketch_agg(distinct.cast("string"), registers).alias("distinct_sketch")]
    if measure is not None:
        made.append(F.kll_sketch_agg_double(measure.cast("double"), accuracy).alias(
            "quantile_sketch"))
    return rows.groupBy(*parts).agg(*made)


def merged(sketches: DataFrame, keys: list) -> DataFrame:
    """The sketches of parts merged over everything but `keys`."""
    made = [F.sum("n_rows").alias("n_rows"),
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch")]
    if "quantile_sketch" in sketches.columns:
        made.append(F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))
    return sketches.groupBy(*keys).agg(*made)


def distinct_count() -> Column:
    """Estimated number of distinct values of a sketch."""
    return F.hll_sketch_estimate("distinct_sketch")


def quantiles(*shares: float) -> Column:
    """Array of the values at these shares of a sketch's rows."""
    return F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*map(F.lit, shares)))
