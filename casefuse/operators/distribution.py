"""Thresholds, islands and extents over grouped or ordered measurements."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse.operators import ordered


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Brightness bin 0..255 of a colour."""
    lum = F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5)
    return F.least(F.greatest(lum, F.lit(0)), F.lit(255)).cast("int")


def otsu_threshold(values: DataFrame, low: int = 60, high: int = 230,
                   default: int = 170) -> DataFrame:
    """Threshold per group that best splits its `bin` histogram (0..255) in two.

    The histogram is made first, so the running sums see at most 256 rows of a group.
    """
    hist = values.groupBy("group_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group_id").orderBy("bin")
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighted = F.col("bin").cast("double") * F.col("n")
    sums = hist.select(
        "group_id", "bin",
        F.sum("n").over(upto).cast("double").alias("below"),
        F.sum(weighted).over(upto).alias("sum_below"),
        F.sum("n").over(all_rows).cast("double").alias("total"),
        F.sum(weighted).over(all_rows).alias("sum_all"))
    above = F.col("total") - F.col("below")
    gap = F.try_divide("sum_below", "below") - F.try_divide(F.col("sum_all") - F.col("sum_below"), above)
    spread = F.when(above > 0, F.col("below") * above * gap * gap)
    scored = sums.withColumn("spread", spread)
    best = F.max_by(F.col("bin"), F.when(F.col("spread") > 0, F.struct(
        F.col("spread"), (-F.col("bin")).alias("first"))))
    return scored.groupBy("group_id").agg(
        F.least(F.greatest(F.coalesce(best, F.lit(default)), F.lit(low)), F.lit(high)).alias("threshold"))


def islands(series: DataFrame, limit: Column, rows: int = ordered.ROWS, keep=()) -> DataFrame:
    """Maximal runs of consecutive `pos` whose `metric` reaches the limit, per series.

    `keep` names columns that are the same on all rows of a series and stay on its runs.
    """
    hits = series.where(F.col("metric") >= limit)
    numbered = ordered.row_number(hits, ["series_id"], ["pos"], F.col("pos"), "rn", rows=rows)
    return numbered.groupBy("series_id", (F.col("pos") - F.col("rn")).alias("island")).agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.max("metric").alias("peak"), *[F.max(c).alias(c) for c in keep]).drop("island")


def frame_lines(series: DataFrame, dims: DataFrame, coverage: float = 0.75, thickness: int = 4,
                edge: float = 0.18, full_span: float = 0.90,
                rows: int = ordered.ROWS) -> DataFrame:
    """Runs that are ruled lines: thin, and near an edge or almost across.

    `series(series_id, pos, metric)`, `dims(series_id, span, total)`: `span` is the largest
    possible metric, `total` the number of positions.
    """
    sized = ordered.lookup(series, dims, ["series_id"], F.col("pos"))
    limit = F.floor(F.col("span") * F.lit(coverage))
    runs = islands(sized, limit, rows, ["span", "total"])
    thin = F.col("end_pos") - F.col("start_pos") + 1 <= thickness
    near_edge = (F.col("start_pos") < F.col("total") * edge) | (
        F.col("end_pos") > F.col("total") * (1 - edge))
    across = F.col("peak") >= F.col("span") * full_span
    return runs.withColumn("is_line", thin & (near_edge | across)).select(
        "series_id", "start_pos", "end_pos", "peak", "is_line")


def extents(points: DataFrame, dims: DataFrame, pad: int = 6) -> DataFrame:
    """Padded bounding range of each series' positions, clamped to its size."""
    box = points.groupBy("series_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return box.join(dims, "series_id").select(
        "series_id", F.greatest(F.lit(0), F.col("lo") - pad).alias("start_pos"),
        F.least(F.col("total") - 1, F.col("hi") + pad).alias("end_pos"))
