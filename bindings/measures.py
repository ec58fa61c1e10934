"""Thresholds, islands and extents."""

from pyspark.sql import functions as F

from bindings.common import query, table
from casefuse.operators import distribution as dist
from casefuse.operators import ordered

_BINS = ["event_type as group_id", "cast(least(floor(value * 2), 255) as int) as bin"]


_COLOUR = ["p_partkey", "p_partkey * 7 % 256 as r", "p_size * 5 % 256 as g", "p_partkey * 13 % 256 as b"]


@query("luminance_bins", f"""
WITH c AS (SELECT {', '.join(_COLOUR)} FROM part)
SELECT p_partkey, CAST(least(greatest(floor(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b
  + CAST(0.5 AS DOUBLE)), 0), 255) AS BIGINT) AS bin FROM c""")
def luminance_bins(spark, sf):
    rows = table(spark, sf, "part").selectExpr(*_COLOUR)
    return rows.select("p_partkey", dist.luminance(F.col("r"), F.col("g"), F.col("b")).alias("bin"))


@query("otsu_thresholds", f"""
WITH v AS (SELECT {', '.join(_BINS)} FROM events),
bins AS (SELECT g.group_id, t.t FROM (SELECT DISTINCT group_id FROM v) g, range(256) t(t)),
hist AS (SELECT group_id, bin, count(*) AS n FROM v GROUP BY ALL),
full_hist AS (SELECT b.group_id, b.t, coalesce(n, 0) AS n FROM bins b LEFT JOIN hist h ON h.group_id = b.group_id AND h.bin = b.t),
sums AS (SELECT group_id, t, CAST(sum(n) OVER w AS DOUBLE) AS wb, CAST(sum(t * n) OVER w AS DOUBLE) AS sb,
         CAST(sum(n) OVER (PARTITION BY group_id) AS DOUBLE) AS n, CAST(sum(t * n) OVER (PARTITION BY group_id) AS DOUBLE) AS s
         FROM full_hist WINDOW w AS (PARTITION BY group_id ORDER BY t)),
var AS (SELECT group_id, t, wb * (n - wb) * (sb / wb - (s - sb) / (n - wb)) * (sb / wb - (s - sb) / (n - wb)) AS v
        FROM sums WHERE wb > 0 AND n - wb > 0),
best AS (SELECT group_id, t FROM var WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY v DESC, t) = 1)
SELECT g.group_id, CAST(least(greatest(coalesce(b.t, 170), 60), 230) AS BIGINT) AS threshold
FROM (SELECT DISTINCT group_id FROM v) g LEFT JOIN best b USING (group_id)""")
def otsu_thresholds(spark, sf):
    return dist.otsu_threshold(table(spark, sf, "events").selectExpr(*_BINS))


# Hourly counts per event type from the first hour of 2024; the scale is each series' own peak.
FIRST_HOUR = 473352
_SERIES = """hours AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
series AS (SELECT series_id, hour - 473352 AS pos, count(*) AS metric FROM hours GROUP BY ALL),
dims AS (SELECT series_id, max(metric) AS span, max(pos) + 1 AS total FROM series GROUP BY ALL)"""
_RUNS = f"""{_SERIES},
hits AS (SELECT s.*, span, total FROM series s JOIN dims USING (series_id) WHERE metric >= floor(span * {{coverage}})),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS island FROM hits),
runs AS (SELECT series_id, min(pos) AS start_pos, max(pos) AS end_pos, max(metric) AS peak, any_value(span) AS span, any_value(total) AS total
         FROM isl GROUP BY series_id, island)"""


def _series(spark, sf):
    hours = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"))
    series = hours.groupBy("series_id", (F.col("hour") - FIRST_HOUR).alias("pos")).agg(
        F.count(F.lit(1)).alias("metric"))
    dims = series.groupBy("series_id").agg(F.max("metric").alias("span"), (F.max("pos") + 1).alias("total"))
    return series, dims


@query("threshold_islands", f"WITH {_RUNS.format(coverage=0.5)} SELECT series_id, start_pos, end_pos, peak FROM runs")
def threshold_islands(spark, sf):
    series, dims = _series(spark, sf)
    rows = ordered.lookup(series, dims, ["series_id"], F.col("pos"))
    return dist.islands(rows, F.floor(F.col("span") * 0.5)).select(
        "series_id", "start_pos", "end_pos", "peak")


@query("ruled_lines", f"""WITH {_RUNS.format(coverage=0.6)}
SELECT series_id, start_pos, end_pos, peak, end_pos - start_pos + 1 <= 4 AND (start_pos < total * CAST(0.18 AS DOUBLE)
  OR end_pos > total * CAST(0.82 AS DOUBLE) OR peak >= span * CAST(0.9 AS DOUBLE)) AS is_line FROM runs""")
def ruled_lines(spark, sf):
    series, dims = _series(spark, sf)
    return dist.frame_lines(series, dims, coverage=0.6)


@query("series_extents", f"""WITH {_SERIES},
box AS (SELECT series_id, min(pos) AS lo, max(pos) AS hi FROM series JOIN dims USING (series_id) WHERE metric > span * CAST(0.7 AS DOUBLE) GROUP BY ALL)
SELECT series_id, greatest(0, lo - 6) AS start_pos, least(total - 1, hi + 6) AS end_pos FROM box JOIN dims USING (series_id)""")
def series_extents(spark, sf):
    series, dims = _series(spark, sf)
    ink = ordered.lookup(series, dims.select("series_id", "span"), ["series_id"], F.col("pos")).where(F.col("metric") > F.col("span") * 0.7)
    return dist.extents(ink, dims)
