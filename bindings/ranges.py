"""Joins on order, interval joins, sketches, grouping sets and event-time streams."""

from pyspark.sql import functions as F

from bindings.auditing import _AUDIT, _SECTION_ROWS, _audited
from bindings.common import query, table
from casefuse import fixed_values as fv
from casefuse.operators import audit, joins, sketches
from casefuse.session import shared_dir
from casefuse.streaming import windows

# Values of fields over time, and calls that ask for them.
_VALUES = ["user_id % 20 as case_id", "'f' || (event_id % 2) as field", "cast(ts as timestamp) as at", "event_id as seq",
           "'v' || cast(regexp_extract(props, '[0-9]+', 0) as bigint) as value"]
_ASKED = ["event_id as call_id", "user_id % 20 as case_id", "'f' || (user_id % 3) as field", "cast(ts as timestamp) as at"]


@query("field_values_as_of", f"""
WITH v AS (SELECT {', '.join(_VALUES)} FROM events WHERE event_id % 4 <> 0),
c AS (SELECT {', '.join(_ASKED)} FROM events WHERE event_id % 4 = 0)
SELECT c.call_id, c.case_id, c.field, v.value, v.seq
FROM c ASOF LEFT JOIN v ON c.case_id = v.case_id AND c.field = v.field AND c.at >= v.at""")
def field_values_as_of(spark, sf):
    events = table(spark, sf, "events")
    asked = events.where("event_id % 4 = 0").selectExpr(*_ASKED)
    values = events.where("event_id % 4 <> 0").selectExpr(*_VALUES)
    return joins.asof_join(asked, values, ["case_id", "field"], "at", ["value", "seq"], tie="seq").select(
        "call_id", "case_id", "field", "value", "seq")


@query("next_values_within_six_hours", f"""
WITH v AS (SELECT {', '.join(_VALUES)} FROM events WHERE event_id % 4 <> 0),
c AS (SELECT {', '.join(_ASKED)} FROM events WHERE event_id % 4 = 0)
SELECT c.call_id, CASE WHEN v.at - c.at <= INTERVAL 6 HOUR THEN v.value END AS value
FROM c ASOF LEFT JOIN v ON c.case_id = v.case_id AND c.field = v.field AND c.at <= v.at""")
def next_values_within_six_hours(spark, sf):
    events = table(spark, sf, "events")
    asked = events.where("event_id % 4 = 0").selectExpr(*_ASKED)
    values = events.where("event_id % 4 <> 0").selectExpr(*_VALUES)
    return joins.asof_join(asked, values, ["case_id", "field"], "at", ["value"], tie="seq", forward=True,
                           max_gap=6 * 3600 * 1000000).select("call_id", "value")


# Field boxes of a page and text fragments on it, in hundredths of a point; some boxes are page-high.
_BOXES = ["l_suppkey as page", "l_orderkey * 10 + l_linenumber as box", "cast(floor(l_quantity * 1000) as bigint) as top",
          "cast(floor(l_quantity * 1000 + case when l_partkey % 50 = 0 then 40000 else l_tax * 10000 end) as bigint) as bottom",
          "cast(floor(l_discount * 100000) as bigint) as x0", "cast(floor(l_discount * 100000 + 3000) as bigint) as x1"]
_FRAGMENTS = ["l_suppkey as page", "l_orderkey * 10 + l_linenumber as fragment",
              "cast(floor(l_extendedprice * 10) as bigint) % 50000 as y0",
              "cast(floor(l_extendedprice * 10) as bigint) % 50000 + 120 as y1", "l_partkey * 37 % 10000 as x"]


@query("fragments_in_boxes", f"""
WITH b AS (SELECT {', '.join(_BOXES)} FROM lineitem WHERE l_orderkey % 8 = 0),
f AS (SELECT {', '.join(_FRAGMENTS)} FROM lineitem WHERE l_orderkey % 8 <> 0)
SELECT b.page, box, count(*) AS n, min(fragment) AS first_fragment, max(fragment) AS last_fragment
FROM b JOIN f ON b.page = f.page AND top <= y1 AND y0 <= bottom AND x BETWEEN x0 AND x1 GROUP BY ALL""")
def fragments_in_boxes(spark, sf):
    rows = table(spark, sf, "lineitem")
    boxes = rows.where("l_orderkey % 8 = 0").selectExpr(*_BOXES)
    fragments = rows.where("l_orderkey % 8 <> 0").selectExpr(*_FRAGMENTS)
    met = joins.interval_join(boxes, fragments, ["page"], ("top", "bottom"), ("y0", "y1"),
                              F.col("r.x").between(F.col("l.x0"), F.col("l.x1")))
    return met.groupBy("page", F.col("l.box").alias("box")).agg(
        F.count(F.lit(1)).alias("n"), F.min("r.fragment").alias("first_fragment"),
        F.max("r.fragment").alias("last_fragment"))


@query("distinct_users_merged", """
SELECT event_type, count(DISTINCT user_id) AS n_exact, count(*) AS n_rows, true AS near, true AS median_near
FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY ALL""")
def distinct_users_merged(spark, sf):
    """Three weeks answered from sketches of days, next to the exact counts."""
    events = table(spark, sf, "events").where("ts < timestamp'2024-01-22'")
    parts = sketches.part_sketches(events.withColumn("day", F.to_date("ts")), ["day", "event_type"],
                                   F.col("user_id"), F.col("value"))
    path = shared_dir(spark, "day-sketches")
    parts.write.partitionBy("day").parquet(path)
    whole = sketches.merged(spark.read.parquet(path), ["event_type"]).select(
        F.col("event_type").alias("kind"), "n_rows", sketches.distinct_count().alias("about"),
        sketches.quantiles(0.48, 0.52).alias("around"))
    exact = events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("n_exact"), F.percentile("value", F.lit(0.5)).alias("median"))
    return exact.join(whole, F.col("event_type") == F.col("kind")).select(
        "event_type", "n_exact", "n_rows",
        (F.abs(F.col("about") - F.col("n_exact")) <= 0.03 * F.col("n_exact")).alias("near"),
        F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("median_near"))


@query("audit_pass_rates_by_level", f"""WITH {_AUDIT},
cat AS (SELECT * FROM {_SECTION_ROWS}),
a AS (SELECT audited.*, cat.section FROM audited LEFT JOIN cat USING (field))
SELECT CASE grouping(section, field) WHEN 0 THEN 'field' WHEN 1 THEN 'section' ELSE 'all' END AS level, section, field,
  count(ok) AS n_checked, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed
FROM a GROUP BY GROUPING SETS ((section, field), (section), ())""")
def audit_pass_rates_by_level(spark, sf):
    return audit.pass_rates_by_level(_audited(spark, sf))


# Decided fields of orders, one per line.
_FIELDS = [row[0] for row in fv.FIELD_CATALOG]
_DECIDED = ["l_orderkey as case_id",
            "split_part('" + "|".join(_FIELDS) + f"', '|', cast(l_partkey % {len(_FIELDS)} + 1 as int)) as field",
            "case l_suppkey % 4 when 0 then 'AI' when 1 then 'CONFLICT' when 2 then 'WARN' else 'USER' end as state"]


@query("state_counts_by_level", f"""
WITH cat AS (SELECT * FROM {_SECTION_ROWS}), d AS (SELECT {', '.join(_DECIDED)} FROM lineitem),
s AS (SELECT d.*, section FROM d LEFT JOIN cat USING (field))
SELECT grouping(section, state) AS level, section, state, count(*) AS n_fields, count(DISTINCT case_id) AS n_cases
FROM s GROUP BY CUBE (section, state)""")
def state_counts_by_level(spark, sf):
    return audit.state_cube(table(spark, sf, "lineitem").selectExpr(*_DECIDED))


_FAILED = ["cast(ts as timestamp) as called_at", "'e' || (event_id % 5) as engine",
           "case when event_type = 'error' then split_part('HTTP 429,invalid json,timed out,unknown', ',', "
           "cast(event_id % 4 + 1 as int)) end as status"]


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


_CAUSES = " ".join(f"WHEN regexp_matches(lower(status), '{p}') THEN '{n}'" for n, _, _, p in fv.FAILURE_RULES)


@query("failure_windows_stream", f"""
WITH c AS (SELECT {', '.join(_FAILED)} FROM events)
SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, called_at)) AS start_us, engine, CASE {_CAUSES} ELSE 'OTHER' END AS cause, count(*) AS n
FROM c WHERE status IS NOT NULL GROUP BY ALL""")
def failure_windows_stream(spark, sf):
    root = shared_dir(spark, "failure-windows")
    windows.start_failure_windows(_stream(spark, sf).selectExpr(*_FAILED), f"{root}/state", f"{root}/checkpoint",
                                  "called_at", "6 hours").awaitTermination()
    return windows.current_failures(spark, f"{root}/state").select(
        F.unix_micros("window_start").alias("start_us"), "engine", "cause", "n")


@query("call_outcomes_stream", """
WITH c AS (SELECT event_id AS call_id, user_id AS case_id, ts AS called_at FROM events WHERE event_id % 3 = 0),
r AS (SELECT event_id - 1 AS call_id, ts AS replied_at FROM events WHERE event_id % 3 = 1),
mark AS (SELECT least((SELECT max(called_at) FROM c), (SELECT max(replied_at) FROM r)) - INTERVAL 1 MINUTE AS passed)
SELECT c.call_id, case_id, epoch_us(replied_at) AS replied_us
FROM c LEFT JOIN r ON c.call_id = r.call_id AND replied_at BETWEEN called_at AND called_at + INTERVAL 4 MINUTE
WHERE replied_at IS NOT NULL OR called_at + INTERVAL 4 MINUTE < (SELECT passed FROM mark)""")
def call_outcomes_stream(spark, sf):
    root = shared_dir(spark, "call-outcomes")
    calls = _stream(spark, sf).where("event_id % 3 = 0").selectExpr(
        "event_id as call_id", "user_id as case_id", "cast(ts as timestamp) as called_at")
    replies = _stream(spark, sf).where("event_id % 3 = 1").selectExpr("event_id - 1 as call_id", "cast(ts as timestamp) as replied_at")
    windows.start_reply_join(calls, replies, f"{root}/out", f"{root}/checkpoint", "4 minutes",
                             "1 minute").awaitTermination()
    return windows.call_outcomes(spark, f"{root}/out").select(
        "call_id", "case_id", F.unix_micros("replied_at").alias("replied_us"))
