"""Voting and cut-offs."""

from pyspark.sql import functions as F

from bindings.common import ENGINES, cte, planted, query, table
from casefuse import fixed_values as fv
from casefuse.functions.rules import failure_cause, failure_hint, failure_label
from casefuse.operators import documents, voting

_VOTED = f"""{cte('votes')},
voted AS (SELECT case_id, field, value, string_agg(DISTINCT engine, '|' ORDER BY engine) AS engines,
                 count(DISTINCT engine) AS n_engines, min(seq) AS first_seq
          FROM votes GROUP BY ALL)"""


def _voted(spark, sf):
    return voting.aggregate_votes(planted(spark, sf, "votes"))


@query("value_votes", f"WITH {_VOTED} SELECT * FROM voted")
def value_votes(spark, sf):
    return _voted(spark, sf).select("case_id", "field", "value", "engines", "n_engines", "first_seq")


@query("consensus_ranking", f"""WITH {_VOTED}
SELECT case_id, field, value, n_engines,
       row_number() OVER (PARTITION BY case_id, field ORDER BY n_engines DESC, first_seq) AS rank
FROM voted""")
def consensus_ranking(spark, sf):
    return voting.rank_values(_voted(spark, sf)).select("case_id", "field", "value", "n_engines", "rank")


@query("consensus_prefill", f"""WITH {_VOTED}
SELECT case_id, field, value, n_engines FROM voted
QUALIFY row_number() OVER (PARTITION BY case_id, field ORDER BY n_engines DESC, first_seq) = 1""")
def consensus_prefill(spark, sf):
    return voting.top_values(_voted(spark, sf)).drop("engines")


@query("majority_type", f"""WITH {cte('votes')},
n AS (SELECT case_id, field AS tipo, count(*) AS n_votes, min(seq) AS first_seq FROM votes GROUP BY ALL)
SELECT case_id, tipo, n_votes FROM n
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n_votes DESC, first_seq) = 1""")
def majority_type(spark, sf):
    rows = planted(spark, sf, "votes").select("case_id", "seq", F.col("field").alias("tipo"))
    return voting.majority_type(rows, "tipo")


_PRIORITY = "coalesce(nullif(list_position(['" + "','".join(fv.CALL_PRIORITY) + "'], engine), 0), 7)"


@query("engine_order", f"""
WITH e AS (SELECT user_id AS case_id,
                  split_part('{ENGINES}', ',', cast(event_id % 9 + 1 as int)) AS engine,
                  min(event_id) AS ord FROM events GROUP BY ALL)
SELECT case_id, engine, row_number() OVER (PARTITION BY case_id ORDER BY {_PRIORITY}, ord) AS call_order
FROM e""")
def engine_order(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "user_id as case_id", "event_id as ord",
        f"split_part('{ENGINES}', ',', cast(event_id % 9 + 1 as int)) as engine")
    return voting.order_engines(rows).select("case_id", "engine", "call_order")


_DEAD = f"""{cte('event_calls')},
died AS (SELECT case_id, engine, min(seq) AS died_at FROM event_calls
         WHERE http_code IN (401, 403, 404) GROUP BY ALL),
ran AS (SELECT c.* FROM event_calls c LEFT JOIN died d USING (case_id, engine)
        WHERE died_at IS NULL OR seq <= died_at)"""


@query("dead_engine_cut", f"WITH {_DEAD} SELECT case_id, engine, seq, CAST(http_code AS BIGINT) AS http_code FROM ran")
def dead_engine_cut(spark, sf):
    return voting.drop_dead_engines(planted(spark, sf, "event_calls")).select(
        "case_id", "engine", "seq", "http_code")


_TYPES = ["click", "view", "purchase", "signup", "error"]


@query("coverage_cut", f"""WITH {cte('votes')},
seen AS (SELECT * EXCLUDE (field), CASE WHEN case_id % 4 = 0 AND field = 'error' THEN 'view' ELSE field END AS field FROM votes),
firsts AS (SELECT case_id, field, min(seq) AS seq FROM seen GROUP BY ALL),
cut AS (SELECT case_id, max(seq) AS cut_seq FROM firsts GROUP BY ALL HAVING count(*) = 5)
SELECT case_id, field, value, seq FROM seen LEFT JOIN cut USING (case_id)
WHERE cut_seq IS NULL OR seq <= cut_seq""")
def coverage_cut(spark, sf):
    field = F.when((F.col("case_id") % 4 == 0) & (F.col("field") == "error"), "view").otherwise(F.col("field"))
    seen = planted(spark, sf, "votes").withColumn("field", field)
    return voting.stop_when_covered(seen, voting.coverage_point(seen, _TYPES)).select(
        "case_id", "field", "value", "seq")


_CAUSE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(status), '{pattern}') THEN '{name}'"
    for name, _, _, pattern in fv.FAILURE_RULES) + " ELSE 'OTHER' END"


@query("last_engine_status", f"""WITH {cte('event_calls')}
SELECT case_id, engine, arg_max(status, seq) AS status FROM event_calls
WHERE status IS NOT NULL GROUP BY ALL""")
def last_engine_status(spark, sf):
    return voting.last_status(planted(spark, sf, "event_calls"))


_LABELS = "CASE cause " + " ".join(
    f"WHEN '{name}' THEN '{label}'" for name, label, _, _ in fv.FAILURE_RULES) + " ELSE 'error' END"


_HINTS = "CASE cause " + " ".join(
    f"WHEN '{name}' THEN '{hint}'" for name, _, hint, _ in fv.FAILURE_RULES) + f" ELSE '{fv.DEFAULT_CAUSE[2]}' END"


@query("failure_causes", f"""WITH {cte('event_calls')},
c AS (SELECT engine, {_CAUSE} AS cause FROM event_calls WHERE status IS NOT NULL)
SELECT engine, cause, {_LABELS} AS label, {_HINTS} AS hint, count(*) AS n FROM c GROUP BY ALL""")
def failure_causes(spark, sf):
    failed = planted(spark, sf, "event_calls").where(F.col("status").isNotNull())
    cause = failure_cause(F.col("status")).alias("cause")
    return failed.groupBy("engine", cause).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "label", failure_label(F.col("cause"))).withColumn("hint", failure_hint(F.col("cause")))


@query("engines_answered", f"""WITH {cte('event_calls')}
SELECT DISTINCT case_id, engine FROM event_calls WHERE http_code = 200""")
def engines_answered(spark, sf):
    rows = planted(spark, sf, "event_calls").withColumn(
        "reply", F.when(F.col("http_code") == 200, F.lit("ok")))
    return voting.engines_answered(rows)


@query("call_progress", f"""WITH {_DEAD},
size AS (SELECT case_id, count(DISTINCT batch) * count(DISTINCT engine) AS total_steps
         FROM event_calls GROUP BY ALL)
SELECT case_id, seq, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS step, total_steps
FROM ran JOIN size USING (case_id)""")
def call_progress(spark, sf):
    every = planted(spark, sf, "event_calls")
    size = every.groupBy("case_id").agg(F.count_distinct("batch").alias("n_batches"),
                                        F.count_distinct("engine").alias("n_engines"))
    return voting.progress(voting.drop_dead_engines(every), size).select("case_id", "seq", "step", "total_steps")


@query("enabled_engines", """
WITH available AS (SELECT DISTINCT user_id AS case_id, 'e' || (event_id % 5) AS engine FROM events
                   WHERE NOT (event_type = 'signup' AND user_id % 3 <> 0)),
chosen AS (SELECT DISTINCT user_id AS case_id, 'e' || (event_id % 7) AS engine FROM events
           WHERE event_type = 'signup' AND user_id % 3 <> 0),
marked AS (SELECT a.case_id, a.engine, c.engine IS NOT NULL AS hit FROM available a
           LEFT JOIN chosen c ON a.case_id = c.case_id AND a.engine = c.engine)
SELECT case_id, engine FROM marked QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY case_id)""")
def enabled_engines(spark, sf):
    events = table(spark, sf, "events")
    available = events.where("not (event_type = 'signup' and user_id % 3 <> 0)").selectExpr(
        "user_id as case_id", "'e' || (event_id % 5) as engine").distinct()
    chosen = events.where("event_type = 'signup' and user_id % 3 <> 0").selectExpr(
        "user_id as case_id", "'e' || (event_id % 7) as engine")
    return voting.enabled_engines(available, chosen)


_SUPPLIERS = """s AS (SELECT s_suppkey % 7 AS case_id, s_name AS engine, r_name = 'EUROPE' AS eu
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _suppliers(spark, sf):
    joined = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr("s_suppkey % 7 as case_id", "s_name as engine", "r_name = 'EUROPE' as eu")


@query("region_policy", f"WITH {_SUPPLIERS} SELECT case_id, engine, eu FROM s WHERE case_id % 2 = 1 OR eu")
def region_policy(spark, sf):
    return voting.in_region(_suppliers(spark, sf), F.col("case_id") % 2 == 0)


@query("region_partition", f"""WITH {_SUPPLIERS}
SELECT case_id, count(*) FILTER (WHERE eu) AS inside, count(*) FILTER (WHERE NOT eu) AS outside
FROM s GROUP BY ALL""")
def region_partition(spark, sf):
    return voting.region_counts(_suppliers(spark, sf))


@query("limited_source_pages", """
WITH p AS (SELECT user_id AS doc_id, event_id AS page_no,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_ord FROM events)
SELECT doc_id, page_no, engine FROM p, (VALUES ('groq'), ('claude')) AS e(engine)
WHERE engine <> 'groq' OR (page_ord - 1) % 20 = 0""")
def limited_source_pages(spark, sf):
    pages = table(spark, sf, "events").selectExpr("1 as case_id", "user_id as doc_id", "event_id as page_no")
    batches = documents.page_batches(pages, F.col("doc_id").cast("string"))
    return documents.limited_pages(batches, ["groq", "claude"]).select("doc_id", "page_no", "engine")


_BOXES = ["l_orderkey as case_id",
          f"split_part('{ENGINES}', ',', cast(l_suppkey % 9 + 1 as int)) as engine",
          "l_quantity as w", "cast(l_linenumber * 3 as double) as h", "l_discount * 100 as x",
          "l_tax * 100 as y"]
_ORDER = "list_position(['" + "','".join(fv.BOX_PRIORITY) + "'], engine)"


@query("first_valid_box", f"""
WITH b AS (SELECT case_id, engine, max(w) AS w, max(h) AS h, round(max(x), 6) AS x, round(max(y), 6) AS y
           FROM (SELECT {', '.join(_BOXES)} FROM lineitem) GROUP BY ALL)
SELECT case_id, engine, x, y, w, h FROM b WHERE w > 15 AND h > 8 AND {_ORDER} > 0
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {_ORDER}) = 1""")
def first_valid_box(spark, sf):
    boxes = table(spark, sf, "lineitem").selectExpr(*_BOXES).groupBy("case_id", "engine").agg(
        *[F.max(c).alias(c) for c in "xywh"])
    return voting.first_valid_box(boxes)
