"""History, profiles, templates and sessions through written tables."""

from pyspark.sql import functions as F

from bindings.common import query, table
from casefuse.session import shared_dir
from casefuse.sources import history as hi
from casefuse.sources import tables as tb

MARKER = "perfil-de-caso"
_BASE36 = """list_reduce(list_transform(range(9), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz',
  CAST((ms // CAST(pow(36, 8 - i) AS BIGINT)) % 36 + 1 AS INT), 1)), lambda a, b: a || b)"""
_ID = f"'h_' || ltrim({_BASE36}, '0')"
_SAVED = f"""p AS (SELECT o_orderkey AS case_id, 1700000000000 + o_orderkey // 2 AS ms, o_orderpriority AS label, o_custkey, o_orderstatus FROM orders),
h AS (SELECT *, {_ID} AS id, strftime(epoch_ms(ms), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS guardado,
      CAST(2 + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_fields FROM p)"""


def _profiles(spark, sf):
    orders = table(spark, sf, "orders")
    rows = F.array(F.struct(F.lit("NIE").alias("field"), F.concat(F.lit("b"), "o_custkey").alias("value")),
                   F.struct(F.lit("CP").alias("field"), F.expr("case when o_custkey % 3 = 0 then ' ' else '46001' end").alias("value")),
                   F.struct(F.lit("Provincia").alias("field"), F.col("o_orderstatus").alias("value")))
    values = orders.select(F.col("o_orderkey").alias("case_id"), F.explode(rows).alias("r")).select("case_id", "r.*")
    cases = orders.selectExpr("o_orderkey as case_id", "o_orderpriority as label",
                              "timestamp_millis(1700000000000 + o_orderkey div 2) as saved_at", "'' as fingerprint")
    return hi.build_profiles(values, cases, MARKER)


def _log(spark, sf):
    """Saved entries, then deletes of every fifth one, as two appends."""
    path = shared_dir(spark, "history")
    saved = hi.profile_json(_profiles(spark, sf))
    broken = F.when(F.col("case_id") % 7 == 0, F.substring("json", 1, 10)).otherwise(F.col("json"))
    tb.append(saved.select(F.col("case_id").alias("owner"), "id", broken.alias("json"), F.lit(0).alias("op_seq"), F.lit(False).alias("deleted")), path)
    tb.append(saved.where("case_id % 5 = 0").select(
        F.col("case_id").alias("owner"), "id", F.lit(None).cast("string").alias("json"), F.lit(1).alias("op_seq"), F.lit(True).alias("deleted")), path)
    return spark.read.parquet(path)


@query("saved_history", f"WITH {_SAVED} SELECT case_id, id, label, guardado, n_fields FROM h")
def saved_history(spark, sf):
    path = shared_dir(spark, "profiles")
    tb.append(_profiles(spark, sf), path)
    return spark.read.parquet(path).select("case_id", "id", "label", "guardado", F.size("campos").alias("n_fields"))


@query("history_list", f"WITH {_SAVED} SELECT case_id AS owner, id, label, guardado, n_fields FROM h WHERE case_id % 5 <> 0 AND case_id % 7 <> 0")
def history_list(spark, sf):
    return hi.list_history(_log(spark, sf))


@query("history_after_delete", f"WITH {_SAVED} SELECT case_id AS owner, id FROM h WHERE case_id % 5 <> 0")
def history_after_delete(spark, sf):
    return tb.latest(_log(spark, sf), ["owner", "id"], "op_seq").where("not deleted").select("owner", "id")


@query("profile_export", f"""WITH {_SAVED}
SELECT case_id, '{{"tipo":"{MARKER}","label":"' || label || '","guardado":"' || guardado || '","fingerprint":"","campos":{{' ||
  CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '"CP":"46001",' END || '"NIE":"b' || o_custkey || '","Provincia":"' || o_orderstatus || '"}},"fieldMapping":{{}}}}' AS json
FROM h""")
def profile_export(spark, sf):
    return hi.profile_json(_profiles(spark, sf)).select("case_id", "json")


_IMPORT = ["o_orderkey as case_id", "case o_orderkey % 6 when 0 then '{\"tipo\":\"otro\",\"label\":\"x\"}' when 1 then '{\"tipo\":' "
           f"when 2 then '{{\"label\":\"sin marca\"}}' else '{{\"tipo\":\"{MARKER}\",\"label\":\"L' || o_custkey || '\",\"campos\":{{\"CP\":\"' || o_orderkey || '\"}}}}' end as json"]


@query("profile_import", f"""WITH r AS (SELECT {', '.join(_IMPORT)} FROM orders)
SELECT case_id, json_extract_string(json, '$.label') AS label, json_extract_string(json, '$.campos.CP') AS cp FROM r
WHERE CASE WHEN json_valid(json) THEN json_extract_string(json, '$.tipo') = '{MARKER}' ELSE false END""")
def profile_import(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*_IMPORT)
    return hi.import_profiles(rows, MARKER).select("case_id", "profile.label", F.col("profile.campos")["CP"].alias("cp"))


@query("profile_import_rejects", f"""WITH r AS (SELECT {', '.join(_IMPORT)} FROM orders)
SELECT case_id, CASE WHEN NOT json_valid(json) THEN 'unreadable' ELSE 'wrong marker' END AS why FROM r
WHERE NOT CASE WHEN json_valid(json) THEN coalesce(json_extract_string(json, '$.tipo'), '') = '{MARKER}' ELSE false END""")
def profile_import_rejects(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*_IMPORT)
    return hi.rejected_profiles(rows, MARKER).select("case_id", "why")


@query("saved_templates", """
WITH ops AS (SELECT p_brand AS fingerprint, p_partkey AS op_seq, p_name AS real FROM part),
last AS (SELECT fingerprint, arg_max(real, op_seq) AS real FROM ops GROUP BY ALL)
SELECT fingerprint, unnest(['CP', 'NIE']) AS canonical, unnest([real, real || ' nie']) AS real FROM last""")
def saved_templates(spark, sf):
    path = shared_dir(spark, "templates")
    tb.append(table(spark, sf, "part").select(
        F.col("p_brand").alias("fingerprint"), F.col("p_partkey").alias("op_seq"),
        F.create_map(F.lit("CP"), F.col("p_name"), F.lit("NIE"), F.concat("p_name", F.lit(" nie"))).alias("mapping")), path)
    return hi.saved_mapping(spark.read.parquet(path))


_SNAP = ["user_id as case_id", "event_id as seq", "cast(event_id % 2 as int) as schema_version",
         "cast(event_id % 7 as int) as step", "event_type as value"]


@query("restored_sessions", f"""
WITH s AS (SELECT {', '.join(_SNAP)} FROM events),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) = 1)
SELECT case_id, seq, CAST(schema_version AS BIGINT) AS schema_version, value, CAST(CASE WHEN schema_version >= 1 THEN step
  WHEN step IN (0, 1, 2) THEN step WHEN step = 3 THEN 2 WHEN step = 4 THEN 3 ELSE 0 END AS BIGINT) AS step FROM last""")
def restored_sessions(spark, sf):
    path = shared_dir(spark, "sessions")
    tb.append(table(spark, sf, "events").selectExpr(*_SNAP), path)
    return hi.load_sessions(spark.read.parquet(path))


@query("migrated_steps", f"""
SELECT CAST(schema_version AS BIGINT) AS schema_version, CAST(step AS BIGINT) AS step, CAST(CASE WHEN schema_version >= 1 THEN step
  WHEN step IN (0, 1, 2) THEN step WHEN step = 3 THEN 2 WHEN step = 4 THEN 3 ELSE 0 END AS BIGINT) AS migrated, count(*) AS n
FROM (SELECT {', '.join(_SNAP)} FROM events) GROUP BY ALL""")
def migrated_steps(spark, sf):
    from casefuse.operators.overlay import migrate_step
    rows = table(spark, sf, "events").selectExpr(*_SNAP)
    step = migrate_step(F.col("step"), F.col("schema_version")).alias("migrated")
    return rows.groupBy("schema_version", "step", step).agg(F.count(F.lit(1)).alias("n"))
