"""Defaults, overlays, the edit log and the fill report."""

import datetime

from pyspark.sql import functions as F

from bindings.common import cte, planted, query, table
from casefuse import fixed_values as fv
from casefuse.functions.text import label_for
from casefuse.operators import edits as ed
from casefuse.operators import overlay as ov
from casefuse.plans.forms import plan_fill

DAY = datetime.date(2026, 7, 23)
_VALUES = {
    "Fecha": "case c_custkey % 4 when 0 then ' ' when 1 then '9' else null end",
    "de": "case when c_custkey % 3 = 0 then 'mayo' else '' end",
    "Dirección": "case when c_custkey % 5 = 0 then '  ' else 'Calle ' || c_custkey end",
    "CP": "'' || (10000 + c_custkey % 40000)",
    "CP_2": "case when c_custkey % 2 = 0 then '99999' else '' end",
    "Población": "c_mktsegment",
    "Responsable": "case when c_custkey % 6 = 0 then c_name end",
}
_LONG = " UNION ALL ".join(f"SELECT c_custkey AS case_id, '{k}' AS field, {v} AS value FROM customer"
                           for k, v in _VALUES.items())
_VALS = f"vals AS (SELECT * FROM ({_LONG}) WHERE value IS NOT NULL)"
_CASES = "cases AS (SELECT c_custkey AS case_id FROM customer)"


def _values(spark, sf):
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.expr(v).alias("value")) for k, v in _VALUES.items()])
    long = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(rows).alias("r"))
    return long.select("case_id", "r.*").where(F.col("value").isNotNull())


def _cases(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))


_DATES = "(VALUES ('Fecha', '23'), ('de', 'julio'), ('año', '6')) AS d(field, value)"
_DATED = f"""{_VALS}, {_CASES},
dated AS (SELECT c.case_id, d.field, coalesce(v.value, d.value) AS value FROM cases c CROSS JOIN {_DATES}
          LEFT JOIN vals v ON v.case_id = c.case_id AND v.field = d.field AND trim(v.value) <> ''
          UNION ALL SELECT * FROM vals WHERE field NOT IN ('Fecha', 'de', 'año'))"""


@query("date_defaults", f"WITH {_DATED} SELECT * FROM dated")
def date_defaults(spark, sf):
    return ov.default_dates(_values(spark, sf), _cases(spark, sf), DAY)


@query("constant_default", f"""WITH {_VALS}, {_CASES}
SELECT * FROM vals UNION ALL SELECT case_id, 'Responsable', 'Ana Ruiz' FROM cases
WHERE case_id NOT IN (SELECT case_id FROM vals WHERE field = 'Responsable')""")
def constant_default(spark, sf):
    return ov.default_value(_values(spark, sf), _cases(spark, sf), "Responsable", "Ana Ruiz")


_PROFILE = "SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'CP' ELSE 'Teléfono' END AS field, 'p' || c_nationkey AS value FROM customer"


@query("profile_overlay", f"""WITH {_VALS}, profile AS ({_PROFILE})
SELECT coalesce(p.case_id, v.case_id) AS case_id, coalesce(p.field, v.field) AS field, coalesce(p.value, v.value) AS value
FROM vals v FULL JOIN profile p ON v.case_id = p.case_id AND v.field = p.field""")
def profile_overlay(spark, sf):
    profile = table(spark, sf, "customer").selectExpr(
        "c_custkey as case_id", "case when c_custkey % 2 = 0 then 'CP' else 'Teléfono' end as field",
        "'p' || c_nationkey as value")
    return ov.overlay(_values(spark, sf), profile)


@query("copied_block", f"""WITH {_VALS},
copied AS (SELECT case_id, field || '_2' AS field, value FROM vals
           WHERE field IN ('Dirección', 'CP', 'Población', 'Provincia') AND trim(value) <> '')
SELECT coalesce(c.case_id, v.case_id) AS case_id, coalesce(c.field, v.field) AS field, coalesce(c.value, v.value) AS value
FROM vals v FULL JOIN copied c ON v.case_id = c.case_id AND v.field = c.field""")
def copied_block(spark, sf):
    return ov.copy_block(_values(spark, sf))


_EDITS_SQL = cte("edits")


def _edits(spark, sf):
    rows = planted(spark, sf, "edits")
    linked = F.when(F.col("linked_field").isNotNull(), F.create_map("linked_field", F.concat(F.lit("l"), "value")))
    return rows.withColumn("linked", linked).drop("linked_field")


@query("edit_replay_last", f"""WITH {_EDITS_SQL},
e AS (SELECT * FROM edits WHERE action <> 'undo'),
changes AS (
  SELECT case_id, seq, 0 AS pos, field, CASE WHEN action = 'dismiss' OR (action = 'set' AND trim(value) = '') THEN NULL ELSE value END AS value, action, origin FROM e
  UNION ALL SELECT case_id, seq, 1, linked_field, 'l' || value, action, origin FROM e WHERE linked_field IS NOT NULL),
vals AS (SELECT case_id, field, value, action, row_number() OVER (PARTITION BY case_id, field ORDER BY seq DESC, pos DESC) AS rn FROM changes),
orig AS (SELECT case_id, field, CASE WHEN action = 'choose' THEN origin END AS origin,
                row_number() OVER (PARTITION BY case_id, field ORDER BY seq DESC, pos DESC) AS rn
         FROM changes WHERE action IN ('choose', 'dismiss'))
SELECT v.case_id, v.field, v.value, CASE WHEN v.value IS NULL THEN 'EMPTY' ELSE 'USER' END AS state, o.origin
FROM vals v LEFT JOIN orig o ON v.case_id = o.case_id AND v.field = o.field AND o.rn = 1 WHERE v.rn = 1""")
def edit_replay_last(spark, sf):
    return ed.last_edits(_edits(spark, sf).where("action <> 'undo'"))


# One step per edit and case, with the open edits kept as a list of at most twenty.
REPLAY_SQL = f"""WITH RECURSIVE {_EDITS_SQL},
steps AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n FROM edits),
run AS (
  SELECT case_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS undone FROM (SELECT DISTINCT case_id FROM edits)
  UNION ALL
  SELECT s.case_id, s.n,
    CASE WHEN s.action <> 'undo' THEN list_slice(list_append(r.stack, s.seq), greatest(len(r.stack) + 1 - 19, 1), len(r.stack) + 1)
         ELSE list_slice(r.stack, 1, len(r.stack) - 1) END,
    CASE WHEN s.action = 'undo' AND len(r.stack) > 0 THEN r.stack[len(r.stack)] END
  FROM run r JOIN steps s ON s.case_id = r.case_id AND s.n = r.n + 1),
e AS (SELECT * FROM edits WHERE action <> 'undo' AND (case_id, seq) NOT IN (SELECT case_id, undone FROM run WHERE undone IS NOT NULL)),
changes AS (
  SELECT case_id, seq, 0 AS pos, field, CASE WHEN action = 'dismiss' OR (action = 'set' AND trim(value) = '') THEN NULL ELSE value END AS value, action, origin FROM e
  UNION ALL SELECT case_id, seq, 1, linked_field, 'l' || value, action, origin FROM e WHERE linked_field IS NOT NULL),
vals AS (SELECT case_id, field, value, action, row_number() OVER (PARTITION BY case_id, field ORDER BY seq DESC, pos DESC) AS rn FROM changes),
orig AS (SELECT case_id, field, CASE WHEN action = 'choose' THEN origin END AS origin,
                row_number() OVER (PARTITION BY case_id, field ORDER BY seq DESC, pos DESC) AS rn
         FROM changes WHERE action IN ('choose', 'dismiss'))
SELECT v.case_id, v.field, v.value, CASE WHEN v.value IS NULL THEN 'EMPTY' ELSE 'USER' END AS state, o.origin
FROM vals v LEFT JOIN orig o ON v.case_id = o.case_id AND v.field = o.field AND o.rn = 1 WHERE v.rn = 1"""


@query("edit_replay_undo", REPLAY_SQL)
def edit_replay_undo(spark, sf):
    return ed.replay_edits(_edits(spark, sf))


_TIPO = "split_part('CIF,nif,NIE,otro,', ',', cast(p_partkey % 5 + 1 as int))"


@query("checkbox_states", f"""
SELECT case_id, checkbox, CASE WHEN upper(tipo) = kind THEN '/On' ELSE '/Off' END AS state
FROM (SELECT p_partkey AS case_id, {_TIPO} AS tipo FROM part), (VALUES ('CIF', 'CIF'), ('NIF', 'NIF'), ('NIE', 'undefined')) AS k(kind, checkbox)
WHERE upper(tipo) IN ('CIF', 'NIF', 'NIE')""")
def checkbox_states(spark, sf):
    return ov.checkbox_states(table(spark, sf, "part").selectExpr("p_partkey as case_id", f"{_TIPO} as tipo"))


_MAPPING = "SELECT c_custkey AS case_id, 'CP' AS canonical, 'Cod. Postal ' || (c_custkey % 3) AS real FROM customer WHERE c_custkey % 2 = 0"
_FORM = """form AS (SELECT c_custkey AS case_id, unnest(['Fecha', 'de', 'año', 'Dirección', 'Cod. Postal 0', 'Cod. Postal 1']) AS real FROM customer
  UNION ALL SELECT c_custkey, 'Responsable' FROM customer WHERE c_custkey % 7 = 0)"""
_PLAN = f"""{_DATED}, mapping AS ({_MAPPING}), {_FORM},
base AS (SELECT * FROM vals WHERE field NOT IN ('Fecha', 'de', 'año')
         UNION ALL SELECT case_id, d.field, d.value FROM cases, {_DATES}
         UNION ALL SELECT case_id, 'Responsable', 'Ana Ruiz' FROM cases WHERE case_id NOT IN (SELECT case_id FROM vals WHERE field = 'Responsable')),
plan AS (SELECT b.case_id, b.field, b.value, coalesce(m.real, b.field) AS real FROM base b
         LEFT JOIN mapping m ON m.case_id = b.case_id AND m.canonical = b.field),
marked AS (SELECT p.*, f.real IS NOT NULL AS exists FROM plan p LEFT JOIN form f ON f.case_id = p.case_id AND f.real = p.real)"""


def _plan(spark, sf):
    customers = table(spark, sf, "customer")
    mapping = customers.where("c_custkey % 2 = 0").selectExpr(
        "c_custkey as case_id", "'CP' as canonical", "'Cod. Postal ' || (c_custkey % 3) as real")
    names = ["Fecha", "de", "año", "Dirección", "Cod. Postal 0", "Cod. Postal 1"]
    form = customers.select(F.col("c_custkey").alias("case_id"), F.explode(F.array(*map(F.lit, names))).alias("real"))
    form = form.unionByName(customers.where("c_custkey % 7 = 0").selectExpr("c_custkey as case_id", "'Responsable' as real"))
    return plan_fill(_values(spark, sf), _cases(spark, sf), mapping, form, DAY, ("Responsable", "Ana Ruiz"))


@query("renamed_fields", f"WITH {_PLAN} SELECT case_id, field, value, real FROM marked")
def renamed_fields(spark, sf):
    return _plan(spark, sf).select("case_id", "field", "value", "real")


@query("fill_report", f"""WITH {_PLAN}
SELECT case_id, count(*) FILTER (WHERE exists) AS n_filled, count(*) FILTER (WHERE NOT exists) AS n_missing,
       coalesce(string_agg(field, '|' ORDER BY field) FILTER (WHERE NOT exists), '') AS missing FROM marked GROUP BY ALL""")
def fill_report(spark, sf):
    return ov.fill_report(_plan(spark, sf))


_LABELS = "CASE field " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, label, *_ in fv.FIELD_CATALOG) + " ELSE field END"


@query("field_labels", f"WITH {_VALS} SELECT field, {_LABELS} AS label, count(*) AS n FROM vals GROUP BY ALL")
def field_labels(spark, sf):
    return _values(spark, sf).groupBy("field", label_for(F.col("field")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("type_override", """
WITH voted AS (SELECT c_custkey AS case_id, split_part('CIF,NIF,NIE', ',', CAST(c_custkey % 3 + 1 AS INT)) AS tipo FROM customer WHERE c_custkey % 5 <> 0),
chosen AS (SELECT c_custkey AS case_id, 'NIE' AS tipo FROM customer WHERE c_custkey % 4 = 0)
SELECT coalesce(c.case_id, v.case_id) AS case_id, coalesce(c.tipo, v.tipo) AS tipo FROM voted v FULL JOIN chosen c ON v.case_id = c.case_id""")
def type_override(spark, sf):
    customers = table(spark, sf, "customer")
    voted = customers.where("c_custkey % 5 <> 0").selectExpr(
        "c_custkey as case_id", "split_part('CIF,NIF,NIE', ',', cast(c_custkey % 3 + 1 as int)) as tipo")
    return ov.override_type(voted, customers.where("c_custkey % 4 = 0").selectExpr("c_custkey as case_id", "'NIE' as tipo"))
