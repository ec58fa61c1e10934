"""Candidates, conflicts, intruders, decisions and the whole consolidation."""

from pyspark.sql import functions as F

from bindings.common import calls, calls_by_case, cte, dealt_calls, query, table
from bindings.parsing import PROPOSALS, normal_form, parsed_from
from casefuse import fixed_values as fv
from casefuse.operators import replies, resolve, voting
from casefuse.plans.consolidation import (
    call_issues, consolidate, counted_calls, identification, reported_types)
from casefuse.sources.tables import bucketed

COVERAGE = ["NIE", "CP", "Teléfono", "Email Comercial", "Actividad principal del negocio"]

_RISKY = " OR ".join(
    f"(field = '{field}' AND (document IN ({', '.join(map(repr, types))}) OR doc_type IN ({', '.join(map(repr, types))})))"
    for field, types in fv.RISKY_SOURCES.items())
_SUFFIX = "CASE WHEN p.tipo = 'direccion_comercio' THEN '_2' ELSE '' END"
_CHAIN = f"""{PROPOSALS},
votes AS (SELECT case_id, doc_id, engine, seq, pos, field, {normal_form('field', 'value')} AS value FROM proposals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, field, value ORDER BY seq, pos) AS rn FROM votes WHERE value IS NOT NULL),
voted AS (SELECT case_id, field, value, list_sort(list_distinct(list(engine))) AS engines, min(seq) AS first_seq,
                 max(pos) FILTER (WHERE rn = 1) AS first_pos, max(doc_id) FILTER (WHERE rn = 1) AS doc_id
          FROM ranked GROUP BY ALL),
doc_types AS (SELECT case_id, doc_id, arg_min(trim(tipo_documento), seq) AS doc_type FROM parsed
              WHERE good AND trim(tipo_documento) <> '' GROUP BY ALL),
pk AS (SELECT case_id, doc_id, engine, seq, unnest(paquetes) AS p, generate_subscripts(paquetes, 1) - 1 AS pkg_seq
       FROM parsed WHERE good),
entries AS (SELECT case_id, doc_id, seq, pkg_seq, p, unnest(map_entries(p.datos)) AS e,
                   generate_subscripts(map_entries(p.datos), 1) - 1 AS pos FROM pk),
package_cands AS (
  SELECT case_id, doc_id, 'Dirección' || {_SUFFIX} AS field, map_extract_value(p.datos, 'Dirección') AS value,
         0 AS src, seq, pkg_seq AS a, 0 AS b, coalesce(p.fuente, '') AS document, CAST([] AS VARCHAR[]) AS engines,
         coalesce(p.etiqueta, '') AS note,
         list_transform(list_filter(map_entries(p.datos), lambda e: e.key IN ('CP', 'Población', 'Provincia') AND trim(e.value) <> ''),
                        lambda e: {{'k': e.key || {_SUFFIX}, 'v': e.value}}) AS linked
  FROM pk WHERE p.tipo IN ('direccion', 'direccion_comercio') AND trim(coalesce(map_extract_value(p.datos, 'Dirección'), '')) <> ''
  UNION ALL
  SELECT case_id, doc_id, e.key, e.value, 0, seq, pkg_seq, pos, coalesce(p.fuente, ''), [], coalesce(p.etiqueta, ''), []
  FROM entries WHERE p.tipo NOT IN ('direccion', 'direccion_comercio') AND trim(e.value) <> ''),
cands AS (
  SELECT p.*, doc_type FROM package_cands p LEFT JOIN doc_types t ON p.case_id = t.case_id AND p.doc_id = t.doc_id
  UNION ALL
  SELECT v.case_id, v.doc_id, field, value, 1, first_seq, first_pos, 0, coalesce(doc_type, 'documento analizado'), engines, '', [], doc_type
  FROM voted v LEFT JOIN doc_types t ON v.case_id = t.case_id AND v.doc_id = t.doc_id
  WHERE field NOT IN ('Fecha', 'de', 'año')),
claims AS (SELECT case_id, doc_id, seq, pkg_seq, upper(trim(map_extract_value(p.datos, 'NIE'))) AS holder FROM pk
           WHERE p.tipo = 'empresa'),
holders AS (SELECT case_id, doc_id, holder FROM claims WHERE holder <> ''
            QUALIFY row_number() OVER (PARTITION BY case_id, doc_id ORDER BY seq DESC, pkg_seq DESC) = 1),
counted AS (SELECT case_id, holder, count(*) AS n FROM holders GROUP BY ALL),
tops AS (SELECT * FROM counted QUALIFY rank() OVER (PARTITION BY case_id ORDER BY n DESC) = 1),
expected AS (SELECT case_id, min(holder) AS expected, min(n) AS n_documents FROM tops GROUP BY case_id HAVING count(*) = 1),
flagged AS (SELECT c.* EXCLUDE (note), coalesce(h.holder <> x.expected, false) AS intruder,
    CASE WHEN h.holder <> x.expected
         THEN CASE WHEN note <> '' THEN note || ' · ' ELSE '' END || 'este documento parece de otro titular (' || h.holder || ')'
         ELSE note END AS note
  FROM cands c LEFT JOIN holders h ON c.case_id = h.case_id AND c.doc_id = h.doc_id LEFT JOIN expected x ON c.case_id = x.case_id),
risked AS (SELECT *, intruder OR coalesce({_RISKY}, false) AS risky, lower(trim(value)) AS value_fold FROM flagged),
firsts AS (SELECT *, row_number() OVER (PARTITION BY case_id, field, value_fold ORDER BY src, seq, a, b) AS rn FROM risked),
backing AS (SELECT case_id, field, value_fold, list_sort(list_distinct(flatten(list(engines)))) AS all_engines, count(*) AS n_rows
            FROM risked GROUP BY ALL),
merged AS (SELECT f.* EXCLUDE (engines, rn), all_engines AS engines, n_rows FROM firsts f JOIN backing USING (case_id, field, value_fold)
           WHERE rn = 1),
protected AS (SELECT c_custkey AS case_id, unnest(['Teléfono', 'CP']) AS field FROM customer WHERE c_custkey % 3 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY src, seq, a, b) AS rn,
                    count(*) OVER (PARTITION BY case_id, field) AS n_values FROM merged),
decisions AS (SELECT n.* EXCLUDE (rn), CASE WHEN p.field IS NOT NULL THEN 'USER' WHEN n_values > 1 THEN 'CONFLICT'
                     WHEN risky THEN 'WARN' ELSE 'AI' END AS state
              FROM numbered n LEFT JOIN protected p ON n.case_id = p.case_id AND n.field = p.field WHERE rn = 1),
links AS (SELECT case_id, unnest(linked).k AS field, unnest(linked).v AS value, field AS via, document FROM decisions WHERE state = 'AI'),
filled AS (
  SELECT case_id, field, value, field AS via, document FROM decisions WHERE state = 'AI'
  UNION ALL
  SELECT l.* FROM links l WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.case_id = l.case_id AND d.field = l.field)
    AND NOT EXISTS (SELECT 1 FROM protected p WHERE p.case_id = l.case_id AND p.field = l.field))"""

# Whole plan: dead engines cut, coverage cut, then the chain above.
_ALIVE = """
died AS (SELECT case_id, engine, min(seq) AS died_at FROM calls WHERE http_code IN (401, 403, 404) GROUP BY ALL),
alive AS (SELECT c.* FROM calls c LEFT JOIN died d USING (case_id, engine) WHERE died_at IS NULL OR seq <= died_at)"""
_FULL = f"""{cte('calls')},{_ALIVE},{parsed_from('alive').replace('parsed AS (', 'all_parsed AS (')},
{PROPOSALS.replace('FROM parsed', 'FROM all_parsed').replace('listed', 'all_listed').replace('proposals AS', 'all_proposals AS')},
reached AS (SELECT case_id, field, min(seq) AS seq FROM all_proposals
            WHERE field IN ('{"','".join(COVERAGE)}') AND {normal_form('field', 'value')} IS NOT NULL GROUP BY ALL),
cut AS (SELECT case_id, max(seq) AS cut_seq FROM reached GROUP BY case_id HAVING count(*) = {len(COVERAGE)}),
parsed AS (SELECT a.* FROM all_parsed a LEFT JOIN cut USING (case_id) WHERE cut_seq IS NULL OR seq <= cut_seq),
{_CHAIN}"""
_PLAIN = f"{cte('calls')},{parsed_from('calls')},{_CHAIN}"


def _protected(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr(
        "c_custkey as case_id", "explode(array('Teléfono', 'CP')) as field")


class _Stages:
    """Each stage on all calls, without cuts."""

    def __init__(self, spark, sf):
        # Decoded once: every branch below reads the written replies. Unless some case is hot, they
        # lie in buckets of a case, and no candidate is shuffled for what is told of cases and fields.
        rows, buckets, dealt_by = calls_by_case(spark, sf)
        parsed = replies.digest(replies.parse_replies(rows).drop("text"))
        self.parsed = bucketed(parsed, "parsed-replies", buckets, dealt_by)
        self.packages = replies.packages(self.parsed)
        self.types = reported_types(self.parsed)
        self.holders = resolve.document_holders(self.packages)
        self.expected = resolve.expected_holder(self.holders)
        self.foreign = resolve.intruder_documents(self.holders, self.expected)
        self.merged = resolve.merge_candidates(resolve.reply_candidates(self.parsed))
        self.protected = _protected(spark, sf)
        if dealt_by == ["case_id"]:
            self.protected = resolve.protected_by_case(self.protected)
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def decisions(self, protected=None):
        firsts = resolve.first_candidates(self.merged, protected)
        return resolve.states(resolve.trace(firsts, self.types, self.foreign))

    def candidates(self, fields=None):
        """Candidates of packages and voted values, only of some fields if given."""
        voted = voting.aggregate_votes(replies.votes(self.parsed, fields))
        rows = resolve.package_candidates(self.packages).unionByName(resolve.proposal_candidates(voted))
        return rows if fields is None else rows.where(F.col("field").isin(*fields))


@query("package_candidates", f"""WITH {_PLAIN}
SELECT case_id, field, value, seq, a AS pkg_seq, document, note,
       array_to_string(list_sort(list_transform(linked, lambda x: x.k || '=' || x.v)), '|') AS linked FROM package_cands""")
def package_candidates(spark, sf):
    rows = resolve.package_candidates(replies.packages(replies.parse_replies(calls(spark, sf))))
    linked = F.array_sort(F.transform(F.map_entries("linked"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("case_id", "field", "value", "ord.seq", "ord.pkg_seq", "document", "note",
                       F.array_join(linked, "|").alias("linked"))


@query("linked_values", f"""WITH {_PLAIN}
SELECT case_id, via, l.k AS field, l.v AS value, count(*) AS n
FROM (SELECT case_id, field AS via, unnest(linked) AS l FROM package_cands) GROUP BY ALL""")
def linked_values(spark, sf):
    rows = resolve.package_candidates(replies.packages(replies.parse_replies(calls(spark, sf))))
    return rows.select("case_id", F.col("field").alias("via"), F.explode("linked").alias("to", "value")).groupBy(
        "case_id", "via", F.col("to").alias("field"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("applied_packages", f"""WITH {_PLAIN}
SELECT case_id, seq, pkg_seq, e.key || CASE WHEN case_id % 2 = 0 AND e.key IN ('Dirección', 'CP', 'Población', 'Provincia')
       THEN '_2' ELSE '' END AS field, e.value AS value FROM entries WHERE trim(e.value) <> ''""")
def applied_packages(spark, sf):
    pkgs = replies.packages(replies.parse_replies(calls(spark, sf)))
    return resolve.apply_package(pkgs, F.col("case_id") % 2 == 0)


@query("merged_candidates", f"""WITH {_PLAIN}
SELECT case_id, field, value_fold, value, document, array_to_string(engines, '|') AS engines FROM merged""")
def merged_candidates(spark, sf):
    s = _Stages(spark, sf)
    return resolve.trace(s.merged, s.types).select(
        "case_id", "field", "value_fold", "value", "document", "engines")


@query("document_holders", f"WITH {_PLAIN} SELECT case_id, doc_id, holder FROM holders")
def document_holders(spark, sf):
    return _Stages(spark, sf).holders


@query("expected_holders", f"WITH {_PLAIN} SELECT case_id, expected, n_documents FROM expected")
def expected_holders(spark, sf):
    return _Stages(spark, sf).expected


@query("intruder_flags", f"""WITH {_PLAIN}
SELECT case_id, doc_id, note, count(*) AS n_candidates FROM flagged WHERE intruder GROUP BY ALL""")
def intruder_flags(spark, sf):
    # Counted before they meet the foreign documents.
    s = _Stages(spark, sf)
    counted = s.candidates().groupBy("case_id", "doc_id", "note").agg(F.count(F.lit(1)).alias("n"))
    flagged = resolve.mark_intruders(counted.join(s.foreign, ["case_id", "doc_id"]))
    return flagged.groupBy("case_id", "doc_id", "note").agg(F.sum("n").alias("n_candidates"))


@query("risky_sources", f"""WITH {_PLAIN}
SELECT field, document, count(*) AS n FROM risked WHERE risky AND NOT intruder GROUP BY ALL""")
def risky_sources(spark, sf):
    # A value that no intruder gave is risky in few fields only.
    s = _Stages(spark, sf)
    counted = s.candidates(list(fv.RISKY_SOURCES)).groupBy(
        "case_id", "doc_id", "field", "document", F.struct("ord.src").alias("ord")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("note", F.lit(""))
    flagged = resolve.trace(counted, s.types, s.foreign).where("risky and not intruder")
    return flagged.groupBy("field", "document").agg(F.sum("n").alias("n"))


@query("field_decisions", f"""WITH {_PLAIN}
SELECT case_id, field, CASE WHEN n_values > 1 THEN 'CONFLICT' WHEN risky THEN 'WARN' ELSE 'AI' END AS state,
       n_values, value FROM numbered WHERE rn = 1""")
def field_decisions(spark, sf):
    return _Stages(spark, sf).decisions().select("case_id", "field", "state", "n_values", "value")


@query("protected_fields", f"WITH {_PLAIN} SELECT case_id, field, state FROM decisions WHERE state = 'USER'")
def protected_fields(spark, sf):
    s = _Stages(spark, sf)
    return s.decisions(s.protected).where("state = 'USER'").select("case_id", "field", "state")


@query("autofilled_values", f"WITH {_PLAIN} SELECT case_id, field, value, via, document FROM filled")
def autofilled_values(spark, sf):
    s = _Stages(spark, sf)
    return resolve.autofill(s.decisions(s.protected), s.protected).select(
        "case_id", "field", "value", "via", "document")


_SECTIONS = "CASE " + " ".join(f"WHEN field = '{k}' THEN '{sec}'" for k, _, sec, _ in fv.FIELD_CATALOG if sec) + " END"


@query("pending_decisions", f"""WITH {_PLAIN}
SELECT case_id, section, count(*) FILTER (WHERE state IN ('CONFLICT', 'WARN')) AS n_pending,
       count(*) FILTER (WHERE state IN ('CONFLICT', 'WARN')) = 0 AS ready
FROM (SELECT *, {_SECTIONS} AS section FROM decisions) GROUP BY ALL""")
def pending_decisions(spark, sf):
    from casefuse.functions.text import section_of
    s = _Stages(spark, sf)
    decisions = s.decisions(s.protected).withColumn("section", section_of(F.col("field")))
    return resolve.pending_decisions(decisions, "section")


@query("state_counts", f"""WITH {_PLAIN}
SELECT case_id, {', '.join(f"count(*) FILTER (WHERE state = '{s}') AS n_{s.lower()}" for s in ('AI', 'CONFLICT', 'WARN', 'USER'))}
FROM decisions GROUP BY ALL""")
def state_counts(spark, sf):
    s = _Stages(spark, sf)
    return resolve.state_counts(s.decisions(s.protected))


def consolidation(spark, sf):
    """The whole plan over the planted calls; decoded replies are staged once."""
    rows, buckets = dealt_calls(spark, sf)
    return consolidate(rows, None, _protected(spark, sf), COVERAGE, staged=True, buckets=buckets)


def _counted(spark, sf):
    """The calls that count for the whole plan, without the values of their replies."""
    rows, buckets = dealt_calls(spark, sf)
    return counted_calls(rows, COVERAGE, staged=True, buckets=buckets, values=False)


@query("consolidated_fields", f"""WITH {_FULL}
SELECT case_id, field, state, n_values, value, document, note, risky, array_to_string(engines, '|') AS engines
FROM decisions""")
def consolidated_fields(spark, sf):
    result = consolidation(spark, sf)
    return result.decisions.select("case_id", "field", "state", "n_values", "value", "document", "note",
                                   "risky", "engines")


@query("consolidated_values", f"""WITH {_FULL}
SELECT case_id, field, value, via, document FROM filled""")
def consolidated_values(spark, sf):
    result = consolidation(spark, sf)
    return result.values.select("case_id", "field", "value", "via", "document")


@query("identification_types", f"""WITH {_FULL},
n AS (SELECT case_id, tipo_identificacion AS tipo, count(*) AS n_votes, min(seq) AS first_seq FROM parsed
      WHERE good AND tipo_identificacion IS NOT NULL GROUP BY ALL)
SELECT case_id, tipo, n_votes FROM n QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n_votes DESC, first_seq) = 1""")
def identification_types(spark, sf):
    types = identification(_counted(spark, sf))
    return types.select("case_id", F.col("tipo_identificacion").alias("tipo"), "n_votes")


@query("engine_issues", f"""WITH {_FULL},
s AS (SELECT case_id, engine, seq, CASE
  WHEN http_code <> 200 THEN 'HTTP ' || http_code || ' — ' ||
    CASE WHEN json_valid(text) AND json_type(text, '$.error') NOT IN ('OBJECT', 'ARRAY')
         THEN json_extract_string(text, '$.error') ELSE substr(text, 1, 200) END
  WHEN NOT ok THEN error
  WHEN NOT good THEN 'respuesta no parseable — "' || coalesce(replace(substr(trim(text), 1, 180), chr(10), ' '), '(vacío)') || '"'
  END AS status FROM parsed),
last AS (SELECT case_id, engine, arg_max(status, seq) AS status FROM s WHERE status IS NOT NULL GROUP BY ALL)
SELECT case_id, engine, status, CASE {' '.join(f"WHEN regexp_matches(lower(status), '{p}') THEN '{n}'" for n, _, _, p in fv.FAILURE_RULES)}
  ELSE 'OTHER' END AS cause FROM last""")
def engine_issues(spark, sf):
    return call_issues(_counted(spark, sf))
