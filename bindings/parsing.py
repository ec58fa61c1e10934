"""Reply parsing, normal forms and classification."""

from pyspark.sql import functions as F

from bindings.common import calls, cte, query, table
from casefuse import fixed_values as fv
from casefuse.functions import rules, text
from casefuse.operators import replies

_SPEC = ('{"sugerencias":"MAP(VARCHAR,VARCHAR)","tipo_identificacion":"VARCHAR","tipo_documento":"VARCHAR",'
         '"alternativas":"MAP(VARCHAR,STRUCT(valor VARCHAR, fuente VARCHAR, nota VARCHAR)[])",'
         '"paquetes":[{"tipo":"VARCHAR","etiqueta":"VARCHAR","fuente":"VARCHAR","datos":"MAP(VARCHAR,VARCHAR)"}]}')


def parsed_from(source):
    """Decoded replies of a call relation; groq keeps only its suggestions.

    The first of two values planted under one key is cut out of the text, as the last one counts.
    """
    return f"""
sliced AS (SELECT *, CASE WHEN ok THEN nullif(replace(regexp_extract(text, '\\{{.*\\}}', 0, 's'), '"CP":"9999",', ''), '') END AS found
  FROM {source}),
valid AS (SELECT *, CASE WHEN json_valid(found) THEN found END AS j FROM sliced),
decoded AS (SELECT *, CASE WHEN j IS NOT NULL THEN json_transform(j, '{_SPEC}') END AS r FROM valid),
parsed AS (SELECT case_id, doc_id, engine, seq, http_code, ok, error, text,
    r.sugerencias AS sugerencias, r.tipo_identificacion AS tipo_identificacion, r.tipo_documento AS tipo_documento,
    CASE WHEN engine <> 'groq' THEN r.alternativas END AS alternativas,
    CASE WHEN engine <> 'groq' THEN r.paquetes END AS paquetes,
    coalesce(r IS NOT NULL AND NOT coalesce(list_has_any(list_concat(json_type(j, '$.sugerencias.*'),
        json_type(j, '$.paquetes[*].datos.*'), json_type(j, '$.alternativas.*[*].valor'),
        json_type(j, '$.alternativas.*[*].fuente'), json_type(j, '$.alternativas.*[*].nota'),
        json_type(j, '$.paquetes[*].tipo'), json_type(j, '$.paquetes[*].etiqueta'), json_type(j, '$.paquetes[*].fuente'),
        [json_type(j, '$.tipo_documento'), json_type(j, '$.tipo_identificacion')]), ['OBJECT', 'ARRAY']), false)
      AND len(list_filter(r.paquetes, lambda p: p.tipo IS NULL)) = 0
      AND len(list_filter(flatten(map_values(r.alternativas)), lambda a: a.valor IS NULL)) = 0, false) AS good
    FROM decoded)"""


PARSED = f"{cte('calls')},{parsed_from('calls')}"
_SECOND = "CASE WHEN p.tipo = 'direccion_comercio' AND e.key IN ('Dirección','CP','Población','Provincia') " \
          "THEN e.key || '_2' ELSE e.key END"
PROPOSALS = f"""
listed AS (SELECT case_id, doc_id, engine, seq, list_concat(
    list_transform(map_entries(sugerencias), lambda e: {{'source': 'suggestion', 'field': e.key, 'value': e.value}}),
    coalesce(flatten(list_transform(map_entries(alternativas), lambda e: list_transform(e.value,
        lambda a: {{'source': 'alternative', 'field': e.key, 'value': a.valor}}))), []),
    coalesce(flatten(list_transform(paquetes, lambda p: list_transform(map_entries(p.datos),
        lambda e: {{'source': 'package', 'field': {_SECOND}, 'value': e.value}}))), [])) AS items
    FROM parsed WHERE good),
proposals AS (SELECT case_id, doc_id, engine, seq, unnest(items).source AS source, unnest(items).field AS field,
    unnest(items).value AS value, generate_subscripts(items, 1) - 1 AS pos FROM listed)"""


def normal_form(field, value):
    """SQL for the normal form of a value, by the exact field name."""
    v = f"trim({value}, ' \t')"
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    parts = f"string_split({v}, ',')"
    return f"""nullif(CASE
 WHEN {field} = 'Datos bancarios del DISTRIBUIDOR' THEN regexp_replace(upper({v}), '[\\s.\\-–—]', '', 'g')
 WHEN {field} IN ('NIE', 'NIF representante') THEN regexp_replace(upper({v}), '[\\s.\\-]', '', 'g')
 WHEN {field} IN ('CP', 'CP_2') AND length({digits}) BETWEEN 1 AND 4 THEN lpad({digits}, 5, '0')
 WHEN {field} = 'Nombre representante' AND len({parts}) = 2 AND trim({parts}[1]) <> '' AND trim({parts}[2]) <> ''
   THEN trim({parts}[2]) || ' ' || trim({parts}[1])
 ELSE {v} END, '')"""


def _parsed(spark, sf):
    return replies.parse_replies(calls(spark, sf))


@query("reply_slice", f"""WITH {cte('calls')}
SELECT seq, nullif(regexp_extract(text, '\\{{.*\\}}', 0, 's'), '') AS json FROM calls""")
def reply_slice(spark, sf):
    return calls(spark, sf).select("seq", replies.json_slice(F.col("text")).alias("json"))


@query("reply_decode", f"""WITH {PARSED}
SELECT case_id, seq, good AS decoded, CASE WHEN good THEN tipo_identificacion END AS tipo_identificacion,
       CASE WHEN good THEN tipo_documento END AS tipo_documento,
       coalesce(CASE WHEN good THEN len(paquetes) END, 0) AS n_packages FROM parsed""")
def reply_decode(spark, sf):
    return _parsed(spark, sf).select(
        "case_id", "seq", F.col("reply").isNotNull().alias("decoded"), "reply.tipo_identificacion",
        "reply.tipo_documento",
        F.coalesce(F.size("reply.paquetes"), F.lit(0)).cast("long").alias("n_packages"))


@query("reply_rejects", f"""WITH {PARSED}
SELECT case_id, doc_id, engine, seq,
       coalesce(replace(substr(trim(text), 1, 180), chr(10), ' '), '(vacío)') AS snippet
FROM parsed WHERE ok AND NOT good""")
def reply_rejects(spark, sf):
    return replies.reject_log(_parsed(spark, sf))


@query("error_messages", f"""WITH {cte('calls')}
SELECT seq, CASE WHEN json_valid(text) THEN coalesce(CASE WHEN json_type(text, '$.error') NOT IN ('OBJECT', 'ARRAY')
                 THEN json_extract_string(text, '$.error') END, substr(text, 1, 200))
                 ELSE substr(text, 1, 200) END AS message
FROM calls WHERE http_code <> 200""")
def error_messages(spark, sf):
    failed = calls(spark, sf).where("http_code <> 200")
    return failed.select("seq", replies.error_message(F.col("text")).alias("message"))


@query("call_status", f"""WITH {PARSED}
SELECT case_id, engine, seq, CASE
  WHEN http_code <> 200 THEN 'HTTP ' || http_code || ' — ' ||
    CASE WHEN json_valid(text) AND json_type(text, '$.error') NOT IN ('OBJECT', 'ARRAY')
         THEN json_extract_string(text, '$.error') ELSE substr(text, 1, 200) END
  WHEN NOT ok THEN error
  WHEN NOT good THEN 'respuesta no parseable — "' ||
    coalesce(replace(substr(trim(text), 1, 180), chr(10), ' '), '(vacío)') || '"' END AS status
FROM parsed""")
def call_status(spark, sf):
    return replies.call_status(_parsed(spark, sf)).select("case_id", "engine", "seq", "status")


@query("source_quality", f"""WITH {PARSED}
SELECT engine, count(*) AS n_replies, CAST(sum(cardinality(sugerencias)) AS BIGINT) AS n_suggestions,
  CAST(sum(coalesce(cardinality(alternativas), 0)) AS BIGINT) AS n_alternatives,
  CAST(sum(coalesce(len(paquetes), 0)) AS BIGINT) AS n_packages FROM parsed WHERE good GROUP BY ALL""")
def source_quality(spark, sf):
    r = "reply."
    n = lambda c: F.sum(F.coalesce(F.size(r + c), F.lit(0)))
    return _parsed(spark, sf).where(F.col("reply").isNotNull()).groupBy("engine").agg(
        F.count(F.lit(1)).alias("n_replies"), n("sugerencias").alias("n_suggestions"),
        n("alternativas").alias("n_alternatives"), n("paquetes").alias("n_packages"))


def _proposals_sql(source):
    return f"""WITH {PARSED},{PROPOSALS}
SELECT case_id, engine, seq, field, value FROM proposals WHERE source = '{source}'"""


def _proposals(spark, sf, source):
    rows = replies.proposals(_parsed(spark, sf)).where(F.col("source") == source)
    return rows.select("case_id", "engine", "seq", "field", "value")


@query("explode_suggestions", _proposals_sql("suggestion"))
def explode_suggestions(spark, sf):
    return _proposals(spark, sf, "suggestion")


@query("explode_alternatives", _proposals_sql("alternative"))
def explode_alternatives(spark, sf):
    return _proposals(spark, sf, "alternative")


@query("explode_packages", f"""WITH {PARSED},
p AS (SELECT case_id, seq, unnest(paquetes) AS p, generate_subscripts(paquetes, 1) - 1 AS pkg_seq
      FROM parsed WHERE good),
v AS (SELECT case_id, seq, pkg_seq, p.tipo AS tipo, unnest(map_entries(p.datos)) AS e FROM p)
SELECT case_id, seq, pkg_seq, tipo, e.key AS field, e.value AS value FROM v""")
def explode_packages(spark, sf):
    rows = replies.package_values(replies.packages(_parsed(spark, sf)))
    return rows.select("case_id", "seq", "pkg_seq", "tipo", "field", "value")


@query("normalised_votes", f"""WITH {PARSED},{PROPOSALS},
n AS (SELECT case_id, engine, seq, pos, field, {normal_form('field', 'value')} AS value FROM proposals)
SELECT * FROM n WHERE value IS NOT NULL""")
def normalised_votes(spark, sf):
    return replies.votes(_parsed(spark, sf)).select("case_id", "engine", "seq", "pos", "field", "value")


# Some texts get a no-break space at both ends.
_ENDS = "case when doc_id % 5 = 0 then chr(160) || text || chr(160) else text end"


@query("fold_text", f"""
SELECT doc_id, trim(regexp_replace(lower(strip_accents({_ENDS})), '\\s+', ' ', 'g'), ' ' || chr(160)) AS folded
FROM documents""")
def fold_text(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{_ENDS} as text")
    return rows.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("clean_identifiers", "SELECT page_id, regexp_replace(upper(url), '[\\s.\\-]', '', 'g') AS cleaned FROM pages")
def clean_identifiers(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_id(F.col("url")).alias("cleaned"))


_NAMES = "replace(p_name, ' ', '_') || case p_partkey % 4 when 0 then '_2' when 1 then ' 13' when 2 then '_x' else '' end"


@query("base_field_names", f"""
SELECT p_partkey, CASE WHEN regexp_matches(n, '[_\\s][0-9]+$') THEN regexp_replace(n, '[_\\s][0-9]+$', '') ELSE n END AS base
FROM (SELECT p_partkey, {_NAMES} AS n FROM part)""")
def base_field_names(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{_NAMES} as n")
    return rows.select("p_partkey", text.base_field(F.col("n")).alias("base"))


_RAW = ["c_custkey as case_id",
        "split_part('CP,NIE,Nombre representante,Datos bancarios del DISTRIBUIDOR,Teléfono,CP_2', ',', "
        "cast(c_custkey % 6 + 1 as int)) as field",
        "case c_custkey % 5 when 0 then ' ' || (c_custkey % 7000) || ' ' when 1 then c_name || ', ' || c_mktsegment "
        "when 2 then 'es 12-' || c_custkey || '.x' when 3 then '   ' else c_name end as raw"]


@query("normalise_values", f"""
SELECT case_id, field, {normal_form('field', 'raw')} AS value FROM (SELECT {', '.join(_RAW)} FROM customer)""")
def normalise_values(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(*_RAW)
    return rows.select("case_id", "field", text.normalise_value(F.col("field"), F.col("raw")).alias("value"))


@query("value_keys", """
SELECT lower(trim(p_name || CASE p_partkey % 2 WHEN 0 THEN ' ' ELSE '' END)) AS value_fold, count(*) AS n
FROM part GROUP BY ALL""")
def value_keys(spark, sf):
    name = F.expr("upper(p_name) || case p_partkey % 2 when 0 then ' ' else '' end")
    return table(spark, sf, "part").groupBy(text.value_key(name).alias("value_fold")).agg(
        F.count(F.lit(1)).alias("n"))


_PHRASES = ("Certificado de Situación Censal,Modelo 036,Tarjeta de identificación fiscal,Régimen especial de trabajo autónomo,"
            "Contrato de arrendamiento,Número de protocolo,código cuenta (IBAN),Permiso de residencia,"
            "Documento nacional de identidad,Pasaporte,nada,Modelo 036 con tarjeta acreditativa")
_TYPED = ["doc_id", "source as case_name", "doc_id as seq",
          f"text || ' ' || split_part('{_PHRASES}', ',', cast(doc_id % 12 + 1 as int)) as text",
          "case when doc_id % 9 = 0 then 'image/jpeg' else 'application/pdf' end as mime",
          "'doc' || doc_id || case when doc_id % 18 = 0 then '.PDF' else '' end as name"]
_FOLDED = "trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))"
_DOC_TYPE = "CASE " + " ".join(
    f"WHEN regexp_matches({_FOLDED}, '{pattern}') THEN '{name}'" for name, pattern in fv.DOC_TYPE_RULES
) + " ELSE 'Documento' END"
_TYPED_SQL = f"t AS (SELECT {', '.join(_TYPED)} FROM documents)"


@query("document_types", f"WITH {_TYPED_SQL} SELECT {_DOC_TYPE} AS doc_type, count(*) AS n FROM t GROUP BY ALL")
def document_types(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(*_TYPED)
    return rows.groupBy(rules.document_type(F.col("text")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


_LOCAL = f"CASE WHEN mime LIKE '%pdf%' OR lower(name) LIKE '%.pdf' THEN {_DOC_TYPE} ELSE 'Documento' END"


@query("local_document_types", f"WITH {_TYPED_SQL} SELECT doc_id, {_LOCAL} AS doc_type FROM t")
def local_document_types(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(*_TYPED)
    return rows.select("doc_id", rules.local_document_type(
        F.col("mime"), F.col("name"), F.col("text")).alias("doc_type"))


_TOLD = ["quality as case_id",
         "'n' || (doc_id % 200) || case when doc_id % 2 = 0 then ' (parte 1/2)' else '' end as label",
         "doc_id as seq",
         "case when toxic = 1 then ' ' else 'Tipo ' || (doc_id % 5) || ' ' end as doc_type"]


@query("type_fill_in", f"""
WITH told AS (SELECT case_id, split_part(label, ' (parte ', 1) AS name, arg_min(trim(doc_type), seq) AS reported
    FROM (SELECT {', '.join(_TOLD)} FROM labels) WHERE trim(doc_type) <> '' GROUP BY ALL),
docs AS (SELECT DISTINCT quality AS case_id, 'n' || (doc_id % 200) AS name,
    CASE WHEN doc_id % 200 % 3 = 0 THEN 'Modelo 036' WHEN doc_id % 200 % 3 = 1 THEN '' ELSE 'Documento' END AS local_type FROM labels)
SELECT CAST(case_id AS BIGINT) AS case_id, name, coalesce(nullif(nullif(local_type, 'Documento'), ''), reported, 'Documento') AS doc_type
FROM docs LEFT JOIN told USING (case_id, name)""")
def type_fill_in(spark, sf):
    from casefuse.operators.documents import fill_in_types
    labels = table(spark, sf, "labels")
    docs = labels.selectExpr(
        "quality as case_id", "'n' || (doc_id % 200) as name",
        "case when doc_id % 200 % 3 = 0 then 'Modelo 036' when doc_id % 200 % 3 = 1 then '' "
        "else 'Documento' end as local_type").distinct()
    return fill_in_types(docs, labels.selectExpr(*_TOLD)).select("case_id", "name", "doc_type")


_IDS = ["c_custkey", "case c_custkey % 4 when 0 then 'b-' || (1000000 + c_custkey) || 'a' "
        "when 1 then 'x' || (1000000 + c_custkey) || '.L' when 2 then (10000000 + c_custkey) || '-z' else c_name end as id"]


@query("identifier_kinds", f"""
SELECT c_custkey, CASE WHEN regexp_matches(v, '{fv.CIF_SHAPE}') THEN 'CIF' WHEN regexp_matches(v, '{fv.NIE_SHAPE}') THEN 'NIE'
  WHEN regexp_matches(v, '{fv.DNI_SHAPE}') THEN 'NIF' END AS kind
FROM (SELECT c_custkey, regexp_replace(upper(id), '[\\s.\\-]', '', 'g') AS v FROM (SELECT {', '.join(_IDS)} FROM customer))""")
def identifier_kinds(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(*_IDS)
    return rows.select("c_custkey", rules.id_kind(F.col("id")).alias("kind"))


@query("strong_identity", f"""WITH {_TYPED_SQL}, k AS (SELECT {_LOCAL} AS doc_type FROM t)
SELECT doc_type IN ('{"','".join(fv.STRONG_IDENTITY_TYPES)}') AS strong, count(*) AS n FROM k GROUP BY ALL""")
def strong_identity(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(*_TYPED)
    kind = rules.local_document_type(F.col("mime"), F.col("name"), F.col("text"))
    return rows.groupBy(rules.is_strong_identity(kind).alias("strong")).agg(F.count(F.lit(1)).alias("n"))
