"""Identifier checks and the column-quality audit."""

from pyspark.sql import functions as F

from bindings.common import query, table
from casefuse import fixed_values as fv
from casefuse.functions import checks
from casefuse.operators import audit

_L = fv.DNI_LETTERS
_CLEAN = "regexp_replace(upper(v), '[\\s.\\-]', '', 'g')"
_PLANT = {
    "dni": f"(10000000 + o_orderkey) || case when o_orderkey % 5 = 0 then '-' else '' end || "
           f"substr('{_L}', cast((10000000 + o_orderkey + o_orderkey % 3) % 23 + 1 as int), 1)",
    "nie": f"substr('xYZW', cast(o_orderkey % 4 + 1 as int), 1) || (1000000 + o_orderkey) || "
           f"substr('{_L}', cast((1000000 + o_orderkey + 10000000 * (o_orderkey % 4)) % 23 + 1 as int), 1)",
    "cif": "substr('ABKNPZC', cast(o_orderkey % 7 + 1 as int), 1) || ' ' || (1000000 + o_orderkey * 7 % 9000000) || "
           "substr('0123456789ABCDEFGHIJ', cast(o_custkey % 20 + 1 as int), 1)",
    "iban": "case when o_orderkey % 10 = 0 then 'GB' else 'es' end || (10 + o_orderkey % 90) || ' ' || "
            "case when o_orderkey % 10 = 0 then 'WEST' else '2100-' end || (1000000 + o_custkey) || '' || "
            "case when o_orderkey % 11 = 0 then '1' else '000000000' end",
    "phone": "'' || (500000000 + o_orderkey * 33333 % 500000000) || case when o_orderkey % 9 = 0 then '0' else '' end",
    "day": "case when o_orderkey % 8 = 0 then 'x' else '' end || (o_orderkey % 45)",
}
_DIGIT = lambda p: f"CAST(substr({_CLEAN}, {p}, 1) AS INT)"
_DNI = f"coalesce(regexp_matches({_CLEAN}, '{fv.DNI_SHAPE}') AND substr('{_L}', CAST(TRY_CAST(substr({_CLEAN}, 1, 8) AS INT) % 23 + 1 AS INT), 1) = substr({_CLEAN}, 9, 1), false)"
_NIE = (f"coalesce(regexp_matches({_CLEAN}, '{fv.NIE_SHAPE}') AND substr('{_L}', CAST(TRY_CAST(translate(substr({_CLEAN}, 1, 1), 'XYZ', '012')"
        f" || substr({_CLEAN}, 2, 7) AS INT) % 23 + 1 AS INT), 1) = substr({_CLEAN}, 9, 1), false)")
_SUM = " + ".join([f"(2 * {_DIGIT(p)}) // 10 + (2 * {_DIGIT(p)}) % 10" for p in (2, 4, 6, 8)]
                  + [_DIGIT(p) for p in (3, 5, 7)])
_CTRL = f"((10 - ({_SUM}) % 10) % 10)"
_LAST = f"substr({_CLEAN}, 9, 1)"
_CIF = f"""CASE WHEN NOT regexp_matches({_CLEAN}, '{fv.CIF_SHAPE}') THEN false
  WHEN contains('NPQRSW', substr({_CLEAN}, 1, 1)) THEN {_LAST} = substr('JABCDEFGHI', CAST({_CTRL} + 1 AS INT), 1)
  WHEN contains('ABEH', substr({_CLEAN}, 1, 1)) THEN {_LAST} = CAST({_CTRL} AS VARCHAR)
  ELSE {_LAST} = CAST({_CTRL} AS VARCHAR) OR {_LAST} = substr('JABCDEFGHI', CAST({_CTRL} + 1 AS INT), 1) END"""
_IBAN = f"""CASE WHEN NOT regexp_matches({_CLEAN}, '{fv.IBAN_SHAPE}') THEN false
  WHEN starts_with({_CLEAN}, 'ES') AND length({_CLEAN}) <> 24 THEN false
  ELSE list_reduce(list_transform(string_split(array_to_string(list_transform(
         string_split(substr({_CLEAN}, 5) || substr({_CLEAN}, 1, 4), ''),
         lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''),
       lambda d: CAST(d AS INT)), lambda a, d: (a * 10 + d) % 97) = 1 END"""
_RULES = {
    "dni_check": ("dni", _DNI, checks.valid_dni),
    "nie_check": ("nie", _NIE, checks.valid_nie),
    "cif_check": ("cif", _CIF, checks.valid_cif),
    "iban_check": ("iban", _IBAN, checks.valid_iban),
    "phone_check": ("phone", f"regexp_matches({_CLEAN}, '{fv.PHONE_SHAPE}')", checks.valid_phone),
    "day_check": ("day", f"regexp_matches({_CLEAN}, '^[0-9]{{1,2}}$') AND TRY_CAST({_CLEAN} AS INT) BETWEEN 1 AND 31",
                  checks.valid_day),
}


def _register(name, plant, sql, check):
    source = f"(SELECT o_orderkey, {_PLANT[plant]} AS v FROM orders)"

    @query(name, f"SELECT o_orderkey, v AS value, coalesce({sql}, false) AS ok FROM {source}")
    def run(spark, sf):
        rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").selectExpr(
            "o_orderkey", f"{_PLANT[plant]} as value")
        return rows.withColumn("ok", check(F.col("value")))


for _name, _args in _RULES.items():
    _register(_name, *_args)

_ANY = ("case o_orderkey % 4 when 0 then " + _PLANT["dni"] + " when 1 then " + _PLANT["nie"] + " when 2 then "
        + _PLANT["cif"] + " else '' || o_orderkey end")


@query("any_id_check", f"SELECT o_orderkey, ({_DNI}) OR ({_NIE}) OR coalesce({_CIF}, false) AS ok "
                       f"FROM (SELECT o_orderkey, {_ANY} AS v FROM orders)")
def any_id_check(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_ANY} as v")
    return rows.select("o_orderkey", checks.valid_any_id(F.col("v")).alias("ok"))


_MAIL = "[^ ,;<>()]*@[^ ,;<>()]*"


@query("email_check", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM documents)
SELECT doc_id, value, regexp_matches(trim(value, ' ' || chr(9) || chr(10) || chr(13)), '{fv.EMAIL_SHAPE}') AS ok, count(*) AS n
FROM m GROUP BY ALL""")
def email_check(spark, sf):
    found = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), 0)).alias("value"))
    return found.withColumn("ok", checks.valid_email(F.col("value"))).groupBy(
        "doc_id", "value", "ok").agg(F.count(F.lit(1)).alias("n"))


_PROV_NAMES = "Valencia,A Coruña,MADRID, ,Illes Balears,Ávila,x"
_CODES = ["o_orderkey", "case when o_orderkey % 13 = 0 then 'x' else '' end || lpad('' || (o_orderkey * 7919 % 60000), "
          "case when o_orderkey % 17 = 0 then 4 else 5 end, '0') as cp",
          f"split_part('{_PROV_NAMES}', ',', cast(o_orderkey % 8 + 1 as int)) as province"]
_PREFIXES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fv.PROVINCES.items()) + ") AS pr(prefix, names)"


def _postcode_sql(cp, province):
    """Message of a postcode, given `pr.names` joined on its prefix."""
    v = f"regexp_replace(upper({cp}), '[\\s.\\-]', '', 'g')"
    p = f"trim(lower(strip_accents({province})))"
    return f"""CASE WHEN NOT regexp_matches({v}, '^[0-9]{{5}}$') THEN 'El C.P. debe tener 5 dígitos'
  WHEN pr.names IS NULL THEN 'Prefijo de C.P. inexistente (' || substr({v}, 1, 2) || ')'
  WHEN trim(coalesce({province}, '')) <> '' AND len(list_filter(string_split(pr.names, ' '),
       lambda n: contains({p}, n) OR contains(n, {p}))) = 0
  THEN 'El C.P. ' || {v} || ' es de ' || string_split(pr.names, ' ')[1] || ' y la provincia es «' || {province} || '»' END"""


@query("postcode_check", f"""
WITH c AS (SELECT {', '.join(_CODES)} FROM orders)
SELECT o_orderkey, cp, province, {_postcode_sql('cp', 'province')} AS message
FROM c LEFT JOIN {_PREFIXES} ON substr(regexp_replace(upper(cp), '[\\s.\\-]', '', 'g'), 1, 2) = pr.prefix""")
def postcode_check(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*_CODES)
    return rows.withColumn("message", checks.postcode_message(F.col("cp"), F.col("province")))


# One case per customer; six fields whose values are planted from the key.
_FIELDS = {
    "NIE": "case c_custkey % 4 when 0 then " + _PLANT["dni"] + " when 1 then " + _PLANT["nie"] + " when 2 then "
           + _PLANT["cif"] + " else ' ' end",
    "CP": "lpad('' || (c_custkey * 7919 % 60000), 5, '0')",
    "Provincia": f"split_part('{_PROV_NAMES}', ',', cast(c_custkey % 8 + 1 as int))",
    "CP_2": "'46001'",
    "Provincia_2": "case when c_custkey % 2 = 0 then 'Valencia' else 'Madrid' end",
    "Teléfono": _PLANT["phone"],
    "Datos bancarios del DISTRIBUIDOR": _PLANT["iban"],
    "Fecha": _PLANT["day"],
    "Población": "'Ciudad'",
    "CP 2": "case when c_custkey % 2 = 0 then '46001' else '28001' end",
}
_FIELDS = {k: v.replace("o_orderkey", "c_custkey").replace("o_custkey", "c_nationkey") for k, v in _FIELDS.items()}
_TYPE = "split_part('CIF,n.i.f.,NIE,,xx', ',', cast(c_custkey % 5 + 1 as int))"
_AUDIT = f"""
src AS (SELECT c_custkey AS case_id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_FIELDS.values()))},
        {_TYPE} AS tipo FROM customer),
vals AS ({' UNION ALL '.join(f"SELECT case_id, '{k}' AS field, f{i} AS v, tipo, CASE WHEN '{k}' = 'CP' THEN f2 WHEN '{k}' = 'CP_2' THEN f4 WHEN '{k}' = 'CP 2' THEN f2 END AS province FROM src" for i, k in enumerate(_FIELDS))}),
checked AS (SELECT case_id, field, v AS value, CASE WHEN trim(v) = '' THEN NULL
  WHEN field = 'NIE' THEN CASE replace(upper(tipo), '.', '')
     WHEN 'CIF' THEN CASE WHEN {_CIF} THEN 'ok' ELSE '{fv.MESSAGES["cif"]}' END
     WHEN 'NIF' THEN CASE WHEN {_DNI} THEN 'ok' ELSE '{fv.MESSAGES["nif"]}' END
     WHEN 'NIE' THEN CASE WHEN {_NIE} THEN 'ok' ELSE '{fv.MESSAGES["nie"]}' END
     ELSE CASE WHEN ({_DNI}) OR ({_NIE}) OR ({_CIF}) THEN 'ok' ELSE '{fv.MESSAGES["any_id"]}' END END
  WHEN field IN ('CP', 'CP_2', 'CP 2') THEN coalesce({_postcode_sql('v', 'province')}, 'ok')
  WHEN field = 'Teléfono' THEN CASE WHEN {_RULES['phone_check'][1]} THEN 'ok' ELSE '{fv.MESSAGES["phone"]}' END
  WHEN field = 'Datos bancarios del DISTRIBUIDOR' THEN CASE WHEN {_IBAN} THEN 'ok' ELSE '{fv.MESSAGES["iban"]}' END
  WHEN field = 'Fecha' THEN CASE WHEN {_RULES['day_check'][1]} THEN 'ok' ELSE '{fv.MESSAGES["day"]}' END END AS res
  FROM vals LEFT JOIN {_PREFIXES} ON substr({_CLEAN}, 1, 2) = pr.prefix),
audited AS (SELECT case_id, field, value, res = 'ok' AS ok, nullif(res, 'ok') AS message,
            trim(value) <> '' AND coalesce(res = 'ok', true) AS done FROM checked)"""


def _audited(spark, sf):
    src = table(spark, sf, "customer")
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.expr(e).alias("value")) for k, e in _FIELDS.items()])
    values = src.select(F.col("c_custkey").alias("case_id"), F.explode(rows).alias("r")).select("case_id", "r.*")
    types = src.selectExpr("c_custkey as case_id", f"{_TYPE} as tipo")
    return audit.audit_fields(values, types)


@query("field_audit", f"WITH {_AUDIT} SELECT case_id, field, value, ok, message FROM audited")
def field_audit(spark, sf):
    return _audited(spark, sf)


@query("audit_pass_rates", f"""WITH {_AUDIT}
SELECT field, count(ok) AS n_checked, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed
FROM audited GROUP BY ALL""")
def audit_pass_rates(spark, sf):
    return audit.pass_rates(_audited(spark, sf))


_SECTION_ROWS = "(VALUES " + ", ".join(f"('{k}', '{s}')" for k, _, s, _ in fv.FIELD_CATALOG if s) + ") AS cat(field, section)"


@query("audit_sections", f"""WITH {_AUDIT},
cat AS (SELECT * FROM {_SECTION_ROWS}),
sizes AS (SELECT section, count(*) AS n_fields FROM cat GROUP BY ALL),
done_in AS (SELECT case_id, section, count(*) AS n_done FROM audited JOIN cat USING (field) WHERE done GROUP BY ALL)
SELECT c.c_custkey AS case_id, z.section, coalesce(n_done, 0) AS n_done, n_fields, coalesce(n_done, 0) = n_fields AS complete
FROM customer c CROSS JOIN sizes z LEFT JOIN done_in d ON d.case_id = c.c_custkey AND d.section = z.section""")
def audit_sections(spark, sf):
    return audit.section_progress(_audited(spark, sf))


@query("audit_progress", f"""WITH {_AUDIT}
SELECT case_id, count(*) FILTER (WHERE done AND field <> 'CP 2') AS n_done, CAST(21 AS BIGINT) AS n_total FROM audited GROUP BY ALL""")
def audit_progress(spark, sf):
    return audit.case_progress(_audited(spark, sf))
