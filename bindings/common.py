"""Shared inputs. A planted input is one list of SQL expressions that both engines evaluate."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefuse.operators.ordered import by_key, together
from casefuse.session import tune
from casefuse.sources.tables import read_table

QUERIES, SQL = {}, {}
ENGINES = "claude,gemini,groq,grok,mistral,scaleway,ovh,nebius,eurouter"


def query(name, sql=None):
    """Register a query: integers as BIGINT, lists as text joined by `|`."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(tune(spark), sf_dir)
            out = []
            for f in df.schema.fields:
                c = F.col(f"`{f.name}`")
                if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                    c = c.cast("long")
                elif isinstance(f.dataType, T.ArrayType):
                    c = F.array_join(c, "|")
                elif isinstance(f.dataType, T.DoubleType):
                    c = F.round(c, 6)
                out.append(c.alias(f.name))
            return df.select(*out)
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return fn
    return register


def _pick(words, index):
    return f"split_part('{words}', ',', cast({index} + 1 as int))"


_JSON = (
    """'{"sugerencias":{"NIE":"b-' || (1000000 + o_custkey) || '.' || (o_orderkey % 3)"""
    """ || '","Teléfono":" ' || (600000000 + o_custkey)"""
    """ || ' ","CP":"' || (1000 + o_custkey % 900 + case when o_orderkey % 7 = 0 then 1 else 0 end)"""
    """ || '","Nombre representante":"Pérez ' || (o_custkey % 50) || ', Ana'"""
    """ || '","Nombre Comercial":"' || case when o_orderkey % 4 = 0 then 'TIENDA ' else 'Tienda ' end || o_custkey"""
    """ || '","Datos bancarios del DISTRIBUIDOR":"es' || (10 + o_custkey % 80) || '-2100 0418.' || (1000 + o_custkey)"""
    """ || '","Fecha":"' || (1 + o_orderkey % 31)"""
    """ || '","Email Comercial":"' || case when o_orderkey % 6 = 0 then ' ' else 'm' || o_custkey || '@mail.example' end"""
    """ || '"}' || case when o_orderkey % 11 = 5 then '' else ',"tipo_identificacion":"' || """
    + _pick("CIF,NIF,NIE", "(o_orderkey + o_custkey) % 3") + """ || '"' end"""
    """ || ',"tipo_documento":"' || """
    + _pick("Modelo 036,Contrato de alquiler,Factura,Documento, ", "o_orderkey % 5") + """ || '"'"""
    """ || ',"alternativas":{"Población":[{"valor":"Ciudad ' || (o_custkey % 40) || '","fuente":"f","nota":"n"},{'"""
    """ || case when o_orderkey % 23 = 0 then '"fuente":"sin valor"' else '"valor":"Ciudad ' || (o_custkey % 40 + case when o_orderkey % 5 = 0 then 1 else 0 end) || '"' end"""
    """ || '}]},"paquetes":[{' || case when o_orderkey % 11 = 0 then '' else '"tipo":"direccion",' end"""
    """ || '"etiqueta":"fiscal","fuente":"doc' || (o_orderkey % 4) || '","datos":{"Dirección":"Calle ' || (o_custkey % 30)"""
    """ || '","CP":"' || (1000 + o_custkey % 900) || '","Población":"","Provincia":"Madrid"}},'"""
    """ || '{"tipo":"empresa","fuente":"doc' || (o_orderkey % 4) || '","datos":{"NIE":" b' """
    """ || case when o_orderkey % 4 = 3 then 9000000 + o_custkey else 1000000 + o_custkey end"""
    """ || ' ","Nombre  Razón Social":"Razón ' || o_custkey || '","Actividad principal del negocio":"'"""
    """ || case when o_orderkey % 4 = 3 then 'Ajena' else '' end || '"}},'"""
    """ || '{"tipo":"direccion_comercio","etiqueta":"tienda","fuente":"doc' || (o_orderkey % 4) || '","datos":{"Dirección":"'"""
    """ || case when o_orderkey % 5 = 0 then '' else 'Local ' || (o_custkey % 20) end"""
    """ || '","CP":"46001","Provincia":"Valencia"}}]}'"""
)

PLANTED = {
    # Values users propose through their events, five engines.
    "votes": ("events", [
        "user_id as case_id", "event_type as field",
        "cast(cast(regexp_extract(props, '[0-9]+', 0) as bigint) % 10 as string) as value",
        "'e' || (event_id % 5) as engine", "event_id as seq", "cast(0 as bigint) as pos",
        "event_id % 3 as doc_id"]),
    # Calls with failures.
    "event_calls": ("events", [
        "user_id as case_id", "'e' || (event_id % 5) as engine", "event_id as seq",
        "case when event_type = 'error' then cast(" + _pick("401,403,404,429,500,503,413", "event_id % 7")
        + " as int) else 200 end as http_code",
        "case when event_type = 'error' then 'HTTP ' || " + _pick("401,403,404,429,500,503,413", "event_id % 7")
        + " || ' — ' || " + _pick("Rate limit,invalid json,timed out,unknown,payload", "event_id % 5")
        + " end as status",
        "event_id % 4 as batch"]),
    # Recorded engine replies, planted from the orders.
    "raw_calls": ("orders", [
        "o_custkey as case_id", "o_orderkey % 4 as doc_id",
        _pick(ENGINES, "o_orderkey % 9") + " as engine", "o_orderkey as seq",
        "case when o_orderkey % 37 = 0 then cast("
        + _pick("401,403,404,429,500,503,413", "o_orderkey % 7") + " as int) else 200 end as http_code",
        "case when o_orderkey % 41 = 0 then 'Rate limit reached' end as error",
        _JSON + " as json", "o_orderkey as k"]),
    # Edits: some undo, some choose with a linked field.
    "edits": ("events", [
        "user_id as case_id", "event_id as seq",
        "case event_type when 'click' then 'set' when 'view' then 'choose' when 'signup' then 'dismiss' "
        "when 'purchase' then 'set' else 'undo' end as action",
        "'f' || (event_id % 4) as field",
        "case when event_id % 9 = 0 then ' ' else 'v' || cast(regexp_extract(props, '[0-9]+', 0) as bigint) end as value",
        "case when event_type = 'view' and event_id % 2 = 0 then 'f' || ((event_id + 1) % 4) end as linked_field",
        "'d' || (event_id % 6) as origin"]),
}
_CALL = [
    "case_id", "doc_id", "engine", "seq", "http_code",
    "http_code = 200 and error is null as ok",
    "case when http_code = 200 then error end as error",
    "case when http_code <> 200 and k % 3 = 0 then '{\"ok\":false,\"error\":{\"code\":429,\"message\":\"quota ' || k || '\"}}' "
    "when http_code <> 200 and k % 5 = 1 then '{\"ok\":false,\"error\":\"[' || k || ']\"}' "
    "when http_code <> 200 and k % 2 = 0 then '{\"ok\":false,\"error\":\"Rate limit ' || k || '\"}' "
    "when http_code <> 200 then 'Bad gateway ' || k when k % 29 = 0 then cast(null as string) "
    "when k % 17 = 0 then substr(json, 1, length(json) - 20) "
    "when k % 31 = 7 then json || ' {\"sugerencias\":{\"CP\":\"1\"}}' "
    "when k % 43 = 5 then json || ' nota {x}' "
    "when k % 47 = 3 then replace(json, '\"CP\":\"', '\"X\":{\"a\":1},\"CP\":\"') "
    "when k % 53 = 4 then replace(json, '\"valor\":\"', '\"valor\":[1],\"x\":\"') "
    "when k % 59 = 6 then replace(json, '\"etiqueta\":\"fiscal\"', '\"etiqueta\":\"{fiscal]\"') "
    "when k % 61 = 8 then replace(json, '\"CP\":\"', '\"CP\":\"9999\",\"CP\":\"') "
    "when k % 67 = 9 then replace(json, '\"Fecha\":\"', '\"Extra\":\"[1]\",\"Otro\":\"{}\",\"Fecha\":\"') "
    "when k % 71 = 10 then replace(json, '\"tipo_documento\":\"', '\"tipo_documento\":{\"a\":1},\"y\":\"') "
    "when k % 73 = 12 then replace(json, '\"etiqueta\":\"fiscal\"', '\"etiqueta\":[\"fiscal\"]') "
    "when k % 13 = 0 then 'Claro:' || chr(10) || '```json' || chr(10) || json || chr(10) || '``` fin' "
    "else json end as text"]


def table(spark, sf, name):
    return read_table(spark, sf, name)


def planted(spark, sf, name):
    """A planted input as a DataFrame."""
    source, columns = PLANTED[name]
    return table(spark, sf, source).selectExpr(*columns)


def dealt_calls(spark, sf):
    """Recorded calls with their reply text and `part`, and the partitions they are dealt into.

    A reply is a hundred times its two keys, so the keys are always dealt out before it is made;
    the calls of a case lie together, as they were recorded.
    """
    keys, buckets = together(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                             ["o_custkey"], F.col("o_orderkey"))
    return _with_text(keys), buckets


def _with_text(keys):
    return keys.selectExpr(*PLANTED["raw_calls"][1], "part").selectExpr(*_CALL, "part")


def calls_by_case(spark, sf):
    """As `dealt_calls`, with the columns the calls are dealt by: the case alone if none is hot.

    A call has some thirty candidates, so a partition holds fewer calls.
    """
    keys, buckets, dealt_by = by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                                     ["o_custkey"], F.col("o_orderkey"), each=1 << 15)
    return _with_text(keys), buckets, ["case_id", *dealt_by[1:]]


def calls(spark, sf):
    """Recorded calls with their reply text."""
    return dealt_calls(spark, sf)[0].drop("part")


def cte(*names):
    """The same inputs as SQL common table expressions (without WITH)."""
    parts = []
    for name in names:
        if name == "calls":
            source, columns = PLANTED["raw_calls"]
            parts.append(f"raw_calls AS (SELECT {', '.join(columns)} FROM {source})")
            parts.append(f"calls AS (SELECT {', '.join(_CALL)} FROM raw_calls)")
        else:
            source, columns = PLANTED[name]
            parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {source})")
    return ", ".join(parts)
