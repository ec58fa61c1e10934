"""Parse engine replies, log rejects and explode them to votes and packages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import is_blank, normalise_value, strip

_SHAPE = """
    sugerencias MAP<STRING, {0}>, tipo_identificacion {0}, tipo_documento {0},
    alternativas MAP<STRING, ARRAY<STRUCT<valor: {0}, fuente: {0}, nota: {0}>>>,
    paquetes ARRAY<STRUCT<tipo: {0}, etiqueta: {0}, fuente: {0}, datos: MAP<STRING, {0}>>>,
    _corrupt STRING
"""
#: A reply with its plain members as text, and the same with members that know their JSON type.
REPLY_SCHEMA, TYPED_SCHEMA = _SHAPE.format("STRING"), _SHAPE.format("VARIANT")
_DECODE = {"columnNameOfCorruptRecord": "_corrupt"}


def json_slice(text: Column) -> Column:
    """Text from the first `{` to the last `}`, null when there is none."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(found)


def is_nested(value: Column) -> Column:
    """Whether a JSON member (VARIANT) is an object or a list and not a plain value."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def _any_plain(r: Column, test) -> Column:
    """Whether `test` holds for one of the members of a reply that must be plain values."""
    def some(xs: Column, of) -> Column:
        return F.coalesce(F.exists(xs, of), F.lit(False))

    def parts(x: Column, names: list) -> Column:
        return F.greatest(*[F.coalesce(test(x[n]), F.lit(False)) for n in names])

    return (some(F.map_values(r["sugerencias"]), test)
            | parts(r, ["tipo_identificacion", "tipo_documento"])
            | some(F.map_values(r["alternativas"]), lambda alts: some(
                alts, lambda a: parts(a, ["valor", "fuente", "nota"])))
            | some(r["paquetes"], lambda p: parts(p, ["tipo", "etiqueta", "fuente"])
                   | some(F.map_values(p["datos"]), test)))


def _number_of(text: Column, *marks) -> Column:
    """How often the marks (single characters) stand in a text."""
    without = text
    for mark in marks:
        without = F.replace(without, F.lit(mark), F.lit(""))
    return F.octet_length(text) - F.octet_length(without)


def _opened_by(r: Column) -> Column:
    """Objects and lists that a decoded reply consists of; its text opens no fewer."""
    def one(x: Column) -> Column:
        return F.when(x.isNotNull(), 1).otherwise(0)

    lists = F.aggregate(F.map_values(r["alternativas"]), F.lit(0), lambda n, alts: n + F.coalesce(
        F.size(alts) + 1, F.lit(0)))
    packages = F.aggregate(r["paquetes"], F.lit(1), lambda n, p: n + one(p) + one(p["datos"]))
    return (F.lit(1) + one(r["sugerencias"]) + one(r["alternativas"])
            + F.coalesce(lists, F.lit(0)) + F.coalesce(packages, F.lit(0)))


def _repeats(m: Column) -> Column:
    keys = F.map_keys(m)
    return F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))


def _last_entries(m: Column) -> Column:
    """A decoded map as JSON objects are read: of a repeated key the last entry counts."""
    keys = F.map_keys(m)
    later = lambda i, key: F.array_contains(F.slice(keys, i + 2, F.size(keys)), key)
    return F.when(_repeats(m), F.map_from_entries(F.filter(
        F.map_entries(m), lambda e, i: ~later(i, e["key"])))).otherwise(m)


def _without_repeats(r: Column) -> Column:
    some = _repeats(r["sugerencias"]) | _repeats(r["alternativas"]) | F.coalesce(F.exists(
        r["paquetes"], lambda p: _repeats(p["datos"])), F.lit(False))
    return F.when(some, r.withField("sugerencias", _last_entries(r["sugerencias"])).withField(
        "alternativas", _last_entries(r["alternativas"])).withField("paquetes", F.transform(
            r["paquetes"], lambda p: p.withField("datos", _last_entries(p["datos"]))))).otherwise(r)


def decode_reply(text: Column) -> Column:
    """The reply as a struct, null when any part of it fails to decode.

    The slice must be one JSON object with nothing behind it. The decoder yields a struct even for
    broken text, and text for objects and lists where a plain value is due. So its corrupt mark and
    the two required members (`tipo` of a package, `valor` of an alternative) are tested, and a
    reply in which some plain member's text begins like an object or a list (few do) is decoded once
    more with types, which tell `"[1]"` from `[1]`. A slice that opens and closes no more braces and
    brackets than its decoded parts need has nothing behind the object (it ends with a brace) and no
    nested plain member, so both tests are left out there. Of a repeated key the last value counts.
    """
    slice_ = json_slice(text)
    # What stands behind the object may close a list around it or an object around it, not both.
    alone = (F.json_array_length(F.concat(F.lit("["), slice_, F.lit("]"))) == 1) & F.json_object_keys(
        F.concat(F.lit('{"a":'), slice_, F.lit("}"))).isNotNull()
    raw = F.from_json(slice_, REPLY_SCHEMA, _DECODE)

    def whole(r: Column) -> Column:
        no_type = F.exists(r["paquetes"], lambda p: p["tipo"].isNull())
        no_value = F.exists(F.map_values(r["alternativas"]), lambda alts: F.exists(
            alts, lambda a: a["valor"].isNull()))
        nested = F.when(_any_plain(r, lambda v: v.startswith("{") | v.startswith("[")), F.transform(
            F.array(F.from_json(slice_, TYPED_SCHEMA, _DECODE)),
            lambda t: _any_plain(t, is_nested))[0]).otherwise(False)
        needed = _opened_by(r)
        plain = (_number_of(slice_, "{", "[") == needed) & (_number_of(slice_, "}", "]") == needed)
        bad = F.coalesce(no_type, F.lit(False)) | F.coalesce(no_value, F.lit(False))
        return F.when(r["_corrupt"].isNull() & ~bad & (
            plain | (F.coalesce(alone, F.lit(False)) & ~nested)), _without_repeats(r))

    return F.transform(F.array(raw), whole)[0]


def parse_replies(calls: DataFrame, suggestion_only=fv.SUGGESTION_ONLY_ENGINES) -> DataFrame:
    """Add `reply`; suggestion-only engines lose their alternatives and packages."""
    reply = decode_reply(F.when(F.col("ok"), F.col("text")))
    trimmed = F.transform(F.array(reply), lambda r: F.when(
        F.col("engine").isin(*suggestion_only),
        r.withField("alternativas", F.lit(None)).withField("paquetes", F.lit(None))).otherwise(r))
    return calls.withColumn("reply", trimmed[0])


def reject_snippet(text: Column, width: int = 180) -> Column:
    """First characters of an undecodable reply on one line."""
    line = F.regexp_replace(F.substring(strip(text), 1, width), "\n", " ")
    return F.coalesce(line, F.lit(fv.EMPTY_REPLY))


def reject_log(parsed: DataFrame) -> DataFrame:
    """Answered calls whose reply could not be decoded."""
    return parsed.where(F.col("ok") & F.col("reply").isNull()).select(
        "case_id", "doc_id", "engine", "seq", reject_snippet(F.col("text")).alias("snippet"))


def error_message(body: Column) -> Column:
    """The `error` member of a JSON body if it is a plain value, else 200 characters of the body."""
    message = F.get_json_object(body, "$.error")
    typed = F.from_json(body, "error VARIANT")["error"]
    nested = (message.startswith("{") | message.startswith("[")) & is_nested(typed)
    plain = F.when(~nested, message)
    return F.when(~is_blank(body), F.coalesce(plain, F.substring(body, 1, 200)))


def call_status(calls: DataFrame) -> DataFrame:
    """Status line of each failed call; null where the reply was usable."""
    http = F.concat_ws(" — ", F.concat(F.lit("HTTP "), F.col("http_code").cast("string")),
                       error_message(F.col("text")))
    status = (
        F.when(F.col("http_code").isNotNull() & ~F.col("http_code").between(200, 299), http)
        .when(~F.col("ok"), F.coalesce(F.col("error"), F.lit("error")))
        .when(F.col("reply").isNull(),
              F.format_string(fv.UNPARSEABLE_STATUS, reject_snippet(F.col("text")))))
    return calls.withColumn("status", status)


def _pairs(m: Column, source: str) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(
        F.lit(source).alias("source"), e["key"].alias("field"), e["value"].alias("value")))


def _package_key(tipo: Column, key: Column) -> Column:
    """Field a package value votes for: shop addresses go to the second block."""
    second = (tipo == "direccion_comercio") & key.isin(*fv.ADDRESS_FIELDS)
    return F.when(second, F.concat(key, F.lit(fv.SECOND_BLOCK_SUFFIX))).otherwise(key)


def _items(r: Column) -> Column:
    """ARRAY<STRUCT<source, field, value>> of all a reply proposes."""
    none = F.array().cast("array<struct<source:string,field:string,value:string>>")
    alternatives = F.flatten(F.transform(F.map_entries(r["alternativas"]), lambda e: F.transform(
        e["value"], lambda a: F.struct(F.lit("alternative").alias("source"),
                                       e["key"].alias("field"), a["valor"].alias("value")))))
    packages = F.flatten(F.transform(r["paquetes"], lambda p: F.transform(
        F.map_entries(p["datos"]), lambda e: F.struct(
            F.lit("package").alias("source"),
            _package_key(p["tipo"], e["key"]).alias("field"), e["value"].alias("value")))))
    return F.concat(*[F.coalesce(x, none) for x in (
        _pairs(r["sugerencias"], "suggestion"), alternatives, packages)])


def proposals(parsed: DataFrame) -> DataFrame:
    """Every value each reply proposes, in one pass: suggestions, alternatives, packages.

    `pos` is the order inside the reply. Values are not yet normalised.
    """
    return parsed.select("case_id", "doc_id", "engine", "seq",
                         F.posexplode(_items(F.col("reply")))).select(
        "case_id", "doc_id", "engine", "seq", "pos", "col.*")


def votes(parsed: DataFrame, fields=None) -> DataFrame:
    """Proposals in normal form, blanks dropped; only of some fields if given.

    Blanks go before the explode: a filter after it would be pushed down and would normalise
    every value a second time. Replies that were digested hold their votes already.
    """
    kept = reply_votes(parsed, fields)
    return parsed.select("case_id", "doc_id", "engine", "seq", F.explode(kept).alias("v")).select(
        "case_id", "doc_id", "engine", "seq", "v.*")


def reply_votes(parsed: DataFrame, fields=None) -> Column:
    """ARRAY<STRUCT<pos, field, value>> of each reply: what it was digested to, or made anew."""
    if "votes" not in parsed.columns:
        return _votes(F.col("reply"), fields)
    kept = F.col("votes")
    return kept if fields is None else F.filter(kept, lambda v: v["field"].isin(*fields))


def digest(parsed: DataFrame, fields=None) -> DataFrame:
    """Add `votes`, all of a reply in normal form; `reply` loses its suggestions and alternatives.

    This is what branches read that are computed from written replies. With `fields`, it is votes
    of these fields only, and `reply` loses its packages too: enough to end cases and judge calls.
    """
    gone = ["sugerencias", "alternativas"] + ([] if fields is None else ["paquetes"])
    return parsed.withColumns({"votes": _votes(F.col("reply"), fields),
                               "reply": F.col("reply").dropFields(*gone)})


def _votes(reply: Column, fields=None) -> Column:
    """ARRAY<STRUCT<pos, field, value>> of a reply, in normal form and without blanks."""
    def normal(x, pos):
        return F.struct(pos.alias("pos"), x["field"].alias("field"),
                        normalise_value(x["field"], x["value"]).alias("value"))

    items = _items(reply)
    if fields is None:
        values = F.transform(items, normal)
    else:
        placed = F.transform(items, lambda x, i: F.struct(
            i.alias("pos"), x["field"].alias("field"), x["value"].alias("value")))
        wanted = F.filter(placed, lambda x: x["field"].isin(*fields))
        values = F.transform(wanted, lambda x: normal(x, x["pos"]))
    return F.filter(values, lambda x: x["value"].isNotNull())


def packages(parsed: DataFrame) -> DataFrame:
    """One row per package."""
    return parsed.select("case_id", "doc_id", "engine", "seq",
                         F.posexplode("reply.paquetes").alias("pkg_seq", "p")).select(
        "case_id", "doc_id", "engine", "seq", "pkg_seq", "p.tipo",
        F.coalesce("p.etiqueta", F.lit("")).alias("etiqueta"),
        F.coalesce("p.fuente", F.lit("")).alias("fuente"), "p.datos")


def package_values(pkgs: DataFrame) -> DataFrame:
    """One row per value of a package."""
    return pkgs.select("case_id", "doc_id", "engine", "seq", "pkg_seq", "tipo",
                       F.explode("datos").alias("field", "value"))
