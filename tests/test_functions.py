import datetime

import pytest
from pyspark.sql import functions as F

from casefuse.functions import checks, rules, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize("fn,value,ok", [
    (checks.valid_dni, "12345678Z", True), (checks.valid_dni, "12345678A", False),
    (checks.valid_dni, "12345678-Z", True), (checks.valid_dni, None, False),
    (checks.valid_nie, "X1234567L", True), (checks.valid_nie, "X1234567Z", False),
    (checks.valid_cif, "A82528548", True), (checks.valid_cif, "B12345678", False),
    (checks.valid_cif, "", False),
    (checks.valid_iban, "ES9121000418450200051332", True),
    (checks.valid_iban, "ES91 2100 0418 4502 0005 1332", True),
    (checks.valid_iban, "ES0000000000000000000000", False),
    (checks.valid_iban, "GB82WEST12345698765432", True),
    (checks.valid_phone, "612345678", True), (checks.valid_phone, "512345678", False),
    (checks.valid_email, " a@b.es ", True), (checks.valid_email, "a@b", False),
    (checks.valid_day, "31", True), (checks.valid_day, "32", False), (checks.valid_day, "0", False),
])
def test_checks(spark, fn, value, ok):
    assert one(spark, fn(lit(value))) is ok


def test_every_control_letter_and_digit(spark):
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"
    rows = [(f"{n:08d}{letters[n % 23]}", f"{n:08d}{letters[(n + 1) % 23]}") for n in range(0, 99999999, 1234567)]
    df = spark.createDataFrame(rows, "good string, bad string")
    got = df.select(F.bool_and(checks.valid_dni(F.col("good"))).alias("g"),
                    F.bool_or(checks.valid_dni(F.col("bad"))).alias("b")).first()
    assert got.g and not got.b

    def cif(kind, digits):
        s = sum(int(d) for d in digits[1::2])
        s += sum(sum(map(int, str(2 * int(d)))) for d in digits[0::2])
        n = (10 - s % 10) % 10
        return kind + digits + ("JABCDEFGHI"[n] if kind in "NPQRSW" else str(n))
    rows = [(cif(k, f"{n:07d}"),) for k in "ABCNPQ" for n in range(0, 9999999, 654321)]
    got = spark.createDataFrame(rows, "v string").select(F.bool_and(checks.valid_cif(F.col("v"))).alias("x"))
    assert got.first().x


@pytest.mark.parametrize("field,raw,want", [
    ("Datos bancarios del DISTRIBUIDOR", "es91-2100-0418-4502-0005-1332", "ES9121000418450200051332"),
    ("Mi IBAN", "es91–2100", "ES912100"),
    ("Nombre representante", "Pérez García, Juan", "Juan Pérez García"),
    ("Nombre representante", "Pérez, Juan, X", "Pérez, Juan, X"),
    ("CP", "1234", "01234"), ("CP_2", " 46 0 ", "00460"), ("CP", "123456", "123456"), ("CP", "abc", "abc"),
    ("NIE", "b-123.4", "B1234"), ("NIF representante", " x 1 ", "X1"),
    ("Teléfono", " 600 ", "600"), ("Teléfono", "\t  ", None), ("NIE", " - ", None),
])
def test_normalise(spark, field, raw, want):
    assert one(spark, text.normalise_value(lit(field), lit(raw))) == want


def test_text_forms(spark):
    assert one(spark, text.fold(lit("  ÁÉ\n ñ  Ŵǖ é İ"))) == "ae n wu e i"
    assert one(spark, text.base_field(lit("Dirección_2"))) == "Dirección"
    assert one(spark, text.base_field(lit("CP 12"))) == "CP"
    assert one(spark, text.label_for(lit("Nombre  Razón Social"))) == "Razón social"
    assert one(spark, text.label_for(lit("otro"))) == "otro"
    assert one(spark, text.value_key(lit(" Calle A\t"))) == "calle a"


@pytest.mark.parametrize("cp,province,want", [
    ("46001", "Valencia", None), ("46001", "Madrid", "El C.P. 46001 es de valencia y la provincia es «Madrid»"),
    ("4600", "Valencia", "El C.P. debe tener 5 dígitos"), ("99001", None, "Prefijo de C.P. inexistente (99)"),
    ("03001", "ALACANT", None), ("15001", "A Coruña", None), ("46001", " ", None), ("46001", "v", None),
])
def test_postcode(spark, cp, province, want):
    assert one(spark, checks.postcode_message(lit(cp), lit(province))) == want


@pytest.mark.parametrize("field,value,tipo,province,want", [
    ("NIE", "A82528548", "CIF", None, (True, None)),
    ("NIE", "A82528548", "N.I.F.", None, (False, "NIF/DNI no válido (letra de control)")),
    ("NIE", "A82528548", None, None, (True, None)),
    ("CP_2", "46001", None, "Madrid", (False, "El C.P. 46001 es de valencia y la provincia es «Madrid»")),
    ("Email  Facturación", "x", None, None, (False, "Email no válido")),
    ("Población", "x", None, None, None), ("CP", "  ", None, None, None),
])
def test_check_value(spark, field, value, tipo, province, want):
    got = one(spark, checks.check_value(lit(field), lit(value), lit(tipo), lit(province)))
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize("raw,cause", [
    ("HTTP 429 … invalid json", "QUOTA"), ("HTTP 401", "AUTH"), ("HTTP 413 — x", "TOO_LARGE"),
    ("unable to resolve host", "NETWORK"), ("Unexpected END", "PARSE"), ("HTTP 503", "UNAVAILABLE"),
    ("HTTP 418", "OTHER")])
def test_failure_cause(spark, raw, cause):
    assert one(spark, rules.failure_cause(lit(raw))) == cause


@pytest.mark.parametrize("body,want", [
    ("El Modelo 036 y la tarjeta acreditativa", "Modelo 036"),
    ("CERTIFICADO DE  SITUACIÓN\nCENSAL", "Certificado de situación censal"),
    ("IBAN suelto", "Documento"), (None, "Documento"), ("su PASAPORTE.", "Pasaporte")])
def test_document_type(spark, body, want):
    assert one(spark, rules.document_type(lit(body))) == want


def test_local_type_needs_a_pdf(spark):
    t = lit("modelo 036")
    assert one(spark, rules.local_document_type(lit("image/png"), lit("a.png"), t)) == "Documento"
    assert one(spark, rules.local_document_type(lit(None), lit("a.PDF"), t)) == "Modelo 036"


def test_risky_source(spark):
    assert one(spark, rules.is_risky_source(lit("Teléfono"), lit("Contrato de alquiler")))
    assert not one(spark, rules.is_risky_source(lit("Teléfono"), lit("Factura")))
    assert not one(spark, rules.is_risky_source(lit("CP"), lit("Factura")))


@pytest.mark.parametrize("v,kind", [("B1234567J", "CIF"), ("X1234567L", "NIE"), ("12345678Z", "NIF"), ("zz", None)])
def test_id_kind(spark, v, kind):
    assert one(spark, rules.id_kind(lit(v))) == kind
