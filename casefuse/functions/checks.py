"""Identifier, contact and postcode checks as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import clean_id, field_kind, fold, is_blank, let, strip


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _control_letter_ok(digits: Column, letter: Column) -> Column:
    return F.substr(F.lit(fv.DNI_LETTERS), _number(digits) % 23 + 1, F.lit(1)) == letter


def valid_dni(c: Column) -> Column:
    return let(clean_id(c), lambda v: _true(
        v.rlike(fv.DNI_SHAPE) & _control_letter_ok(v.substr(1, 8), v.substr(9, 1))))


def valid_nie(c: Column) -> Column:
    def check(v):
        digits = F.concat(F.translate(v.substr(1, 1), "XYZ", "012"), v.substr(2, 7))
        return _true(v.rlike(fv.NIE_SHAPE) & _control_letter_ok(digits, v.substr(9, 1)))

    return let(clean_id(c), check)


def _cif_control(v: Column) -> Column:
    """Control number: doubled odd digits (digit sums) plus even digits, to the next ten."""
    odd = F.translate(F.concat(*[v.substr(p, 1) for p in (2, 4, 6, 8)]), "0123456789", "0246813579")
    digits = F.split(F.concat(odd, *[v.substr(p, 1) for p in (3, 5, 7)]), "")
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.coalesce(_number(d), F.lit(0)))
    return (10 - total % 10) % 10


def valid_cif(c: Column) -> Column:
    def check(v):
        kind, last = v.substr(1, 1), v.substr(9, 1)

        def fits(n):
            by_letter = last == F.substr(F.lit(fv.CIF_CONTROL_LETTERS), n + 1, F.lit(1))
            by_digit = last == n.cast("string")
            return (F.when(kind.isin(*fv.CIF_LETTER_TYPES), by_letter)
                    .when(kind.isin(*fv.CIF_DIGIT_TYPES), by_digit).otherwise(by_digit | by_letter))

        return _true(F.when(v.rlike(fv.CIF_SHAPE), let(_cif_control(v), fits)))

    return let(clean_id(c), check)


def valid_any_id(c: Column) -> Column:
    return valid_dni(c) | valid_nie(c) | valid_cif(c)


def iban_remainder(v: Column) -> Column:
    """Remainder modulo 97 with the first four characters moved to the end.

    Letters become two digits, then fifteen digits at a time join the running remainder: at most
    five steps for the longest shape, and never a number beyond a long.
    """
    digits = F.concat(F.substr(v, F.lit(5)), v.substr(1, 4))
    for i, letter in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        digits = F.replace(digits, F.lit(letter), F.lit(str(10 + i)))

    def remainder(d):
        rem = F.lit(0).cast("long")
        for start in range(1, 69, 15):
            rem = F.concat(rem.cast("string"), d.substr(start, 15)).try_cast("long") % 97
        return rem

    return let(digits, remainder)


def valid_iban(c: Column) -> Column:
    def check(v):
        shape = v.rlike(fv.IBAN_SHAPE) & (~v.startswith("ES") | (F.length(v) == 24))
        return _true(F.when(shape, iban_remainder(v) == 1))

    return let(clean_id(c), check)


def valid_phone(c: Column) -> Column:
    return _true(clean_id(c).rlike(fv.PHONE_SHAPE))


def valid_email(c: Column) -> Column:
    return _true(strip(c).rlike(fv.EMAIL_SHAPE))


def valid_day(c: Column) -> Column:
    v = clean_id(c)
    return _true(v.rlike(r"^\d{1,2}$") & _number(v).between(1, 31))


def postcode_message(postcode: Column, province: Column) -> Column:
    """Why a postcode is wrong or does not fit its province; null when it is fine."""
    m = fv.MESSAGES
    table = F.create_map(*[F.lit(x) for pair in fv.PROVINCES.items() for x in pair])

    def check(s):
        v, names, p = s["v"], s["names"], s["p"]
        fits = F.exists(names, lambda n: p.contains(n) | n.contains(p))
        return (
            F.when(~v.rlike(r"^\d{5}$"), m["postcode_shape"])
            .when(names.isNull(), F.format_string(m["postcode_prefix"], v.substr(1, 2)))
            .when(~is_blank(province) & (p != "") & ~fits, F.format_string(
                m["postcode_province"], v, F.try_element_at(names, F.lit(1)), province)))

    def parts(v):
        names = F.split(F.try_element_at(table, v.substr(1, 2)), " ")
        return let(F.struct(v.alias("v"), names.alias("names"), fold(province).alias("p")), check)

    return let(clean_id(postcode), parts)


def check_value(field: Column, value: Column, id_type: Column, province: Column) -> Column:
    """STRUCT<ok, message> for one value; null when no rule applies or the value is blank."""
    m = fv.MESSAGES
    tipo = F.coalesce(F.replace(F.upper(id_type), F.lit("."), F.lit("")), F.lit(""))

    def rule(ok: Column, message: str) -> Column:
        return let(ok, lambda x: F.struct(x.alias("ok"), F.when(~x, F.lit(message)).alias("message")))

    def by_kind(s: Column) -> Column:
        kind, v = s["kind"], s["v"]
        holder = (F.when(tipo == "CIF", rule(valid_cif(v), m["cif"]))
                  .when(tipo == "NIF", rule(valid_dni(v), m["nif"]))
                  .when(tipo == "NIE", rule(valid_nie(v), m["nie"]))
                  .otherwise(rule(valid_any_id(v), m["any_id"])))
        postcode = let(postcode_message(v, province), lambda why: F.struct(
            why.isNull().alias("ok"), why.alias("message")))
        return F.when(v != "", (
            F.when(kind == "holder_id", holder)
            .when(kind == "rep_id", rule(valid_dni(v) | valid_nie(v), m["rep_id"]))
            .when(kind == "iban", rule(valid_iban(v), m["iban"]))
            .when(kind == "postcode", postcode)
            .when(kind == "phone", rule(valid_phone(v), m["phone"]))
            .when(kind == "email", rule(valid_email(v), m["email"]))
            .when(kind == "day", rule(valid_day(v), m["day"]))))

    return let(F.struct(field_kind(field).alias("kind"), strip(value).alias("v")), by_kind)
