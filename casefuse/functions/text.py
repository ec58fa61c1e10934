"""Text normal forms as column expressions."""

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefuse import fixed_values as fv

WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _accent_table():
    """Letters made of one base character and marks, their bases, and the marks themselves.

    `translate` drops every character that has no counterpart, so the marks come last.
    """
    accented, plain, marks = [], [], []
    for code in [*range(0xC0, 0x20000), *range(0xE0100, 0xE01F0)]:
        if 0xAC00 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        base = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != ch:
            accented.append(ch)
            plain.append(base[0])
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip(c: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def nonblank(c: Column) -> Column:
    """The value, or null when it is blank."""
    return F.when(~is_blank(c), c)


def fold(c: Column) -> Column:
    """Lower case, no accents, single spaces, no white space of any kind at the ends."""
    # A text of one byte a character has no accents to look up.
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, _ACCENTED, _PLAIN))
    return strip(F.regexp_replace(F.lower(plain), r"\s+", " "))


def clean_id(c: Column) -> Column:
    """Upper case without spaces, dots and hyphens."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s.\-]", "")


def base_field(c: Column) -> Column:
    """Field name without its block number: `CP_2` and `CP 2` become `CP`."""
    return F.regexp_replace(c, r"^(.*?)[_\s]\d+$", "$1")


def value_key(c: Column) -> Column:
    """Case-insensitive identity of a value."""
    return F.lower(strip(c))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def _catalog(column: int) -> Column:
    return F.create_map(*[F.lit(x) for row in fv.FIELD_CATALOG for x in (row[0], row[column])])


def _named(kind: str) -> list:
    return [row[0] for row in fv.FIELD_CATALOG if row[3] == kind]


def _kind_by_name(field: Column) -> Column:
    key = F.replace(fold(base_field(field)), F.lit(" "), F.lit(""))
    return let(key, lambda k: (
        F.when(k.contains("datosbancarios") | k.contains("iban"), "iban")
        .when(k == "nie", "holder_id")
        .when(k == "nifrepresentante", "rep_id")
        .when(k == "cp", "postcode")
        .when(k == "nombrerepresentante", "person")
        .when(k == "telefono", "phone")
        .when(k.startswith("email"), "email")
        .when(k == "fecha", "day")
        .otherwise("text")))


def field_kind(field: Column) -> Column:
    """Rule family of a field: from the catalogue, else from its folded base name without spaces."""
    kinds = list(dict.fromkeys(row[3] for row in fv.FIELD_CATALOG))
    known = reduce(lambda acc, kind: acc.when(field.isin(*_named(kind)), kind), kinds, F)
    return known.otherwise(_kind_by_name(field))


#: Families whose values are rewritten beyond their ends.
_REWRITTEN = {"iban", "holder_id", "rep_id", "postcode", "person"}


def normalise_value(field: Column, raw: Column) -> Column:
    """Canonical form of a value for its field; null when blank."""
    def person(v):
        def swapped(parts):
            surname, given = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            return F.when((F.size(parts) == 2) & (surname != "") & (given != ""),
                          F.concat_ws(" ", given, surname)).otherwise(v)
        return let(F.transform(F.split(v, ","), strip), swapped)

    def postcode(v):
        return let(F.regexp_replace(v, r"\D", ""), lambda digits: F.when(
            F.length(digits).between(1, 4), F.lpad(digits, 5, "0")).otherwise(v))

    def by_kind(kind, v):
        return (F.when(kind == "iban", F.regexp_replace(F.upper(v), r"[\s.\-–—]", ""))
                .when(kind.isin("holder_id", "rep_id"), clean_id(v))
                .when(kind == "postcode", postcode(v))
                .when(kind == "person", person(v))
                .otherwise(v))

    # Most values only lose white space; their fields are told by one look into a set.
    plain = [key for key, _, _, kind in fv.FIELD_CATALOG if kind not in _REWRITTEN]
    formed = let(strip(raw), lambda v: F.when(field.isin(*plain), v).otherwise(
        let(field_kind(field), lambda kind: by_kind(kind, v))))
    return let(formed, lambda v: F.when(v != "", v))


def label_for(field: Column) -> Column:
    """Readable label of a field, the key itself when it is not in the catalogue."""
    return F.coalesce(F.try_element_at(_catalog(1), field), field)


def section_of(field: Column) -> Column:
    """Form section of a field, null outside the catalogue."""
    return F.try_element_at(_catalog(2), field)
