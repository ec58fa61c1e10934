"""Ordered first-match rule tables as CASE expressions."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import clean_id, fold, let


def _found(text: Column, pattern: str) -> Column:
    """Is the pattern in the text? Its plain-word alternatives use a substring search."""
    alternatives = re.split(r"\|(?![^(]*\))", pattern)
    plain = [a for a in alternatives if re.fullmatch(r"[\w ]+", a)]
    rest = [a for a in alternatives if a not in plain]
    tests = [text.contains(a) for a in plain] + ([text.rlike("|".join(rest))] if rest else [])
    return reduce(lambda a, b: a | b, tests)


def first_match(text: Column, rules, default: str) -> Column:
    """Name of the first (name, pattern) rule found in the text."""
    if not rules:
        return F.lit(default)
    return let(text, lambda t: reduce(
        lambda acc, r: acc.when(_found(t, r[1]), r[0]), rules, F).otherwise(default))


def rules_of(table: DataFrame, most: int = 500) -> list:
    """(name, pattern) pairs of a table `ord, name, pattern`, in order.

    The rules become a literal CASE chain in every task, so their number is checked before they are
    read; null patterns never match and are left out.
    """
    rows = table.where(F.col("pattern").isNotNull()).orderBy("ord", "name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [(r.name, r.pattern) for r in rows]


def document_type(text: Column, rules=fv.DOC_TYPE_RULES) -> Column:
    """Document type from its text."""
    return first_match(fold(F.coalesce(text, F.lit(""))), rules, fv.DEFAULT_DOC_TYPE)


def local_document_type(mime: Column, name: Column, text: Column) -> Column:
    """Document type of a PDF; anything else has no text to judge by."""
    is_pdf = F.coalesce(F.lower(mime).contains("pdf"), F.lit(False)) | F.coalesce(
        F.lower(name).endswith(".pdf"), F.lit(False))
    return F.when(is_pdf, document_type(text)).otherwise(fv.DEFAULT_DOC_TYPE)


def failure_cause(message: Column) -> Column:
    """Cause of a failure from its raw message."""
    return first_match(F.lower(message), [(r[0], r[3]) for r in fv.FAILURE_RULES],
                       fv.DEFAULT_CAUSE[0])


def failure_label(cause: Column) -> Column:
    """Readable label of a cause."""
    pairs = [x for r in fv.FAILURE_RULES for x in r[:2]] + list(fv.DEFAULT_CAUSE[:2])
    return F.try_element_at(F.create_map(*[F.lit(x) for x in pairs]), cause)


def failure_hint(cause: Column) -> Column:
    """What to do about a cause."""
    pairs = [x for r in fv.FAILURE_RULES for x in (r[0], r[2])]
    pairs += [fv.DEFAULT_CAUSE[0], fv.DEFAULT_CAUSE[2]]
    return F.try_element_at(F.create_map(*[F.lit(x) for x in pairs]), cause)


def id_kind(value: Column) -> Column:
    """Identifier family from its shape alone; null when it has none."""
    return let(clean_id(value), lambda v: (
        F.when(v.rlike(fv.CIF_SHAPE), "CIF").when(v.rlike(fv.NIE_SHAPE), "NIE")
        .when(v.rlike(fv.DNI_SHAPE), "NIF")))


def is_strong_identity(doc_type: Column) -> Column:
    """Does this document type prove identity?"""
    return F.coalesce(doc_type.isin(*fv.STRONG_IDENTITY_TYPES), F.lit(False))


def is_risky_source(field: Column, doc_type: Column, table=fv.RISKY_SOURCES) -> Column:
    """Does a value of this field, from this document type, usually belong to a third party?"""
    chain = reduce(lambda acc, r: acc.when(field == r[0], doc_type.isin(*r[1])), table.items(), F)
    return F.coalesce(chain, F.lit(False))
