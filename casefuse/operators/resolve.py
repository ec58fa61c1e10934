"""Candidates with provenance, conflicts, intruder documents and what may be filled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.rules import is_risky_source
from casefuse.functions.text import is_blank, nonblank, value_key
from casefuse.operators import ordered, replies

EMPTY, AI, CONFLICT, WARN, USER = "EMPTY", "AI", "CONFLICT", "WARN", "USER"
_LINKED = "map<string,string>"
_DECIDED = ["value", "doc_id", "document", "note", "risky", "engines", "linked"]


def _second(field: Column, to_second: Column) -> Column:
    return F.when(to_second & field.isin(*fv.ADDRESS_FIELDS),
                  F.concat(field, F.lit(fv.SECOND_BLOCK_SUFFIX))).otherwise(field)


def linked_values(tipo: Column, datos: Column) -> Column:
    """Postcode, town and province that travel with an address, under their block's names."""
    keep = F.map_filter(datos, lambda k, v: k.isin(*fv.ADDRESS_FIELDS[1:]) & ~is_blank(v))
    return F.transform_keys(keep, lambda k, v: _second(k, tipo == "direccion_comercio"))


def _with_types(rows: DataFrame, documents: DataFrame, seq: Column, calls: DataFrame) -> DataFrame:
    """Add the type of each row's document, null without a list of documents."""
    if documents is None:
        return rows.withColumn("doc_type", F.lit(None).cast("string"))
    return ordered.lookup(rows, documents.select("case_id", "doc_id", "doc_type"),
                          ["case_id", "doc_id"], seq, source=calls)


def _package_values(tipo: Column, datos: Column) -> Column:
    """ARRAY<STRUCT<field, value, linked>> of a package: its address with what is linked, or all."""
    is_address = tipo.isin("direccion", "direccion_comercio")
    street = F.array(F.struct(
        _second(F.lit(fv.ADDRESS_FIELDS[0]), tipo == "direccion_comercio").alias("field"),
        F.try_element_at(datos, F.lit(fv.ADDRESS_FIELDS[0])).alias("value"),
        linked_values(tipo, datos).alias("linked")))
    single = F.transform(F.map_entries(datos), lambda e: F.struct(
        e["key"].alias("field"), e["value"].alias("value"),
        F.create_map().cast(_LINKED).alias("linked")))
    return F.when(is_address, street).otherwise(single)


def package_candidates(pkgs: DataFrame, documents: DataFrame = None,
                       calls: DataFrame = None) -> DataFrame:
    """Candidates of each package: one per address with its linked values, else one per value.

    `documents(case_id, doc_id, doc_type)` gives the type of the document a package comes from.
    """
    pkgs = _with_types(pkgs, documents, F.col("seq"), calls)
    rows = pkgs.select("*", F.posexplode(_package_values(F.col("tipo"), F.col("datos"))).alias(
        "pos", "c"))
    return rows.select(
        "case_id", "doc_id", "c.field", "c.value", "c.linked",
        F.struct(F.lit(0).alias("src"), F.col("seq"), F.col("pkg_seq"), F.col("pos")).alias("ord"),
        F.col("fuente").alias("document"), F.array().cast("array<string>").alias("engines"),
        F.col("etiqueta").alias("note"), "doc_type").where(~is_blank(F.col("value")))


def apply_package(pkgs: DataFrame, to_second: Column) -> DataFrame:
    """Values of a package under the chosen block's names, blanks skipped."""
    rows = pkgs.select("*", F.explode("datos").alias("key", "value"))
    return rows.where(~is_blank(F.col("value"))).select(
        "case_id", "seq", "pkg_seq", _second(F.col("key"), to_second).alias("field"), "value")


def proposal_candidates(voted: DataFrame, documents: DataFrame = None,
                        calls: DataFrame = None) -> DataFrame:
    """Candidates from voted values; dates never count.

    `documents(case_id, doc_id, doc_type)` names the document of a value's first sighting;
    `calls(case_id, doc_id, seq)` are the calls the votes came from.
    """
    rows = voted.where(~F.col("field").isin(*fv.DATE_FIELDS)).withColumnRenamed(
        "first_doc", "doc_id")
    rows = _with_types(rows, documents, F.col("first_seq"), calls)
    return rows.select(
        "case_id", "doc_id", "field", "value", F.create_map().cast(_LINKED).alias("linked"),
        F.struct(F.lit(1).alias("src"), F.col("first_seq").alias("seq"),
                 F.col("first_pos").alias("pkg_seq"), F.lit(0).alias("pos")).alias("ord"),
        F.coalesce(nonblank(F.col("doc_type")), F.lit(fv.UNKNOWN_DOCUMENT)).alias("document"),
        "engines", F.lit("").alias("note"), "doc_type")


def reply_candidates(parsed: DataFrame) -> DataFrame:
    """Candidates straight from replies, one per vote, before their documents are known.

    Merging them gives what merging voted values gives: an earlier vote of a value is its first.
    Both kinds leave a reply in one explode, so that rows keep the places their replies lie in.
    """
    def order(src, pkg_seq, pos) -> Column:
        return F.struct(F.lit(src).alias("src"), F.col("seq").alias("seq"), pkg_seq.alias("pkg_seq"), pos.alias("pos"))

    def of_package(p: Column, i: Column) -> Column:
        found = F.transform(_package_values(p["tipo"], p["datos"]), lambda c, pos: F.struct(
            c["field"].alias("field"), c["value"].alias("value"), c["linked"].alias("linked"),
            order(0, i, pos).alias("ord"), F.coalesce(p["fuente"], F.lit("")).alias("document"),
            F.coalesce(p["etiqueta"], F.lit("")).alias("note"),
            F.lit(None).cast("string").alias("engine")))
        return F.coalesce(F.filter(found, lambda c: ~is_blank(c["value"])), F.array())

    voted = F.transform(F.filter(replies.reply_votes(parsed), lambda v: ~v["field"].isin(*fv.DATE_FIELDS)),
                        lambda v: F.struct(
        v["field"].alias("field"), v["value"].alias("value"), F.create_map().cast(_LINKED).alias("linked"),
        order(1, v["pos"], F.lit(0)).alias("ord"), F.lit(fv.UNKNOWN_DOCUMENT).alias("document"),
        F.lit("").alias("note"), F.col("engine").alias("engine")))
    every = F.concat(F.coalesce(F.flatten(F.transform("reply.paquetes", of_package)), F.array()),
                     F.coalesce(voted, F.array()))
    return parsed.select("case_id", "doc_id", F.explode(every).alias("c")).select(
        "case_id", "doc_id", "c.*")


def trace(rows: DataFrame, documents: DataFrame, foreign: DataFrame = None) -> DataFrame:
    """Candidates that were merged or decided first, with what their documents tell.

    `documents(case_id, doc_id, doc_type)`, `foreign(case_id, doc_id, holder)` as from
    `intruder_documents`. Neither merging nor choosing the first depends on documents, so only the
    rows that are left meet them: of a document at most one for each value, or field, it gave first.
    """
    known = documents.select("case_id", "doc_id", "doc_type")
    if foreign is None:
        known = known.withColumn("holder", F.lit(None).cast("string"))
    else:
        known = known.join(foreign, ["case_id", "doc_id"], "full")
    rows = rows.drop("doc_type").join(known, ["case_id", "doc_id"], "left")
    voted = F.when(F.col("ord.src") == 1, nonblank(F.col("doc_type")))
    return flag_risky(mark_intruders(rows.withColumn("document", F.coalesce(voted, "document"))))


def document_holders(pkgs: DataFrame) -> DataFrame:
    """Holder each document claims in its company package, the last claim winning."""
    holder = F.upper(F.trim(F.try_element_at(F.col("datos"), F.lit("NIE"))))
    claims = pkgs.where(F.col("tipo") == "empresa").withColumn("holder", holder).where(
        ~is_blank(F.col("holder")))
    last = F.max(F.struct("seq", "pkg_seq", "holder")).alias("last")
    return claims.groupBy("case_id", "doc_id").agg(last).select(
        "case_id", "doc_id", F.col("last.holder").alias("holder"))


def expected_holder(holders: DataFrame) -> DataFrame:
    """Holder most documents of a case claim; cases with a tie have no row.

    Smallest and largest holder among those with the top count differ exactly on a tie, so one
    map-side combined aggregate decides without ranking.
    """
    n = holders.groupBy("case_id", "holder").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("case_id").agg(
        F.max(F.struct("n", "holder")).alias("hi"),
        F.min(F.struct((-F.col("n")).alias("n"), "holder")).alias("lo"))
    return top.where(F.col("hi.holder") == F.col("lo.holder")).select(
        "case_id", F.col("hi.holder").alias("expected"), F.col("hi.n").alias("n_documents"))


def intruder_documents(holders: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents whose holder is not the one their case expects.

    A case with very many documents is spread: the lookup buckets them by document.
    """
    known = ordered.lookup(holders, expected.select("case_id", "expected"), ["case_id"],
                           F.xxhash64("doc_id"))
    return known.where(
        F.col("holder") != F.col("expected")).select("case_id", "doc_id", "holder")


def flag_intruders(candidates: DataFrame, holders: DataFrame, expected: DataFrame,
                   calls: DataFrame = None) -> DataFrame:
    """Mark candidates from a document that belongs to another holder than the case's.

    Documents are judged first, so the candidates join once, with the few foreign documents.
    `calls(case_id, doc_id, seq)` are the calls the candidates came from.
    """
    return mark_intruders(ordered.lookup(candidates, intruder_documents(holders, expected),
                                         ["case_id", "doc_id"], F.col("ord.seq"), source=calls))


def mark_intruders(rows: DataFrame) -> DataFrame:
    """`intruder` and its note from `holder`, the foreign holder of a row's document."""
    intruder = F.col("holder").isNotNull()
    note = F.concat_ws(fv.NOTE_SEPARATOR, nonblank(F.col("note")),
                       F.format_string(fv.INTRUDER_NOTE, "holder"))
    return rows.withColumns({
        "intruder": intruder, "note": F.when(intruder, note).otherwise(F.col("note")),
    }).drop("holder")


def flag_risky(candidates: DataFrame) -> DataFrame:
    """`risky`: an intruder's value, or one from a document type that is risky for the field.

    The type is that of the value's document, or what a package names as its source.
    """
    return candidates.withColumn("risky", F.col("intruder") | is_risky_source(
        F.col("field"), F.col("document")) | is_risky_source(F.col("field"), F.col("doc_type")))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per distinct value of a field: the first wording, all engines behind it."""
    told = [c for c in ("value", "doc_id", "document", "note", "risky", "linked")
            if c in candidates.columns]
    first = F.min_by(F.struct("ord", *told), "ord").alias("first")
    if "engine" in candidates.columns:
        engines = F.array_sort(F.collect_set("engine"))
    else:
        engines = F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines"))))
    return candidates.groupBy("case_id", "field", value_key(F.col("value")).alias("value_fold")) \
        .agg(first, engines.alias("engines")) \
        .select("case_id", "field", "value_fold", "engines", "first.*")


def decide(merged: DataFrame, protected: DataFrame = None) -> DataFrame:
    """State of every field that has candidates, with its first candidate."""
    return states(first_candidates(merged, protected))


def first_candidates(merged: DataFrame, protected: DataFrame = None) -> DataFrame:
    """First candidate of every field that has any, `n_values`, and `kept` for protected fields.

    `protected(case_id, field)` are fields filled by the user or by a default: they become USER.
    They enter the same aggregate as marker rows, so no join is needed. As `protected(case_id, fields)`,
    see `protected_by_case`, they join the fields that are left.
    """
    by_case = protected is not None and "fields" in protected.columns
    told = [c for c in _DECIDED if c in merged.columns]
    rows = merged.select("case_id", "field", "ord", F.struct("ord", *told).alias("c"),
                         F.lit(False).alias("kept"))
    if protected is not None and not by_case:
        rows = rows.unionByName(protected.select("case_id", "field", F.lit(True).alias("kept")),
                                allowMissingColumns=True)
    per_field = rows.groupBy("case_id", "field").agg(
        F.count("ord").alias("n_values"), F.min_by("c", "ord").alias("first"),
        F.bool_or("kept").alias("kept")).where(F.col("n_values") > 0)
    if by_case:
        per_field = _with_protected(per_field.drop("kept"), protected, "kept")
    return per_field.select("case_id", "field", "n_values", "kept", "first.*")


def protected_by_case(protected: DataFrame) -> DataFrame:
    """`case_id, fields`: the protected fields of each case, a set of catalogue fields.

    In this form they meet rows that lie together by case without a shuffle of these.
    """
    return protected.groupBy("case_id").agg(F.collect_set("field").alias("fields"))


def _with_protected(rows: DataFrame, protected: DataFrame, out: str) -> DataFrame:
    """Add whether a row's field is protected; `protected(case_id, fields)`."""
    found = F.coalesce(F.array_contains("fields", F.col("field")), F.lit(False))
    return rows.join(protected, "case_id", "left").withColumn(out, found).drop("fields")


def states(firsts: DataFrame) -> DataFrame:
    """State of each field from its first candidate, the number of its values and its protection."""
    state = (F.when(F.col("kept"), USER).when(F.col("n_values") > 1, CONFLICT)
             .when(F.col("risky"), WARN).otherwise(AI))
    return firsts.select("case_id", "field", state.alias("state"), "n_values", *_DECIDED)


def autofill(decisions: DataFrame, protected: DataFrame = None) -> DataFrame:
    """Values that may be filled: AI fields, and what is linked to them.

    A field's own decision beats a linked value, whatever that decision is, and a protected
    field is never touched. One shuffle settles both: rows are ranked by kind and the best kept;
    a decision and its linked values leave it in one explode, so it is computed once.
    """
    ai = F.col("state") == AI
    own = F.array(F.struct(F.col("field").alias("to"), F.when(ai, F.col("value")).alias("value"),
                           F.lit(0).alias("prio")))
    linked = F.transform(F.map_entries("linked"), lambda e: F.struct(
        e["key"].alias("to"), e["value"].alias("value"), F.lit(1).alias("prio")))
    every = F.when(ai & F.col("linked").isNotNull(), F.concat(own, linked)).otherwise(own)
    rows = decisions.select("case_id", F.col("field").alias("via"), "document", "engines", "note",
                            F.explode(every).alias("c")).select(
        "case_id", F.col("c.to").alias("field"), "c.prio", "via", "c.value", "document", "engines",
        "note")
    if protected is not None and "fields" in protected.columns:
        rows = _with_protected(rows, protected, "kept").where("not kept").drop("kept")
    elif protected is not None:
        rows = rows.unionByName(protected.select(
            "case_id", "field", F.lit(-1).alias("prio")), allowMissingColumns=True)
    best = F.min_by(F.struct("value", "via", "document", "engines", "note"),
                    F.struct("prio", "via")).alias("best")
    return rows.groupBy("case_id", "field").agg(best).select(
        "case_id", "field", "best.*").where(F.col("value").isNotNull())


def pending_decisions(decisions: DataFrame, *by) -> DataFrame:
    """Fields still to be decided per case (and other grouping columns); ready when none is."""
    pending = F.count_if(F.col("state").isin(CONFLICT, WARN)).alias("n_pending")
    return decisions.groupBy("case_id", *by).agg(pending).withColumn(
        "ready", F.col("n_pending") == 0)


def state_counts(decisions: DataFrame) -> DataFrame:
    """Number of fields in each state, per case."""
    counts = [F.count_if(F.col("state") == s).alias(f"n_{s.lower()}")
              for s in (AI, CONFLICT, WARN, USER)]
    return decisions.groupBy("case_id").agg(*counts)
