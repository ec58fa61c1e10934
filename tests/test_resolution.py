from pyspark.sql import functions as F

from casefuse.operators import resolve

PKG = ("case_id long, doc_id long, engine string, seq long, pkg_seq int, tipo string, etiqueta string, "
       "fuente string, datos map<string,string>")
VOTED = ("case_id long, field string, value string, engines array<string>, n_engines long, first_seq long, "
         "first_pos int, first_doc long")
DOCS = "case_id long, doc_id long, doc_type string"


def company(doc, holder, seq=None, **more):
    return (1, doc, "e", doc if seq is None else seq, 0, "empresa", "lbl", f"doc{doc}", {"NIE": holder, **more})


def voted(field, value, doc, seq=50, engines=("a", "b")):
    return (1, field, value, list(engines), len(engines), seq, 0, doc)


def decide(spark, pkgs, votes=(), docs=(), protected=()):
    p = spark.createDataFrame(list(pkgs), PKG)
    types = spark.createDataFrame(list(docs), DOCS)
    rows = resolve.package_candidates(p, types).unionByName(resolve.proposal_candidates(
        spark.createDataFrame(list(votes), VOTED), types))
    holders = resolve.document_holders(p)
    flagged = resolve.flag_risky(resolve.flag_intruders(rows, holders, resolve.expected_holder(holders)))
    kept = spark.createDataFrame([(1, f) for f in protected], "case_id long, field string")
    decisions = resolve.decide(resolve.merge_candidates(flagged), kept)
    values = resolve.autofill(decisions, kept)
    return ({r.field: r for r in decisions.collect()}, {r.field: r.value for r in values.collect()})


def test_clean_case(spark):
    d, v = decide(spark, [company(i, "A1") for i in (1, 2, 3)], [voted("NIE", "A1", 1)])
    assert d["NIE"].state == "AI" and d["NIE"].engines == ["a", "b"] and not d["NIE"].risky
    assert v == {"NIE": "A1"}


def test_intruder_document(spark):
    d, v = decide(spark, [company(1, "A1"), company(2, "a1 "), company(3, "B9", Extra="x")])
    assert d["Extra"].state == "WARN" and d["Extra"].risky
    assert d["Extra"].note == "lbl · este documento parece de otro titular (B9)"
    assert d["NIE"].state == "CONFLICT" and v == {}


def test_package_value_of_a_risky_document_type(spark):
    """The type of the document counts as much as what the package names as its source."""
    iban, bank = "Datos bancarios del DISTRIBUIDOR", (1, 4, "e", 4, 0, "banco", "", "hoja 2")
    docs = [(1, 4, "Contrato de alquiler")]
    d, v = decide(spark, [(*bank, {iban: "ES1"})], docs=docs)
    assert d[iban].state == "WARN" and v == {} and d[iban].document == "hoja 2"
    d, v = decide(spark, [(*bank, {iban: "ES1"})], docs=[(1, 4, "DNI")])
    assert d[iban].state == "AI" and v == {iban: "ES1"}
    d, v = decide(spark, [(*bank[:7], "Factura", {iban: "ES1"})])
    assert d[iban].state == "WARN" and v == {}


def test_tie_accuses_nobody(spark):
    d, _ = decide(spark, [company(1, "A1", Extra="x"), company(2, "B9", Other="y")])
    assert d["Extra"].state == "AI" and d["Other"].state == "AI"


def test_last_claim_of_a_document_counts(spark):
    p = spark.createDataFrame([company(1, "A1", seq=1), company(1, "B2", seq=2)], PKG)
    assert [(r.doc_id, r.holder) for r in resolve.document_holders(p).collect()] == [(1, "B2")]


def test_risky_source(spark):
    d, v = decide(spark, [], [voted("Datos bancarios del DISTRIBUIDOR", "ES1", 7), voted("Teléfono", "6", 8)],
                  [(1, 7, "Contrato de alquiler"), (1, 8, "Factura")])
    assert d["Datos bancarios del DISTRIBUIDOR"].state == "WARN" and d["Teléfono"].state == "AI"
    assert v == {"Teléfono": "6"}


def test_values_equal_but_for_case_are_one(spark):
    d, v = decide(spark, [], [voted("Dirección", "Calle A", 1, 1), voted("Dirección", " calle a ", 1, 2)])
    assert d["Dirección"].state == "AI" and v == {"Dirección": "Calle A"}


def test_dates_are_never_candidates(spark):
    d, _ = decide(spark, [], [voted("Fecha", "3", 1), voted("CP", "1", 1)])
    assert set(d) == {"CP"}


def address(tipo, doc, street, **rest):
    return (1, doc, "e", doc, 0, tipo, "", f"doc{doc}", {"Dirección": street, **rest})


def test_linked_values_follow_their_address(spark):
    d, v = decide(spark, [address("direccion", 1, "Calle A", CP="46001", Provincia="Valencia", Población=" "),
                          address("direccion_comercio", 2, "Local B", CP="28001"),
                          address("direccion", 3, "  ", CP="99999")], protected=["CP"])
    assert v == {"Dirección": "Calle A", "Provincia": "Valencia", "Dirección_2": "Local B", "CP_2": "28001"}
    assert set(d) == {"Dirección", "Dirección_2"}


def test_own_decision_beats_a_linked_value(spark):
    d, v = decide(spark, [address("direccion", 1, "Calle A", CP="46001")],
                  [voted("CP", "1", 1, 1), voted("CP", "2", 1, 2)])
    assert d["CP"].state == "CONFLICT" and v == {"Dirección": "Calle A"}


def test_protected_fields_become_user(spark):
    d, v = decide(spark, [], [voted("CP", "1", 1, 1), voted("CP", "2", 1, 2)], protected=["CP", "NIE"])
    assert d["CP"].state == "USER" and set(d) == {"CP"} and v == {}


def test_pending_is_conflict_plus_warn(spark):
    rows = [(1, s) for s in ("AI", "CONFLICT", "WARN", "USER")] + [(2, "AI")]
    df = spark.createDataFrame(rows, "case_id long, state string")
    assert {(r.case_id, r.n_pending, r.ready) for r in resolve.pending_decisions(df).collect()} == {
        (1, 2, False), (2, 0, True)}
    counts = {r.case_id: (r.n_ai, r.n_conflict, r.n_warn, r.n_user) for r in resolve.state_counts(df).collect()}
    assert counts == {1: (1, 1, 1, 1), 2: (1, 0, 0, 0)}


def test_input_order_does_not_matter(spark):
    votes = [voted("CP", f"v{i % 3}" if i % 2 else f"V{i % 3}", i, i) for i in range(12)]
    a, _ = decide(spark, [company(i, "A1") for i in range(4)], votes)
    b, _ = decide(spark, [company(i, "A1") for i in reversed(range(4))], votes[::-1])
    assert a == b


def test_candidates_of_whole_cases_are_not_shuffled(spark, sf):
    import re

    import bindings
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("autofilled_values", "pending_decisions", "state_counts", "protected_fields"):
            plan = bindings.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(case_id#\d+L?, (field|doc_id|_grouping)", plan), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_protected_fields_by_case_equal_marker_rows(spark, sf):
    from bindings import resolving
    from casefuse.session import tune
    stages = resolving._Stages(spark, sf)
    tune(spark)
    marked, by_case = resolving._protected(spark, sf), stages.protected
    assert by_case.columns == ["case_id", "fields"]
    shown = ["case_id", "field", "state", "n_values", "value", "document"]
    one, two = stages.decisions(marked), stages.decisions(by_case)
    assert sorted(map(str, one.select(*shown).collect())) == sorted(map(str, two.select(*shown).collect()))
    filled = [sorted(map(str, resolve.autofill(one, p).collect())) for p in (marked, by_case)]
    assert filled[0] == filled[1] and filled[0]


def test_calls_of_a_hot_case_give_the_same(spark, sf, monkeypatch):
    from bindings import common, resolving
    from casefuse.operators import ordered

    def counts():
        stages = resolving._Stages(spark, sf)
        return sorted(map(str, resolve.state_counts(stages.decisions(stages.protected)).collect())), stages

    want, _ = counts()
    monkeypatch.setattr(common, "by_key", lambda *a, **k: ordered.by_key(*a, **{**k, "rows": 12}))
    got, stages = counts()
    assert "field" in stages.protected.columns and got == want
