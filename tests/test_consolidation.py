"""The whole plan's steps: dealing calls, ends of cases, one pass over decisions."""

import random

from pyspark.sql import functions as F

from bindings.common import calls
from bindings.resolving import COVERAGE
from casefuse.operators import ordered, replies, resolve, voting
from casefuse.plans.consolidation import call_issues, counted_calls, identification
from casefuse.sources.tables import written

REPLY = ("case_id long, doc_id long, engine string, seq long, http_code int, part int, reply struct<"
         "tipo_documento:string, paquetes:array<struct<tipo:string,etiqueta:string,fuente:string,"
         "datos:map<string,string>>>>, votes array<struct<pos:int,field:string,value:string>>")


def digested(spark, n=400, hot=None):
    rnd, rows = random.Random(5), []
    for seq in range(n):
        case = 1 if hot and seq % 2 else rnd.randrange(12)
        holder = rnd.choice(["A1", "A1", "A1", "B2"])
        pkgs = [("empresa", "", "f", {"NIE": holder, "Extra": rnd.choice("xy")}),
                ("direccion", "fiscal", "g", {"Dirección": "Calle " + rnd.choice("ab"), "CP": "46001"})]
        votes = [(i, rnd.choice(["NIE", "CP", "Teléfono"]), rnd.choice(["u", "U", "v"])) for i in range(3)]
        rows.append((case, seq % 4, rnd.choice("abc"), seq, rnd.choice([200] * 9 + [401]), 0,
                     (rnd.choice(["Factura", "Contrato de alquiler", " "]), pkgs), votes))
    return spark.createDataFrame(rows, REPLY)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_dealt_rows_of_a_key_lie_together_unless_it_is_hot(spark):
    df, many = ordered.together(digested(spark, hot=True).drop("part"), ["case_id"], F.col("seq"), rows=100, each=50)
    places = {}
    for r in df.withColumn("at", F.spark_partition_id()).collect():
        places.setdefault(r.case_id, set()).add(r.at)
    assert many >= 8 and df.count() == 400
    assert len(places.pop(1)) > 3 and all(len(p) == 1 for p in places.values())


def test_ends_of_cases_are_those_of_both_cuts(spark):
    df, fields = digested(spark, hot=True), ["NIE", "CP"]
    alive = voting.drop_dead_engines(df)
    want = voting.stop_when_covered(alive, voting.coverage_point(replies.votes(alive, fields), fields))
    dealt, _ = ordered.together(df.drop("part"), ["case_id"], F.col("seq"), rows=100)
    got = voting.before_stops(dealt, voting.stops(df, fields), rows=100)
    seqs = sorted(r.seq for r in want.collect())
    assert 0 < len(seqs) < 400 and sorted(r.seq for r in got.collect()) == seqs
    lazy = voting.before_stops(df.drop("part"), voting.stops(df, fields))
    assert sorted(r.seq for r in lazy.collect()) == seqs
    only_dead = voting.before_stops(df.drop("part"), voting.stops(df))
    assert sorted(r.seq for r in only_dead.collect()) == sorted(r.seq for r in alive.collect())


def test_documents_may_be_met_after_the_decision(spark):
    df = digested(spark)
    pkgs, types = replies.packages(df), df.where(F.trim("reply.tipo_documento") != "").groupBy(
        "case_id", "doc_id").agg(F.min_by("reply.tipo_documento", "seq").alias("doc_type"))
    holders = resolve.document_holders(pkgs)
    expected = resolve.expected_holder(holders)
    kept = spark.createDataFrame([(3, "CP"), (4, "NIE")], "case_id long, field string")
    rows = resolve.package_candidates(pkgs, types).unionByName(resolve.proposal_candidates(
        voting.aggregate_votes(replies.votes(df)), types))
    early = resolve.decide(resolve.merge_candidates(resolve.flag_risky(
        resolve.flag_intruders(rows, holders, expected))), kept)
    late = resolve.states(resolve.trace(resolve.first_candidates(
        resolve.merge_candidates(resolve.reply_candidates(df)), kept), types,
        resolve.intruder_documents(holders, expected)))
    a, b = ({(r.case_id, r.field): r for r in d.collect()} for d in (early, late.select(early.columns)))
    assert a == b and {r.state for r in a.values()} >= {"CONFLICT", "USER"}


def test_decisions_are_computed_once_for_filling(spark):
    rows = [(1, "Dirección", "AI", "Calle A", "f", "", ["e"], {"CP": "46001"}), (1, "NIE", "WARN", "A1", "f", "", ["e"], {})]
    decisions = written(spark.createDataFrame(
        rows, "case_id long, field string, state string, value string, document string, note string, "
              "engines array<string>, linked map<string,string>"), "decisions")
    values = resolve.autofill(decisions)
    assert {(r.field, r.value, r.via) for r in values.collect()} == {
        ("Dirección", "Calle A", "Dirección"), ("CP", "46001", "Dirección")}
    assert scans(resolve.autofill(decisions)) == 1


def test_texts_behind_the_object_and_nested_members_are_found_by_counting(spark):
    whole = '{"sugerencias":{"CP":"1"},"paquetes":[{"tipo":"t","datos":{"a":"b"}}]}'
    texts = {
        whole: True, f"vea {whole} fin": True, whole + "}": False, whole + " x}": False, whole + "]}": False,
        whole + whole: False, whole + " {}": False, whole.replace('"1"', '"{1"'): True,
        whole.replace('"1"', '"1}"'): True, whole.replace('"1"', '"]["'): True,
        whole.replace('"1"', '{"x":1}'): False, whole.replace('"1"', "[1]"): False,
        whole.replace('"1"', '"1","y":null'): True, whole.replace('{"a":"b"}', "null"): True,
        '{"alternativas":{"a":[{"valor":"v"}],"b":[]},"z":[{}]}': True, "{}": True, "{": False, "}{": False,
        whole.replace('[{"tipo"', '[null,{"tipo"'): False,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.ok for r in rows.select("i", replies.decode_reply(F.col("text")).isNotNull().alias("ok")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_issues_and_types_need_no_values(spark, sf):
    rows = calls(spark, sf).where("case_id < 50")
    whole = written(counted_calls(rows, COVERAGE), "whole")
    thin = written(counted_calls(rows, COVERAGE, values=False), "thin")
    assert "paquetes" in whole.schema["reply"].dataType.names
    assert not {"paquetes", "sugerencias", "alternativas"} & set(thin.schema["reply"].dataType.names)
    fields = {r.field for r in replies.votes(thin).select("field").distinct().collect()}
    assert fields and fields <= set(COVERAGE)
    for made in (call_issues, identification):
        want = sorted(map(tuple, made(whole).collect()))
        assert want and sorted(map(tuple, made(thin).collect())) == want
