import json

from pyspark.sql import functions as F

from casefuse.operators import replies, voting

CALLS = "case_id long, doc_id long, engine string, seq long, http_code int, ok boolean, error string, text string"


def parsed(spark, texts, engine="claude"):
    rows = [(1, 1, engine, i, 200, True, None, t) for i, t in enumerate(texts)]
    return replies.parse_replies(spark.createDataFrame(rows, CALLS))


def test_reply_wrapped_in_prose(spark):
    text = "Resultado del documento 3\n~~~\n{\"sugerencias\":{\"CP\":\"8001\",\"Población\":\"{x\"}}\n~~~\nSaludos."
    assert parsed(spark, [text]).first().reply.sugerencias == {"CP": "8001", "Población": "{x"}


def test_replies_must_be_one_object_with_plain_values(spark):
    texts = ['{"sugerencias":{"CP":"1"}} {"sugerencias":{"CP":"2"}}', '{"sugerencias":{"CP":"1"}} nota {x}',
             '{"sugerencias":{"CP":{"a":1}}}', '{"alternativas":{"CP":[{"valor":["1"]}]}}',
             '{"paquetes":[{"tipo":"banco","datos":{"x":[]}}]}']
    assert [r.reply for r in parsed(spark, texts).collect()] == [None] * 5
    assert replies.reject_log(parsed(spark, texts)).count() == 5


def test_types_decide_and_not_the_text_of_a_value(spark):
    kept = ['{"sugerencias":{"CP":"[1]","NIE":"{}"}}', '{"tipo_documento":"{x","paquetes":[{"tipo":"[a]"}]}',
            '{"alternativas":{"CP":[{"valor":"[]","fuente":"{}","nota":"[n"}]}}']
    gone = ['{"tipo_documento":{"a":1}}', '{"tipo_identificacion":["CIF"]}',
            '{"paquetes":[{"tipo":"banco","etiqueta":{}}]}', '{"paquetes":[{"tipo":["banco"]}]}',
            '{"alternativas":{"CP":[{"valor":"1","nota":[]}]}}', '{"sugerencias":{"CP":"[1]","NIE":[1]}}']
    rows = parsed(spark, kept + gone).orderBy("seq").collect()
    assert [r.reply is not None for r in rows] == [True] * 3 + [False] * 6
    assert rows[0].reply.sugerencias == {"CP": "[1]", "NIE": "{}"}
    assert rows[1].reply.tipo_documento == "{x"


def test_of_a_repeated_key_the_last_value_counts(spark):
    text = ('{"sugerencias":{"CP":"1","CP":"2","Fecha":"3","CP":"4"},'
            '"alternativas":{"NIE":[{"valor":"b1"}],"NIE":[{"valor":"b2"},{"valor":"b3"}]},'
            '"paquetes":[{"tipo":"banco","datos":{"x":"5","x":"6"}},{"tipo":"banco","datos":{"x":"7"}}]}')
    rows = replies.proposals(parsed(spark, [text])).orderBy("pos").collect()
    assert [(r.field, r.value) for r in rows] == [
        ("Fecha", "3"), ("CP", "4"), ("NIE", "b2"), ("NIE", "b3"), ("x", "6"), ("x", "7")]
    assert replies.packages(parsed(spark, [text])).count() == 2


def test_broken_replies_are_rejected_whole(spark):
    good = {"sugerencias": {"CP": "1"}, "paquetes": [{"tipo": "banco", "datos": {}}], "otro": 1}
    no_type = {"sugerencias": {"CP": "1"}, "paquetes": [{"etiqueta": "x"}]}
    no_value = {"alternativas": {"CP": [{"fuente": "x"}]}}
    texts = [json.dumps(good), json.dumps(no_type), json.dumps(no_value), json.dumps(good)[:-9],
             None, "sin json", '{"sugerencias": "texto"}', "} {"]
    rows = parsed(spark, texts).orderBy("seq").collect()
    assert [r.reply is not None for r in rows] == [True] + [False] * 7
    log = replies.reject_log(parsed(spark, texts)).orderBy("seq").collect()
    assert [r.seq for r in log] == [1, 2, 3, 4, 5, 6, 7]
    assert log[3].snippet == "(vacío)" and log[4].snippet == "sin json"


def test_snippet_is_one_short_line(spark):
    log = replies.reject_log(parsed(spark, ["  a\nb" + "x" * 300])).first()
    assert log.snippet == ("a b" + "x" * 300)[:180]


def test_suggestion_only_engine(spark):
    text = json.dumps({"sugerencias": {"CP": "1"}, "alternativas": {"CP": [{"valor": "2"}]},
                       "paquetes": [{"tipo": "banco", "datos": {"x": "y"}}]})
    assert [(r.field, r.value) for r in replies.votes(parsed(spark, [text], "groq")).collect()] == [("CP", "00001")]
    assert replies.votes(parsed(spark, [text])).count() == 3


def test_shop_address_votes_for_the_second_block(spark):
    text = json.dumps({"paquetes": [{"tipo": "direccion_comercio", "datos": {"CP": "46001", "NIE": "b1"}}]})
    assert {(r.field, r.value) for r in replies.votes(parsed(spark, [text])).collect()} == {
        ("CP_2", "46001"), ("NIE", "B1")}


def test_error_text_that_looks_like_json(spark):
    df = spark.createDataFrame([('{"error":"[1]"}',), ('{"error":"{}"}',), ('{"error":[1]}',), ('{"error":{"a":"[1]"}}',),
                                ('{"error":7}',)], "body string")
    assert [r.m for r in df.select(replies.error_message(F.col("body")).alias("m")).collect()] == [
        "[1]", "{}", '{"error":[1]}', '{"error":{"a":"[1]"}}', "7"]


def test_error_message(spark):
    df = spark.createDataFrame([('{"ok":false,"error":"cuota"}',), ("x" * 300,), (" ",), (None,),
                                ('{"error":{"code":429}}' + " " * 300,), ('{"error":"[x] y"}',)], "b string")
    assert [r[0] for r in df.select(replies.error_message(F.col("b"))).collect()] == [
        "cuota", "x" * 200, None, None, ('{"error":{"code":429}}' + " " * 300)[:200], "[x] y"]


def test_consensus_beats_order(spark):
    rows = [(1, "F", "rojo", "ovh", 0, 0, 1), (1, "F", "azul", "ovh", 0, 1, 1), (1, "F", "azul", "grok", 1, 0, 1)]
    votes = spark.createDataFrame(rows, "case_id long, field string, value string, engine string, seq long, pos int, doc_id long")
    voted = voting.aggregate_votes(votes)
    ranked = voting.rank_values(voted, width=1).orderBy("rank").collect()
    assert [(r.value, r.n_engines, r.rank) for r in ranked] == [("azul", 2, 1), ("rojo", 1, 2)]
    assert voting.top_values(voted).first().value == "azul"


def test_permanent_failure_ends_an_engine(spark):
    codes = {0: 200, 1: 503, 2: 403, 3: 200, 4: 200}
    rows = [(1, "a", s, c) for s, c in codes.items()] + [(1, "b", 5, 200), (2, "a", 6, 200)]
    calls = spark.createDataFrame(rows, "case_id long, engine string, seq long, http_code int")
    assert sorted(r.seq for r in voting.drop_dead_engines(calls).collect()) == [0, 1, 2, 5, 6]


def test_coverage_cut(spark):
    fields = voting.coverage_fields()
    assert len(fields) == 18
    rows = [(1, f, min(i // 4, 4)) for i, f in enumerate(fields)] + [(2, fields[0], s) for s in range(9)]
    votes = spark.createDataFrame(rows, "case_id long, field string, seq long")
    calls = spark.createDataFrame([(c, s) for c in (1, 2) for s in range(9)], "case_id long, seq long")
    kept = voting.stop_when_covered(calls, voting.coverage_point(votes, fields)).collect()
    assert sorted(r.seq for r in kept if r.case_id == 1) == [0, 1, 2, 3, 4]
    assert len([r for r in kept if r.case_id == 2]) == 9


def test_majority_tie_goes_to_the_first_seen(spark):
    rows = [(1, 3, "NIF"), (1, 5, "NIF"), (1, 2, "CIF"), (1, 9, "CIF"), (1, 1, None)]
    calls = spark.createDataFrame(rows, "case_id long, seq long, tipo_identificacion string")
    assert voting.majority_type(calls).first().tipo_identificacion == "CIF"


def test_engine_order(spark):
    rows = [(1, e, i) for i, e in enumerate(["ovh", "claude", "nebius", "groq", "mistral"])]
    out = voting.order_engines(spark.createDataFrame(rows, "case_id long, engine string, ord int")).orderBy("call_order")
    assert [r.engine for r in out.collect()] == ["groq", "mistral", "claude", "ovh", "nebius"]


def test_first_valid_box(spark):
    rows = [(1, "claude", 0., 0., 50., 50.), (1, "mistral", 0., 0., 15., 50.), (1, "scaleway", 1., 2., 16., 9.),
            (2, "groq", 0., 0., 99., 99.)]
    boxes = spark.createDataFrame(rows, "case_id long, engine string, x double, y double, w double, h double")
    assert [(r.case_id, r.engine) for r in voting.first_valid_box(boxes).collect()] == [(1, "scaleway")]
