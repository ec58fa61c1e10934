import os
import random

import pytest
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions import rules
from casefuse.functions.text import fold
from casefuse.operators import catalogue, matching
from casefuse.session import shared_dir
from casefuse.sources import tables

WORDS = "red blue ring gear big small widget hot cold box de CP código postal nombre".split()


def _names(rnd, n):
    out = [" ".join(rnd.sample(WORDS, rnd.randrange(1, 6))) for _ in range(n)]
    return out + [w[:rnd.randrange(1, 4)] for w in out[:20]] + ["", "  ", "Código  Postal", "codigo postal", "é"]


@pytest.mark.parametrize("least", [0.5, 0.69, 0.75])
def test_catalogue_match_equals_all_pairs(spark, least):
    rnd = random.Random(4)
    entries = list(dict.fromkeys(_names(rnd, 150)))
    names = [(i, n) for i, n in enumerate(_names(rnd, 120) + [None])]
    fields = spark.createDataFrame(names, "ord long, field_name string")
    table = spark.createDataFrame([(c, i) for i, c in enumerate(entries)], "canonical string, ord long")
    got = {r.ord: (r.canonical, r.score) for r in catalogue.match_catalogue(fields, table, least).collect()}
    # Every name against every entry, only here.
    a, b = fold(F.col("field_name")), fold(F.col("canonical"))
    scored = fields.crossJoin(table.withColumnRenamed("ord", "at")).withColumn("score", matching.name_score(a, b)).where(
        (F.col("score") >= least) & (a != "") & (b != ""))
    want = {r.ord: (r.c.canonical, r.c.score) for r in scored.groupBy("ord").agg(F.max(F.struct(
        "score", (-F.col("at")).alias("at"), "canonical")).alias("c")).collect()}
    assert got == {i: want.get(i, (None, 0.0)) for i, _ in names}
    assert len(want) > 50


def test_catalogue_match_has_no_cross_join(spark):
    fields = spark.createDataFrame([(1, "a b")], "ord long, field_name string")
    table = spark.createDataFrame([], "canonical string, ord long")
    got = catalogue.match_catalogue(fields, table)
    assert [(r.canonical, r.score) for r in got.collect()] == [(None, 0.0)]
    assert "Cross" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rules_from_a_table_equal_the_literals(spark):
    table = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(fv.DOC_TYPE_RULES)],
                                  "ord int, name string, pattern string")
    texts = spark.createDataFrame([("Modelo 036 con tarjeta acreditativa",), ("Pasaporte",), ("nada",), (None,)], "t string")
    shuffled = table.unionByName(spark.createDataFrame([(-1, "never", None)], table.schema)).orderBy(F.rand(1))
    got = texts.select(rules.document_type(F.col("t"), rules.rules_of(shuffled)).alias("a"),
                       rules.document_type(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    with pytest.raises(ValueError):
        rules.rules_of(table, most=3)
    none = rules.document_type(F.col("t"), rules.rules_of(table.limit(0)))
    assert {r[0] for r in texts.select(none).collect()} == {fv.DEFAULT_DOC_TYPE}


def test_compaction_rewrites_only_touched_parts(spark):
    path = shared_dir(spark, "parted")
    schema = "owner long, v string, op_seq long, deleted boolean"
    tables.append_parted(spark.createDataFrame([(i, f"v{i}", 0, False) for i in range(80)], schema), path, ["owner"], 16)
    changes = [(3, "new", 1, False), (7, None, 1, True), (8, None, 1, True), (8, "back", 2, False)]
    tables.append_parted(spark.createDataFrame(changes, schema), path, ["owner"], 16)

    def seen():
        rows = tables.latest(spark.read.parquet(path), ["owner"], "op_seq").where("NOT deleted").collect()
        return sorted((r.owner, r.v) for r in rows)

    def files():
        return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet"))
                for d in os.listdir(path) if d.startswith("part=")}
    before, old = seen(), files()
    touched = tables.compact(spark, path, ["owner"], "op_seq", gone="deleted")
    now = files()
    assert seen() == before and 1 <= len(touched) <= 3
    assert {d for d in old if old[d] != now[d]} == {f"part={p}" for p in touched}
    assert spark.read.parquet(path).where("deleted").count() == 0 and spark.read.parquet(path).count() == 79
    assert tables.compact(spark, path, ["owner"], "op_seq", gone="deleted") == []
