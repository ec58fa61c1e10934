from pyspark.sql import functions as F

from casefuse.llm import lines
from casefuse.llm.queries import QUERIES, SQL
from tests.llm.common import awkward, documents
from tests.oracle import connect, spark_rows, sql_rows


def test_query_equals_sql(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        got = spark_rows(QUERIES["op8_line_site_frequency"](spark, folder))
        assert got == sql_rows(connect(folder), SQL["op8_line_site_frequency"])


def report(spark, rows, **how):
    got = lines.line_report(documents(spark, rows), F.col("source"), **how).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str)


def test_boilerplate_goes_and_the_rest_stays(spark):
    rows = [(i, f"Own line {i}\n Subscribe now \n\nlast {i}", "a") for i in range(20)]
    rows += [(20 + i, f"Subscribe now\nother {i}", "b") for i in range(2)]
    rows += [(30 + i, "copied text\nin two lines", "a") for i in range(10)]
    got = report(spark, rows, max_ratio=0.2)
    assert [r[2] for r in got if r[0] < 20] == [1] * 20
    assert all(r[3] == f"Own line {r[0]}\n\nlast {r[0]}" for r in got if r[0] < 20)
    assert all(r[2] == 0 for r in got if r[0] >= 20)


def test_awkward_rows(spark):
    rows = awkward() + [(50 + i, f"x{i}\n© always", None) for i in range(4)]
    got = {(i, t) for i, _, _, t in report(spark, rows, max_ratio=0.1)}
    want = {(i, t) for i, t, s in rows if i is None or i < 50} | {(50 + i, f"x{i}") for i in range(4)}
    assert got == want
    docs = documents(spark, rows)
    cut = lines.drop_boilerplate(docs, F.col("source"), max_ratio=0.1)
    assert [f.name for f in cut.schema] == docs.columns
    assert [f.dataType for f in cut.schema] == [f.dataType for f in docs.schema]
    assert cut.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)
    assert lines.drop_boilerplate(documents(spark, []), F.col("source")).count() == 0


def test_all_lines_dropped_leave_an_empty_text(spark):
    rows = [(i, "menu" if i else "menu\nfooter", "a") for i in range(2)] + [
        (9, "menu\nx", "a"), (8, "footer\ny", "a"), (7, "footer\nmenu\nz", "a")]
    got = report(spark, rows, max_ratio=0.3)
    assert [(r[0], r[3]) for r in got] == [(0, ""), (1, ""), (7, "z"), (8, "y"), (9, "x")]


def test_host_of(spark):
    urls = ["http://A.example.com/x", "https://b.example:80?x", "c", None, "ftp://d#e"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(
        lines.host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in got] == ["a.example.com", "b.example", None, None, "d"]
