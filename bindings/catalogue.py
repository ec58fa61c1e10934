"""Names against a catalogue table, rules out of a table, and a compacted history."""

from pyspark.sql import functions as F

from bindings.common import query, table
from bindings.parsing import _DOC_TYPE, _TYPED, _TYPED_SQL
from bindings.stored import _SAVED, _profiles
from casefuse import fixed_values as fv
from casefuse.functions import rules
from casefuse.operators import catalogue
from casefuse.session import shared_dir
from casefuse.sources import history as hi
from casefuse.sources import tables as tb

_NAMED = "c_mktsegment || ' ' || (c_custkey % 17) || ' n' || c_nationkey"
_ENTRY = "c_mktsegment || ' n' || c_nationkey || case c_custkey % 3 when 0 then '' else ' ' || (c_custkey % 13) end"


@query("catalogue_matches", f"""
WITH names AS (SELECT DISTINCT {_NAMED} AS field_name, lower({_NAMED}) AS a FROM customer),
entries AS (SELECT {_ENTRY} AS canonical, lower({_ENTRY}) AS b, min(c_custkey) AS ord FROM customer GROUP BY 1, 2),
t AS (SELECT *, string_split(a, ' ') AS ta FROM names), u AS (SELECT *, string_split(b, ' ') AS tb FROM entries),
scored AS (SELECT field_name, canonical, ord, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8
  ELSE round(0.7 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) END AS score FROM t, u),
best AS (SELECT * FROM scored WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY score DESC, ord) = 1)
SELECT n.field_name, canonical, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM names n LEFT JOIN best USING (field_name)""")
def catalogue_matches(spark, sf):
    customers = table(spark, sf, "customer")
    names = customers.select(F.expr(_NAMED).alias("field_name")).distinct()
    entries = customers.groupBy(F.expr(_ENTRY).alias("canonical")).agg(F.min("c_custkey").alias("ord"))
    return catalogue.match_catalogue(names, entries)


@query("document_types_by_table", f"WITH {_TYPED_SQL} SELECT doc_id, {_DOC_TYPE} AS doc_type FROM t")
def document_types_by_table(spark, sf):
    """The ordered rules come from a table instead of the library's list."""
    table_ = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(fv.DOC_TYPE_RULES)],
                                   "ord int, name string, pattern string")
    rows = table(spark, sf, "documents").selectExpr(*_TYPED)
    return rows.select("doc_id", rules.document_type(F.col("text"), rules.rules_of(table_)).alias("doc_type"))


@query("compacted_history", f"""WITH {_SAVED}
SELECT case_id AS owner, id, true AS compacted FROM h WHERE case_id % 5 <> 0""")
def compacted_history(spark, sf):
    """History after deletes, from a table whose parts were compacted; they hold no row twice."""
    path = shared_dir(spark, "history-parts")
    saved = hi.profile_json(_profiles(spark, sf)).select(
        F.col("case_id").alias("owner"), "id", "json", F.lit(0).alias("op_seq"), F.lit(False).alias("deleted"))
    tb.append_parted(saved, path, ["owner", "id"])
    tb.append_parted(saved.where("owner % 5 = 0").select(
        "owner", "id", F.lit(None).cast("string").alias("json"), F.lit(1).alias("op_seq"),
        F.lit(True).alias("deleted")), path, ["owner", "id"])
    tb.compact(spark, path, ["owner", "id"], "op_seq", gone="deleted")
    return spark.read.parquet(path).groupBy("owner", "id").agg(
        (F.count(F.lit(1)) == 1).alias("compacted"), F.bool_or("deleted").alias("deleted")).where(
        "NOT deleted").select("owner", "id", "compacted")
