"""Document intake."""

from pyspark.sql import functions as F

from bindings.common import query, table
from casefuse import fixed_values as fv
from casefuse.operators import documents as docs
from casefuse.operators import ordered
from casefuse.plans.sessions import restore_sessions

_INTAKE = ["o_custkey as case_id", "'content://doc/' || (o_orderkey % 5) as uri", "o_orderkey as seq"]


@query("document_intake", f"""
SELECT case_id, uri, min(seq) AS seq FROM (SELECT {', '.join(_INTAKE)} FROM orders) GROUP BY ALL""")
def document_intake(spark, sf):
    return docs.distinct_documents(table(spark, sf, "orders").selectExpr(*_INTAKE))


_FILES = ["doc_id", "'content://store/' || source || '/' || case when doc_id % 4 = 0 then (1700000000000 + doc_id) || '_' else '' end"
          " || 'Doc ' || doc_id || case doc_id % 7 when 0 then '.PDF' when 1 then '.jpeg' when 2 then '.x.heif' when 3 then '' "
          "when 4 then '.unknown' when 5 then '.Png' else '.webp' end as uri",
          "case doc_id % 5 when 0 then 'application/octet-stream' when 1 then ' ' when 2 then 'text/plain' else null end as mime",
          "case when doc_id % 6 = 0 then 'Real ' || doc_id when doc_id % 6 = 1 then ' ' end as reported"]
_FILES_SQL = f"f AS (SELECT {', '.join(_FILES)} FROM documents)"
_SEG = "split_part(uri, '/', -1)"
_EXT = f"CASE WHEN contains({_SEG}, '.') THEN lower(split_part({_SEG}, '.', -1)) ELSE '' END"
_MIMES = "CASE " + _EXT + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.MIME_BY_EXTENSION.items()) + " ELSE 'application/octet-stream' END"


def _files(spark, sf):
    return table(spark, sf, "documents").selectExpr(*_FILES)


@query("mime_types", f"""WITH {_FILES_SQL}
SELECT doc_id, CASE WHEN trim(coalesce(mime, '')) NOT IN ('', 'application/octet-stream') THEN mime ELSE {_MIMES} END AS mime FROM f""")
def mime_types(spark, sf):
    return _files(spark, sf).select("doc_id", docs.mime_type(F.col("mime"), F.col("uri")).alias("mime"))


_DISPLAY = f"CASE WHEN trim(coalesce(reported, '')) <> '' THEN reported ELSE regexp_replace({_SEG}, '^[0-9]{{10,}}_', '') END"


@query("display_names", f"WITH {_FILES_SQL} SELECT doc_id, {_DISPLAY} AS name FROM f")
def display_names(spark, sf):
    return _files(spark, sf).select("doc_id", docs.display_name(F.col("uri"), F.col("reported")).alias("name"))


_OWNED = "CASE WHEN doc_id % 3 = 0 THEN 'file:///app/docs/1_x' || doc_id || '.pdf' ELSE uri END"


@query("copy_manifest", f"""WITH {_FILES_SQL}, o AS (SELECT doc_id, {_OWNED} AS uri FROM f)
SELECT doc_id, doc_id % 3 = 0 AS already_owned, CASE WHEN doc_id % 3 = 0 THEN uri ELSE 'file:///app/docs/' || (1700000000000 + doc_id * 1000) || '_'
  || regexp_replace(substr(regexp_replace({_SEG}, '^[0-9]{{10,}}_', ''), 1, 80), '[^A-Za-z0-9._-]', '_', 'g') END AS target_uri FROM o""")
def copy_manifest(spark, sf):
    rows = _files(spark, sf).selectExpr("doc_id", f"{_OWNED} as uri",
                                        "timestamp_millis(1700000000000 + doc_id * 1000) as copied_at")
    return docs.copy_manifest(rows, "/app/docs").select("doc_id", "already_owned", "target_uri")


# Every turn is a page; those of every fourth conversation are of another one's document.
_PAGE_DOC = "case when conv_id % 4 = 0 then conv_id + 1 else conv_id end"
_PAGES_SQL = f"""pages_of AS (SELECT {_PAGE_DOC} AS doc_id, {_PAGE_DOC} // 2 AS case_id FROM conversations),
docs_of AS (SELECT DISTINCT conv_id // 2 AS case_id, conv_id AS doc_id FROM conversations
            UNION SELECT DISTINCT -1 - conv_id, conv_id FROM conversations WHERE conv_id % 8 = 0)"""


def _docs_pages(spark, sf):
    c = table(spark, sf, "conversations")
    pages = c.selectExpr(f"{_PAGE_DOC} as doc_id").selectExpr("doc_id div 2 as case_id", "doc_id")
    more = c.where("conv_id % 8 = 0").selectExpr("-1 - conv_id as case_id", "conv_id as doc_id")
    return c.selectExpr("conv_id div 2 as case_id", "conv_id as doc_id").unionByName(more).distinct(), pages


@query("readable_documents", f"WITH {_PAGES_SQL} SELECT case_id, doc_id FROM docs_of SEMI JOIN pages_of USING (case_id, doc_id)")
def readable_documents(spark, sf):
    return docs.readable_documents(*_docs_pages(spark, sf))


@query("unreadable_cases", f"""WITH {_PAGES_SQL}
SELECT DISTINCT case_id, 'No se pudieron leer los documentos.' AS error FROM docs_of
WHERE case_id NOT IN (SELECT case_id FROM pages_of)""")
def unreadable_cases(spark, sf):
    return docs.unreadable_cases(*_docs_pages(spark, sf))


@query("page_batches", """
WITH p AS (SELECT user_id AS doc_id, event_id AS page_no, CASE WHEN user_id % 7 = 0 THEN '' ELSE 'f' || user_id || '.pdf' END AS name,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT doc_id, page_no, coalesce(nullif(name, ''), 'documento ' || dense_rank() OVER (ORDER BY doc_id)) AS name, (rn - 1) // 20 + 1 AS batch_no, (n + 19) // 20 AS n_batches FROM p)
SELECT doc_id, page_no, batch_no, CASE WHEN n_batches = 1 THEN name ELSE name || ' (parte ' || batch_no || '/' || n_batches || ')' END AS label
FROM b""")
def page_batches(spark, sf):
    pages = table(spark, sf, "events").selectExpr("1 as case_id", "user_id as doc_id", "event_id as page_no")
    name = F.expr("case when doc_id % 7 = 0 then '' else 'f' || doc_id || '.pdf' end")
    places = docs.document_ordinals(pages.withColumn("seq", F.col("doc_id")), "seq")
    pages = ordered.lookup(pages, places, ["case_id", "doc_id"], F.col("page_no"))
    return docs.page_batches(pages, name, ordinal=F.col("ordinal")).select("doc_id", "page_no", "batch_no", "label")


@query("first_pages_text", """
SELECT conv_id AS doc_id, nullif(string_agg(text, chr(10) ORDER BY turn), '') AS text FROM conversations WHERE turn < 2 GROUP BY ALL""")
def first_pages_text(spark, sf):
    pages = table(spark, sf, "conversations").selectExpr(
        "1 as case_id", "conv_id as doc_id", "turn as page_no", "text")
    return docs.first_pages_text(pages).select("doc_id", "text")


_STORED = ["o_custkey % 100 as case_id", "'s3://in/' || o_custkey || '/' || (o_orderkey % 1000) || '.pdf' as uri",
           "o_orderkey as seq"]
_RESTORE = f"""stored AS (SELECT case_id, uri, min(seq) AS seq FROM (SELECT {', '.join(_STORED)} FROM orders) GROUP BY ALL),
listing AS (SELECT DISTINCT uri FROM (SELECT {', '.join(_STORED)} FROM orders) WHERE seq % 3 <> 0),
lost AS (SELECT * FROM stored ANTI JOIN listing USING (uri))"""


def _restore(spark, sf):
    every = table(spark, sf, "orders").selectExpr(*_STORED)
    return docs.distinct_documents(every), every.where("seq % 3 <> 0").select("uri").distinct()


@query("unreachable_documents", f"WITH {_RESTORE} SELECT case_id, uri FROM lost")
def unreachable_documents(spark, sf):
    return docs.unreachable_documents(*_restore(spark, sf)).select("case_id", "uri")


@query("restore_warnings", f"""WITH {_RESTORE}
SELECT case_id, substr(string_agg(split_part(uri, '/', -1), ', ' ORDER BY seq), 1, 120) AS names FROM lost GROUP BY ALL""")
def restore_warnings(spark, sf):
    return docs.restore_warnings(*_restore(spark, sf))


@query("restored_documents", f"WITH {_RESTORE} SELECT case_id, uri FROM stored SEMI JOIN listing USING (uri)")
def restored_documents(spark, sf):
    stored, listing = _restore(spark, sf)
    snapshots = stored.selectExpr("case_id", "seq", "0 as schema_version", "0 as step")
    return restore_sessions(snapshots, stored, listing)[1].select("case_id", "uri")
