"""Site-relative line deduplication, in DataFrame functions only.

A line is boilerplate of its host when it stands on a larger share of the host's pages than the
given ratio. Pages with the same text count once, so a page that was copied many times does not
turn its own lines into boilerplate.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, packed, unpacked, written

MAX_RATIO, MIN_PAGES = 0.005, 3
_SPACES = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """Host of a URL in small letters; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)),
                    F.lit(""))


def line_key(line: Column) -> Column:
    """What makes lines equal: the line without white space at its ends."""
    return F.btrim(line, F.lit(_SPACES))


def _hashes(value: Column, name: str) -> list:
    return [mix64(value, seed=1).alias(f"{name}1"), mix64(value, seed=2).alias(f"{name}2")]


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """`host, n_pages, first1, lines`: hashes of each host's boilerplate lines.

    A line counts from `min_pages` distinct pages on. A host has at most (mean lines of its pages /
    `max_ratio`) such lines, whatever its number of pages. Lines, pages and hosts meet as 128-bit
    hashes; texts are not shuffled. Both counts are combined before they are shuffled, so neither a
    line on every page nor a host with most pages fills one task.
    """
    pages = docs.select(host.alias("host"), text.alias("text"))
    pages = pages.select("host", *_hashes(F.col("text"), "p"), F.explode(
        F.split("text", "\n", -1)).alias("line"))
    lines = pages.select("host", "p1", "p2", line_key(F.col("line")).alias("line")).where(
        "line <> ''")
    seen = lines.select("host", "p1", "p2", *_hashes(F.col("line"), "l")).distinct()
    counts = seen.groupBy("host", "l1", "l2").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.where(F.col("n") >= min_pages), "line_counts")
    totals = docs.select(host.alias("host"), *_hashes(text, "p")).distinct().groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"))
    totals = written(totals, "host_totals")
    often = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    often = often.where(F.col("n") > max_ratio * F.col("n_pages"))
    return written(often.groupBy("c.host").agg(
        F.collect_list("l1").alias("first1"),
        F.collect_list(F.struct("l1", "l2")).alias("lines")), "boilerplate")


def _kept(line: Column) -> Column:
    """Whether a line stays; the second hash is looked up only where the first one is known."""
    key = line_key(line)
    known = F.array_contains(F.col("b.first1"), mix64(key, seed=1)) & F.array_contains(
        F.col("b.lines"), F.struct(*_hashes(key, "l")))
    return (key == "") | ~known


def strip_boilerplate(docs: DataFrame, host: Column, text_col: str = "text",
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`row, old, lines, kept`: the input row, its lines, and those that stay (null for no text).

    Hosts are spread by the runtime: the table of boilerplate lines is broadcast while small, else
    both sides are plain tables whose hot hosts the join splits.
    """
    rows = packed(docs, host.alias("host"), F.col(f"`{text_col}`").alias("text"))
    found = boilerplate(rows, F.col("host"), F.col("text"), max_ratio, min_pages)
    joined = rows.alias("d").join(found.alias("b"), F.col("d.host").eqNullSafe(F.col("b.host")),
                                  "left")
    lines = F.split("d.text", "\n", -1)
    kept = F.when(F.col("b.lines").isNull(), lines).otherwise(F.filter(lines, _kept))
    return joined.select("d.row", F.col("d.text").alias("old"), lines.alias("lines"),
                         kept.alias("kept"))


def line_report(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text",
                max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`doc_id, n_lines, n_dropped, n_chars, text` of every row.

    A null text has no lines and stays null; blank lines always stay; a text that is all
    boilerplate becomes empty. Rows with a null host form one host. Repeated rows each give a row
    (their text counts as one page), an empty table none; further columns are ignored.
    """
    cut = strip_boilerplate(docs, host, text_col, max_ratio, min_pages)
    size = F.coalesce(F.size("lines"), F.lit(0))
    text = F.when(F.size("kept") == F.size("lines"), F.col("old")).otherwise(
        F.array_join("kept", "\n"))
    return cut.select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        F.when(F.col("old").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        F.when(F.col("old").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast(
            "long").alias("n_dropped"),
        F.length(text).cast("long").alias("n_chars"), text.alias("text"))


def drop_boilerplate(docs: DataFrame, host: Column, text_col: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of `docs` without boilerplate lines; a column `n_chars` follows the text."""
    cut = strip_boilerplate(docs, host, text_col, max_ratio, min_pages)
    same = F.size("kept") == F.size("lines")
    text = F.when(F.col("old").isNull() | same, F.col("old")).otherwise(F.array_join("kept", "\n"))
    new = {text_col: text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("old").isNull() | same, F.col("row.n_chars")).otherwise(
            F.length(text)).cast(kind)
    return unpacked(cut, docs.columns, **new)


def report_sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """The report over `documents` with `source` as host, its text as MD5."""
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
split AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
cleaned AS (SELECT r, source, text, line, i,
                   trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM split),
counts AS (SELECT source, key, count(DISTINCT text) AS n FROM cleaned WHERE key <> '' GROUP BY 1, 2),
totals AS (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END)
                  AS n_pages FROM docs GROUP BY 1),
bad AS (SELECT c.source, c.key FROM counts c JOIN totals t
        ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.n >= {min_pages} AND c.n > CAST({max_ratio} AS DOUBLE) * t.n_pages),
marked AS (SELECT l.*, b.key IS NOT NULL AS dropped FROM cleaned l LEFT JOIN bad b
           ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key),
cut AS (SELECT r, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text
        FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped,
       CAST(length(c.text) AS BIGINT) AS n_chars, md5(c.text) AS text_md5
FROM docs d LEFT JOIN cut c ON d.r = c.r
"""
