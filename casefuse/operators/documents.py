"""Document intake: names, types, batches and first pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import is_blank, nonblank
from casefuse.operators import ordered


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row per (case_id, uri): its first appearance, with the other columns of that row."""
    rest = [c for c in docs.columns if c not in ("case_id", "uri")]
    first = F.min_by(F.struct(*rest), "seq").alias("first")
    return docs.groupBy("case_id", "uri").agg(first).select("case_id", "uri", "first.*")


def last_segment(uri: Column) -> Column:
    """Text after the last slash."""
    return F.element_at(F.split(uri, "/"), -1)


def mime_type(supplied: Column, uri: Column) -> Column:
    """The supplied MIME type unless it says nothing, else the one of the extension."""
    name = F.lower(last_segment(uri))
    ext = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    table = F.create_map(*[F.lit(x) for pair in fv.MIME_BY_EXTENSION.items() for x in pair])
    trusted = F.when(~is_blank(supplied) & (supplied != fv.DEFAULT_MIME), supplied)
    return F.coalesce(trusted, F.try_element_at(table, ext), F.lit(fv.DEFAULT_MIME))


def display_name(uri: Column, reported: Column = None) -> Column:
    """Reported name, else the last path segment without a copy's time prefix."""
    own = F.regexp_replace(last_segment(uri), r"^\d{10,}_", "")
    known = [nonblank(reported)] if reported is not None else []
    return F.coalesce(*known, own, F.lit(fv.DEFAULT_NAME))


def stored_name(name: Column, copied_at: Column) -> Column:
    """Collision-free file name of a private copy."""
    safe = F.regexp_replace(F.substring(name, 1, 80), r"[^A-Za-z0-9._-]", "_")
    return F.concat_ws("_", F.unix_millis(copied_at).cast("string"), safe)


def copy_manifest(docs: DataFrame, folder: str) -> DataFrame:
    """Target of each document's private copy; one already below `folder` keeps its place."""
    owned = F.col("uri").startswith(f"file://{folder.rstrip('/')}/")
    target = F.concat(F.lit(f"file://{folder.rstrip('/')}/"),
                      stored_name(display_name(F.col("uri")), F.col("copied_at")))
    return docs.withColumns({"already_owned": owned,
                             "target_uri": F.when(owned, F.col("uri")).otherwise(target)})


def readable_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents that yielded at least one page.

    Pages are reduced to one row per document on the map side, so a document of very many pages
    does not fill one task of the join.
    """
    seen = pages.select("case_id", "doc_id").distinct()
    return docs.join(seen, ["case_id", "doc_id"], "left_semi")


def unreadable_cases(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One error row per case none of whose documents yielded a page.

    One map-side combined aggregate over both inputs, so a hot case is no hot task.
    """
    rows = docs.select("case_id", F.lit(True).alias("known"), F.lit(False).alias("read")).unionByName(
        pages.select("case_id", F.lit(False).alias("known"), F.lit(True).alias("read")))
    cases = rows.groupBy("case_id").agg(F.bool_or("known").alias("known"), F.bool_or("read").alias("read"))
    return cases.where(F.col("known") & ~F.col("read")).select(
        "case_id", F.lit(fv.NO_DOCUMENTS_ERROR).alias("error"))


def document_ordinals(docs: DataFrame, order: str, seq: Column = None,
                      rows: int = ordered.ROWS) -> DataFrame:
    """`case_id, doc_id, ordinal`: the place of each document in its case, from 1.

    `docs(case_id, doc_id, <order>)` may repeat a document; its first appearance counts. `seq`
    is a whole number that agrees with the order, by default the order itself.
    """
    first = docs.groupBy("case_id", "doc_id").agg(F.min(order).alias("first"))
    seq = F.col("first") if seq is None else seq
    return ordered.row_number(first, ["case_id"], ["first", "doc_id"], seq, "ordinal",
                              rows=rows).select(
        "case_id", "doc_id", "ordinal")


def page_batches(pages: DataFrame, name: Column, max_pages: int = fv.MAX_PAGES_PER_CALL,
                 rows: int = ordered.ROWS, ordinal: Column = None) -> DataFrame:
    """Batch number (from 1) and call label of every page; a label counts parts only if several.

    A document without a name is called by its `ordinal` in the case, where that is given.
    """
    numbered = ordered.row_number(
        pages, ["case_id", "doc_id"], ["page_no"], F.col("page_no"), "page_ord", "n_pages",
        rows=rows)
    size = F.lit(max_pages)
    numbered = numbered.withColumns({
        "batch_no": (F.floor((F.col("page_ord") - 1) / size) + 1),
        "n_batches": F.ceil(F.col("n_pages") / size)})
    unnamed = F.lit(fv.DEFAULT_NAME) if ordinal is None else F.concat_ws(
        " ", F.lit(fv.DEFAULT_NAME), ordinal)
    base = F.coalesce(nonblank(name), unnamed)
    label = F.when(F.col("n_batches") == 1, base).otherwise(
        F.format_string(fv.BATCH_LABEL, base, F.col("batch_no"), F.col("n_batches")))
    return numbered.withColumn("label", label)


def limited_pages(batches: DataFrame, engines, single_page=fv.SINGLE_PAGE_ENGINES,
                  max_pages: int = fv.MAX_PAGES_PER_CALL) -> DataFrame:
    """One row per page and engine that receives it: single-page engines get a batch's first page.

    A page's place in its batch follows from `page_ord`, so no further window is needed.
    """
    first_in_batch = (F.col("page_ord") - 1) % max_pages == 0
    sent = F.when(first_in_batch, F.array(*map(F.lit, engines))).otherwise(
        F.array(*[F.lit(e) for e in engines if e not in single_page]))
    return batches.withColumn("engine", F.explode(sent))


def first_pages_text(pages: DataFrame, max_pages: int = 2) -> DataFrame:
    """Text of the first pages of each document (`page_no` from 0), null when blank."""
    first = pages.where(F.col("page_no") < max_pages).groupBy("case_id", "doc_id")
    in_order = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = F.array_join(F.transform(in_order, lambda p: p["text"]), "\n")
    return first.agg(joined.alias("joined")).select(
        "case_id", "doc_id", nonblank(F.col("joined")).alias("text"))


def fill_in_types(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Local type of each document, else the first type an engine reported for it.

    `docs(case_id, name, local_type)`, `replies(case_id, label, seq, doc_type)`; a part suffix
    in the label is ignored.
    """
    base = F.trim(F.element_at(F.split(F.col("label"), r" \(parte "), 1))
    told = (replies.where(~is_blank(F.col("doc_type"))).groupBy("case_id", base.alias("name"))
            .agg(F.min_by(F.trim("doc_type"), "seq").alias("reported")))
    known = F.when(F.col("local_type") != fv.DEFAULT_DOC_TYPE, nonblank(F.col("local_type")))
    return docs.join(told, ["case_id", "name"], "left").withColumn(
        "doc_type", F.coalesce(known, "reported", F.lit(fv.DEFAULT_DOC_TYPE))).drop("reported")


def unreachable_documents(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored documents whose URI is no longer in the listing."""
    return stored.join(listing.select("uri"), "uri", "left_anti")


def restore_warnings(stored: DataFrame, listing: DataFrame, width: int = 120) -> DataFrame:
    """One line per case naming its unreachable documents, `width` characters of names at most.

    Every name after the first adds two characters, so `width // 2 + 1` names settle the line
    exactly; the limit below runs on the map side before the shuffle.
    """
    order = Window.partitionBy("case_id").orderBy("seq")
    lost = (unreachable_documents(stored, listing)
            .withColumn("name", last_segment(F.col("uri")))
            .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= width // 2 + 1))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])
    return lost.groupBy("case_id").agg(F.array_join(names, ", ").alias("names")).select(
        "case_id", F.substring("names", 1, width).alias("names"))
