"""Signature pages and placements from widget, text and size tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.operators import ordered


def multipage_fields(widgets: DataFrame) -> DataFrame:
    """Fields of a document with widgets on more than one page, and how many pages."""
    pages = widgets.groupBy("doc_id", "field_name").agg(F.count_distinct("page_no").alias("n_pages"))
    return pages.where(F.col("n_pages") > 1)


def multipage_pages(widgets: DataFrame) -> DataFrame:
    """Pages that carry a multi-page field."""
    on = widgets.select("doc_id", "field_name", "page_no").distinct()
    return on.join(multipage_fields(widgets), ["doc_id", "field_name"], "left_semi").select(
        "doc_id", "page_no").distinct()


def candidate_pages(pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Multi-page pages without the cover, plus the forced page of long enough documents."""
    forced = page_counts.where(F.col("n_pages") > fv.FORCED_PAGE).select(
        "doc_id", F.lit(fv.FORCED_PAGE).cast(pages.schema["page_no"].dataType).alias("page_no"))
    return pages.where(F.col("page_no") != 0).unionByName(forced).distinct()


def is_anchor(text: Column) -> Column:
    """Does a text fragment carry the signature label?"""
    up = F.upper(text)
    return up.contains(fv.ANCHOR_WORD) & ~up.contains(fv.ANCHOR_EXCLUDED)


def page_anchors(fragments: DataFrame) -> DataFrame:
    """Highest label of each page, relative to its height: `fragments(doc_id, page_no, text, y, page_height)`."""
    rel = F.least(F.greatest(F.col("y") / F.col("page_height"), F.lit(0.0)), F.lit(1.0))
    return fragments.where(is_anchor(F.col("text"))).groupBy("doc_id", "page_no").agg(
        F.min(rel).alias("anchor"))


def signature_pages(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates with a label; all candidates of a document where none has one."""
    rows = candidates.join(anchors, ["doc_id", "page_no"], "left")
    strong = rows.groupBy("doc_id").agg(F.count("anchor").alias("n_strong"))
    return ordered.lookup(rows, strong, ["doc_id"], F.col("page_no")).where(
        (F.col("n_strong") == 0) | F.col("anchor").isNotNull()).select(
        "doc_id", "page_no", "anchor")


def placements(pages: DataFrame) -> DataFrame:
    """Default box of every signature page: calibrated, else below the label, else low on the page."""
    d = fv.DEFAULT_PLACEMENT
    table = F.create_map(*[x for page, box in fv.CALIBRATED_PLACEMENTS.items() for x in (
        F.lit(page), F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", box)]))])
    fixed = F.try_element_at(table, F.col("page_no").cast("int"))
    below = F.least(F.col("anchor") + d["below_anchor"], F.lit(d["lowest"]))
    return pages.select(
        "doc_id", "page_no", F.coalesce(fixed["x"], F.lit(d["x"])).alias("x"),
        F.coalesce(fixed["y"], below, F.lit(d["y"])).alias("y"),
        F.coalesce(fixed["w"], F.lit(d["w"])).alias("w"),
        F.coalesce(fixed["h"], F.lit(d["h"])).alias("h"))


def fit_in_box(stamps: DataFrame) -> DataFrame:
    """Place a picture inside its box without distortion, y counted from the page's foot.

    `stamps(…, page_no, n_pages, x, y, w, h, page_width, page_height, aspect)`; pages outside the
    document get no stamp.
    """
    box_w, box_h = F.col("w") * F.col("page_width"), F.col("h") * F.col("page_height")
    by_height = F.col("aspect") > box_h / box_w
    width = F.when(by_height, box_h / F.col("aspect")).otherwise(box_w)
    height = F.when(by_height, box_h).otherwise(box_w * F.col("aspect"))
    inside = (F.col("page_no") >= 0) & (F.col("page_no") < F.col("n_pages"))
    return stamps.where(inside).withColumns({
        "draw_w": width, "draw_h": height,
        "draw_x": F.col("x") * F.col("page_width") - width / 2,
        "draw_y": (1 - F.col("y")) * F.col("page_height") - height / 2})


def adjust_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Signature pages after manual changes, in their order.

    `edits(doc_id, page_no, seq, action)` with `add` or `remove`; the last one of a page decides.
    Pages below 0 are passed over. The detected pages enter the same aggregate as oldest edits.
    """
    found = pages.select("doc_id", "page_no", F.lit(None).cast("long").alias("seq"),
                         F.lit("add").alias("action"))
    log = found.unionByName(edits.where(F.col("page_no") >= 0).select(
        "doc_id", F.col("page_no").cast(pages.schema["page_no"].dataType).alias("page_no"),
        F.col("seq").cast("long").alias("seq"), "action"))
    last = F.max(F.struct("seq", "action")).alias("last")  # null sequence numbers come first
    return log.groupBy("doc_id", "page_no").agg(last).where(
        F.col("last.action") == "add").select("doc_id", "page_no")


def kept_stamps(stamps: DataFrame, edits: DataFrame) -> DataFrame:
    """Stamps but those of pages that were removed; adding a page again brings none back."""
    removed = edits.where(F.col("action") == "remove").select("doc_id", "page_no").distinct()
    return stamps.join(removed, ["doc_id", "page_no"], "left_anti")


def move_stamps(stamps: DataFrame, moves: DataFrame) -> DataFrame:
    """Stamps after moves `(doc_id, page_no, seq, x, y)`: last move wins, clamped, size kept."""
    last = moves.groupBy("doc_id", "page_no").agg(F.max(F.struct("seq", "x", "y")).alias("m"))
    w, h = fv.MOVED_PLACEMENT_SIZE
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return stamps.join(last, ["doc_id", "page_no"], "full_outer").select(
        "doc_id", "page_no",
        F.coalesce(unit(F.col("m.x")), "x").alias("x"), F.coalesce(unit(F.col("m.y")), "y").alias("y"),
        F.coalesce("w", F.lit(w)).alias("w"), F.coalesce("h", F.lit(h)).alias("h"))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """STRUCT<x, y, w, h> in pixels of a box given in percent, clamped to the picture."""
    def clamp(c, low, high):
        return F.least(F.greatest(c, low), high)

    def pixels(percent, size):
        return (percent / 100 * size).cast("int")

    px = clamp(pixels(x, width), F.lit(0), width - 1)
    py = clamp(pixels(y, height), F.lit(0), height - 1)
    return F.struct(px.alias("x"), py.alias("y"),
                    clamp(pixels(w, width), F.lit(1), width - px).alias("w"),
                    clamp(pixels(h, height), F.lit(1), height - py).alias("h"))
