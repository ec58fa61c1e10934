"""Replay of an edit log with bounded undo, without a per-case state machine.

Undo pops the newest edit that is still open, and an edit leaves the stack for good once `depth`
newer ones lie on it. Let the level of an edit be the stack height right after it, were the stack
unbounded. At one level, an edit is followed either by the undo that pops it, or by an edit that
reaches `depth` levels higher (from then on it can no longer be undone), or by nothing (it is
still open). So the running height and one look at the next row per (case, level) settle every
edit, and both are computed range by range, along the same cuts of a case.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import is_blank
from casefuse.operators import ordered

SET, CLEAR, CHOOSE, DISMISS, UNDO = "set", "clear", "choose", "dismiss", "undo"
EDIT_COLUMNS = ["case_id", "seq", "action", "field", "value", "linked", "origin"]


def settle_edits(edits: DataFrame, depth: int = fv.UNDO_DEPTH,
                 rows: int = ordered.ROWS) -> DataFrame:
    """Add `fate` to every edit: `undone`, `open` (may still be undone) or `final`."""
    is_undo = F.col("action") == UNDO
    cut = (["case_id"], ordered.cut_points(edits, ["case_id"], F.col("seq"), rows))
    heights = ordered.running_height(edits, ["case_id"], "seq", F.when(is_undo, -1).otherwise(1),
                                     "height", cut=cut)
    height = F.col("height")
    marks = F.when(is_undo, F.array(F.struct((height + 1).alias("level"), F.lit("undo").alias("kind")))) \
        .when(height > depth, F.array(
            F.struct(height.alias("level"), F.lit("edit").alias("kind")),
            F.struct((height - depth).alias("level"), F.lit("buried").alias("kind")))) \
        .otherwise(F.array(F.struct(height.alias("level"), F.lit("edit").alias("kind"))))
    marked = heights.withColumn("m", F.explode(marks)).select(
        *edits.columns, F.col("m.level").alias("level"), F.col("m.kind").alias("kind"))
    marked = ordered.neighbour(marked, ["case_id", "level"], "seq", F.col("kind"), "next",
                               following=True, cut=cut)
    fate = (F.when(F.col("next").isNull(), "open").when(F.col("next.v") == "undo", "undone")
            .otherwise("final"))
    return marked.where(F.col("kind") == "edit").withColumn("fate", fate).select(
        *edits.columns, "fate")


def field_changes(edits: DataFrame) -> DataFrame:
    """Each edit as one row per field it touches; a chosen candidate brings its linked fields."""
    own = F.array(F.struct(F.col("field").alias("field"), F.col("value").alias("value")))
    linked = F.coalesce(F.transform(F.map_entries("linked"), lambda e: F.struct(
        e["key"].alias("field"), e["value"].alias("value"))), F.array().cast(
        "array<struct<field:string,value:string>>"))
    touched = F.when(F.col("action") == CHOOSE, F.concat(own, linked)).otherwise(own)
    rows = edits.select("case_id", "seq", "action", "origin", F.posexplode(touched).alias("pos", "t"))
    emptied = F.col("action").isin(CLEAR, DISMISS) | (
        (F.col("action") == SET) & is_blank(F.col("t.value")))
    return rows.select(
        "case_id", "seq", "pos", F.col("t.field").alias("field"),
        F.when(~emptied, F.col("t.value")).alias("value"),
        F.when(emptied, "EMPTY").otherwise("USER").alias("state"),
        F.col("action").isin(CHOOSE, DISMISS).alias("sets_origin"),
        F.when(F.col("action") == CHOOSE, F.col("origin")).alias("origin"))


def latest_fields(changes: DataFrame) -> DataFrame:
    """Last value and state of each field, and the origin last set for it."""
    at = F.struct("seq", "pos")
    last = F.max_by(F.struct("value", "state"), at).alias("last")
    origin = F.max_by(F.struct("origin"), F.when(F.col("sets_origin"), at)).alias("from")
    seqs = F.max("seq").alias("seq")
    origin_seq = F.max(F.when(F.col("sets_origin"), F.col("seq"))).alias("origin_seq")
    return changes.groupBy("case_id", "field").agg(last, origin, seqs, origin_seq).select(
        "case_id", "field", "last.value", "last.state", "from.origin", "seq", "origin_seq")


def as_changes(fields: DataFrame) -> DataFrame:
    """Field values that hold before the first edit, in the shape of changes."""
    seq = F.col("seq") if "seq" in fields.columns else F.lit(-1).cast("long")
    return fields.select("case_id", seq.alias("seq"), F.lit(0).alias("pos"), "field", "value",
                         "state", F.lit(True).alias("sets_origin"), "origin")


def replay_edits(edits: DataFrame, initial: DataFrame = None, depth: int = fv.UNDO_DEPTH,
                 rows: int = ordered.ROWS) -> DataFrame:
    """Field values, states and origins after the whole log.

    `edits(case_id, seq, action, field, value, linked, origin)` with unique non-negative `seq`
    per case; `initial(case_id, field, value, state, origin)` is what was there before.
    """
    settled = settle_edits(edits, depth, rows).where(F.col("fate") != "undone")
    changes = field_changes(settled)
    if initial is not None:
        changes = changes.unionByName(as_changes(initial))
    return latest_fields(changes).drop("seq", "origin_seq")


def last_edits(edits: DataFrame) -> DataFrame:
    """Field values after a log without undo: the last edit of each field."""
    return latest_fields(field_changes(edits)).drop("seq", "origin_seq")
