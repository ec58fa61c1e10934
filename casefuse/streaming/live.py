"""The same operators on streams, on Spark's own state store.

Feeds that need an order inside a case keep their state per case with `transformWithStateInPandas`;
tallies are a streaming aggregation. A feed's output is an append-only log with one folder per epoch,
which a retried epoch overwrites; where rows replace earlier ones, the newest epoch counts. A task
holds the rows that one micro-batch has for one case, so the source's trigger options
(`maxFilesPerTrigger`, `maxBytesPerTrigger`) bound its memory. Rows whose `seq` is not above the last
one seen for their case change nothing and go to an output of their own.
"""

import json
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from casefuse import fixed_values as fv
from casefuse.operators import ordered
from casefuse.session import importable
from casefuse.sources.tables import latest

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FEED = "case_id long, seq long, snapshot string, why string"
FIELDS = "case_id long, field string, value string, state string, origin string, present boolean"
EDIT_FEED = f"{FIELDS}, seq long, why string"
TALLIES = "case_id long, field string, value string, engines array<string>, first_seq long"


def _save(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def newest(spark: SparkSession, path: str, schema: str, keys: list) -> DataFrame:
    """Rows of the newest epoch per key of a log written epoch by epoch."""
    log = spark.read.schema(f"{schema}, epoch long").parquet(path)
    return latest(log, keys, "epoch").drop("epoch")


def _start(rows: DataFrame, handler, checkpoint: str, trigger, mode: str) -> StreamingQuery:
    """Start with the RocksDB store; the session's own choice is restored once the query has it."""
    conf = importable(rows.sparkSession).conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, ROCKS_DB)
    try:
        writer = rows.writeStream.outputMode(mode).foreachBatch(handler)
        return writer.option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def changed_rows(snapshots: DataFrame, rows: int = ordered.ROWS) -> DataFrame:
    """Rows `(case_id, seq, snapshot)` that differ from the row before in their case."""
    seen = ordered.neighbour(snapshots, ["case_id"], "seq", F.col("snapshot"), "prev", rows=rows)
    same = F.col("prev").isNotNull() & F.col("prev.v").eqNullSafe(F.col("snapshot"))
    return seen.where(~same).drop("prev")


@lru_cache
def _row_class(columns: tuple) -> type:
    return namedtuple("Row", columns, rename=True)


def _frame(rows: list, columns: list) -> pd.DataFrame:
    """A few rows of plain objects; Spark gives the columns their types."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def in_order(frames: Iterator[pd.DataFrame], last: int | None) -> tuple[list, list]:
    """(rows above all before them, the others with `why`) of one case in one micro-batch.

    `why` tells a row that repeats the last number from one that came after a later number.
    """
    fresh, late, rows = [], [], []
    for f in frames:
        # Most cases have few rows: a class of rows a frame, as `itertuples` makes, costs more than they.
        make = _row_class(tuple(f.columns))._make
        rows += map(make, zip(*[f[c].tolist() for c in f.columns]))
    for r in sorted(rows, key=attrgetter("seq")):
        if last is not None and r.seq <= last:
            late.append((r, "repeated" if r.seq == last else "late"))
        else:
            fresh.append(r)
            last = r.seq
    return fresh, late


class ChangeFeed(StatefulProcessor):
    """Keeps each case's last snapshot."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, snapshot string")

    def handleInputRows(self, key, rows, timers):
        seen = self.last.get()
        seq, snapshot = seen or (None, None)
        fresh, late = in_order(rows, seq)
        out = [(key[0], r.seq, r.snapshot, why) for r, why in late]
        for r in fresh:
            if seq is None or r.snapshot != snapshot:
                out.append((key[0], r.seq, r.snapshot, None))
            seq, snapshot = r.seq, r.snapshot
        if fresh:
            self.last.update((int(seq), snapshot))
        if out:
            yield _frame(out, ["case_id", "seq", "snapshot", "why"])

    def close(self) -> None:
        pass


def start_change_feed(stream: DataFrame, out: str, state: str, checkpoint: str,
                      trigger=None) -> StreamingQuery:
    """Write to `out/epoch=n` each snapshot that differs from the one before in its case.

    Rows that come too late are in `state/late/epoch=n`.
    """
    feed = stream.select("case_id", "seq", "snapshot").groupBy("case_id").transformWithStateInPandas(
        ChangeFeed(), FEED, "Append", "None")

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        _save(batch.where("why IS NULL").drop("why"), out, epoch)
        _save(batch.where("why IS NOT NULL"), f"{state}/late", epoch)
        batch.unpersist()

    return _start(feed, handle, checkpoint, trigger, "append")


def apply_edit(cells: dict, stack: list, edit, depth: int) -> set:
    """Apply one edit to a case's cells (value, state, origin) and undo stack; the fields it touches.

    The stack holds what each of the last `depth` edits replaced (None: nothing).
    """
    if edit.action == "undo":
        replaced = stack.pop() if stack else {}
        for field, old in replaced.items():
            if old is None:
                cells.pop(field, None)
            else:
                cells[field] = old
        return set(replaced)
    new = {edit.field: edit.value}
    if edit.action == "choose":
        new.update(edit.linked or {})
    stack.append({field: cells.get(field) for field in new})
    del stack[:-depth]
    filled = edit.action == "choose" or (
        edit.action == "set" and edit.value is not None and edit.value.strip() != "")
    for field, value in new.items():
        origin = cells[field][2] if field in cells else None
        if edit.action in ("choose", "dismiss"):
            origin = edit.origin if edit.action == "choose" else None
        cells[field] = [value if filled else None, "USER" if filled else "EMPTY", origin]
    return set(new)


class EditReplay(StatefulProcessor):
    """Keeps each case's fields, the last number seen and what the last edits replaced."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle) -> None:
        self.case = handle.getValueState("case", "seq long, cells string, stack string")

    def handleInputRows(self, key, rows, timers):
        seen = self.case.get()
        last, cells, stack = (seen[0], json.loads(seen[1]), json.loads(seen[2])) if seen else (
            None, {}, [])
        fresh, late = in_order(rows, last)
        touched = set()
        for edit in fresh:
            touched |= apply_edit(cells, stack, edit, self.depth)
        if fresh:
            self.case.update((int(fresh[-1].seq), json.dumps(cells), json.dumps(stack)))
        out = [(key[0], f, *(cells.get(f) or (None, None, None)), f in cells, None, None)
               for f in sorted(touched)]
        out += [(key[0], r.field, r.value, None, r.origin, False, r.seq, why) for r, why in late]
        if out:
            yield _frame(out, ["case_id", "field", "value", "state", "origin", "present", "seq", "why"])

    def close(self) -> None:
        pass


def start_edit_replay(stream: DataFrame, state: str, checkpoint: str, trigger=None,
                      depth: int = fv.UNDO_DEPTH) -> StreamingQuery:
    """Keep every case's fields up to date from a stream of edits.

    `state/fields/epoch=n` holds the fields that an epoch touched (see `current_fields`), rows that
    come too late are in `state/late/epoch=n`. State per case: its fields, and what the last `depth`
    edits replaced.
    """
    linked = F.map_filter("linked", lambda k, v: k.isNotNull())
    edits = stream.select("case_id", "seq", "action", "field", "value", linked.alias("linked"), "origin")
    feed = edits.groupBy("case_id").transformWithStateInPandas(
        EditReplay(depth), EDIT_FEED, "Append", "None")

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        _save(batch.where("why IS NULL").drop("seq", "why"), f"{state}/fields", epoch)
        _save(batch.where("why IS NOT NULL").select("case_id", "seq", "field", "value", "origin", "why"),
              f"{state}/late", epoch)
        batch.unpersist()

    return _start(feed, handle, checkpoint, trigger, "append")


def current_fields(spark: SparkSession, state: str) -> DataFrame:
    """What the user sees after the last epoch: the fields that are there."""
    return newest(spark, f"{state}/fields", FIELDS, ["case_id", "field"]).where("present").drop("present")


def start_live_votes(stream: DataFrame, state: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Running votes per (case, field, value); `state/epoch=n` holds the tallies an epoch changed.

    Votes are dealt by case, field and value, so a hot case fills many tasks; `current_votes` gives
    the newest tallies.
    """
    tally = stream.groupBy("case_id", "field", "value").agg(
        F.array_sort(F.collect_set("engine")).alias("engines"), F.min("seq").alias("first_seq"))
    return _start(tally, lambda batch, epoch: _save(batch, state, epoch), checkpoint, trigger, "update")


def current_votes(spark: SparkSession, state: str) -> DataFrame:
    """The newest tally of every (case, field, value)."""
    return newest(spark, state, TALLIES, ["case_id", "field", "value"])
