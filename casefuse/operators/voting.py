"""Votes, ranking and cut-offs over calls and proposals.

Order inside a case is `(seq, pos)`: the call, then the place inside its reply.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.operators import ordered



def aggregate_votes(votes: DataFrame) -> DataFrame:
    """Engines behind each value of a field, and where the value was first seen."""
    first = F.min(F.struct("seq", "pos", "doc_id")).alias("first")
    engines = F.array_sort(F.collect_set("engine")).alias("engines")
    return votes.groupBy("case_id", "field", "value").agg(engines, first).select(
        "case_id", "field", "value", "engines", F.size("engines").cast("long").alias("n_engines"),
        F.col("first.seq").alias("first_seq"), F.col("first.pos").alias("first_pos"),
        F.col("first.doc_id").alias("first_doc"))


def rank_values(voted: DataFrame, rows: int = ordered.ROWS, width: int = None) -> DataFrame:
    """Rank of each value inside its field: most engines first, then first seen.

    `width` is the older name of `rows`.
    """
    return ordered.row_number(
        voted, ["case_id", "field"], ["first_seq", "first_pos"], F.col("first_seq"), "rank",
        lead=-F.col("n_engines"), rows=width or rows)


def top_values(voted: DataFrame) -> DataFrame:
    """Best value per field, without ranking the rest."""
    best = F.min_by(F.struct("value", "engines", "n_engines"),
                    F.struct(-F.col("n_engines"), "first_seq", "first_pos")).alias("best")
    return voted.groupBy("case_id", "field").agg(best).select("case_id", "field", "best.*")


def majority_type(calls: DataFrame, tipo: str = "tipo_identificacion") -> DataFrame:
    """Most frequent type per case, the one seen first on a tie."""
    counted = calls.where(F.col(tipo).isNotNull()).groupBy("case_id", tipo).agg(
        F.count(F.lit(1)).alias("n_votes"), F.min("seq").alias("first_seq"))
    best = F.min(F.struct((-F.col("n_votes")).alias("n"), "first_seq", tipo)).alias("best")
    return counted.groupBy("case_id").agg(best).select(
        "case_id", F.col(f"best.{tipo}").alias(tipo), (-F.col("best.n")).alias("n_votes"))


def call_priority(engine: Column, order=fv.CALL_PRIORITY) -> Column:
    """Place of an engine in the fixed call order; unlisted engines come after all listed."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), engine), F.lit(0)),
                      F.lit(len(order) + 1)) - 1


def order_engines(enabled: DataFrame, order=fv.CALL_PRIORITY) -> DataFrame:
    """Call order of each case's engines: fixed priority, then the order they were given in.

    A case enables an engine once, so a group holds at most the engine registry.
    """
    ranked = enabled.groupBy("case_id", "engine").agg(F.min("ord").alias("ord")).withColumn(
        "priority", call_priority(F.col("engine"), order))
    w = Window.partitionBy("case_id").orderBy("priority", "ord")
    return ranked.withColumn("call_order", F.row_number().over(w))


def drop_dead_engines(calls: DataFrame, codes=fv.PERMANENT_FAILURE_CODES) -> DataFrame:
    """Calls up to each engine's first permanent failure, that failure included."""
    died = calls.where(F.col("http_code").isin(*codes)).groupBy("case_id", "engine").agg(
        F.min("seq").alias("died_at"))
    marked = ordered.lookup(calls, died, ["case_id", "engine"], F.col("seq"))
    return marked.where(F.col("died_at").isNull() | (F.col("seq") <= F.col("died_at"))).drop("died_at")


def coverage_point(votes: DataFrame, fields) -> DataFrame:
    """Per case, the first call after which every field has a value; only covered cases."""
    firsts = votes.where(F.col("field").isin(*fields)).groupBy("case_id", "field").agg(
        F.min("seq").alias("seq"))
    covered = firsts.groupBy("case_id").agg(F.max("seq").alias("cut_seq"),
                                            F.count(F.lit(1)).alias("n_fields"))
    return covered.where(F.col("n_fields") == len(set(fields))).select("case_id", "cut_seq")


def stop_when_covered(rows: DataFrame, cut: DataFrame, calls: DataFrame = None) -> DataFrame:
    """Rows up to the coverage point of their case, all rows where there is none."""
    marked = ordered.lookup(rows, cut, ["case_id"], F.col("seq"), source=calls)
    return marked.where(F.col("cut_seq").isNull() | (F.col("seq") <= F.col("cut_seq"))).drop("cut_seq")


def stops(parsed: DataFrame, fields=None, codes=fv.PERMANENT_FAILURE_CODES) -> DataFrame:
    """Per case `died`, the first permanent failure by engine, `cut_seq`, its coverage point, and `n`.

    Both cuts keep calls up to a place in their order. So the first call with a field's value counts
    for coverage exactly if its engine had not died before, and thin rows of digested replies decide.
    """
    fields = list(dict.fromkeys(fields or ()))
    died = F.min(F.when(F.col("http_code").isin(*codes), F.col("seq"))).alias("_died")
    firsts = [F.min(F.when(F.array_contains("votes.field", f), F.col("seq"))).alias(f"_f{i}")
              for i, f in enumerate(fields)]
    engines = parsed.groupBy("case_id", "engine").agg(died, *firsts, F.count(F.lit(1)).alias("n"))
    alive = [F.min(F.when(F.col("_died").isNull() | (F.col(f"_f{i}") <= F.col("_died")), F.col(
        f"_f{i}"))).alias(f"_f{i}") for i in range(len(fields))]
    dead = F.collect_list(F.when(F.col("_died").isNotNull(), F.struct("engine", "_died")))
    cases = engines.groupBy("case_id").agg(
        F.map_from_entries(dead).alias("died"), *alive, F.sum("n").alias("n"))
    # The latest alone would pass over fields without a value.
    reached = [F.col(f"_f{i}") for i in range(len(fields))]
    covered = reduce(lambda a, b: a & b, [c.isNotNull() for c in reached], F.lit(bool(fields)))
    last = F.array_max(F.array(*reached)) if fields else F.lit(None).cast("long")
    return cases.select("case_id", "died", F.when(covered, last).alias("cut_seq"), "n")


def before_stops(calls: DataFrame, stops: DataFrame, rows: int = ordered.ROWS) -> DataFrame:
    """Calls up to the first permanent failure of their engine and the coverage point of their case.

    Calls that were dealt by `ordered.together` (with these `rows`) stay where they are.
    """
    if "part" in calls.columns:
        marked = ordered.meet(calls, stops, ["case_id"], rows)
    else:
        marked = ordered.lookup(calls, stops.drop("n"), ["case_id"], F.col("seq"))
    end = F.try_element_at("died", F.col("engine"))
    return marked.where((F.col("cut_seq").isNull() | (F.col("seq") <= F.col("cut_seq"))) & (
        end.isNull() | (F.col("seq") <= end))).drop("died", "cut_seq")


def coverage_fields():
    """Catalogue fields that count for coverage: all but the dates."""
    return [key for key, *_ in fv.FIELD_CATALOG if key not in fv.DATE_FIELDS]


def last_status(calls: DataFrame) -> DataFrame:
    """Last failure line of each engine that failed in a case."""
    failed = calls.where(F.col("status").isNotNull()).groupBy("case_id", "engine")
    return failed.agg(F.max(F.struct("seq", "status")).alias("last")).select(
        "case_id", "engine", F.col("last.status").alias("status"))


def engines_answered(calls: DataFrame) -> DataFrame:
    """Engines that gave at least one usable reply, per case."""
    return calls.where(F.col("reply").isNotNull()).select("case_id", "engine").distinct()


def progress(calls: DataFrame, ceilings: DataFrame, rows: int = ordered.ROWS) -> DataFrame:
    """Step number of each processed call and its case's ceiling of batches x engines.

    `calls` holds the calls that ran, `ceilings(case_id, n_batches, n_engines)` the plan.
    """
    steps = ordered.row_number(calls, ["case_id"], ["seq"], F.col("seq"), "step", rows=rows)
    total = ceilings.select("case_id", (F.col("n_batches") * F.col("n_engines")).alias("total_steps"))
    return ordered.lookup(steps, total, ["case_id"], F.col("seq"))


def enabled_engines(available: DataFrame, selected: DataFrame) -> DataFrame:
    """Stored selection that is still available, per case; all available ones where none is."""
    chosen = selected.select("case_id", "engine", F.lit(True).alias("chosen")).distinct()
    marked = available.join(chosen, ["case_id", "engine"], "left")
    any_chosen = marked.groupBy("case_id").agg(F.max("chosen").alias("any_chosen"))
    return marked.join(any_chosen, "case_id").where(
        F.col("any_chosen").isNull() | F.col("chosen")).drop("chosen", "any_chosen")


def in_region(engines: DataFrame, eu_only: Column) -> DataFrame:
    """Engines a case may use: all, or those inside the EU where the case asks for it."""
    return engines.where(~eu_only | F.col("eu"))


def region_counts(engines: DataFrame) -> DataFrame:
    """Number of engines inside and outside the EU per case."""
    return engines.groupBy("case_id").agg(F.count_if("eu").alias("inside"),
                                          F.count_if(~F.col("eu")).alias("outside"))


def valid_box(w: Column, h: Column) -> Column:
    """A located box counts when it is wider than 15 % and higher than 8 %."""
    return (w > 15) & (h > 8)


def first_valid_box(boxes: DataFrame, order=fv.BOX_PRIORITY) -> DataFrame:
    """First valid box per case by engine priority; engines outside the list never count."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("engine"))
    usable = boxes.where(valid_box(F.col("w"), F.col("h")) & (place > 0))
    return usable.groupBy("case_id").agg(F.min_by(
        F.struct("engine", "x", "y", "w", "h"), place).alias("b")).select("case_id", "b.*")
