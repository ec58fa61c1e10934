"""Column-quality audit over `(case_id, field, value)`."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.checks import check_value
from casefuse.functions.text import field_kind, is_blank, section_of


def _block(field):
    return F.when(field.endswith(fv.SECOND_BLOCK_SUFFIX), fv.SECOND_BLOCK_SUFFIX).otherwise("")


def audit_fields(values: DataFrame, types: DataFrame) -> DataFrame:
    """Check every value with the rule of its field.

    Only postcodes need a sibling, the province of their block, so only they (by whatever name the
    rules know them) take part in the sibling join. `types(case_id, tipo)` is the identification type of a case. Adds `ok` (null
    when no rule applies) and `message`.
    """
    field = F.col("field")
    kind = field_kind(field)
    is_code, is_holder = kind == "postcode", kind == "holder_id"
    provinces = values.where(field.isin("Provincia", "Provincia" + fv.SECOND_BLOCK_SUFFIX)).select(
        "case_id", _block(field).alias("block"), F.col("value").alias("province"))
    codes = values.where(is_code).withColumn("block", _block(field)).join(
        provinces, ["case_id", "block"], "left").select(
        "case_id", "field", "value", "province", F.lit(None).cast("string").alias("tipo"))
    ids = values.where(is_holder).join(types.select("case_id", "tipo"), "case_id", "left").select(
        "case_id", "field", "value", F.lit(None).cast("string").alias("province"), "tipo")
    rest = values.where(~is_code & ~is_holder).select(
        "case_id", "field", "value", F.lit(None).cast("string").alias("province"),
        F.lit(None).cast("string").alias("tipo"))
    rows = codes.unionByName(ids).unionByName(rest)
    result = check_value(F.col("field"), F.col("value"), F.col("tipo"), F.col("province"))
    return rows.withColumn("r", result).select("case_id", "field", "value", "r.ok", "r.message")


def pass_rates(audited: DataFrame) -> DataFrame:
    """Checked, passed and failed values per field."""
    return audited.groupBy("field").agg(
        F.count("ok").alias("n_checked"), F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"))


def field_ok(audited: DataFrame) -> DataFrame:
    """A field counts as done when it has a value that no rule rejects."""
    return audited.withColumn("field_ok", ~is_blank(F.col("value")) & F.coalesce("ok", F.lit(True)))


def section_progress(audited: DataFrame) -> DataFrame:
    """Done fields of every section per case; complete when all fields of the section are done."""
    sizes = {}
    for _, _, section, _ in fv.FIELD_CATALOG:
        if section:
            sizes[section] = sizes.get(section, 0) + 1
    done = field_ok(audited).withColumn("section", section_of(F.col("field")))
    counts = done.groupBy("case_id").agg(*[
        F.count_if(F.col("field_ok") & (F.col("section") == s)).alias(f"n{i}")
        for i, s in enumerate(sizes)])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"n{i}").alias("n_done"),
                              F.lit(n).alias("n_fields"), (F.col(f"n{i}") == n).alias("complete"))
                     for i, (s, n) in enumerate(sizes.items())])
    return counts.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")


def case_progress(audited: DataFrame) -> DataFrame:
    """Done fields per case out of the whole catalogue."""
    done = field_ok(audited).where(F.col("field").isin(*[row[0] for row in fv.FIELD_CATALOG]))
    return done.groupBy("case_id").agg(F.count_if("field_ok").alias("n_done")).withColumn(
        "n_total", F.lit(len(fv.FIELD_CATALOG)))


def pass_rates_by_level(audited: DataFrame) -> DataFrame:
    """Checked, passed and failed values per field, per section and of all, in one pass.

    `level` tells the three apart (a field without a section has a null one); rows are expanded once
    and combined before the shuffle, instead of one job a level.
    """
    rows = audited.withColumn("section", section_of(F.col("field")))
    sets = rows.groupingSets([["section", "field"], ["section"], []], "section", "field").agg(
        F.grouping_id("section", "field").alias("_g"), F.count("ok").alias("n_checked"),
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    level = F.when(F.col("_g") == 0, "field").when(F.col("_g") == 1, "section").otherwise("all")
    return sets.select(level.alias("level"), "section", "field", "n_checked", "n_ok", "n_failed")


def state_cube(decisions: DataFrame) -> DataFrame:
    """Number of fields per section and state, per section, per state and of all (`level` 0 to 3).

    Sections come from the catalogue, so each has a column of its own: fields are counted once per
    case and state, these rows per case, and cases are rows with a count. No row is repeated for a
    level and no distinct cases are looked for.
    """
    sections = [*dict.fromkeys(row[2] for row in fv.FIELD_CATALOG if row[2]), None]
    names = [f"n{i}" for i in range(len(sections))]
    held = decisions.select("case_id", "state", section_of(F.col("field")).alias("section")).groupBy(
        "case_id", "state").agg(*[F.count_if(F.col("section").eqNullSafe(F.lit(s))).alias(n)
                                  for s, n in zip(sections, names)])
    cases = held.groupBy("case_id").agg(*[F.sum(n).alias(n) for n in names])

    def levels(rows: DataFrame, level: int, *by) -> DataFrame:
        """The level of single sections, and of all of them (two above)."""
        def cell(at, section, n):
            return F.struct(F.lit(at).alias("level"), F.lit(section).cast("string").alias("section"),
                            F.sum(n).alias("n_fields"),
                            F.count_if((n > 0) & F.col("case_id").isNotNull()).alias("n_cases"))

        cells = [cell(level, s, F.col(n)) for s, n in zip(sections, names)]
        cells.append(cell(level + 2, None, reduce(lambda a, b: a + b, map(F.col, names))))
        return rows.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.explode("cells").alias("c"))

    every = levels(held, 0, "state").unionByName(levels(cases, 1), allowMissingColumns=True)
    return every.where("c.n_fields > 0").select(
        F.col("c.level").cast("long").alias("level"), "c.section", "state", "c.n_fields", "c.n_cases")
