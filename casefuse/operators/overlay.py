"""Defaults, overlays and the fill plan over long tables `(case_id, field, value)`."""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import is_blank


def overlay(*layers: DataFrame) -> DataFrame:
    """Union of layers per (case_id, field); later layers win. One shuffle for all layers."""
    tagged = [layer.select("case_id", "field", "value", F.lit(i).alias("layer"))
              for i, layer in enumerate(layers)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("case_id", "field").agg(F.max_by("value", "layer").alias("value"))


def filled(values: DataFrame) -> DataFrame:
    """Rows whose value is not blank."""
    return values.where(~is_blank(F.col("value")))


def date_values(day: datetime.date) -> dict:
    """Day, month name and last digit of the year, under the three date fields."""
    parts = [str(day.day), fv.MONTH_NAMES[day.month - 1], str(day.year)[-1]]
    return dict(zip(fv.DATE_FIELDS, parts))


def constant_layer(cases: DataFrame, values: dict) -> DataFrame:
    """The same values for every case."""
    rows = [F.struct(F.lit(k).alias("field"), F.lit(v).alias("value")) for k, v in values.items()]
    return cases.select("case_id", F.explode(F.array(*rows)).alias("r")).select("case_id", "r.*")


def default_dates(values: DataFrame, cases: DataFrame, day: datetime.date) -> DataFrame:
    """Fill each case's blank date fields with the signing day."""
    return overlay(constant_layer(cases, date_values(day)), filled(values).where(
        F.col("field").isin(*fv.DATE_FIELDS))).unionByName(
        values.where(~F.col("field").isin(*fv.DATE_FIELDS)))


def drop_dates(values: DataFrame) -> DataFrame:
    """Values without the dates read from documents: the contract date is the signing day."""
    return values.where(~F.col("field").isin(*fv.DATE_FIELDS))


def default_value(values: DataFrame, cases: DataFrame, field: str, value: str) -> DataFrame:
    """Give a field a fixed value where the case has none."""
    return overlay(constant_layer(cases, {field: value}), values)


def copy_block(values: DataFrame, fields=fv.ADDRESS_FIELDS) -> DataFrame:
    """Copy the fiscal address to the second block; a blank source overwrites nothing."""
    copied = filled(values.where(F.col("field").isin(*fields))).withColumn(
        "field", F.concat("field", F.lit(fv.SECOND_BLOCK_SUFFIX)))
    return overlay(values, copied)


def checkbox_states(cases: DataFrame, tipo: str = "tipo") -> DataFrame:
    """State of the three identification boxes; none for an unknown type."""
    rows = [F.struct(F.lit(box).alias("checkbox"), F.when(F.upper(F.col(tipo)) == kind, fv.CHECKBOX_ON)
                     .otherwise(fv.CHECKBOX_OFF).alias("state"))
            for kind, box in fv.CHECKBOXES.items()]
    known = cases.where(F.upper(F.col(tipo)).isin(*fv.CHECKBOXES))
    return known.select("case_id", F.explode(F.array(*rows)).alias("r")).select("case_id", "r.*")


def rename_fields(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Name of each field on the case's own form: `mapping(case_id, canonical, real)`, else itself."""
    names = mapping.select("case_id", F.col("canonical").alias("field"), "real")
    return values.join(names, ["case_id", "field"], "left").withColumn(
        "real", F.coalesce("real", "field"))


def fill_plan(values: DataFrame, form_fields: DataFrame) -> DataFrame:
    """Mark values whose target exists on the form: `form_fields(case_id, real)`."""
    present = form_fields.select("case_id", "real", F.lit(True).alias("exists")).distinct()
    return values.join(present, ["case_id", "real"], "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False)))


def fill_report(plan: DataFrame) -> DataFrame:
    """Filled and missing counts per case, with the missing field names in order.

    A case holds a field once, so the list is bounded by the form's own vocabulary.
    """
    missing = F.when(~F.col("exists"), F.col("field"))
    return plan.groupBy("case_id").agg(
        F.count_if("exists").alias("n_filled"), F.count(missing).alias("n_missing"),
        F.array_join(F.array_sort(F.collect_set(missing)), "|").alias("missing"))


def migrate_step(step: Column, schema_version: Column) -> Column:
    """Step index of a stored session under the current schema."""
    table = F.create_map(*[F.lit(x) for pair in fv.STEP_MIGRATION.items() for x in pair])
    return F.when(schema_version >= fv.SESSION_SCHEMA_VERSION, step).otherwise(
        F.coalesce(F.try_element_at(table, step), F.lit(0)))


def override_type(voted: DataFrame, overrides: DataFrame) -> DataFrame:
    """Identification type per case, the user's choice beating the vote."""
    chosen = overrides.select("case_id", F.col("tipo").alias("chosen"))
    return voted.join(chosen, "case_id", "full_outer").select(
        "case_id", F.coalesce("chosen", "tipo").alias("tipo"))
