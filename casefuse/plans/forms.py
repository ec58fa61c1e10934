"""Match user forms, find their signature pages, plan and report the filling."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse.operators import layout, matching, overlay


def match_forms(fields: DataFrame, page_counts: DataFrame, saved: DataFrame,
                canonicals=matching.CANONICAL_NAMES) -> DataFrame:
    """Mapping of every form: saved for its fingerprint, else suggested and to be reviewed."""
    assigned = matching.assign_canonicals(matching.best_canonical(fields, canonicals))
    suggested = assigned.select("template_id", "canonical", F.col("field_name").alias("real"))
    return matching.apply_saved_mapping(
        suggested, matching.template_fingerprint(fields, page_counts), saved)


def signature_layout(widgets: DataFrame, fragments: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Default placement on every signature page."""
    candidates = layout.candidate_pages(layout.multipage_pages(widgets), page_counts)
    pages = layout.signature_pages(candidates, layout.page_anchors(fragments))
    return layout.placements(pages)


def plan_fill(values: DataFrame, cases: DataFrame, mapping: DataFrame, form_fields: DataFrame,
              day: datetime.date, responsible: tuple) -> DataFrame:
    """Every value with its target on the case's form; `responsible` is a (field, value) default."""
    dated = overlay.default_dates(overlay.drop_dates(values), cases, day)
    complete = overlay.default_value(dated, cases, *responsible)
    return overlay.fill_plan(overlay.rename_fields(complete, mapping), form_fields)
