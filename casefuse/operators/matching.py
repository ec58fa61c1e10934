"""Match a form's own field names to the canonical ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse import fixed_values as fv
from casefuse.functions.text import fold

CANONICAL_NAMES = [key for key, *_ in fv.FIELD_CATALOG]
MIN_SCORE = 0.5


def name_score(a: Column, b: Column, min_contain_len: int = 0) -> Column:
    """Similarity of two folded names: equal 1, one inside the other 0.8, else 0.7 x Jaccard."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    inside = (a.contains(b) & (F.length(b) >= min_contain_len)) | (
        b.contains(a) & (F.length(a) >= min_contain_len))
    return (F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(inside, 0.8)
            .otherwise(F.round(F.lit(0.7) * jaccard, 6)))


def score_canonicals(real: Column, canonicals=CANONICAL_NAMES) -> Column:
    """ARRAY<STRUCT<score, ord, canonical>> of a real name against the fixed canonical list.

    The list is a literal inside the row's expression: no join and no shuffle.
    """
    literal = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("canonical"),
                                 fold(F.lit(c)).alias("folded"))
                        for i, c in enumerate(canonicals)])
    return F.transform(F.array(fold(real)), lambda a: F.transform(literal, lambda c: F.struct(
        name_score(a, c["folded"]).alias("score"), (-c["ord"]).alias("ord"),
        c["canonical"].alias("canonical"))))[0]


def best_canonical(fields: DataFrame, canonicals=CANONICAL_NAMES) -> DataFrame:
    """Best canonical of each real name (`template_id, ord, field_name`); first listed on a tie."""
    best = fields.withColumn("best", F.array_max(score_canonicals(F.col("field_name"), canonicals)))
    return best.select(*fields.columns, F.col("best.canonical").alias("canonical"),
                       F.col("best.score").alias("score"))


def assign_canonicals(best: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One real name per canonical and template; names that lose stay unmapped.

    A real name proposes its best canonical only, so the winner of each canonical is a plain
    aggregate: highest score, then input order.
    """
    winners = best.where(F.col("score") >= min_score).groupBy("template_id", "canonical").agg(
        F.max_by("field_name", F.struct("score", (-F.col("ord")).alias("ord"))).alias("field_name"))
    won = winners.withColumn("won", F.lit(True))
    out = best.join(won, ["template_id", "canonical", "field_name"], "left")
    return out.select(
        "template_id", "ord", "field_name",
        F.when(F.col("won"), F.col("canonical")).alias("canonical"),
        F.when(F.col("won"), F.col("score")).otherwise(0.0).alias("confidence"))


def template_fingerprint(fields: DataFrame, page_counts: DataFrame) -> DataFrame:
    """`pages|sorted folded names`, repeated names kept.

    Equal names are counted before they are collected, so a template's list holds each distinct
    name once however many rows it has.
    """
    counted = fields.groupBy("template_id", fold(F.col("field_name")).alias("name")).agg(
        F.count(F.lit(1)).cast("int").alias("n"))
    names = F.array_sort(F.collect_list(F.struct("name", "n")))
    flat = F.flatten(F.transform(names, lambda x: F.array_repeat(x["name"], x["n"])))
    joined = counted.groupBy("template_id").agg(F.array_join(flat, ",").alias("names"))
    return joined.join(page_counts, "template_id").select(
        "template_id", F.concat_ws("|", F.col("n_pages").cast("string"), "names").alias("fingerprint"))


def apply_saved_mapping(suggested: DataFrame, fingerprints: DataFrame,
                        saved: DataFrame) -> DataFrame:
    """Saved mapping of a template's fingerprint if there is one, else the suggestion.

    `suggested(template_id, canonical, real)`, `saved(fingerprint, canonical, real)`.
    """
    known = fingerprints.join(saved, "fingerprint").select("template_id", "canonical", "real")
    kept = suggested.where(F.col("canonical").isNotNull()).join(
        known.select("template_id"), "template_id", "left_anti")
    return known.withColumn("needs_review", F.lit(False)).unionByName(
        kept.select("template_id", "canonical", "real").withColumn("needs_review", F.lit(True)))


def override_mapping(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual changes over a mapping; a null real name deletes the entry."""
    rows = mapping.select("template_id", "canonical", "real", F.lit(0).alias("layer")).unionByName(
        changes.select("template_id", "canonical", "real", F.lit(1).alias("layer")))
    last = F.max_by(F.struct("real"), "layer").alias("last")
    return rows.groupBy("template_id", "canonical").agg(last).select(
        "template_id", "canonical", "last.real").where(F.col("real").isNotNull())


def effective_fields(templates: DataFrame, fields: DataFrame,
                     canonicals=CANONICAL_NAMES) -> DataFrame:
    """A template's own field names, or the canonical list where it has none."""
    own = fields.select("template_id", "field_name", "ord")
    bare = templates.select("template_id").distinct().join(
        own.select("template_id").distinct(), "template_id", "left_anti")
    default = bare.select("template_id", F.posexplode(F.array(*map(F.lit, canonicals))).alias(
        "ord", "field_name"))
    return own.unionByName(default.select("template_id", "field_name", F.col("ord").cast(
        own.schema["ord"].dataType)))
