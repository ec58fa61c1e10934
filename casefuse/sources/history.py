"""Profiles, history, saved templates and session snapshots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.functions.text import is_blank
from casefuse.operators.overlay import migrate_step
from casefuse.sources.tables import latest

PROFILE_SCHEMA = """
    tipo STRING, label STRING, guardado STRING, fingerprint STRING,
    campos MAP<STRING, STRING>, fieldMapping MAP<STRING, STRING>, _corrupt STRING
"""
PROFILE_FIELDS = ["tipo", "label", "guardado", "fingerprint", "campos", "fieldMapping"]


def history_id(saved_at: Column) -> Column:
    """`h_` and the save time in milliseconds, base 36."""
    return F.concat(F.lit("h_"), F.lower(F.conv(F.unix_millis(saved_at).cast("string"), 10, 36)))


def build_profiles(values: DataFrame, cases: DataFrame, marker: str) -> DataFrame:
    """One profile per case: its non-blank fields and its labels.

    `values(case_id, field, value)` holds a field once per case, so a map is bounded by the
    field vocabulary. `cases(case_id, label, saved_at, fingerprint)`.
    """
    kept = values.where(~is_blank(F.col("value"))).groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("campos"))
    none = F.create_map().cast("map<string,string>")
    return cases.join(kept, "case_id", "left").select(
        "case_id", history_id(F.col("saved_at")).alias("id"), F.lit(marker).alias("tipo"), "label",
        F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("guardado"), "fingerprint",
        F.coalesce("campos", none).alias("campos"), none.alias("fieldMapping"))


def profile_json(profiles: DataFrame) -> DataFrame:
    """Profiles as JSON text."""
    return profiles.select("case_id", "id", "guardado",
                           F.to_json(F.struct(*PROFILE_FIELDS)).alias("json"))


def parse_profiles(rows: DataFrame) -> DataFrame:
    """Decode `json`; `profile` is null where it cannot be read."""
    raw = F.from_json("json", PROFILE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    one = F.transform(F.array(raw), lambda p: F.when(p["_corrupt"].isNull(), p))[0]
    return rows.withColumn("profile", one)


def import_profiles(rows: DataFrame, marker: str) -> DataFrame:
    """Profiles whose text can be read and carries the marker of this format."""
    return parse_profiles(rows).where(F.col("profile.tipo") == marker)


def rejected_profiles(rows: DataFrame, marker: str) -> DataFrame:
    """What `import_profiles` leaves out, and why."""
    why = F.when(F.col("profile").isNull(), "unreadable").when(
        ~F.col("profile.tipo").eqNullSafe(marker), "wrong marker")
    return parse_profiles(rows).withColumn("why", why).where(F.col("why").isNotNull()).drop("profile")


def list_history(log: DataFrame) -> DataFrame:
    """Readable entries that were not deleted, newest first, with their non-blank field count.

    `log(owner, id, json, op_seq, deleted)` is append-only: a delete is one more row for its id, so
    nothing is rewritten and a partition that loses its last entry needs no care. An id is a save
    time, so entries are told apart by owner and id.
    """
    alive = parse_profiles(latest(log, ["owner", "id"], "op_seq").where(~F.col("deleted")))
    # Exploding the one or no profile drops unreadable ones; a filter would decode each twice.
    readable = F.filter(F.array("profile"), lambda p: p.isNotNull())
    used = F.size(F.map_filter(F.col("profile.campos"), lambda k, v: ~is_blank(v)))
    return alive.select("owner", "id", F.explode(readable).alias("profile")).select(
        "owner", "id", "profile.label", "profile.guardado", used.alias("n_fields")).orderBy(
        F.col("guardado").desc(), "id", "owner")


def saved_mapping(log: DataFrame) -> DataFrame:
    """Latest mapping of each fingerprint as `(fingerprint, canonical, real)`."""
    return latest(log, ["fingerprint"], "op_seq").select(
        "fingerprint", F.explode("mapping").alias("canonical", "real"))


def load_sessions(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot of each case, its step moved to the current schema."""
    return latest(snapshots, ["case_id"], "seq").withColumn(
        "step", migrate_step(F.col("step"), F.col("schema_version")))
