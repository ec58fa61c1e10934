"""Readers, and append-only tables where the newest row of a key counts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefuse.session import shared_dir


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_document_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as `(uri, copied_at, n_bytes, content)`; content is read only if used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("uri"), F.col("modificationTime").alias("copied_at"),
                        F.col("length").alias("n_bytes"), "content")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to an append-only table; readers never see a half-written append."""
    rows.write.mode("append").parquet(path)


def append_parted(rows: DataFrame, path: str, keys: list, parts: int = 64) -> None:
    """Add rows to an append-only table that is cut into `part=…` folders by a hash of the key."""
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rows.withColumn("part", part).write.mode("append").partitionBy("part").parquet(path)


def compact(spark: SparkSession, path: str, keys: list, order: str, gone: str = None) -> list:
    """Keep the newest row per key of a parted table; the parts that were rewritten.

    Only parts that hold more rows than keys are rewritten, by dynamic partition overwrite; the others
    are not touched, and readers see the same newest rows before and after. Rows for which `gone`
    holds (a deletion) go together with what they delete. The newest rows are written elsewhere
    first, as a table cannot be read and overwritten at once. A part that is left empty keeps its
    deletions.
    """
    log = spark.read.parquet(path)
    newest = latest(log, ["part", *keys], order)
    stale = F.count(F.lit(1)) > F.count_distinct(F.struct(*keys))
    touched = [r.part for r in log.groupBy("part").agg(stale.alias("stale")).where("stale").collect()]
    if not touched:
        return []
    kept = written(newest.where(F.col("part").isin(*touched)), "compacted")
    if gone:
        live = kept.where(~F.expr(gone)).select("part").distinct()
        kept = kept.join(live, "part", "left_semi").where(~F.expr(gone)).unionByName(
            kept.join(live, "part", "left_anti"))
    kept.select(*log.columns).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return sorted(touched)


def latest(log: DataFrame, keys: list, order: str) -> DataFrame:
    """Newest row per key of an append-only table."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def bucketed(df: DataFrame, name: str, buckets: int, keys: list) -> DataFrame:
    """As `written`, in buckets of the keys: joins on these keys leave the rows where they are."""
    path = shared_dir(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage cut, work done once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
