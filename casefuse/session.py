"""Session settings and the shared folder for written intermediates."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sets of engines and similar small buffers: keep hashing instead of sorting after 128 groups.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "262144",
    # A row (a reply, a text) costs far more time than its bytes tell: keep small stages on all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    # Spark's default; queries whose rows lie in buckets of a case turn it off for themselves.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed or shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's `spark.checkpoint.dir` (or the checkpoint folder the context
    was given); a temporary one in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
