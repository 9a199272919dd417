"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM leaves methods over 8000 bytes of code interpreted; past that size Spark's split
    # projections are faster than one fused loop. Reading five vendors' payloads is past it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A repeated key in a vendor's JSON is legal; its last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


#: Parts of a scan for every task slot: reading a vendor's line costs far more than its bytes tell, so a scan is cut finer than one part a slot.
SCAN_PARTS = 4


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on (UTC), the ones skew handling needs (AQE), and the parts of a scan."""
    parts = str(SCAN_PARTS * spark.sparkContext.defaultParallelism)
    for key, value in {**SETTINGS, "spark.sql.files.minPartitionNum": parts}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``. Only where that is unset on a
    local master does a temporary folder stand in; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), f"convoy-{os.getpid()}")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give Spark's own checkpoints, which model fitting makes, a folder when the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def staged(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back, for results that several steps read.

    Later steps scan the files, with their columns and sizes, also after the loss of an executor.
    """
    path = shared_dir(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
