"""Table access and the shared workspace that cuts lineage.

Everything that is kept between jobs goes to the folder named by ``spark.checkpoint.dir``,
which every executor of a cluster sees, so a lost executor never loses a kept result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
BATCH_BYTES = 8 << 20  # of rows that a Python worker is handed at once
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python workers get, unless the session bounds them lower; long texts then come few at a time."""
    if not spark.conf.get(_BATCH).isdigit() or int(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The shared folder of this session; a local one is made only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quayline-")
    return _LOCAL[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the workspace that nothing else uses."""
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the workspace and read it back: one evaluation, no lineage."""
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
