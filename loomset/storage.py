"""Shared scratch tables: the place where a job cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"

# Folders made for local sessions that name none, by application.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="loomset-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    app = spark.conf.get("spark.app.id", "local")
    return f"{shared_dir(spark)}/loomset/{app}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back; ``codec``: if not Spark's usual one.

    Unlike a checkpoint the table keeps column pruning and filter pushdown, so
    later passes that need one column read one column, and a lost executor
    never causes the upstream work to run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
