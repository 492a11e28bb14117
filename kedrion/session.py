"""Session defaults and shared staging.

``staged`` is how every multi-step operator cuts lineage: the frame is written as Parquet to the
folder named by ``spark.checkpoint.dir`` (shared by all executors) and read back.  Nothing depends
on executor-local blocks, so a lost executor costs a re-read, never a recomputation from scratch.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_staged: dict[str, list[str]] = {}  # by application
_own_dir: list[str] = []


def build_session(app: str = "kedrion", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators are tuned for; keyword arguments override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The staging folder all executors share.

    Read from ``spark.checkpoint.dir``.  Only where that is unset *and* the session is local
    (one machine, e.g. tests) a temporary folder is made; on a cluster an unset value is an error.
    """
    folder = spark.conf.get(_CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="kedrion-stage-"))
    return _own_dir[0]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the staging folder; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (schema preserved)."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables staged for this application; frames built on them can no longer be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for staged_at in _staged.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(staged_at)
        path.getFileSystem(conf).delete(path, True)


def staged_with(df: DataFrame, label: str = "stage", **metrics: Column) -> tuple[DataFrame, dict]:
    """``staged``, and aggregates over its rows that are taken while they are written (no second job)."""
    seen = Observation()
    table = staged(df.observe(seen, *[value.alias(name) for name, value in metrics.items()]), label)
    return table, seen.get


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
