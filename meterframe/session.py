"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "meterframe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster ``master`` stays ``None`` and the submitter's settings win;
    only unset keys are filled in here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Small shuffles feed CPU-heavy projections and aggregates: do not
        # coalesce them below ~256 KB per task (large shuffles are unaffected).
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Times are TIMESTAMP_NTZ holding UTC; the session zone never enters
        # a computation, UTC keeps printed values readable.
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
        # Plans here are built from many column expressions; capturing the
        # Python call site for every API call costs JVM round trips each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Merges and refreshes checkpoint their staged results; drop those
        # files once the DataFrames are gone (long-running streams).
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.ui.enabled", "false")
        conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster names it; only when it is unset (local tests) a private folder
    is created and registered.  On a cluster an unset key is an error: executors
    would each write to a folder of their own.
    """
    sc = spark.sparkContext
    current = sc.getConf().get(_CHECKPOINT_KEY, None) or spark.conf.get(_CHECKPOINT_KEY, None)
    if not current:
        current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="meterframe-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    sc.setCheckpointDir(current)
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for staged tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"

