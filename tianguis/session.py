"""Session helpers.

Library code never changes session configuration: a cluster session arrives
already tuned. ``local_session`` is for tests and the bench only, and
``shared_dir`` resolves the shared folder for materialised marts and
checkpoints from ``spark.checkpoint.dir`` (set only when it is unset).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "tianguis", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session configured like the cluster profile we target.

    AQE is on so that small dimensions become broadcast joins only after their
    runtime size is known, skewed join partitions are split, and tiny shuffles
    are coalesced.
    """
    parts = shuffle_partitions or (8 if cores == "*" else max(2, int(cores)))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local-mode session without one gets a scratch folder; on a cluster a
    machine-local folder would not survive the loss of an executor, so a
    missing setting is an error there."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="tianguis-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - no SparkContext on a Connect session
        pass
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
