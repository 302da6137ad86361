"""Session helpers: a local session for tests/bench and a shared scratch folder.

On a cluster the caller owns the session; nothing here overrides settings that
are already present.  The scratch folder is derived from
``spark.checkpoint.dir`` (a shared filesystem on a cluster); only a local session
without that setting, as in tests, gets a folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: str | int = "*", app: str = "quarry", extra: dict | None = None) -> SparkSession:
    """A local[N] session with the settings used by the tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_LOCAL_DEFAULTS)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` (or the context) names.

    Where it is unset, a local session (tests, bench) gets a folder of its own; on
    a cluster that would be a folder other machines cannot read, so it raises."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        current = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    # DataFrame.checkpoint() needs the context-level directory too.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder (URI) of the shared folder for written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
