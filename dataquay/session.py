"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "dataquay", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine.

    On a cluster the caller brings its own session: no operator sets cluster
    settings, and shuffle partition counts are left to AQE.
    """
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    partitions = str(os.cpu_count() if cpus == "*" else cpus)
    settings = {**DEFAULT_CONF, "spark.sql.shuffle.partitions": partitions, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local session may
    fall back to a folder of its own, since there every task sees the same disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    existing = context.getCheckpointDir()
    if not configured and not existing and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = configured or existing or tempfile.mkdtemp(prefix="dataquay-")
    if not existing:
        context.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, for one written table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/dataquay/{label}-{uuid.uuid4().hex}"
