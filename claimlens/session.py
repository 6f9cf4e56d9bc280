"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import os
import pathlib
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale; all are safe in local mode too.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Catalyst/AQE broadcast a side only when its measured size is below this.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove a checkpoint's files once its DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "claimlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the scale settings applied.

    ``shuffle_partitions`` is the initial partition count of every shuffle;
    AQE coalesces it down to ~128 MB partitions at runtime, so on a cluster
    set it to roughly (largest shuffle bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one that ``spark.checkpoint.dir`` names. Where that is unset,
    a local master uses a folder of its own under the session's warehouse
    folder; any other master is an error, since executors would each write
    to a folder that the others cannot see.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{sc.applicationId}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers: its sources go to the
    executors as a zip (once per application), as ``--py-files`` would do."""
    sc = spark.sparkContext
    if getattr(sc, "_claimlens_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="claimlens-zip-"), "claimlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"claimlens/{f.relative_to(root)}")
    sc.addPyFile(target)
    sc._claimlens_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
