"""Session construction and the shared scratch location.

Library code never invents a machine-local folder: anything it writes goes below the
directory the cluster names in ``spark.checkpoint.dir``.  Only when that setting is
absent and the master is local (tests) is a private temporary folder chosen, recorded in the
session and removed when the process ends; off local mode a missing setting raises.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app_name: str = "leadflow",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings the plans assume (AQE on, UTC, UI off).

    The master, shuffle partitions and everything about size are set only if passed: what
    spark-submit or the cluster's defaults say is left alone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for a cluster run over ``input_bytes`` of Parquet.

    * scans: one split per ``target_partition_bytes`` (``spark.sql.files.maxPartitionBytes``);
    * shuffles: start with enough partitions that each holds about 128 MB of the largest
      shuffle (taken as the input size, an upper bound for these plans), at least 3 per
      core; AQE then coalesces small ones and splits skewed ones at runtime.
    At 100 TB this is about 745,000 initial shuffle partitions; AQE coalesces them to the
    advisory size.  Pass the result as ``build_session(extra=...)``.
    """
    shuffle = max(3 * total_cores, input_bytes // (128 << 20))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and stream checkpoints.

    Read from the session (``spark.checkpoint.dir``, else the context's checkpoint
    folder).  If the session has none, a private temporary folder serves in local mode;
    with any other master executors would each write to their own disk, so that raises."""
    value = spark.conf.get(CHECKPOINT_KEY, None)
    if not value:
        try:
            value = spark.sparkContext.getCheckpointDir()
        except Exception:                                # no JVM context (e.g. a remote session)
            value = None
    if not value:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_KEY} is not set; with master {master!r} it must name a folder that "
                             "all executors share")
        value = tempfile.mkdtemp(prefix="leadflow-ckpt-")
        atexit.register(shutil.rmtree, value, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, value)
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(value)
    except Exception:
        pass
    return value.rstrip("/")


def application_id(spark: SparkSession) -> str:
    value = spark.conf.get("spark.app.id", None)
    if value:
        return value
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return "app"


def written(df, name: str):
    """``df`` written once below the shared folder and read back: computed once however often
    it is read, and safe from lost executors."""
    path = scratch_path(df.sparkSession, "written", name, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path below the checkpoint folder; ``unique`` adds a fresh component."""
    pieces = [checkpoint_dir(spark), "leadflow", *parts]
    if unique:
        pieces.append(uuid.uuid4().hex[:12])
    return "/".join(pieces)
