"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on; applied only where the session has none.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def scale_conf(shuffle_bytes: float, cores: int, partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Settings that keep shuffle partitions near ``partition_bytes`` for an
    expected shuffle volume (the projected timeline for the window stage is
    the largest shuffle), so every task fits in executor memory without
    heavy spill.  Adaptive execution may coalesce below the initial count but
    never splits a window partition, which is why hot entities are bucketed."""
    initial = max(2 * cores, int(shuffle_bytes // partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def get_spark(master: str | None = None, app: str = "behaviorlens", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local tests and scripts)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def default_parallelism(spark: SparkSession) -> int:
    """Cores available to the session (configuration value when the session
    has no local SparkContext, e.g. a remote client)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext on remote sessions
        return int(spark.conf.get("spark.default.parallelism", "8"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder; only a local session (tests) gets a
    scratch folder of its own when the setting is missing.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="behaviorlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    try:
        checkpoint_dir(df.sparkSession)
    except AttributeError:  # remote session: the server's checkpoint folder applies
        pass
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared checkpoint folder: compressed,
    prunable by column, and of a size that later joins know."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
