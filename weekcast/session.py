"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading

from pyspark.sql import SparkSession

# Session settings every job relies on: UTC so DATE/TIMESTAMP casts agree with
# the oracle, AQE for runtime coalescing and skew-join splitting.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app: str = "weekcast",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the library defaults.

    On a cluster ``master`` stays ``None`` so the launcher's master is used and
    ``spark.sql.shuffle.partitions`` should be sized to the data (AQE coalesces
    small partitions at runtime, so erring high is cheap).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    checkpoint_dir(spark)
    return spark


_LOCAL_CKPT: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; only when that setting is
    absent and the master is local (tests) is a fresh scratch folder created and
    recorded. Elsewhere a missing setting is an error: one machine's folder is
    none that the executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not configured and sc is not None:
        configured = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app_id(spark) not in _LOCAL_CKPT:
            _LOCAL_CKPT[app_id(spark)] = tempfile.mkdtemp(prefix="weekcast-ckpt-")
        configured = _LOCAL_CKPT[app_id(spark)]
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        return None


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or "app"


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", None) or spark.conf.get("spark.sql.shuffle.partitions"))


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables.

    Each application has a folder of its own there, which goes when the driver ends.
    """
    base = os.path.join(checkpoint_dir(spark), "tables", app_id(spark))
    if base not in _SCRATCH:
        sc = _context(spark)
        if not _SCRATCH and sc is not None:
            atexit.register(_remove_scratch, sc._jvm)
        _SCRATCH.add(base)
    return os.path.join(base, name)


def _remove_scratch(jvm) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone already; the folder then stays
        for base in _SCRATCH:
            path = jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


# One lock for the "write once per application" tables (retail tables, feature
# table, fitted model): concurrent callers wait instead of writing twice.
ONCE_LOCK = threading.RLock()


MAX_SHUFFLE_PARTITIONS = 100_000


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized to the input for a large cluster.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least 3 per core, at most 100k: map tasks x reducers is the
    number of shuffle blocks); AQE then coalesces small ones to the advisory
    size and splits skewed ones, so starting high is cheap while starting low
    makes tasks spill. Scan splits match the target size.
    """
    parts = min(MAX_SHUFFLE_PARTITIONS, max(3 * total_cores, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
        # coalesce to the advisory size rather than keeping one partition per
        # core (Spark's advice for shared clusters; on a laptop-sized input it
        # would leave a single task per stage)
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
