"""Session construction and the shared scratch location.

Lineage is cut with ``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``; scratch tables are written below the same folder.  The
setting is read from the session.  Only when it is unset (local tests) do we set one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoint files of the two-phase rank are deleted once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "seatwise",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the settings every job here assumes (UTC, AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _context_checkpoint_dir(spark: SparkSession) -> str | None:
    try:
        jd = spark.sparkContext._jsc.sc().getCheckpointDir()
    except Exception:          # no JVM context (e.g. a Spark Connect client)
        return None
    return jd.get() if jd.isDefined() else None


def _master(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.master
    except Exception:
        return spark.conf.get("spark.master", "")


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, or None when unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or _context_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has a target.

    Uses ``spark.checkpoint.dir`` when the session has it.  When it is unset on a
    local master (tests), a fresh folder under the system temp dir is set instead; on
    a cluster that would be a machine-local folder, so it is an error.
    """
    d = checkpoint_root(spark)
    if d is None:
        if not _master(spark).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
                               "for checkpoints and scratch tables")
        d = tempfile.mkdtemp(prefix="seatwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if _context_checkpoint_dir(spark) is None:
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:      # no JVM context: the conf setting is what checkpoint() reads
            pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path for a written table below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/seatwise-scratch/{name}-{uuid.uuid4().hex}"


def stored(df):
    """``df`` written below ``spark.checkpoint.dir`` and read from there: computed once, and a
    lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


__all__ = ["stored", "build_session", "checkpoint_root", "ensure_checkpoint_dir", "scratch_path",
           "DEFAULT_CONF"]


UNKNOWN_BYTES = 2 ** 63 - 1


def estimated_bytes(df) -> int:
    """Catalyst's size estimate of ``df`` (``sizeInBytes`` of the optimized plan).

    It scales the compressed file size by default column widths, so it can be several
    times too small (or, for joins, too large).  Used only to pick the cheaper of two
    plans with the same result, never as a bound.
    """
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:          # no plan statistics available: treat as unknown, i.e. large
        return UNKNOWN_BYTES
    return int(size if isinstance(size, int) else size.toString())


def scale_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a run over ``input_bytes`` of input on ``cores`` executor cores.

    * read splits of ``partition_bytes`` (fewer, larger scan tasks);
    * shuffles start at about one partition per ``partition_bytes`` of input (at least
      three waves of the cores) and AQE merges them down to ``partition_bytes``;
    * AQE splits skewed join partitions; broadcasts stay small (the size checks in
      ``operators/sizing`` hint only proven-small sides);
    * checkpoint files are cleaned when unreferenced;
    * streaming state lives in RocksDB (local disk) instead of the executor heap.
    Pass the result as ``extra`` to ``build_session`` (or to spark-submit ``--conf``).
    """
    initial = max(3 * cores, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # streaming intake state (one row per person) on local disk, not executor heap
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
