"""Session helpers: building a local session for tests/bench, and the shared
checkpoint folder used to cut lineage in iterative miners."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "basketry", extra: dict | None = None) -> SparkSession:
    """Local session with AQE (coalesce + skew-join split) and no UI."""
    master = master or os.environ.get("BASKETRY_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one set
    earlier on the context). Only a local-mode session without one gets a
    private folder; a cluster session without one is an error, because a
    machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="basketry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/basketry-scratch/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Inputs whose tables are larger than this are read again for each pass, not kept.
PERSIST_BYTES = 16 << 30
# So are plain scans of files larger than this: their rows (texts, say) may be wide, and what
# holds or builds their columns then fills an executor's heap, to save one more scan.
RESCAN_BYTES = 128 << 20


def scanned_bytes(df: DataFrame) -> int:
    """The size of the tables that ``df`` reads, as Spark's plan knows it (a checkpoint
    counts as boundless: reading it again costs little)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is columns and filters over one table of files: no join, no shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


@contextmanager
def persisted(df: DataFrame):
    """Keep ``df`` (an input read several times) in memory/disk for a block, where
    the tables behind it are of at most ``PERSIST_BYTES``, or ``RESCAN_BYTES`` if it is a plain scan.

    Multi-pass operators read their baskets once per pass; persisting builds
    small ones once, large ones are read again, so executor disks never hold a large input.
    A lost block is rebuilt from lineage. A DataFrame the caller
    already persisted is used as is and left persisted.
    """
    size = scanned_bytes(df)
    if size > PERSIST_BYTES or size > RESCAN_BYTES and plain_scan(df) or df.storageLevel != StorageLevel(False, False, False, False, 1):
        yield df
        return
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield p
    finally:
        p.unpersist()
