"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that hold on a cluster as well as on one machine. The number of
# shuffle partitions is left to the cluster: AQE coalesces small ones and splits
# skewed ones at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def share_path() -> None:
    """Python workers of a session made after this find the package from any folder of this machine.

    A cluster gets it by spark.submit.pyFiles or an installed package.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def local_session(cpus: int | str = "*", app: str = "turnout", memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    share_path()
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared folder; make a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="turnout-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


#: Spark's setting to delete the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes = threading.Lock(), {"now": 0, "before": None}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written inside go when it is there, not when the driver next collects garbage."""
    with _lock:
        if not _writes["now"]:
            _writes["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writes["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _writes["now"] -= 1
            if not _writes["now"] and _writes["before"] is None:
                spark.conf.unset(CLEANUP)
            elif not _writes["now"]:
                spark.conf.set(CLEANUP, _writes["before"])


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables `stored` inside are deleted at the end. What is to last is `stored` with keep=True."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"scratch-{uuid.uuid4().hex}")
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def frozen(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_deleted(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """As `frozen`, for tables that grow with the input: columns compressed, and read only where used."""
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join((not keep and _scratch.get()) or folder, f"table-{uuid.uuid4().hex}")
    with _shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A lookup table is broadcast up to so many rows.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it has at most BROADCAST_ROWS rows, else unchanged.

    For tables whose size the planner overrates, as those aggregated from joins. The rows
    are counted, so `df` should be cheap to compute. Only the plan depends on the count.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for small inputs that expand into much computation.

    An explicit number keeps AQE from coalescing them by their (small) input size.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores on a scan of few splits that heavy expressions follow.

    A scan with at least as many splits as cores, the normal case on a cluster, is
    returned unchanged and not shuffled. Only for plans without a shuffle: asking
    for their partitions runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
