"""Session settings, the shared folder and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. Skewed sort-merge joins must be
# split even where that adds a shuffle: one key may hold a third of the rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state larger than memory must not end the job.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"

_own_root: str | None = None


def build_session(app: str = "drayage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, as in tests, may have none named: then one is made.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        global _own_root
        named = _own_root = _own_root or tempfile.mkdtemp(prefix="run-drayage-")
    return named.rstrip("/")


def planned_bytes(df: DataFrame) -> int | None:
    """Size of the tables ``df`` reads, after pruning, as Spark's planner sees it.

    The sum over the scans, not the plan's own estimate: that takes a join for
    the product of its sides. None if a scan has no known size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < UNKNOWN_BYTES else None


# Spark takes a source it knows nothing about for one of 8 exabytes.
UNKNOWN_BYTES = 1 << 62

# The size up to which Spark reads files in one task.
SPLIT_BYTES = 128 << 20

def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores where the input is too small to be split that far.

    For costly work per row; a large input has splits enough and is left as it
    is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = planned_bytes(df)
    return df.repartition(cores) if size is not None and size < cores * SPLIT_BYTES else df


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_root(spark)}/drayage/{spark.sparkContext.applicationId}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of tables, wherever it lies; nothing happens if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered_folders(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers ``n`` of the folders ``name=n`` in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(x.getPath().getName()) for x in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))


_scope: ContextVar[str] = ContextVar("scratch_scope", default="")


@contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Intermediate tables made inside lie in a folder of their own, to be dropped together."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's folder; never one that is in use."""
    return "/".join(filter(None, [scratch_root(spark), _scope.get(), f"{label}-{uuid.uuid4().hex}"]))


def drop_scratch(spark: SparkSession, scope: str = "") -> None:
    """Remove the application's intermediate tables, or those of one scope, when no result of them is read any more.

    Shuffle files go too, as far as no plan that is still held needs them.
    """
    drop_folder(spark, "/".join(filter(None, [scratch_root(spark), scope])))
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet and read it back.

    Used where one result feeds several jobs. The table outlives executors,
    is column-pruned by its readers and has a known size, so that joins with
    it are planned on real numbers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
