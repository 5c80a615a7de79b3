"""Session settings and the shared scratch folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Ranks up to any k a caller may ask for are pruned per key before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # A batch of 10,000 rows of packed arrays would be gigabytes in the JVM and in the worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


BROADCAST_ROWS = 100_000
# Least and most rows of a task that goes through kept arrays again and again.
TASK_LEAST, TASK_MOST = 16_384, 500_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on.

    A cluster keeps its own number of shuffle partitions; on one machine the untouched
    default of 200 is replaced by the number of cores.
    """
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, context.defaultParallelism)))
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Kernels are pickled by reference, so workers must be able to import them wherever Spark was
    started. The archive goes to the shared folder, where a replaced executor finds it as well.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent).as_posix())
    path = f"{scratch_path(spark, 'code')}/{root.name}.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(content.getvalue()))
    stream.close()
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brightshelf")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder.

    A temporary folder is used only on a local master that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="brightshelf-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, inside a directory of this application.

    Nothing here deletes it: results are read lazily. Once the application has ended, its
    directory can go.
    """
    return f"{shared_dir(spark)}/brightshelf/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Cut lineage by writing a table to the shared folder and reading it back.

    The table survives a lost executor, and branches that use it twice read it
    instead of computing it twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete a table written by `materialise` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(spark: SparkSession, rdd) -> None:
    """Have an RDD written to the shared folder by its first action, which ends its lineage there."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))
    rdd.checkpoint()


def drop_checkpoint(spark: SparkSession, rdd) -> None:
    """Delete the checkpoint of an RDD (None: nothing) that nothing reads any more."""
    path = rdd and rdd.getCheckpointFile()
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def removing_shuffles(spark: SparkSession):
    """Shuffle files of each action in here go when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_side(df, name: str):
    """One row per key of a fact table's grouping key, for a join with that table.

    The table is written, its rows are counted, and only up to BROADCAST_ROWS rows are
    broadcast; beyond that the join is an ordinary shuffle with AQE skew handling. With
    few keys a shuffle on them would put the facts into few tasks.
    """
    from pyspark.sql import functions as F

    stored = materialise(df, name)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def partitions_for(spark: SparkSession, rows: int, at_most: int) -> int:
    """Partitions of `at_most` rows on average; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // at_most))


def tasks_for(rows: int, cores: int) -> int:
    """Tasks of a pass over kept arrays: one per core from TASK_LEAST rows each, more where a task would hold over TASK_MOST."""
    return max(1, min(cores, rows // TASK_LEAST), -(-rows // TASK_MOST))
