"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "daygrain", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the library relies on.

    Shuffle partitions are only set when asked for: on a cluster AQE coalesces
    from ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``.
    ``driver_memory`` sizes the single JVM of a local master.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``; a session without that
    setting names it with ``sparkContext.setCheckpointDir``.  Driver and
    executors must share the folder, so none is made up here: an unset folder
    is an error on every master.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, or call sparkContext.setCheckpointDir, "
                           "with a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp()}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession, prefix: str = "scratch") -> str:
    """A new path below the shared folder, deleted when the driver program ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def remove_scratch() -> None:
    """Delete the scratch folders through the file system that holds them."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # the session is gone: the folder is left to its owner
            continue


#: Spark deletes a query's shuffle files when it ends, not when the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, prefix: str = "scratch", release: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    The rows survive lost executors, are computed once however often they are
    used, and columns that are not asked for are not read.  With ``release``
    the shuffle files of the write are deleted after it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, prefix)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true" if release else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


#: Stages whose generated method has more bytes run without one.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs over many computed columns: the JVM does not compile methods of more than 8,000 bytes, but interprets them."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, "8000")
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and forget its plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
