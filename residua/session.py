"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("residua")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # work per byte is high here: small tables still use every core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="residua-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the copy.

    Cuts lineage without relying on any single executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete all copies written so far, as is done at the end.

    For long sessions, between results: what still reads a copy must be finished.
    """
    while _written:
        path, spark = _written.popitem()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is already gone
            pass


atexit.register(forget)
