"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# The right settings on a cluster too: none of them sizes the job. Shuffle width is left to AQE, which
# merges small partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = 8, name: str = "starling", memory: str = "12g",
                  checkpoints: str | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own. ``checkpoints`` names the folder
    for intermediate data."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(cpus)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _same_folder(named: str, in_use: str) -> bool:
    """Whether ``in_use``, a session's own folder, lies directly in ``named``, with or without a scheme."""
    wanted, parent = urlparse(named), urlparse(in_use.rstrip("/").rpartition("/")[0])
    return (wanted.path.rstrip("/") == parent.path.rstrip("/")
            and (not wanted.scheme or (wanted.scheme, wanted.netloc) == (parent.scheme or "file", parent.netloc)))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, made the one in use. Where the setting is absent, the folder
    already in use. Where there is none either, the caller must name one; only a local master, where all tasks see
    the same disk, gets one beside the tables of ``spark.sql.warehouse.dir``."""
    context = spark.sparkContext
    in_use = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and in_use is not None:
        return in_use
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_checkpoints"
    if in_use is None or not _same_folder(named, in_use):
        context.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for one run beside the checkpoints, where all executors reach it; it goes when the driver ends."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so a lost executor does not redo what led to it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
