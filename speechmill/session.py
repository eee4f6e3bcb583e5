"""Session settings and the few cluster facts the operators ask for."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("speechmill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    The cluster names a shared one in ``spark.checkpoint.dir``. A private temporary folder is
    used only by a local master, where driver and executors are the same machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="speechmill-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run that the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back: computed once, and no lineage to lose."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of :func:`kept` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        session = df.sparkSession
        folder = session._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table refers to any more; else they stay until the driver happens to collect its garbage.

    The last job's are held until another one has run.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Use every core when a scan has fewer tasks than the cluster has cores.

    A scan of a large table already has many more splits than cores and is returned as it is, so
    no shuffle is added where it would cost something.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) if isinstance(k, str) else k for k in keys])
