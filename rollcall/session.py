"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"
WIDTH_CONF = "spark.sql.shuffle.partitions"
STATE_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "rollcall", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC days, adaptive execution and stream state on disk.

    ``master`` is left to spark-submit on a cluster. Shuffle width is not set
    here: on a cluster it belongs to the submit command, and adaptive execution
    coalesces what turns out too narrow.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(STATE_CONF, STATE_ON_DISK)
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state on disk, the only store that takes keyed
    state, in sessions not from :func:`build_session` too. Every batch opens and commits
    each of its partitions, whatever rows it has, so there are no more of them than two
    per core; the checkpoint keeps their number. A stream takes its settings along when
    it starts, so the session gets its own back."""
    width = min(int(spark.conf.get(WIDTH_CONF)), 2 * spark.sparkContext.defaultParallelism)
    wanted = {STATE_CONF: STATE_ON_DISK, WIDTH_CONF: str(width)}
    own = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="rollcall-")
        sc.setCheckpointDir(folder)
    return folder


def stage_by(df: DataFrame, column: str, spread: str, splits: int = 64) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder, one directory per value of
    ``column``, and read it back: a loop over the values then scans one
    directory per turn. A value is written by up to ``splits`` tasks, by hash
    of ``spread``. Returns the table and its path, for :func:`remove`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    salt = F.pmod(F.xxhash64(spread), F.lit(splits))
    df.repartition(F.col(column), salt).write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through its own file system; absent is fine."""
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        fs.delete(target, True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and holds anything."""
    fs, target = _file_system(spark, path)
    return fs.exists(target) and len(fs.listStatus(target)) > 0


def folder_values(spark: SparkSession, root: str, column: str) -> list[str]:
    """Values that have a ``column=VALUE`` directory under ``root``: one listing
    of one level, where a distinct over the table would open every file."""
    fs, target = _file_system(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def day_folders(spark: SparkSession, root: str, column: str) -> DataFrame:
    """Days that have a directory."""
    days = [(date.fromisoformat(d),) for d in folder_values(spark, root, column)]
    return spark.createDataFrame(days, "day date")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
