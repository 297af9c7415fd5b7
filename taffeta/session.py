"""Session and scratch-space helpers.

Scratch data (written corpora, checkpoints) always goes below the folder the cluster names
in ``spark.checkpoint.dir``. Only a local session without that setting (tests) gets a private
folder under the system temp dir; elsewhere a missing setting is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
import warnings

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "taffeta",
                extra: dict | None = None) -> SparkSession:
    """A session with the library's settings. The master and the shuffle width are set only when
    given (tests, benchmarks); on a cluster they are ``spark-submit``'s."""
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A private local one is made only where none is set and the
    whole session is this machine's; on a cluster each executor would write to its own disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="taffeta-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_cleaned: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for written intermediates; it goes when the application ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(remove_scratch, spark, root)
    return root


def remove_scratch(spark: SparkSession, root: str | None = None) -> None:
    """Deletes the application's intermediates; results that still read them must be stored first."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(root or scratch_root(spark))
        path.getFileSystem(conf).delete(path, True)
    except Exception as e:  # the JVM may be gone already
        warnings.warn(f"scratch not removed: {type(e).__name__}", stacklevel=2)


#: How intermediates are written: they are read once or twice, and their size is what counts.
SCRATCH = {"compression": "zstd"}

_here = threading.local()


def scratch_made() -> list[str]:
    """The folders that this thread was given, in order."""
    if not hasattr(_here, "made"):
        _here.made = []
    return _here.made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder for a written intermediate; its file system is the checkpoint folder's."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    scratch_made().append(path)
    return path


@contextlib.contextmanager
def open_writers(spark: SparkSession, writers: int = 32):
    """Tables written inside with ``partitionBy`` keep up to ``writers`` files open in a task, where Spark would sort
    all of the task's rows by folder first; a task that meets more folders sorts the rest."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(writers))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def same_splits(spark: SparkSession):
    """Files read twice inside are split alike both times, also when executors come or go meanwhile."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, upon which Spark deletes the shuffle files of plans
    that nothing refers to any more. For the places where a table as large as the input was shuffled."""
    spark._jvm.System.gc()


def bucketed(df, key: str, name: str):
    """Writes a frame in buckets of ``key`` below the shared checkpoint folder: one shuffle, after
    which joins on that key shuffle their other side only. As many buckets as the session has shuffle
    partitions. The files alone stay; the catalogue entry goes at once. Not for hot keys: Spark
    splits skewed partitions only where both sides are shuffled."""
    spark = df.sparkSession
    path, n = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    df.repartition(n, key).write.bucketBy(n, key).options(path=path, **SCRATCH).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")
    return out


def materialise(df, name: str):
    """Write a frame once below the shared checkpoint folder and read it back: cuts lineage
    (survives executor loss) and lets several branches of a plan, and pushed-down filters,
    read stored columns instead of re-deriving them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**SCRATCH).parquet(path)
    return spark.read.parquet(path)
