"""Split dataset store (S8) and build-if-absent."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.session import open_writers


def save_dataset(df: DataFrame, path: str, split_col: str = "split", mode: str = "error") -> None:
    """One folder per split value, so ``where(split = 'train')`` prunes whole folders."""
    with open_writers(df.sparkSession):
        df.write.mode(mode).partitionBy(split_col).parquet(path)


def load_dataset(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    d = spark.read.parquet(path)
    return d.where(F.col(split_col) == split) if split is not None else d


def save_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Build an artefact only when it does not exist yet (``mode('ignore')``)."""
    df.write.mode("ignore").format(fmt).save(path)


def build_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet",
                    stale_s: float = 3600, poll_s: float = 0.5) -> DataFrame:
    """The artefact at ``path``, built by ``build`` only when it is not there, and by one application only.

    The builder claims the artefact by creating a file beside it, which a file system grants once; it writes to a
    folder of its own and commits by renaming that to ``path``, so nobody ever reads half an artefact. Others
    wait for the commit. A claim older than ``stale_s``, whose application must have died, is
    taken over; a builder that fails gives its claim back.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}.claim")
    fs.mkdirs(claim.getParent())
    while not fs.exists(target):
        if not _claimed(spark.sparkContext._gateway, fs, claim):
            if _age(fs, claim) > stale_s:
                fs.delete(claim, False)
            else:
                time.sleep(poll_s)
            continue
        try:
            if not fs.exists(target):  # committed between the two looks
                own = f"{path}.building-{uuid.uuid4().hex[:12]}"
                build().write.format(fmt).save(own)
                if not fs.rename(jvm.org.apache.hadoop.fs.Path(own), target):
                    raise OSError(f"cannot commit {path}")
        finally:
            fs.delete(claim, False)
    return spark.read.format(fmt).load(path)


def _claimed(gateway, fs, claim) -> bool:
    jvm = gateway.jvm
    try:
        if fs.getScheme() == "file":  # whose create() looks first and creates then
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(claim.toUri().getPath()).toPath(),
                                               gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(claim, False).close()
        return True
    except Exception as e:
        if fs.exists(claim) or "AlreadyExists" in str(e):
            return False
        raise


def _age(fs, claim) -> float:
    try:
        return time.time() - fs.getFileStatus(claim).getModificationTime() / 1000
    except Exception:  # given back meanwhile
        return 0.0
