"""Session helpers: checkpoint folder, tables, small bounded values."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a session on one machine gets a temporary
    one; on a cluster, where such a folder would not be shared, it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get(CHECKPOINT)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tamiz-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of plans made here are deleted as soon as the plan has run, not when the driver collects its garbage.

    For large steps whose result is checkpointed or collected: nothing reads their shuffles again.
    """
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def kept(spark: SparkSession, source: DataFrame, key: str, make: Callable[[str], None], again: bool = False) -> str:
    """A folder of tables made from ``source`` by ``make(folder)``; made if it is not there or is to be made ``again``.

    It lies in the shared checkpoint folder under ``key`` and the names, sizes and times of the source's files, so that another
    input is another folder.  A mark is written last: what was broken off is made anew.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda f: jvm.org.apache.hadoop.fs.Path(f)
    state = lambda p: (p.toString(), *(lambda s: (s.getLen(), s.getModificationTime()))(p.getFileSystem(conf).getFileStatus(p)))
    said = hashlib.sha256(repr(sorted(state(at(f)) for f in source.inputFiles())).encode()).hexdigest()[:16]
    folder = f"{shared_folder(spark)}/tamiz-{key}-{said}"
    mark = at(f"{folder}/_DONE")
    if again or not mark.getFileSystem(conf).exists(mark):
        make(folder)
        mark.getFileSystem(conf).create(mark, True).close()
    return folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bytes_of(df: DataFrame) -> int:
    """Catalyst's upper estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint only where the estimated size is under ``limit``; else Spark chooses."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if bytes_of(df) <= limit else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the cluster has cores, for steps whose CPU time outweighs a shuffle of their input.

    Only for plain scans: counting the partitions of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
