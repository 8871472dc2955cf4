"""Stage tables: lineage cuts written to the shared checkpoint folder.

Several operators need a result twice and must see the same rows in the same
place both times (numbering, running totals), or need the true size of a result
before joining it. They write it as Parquet under ``spark.checkpoint.dir``: the
copy survives lost executors, prunes columns, and carries its size, so that
Spark's own size check decides whether a join broadcasts it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}
_WRITTEN: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """The shared folder of the session; a private one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="sievespark-")
        spark.sparkContext.setCheckpointDir(_OWN_ROOT[app])
    return _OWN_ROOT[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the stage root."""
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._stage_path = path
    return copy


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more, and the shuffle files of the jobs that have ended.

    Spark deletes the files of a shuffle when the driver's JVM finds that nothing refers to it, which
    it looks for when its memory runs short, or twice an hour; rounds over tables would pile them up.
    """
    spark = tables[0].sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stage_path)
        path.getFileSystem(conf).delete(path, True)
        _WRITTEN.remove(table._stage_path)
    gc.collect()  # Python's references keep the JVM's objects
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Delete the stage tables written so far; returns how many there were."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += int(path.getFileSystem(conf).delete(path, True))
    return count


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run_stage(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    from_scratch: bool = False,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Skip a stage whose output is complete; build it otherwise.

    Completeness is the ``_SUCCESS`` marker, so a half-written stage is redone.
    """
    if from_scratch or not path_exists(spark, f"{path}/_SUCCESS"):
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def load_or_fit(spark: SparkSession, path: str, loader, fit: Callable[[], object], from_scratch: bool = False):
    """Reload a fitted model or transformer if it was saved, else fit and save it.

    A marker beside the model is written last, so one saved in part is fitted again.
    """
    marker = f"{path.rstrip('/')}.complete"
    if from_scratch or not path_exists(spark, marker):
        fit().write().overwrite().save(path)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()
        _WRITTEN.append(marker)
    return loader.load(path)


def fits_rows(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; stops counting beyond that."""
    return df.limit(max_rows + 1).select(F.lit(1)).count() <= max_rows


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a scan of few splits more tasks.

    A table with as many splits as the session has cores passes unchanged, so
    nothing is shuffled where the input is large. ``scan`` must be a plain scan.
    """
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan
