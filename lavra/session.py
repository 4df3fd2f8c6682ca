"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lavra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LAVRA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only in a session on one machine (tests, the bench) may that be
    unset, and a folder of this process takes its place; on a cluster such a folder would be another one on every
    executor, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir isn't set; {master} needs a folder that all executors share")
    if not getattr(shared_dir, "_own", None):
        shared_dir._own = tempfile.mkdtemp(prefix="lavra-")
        atexit.register(shutil.rmtree, shared_dir._own, ignore_errors=True)
    return shared_dir._own


_STAGED: list[str] = []


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables this process has staged (whose readers must be done with them); the number deleted."""
    done = 0
    while _STAGED:
        done += _delete(spark, _STAGED.pop())
    return done


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear_staged(spark)
    except Exception:  # noqa: BLE001  the session is gone; its folder is the owner's to clear
        pass


def own_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder within the shared one, deleted when the process ends."""
    path = f"{shared_dir(spark)}/lavra/{name}-{uuid.uuid4().hex}"
    if not getattr(own_folder, "_clears", False):
        own_folder._clears = True
        atexit.register(_clear_at_exit, spark)
    _STAGED.append(path)
    return path


def staged(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage and survives the loss of any executor, because the files lie in the shared folder, not on executors.
    What is still there when the process ends is deleted then; :func:`unstage` does it at once.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lv_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables made by :func:`staged` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_lv_path", None)
        if path in _STAGED:
            _STAGED.remove(path)
            _delete(t.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: for work per row that is worth a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
