"""Session construction and table access shared by all plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for local runs; on a cluster the submitted configuration wins."""
    b = (
        SparkSession.builder.appName("panelweave")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One base table; columns are pruned by what the plan selects."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and stored tables: the one that spark.checkpoint.dir names.

    Where it is unset, a local master gets a temporary folder. A cluster has none that all its executors share, so there a
    RuntimeError asks for the setting. Checkpoints are removed once nothing refers to them, stored tables when Python ends.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, stored in the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *sort: str) -> DataFrame:
    """df written as a table in the shared folder and read back: columnar, so later readers prune and push down; removed when Python ends.

    sort: columns by which each task orders its rows before writing.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(folder)
    atexit.register(_remove, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone; then its scheduler removes the folder
        pass


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than `rows` rows; reads no more than it needs to tell. For tables that are stored or small."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (of a few numbers each); otherwise as it is, to be joined by a shuffle."""
    return F.broadcast(df) if at_most(df, rows) else df


def side_by_side(makers: list[Callable[[], DataFrame]], at_once: int = 4) -> list[DataFrame]:
    """The tables that the makers build, each materialized, several at once: small jobs that don't depend on each other fill a cluster together."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda make: materialize(make()), makers))
