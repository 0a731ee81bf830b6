"""Session helpers: local sessions for tests and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Lists that note the folders cut_lineage writes, innermost scope last.
_noting: list[list[str]] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tablelens") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python line of each column expression costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; on a cluster ship or install it."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session may fall back to a temporary folder of its own: there, driver and
    executors are one process. On a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tablelens-"))
    return context.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    What follows neither repeats the work before nor depends on an executor that may be lost.
    """
    folder = work_dir(df.sparkSession, "cut")
    for noted in _noting[-1:]:
        noted.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def cut_folders() -> Iterator[list[str]]:
    """The folders that cut_lineage writes within this scope."""
    noted: list[str] = []
    _noting.append(noted)
    try:
        yield noted
    finally:
        _noting.pop()


def discard(spark: SparkSession, folders: Iterable[str], but: DataFrame | None = None) -> list[str]:
    """Delete folders, save those that `but` still reads; returns the ones that stay. A folder that is gone is no error."""
    read = but.inputFiles() if but is not None else []
    stay = [f for f in folders if any(f"/{Path(f).name}/" in x for x in read)]
    for folder in set(folders) - set(stay):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return stay
