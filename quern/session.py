"""Spark session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` adds or overrides settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one process may be all there is (local mode, as in tests): then it is a temporary folder. On a
    cluster there is no folder to fall back on, and this raises.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
    local = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends here and survives lost executors.

    A table that is not discarded before is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    # Small row groups: a writer holds one in memory, and texts are long.
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    _folder(spark, path).deleteOnExit(_hadoop_path(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def written_together(**tables: DataFrame) -> list[DataFrame]:
    """Tables that do not depend on each other, planned and written at the same time."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda item: written(item[1], item[0]), tables.items()))


def local(df: DataFrame) -> DataFrame:
    """A table whose size the configuration bounds (calendar days, ranked accounts), as rows within the plans that use it."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str):
    """The file system of a path."""
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of `written` that nothing reads any more; anything else is left alone."""
    for t in tables:
        if path := getattr(t, "_quern_path", None):
            _folder(t.sparkSession, path).delete(_hadoop_path(t.sparkSession, path), True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that have been written and are no longer referred to.

    Spark does so when the driver's garbage is collected; between large shuffles on a cluster that need not be left to
    chance. The JVM hears of references that Python dropped from a thread that looks for them once a second. In local
    mode, where nothing is large, there is no wait.
    """
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers anywhere can import it."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quern-ship-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"quern-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    context._quern_shipped = True
