"""Session set-up and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = "outcomelens-cut"
_SHIPPED: set[str] = set()


def get_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, the command line and the bench; on a cluster the submitter's session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("outcomelens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepared(spark: SparkSession) -> SparkSession:
    """All operators read wall-clock columns as UTC, whatever the session was started with; and the Python workers must
    find this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship(spark)
    return spark


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def _ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application. A path that only the driver has helps none of them; on a
    local master they inherit it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    here = root in map(Path, [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()])
    if (here and _local(spark)) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="outcomelens-code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/outcomelens", "zip", root, "outcomelens"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, or the checkpoint directory that is set; on a local
    master else one set here. Anywhere else a missing folder is an error: tables would be written to one machine each."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not known and not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="outcomelens-"))
    return known or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read from there: many readers, one computation, and a lost
    executor costs no more than reading again. Columnar, so it is smaller than the checkpoint of the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{TABLES}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete the tables that this application cut; call it when their readers are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{TABLES}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
