"""Session defaults, and the shared folder in which long plans are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or where that is unset and Spark runs in one process a temporary one.

    A cluster must name the folder; without it this raises, since a folder of one machine would lose what others write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        atexit.register(shutil.rmtree, folder[len("file://"):], True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which ends its lineage.

    The copy outlives any executor, keeps column pruning for what reads it, and tells its row count from file footers.
    It lies in a folder of this application, which :func:`clear_cuts` deletes.
    """
    spark = df.sparkSession
    path = f"{_cuts_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cuts_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/kgloom-{spark.sparkContext.applicationId}"


def clear_cuts(spark: SparkSession) -> bool:
    """Deletes all tables this application has cut; to be called once results that were made from them are written or collected."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_cuts_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import os
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kgloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "kgloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for place, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(place, name)
                z.write(full, os.path.join("kgloom", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
