"""Session helpers: settings that suit these jobs, and cutting lineage through shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "flowlens") -> SparkSession:
    """A session for tests and benchmarks on one machine. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it, else a
    folder below the warehouse, which they share as well. Everything of one application lies below one
    folder, so that it can be removed when the application is over."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """The path of a shared folder that nothing else uses. It is not made yet."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def store(df: DataFrame) -> str:
    """Write a DataFrame as Parquet to the shared folder; its path. Runs a job."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and go on from the stored table. Runs a job."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, so that functions run there
    find their module whether or not it is installed on the executors."""
    sc = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _shipped or not os.path.isdir(here):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-package-"), "flowlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(here), os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
