"""Intermediate tables in shared storage, for plans that are read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it; a session without one uses a sub-folder of its table
    storage (``spark.sql.warehouse.dir``). Spark's own default for that is a folder of the
    driver's machine, which executors elsewhere cannot read: on a cluster it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    one_machine = spark.conf.get("spark.master", "local").split("[")[0] == "local"
    if not one_machine and warehouse.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_intermediate"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to shared storage and read back.

    Cuts the lineage, survives lost executors, and (unlike an RDD checkpoint) keeps column
    pruning and size estimates for the readers.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files below a frame that ``materialize`` returned, once nothing reads them."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    jvm = spark.sparkContext._jvm
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if path.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
