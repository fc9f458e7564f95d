"""Where intermediate tables go, and how lineage is cut by storing them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset, one below the warehouse. A folder on the
    driver's own disk is refused unless the session runs on that machine alone."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        if not sc.master.startswith("local") and root.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path (not created yet) below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise an expensive stage once as Parquet and read it back (statistics and pruning come with it)."""
    path = new_folder(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored stage that nothing reads any more (a superseded step of an iteration)."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = shared_root(df.sparkSession)
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
            path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A stored copy: survives the loss of any executor, knows its size, and is computed once (a reliable checkpoint of
    an uncached frame computes it twice)."""
    return stage(df, "lineage")
