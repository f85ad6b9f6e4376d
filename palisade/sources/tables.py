"""Tables in the folder that all executors share, to cut the lineage of what is made in rounds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only sessions of one process without the setting, as in tests, get a folder made for them."""
    context = spark.sparkContext
    if folder := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
    return context.getCheckpointDir()


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs its tasks, not the rounds before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`settled` once all that is made from them is written itself, and lets Spark delete the shuffle files that went into it."""
    for df in tables:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
    swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written by now, which it does once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
