"""Shared scratch space: intermediate tables that outlive a lost executor.

Long plans are cut by writing a Parquet table below the folder the cluster
names in ``spark.checkpoint.dir``. Only where that setting is absent and the
master is local (tests on one machine) a local folder is made and set; on a
cluster its absence is an error, for executors would write to their own disks.
"""

from __future__ import annotations

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tallymark.session import scratch_path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one call; each goes by its name once nothing reads it any more.

    Tables that the lazy result reads stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_path(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the table ``name`` and read it back, cutting its lineage."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables of which no later step reads anything."""
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in whichever Hadoop file system holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(jpath) if f.isDirectory()] if files.exists(jpath) else []


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder, unless ``target`` exists: then False and nothing changes."""
    fs = spark._jvm.org.apache.hadoop.fs
    jsource, jtarget = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(jtarget.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(jsource, jtarget, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from lists, numpy arrays or Arrow arrays."""
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
