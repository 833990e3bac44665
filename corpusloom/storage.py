"""Shared storage: where written tables go, cutting lineage by writing them, and clearing them away."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is on this machine, as in tests, is a temporary folder made
    and set; on a cluster that would be a different folder on every machine, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table or archive set."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that its lineage is cut."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read any more; others are left alone."""
    for table in tables:
        path = table.__dict__.pop("_written", None)
        if path is not None:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark knows for it."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where a scan gives fewer.

    A small file, or one of a single row group, is one task, whatever is computed on it. A table of
    many files has more tasks than cores, and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain local path; s3a and s3n are read as s3."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
