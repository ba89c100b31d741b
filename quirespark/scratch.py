"""Tables between the steps of a job, in the folder that all executors reach: the one named in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI; the warehouse, or in local mode a temporary folder, where the setting is
    missing. A path without a scheme lies in Hadoop's default file system, as it does for Spark."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return _qualified(spark, named).rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="quirespark-")
        return _OWN["dir"]
    return _qualified(spark, spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/_quirespark"


def located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _qualified(spark: SparkSession, path: str) -> str:
    at, store = located(spark, path)
    return store.makeQualified(at).toString()


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and outlives lost executors. by: a column of few values,
    whose rows are written apart, so that a filter on it reads only theirs."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found = found.select(*df.columns) if by else found
    found._scratch_path = path
    return found


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` gave, once nothing reads them any more; others are left alone."""
    for df in tables:
        if "_scratch_path" in df.__dict__:
            at, store = located(df.sparkSession, df._scratch_path)
            store.delete(at, True)
