"""Cutting of lineage in loops, by tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where set, else (in local runs) a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and read from there: no executor holds what a later step needs, and a
    step reads only the columns that it uses."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """What is planned within is shuffled into n partitions, none of them merged."""
    put = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """df, written once in n buckets of a column, so that joins by it with others of n buckets shuffle nothing."""
    spark = df.sparkSession
    name = f"quern_cut_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `cut` or `dealt` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            if path.getName().startswith("quern_cut_"):
                spark.sql(f"DROP TABLE IF EXISTS {path.getName()}")
