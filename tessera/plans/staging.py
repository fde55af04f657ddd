"""Tables written between the steps of a job, in the folder that the whole cluster shares.

A staged table cuts the lineage as a checkpoint does, and survives the loss of
executors, because it lies in ``spark.checkpoint.dir``.  Only where a session
names no such folder (local tests) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-staging-")
        else:
            _LOCAL[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    return _LOCAL[app]


class Staging:
    """The staged tables of one job.

    ``keep(df, name)`` writes ``df`` as Parquet and returns it reread;
    ``drop(name)`` deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
