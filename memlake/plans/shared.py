"""Tables that cut lineage, written where every executor can read them.

``SharedStage`` writes Parquet under the folder named by
``spark.checkpoint.dir``.  Only a purely local session (``local[...]``) may run
without that setting; it then uses a folder under the system's temp folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session (see the module's text)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        root = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


class SharedStage:
    """One fresh folder of written tables; ``put`` writes and rereads a DataFrame."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/memlake/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{name}-{self._n:03d}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.shared_path = where
        return out

    @staticmethod
    def stands(df: DataFrame) -> bool:
        """Whether a table of ``put`` is still in the shared folder."""
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{df.shared_path}/_SUCCESS")
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``put`` that nothing reads any more."""
        where = getattr(df, "shared_path", None)
        if where:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
