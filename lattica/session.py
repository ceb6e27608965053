"""What jobs ask of the cluster: the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only on a local master a temporary one will do where that is unset; on a cluster it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs only its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of one call in the shared folder, for iterations.

    A plan that reads one starts anew: a checkpoint would carry what the planner knows about its columns from round to round, and that
    grows until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._n = spark, f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", 0

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a stored table of this call."""
        self._n += 1
        return self._written(df, f"{self.folder}/{self._n}")

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that stays; the call's others go, in one step."""
        out = self._written(df, f"{self.folder}-result")
        self.spark.range(0).write.mode("overwrite").parquet(self.folder)
        return out
