"""What iterative plans need of Spark: cut lineage, and joins whose skew can be split."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, which all executors share: spark.checkpoint.dir.

    A session on one machine (master local) that names none gets a temporary folder; on a cluster that is an error, since
    executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's folder.

    Spark removes the files of checkpoints that are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    folder(df.sparkSession)
    return df.checkpoint()


def unbound(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with keys (integers, strings or binary) that are expressions no exchange below is known to be partitioned by.

    A join of an aggregate to the rows that it was made of would otherwise take over the aggregate's exchange; given one of its
    own on both sides, adaptive execution can split a key that holds many rows.
    """

    def same(key: str) -> Column:
        kind = df.schema[key].dataType
        if isinstance(kind, T.BinaryType):
            return F.unhex(F.hex(key))
        return F.reverse(F.reverse(key)) if isinstance(kind, T.StringType) else F.bitwise_not(F.bitwise_not(key))

    return df.withColumns({k: same(k) for k in keys})
