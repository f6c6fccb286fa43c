"""Helpers shared by the operators of this subpackage.

Computed arrays are exploded with the outer variants throughout: for the others the
optimizer infers a filter on the array's size, pushes it below the projections and so
computes the array again, inside lambdas even once per element.
"""

from __future__ import annotations

import re
import tempfile
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of one key that a join gathers in a task, and keys that it may broadcast.
OFTEN, BROADCAST_KEYS = 4096, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the setting is missing a master of one machine gets a temporary folder, with a
    warning; any other master is refused, since its executors could not read that folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if where is None and current.isDefined():
        where = current.get()
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        warnings.warn(f"spark.checkpoint.dir is not set; {where} serves this machine alone", stacklevel=2)
    if current.isEmpty():
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def split_join(rows: DataFrame, info: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Inner join on ``keys``; ``info`` has unique keys and, in ``n``, how many of ``rows`` hold each.

    Keys of more than max(OFTEN, sum of n / BROADCAST_KEYS) rows are joined apart by
    broadcast, so no task gathers them; by their definition there are at most
    BROADCAST_KEYS of these, whatever the input's size.
    """
    total = info.agg(F.sum(n)).first()[0] or 0
    often = info.where(F.col(n) > max(OFTEN, total / BROADCAST_KEYS))
    if often.isEmpty():
        return rows.join(info, keys)
    often = F.broadcast(often)
    cold = rows.join(often.select(*keys), keys, "left_anti").join(info.where(F.col(n) <= max(OFTEN, total / BROADCAST_KEYS)), keys)
    return cold.unionByName(rows.join(often, keys).select(*cold.columns))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row; equal ids with different texts stay apart, repeated rows coincide."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\x00")), text)
