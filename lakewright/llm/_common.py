"""Helpers shared by the operators: table access, checkpoints, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (8-byte key, small payload) up to which a side may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session of one JVM (tests) takes a temporary folder; a cluster,
    whose machines would not see it, raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: as `cut`, but columnar and compressed."""
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it is proven to hold at most limit rows, else as it is.

    Beyond the limit Spark shuffles both sides, so no case is lost.
    """
    n = small.limit(limit + 1).count()
    return F.broadcast(small) if n <= limit else small.hint("shuffle_merge")


def crc_bucket(doc_id: Column) -> Column:
    """crc32 of the decimal text of doc_id, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


#: Rows of an Arrow batch between the JVM and Python: whole documents, so a thousand are megabytes.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_ROWS rows, unless the session asks for fewer.

    The default of 10000 would put tens of megabytes of text into each of the buffers that
    every task holds on both sides.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(f, schema)
