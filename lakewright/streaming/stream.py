"""File streams that land each file once, and merges of each micro-batch by key.

A landing commit carries two things that make it happen once.  A mark (identity of the stream, number of the
batch) stands in the same log entry as the rows, so a batch that is tried again after its commit does nothing; the
identity is that of the checkpoint, so another stream, or the same one with a new checkpoint, counts
for itself.  And a manifest part names the files that landed, so a stream that begins anew skips them.

Late data is never dropped here: a batch merges into the table by key, whatever its age.
Watermarks only serve windowed aggregates, where state must be bounded.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewright.operators.dedupe import dedupe_latest
from lakewright.sources.bronze import FILE_COLUMNS, FILES, decorate, manifest_of, one_path, stage_landing
from lakewright.sources.tablestore import Table


def land_stream(spark: SparkSession, source: str, path: str, schema: str, fmt: str, table: Table, checkpoint: str, key: Sequence[str] = (), pattern: str = r"dt=([0-9]{4}-[0-9]{2}-[0-9]{2})") -> StreamingQuery:
    """Every file under path once: rows to the table, rejects to its quarantine part, files to its manifest part."""
    meta = {"_source_file": F.col("_metadata.file_path")} | {c: F.col(f"_metadata.{m}") for c, m in FILE_COLUMNS.items()}
    rows = spark.readStream.format(fmt).schema(schema).option("header", "true").option("recursiveFileLookup", "true").load(path).withColumns(meta)

    def land(batch: DataFrame, number: int) -> None:
        mark = (f"{source}:{stream_id(spark, checkpoint)}", number)
        last = table.marked(mark[0])
        if last is not None and last >= number:
            return
        if table.has(FILES):
            done = table.read(part=FILES).where(F.col("source_name") == source)
            known = [F.col("file_path") == one_path("_source_file"), F.col("file_size") == F.col("_file_size"), F.col("file_modified_at") == F.date_trunc("second", "_file_modified_at")]
            batch = batch.join(done, known, "left_anti")
        now, name = dt.datetime.now(dt.UTC), f"{mark[0]}:{number}"
        staged, _ = stage_landing(table, decorate(batch, source, name, pattern, now), key)
        files = table.stage_part(manifest_of(table, staged, source, name, pattern, now), FILES)
        table.add([staged, files], mark)

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that a checkpoint gives its stream, the same for every run from it."""
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()
    return json.loads("".join(r["value"] for r in lines))["id"]


def merge_stream(rows: DataFrame, table: Table, keys: Sequence[str], latest: Sequence[Column | str], checkpoint: str, deleted: Column | None = None, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Keyed merge of a stream: each micro-batch is reduced to the newest row per key, compared with the
    table's by the same order, and merged.  Trying a batch again changes nothing."""
    order = [c if isinstance(c, str) else None for c in latest]

    def apply(batch: DataFrame, _: int) -> None:
        new = shape(batch)
        if new.isEmpty():
            return
        newest = dedupe_latest(new, keys, latest)
        if table.exists() and all(order):
            held = table.read().select(*keys, F.struct(*order).alias("_held"))
            newest = newest.join(held, list(keys), "left").where(F.col("_held").isNull() | (F.struct(*order) >= F.col("_held"))).drop("_held")
        table.merge(newest, keys, deleted)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, at: str, keys: Sequence[str], size: str = "1 hour", late: str = "60 days") -> DataFrame:
    """Counts per key and tumbling window of event time; state older than `late` is let go."""
    return rows.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"))
