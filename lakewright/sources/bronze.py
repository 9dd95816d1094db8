"""Landing: files as they come, once each, with metadata, quarantine and drift audit.

Everything that identifies a file comes from Spark's ``_metadata`` columns, so landing zones
may be in any store.  One pass over the new files writes rows and rejects side by side and counts them;
the manifest counts each file's rows from what was written.  Rows, rejects, manifest and audit
are parts of one table commit: a landing that stops anywhere before it has landed nothing, and the
next one takes the same files again; two at once cannot both commit.
"""

from __future__ import annotations

import argparse
import csv
import datetime as dt
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.operators.dedupe import record_hash
from lakewright.sources.evolution import changes
from lakewright.sources.registry import Registry, Source, declarations, in_sync, load
from lakewright.sources.tablestore import DATA, Part, Staged, Table

METADATA = ("_ingested_at", "_source_file", "_batch_id", "_record_hash", "_source_name", "_batch_date")
CORRUPT = "_corrupt_record"

MANIFEST = "source_name string, file_path string, file_size long, file_modified_at timestamp, batch_id string, batch_date date, row_count long, quarantined_count long, ingested_at timestamp, status string"
SCHEMA_AUDIT = "source_name string, batch_id string, added_columns string, removed_columns string, changed_types string, previous_column_count long, new_column_count long, detected_at timestamp"
#: What a landed row tells of its file, beside its path; written with the rows, not part of their schema.
FILE_COLUMNS = {"_file_size": "file_size", "_file_modified_at": "file_modification_time"}
#: Stores from which tasks can read a file's first line by themselves.
_OPENED = ("file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss")


@dataclass(frozen=True)
class Landed:
    source: str
    status: str
    rows: int = 0
    quarantined: int = 0
    added: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    #: ``name: old type > new type`` of columns whose type changed.
    changed: tuple[str, ...] = ()


def batch_id(now: dt.datetime | None = None) -> str:
    return f"{(now or dt.datetime.now(dt.UTC)):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def quarantine_reason(columns: Sequence[str], key: Sequence[str]) -> Column:
    """Why a row must not land: it could not be parsed, or a present key column is blank; else null."""
    blank = [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in key if k in columns]
    reason = F.when(reduce(Column.__or__, blank), "missing_primary_key") if blank else F.lit(None).cast("string")
    return F.when(F.col(CORRUPT).isNotNull(), "unparseable_record").otherwise(reason) if CORRUPT in columns else reason


def files_of(spark: SparkSession, source: Source, landing: str) -> DataFrame:
    """path, size and modification time (whole seconds) of the files the source's pattern matches; the file
    system itself reads wildcards and ``{a,b}`` choices."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{landing.rstrip('/')}/{source.path}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    # Paths as Spark's file metadata tells them.
    there = [(re.sub("^file:/+", "file:/", s.getPath().toUri().toString()), s.getLen(), dt.datetime.fromtimestamp(s.getModificationTime() // 1000, dt.UTC)) for s in found or [] if s.isFile()]
    return spark.createDataFrame(sorted(there), "file_path string, file_size long, file_modified_at timestamp")


def _first_lines(batches):
    """(path, first line) of each file, read by a task."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch["path"]:
            uri = path.replace("s3a://", "s3://", 1)
            store, place = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            line = b""
            with store.open_input_stream(place, compression=None) as stream:
                while b"\n" not in line and (more := stream.read(1 << 14)):
                    line += more
            out.append(line.split(b"\n", 1)[0].decode("utf-8", "replace"))
        yield batch.assign(header=out)


def headers_of(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The files of each first line; the driver opens none."""
    scheme = paths[0].split(":", 1)[0] if ":" in paths[0] else "file"
    if scheme in _OPENED:
        there = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 256))
        found = there.mapInPandas(_first_lines, "path string, header string")
    else:
        lines = spark.read.text([_plain(p) for p in paths]).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
        found = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("header"))
    groups = found.groupBy(F.rtrim(F.regexp_replace("header", "\r$", "")).alias("header")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {r["header"]: r["paths"] for r in groups.collect()}


def _plain(path: str) -> str:
    """A path as readers take it, from the form in which file metadata tells it."""
    return unquote(path)


def _read(spark: SparkSession, source: Source, paths: Sequence[str]) -> DataFrame:
    """All columns as strings.  CSV files are read per header, as one header rules a read."""
    meta = [F.col("_metadata.file_path").alias("_source_file"), *(F.col(f"_metadata.{m}").alias(c) for c, m in FILE_COLUMNS.items())]
    options = {"mode": "PERMISSIVE", "encoding": "UTF-8"} | dict(source.reader_options)
    if source.format == "json":
        # Two passes, so that the same batch always has the same columns: names first, then strings.
        lines = spark.read.text([_plain(p) for p in paths]).select(*meta, "value")
        names = lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
        columns = sorted(r["k"] for r in names.collect())
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
        parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
        return parsed.where(F.trim("value") != "").select("r.*", "_source_file", *FILE_COLUMNS)
    frames = []
    for header, group in sorted(headers_of(spark, paths).items()):
        first = next(csv.reader([header.lstrip("\ufeff")], delimiter=options.get("sep", ",")), [])
        schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in [*first, CORRUPT]])
        read = spark.read.options(**options | {"header": "true", "columnNameOfCorruptRecord": CORRUPT, "enforceSchema": "true"}).schema(schema)
        frames.append(read.csv([_plain(p) for p in group]).select("*", *meta))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def decorate(df: DataFrame, source: str, batch: str, pattern: str, now: dt.datetime) -> DataFrame:
    """Adds the metadata columns; the hash covers the business columns by name."""
    business = sorted(c for c in df.columns if c not in METADATA and c not in FILE_COLUMNS and c != CORRUPT)
    day = F.regexp_extract("_source_file", pattern, 1)
    return df.withColumns(
        {"_record_hash": record_hash(business), "_ingested_at": F.lit(now), "_batch_id": F.lit(batch), "_source_name": F.lit(source), "_batch_date": F.try_to_date(F.nullif(day, F.lit("")))}
    )


def stage_landing(table: Table, rows: DataFrame, key: Sequence[str], partition_by: Sequence[str] = ()) -> tuple[Staged, list[str]]:
    """Decorated rows written once, good ones and rejects side by side, and the columns of the good ones."""
    columns = [c for c in rows.columns if c != CORRUPT and c not in FILE_COLUMNS]
    marked = rows.withColumn("_quarantine_reason", quarantine_reason(rows.columns, key))
    refused = F.col("_quarantine_reason").isNotNull()
    by = [c for c in partition_by if c in columns]
    rejects = [c for c in marked.columns if c not in FILE_COLUMNS]
    return table.stage(marked, {DATA: (~refused, columns), QUARANTINE: (refused, rejects)}, by), columns


def one_path(path: str) -> Column:
    """A file's path in the one form that manifests have; local paths are told with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def manifest_of(table: Table, staged: Staged, source: str, batch: str, pattern: str, now: dt.datetime, files: DataFrame | None = None) -> DataFrame:
    """The manifest rows of staged files: rows and rejects counted from what was written; `files` (path, size, modification
    time) adds those without a row."""
    written = T.StructType([T.StructField("_source_file", T.StringType()), T.StructField("_file_size", T.LongType()), T.StructField("_file_modified_at", T.TimestampType()), T.StructField("_quarantine_reason", T.StringType())])
    per_file = [one_path("_source_file").alias("file_path"), F.col("_file_size").alias("file_size"), F.date_trunc("second", "_file_modified_at").alias("file_modified_at")]
    counted = table.read_staged(staged, written).groupBy(*per_file).agg(F.count_if(F.col("_quarantine_reason").isNull()).alias("row_count"), F.count_if(F.col("_quarantine_reason").isNotNull()).alias("quarantined_count"))
    if files is not None:
        counted = files.join(counted.drop("file_size", "file_modified_at"), "file_path", "left").fillna(0, ["row_count", "quarantined_count"])
    day = F.regexp_extract("file_path", pattern, 1)
    out = counted.withColumns({"source_name": F.lit(source), "batch_id": F.lit(batch), "batch_date": F.try_to_date(F.nullif(day, F.lit(""))), "ingested_at": F.lit(now), "status": F.lit("INGESTED")})
    wanted = T.StructType.fromDDL(MANIFEST)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])


QUARANTINE, FILES, AUDIT = "quarantine", "manifest", "audit"


class Bronze:
    """The landing tables under one folder.  A source's table holds its rejects, its manifest and its schema audit as parts."""

    def __init__(self, spark: SparkSession, registry: Registry) -> None:
        self.spark, self.registry = spark, registry
        tables = tuple(self.table(s.name) for s in registry.sources)
        self.manifest = Part(tables, FILES, MANIFEST)
        self.audit = Part(tables, AUDIT, SCHEMA_AUDIT)

    def table(self, name: str) -> Table | Part:
        """A source's table, or as ``<source>__quarantine`` its rejects."""
        own = Table(self.spark, f"{self.registry.bronze.rstrip('/')}/{name.removesuffix('__quarantine')}")
        return Part((own,), QUARANTINE, "_quarantine_reason string") if name.endswith("__quarantine") else own

    def new_files(self, source: Source) -> tuple[DataFrame, bool]:
        """Files not yet landed (by path, size and second of change), and whether there are any at all."""
        there = files_of(self.spark, source, self.registry.landing)
        if there.isEmpty():
            return there, False
        table = self.table(source.name)
        if table.has(FILES):
            done = table.read(part=FILES).where((F.col("source_name") == source.name) & (F.col("status") == "INGESTED"))
            there = there.join(done, ["file_path", "file_size", "file_modified_at"], "left_anti")
        return there, True

    def ingest(self, name: str, batch: str | None = None, now: dt.datetime | None = None) -> Landed:
        """Land a source's new files: INGESTED, UP_TO_DATE or NO_FILES."""
        source, now = self.registry[name], now or dt.datetime.now(dt.UTC)
        batch, target = batch or batch_id(now), self.table(name)
        version = target.version() if target.exists() else None  # before the files are looked for, so that what lands meanwhile is a conflict
        new, any_files = self.new_files(source)
        files = sorted(new.collect())
        if not files:
            return Landed(name, "UP_TO_DATE" if any_files else "NO_FILES")
        rows = decorate(_read(self.spark, source, [f["file_path"] for f in files]), name, batch, self.registry.batch_date_from_path, now)
        staged, columns = stage_landing(target, rows, source.primary_key, source.partition_by)
        listed = self.spark.createDataFrame(files, new.schema)
        parts = [staged, target.stage_part(manifest_of(target, staged, name, batch, self.registry.batch_date_from_path, now, listed).coalesce(1), FILES)]
        before = T.StructType.fromJson(json.loads(version.schema)) if version else None
        drift = changes(before, staged.schemas[DATA]) if before is not None else ((), (), ())
        if any(drift):
            told = (name, batch, *(",".join(d) for d in drift), len(before.names), len(columns), now)
            parts.append(target.stage_part(self.spark.createDataFrame([told], SCHEMA_AUDIT).coalesce(1), AUDIT))
        target.add(parts, after=version.number if version else -1)
        return Landed(name, "INGESTED", staged.rows[DATA], staged.rows[QUARANTINE], *drift)

    def ingest_all(self, only: Sequence[str] | None = None, batch: str | None = None) -> list[Landed]:
        batch = batch or batch_id()
        return [self.ingest(s.name, batch) for s in self.registry.sources if not only or s.name in only]

    def assert_reachable(self) -> None:
        """Raises unless something has landed under the configured folder."""
        if not self.manifest.exists():
            raise RuntimeError(f"nothing has landed under {self.registry.bronze!r}: land the sources first, or set LAKEHOUSE_BRONZE or defaults.bronze to the folder they landed in")

    def read(self, name: str) -> DataFrame:
        """A landing table.  A source of which no file came yet is an empty frame of the metadata
        columns; if nothing landed at all, or the name is not declared, it raises."""
        self.assert_reachable()
        self.registry[name.removesuffix("__quarantine")]
        table = self.table(name)
        if table.exists():
            return table.read()
        return self.spark.createDataFrame([], "_ingested_at timestamp, _source_file string, _batch_id string, _record_hash string, _source_name string, _batch_date date")

    def register(self, database: str = "bronze") -> list[str]:
        """Catalog entries for all landed tables; rejects and manifest are read through this class."""
        landed = [s.name for s in self.registry.sources if self.table(s.name).exists()]
        return [self.table(n).register(database, n) for n in landed]

    def quarantine_reasons(self) -> DataFrame:
        """Refused rows per source and reason."""
        refused = [(s.name, self.table(f"{s.name}__quarantine")) for s in self.registry.sources]
        counts = [t.read().groupBy(F.lit(n).alias("source_name"), F.col("_quarantine_reason").alias("reason")).agg(F.count("*").alias("rows")) for n, t in refused if t.exists()]
        return reduce(DataFrame.unionByName, counts) if counts else self.spark.createDataFrame([], "source_name string, reason string, rows long")

    def inspect(self) -> DataFrame:
        """Rows landed and refused per source and batch."""
        return self.manifest.read().groupBy("source_name", "batch_id").agg(F.count("*").alias("files"), F.sum("row_count").alias("rows"), F.sum("quarantined_count").alias("quarantined"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Land new files of declared sources.")
    parser.add_argument("--config", required=True)
    parser.add_argument("--source", action="append", help="land only this source (may be repeated)")
    parser.add_argument("--batch-id")
    parser.add_argument("--list-sources", action="store_true")
    parser.add_argument("--declarations", metavar="FILE", help="write source declarations, or with --check say whether FILE is in sync")
    parser.add_argument("--check", action="store_true")
    given = parser.parse_args(args)
    registry = load(given.config)
    if given.list_sources:
        for s in registry.sources:
            print(f"{s.name}\t{s.format}\t{s.path}")
        return 0
    if given.declarations:
        if given.check:
            same = in_sync(given.declarations, registry)
            print("in sync" if same else f"{given.declarations} differs from {given.config}")
            return int(not same)
        Path(given.declarations).write_text(declarations(registry), encoding="utf-8")
        return 0
    from lakewright.session import build_session

    for r in Bronze(build_session(), registry).ingest_all(given.source, given.batch_id):
        print(f"{r.source}\t{r.status}\t{r.rows} rows\t{r.quarantined} quarantined")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
