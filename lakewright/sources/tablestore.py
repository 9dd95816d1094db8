"""A versioned table store on Parquet.

A table is a folder: ``_log/<version>.json`` lists the data folders of a version (for a
partitioned table, the partitions of each write), and data folders are written once and
never changed.  Merges and deletes write anew only the folders that hold a row they touch;
the others stay listed as they are.  A commit creates the next log file
exclusively, so of two writers one fails and no reader sees half a write.  All access
goes through Hadoop's file system, so any store Spark can write will do; creation without
overwriting must be atomic there, as it is on HDFS and local disks.

A commit may hold more than rows.  Companion parts (rejects, a manifest of files, an audit) are tables of their own
under the same log entry, so that they change with the rows or not at all.  Marks name the writer
of a commit and its number: a write with a mark that the log has already is not done again.

Columns may change their type from commit to commit.  Each folder keeps the schema it was written with;
the table's is the least that holds all (`evolution`), as which every folder is read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.operators.merge import merge_upsert
from lakewright.operators.scd2 import scd2_apply
from lakewright.sources.evolution import changes, read_as, widened

DATA = "data"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Version:
    number: int
    timestamp: str
    operation: str
    files: tuple[str, ...]
    metrics: dict
    #: Schema (JSON) of each data folder, so that reading asks no footers.
    schemas: dict[str, str]
    #: Schema (JSON) of the table, and its partition columns.
    schema: str
    partition_by: tuple[str, ...]
    #: Companion parts by name: (schema of each folder, schema of the part).
    parts: dict[str, tuple[dict[str, str], str]] = field(default_factory=dict)
    #: The number of the last write of each marked writer.
    marks: dict[str, int] = field(default_factory=dict)

    def part(self, name: str) -> tuple[dict[str, str], str]:
        return (self.schemas, self.schema) if name == DATA else self.parts[name]


@dataclass(frozen=True)
class Staged:
    """Folders that are written, and that no version lists yet: of each part its folders' schemas and rows."""

    folders: dict[str, dict[str, str]]
    rows: dict[str, int]
    #: Schema of each part, folders or not.
    schemas: dict[str, T.StructType]
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Part:
    """A companion part of one or more tables, read as one."""

    tables: tuple[Table, ...]
    name: str
    schema: str

    def exists(self) -> bool:
        return any(t.has(self.name) for t in self.tables)

    def read(self) -> DataFrame:
        there = [t.read(part=self.name) for t in self.tables if t.has(self.name)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there) if there else self.tables[0].spark.createDataFrame([], self.schema)


class Table:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    # ------------------------------------------------------------ log

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        log = self._Path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        known = self.versions()
        if number is None:
            number = known[-1] if known else -1
        if number not in known:
            raise ValueError(f"{self.path} has no version {number}; known: {known}")
        stream = self._fs.open(self._Path(f"{self.path}/_log/{number:08d}.json"))
        try:
            d = json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()
        parts = {k: (p["schemas"], p["schema"]) for k, p in d.get("parts", {}).items()}
        return Version(number, d["timestamp"], d["operation"], tuple(d["files"]), d["metrics"], d["schemas"], d["schema"], tuple(d["partition_by"]), parts, d.get("marks", {}))

    def history(self) -> DataFrame:
        """version, timestamp, operation and metrics (JSON), newest first."""
        rows = [(v.number, v.timestamp, v.operation, json.dumps(v.metrics, sort_keys=True)) for v in map(self.version, reversed(self.versions()))]
        return self.spark.createDataFrame(rows, "version int, timestamp string, operation string, metrics string")

    def _commit(self, old: Version | None, operation: str, files: dict[str, str], metrics: dict, schema: T.StructType, partition_by: Sequence[str], parts: dict | None = None, marks: dict | None = None) -> Version:
        """The version after `old`; parts and marks stay as they are unless given."""
        base = old.number if old else -1
        parts, marks = (old.parts if old else {}) if parts is None else parts, (old.marks if old else {}) | (marks or {})
        entry = {"timestamp": dt.datetime.now(dt.UTC).isoformat(), "operation": operation, "files": list(files), "metrics": metrics, "schemas": files, "schema": schema.json(), "partition_by": list(partition_by)}
        entry |= {"parts": {k: {"schemas": f, "schema": kind} for k, (f, kind) in parts.items()}, "marks": marks}
        try:
            out = self._fs.create(self._Path(f"{self.path}/_log/{base + 1:08d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {base + 1} of {self.path} exists already") from e
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        return self.version(base + 1)

    def _write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> tuple[dict[str, str], int]:
        """The data folders written, one for each partition, with their schema, and the number of rows, counted in passing."""
        staged = self.stage(df, partition_by=partition_by)
        return staged.folders[DATA], staged.rows[DATA]

    def stage(self, df: DataFrame, parts: Mapping[str, tuple[Column, Sequence[str]]] | None = None, partition_by: Sequence[str] = ()) -> Staged:
        """Write df once, its rows dealt to parts: of each part the condition (the first that holds counts) and
        the columns.  Without parts all goes to one.  Nothing is part of the table until it is committed."""
        name, seen = f"data/_commit=c{uuid.uuid4().hex}", Observation()
        # Every folder has both levels, so that any of them can be read together.
        if parts is None:
            name += f"/_part={DATA}"
            schemas, levels = {DATA: df.schema}, list(partition_by)
            df = df.observe(seen, F.count(F.lit(1)).alias(DATA))
        else:
            schemas = {k: T.StructType([df.schema[c] for c in columns]) for k, (_, columns) in parts.items()}
            dealt, levels = F.lit(None).cast("string"), ["_part", *partition_by]
            for k, (condition, _) in reversed(list(parts.items())):
                dealt = F.when(condition, F.lit(k)).otherwise(dealt)
            df = df.withColumn("_part", dealt).where("_part is not null")
            df = df.observe(seen, *[F.count(F.when(F.col("_part") == k, 1)).alias(k) for k in parts])
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*levels) if levels else writer).parquet(f"{self.path}/{name}")
        leaves = self._leaves(name, len(levels))
        of = lambda k: [f for f in leaves if parts is None or f.split("/")[2] == f"_part={k}"]
        return Staged({k: dict.fromkeys(of(k), kind.json()) for k, kind in schemas.items()}, {k: seen.get[k] for k in schemas}, schemas, tuple(partition_by))

    def stage_part(self, df: DataFrame, part: str) -> Staged:
        """Write df for one companion part."""
        staged = self.stage(df)
        return Staged({part: staged.folders[DATA]}, {part: staged.rows[DATA]}, {part: df.schema})

    def read_staged(self, staged: Staged, schema: T.StructType) -> DataFrame:
        """All rows of staged folders, of any part, with the columns of a schema that was written."""
        return self._folders({f: schema.json() for folders in staged.folders.values() for f in folders}, schema)

    def _leaves(self, name: str, depth: int) -> list[str]:
        """The folders `depth` levels below a data folder."""
        names = [name]
        for _ in range(depth):
            names = [f"{n}/{s.getPath().getName()}" for n in names for s in self._fs.listStatus(self._Path(f"{self.path}/{n}")) if s.isDirectory()]
        return sorted(names)

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None, part: str = DATA) -> DataFrame:
        """The newest or the given version: columns added over time are null where they were not yet, and
        columns whose type changed have the least type that holds all their values."""
        files, schema = self.version(version).part(part)
        return self._folders(files, T.StructType.fromJson(json.loads(schema)))

    def has(self, part: str) -> bool:
        return self.exists() and (part == DATA or part in self.version().parts)

    def _folders(self, files: dict[str, str], schema: T.StructType, marked: bool = False) -> DataFrame:
        """The rows of some folders as of a schema: one scan for each schema they were written with; marked
        tells each row's file in the column _file."""
        by_schema: dict[str, list[str]] = {}
        for name, kind in files.items():
            by_schema.setdefault(kind, []).append(f"{self.path}/{name}")
        out, file = None, [F.col("_metadata.file_path").alias("_file")] if marked else []
        for kind, paths in by_schema.items():
            had = T.StructType.fromJson(json.loads(kind))
            part = self.spark.read.schema(had).option("basePath", f"{self.path}/data").parquet(*paths).select(*read_as(had, schema), *file)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], schema)
            return out.withColumn("_file", F.lit("")) if marked else out
        return out

    def _folders_of(self, found: DataFrame, v: Version) -> list[str]:
        """The data folders of v that the rows of found (column _file) come from."""
        uri, path = self.spark.sparkContext._jvm.java.net.URI, self._Path
        start = f"{path(self.path).toUri().getPath()}/"
        there = {path(uri(r["_file"])).getParent().toUri().getPath().split(start, 1)[-1] for r in found.select("_file").distinct().collect()}
        return [f for f in v.files if f in there]

    def since(self, column: str, bound: object) -> DataFrame:
        """Rows whose column is at least a bound; of a table partitioned by it, older folders are not even opened."""
        return self.read().where(F.col(column) >= F.lit(bound))

    def holding(self, keys: Mapping[str, tuple[Column, DataFrame]]) -> tuple[DataFrame, int]:
        """The rows that have a key, and the number of files they stand in: two steps, so that what is read of a
        table follows the keys.  First only the keys' columns are read, for the files that hold one; then these files
        alone.  keys: for each name an expression over the table and a frame of one column with wanted values; a
        row is taken if any of its expressions is among the wanted."""
        v = self.version()
        schema = T.StructType.fromJson(json.loads(v.schema))

        def wanted(df: DataFrame) -> DataFrame:
            if len(keys) == 1:
                ((value, known),) = keys.values()
                return df.join(known.select(F.col(known.columns[0]).alias("_known")), value == F.col("_known"), "left_semi")
            for name, (value, known) in keys.items():
                df = df.withColumn(f"_is_{name}", value)
                df = df.join(known.select(F.col(known.columns[0]).alias(f"_known_{name}")).distinct(), F.col(f"_is_{name}") == F.col(f"_known_{name}"), "left")
            hit = reduce(Column.__or__, [F.col(f"_known_{name}").isNotNull() for name in keys])
            return df.where(hit).drop(*[f"{p}_{name}" for p in ("_is", "_known") for name in keys])

        files = [r["_file"] for r in wanted(self._folders(v.schemas, schema, marked=True)).select("_file").distinct().collect()]
        uri, path = self.spark.sparkContext._jvm.java.net.URI, self._Path
        root = path(self.path).toUri().getPath()
        of_folder = {f"{root}/{f}": kind for f, kind in v.schemas.items()}
        by_file = {}
        for f in files:
            place = path(uri(f))
            by_file[place.toUri().getPath()[len(root) + 1 :]] = of_folder[place.getParent().toUri().getPath()]
        return wanted(self._folders(by_file, schema)), len(files)

    # ------------------------------------------------------------ writing

    @contextmanager
    def scratch(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Gives a function that stores a frame as files beside the table and reads it from there, so that it is made once
        however often it is used and whichever executor is lost.  The files go at the end."""
        folder = f"{self.path}/_scratch/{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield keep
        finally:
            self._fs.delete(self._Path(folder), True)

    def marked(self, writer: str) -> int | None:
        """The number of the last committed write of a marked writer."""
        return self.version().marks.get(writer) if self.exists() else None

    def append(self, df: DataFrame, partition_by: Sequence[str] = (), mark: tuple[str, int] | None = None) -> Version:
        """Add rows.  With a mark (writer, number) whose number is committed already, nothing is written."""
        v = self.version() if self.exists() else None
        if mark and v and v.marks.get(mark[0], -1) >= mark[1]:
            return v
        by = tuple(c for c in (v.partition_by if v else tuple(partition_by)) if c in df.columns)
        return self.add([self.stage(df, partition_by=by)], mark)

    def add(self, staged: Sequence[Staged], mark: tuple[str, int] | None = None, after: int | None = None, tries: int = 5) -> Version:
        """Commit staged folders of rows and companion parts in one step.

        A writer that loses the race looks at the mark again and takes the next version, up to `tries` times; with
        `after` it may follow that version only (-1: be the first), and raises Conflict otherwise.
        """
        for left in range(tries, 0, -1):
            v = (self.version(after) if after >= 0 else None) if after is not None else self.version() if self.exists() else None
            if mark and v and v.marks.get(mark[0], -1) >= mark[1]:
                return v
            held = {DATA: (v.schemas, v.schema) if v else ({}, None)} | (v.parts if v else {})
            rows: dict[str, int] = {}
            retyped: list[str] = []
            for s in staged:
                for part, folders in s.folders.items():
                    rows[part] = rows.get(part, 0) + s.rows[part]
                    if not folders and part != DATA:
                        continue
                    new = s.schemas[part]
                    had, kind = held.get(part, ({}, None))
                    old = T.StructType.fromJson(json.loads(kind)) if kind else new
                    wide = widened(old, new)
                    retyped += [c for c in changes(old, wide)[2] if part == DATA]
                    held[part] = (had | folders, wide.json())
            files, schema = held.pop(DATA)
            by = v.partition_by if v else next((s.partition_by for s in staged if DATA in s.folders), ())
            metrics = {"rows_added": rows.get(DATA, 0)} | {f"{k}_rows": n for k, n in rows.items() if k != DATA} | ({"types_widened": retyped} if retyped else {})
            kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
            try:
                return self._commit(v, "APPEND", files, metrics, kind, by, held, {mark[0]: mark[1]} if mark else {})
            except Conflict:
                if after is not None or left == 1:
                    raise
        raise AssertionError("unreachable")

    def overwrite(self, df: DataFrame, operation: str = "OVERWRITE", partition_by: Sequence[str] | None = None, metrics: dict | None = None) -> Version:
        """df as the whole table, partitioned as before unless told otherwise."""
        v = self.version() if self.exists() else None
        by = tuple(partition_by) if partition_by is not None else tuple(c for c in v.partition_by if c in df.columns) if v else ()
        new, rows = self._write(df, by)
        return self._commit(v, operation, new, (metrics or {}) | {"rows": rows}, df.schema, by)

    def _replace(self, v: Version, operation: str, touched: Sequence[str], rows: DataFrame, parts: dict | None = None) -> Version:
        """v with the rows in place of the touched folders."""
        new, n = self._write(rows, v.partition_by)
        kept = {f: k for f, k in v.schemas.items() if f not in set(touched)}
        schema = widened(T.StructType.fromJson(json.loads(v.schema)), rows.schema)
        return self._commit(v, operation, kept | new, {"rows_written": n, "folders_kept": len(kept), "folders_replaced": len(touched)}, schema, v.partition_by, parts)

    def _with_file(self, v: Version) -> DataFrame:
        return self._folders(v.schemas, T.StructType.fromJson(json.loads(v.schema)), marked=True)

    def merge(self, source: DataFrame, keys: Sequence[str], deleted: Column | None = None) -> Version:
        """Upsert by key; see `merge_upsert`.  On a new table it is the first write.

        Only folders that hold a key of source are written anew; its new rows go with them.
        """
        if not self.exists():
            return self.overwrite(source if deleted is None else source.where(~F.coalesce(deleted, F.lit(False))), "MERGE")
        v = self.version()
        had = T.StructType.fromJson(json.loads(v.schema))
        wide = {f.name.lower(): f for f in widened(had, source.schema).fields}
        # A column whose type differs from the table's is compared and kept as the type that holds both.
        source = source.select(*read_as(source.schema, T.StructType([wide[c.lower()] for c in source.columns])))
        named = source.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
        same = reduce(Column.__and__, [F.col(k).cast(wide[k.lower()].dataType).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
        touched = self._folders_of(self._with_file(v).join(named, same, "left_semi"), v)
        held = self._folders({f: v.schemas[f] for f in touched}, T.StructType.fromJson(json.loads(v.schema)))
        held = held.select(*read_as(had, T.StructType([wide[c.lower()] for c in had.names])))
        return self._replace(v, "MERGE", touched, merge_upsert(held, source, keys, deleted))

    def replace_keys(self, source: DataFrame, key: str, affected: DataFrame) -> Version:
        """source in place of all rows whose key is among those affected (a frame of one column); keys of source are among them.

        Only folders that hold an affected key are written anew.
        """
        v = self.version()
        schema = T.StructType.fromJson(json.loads(v.schema))
        named = affected.select(F.col(affected.columns[0]).alias("_affected")).distinct()
        touched = self._folders_of(self._with_file(v).join(named, F.col(key) == F.col("_affected"), "left_semi"), v)
        held = self._folders({f: v.schemas[f] for f in touched}, schema).join(named, F.col(key) == F.col("_affected"), "left_anti")
        return self._replace(v, "REPLACE", touched, held.unionByName(source.select(*[c for c in source.columns if c in schema.names]), allowMissingColumns=True))

    def snapshot(self, source: DataFrame, keys: Sequence[str], check: Sequence[str], at: dt.datetime | dt.date) -> Version:
        """SCD2 history of source; see `scd2_apply`.  Folders of closed versions alone stay."""
        if self.exists():
            v = self.version()
            schema = T.StructType.fromJson(json.loads(v.schema))
            touched = self._folders_of(self._with_file(v).where("valid_to is null"), v)
            return self._replace(v, "SNAPSHOT", touched, scd2_apply(self._folders({f: v.schemas[f] for f in touched}, schema), source, keys, check, at))
        kind = "date" if not isinstance(at, dt.datetime) else "timestamp"
        return self.overwrite(source.withColumns({"valid_from": F.lit(at).cast(kind), "valid_to": F.lit(None).cast(kind)}), "SNAPSHOT")

    def delete_where(self, condition: Column) -> Version:
        """Rows for which the condition holds go; earlier versions keep them until vacuum."""
        return self._delete(lambda df: df.where(F.coalesce(condition, F.lit(False))), lambda df: df.where(~F.coalesce(condition, F.lit(False))))

    def delete_keys(self, keys: DataFrame) -> Version:
        """Rows that agree with a row of keys in all of its columns go, from the companion parts that have these columns, too."""
        return self._delete(lambda df: df.join(keys, keys.columns, "left_semi"), lambda df: df.join(keys, keys.columns, "left_anti"), keys.columns)

    def _delete(self, hit: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], columns: Sequence[str] | None = None) -> Version:
        v = self.version()
        touched = self._folders_of(hit(self._with_file(v)), v)
        held = self._folders({f: v.schemas[f] for f in touched}, T.StructType.fromJson(json.loads(v.schema)))
        parts = dict(v.parts)
        for name, (files, kind) in v.parts.items() if columns else ():
            schema = T.StructType.fromJson(json.loads(kind))
            if set(columns) <= set(schema.names):
                parts[name] = (self._write(rest(self._folders(files, schema)))[0], kind)
        return self._replace(v, "DELETE", touched, rest(held), parts)

    def register(self, database: str, name: str) -> str:
        """A catalog entry of the newest version, as an external table over its folders' files
        if it is one plain folder, else as a view of them; gives the entry's name."""
        v, full = self.version(), f"`{database}`.`{name}`"
        self.spark.sql(f"create database if not exists `{database}`")
        self.spark.sql(f"drop view if exists {full}") if self._is_view(database, name) else self.spark.sql(f"drop table if exists {full}")
        if len(v.files) == 1 and not v.partition_by and json_names(v.schemas[v.files[0]]) == json_names(v.schema):
            self.spark.catalog.createTable(f"{database}.{name}", path=f"{self.path}/{v.files[0]}", source="parquet")
            return full
        columns = ", ".join(f"`{c}`" for c in json_names(v.schema))
        scans = [f"select {', '.join(self._selected(v, f))} from {self._partition(database, f, v)}" for f in v.files]
        self.spark.sql(f"create view {full} as select {columns} from ({' union all '.join(scans)})")
        return full

    def _selected(self, v: Version, file: str) -> list[str]:
        """A folder's columns in SQL as those of the table."""
        had = {f.name.lower(): f for f in T.StructType.fromJson(json.loads(v.schemas[file])).fields}
        out = []
        for f in T.StructType.fromJson(json.loads(v.schema)).fields:
            own, kind = had.get(f.name.lower()), f.dataType.simpleString()
            nested = own and isinstance(own.dataType, (T.ArrayType, T.MapType, T.StructType))
            value = "null" if own is None else f"`{own.name}`"
            if own and kind == "string" and own.dataType.simpleString() != kind:
                value = f"to_json({value})" if nested else f"base64({value})" if isinstance(own.dataType, T.BinaryType) else value
            out.append(f"{value} as `{f.name}`" if own and own.dataType.simpleString() == kind else f"cast({value} as {kind}) as `{f.name}`")
        return out

    def _is_view(self, database: str, name: str) -> bool:
        return any(t.name == name.lower() and t.tableType == "VIEW" for t in self.spark.catalog.listTables(database))

    def _partition(self, database: str, file: str, v: Version) -> str:
        """A folder in SQL, with its partition values as columns."""
        values = {c: x for c, x in (level.split("=", 1) for level in file.split("/")[2:]) if c != "_part"}
        kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(json.loads(v.schemas[file])).fields}
        literal = lambda c: "null" if values[c] == "__HIVE_DEFAULT_PARTITION__" else f"cast('{unquote(values[c])}' as {kinds[c]})"
        extra = "".join(f", {literal(c)} as `{c}`" for c in values)
        return f"(select *{extra} from parquet.`{self.path}/{file}`)"

    # ------------------------------------------------------------ maintenance

    def optimize(self, files: int | None = None, zorder: Sequence[str] = (), file_bytes: int = 128 << 20) -> Version:
        """Fewer, larger files, about file_bytes each unless their number is given; with zorder,
        rows near in those columns are near in the files."""
        v, df = self.version(), self.read()
        held = sum(self._fs.getContentSummary(self._Path(f"{self.path}/{f}")).getLength() for f in v.files)
        files = files or max(1, -(-held // file_bytes))
        if zorder:
            df = df.withColumn("_z", z_value(df, zorder)).repartitionByRange(files, *v.partition_by, "_z").sortWithinPartitions("_z").drop("_z")
        else:
            df = df.repartition(files, *v.partition_by) if v.partition_by else df.coalesce(files) if files > 1 else df.repartition(1)
        return self.overwrite(df, "OPTIMIZE", metrics={"zorder": list(zorder), "files": files})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove data folders that none of the newest `keep` versions lists, and older logs; gives what went.

        keep=0 keeps the current version only, as does 1: what is current always stays.
        """
        known = self.versions()
        kept = known[-max(1, keep) :]
        live = {f for n in kept for v in (self.version(n),) for part in (DATA, *v.parts) for f in v.part(part)[0]}
        folder = self._Path(f"{self.path}/data")
        gone = []
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = f"data/{s.getPath().getName()}"
            within = [f for f in live if f == name or f.startswith(f"{name}/")]
            depth = max((f.count("/") - 1 for f in within), default=0)
            for leaf in self._leaves(name, depth) if within else [name]:
                if leaf not in live:
                    self._fs.delete(self._Path(f"{self.path}/{leaf}"), True)
                    gone.append(leaf)
        for n in known:
            if n not in kept:
                self._fs.delete(self._Path(f"{self.path}/_log/{n:08d}.json"), False)
        return sorted(gone)


def json_names(schema: str) -> list[str]:
    return T.StructType.fromJson(json.loads(schema)).names


def z_value(df: DataFrame, columns: Sequence[str], bits: int = 8) -> Column:
    """Interleaved bits of the columns' ranks among approximate quantiles; text ranks by its first
    six bytes, null ranks first."""
    kinds = dict(df.dtypes)

    def number(c: str) -> Column:
        if kinds[c] in ("string", "binary"):
            return F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
        return F.unix_timestamp(c).cast("double") if kinds[c] in ("date", "timestamp") else F.col(c).cast("double")

    bits = min(bits, 62 // max(1, len(columns)))
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(number(c), shares, 4 << bits).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    out: Column = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        rank = _rank(number(c), list(cuts[i] or [0.0] * len(shares)), bits)
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + i))
    return out


def _rank(value: Column, edges: list[float], bits: int) -> Column:
    """How many of 2**bits - 1 sorted edges lie at or below the value, by binary search; 0 for null."""
    steps, all_edges = F.lit([1 << i for i in range(bits - 1, -1, -1)]), F.lit(edges)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(all_edges, at + step - 1) <= value, at + step).otherwise(at)).cast("long")
