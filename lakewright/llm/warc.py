"""Deterministic sharded WARC archives: written by range-sorted tasks, committed by manifest, read back.

Writing:

1. A narrow pass keeps id, url, size and SHA-256 of every payload.  Of equal payloads of at least ``min_bytes``
   bytes the page of least page_id is a response, the others are revisits of it; only payloads that
   occur twice are joined back, broadcast if they are proven few, else by a shuffle.
2. Pages are sorted by page_id into shards of about equal bytes.  The shards' borders are quantiles of
   a sample drawn by hash, so they depend on the data alone, not on partitions or runs; a hash of url
   and payload parts pages of one id.  Payloads of revisits never travel.
3. A task writes its shards' records, one gzip member each, and begins the next file once the last
   has ``roll_bytes`` compressed bytes.  Headers and digests are made anew from the data: ids of records are hashes,
   dates a parameter.  The bytes of all files thus depend only on the rows and the parameters.

Committing: tasks write under names of their own attempt in a temporary folder and return what they
wrote as rows of a manifest, a Parquet table; a lost task's files are in no manifest.  Tasks over the manifest then move its
files to their final names, which may be repeated without harm, and at last the marker ``COMMITTED``, which names
the manifest, is moved into place.  Readers take files from a committed manifest only.

Reading: one row per file of the manifest; tasks stream its members, check every block and payload digest and the number
of records, and give a row per page.

Defined results: a null html is an empty payload; a null page_id comes after all others and has no header, and a revisit
of a page without id does not exist (pages without id are responses unless a page with an id has their payload);
rows that share the least page_id of their payload are all responses, so repeated rows are written each, and record ids tell them
apart by a running number; null urls become ``urn:page:<page_id>``, and control characters, spaces and non-ASCII
characters of urls are percent-encoded; very long pages are whole (a task holds one at a time); extra columns are ignored;
an empty table gives a committed archive without files.  Rows equal in all columns go to one shard.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import map_arrow, shared_folder, sized, table, written

#: Payload bytes of a shard; small tables are cut finer, into up to LEAST_SHARDS shards of at least FINE_BYTES.
SHARD_BYTES, LEAST_SHARDS, FINE_BYTES = 1 << 30, 48, 4 << 20
ROLL_BYTES = 256 << 20
#: Pages of the border sample: a number per shard, within these bounds.
SAMPLE, SAMPLE_LEAST, SAMPLE_MOST = 64, 20_000, 1_000_000
HEADER_BYTES = 700
DATE = "2000-01-01T00:00:00Z"
_LAST = (1 << 63) - 1
_MARKER = "COMMITTED"


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, as tasks and driver see it, and the folder's path there."""
    if folder.startswith("file:/"):
        folder = "file:///" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{'' if page_id is None else page_id}"
    return quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page: dict, occurrence: int, date: str) -> bytes:
    """The record of one page; payload is None for revisits, whose block keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['n']}\r\n\r\n".encode()
    block, digest = http + (page["payload"] or b""), base32(bytes.fromhex(page["sha1"]))
    headers = [
        ("WARC-Type", "revisit" if page["payload"] is None else "response"),
        ("WARC-Record-ID", _record_id(page["page_id"], page["url"], page["sha256"], occurrence)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(page["url"], page["page_id"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page["page_id"] is not None:
        headers.append(("X-Page-Id", str(page["page_id"])))
    if page["payload"] is None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(page["first_id"], page["first_url"], page["sha256"], 0)),
            ("WARC-Refers-To-Target-URI", _uri(page["first_url"], page["first_id"])),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-Id", str(page["first_id"])),
        ]
    return _record(headers, block)


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class _File:
    """One archive under its temporary name."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, date: str) -> None:
        self.name, self.temporary = name, f"{folder}/{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        block = b"software: lakewright\r\nformat: WARC File Format 1.1\r\n"
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        self.add(_member(_record(headers, block)))

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1


_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _write(folder: str, prefix: str, roll_bytes: int, date: str):
    """Writes sorted rows of (shard, page...) and gives a manifest row per finished file."""

    def run(batches):
        fs, root = _filesystem(folder)
        file, shard, seq, last, occurrence = None, None, 0, None, 0

        def closed(f: _File) -> pa.RecordBatch:
            f.out.close()
            return pa.RecordBatch.from_pylist([{"name": f.name, "temporary": f.temporary, "records": f.records, "bytes": f.size, "sha256": f.digest.hexdigest()}])

        for batch in batches:
            columns = batch.schema.names
            for i in range(batch.num_rows):
                page = {c: batch.column(k)[i].as_py() for k, c in enumerate(columns)}
                this = (page["page_id"], page["url"], page["sha256"])
                occurrence = occurrence + 1 if this == last else 0
                last = this
                if file and (page["shard"] != shard or file.size >= roll_bytes):
                    yield closed(file)
                    file = None
                if page["shard"] != shard:
                    shard, seq = page["shard"], 0
                if file is None:
                    file = _File(fs, root, f"{prefix}-{shard:06d}-{seq:04d}.warc.gz", date)
                    seq += 1
                file.add(_member(page_record(page, occurrence, date)))
        if file:
            yield closed(file)

    return run


def _move(folder: str):
    """Moves the manifest's files to their names; done twice, or by two attempts at once, it comes to the same."""

    def run(batches):
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                here, there = fs.get_file_info([temporary, f"{root}/{name}"])
                if here.type == pafs.FileType.File:
                    if there.type == pafs.FileType.File:
                        fs.delete_file(there.path)
                    fs.move(temporary, there.path)
                elif there.type != pafs.FileType.File or there.size != size:
                    raise FileNotFoundError(f"{temporary}, and {there.path} is not it")
            yield batch.select([0])

    return run


def _borders(sample: list, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(page_id, tie) of the first page of every shard but the first, at equal shares of the sample's bytes."""
    rows = sorted((r["place"], r["tie"], r["weight"]) for r in sample)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.cumsum([0, *(w for *_, w in rows[:-1])], dtype=np.float64)
    total = before[-1] + rows[-1][2]
    at = np.unique(np.searchsorted(before, np.arange(1, n_shards) * total / n_shards))
    kept = sorted({rows[i][:2] for i in at if 0 < i < len(rows)})
    return np.array([p for p, _ in kept], dtype=np.int64), np.array([t for _, t in kept], dtype=np.int64)


def _shard(places: np.ndarray, ties: np.ndarray):
    """The shard of a page by binary search; only the two key columns go to Python."""

    @F.pandas_udf("int")
    def shard(place: pd.Series, tie: pd.Series) -> pd.Series:
        p, t = place.to_numpy(), tie.to_numpy()
        low, out = np.searchsorted(places, p, "left"), np.searchsorted(places, p, "right")
        for value in np.unique(p[low < out]):
            those, (a, b) = p == value, np.searchsorted(places, [value, value + 1] if value < _LAST else [value, value])
            b = len(places) if value == _LAST else b
            out[those] = a + np.searchsorted(ties[a:b], t[those], "right")
        return pd.Series(out, dtype="int32")

    return shard


def write(pages: DataFrame, folder: str, prefix: str = "pages", min_bytes: int = 0, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> dict:
    """Archives (page_id, url, html) as WARC files in a folder that holds no committed archive; gives the marker's content."""
    spark = pages.sparkSession
    fs, root = _filesystem(folder)
    if fs.get_file_info(f"{root}/{_MARKER}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds a committed archive")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    page = page.withColumns({"sha256": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    narrow = written(page.select("page_id", "url", "n", F.unhex("sha256").alias("sha256")), "warc-pages")

    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))).alias("least")
    repeats = narrow.where(F.col("n") >= min_bytes).groupBy("sha256").agg(F.count("*").alias("times"), least).where("times > 1")
    repeats = written(repeats.select(F.lower(F.hex("sha256")).alias("of"), "least.first_id", "least.first_url"), "warc-repeats")

    # Shards by bytes, from the narrow table alone.
    key = {"place": F.coalesce("page_id", F.lit(_LAST)), "tie": F.xxhash64("url", "sha256")}
    rows, total = narrow.agg(F.count("*"), F.sum(F.col("n") + HEADER_BYTES)).first()
    total = total or 0
    n_shards = max(1, -(-total // (shard_bytes or SHARD_BYTES)), 0 if shard_bytes else min(LEAST_SHARDS, -(-total // FINE_BYTES)))
    share = min(1.0, min(max(SAMPLE * n_shards, SAMPLE_LEAST), SAMPLE_MOST) / max(rows, 1))
    drawn = F.pmod(F.xxhash64("page_id", "url", "sha256", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)
    first = narrow.join(sized(repeats), F.lower(F.hex("sha256")) == F.col("of"), "left")
    same = F.col("of").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    weight = F.when(same, F.col("n")).otherwise(0) + HEADER_BYTES
    places, ties = _borders(first.where(drawn).select(*(c.alias(k) for k, c in key.items()), weight.alias("weight")).collect(), n_shards)

    # Keys are those of the narrow table: the tie hashes the digest's bytes.
    full = page.join(sized(repeats), F.col("sha256") == F.col("of"), "left").withColumns({"place": key["place"], "tie": F.xxhash64("url", F.unhex("sha256"))})
    full = full.select(
        _shard(places, ties)("place", "tie").alias("shard"), "place", "tie", "page_id", "url", F.when(same, F.col("payload")).alias("payload"), "n", F.sha1("payload").alias("sha1"), "sha256", "first_id", "first_url"
    )
    full = full.repartitionById(len(places) + 1, F.col("shard")).sortWithinPartitions("shard", "place", F.col("page_id").isNull(), "tie", "url", "sha256").drop("place", "tie")

    token = uuid.uuid4().hex
    fs.create_dir(f"{root}/temporary-{token}", recursive=True)
    manifest = f"{folder}/manifests/{token}"
    map_arrow(full, _write(f"{folder}/temporary-{token}", prefix, roll_bytes, date), _MANIFEST).write.parquet(manifest)
    listed = spark.read.schema(_MANIFEST).parquet(manifest)
    files, records, size = listed.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    moved = listed.select("name", "temporary", "bytes").repartition(max(1, min(files, 1000)), "name")
    map_arrow(moved, _move(folder), "name string").write.format("noop").mode("overwrite").save()
    marker = {"manifest": manifest, "files": files, "records": records, "bytes": size}
    with fs.open_output_stream(f"{root}/{_MARKER}.{token}", compression=None) as out:
        out.write(json.dumps(marker).encode())
    fs.move(f"{root}/{_MARKER}.{token}", f"{root}/{_MARKER}")
    fs.delete_dir(f"{root}/temporary-{token}")
    return marker


def _members(stream):
    """(offset, content) of every gzip member of a file."""
    z, parts, rest, at, read = zlib.decompressobj(31), [], b"", 0, 0
    while chunk := rest or stream.read(1 << 16):
        if not rest:
            read += len(chunk)
        parts.append(z.decompress(chunk))
        rest = z.unused_data
        if z.eof:
            yield at, b"".join(parts)
            at = read - len(rest)
            z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends inside a member")


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not first.startswith("WARC/") or len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, block


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, payload binary"


def _page(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    if headers["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    size, digest = int(http.rpartition(b"Content-Length: ")[2]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    own = headers["WARC-Type"] == "response"
    if own and (len(body) != size or base32(hashlib.sha1(body).digest()) != digest):
        raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
    number = {k: int(headers[h]) if h in headers else None for k, h in (("page_id", "X-Page-Id"), ("refers_to", "X-Refers-To-Page-Id"))}
    return number | {"payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "url": headers["WARC-Target-URI"], "payload": body if payload and own else None}


def _read(folder: str, payload: bool):
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "file": pa.string(), "offset": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], list(types))

    def run(batches):
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, content in _members(stream):
                        seen += 1
                        headers, block = parsed(content)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_page(headers, block, payload) | {"file": name, "offset": offset})
                        if len(rows) == (64 if payload else 4096):
                            yield batch_of(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records of {records}")
                yield batch_of(rows)

    return run


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row per page of a committed archive: ids, sizes, digests, where it stands, and responses' payloads if asked for."""
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/{_MARKER}", compression=None) as stream:
        marker = json.loads(stream.read())
    listed = spark.read.schema(_MANIFEST).parquet(marker["manifest"]).select("name", "records")
    spread = listed.repartitionByRange(max(1, min(marker["files"], 10_000)), "name")
    return map_arrow(spread, _read(folder, payload), _PAGES)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select *, min(page_id) over (partition by html) as first_id, sha1(html) as h from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from g
"""
