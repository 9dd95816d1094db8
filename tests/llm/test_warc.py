"""WARC archives: round trip, revisits, same bytes for any partitioning, commits."""

import base64
import glob
import gzip
import hashlib
import os
import random
from collections import defaultdict

import pytest

from lakewright.llm import warc

SCHEMA = "page_id long, url string, html string, sha256 string, shard int"


def pages_of(n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        html = rng.choice([None, "", "same page é", f"page {rng.randint(0, 40)} " * 5, "".join(rng.choices("abcdefgh <p>", k=rng.randint(0, 3000)))])
        rows.append((i * 7, rng.choice([None, f"http://a.example/{i}", "http://b.example/x y\r\nX: é"]), html, "x", 5))
    return rows


def expected(rows, min_bytes=0):
    least = {}
    for i, _, html, *_ in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        first = least.get(html or "")
        again = first is not None and i != first and len(raw) >= min_bytes
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def files(folder):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{folder}/*.warc.gz")}


@pytest.mark.parametrize("min_bytes", [0, 12])
def test_round_trip_with_revisits(spark, tmp_path, min_bytes):
    rows = pages_of()
    marker = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(5), f"{tmp_path}/a", min_bytes=min_bytes, shard_bytes=40_000, roll_bytes=9_000)
    assert got(spark, f"{tmp_path}/a") == expected(rows, min_bytes)
    assert marker["files"] == len(files(f"{tmp_path}/a")) > 6
    assert marker["records"] == len(rows) + marker["files"]  # each file opens with a warcinfo record
    names = sorted(files(f"{tmp_path}/a"))
    assert any(n.endswith("-0001.warc.gz") for n in names)  # a shard rolled over
    assert not glob.glob(f"{tmp_path}/a/temporary-*")


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    rows = pages_of()
    rng = random.Random(1)
    for k in range(2):
        rng.shuffle(rows)
        warc.write(spark.createDataFrame(rows, SCHEMA).repartition(1 + 6 * k), f"{tmp_path}/{k}", shard_bytes=50_000, roll_bytes=9_000)
    assert files(f"{tmp_path}/0") == files(f"{tmp_path}/1")


def test_records_are_sorted_and_refer_to_responses(spark, tmp_path):
    warc.write(spark.createDataFrame(pages_of(), SCHEMA), f"{tmp_path}/a", shard_bytes=40_000)
    ids, refers, order = set(), set(), []
    for _, raw in sorted(files(f"{tmp_path}/a").items()):
        for _, content in warc._members(__import__("io").BytesIO(raw)):
            headers, _ = warc.parsed(content)
            assert headers["WARC-Record-ID"] not in ids
            ids.add(headers["WARC-Record-ID"])
            if headers["WARC-Type"] == "warcinfo":
                continue
            order.append(int(headers["X-Page-Id"]))
            assert all(" " not in headers[k] for k in ("WARC-Target-URI", "WARC-Record-ID"))
            if headers["WARC-Type"] == "revisit":
                refers.add(headers["WARC-Refers-To"])
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert order == sorted(order)
    assert refers and refers <= ids


def test_null_ids_repeats_and_long_pages(spark, tmp_path):
    rows = [(None, None, "a", "", 0), (None, "u", "a", "", 0), (4, "u", "a", "", 0), (4, "u", "a", "", 0), (9, "v", "a", "", 0)]
    rows += [(None, "w", "only without ids", "", 0)] * 2 + [(11, "long", "<p>é " * 200_000, "", 0)]
    warc.write(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    assert got(spark, f"{tmp_path}/a") == expected(rows)
    whole = warc.read(spark, f"{tmp_path}/a", payload=True).where("page_id = 11").first()
    assert whole["payload"].decode() == "<p>é " * 200_000
    record_ids = defaultdict(int)
    for raw in files(f"{tmp_path}/a").values():
        for line in gzip.decompress(raw).split(b"\r\n"):
            record_ids[line] += line.startswith(b"WARC-Record-ID")
    assert max(record_ids.values()) == 1


def test_empty_table(spark, tmp_path):
    marker = warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert marker["files"] == 0 and got(spark, f"{tmp_path}/a") == []


def test_only_committed_archives_are_read_and_none_is_overwritten(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame(pages_of(50), SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(warc, "json", None)  # the driver ends just before the marker
        with pytest.raises(AttributeError):
            warc.write(frame, f"{tmp_path}/a")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"{tmp_path}/a")
    warc.write(frame, f"{tmp_path}/a")  # a second try replaces the files that had been moved
    assert got(spark, f"{tmp_path}/a") == expected(pages_of(50))
    with pytest.raises(FileExistsError):
        warc.write(frame, f"{tmp_path}/a")


def test_moving_twice_is_harmless(tmp_path):
    (tmp_path / "t").write_bytes(b"abc")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["x"], "temporary": [f"{tmp_path}/t"], "bytes": [3]})
    for _ in range(2):
        assert [b.num_rows for b in warc._move(str(tmp_path))([batch])] == [1]
    assert (tmp_path / "x").read_bytes() == b"abc"


def test_damage_is_told(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "hello world", "", 0)], SCHEMA), f"{tmp_path}/a")
    (name,) = glob.glob(f"{tmp_path}/a/*.warc.gz")
    plain = gzip.decompress(open(name, "rb").read()).replace(b"hello", b"jello")
    parts = plain.split(b"WARC/1.1\r\n")[1:]
    open(name, "wb").write(b"".join(gzip.compress(b"WARC/1.1\r\n" + p) for p in parts))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"{tmp_path}/a").collect()
