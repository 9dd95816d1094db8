"""Secret scans with multipart credential linking.

Base kinds, leftmost and non-overlapping each (failing matches still consume):
``assign``, ``access`` and ``hex``.  Further parts of a credential are weak on
their own and so only candidates:

* ``ident``   - an access identifier: a value assigned to user, login, account
  or client id, or a base ``access`` match,
* ``endpoint`` - a URL with a host, or a host with a port,
* ``weak``    - a whole run of 20 or more characters of a key alphabet, with lower case,
  upper case and a digit, that no base span or endpoint touches.

Parts are joined by intervals: each part reaches ``REACH`` code points beyond
its ends, never over a blank line (its scope).  A weak secret is reported if an
identifier or endpoint lies in reach; an identifier or endpoint if any secret
does.  Parts that overlap are one piece of text and do not complement each other: a digest
inside a URL, or an identifier whose value is the secret, is no pair.  The join is a sweep
over each text's sorted parts, so it costs their sort, not their pairs, and needs no
shuffle: texts are independent rows.  All patterns take time linear in the text.

Defined results: a null text is empty and has no spans; a null doc_id stays;
repeated rows are scanned each; other columns are ignored, or kept by
``redacted``.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import map_arrow, table

REACH = 200
KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
_ORDER = {k: i for i, k in enumerate(KINDS)}


def _either(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_ASSIGN = re.compile(f"({_either('password|passwd|secret|token|api_?key')})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_IDENT = re.compile(f"(?<![A-Za-z0-9])(?:{_either('user|user_?name|login|account|client_?id|access_?id')})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=@-]+)")
_SCHEME_END = re.compile(r"://[^\s\"'<>]+")
_HOST_PORT = re.compile(r"(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+")
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
_MARKS = ("passw", "secret", "token", "apikey", "api_key")
_IDENT_MARKS = ("user", "login", "account", "client", "access")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(m in low for m in _MARKS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs with a scheme (letters, digits and +, a letter first), and hosts with a port outside of them."""
    found: list[tuple[int, int]] = []
    for m in _SCHEME_END.finditer(text) if "://" in text else ():
        start, floor = m.start(), found[-1][1] if found else 0
        while start > floor and text[start - 1] in _SCHEME:
            start -= 1
        while start < m.start() and not text[start].isalpha():
            start += 1
        if start < m.start():
            found.append((start, m.end()))
    urls = _merged(found)
    for m in _HOST_PORT.finditer(text):
        i = bisect_left(urls, (m.end(), 0))
        if not (i and urls[i - 1][1] > m.start()):
            found.append((m.start(), m.end()))
    return sorted(found)


class _Sorted:
    """Spans by start and by end, so that the nearest on either side that do not overlap are neighbours."""

    def __init__(self, spans) -> None:
        self.starts, self.ends = sorted(s for s, _ in spans), sorted(e for _, e in spans)

    def near(self, start: int, end: int, blanks: list[int]) -> bool:
        """Whether one lies within REACH of [start, end), in its scope and without overlap."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        gaps = [(x, start) for x in self.ends[max(0, i - 1) : i]] + [(end, x) for x in self.starts[j : j + 1]]
        return any(hi - lo <= REACH and bisect_left(blanks, lo) == bisect_left(blanks, hi) for lo, hi in gaps)


def _merged(spans) -> list[tuple[int, int]]:
    """Sorted disjoint cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of weak parts whose complementary parts co-occur in scope."""
    low = text.lower()
    idents = [(m.start(), m.end()) for m in _IDENT.finditer(text)] if any(m in low for m in _IDENT_MARKS) else []
    ends = endpoints(text) if ":" in text else []
    access = [(s, e) for s, e, k in base if k == "access"]
    if not idents and not ends and not access:
        return []
    covered = _merged([(s, e) for s, e, _ in base] + ends)
    weak = []
    for m in _WEAK.finditer(text):
        v = m[0]
        if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v):
            i = bisect_left(covered, (m.end(), 0))
            if not (i and covered[i - 1][1] > m.start()):
                weak.append((m.start(), m.end()))
    blanks = [m.start() for m in _BLANK.finditer(text)]
    keys = _Sorted(idents + ends + access)
    weak = [w for w in weak if keys.near(*w, blanks)]
    secrets = _Sorted([(s, e) for s, e, k in base if k != "access"] + weak)
    out = [(s, e, "weak") for s, e in weak]
    for kind, parts in (("ident", idents), ("endpoint", ends)):
        out += [(s, e, kind) for s, e in parts if secrets.near(s, e, blanks)]
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], _ORDER[x[2]], x[1])))


_FOUND = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])


def _scan(batches):
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            base = base_spans(text)
            more = linked_spans(text, base)
            n = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
            rows.append((i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
        cols = list(zip(*rows, strict=True)) or [()] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans
    (base and linked) and n_linked."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(text: str) -> str:
    """text with every base or weak secret replaced by ``[kind]``; identifiers and endpoints stay."""
    base = base_spans(text)
    kinds = {}
    spans = base + [x for x in linked_spans(text, base) if x[2] == "weak"]
    for s, e, k in sorted(spans, key=lambda x: (x[0], _ORDER[x[2]])):
        kinds.setdefault(s, k)
    out, at = [], 0
    for s, e in _merged([(s, e) for s, e, _ in spans]):
        out += [text[at:s], f"[{kinds[s]}]"]
        at = e
    return "".join([*out, text[at:]])


def _redactor(at: int, length: int):
    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact(t) for t in old]
            cols = batch.columns
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if length >= 0:
                n = [was if o == t or t is None else len(t) for was, o, t in zip(batch.column(length).to_pylist(), old, new, strict=True)]
                cols[length] = pa.array(n, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets redacted in text, and n_chars (if there) of changed texts renewed."""
    names = docs.columns
    return map_arrow(docs, _redactor(names.index("text"), names.index("n_chars") if "n_chars" in names else -1), docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
