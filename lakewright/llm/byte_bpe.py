"""Byte-level BPE by prefix dynamic programming.

For the ranks of a byte-level BPE, every byte prefix of a piece has exactly one
encoding, and that encoding has one last token.  A token t ending at byte i is
this last token iff the prefix before it ends in a token p such that BPE, run
on the bytes of p and t together, gives back exactly [p, t].  So one array,
``last``, describes the encodings of all prefixes: following it backwards from
any byte decodes that prefix.  Appending bytes only extends it (`Piece.append`),
and an edit in a text (`Encoded.edit`) recomputes from the edited piece to the
first old piece boundary at which the new pieces fall in step again.

Whether [p, t] is stable is decided by taking both tokens apart in the reverse
order of their merges: as soon as the two bytes strings facing each other across
the border form a token of a lower rank than every merge undone so far, BPE would
have merged across the border and the pair is not stable.

Ranks come as a parameter (a tiktoken file read on the driver and broadcast:
bounded by the vocabulary).  Texts are cut by the tokenizer's own pattern; special
tokens are never recognised.  Encodings of pieces are remembered per task in
a table of at most ``MEMORY`` entries.

Defined results: a null text is empty and has no tokens; a null doc_id stays;
repeated rows are encoded each; other columns are ignored by ``encoded`` and
kept by ``with_tokens``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm._common import map_arrow, table

MEMORY = 300_000
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with what the dynamic program asks: suffix tokens, splits, stable pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.size_of = {r: len(b) for b, r in ranks.items()}
        # All tokens' bytes end to end, for decoding by look-up.
        order = [self.bytes_of.get(r, b"") for r in range(max(self.bytes_of) + 1)]
        self.sizes = np.array([len(b) for b in order], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(order), dtype=np.uint8)
        self.split: dict[int, tuple[int, int]] = {}
        #: Of each token, whether it is stable after the tokens asked about so far.
        self.stable: dict[int, dict[int, bool]] = {r: {} for r in ranks.values()}
        self.asked = 0
        #: Finds, byte by byte, every token that ends there (latin-1 text stands for bytes).
        self.suffixes = ahocorasick.Automaton()
        for b, r in ranks.items():
            if len(b) == 1 or self.parts(r) != (-1, -1):
                self.suffixes.add_word(b.decode("latin-1"), (r, len(b), self.stable[r]))
        self.suffixes.make_automaton()

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives token, or None for a single byte."""
        if token in self.split:
            return self.split[token]
        b = self.bytes_of[token]
        if len(b) == 1:
            return None
        pieces = [b[i : i + 1] for i in range(len(b))]
        while len(pieces) > 2:
            rank, at = min((self.ranks.get(pieces[i] + pieces[i + 1], 1 << 60), i) for i in range(len(pieces) - 1))
            if rank >= token:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        found = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else (-1, -1)
        self.split[token] = found
        return found

    def is_stable(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens gives exactly [left, right]."""
        if (known := self.stable[right].get(left)) is not None:
            return known
        # Undo the latest merge of either side, one at a time: `border` is the rank below
        # which a merge across the border would have come first.
        a, b, border, ok = left, right, 1 << 60, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60)
            if joined < border:
                ok = False
                break
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                break
            # On equal ranks the leftmost merge comes first, hence is undone last.
            if pb is None or (pa_ is not None and a > b):
                border, a = a, pa_[1]
            else:
                border, b = b + 1, pb[0]
        if self.asked >= MEMORY:
            self.asked = 0
            for known_ in self.stable.values():
                known_.clear()
        self.asked += 1
        self.stable[right][left] = ok
        return ok


class Piece:
    """The encodings of all prefixes of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last = self.v, self.last
        old = len(self.data)
        self.data += more
        from_ = max(0, old - v.longest + 1)
        settled = old - 1
        for end, (token, n, after) in v.suffixes.iter((self.data[from_:] if from_ else self.data).decode("latin-1")):
            end += from_
            if end <= settled:
                continue
            if end + 1 != n:
                before = last[end - n]
                ok = after.get(before)
                if not (v.is_stable(before, token) if ok is None else ok):
                    continue
            last.append(token)
            settled = end

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes (all by default)."""
        i, out = len(self.data) if end is None else end, []
        last, size = self.last, self.v.size_of
        while i:
            t = last[i - 1]
            out.append(t)
            i -= size[t]
        return out[::-1]


#: White space other than a space or line feed, and the byte that marks borders below.
_ODD = re.compile("[\x00\t\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")
#: The pattern for which texts may be cut before spaces; others take the plain path.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_ASCII = tuple(map(chr, (0, 9, 11, 12, 13, *range(28, 32), 127)))


class _Memory(dict):
    """Packed ids by stretch of text, in two generations of at most MEMORY / 2 entries:
    what was asked for since the last change of generation survives the next."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.old = encoder, {}

    def __missing__(self, s: str) -> bytes:
        e = self.encoder
        if (got := self.old.get(s)) is not None:
            pass
        elif s.isascii() and (s[1:].isalpha() if s[:1] == " " else s.isalpha()):
            got = e.piece(s)
        else:
            got = b"".join([e.piece(p) for p in e.all(s)])
        if len(s) < 64:
            if len(self) >= MEMORY // 2:
                self.old = dict(self)
                self.clear()
            self[s] = got
        return got


class Encoder:
    """Encodes texts piece by piece; remembers stretches between spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.v, compiled = Vocabulary(ranks), regex.compile(pattern)
        self.find, self.all = compiled.finditer, compiled.findall
        self.known, self.pieces, self.spaced = _Memory(self), {}, pattern == SPACED

    def piece(self, s: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        if (got := self.pieces.get(s)) is None:
            data = s.encode()
            token = self.v.ranks.get(data)
            ids = Piece(self.v, data).tokens() if token is None else (token,)  # a whole token is never taken apart
            got = array("I", ids).tobytes() if _LITTLE else np.array(ids, dtype="<u4").tobytes()
            if len(s) < 64:
                if len(self.pieces) >= MEMORY // 2:
                    self.pieces.clear()
                self.pieces[s] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed.

        Under SPACED, a space between two visible characters always starts a piece and no piece there
        depends on what follows, so the text can be cut before every such space and each
        stretch looked up whole.  Texts with other white space, or with white space next
        to a space, and all under other patterns, are cut by the pattern alone.
        """
        if not self.spaced:
            return b"".join([self.piece(p) for p in self.all(text)])
        odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)
        if odd or "  " in text or " \n" in text or "\n " in text or text[-1:] == " ":
            known, plain = self.known, []
            for p in self.all(text):
                plain.append(known[p])
            return b"".join(plain)
        return b"".join(map(self.known.__getitem__, text.replace(" ", "\0 ").split("\0")))

    def forget(self) -> None:
        """Give the remembered stretches back, so that an idle worker holds little."""
        self.known.clear()
        self.known.old = {}
        self.pieces.clear()

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        size = self.v.sizes[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.v.starts[ids] - (ends - size), size)
        return self.v.all_bytes[at].tobytes()


class Encoded:
    """A text with its encoding, which can be edited in place."""

    def __init__(self, encoder: Encoder, text: str) -> None:
        self.encoder, self.text = encoder, text
        self.ends = [m.end() for m in encoder.find(text)]
        self.pieces = [encoder.piece(p) for p in encoder.all(text)]

    @property
    def packed(self) -> bytes:
        return b"".join(self.pieces)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end] by new; gives the number of pieces encoded anew."""
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        # Under SPACED a piece ends by what follows it by at most one character: step back past the
        # piece before.  Another pattern may look anywhere, so all is cut anew.
        keep = max(0, sum(e < start for e in self.ends) - 1) if self.encoder.spaced else 0
        at = self.ends[keep - 1] if keep else 0
        old = {e + shift: i for i, e in enumerate(self.ends) if e > end}
        ends, pieces = self.ends[:keep], self.pieces[:keep]
        done = 0
        for m in self.encoder.find(text, at):
            ends.append(m.end())
            pieces.append(self.encoder.piece(m[0]))
            done += 1
            if self.encoder.spaced and (i := old.get(m.end())) is not None and m.end() > start + len(new):
                ends += [e + shift for e in self.ends[i + 1 :]]
                pieces += self.pieces[i + 1 :]
                break
        self.text, self.ends, self.pieces = text, ends, pieces
        return done


_WORKER: dict = {}


def _encoder(ranks, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    vocabulary = ranks.value
    if _WORKER.get("for") != (len(vocabulary), pattern, next(iter(vocabulary))):
        _WORKER.update({"for": (len(vocabulary), pattern, next(iter(vocabulary))), "encoder": Encoder(vocabulary, pattern)})
    return _WORKER["encoder"]


def _digests(ranks, pattern):
    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = encoder.encode(text.as_py() or "")
                rows.append((i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(encoder.decode(packed)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()

    return run


def _tokens(ranks, pattern, at):
    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            packed = [encoder.encode(t.as_py() or "") for t in batch.column(at)]
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]), pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "token_ids"])
        encoder.forget()

    return run


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of the bytes they decode to, a row each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = _broadcast(docs.sparkSession, ranks_path)
    return map_arrow(texts, _digests(ranks, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with a column token_ids (array of int)."""
    ranks = _broadcast(docs.sparkSession, ranks_path)
    schema = docs.drop("token_ids").schema.add("token_ids", T.ArrayType(T.IntegerType()))
    kept = docs.drop("token_ids")
    return map_arrow(kept, _tokens(ranks, pattern, kept.columns.index("text")), schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
