"""Substring deduplication with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document; a word goes if some window
over it has its word sequence starting earlier, too (smaller doc_id, or earlier in
the same document).  Windows are judged on the input.

1. One pass hashes words.  Documents of equal word sequences are copies: all but those
   of the least id lose every window at once, so copies cost one aggregation.
2. Every window has an anchor, its ``GRAM``-word stretch of least hash; equal windows have
   equal anchors, and neighbours mostly share theirs.  Only windows whose anchor
   occurs twice in the corpus can repeat; the others are dropped here (counts are
   summed before the shuffle).
3. The rest is cut into passages, runs of windows with one anchor, dealt to shards by
   anchor.  A shard holds about ``SHARD_WORDS`` words.  It builds an FM-index of its
   passages (`_fm_index`), then streams each passage backwards through it: matching
   statistics, capped at WINDOW words, give for every window the range of its
   occurrences and so the earliest one.  Windows with an earlier one are reported
   as intervals.
4. An anchor in more than ``HOT`` places would overfill its shard.  Its windows are dealt
   one by one by their own 128-bit hash, and the first of equal windows is found by
   an aggregation, which any number of machines share.

Words are compared by a keyed universal hash of 64 bits (`_words.hash_words`): a window is taken for another
only if words that differ agree in theirs, which has a probability of 2**-64 a pair, whatever the words.

Equal documents and windows of hot anchors thus never enter an index: both are found by
hashes of all their words, which gives the same rows and which an index of one shard could
not hold.

Defined results: a null text has no words; a null doc_id comes before all others;
rows that agree in id and text are one document and get equal results; rows of
one id (or none) with different texts are different documents, in the order of their hash.
Very long texts are hashed whole, a slice of their own.  Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm._common import BROADCAST_ROWS, cut, map_arrow, sized, table
from lakewright.llm._fm_index import FMIndex, matching_statistics
from lakewright.llm._words import U, hash_words, mix, ngrams, slices, tokens

WINDOW, GRAM = 20, 6
SHARD_WORDS, HOT = 400_000, 10_000
_NULL = -(1 << 63)


def _sequence(h: np.ndarray) -> bytes:
    """128-bit hash of a document's words in order."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _least_of(g: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values (two scans of blocks, no loop over width)."""
    n = len(g)
    pad = -n % width
    full = np.concatenate([g, np.full(pad, ~U(0), dtype=U)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _anchors(h: np.ndarray) -> np.ndarray:
    """Anchor of every window of a document."""
    if len(h) < WINDOW:
        return h[:0]
    _, g, _ = ngrams(h, np.array([0, len(h)]), GRAM)
    return _least_of(g, WINDOW - GRAM + 1)


def _runs(flags: np.ndarray) -> np.ndarray:
    """[first, last] of every maximal run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def _documents(texts):
    """(row, word hashes) of every text."""
    for lo, hi, offsets, data in slices(texts):
        starts, ends, first = tokens(offsets, data)
        h = hash_words(data, starts, ends)
        for r in range(hi - lo):
            yield lo + r, h[first[r] : first[r + 1]]


def _survey(batches):
    for batch in batches:
        rows = ([], [], [])
        for _, h in _documents(batch.column(2)):
            a = _anchors(h)
            # An anchor counts once, or twice if its gram stands in several places of the document.
            values = np.unique(a)
            grams, counts = np.unique(ngrams(h, np.array([0, len(h)]), GRAM)[1], return_counts=True)
            twice = np.isin(values, grams[counts > 1])
            rows[0].append(_sequence(h))
            rows[1].append(len(h))
            rows[2].append(np.concatenate([values, values[twice]]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64()))],
            ["place", "mark", "seq", "n_words", "anchors"],
        )


def _passages(batch, wanted: int):
    """(place, mark, words, anchors, rare and hot flags of the windows) of candidates; of documents without
    any in the wanted column the words are not even cut.  (Spark reads one shuffle for both columns.)"""
    batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(wanted)), 0), False))
    rare, hot = batch.column(3), batch.column(4)
    for r, h in _documents(batch.column(2)):
        a = _anchors(h)
        flags = [np.isin(a, np.array(c[r].as_py() or [], dtype=np.int64).view(U)) for c in (rare, hot)]
        yield batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), h, a, *flags


def _cut_passages(n_shards: int):
    def run(batches):
        for batch in batches:
            rows = []
            for place, mark, h, a, rare, _ in _passages(batch, 3):
                if not rare.any():
                    continue
                change = np.ones(len(a), dtype=bool)
                change[1:] = (a[1:] != a[:-1]) | (rare[1:] != rare[:-1])
                first = np.flatnonzero(change)
                last = np.append(first[1:], len(a)) - 1
                for i, j in zip(first[rare[first]].tolist(), last[rare[first]].tolist(), strict=True):
                    rows.append((int(mix(a[i : i + 1])[0] % U(n_shards)), place, mark, i, h[i : j + WINDOW].tobytes()))
            if rows:
                cols = list(zip(*rows, strict=True))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "place", "mark", "start", "words"])

    return run


_INTERVAL = pa.schema([("place", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def repeated_windows(passages: list[np.ndarray]) -> list[np.ndarray]:
    """For passages of word hashes in corpus order: flags of their windows that occur earlier."""
    sizes = np.array([len(p) for p in passages], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.concatenate(passages)
    codes = np.unique(words, return_inverse=True)[1] + 1
    text = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int64)
    text[np.arange(len(words)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = codes
    first = matching_statistics(FMIndex(text, WINDOW), text, starts, sizes)
    seen = (first >= 0) & (first < np.arange(len(text)))
    return [seen[s : s + n - WINDOW + 1] for s, n in zip(starts, sizes, strict=True)]


def _search_shard(group: pa.Table) -> pa.Table:
    group = group.sort_by([("place", "ascending"), ("mark", "ascending"), ("start", "ascending")])
    place, mark, start = (group.column(n).to_pylist() for n in ("place", "mark", "start"))
    passages = [np.frombuffer(w.as_py(), dtype=U) for w in group.column("words")]
    # A repeated row is the same document, not an earlier occurrence.
    new = [i for i in range(len(place)) if not i or (place[i], mark[i], start[i]) != (place[i - 1], mark[i - 1], start[i - 1])]
    rows = []
    for i, flags in zip(new, repeated_windows([passages[i] for i in new]), strict=True):
        rows += [(place[i], mark[i], start[i] + a, start[i] + b) for a, b in _runs(flags).tolist()]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_INTERVAL)], schema=_INTERVAL)


def _cut_windows(batches):
    for batch in batches:
        cols = ([], [], [], [], [])
        for place, mark, h, _, _, hot in _passages(batch, 4):
            at = np.flatnonzero(hot)
            if not len(at):
                continue
            one = ngrams(h, np.array([0, len(h)]), WINDOW)[1][at]
            two = ngrams(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), np.array([0, len(h)]), WINDOW)[1][at]
            for c, v in zip(cols, (one.view(np.int64), two.view(np.int64), np.full(len(at), place), np.full(len(at), mark), at.astype(np.int32)), strict=True):
                c.extend(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["one", "two", "place", "mark", "start"])


def _merge(batches):
    """Intervals of a document that touch as one: few are left of thousands of windows."""
    for batch in batches:
        out = []
        for found in batch.column(2).to_pylist():
            kept: list[dict] = []
            for x in sorted(found, key=lambda x: (x["last"] >= 0, x["first"], x["last"])):
                if kept and (kept[-1]["last"] < 0 or x["first"] <= kept[-1]["last"] + WINDOW):
                    # Windows less than WINDOW apart cover every word between them.
                    if kept[-1]["last"] >= 0:
                        kept[-1]["last"] = max(kept[-1]["last"], x["last"])
                else:
                    kept.append(x)
            out.append(kept)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["place", "mark", "found"])


def _finish(batches):
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_py() or ""
            words = raw.encode().split()  # splits at the six bytes that part words
            n = len(words)
            if found and n >= WINDOW:
                gone = np.zeros(n + 1, dtype=np.int64)
                for x in found:
                    gone[x["first"]] += 1
                    gone[(n - WINDOW if x["last"] < 0 else x["last"]) + WINDOW] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone[:n]).tolist(), strict=True) if not g]
            rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _named(docs: DataFrame) -> DataFrame:
    """place (doc_id, least for null) and mark (hash of the text) name a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(_NULL)).alias("place"), F.xxhash64("text").alias("mark"), "text")


def repeated_intervals(docs: DataFrame, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(place, mark, found) of documents with repeated windows: found lists (first, last), the
    first and last start of repeated windows; a last of -1 means to the end."""
    name = ["place", "mark"]
    texts = _named(docs).select("place", "mark", "text")
    seen = cut(map_arrow(texts, _survey, "place long, mark long, seq binary, n_words long, anchors array<long>").where(F.col("n_words") >= WINDOW))
    this = F.struct(*name)
    same = cut(seen.groupBy("seq").agg(F.min(this).alias("least"), F.max(this).alias("most")).where("least < most").select("seq", "least"))
    copies = seen.select(*name, "seq").join(sized(same), "seq").where(this > F.col("least")).select(*name).distinct()
    one = seen.join(sized(same), "seq", "left").where(F.col("least").isNull() | (this == F.col("least"))).select(*name, F.explode("anchors").alias("anchor"))
    often = one.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    marked = one.join(often, "anchor").distinct()
    wanted = cut(
        marked.groupBy(*name).agg(
            F.collect_list(F.when(F.col("n") <= hot, F.col("anchor"))).alias("rare"), F.collect_list(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot")
        )
    )
    n_rare, n_hot = wanted.agg(F.sum(F.size("rare")), F.sum(F.size("hot"))).first()
    few = texts.join(sized(wanted.select(*name)), name, "left_semi").join(wanted.hint("shuffle_merge"), name).select(*name, "text", "rare", "hot")
    n_shards = max(1, -(-(n_rare or 0) * 30 // shard_words))
    found = [copies.select(*name, F.lit(0).alias("first"), F.lit(-1).alias("last"))]
    if n_rare:
        cut_up = map_arrow(few, _cut_passages(n_shards), "shard int, place long, mark long, start int, words binary")
        found.append(cut_up.groupBy("shard").applyInArrow(_search_shard, "place long, mark long, first int, last int"))
    if n_hot:
        windows = map_arrow(few, _cut_windows, "one long, two long, place long, mark long, start int")
        first = windows.groupBy("one", "two").agg(F.min(F.struct(*name, "start")).alias("least"))
        later = windows.join(first, ["one", "two"]).where(F.struct(*name, "start") != F.col("least"))
        found.append(later.select(*name, F.col("start").alias("first"), F.col("start").alias("last")).distinct())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    gathered = out.groupBy(*name).agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return cut(map_arrow(gathered, _merge, "place long, mark long, found array<struct<first: int, last: int>>"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs."""
    found = repeated_intervals(docs, **how)
    # Broadcast only if the intervals, not just the documents, are known to be few.
    n = found.agg(F.sum(F.size("found"))).first()[0] or 0
    side = F.broadcast(found) if n <= BROADCAST_ROWS else found.hint("shuffle_merge")
    joined = _named(docs).join(side, ["place", "mark"], "left").select("doc_id", "text", "found")
    return map_arrow(joined, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
  select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from w, unnest(range(1, len(ws) - 18)) as t(i) where len(ws) >= 20
), ranked as (
  select doc_id, i, row_number() over (partition by k order by doc_id, i) as rn from windows
), gone as (
  select distinct doc_id, j from ranked, unnest(range(i, i + 20)) as u(j) where rn > 1
), words as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w
), marked as (
  select words.doc_id, word, words.j, gone.j is not null as removed from words left join gone on words.doc_id = gone.doc_id and words.j = gone.j
), sums as (
  select doc_id, count(*) as n, sum(case when removed then 1 else 0 end) as r,
         string_agg(case when removed then null else word end, ' ' order by j) as kept
  from marked group by doc_id
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(r, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join sums on d.doc_id = sums.doc_id
"""
