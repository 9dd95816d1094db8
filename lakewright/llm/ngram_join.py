"""N-gram Jaccard join by MinHash banding, with exact verification.

1. Each text becomes the set of its word 5-grams (a text of 1-4 words: one
   gram of all its words); texts of equal sets form a class, found by one
   aggregation, so exact copies cost one row however many there are.
2. One representative per class is banded.  ``plan_bands`` picks bands and rows for
   the target recall at the threshold.  Classes are shuffled on band hashes; those that
   share a bucket are tied to the bucket's least class (a star), the ties of a class
   are reduced to its least hub, and the components of these ties bound where links can be.
3. Full n-gram sets are compared within units:
   a component of one block (``BLOCK`` classes and ``GRAMS`` grams) is one unit;
   a larger one whose buckets hold fewer pairs than itself is taken bucket by bucket, a
   pair being compared in the first bucket it shares only; a larger dense one is one
   unit.  A unit of several blocks is dealt as pairs of blocks.  All banded pairs are
   compared in every case, so which way is taken changes costs and no result but
   that a whole component also shows links that banding missed.  Tasks return link
   counts and a spanning forest of their links, never the pairs, so a group of g near
   copies costs O(g) rows of output.

Comparing g texts of one dense group takes g**2 / 2 set intersections, in
g**2 / (2 * BLOCK**2) tasks of bounded memory; link counts of all its members need that.

Defined results: a null or empty text has no grams, is in no class but its
own row's and has no links; rows of a null doc_id take part, and show null
where their own id would stand; repeated rows are copies of one another.  Very long texts
are whole.  Extra columns are ignored.  An empty table gives an empty result.  Words are compared by a
keyed universal hash of 64 bits (`_words.hash_words`), sets of grams by sums of 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.llm._common import cut, map_arrow, sized, table
from lakewright.llm._graph import connected
from lakewright.llm._words import U, hash_words, mix, ngrams, slices, tokens

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Classes and grams in a block, on average: they bound the memory of a task.
BLOCK, GRAMS = 512, 2_000_000


def plan_bands(threshold: float, recall: float, max_rows: int = 12) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - t**rows)**bands >= recall: as many rows a band, i.e. as
    few false candidates, as at most 150 hash functions allow."""
    best = (1, 1)
    for rows in range(1, max_rows + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
        if bands * rows <= 150:
            best = (bands, rows)
    return best


def _gram_sets(offsets, data, k):
    """Per row the sorted distinct 64-bit grams."""
    starts, ends, first = tokens(offsets, data)
    h = hash_words(data, starts, ends)
    _, g, bounds = ngrams(h, first, k)
    for r in range(len(offsets) - 1):
        n = first[r + 1] - first[r]
        if n >= k:
            yield np.unique(g[bounds[r] : bounds[r + 1]])
        elif n:
            short = np.zeros(1, dtype=U)
            for x in h[first[r] : first[r + 1]]:
                short = mix(short * U(31) + x)
            yield short
        else:
            yield h[:0]


def _class_key(s: np.ndarray) -> bytes:
    return np.array([mix(s).sum(dtype=U), mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) + U(len(s))], dtype=U).tobytes()


def signer(k: int, bands: int, rows: int):
    """Batches (doc_id, mark, text) as (doc_id, mark, key, bands, n_grams): MinHash bands of the
    sets of k-word grams; key and bands are null without words."""
    rng = np.random.default_rng(10)
    mul = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
    weights = rng.integers(0, 1 << 63, rows, dtype=U) | U(1)

    def sign(s: np.ndarray) -> list[int]:
        low = (s >> U(32)).astype(np.uint32)
        least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(low), 1024):
            np.minimum(least, (low[i : i + 1024] * mul + add).min(axis=1), out=least)
        return mix((least.reshape(bands, rows).astype(U) * weights).sum(axis=1, dtype=U) + np.arange(bands, dtype=U)).view(np.int64)

    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, offsets, data in slices(texts):
                keys, signs, sizes = [], [], []
                for s in _gram_sets(offsets, data, k):
                    sizes.append(len(s))
                    keys.append(_class_key(s) if len(s) else None)
                    signs.append(sign(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), marks.slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                    ["doc_id", "mark", "key", "bands", "n_grams"],
                )

    return run


def _set_maker(k: int):
    """Batches (text, key, ...) with the text replaced by its gram set, if that has the key."""

    def run(batches):
        for batch in batches:
            for lo, hi, offsets, data in slices(batch.column(0)):
                sets = list(_gram_sets(offsets, data, k))
                part = batch.slice(lo, hi - lo)
                same = [(_class_key(s) if len(s) else None) == w for s, w in zip(sets, part.column(1).to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[1:]], names=["grams", *part.schema.names[1:]])
                yield out.filter(pa.array(same, pa.bool_()))

    return run


def links_within(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, threshold: float, before: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Link counts (weighted by copies) of every member and a spanning forest of the links.

    side is 0/1 for a pair of different blocks (only links across count) or
    -1 throughout for a block with itself.  before holds the bands of each
    member that come before the unit's own: pairs that agree in one of these belong there.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    grams = np.concatenate(sets) if n else np.zeros(0, dtype=U)
    _, code, df = np.unique(grams, return_inverse=True, return_counts=True)
    shared = df[code] > 1
    owner, code = owner[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    inter = np.zeros((n, n), dtype=np.float32)
    width, i = 2048, 0
    while i < len(code):
        j = int(np.searchsorted(code, code[i] + width))
        dense = np.zeros((n, width), dtype=np.float32)
        dense[owner[i:j], code[i:j] - code[i]] = 1
        inter += dense @ dense.T
        i = j
    union = size[:, None] + size[None, :] - inter
    linked = inter >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if side[0] >= 0:
        linked &= side[:, None] != side[None, :]
    if before is not None:
        for band in before.T:
            linked &= band[:, None] != band[None, :]
    counts = linked @ weight
    root = np.arange(n)

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
        ra, rb = top(a), top(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            forest.append((int(a), int(b)))
    return counts, forest


_VERIFIED = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])


def _verifier(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        keys, blocks, bands = (group.column(c).to_pylist() for c in ("key", "block", "bands"))
        at = sorted(range(len(keys)), key=lambda i: keys[i])
        grams, docs = group.column("grams"), group.column("n_docs").to_pylist()
        sets = [np.frombuffer(grams[i].as_py(), dtype=U) for i in at]
        side = np.array([blocks[i] for i in at])
        if side.min() == side.max():
            if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
                return _VERIFIED.empty_table()
            side[:] = -1
        else:
            side = (side != side.min()).astype(np.int64)
        before = None
        if bands[0] is not None:
            before = np.array([bands[i] for i in at], dtype=np.int64)
            before = before[:, : int(np.flatnonzero(before[0] == group.column("unit")[0].as_py())[0])]
        counts, forest = links_within(sets, side, np.array([docs[i] for i in at], dtype=np.int64), threshold, before)
        rows = [(keys[i], None, int(c)) for i, c in zip(at, counts, strict=True) if c]
        rows += [(keys[at[a]], keys[at[b]], 0) for a, b in forest]
        return pa.Table.from_pylist([dict(zip(("key", "other", "links"), r, strict=True)) for r in rows], schema=_VERIFIED)

    return run


def _units(classes: DataFrame, block: int, grams: int) -> DataFrame:
    """(code, units) for every class that shares a bucket: the units it is compared in, as
    structs of unit, n_blocks and banded.  A code is a 64-bit name of a class that serves
    candidate search alone: should two classes share one, they are compared once more."""
    bucket = classes.select("code", "n_grams", F.explode("bands").alias("bucket"))
    blocks = lambda n, g: F.ceil(F.greatest(n / F.lit(block), g / F.lit(grams))).cast("int")
    stars = bucket.groupBy("bucket").agg(F.min("code").alias("hub"), F.count("*").alias("n"), F.sum("n_grams").alias("g")).where("n > 1")
    stars = cut(stars.select(F.col("bucket").alias("unit"), "hub", "n", blocks(F.col("n"), F.col("g")).alias("n_blocks")))
    shared = bucket.join(stars, F.col("bucket") == F.col("unit")).groupBy("code").agg(F.max("n_grams").alias("n_grams"), F.min("hub").alias("least"), F.collect_set(F.struct("unit", "hub", "n_blocks")).alias("buckets"))
    shared = cut(shared)
    ties = shared.select(F.explode(F.array_append(F.col("buckets.hub"), F.col("code"))).alias("a"), F.col("least").alias("b"))
    # A hub that shares no bucket with another class does not exist, so every code has a label.
    labels = connected(ties)
    named = shared.join(labels, F.col("code") == F.col("node")).select("code", "n_grams", "label", "buckets")
    pairs = stars.join(labels, F.col("hub") == F.col("node")).groupBy("label").agg(F.sum(F.col("n") * F.col("n").cast("double")).alias("in_buckets")).withColumnRenamed("label", "of")
    size = named.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g")).join(pairs, F.col("label") == F.col("of"))
    split = (blocks(F.col("n"), F.col("g")) > 1) & (F.col("in_buckets") < F.col("n") * F.col("n").cast("double"))
    plan = cut(size.select(F.col("label").alias("of"), blocks(F.col("n"), F.col("g")).alias("n_blocks"), split.alias("split")))
    whole = F.array(F.struct(F.col("label").alias("unit"), "n_blocks", F.lit(False).alias("banded")))
    by_bucket = F.transform("buckets", lambda b: F.struct(b["unit"].alias("unit"), b["n_blocks"].alias("n_blocks"), F.lit(True).alias("banded")))
    return named.join(plan, F.col("label") == F.col("of")).select("code", F.when(F.col("split"), by_bucket).otherwise(whole).alias("units"))


def _rep(doc_id: str = "doc_id", mark: str = "mark"):
    """Names a row by id and text hash; a null id comes last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(mark).alias("mark"))


def _judged(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, grams: int = GRAMS) -> DataFrame:
    """The rows of ngram_jaccard_join with the hash of the text, the class key and the label
    of the connected group, which no other group shares, whatever its ids; key and label
    are null without words."""
    bands, rows = plan_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    signed = cut(map_arrow(texts, signer(words, bands, rows), "doc_id long, mark long, key binary, bands array<long>, n_grams long"))
    full, bare = signed.where("key is not null"), signed.where("key is null")
    classes = full.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"), F.min(_rep()).alias("rep"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    classes = cut(classes.withColumn("code", F.xxhash64("key")))
    of_code = _units(classes, block, grams).withColumnRenamed("code", "of")
    wanted = cut(classes.join(of_code, F.col("code") == F.col("of")).select("rep.*", "key", "n_docs", "bands", "units").withColumnRenamed("mark", "r_mark"))
    # Rows that repeat the representative row are dropped here, with map-side combine.
    same = (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("doc_id").isNull() == F.col("none")) & (F.col("mark") == F.col("r_mark"))
    # The side that may be broadcast holds names alone; the rest joins on the key the texts are dealt by already.
    names = sized(wanted.select("none", "id", "r_mark", "key"), 250_000)
    chosen = texts.join(names, same).groupBy("key").agg(F.first("text").alias("text")).join(wanted.select("key", "n_docs", "bands", "units").hint("shuffle_merge"), "key")
    sets = map_arrow(
        chosen.select("text", "key", "n_docs", "bands", "units"),
        _set_maker(words),
        "grams binary, key binary, n_docs long, bands array<long>, units array<struct<unit: long, n_blocks: int, banded: boolean>>",
    )
    block_of = F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")
    dealt = (
        sets.select("key", "n_docs", "grams", "bands", F.inline("units"))
        .withColumn("bands", F.when(F.col("banded"), F.col("bands")))
        .withColumn("block", block_of)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("unit", "banded", "key", "n_docs", "grams", "bands", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )
    verified = cut(dealt.groupBy("unit", "banded", "bi", "bj").applyInArrow(_verifier(threshold), "key binary, other binary, links long"))
    links = verified.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    groups = connected(verified.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = cut(groups.join(classes, groups.node == classes.key).select("key", "label", "class_id"))
    least = cut(named.groupBy("label").agg(F.min("class_id").alias("group_id")))
    told = named.join(least, "label").select("key", "group_id", "label").join(links, "key", "left")
    # Cut here, so that the join below has two plain sides and adaptive execution may split a class of many copies.
    known = cut(classes.select("key", "class_id", "n_docs").join(told, "key", "left"))
    n_links, none = F.col("n_docs") - 1 + F.coalesce("links", F.lit(0)), F.lit(None).cast("binary")
    of_full = full.join(known, "key").select(
        "doc_id", "class_id", n_links.alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), "n_grams", "mark", "key", F.coalesce("label", "key").alias("label")
    )
    return of_full.unionByName(
        bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), "n_grams", "mark", none.alias("key"), none.alias("label"))
    )


def ngram_jaccard_join(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id (least doc_id with the
    same gram set), n_links (other documents with Jaccard similarity of at least
    threshold, copies included), group_id (least doc_id of its connected group) and
    n_grams.  how: words, threshold, recall, block and grams."""
    return _judged(docs, **how).drop("mark", "key", "label")


def one_per_group(docs: DataFrame, words: int = WORDS, **how) -> DataFrame:
    """The rows of docs without all but one of each group of near-duplicates.

    The row with the least doc_id stays, one with a null doc_id only if no other is
    there.  Rows without words stay.  Rows are told apart by doc_id and text, so what
    happens to one never touches an unlinked row of the same, or no, doc_id.  If a
    doc_id names several rows of a group, the first by hash of the text stays; of rows
    that agree in both, one: the first by the columns that have an order.
    """
    judged = cut(_judged(docs, words, **how).where("n_grams > 0 and n_links > 0").select("label", _rep().alias("row")))
    kept = judged.groupBy("label").agg(F.min("row").alias("row")).select("row")
    rows = judged.groupBy("row").count()
    gone = cut(rows.join(kept, "row", "left_anti").select("row.*"))
    twice = cut(rows.where("count > 1").join(kept, "row", "left_semi").select("row.*"))
    # Names that no column of docs has, in whatever case.
    taken = {c.lower() for c in docs.columns}
    row, nth, *gone_names = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("row", "nth", "none", "id", "mark"))
    marked = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark")))
    same = [F.col(f"{row}.{c}") == F.col(n) for c, n in zip(("none", "id", "mark"), gone_names, strict=True)]
    named = lambda x: x.select(*(F.col(c).alias(n) for c, n in zip(("none", "id", "mark"), gone_names, strict=True)))
    left = marked.join(sized(named(gone)), same, "left_anti")
    if twice.isEmpty():
        return left.drop(row)
    again = sized(named(twice))
    plain = left.join(again, same, "left_anti").drop(row)
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # A limit of one row a window is also applied before the shuffle.
    first = left.join(again, same, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(*ordered)))
    return plain.unionByName(first.where(F.col(nth) == 1).drop(row, nth))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
