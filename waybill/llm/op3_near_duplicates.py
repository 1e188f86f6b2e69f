"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

1. One pass over the texts makes each document's set of word shingles (64-bit hashes),
   its size, an order-free 128-bit fingerprint and a MinHash signature.  Equal sets
   become one class, named by its smallest id; only classes go on.
2. Signatures are cut into bands.  In each bucket every class is paired with the
   bucket's smallest, its pivot: as many pairs as members, however large the bucket.
3. A pair's signatures are compared in batches.  After each batch the pair is dropped
   if the posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``MISS``.  Survivors are verified exactly on their full sets.
4. Each class is tried with its smallest pivot first and, if that does not link it, with
   its other pivots.  Where a bucket still holds classes of several components, they meet
   block by block with their full sets: a task prunes, verifies and gives back a spanning
   forest.  So no pair of different components that shares a bucket is left out, and no
   pair beyond a class's pivots ever becomes a row.

A text without words, empty or null has no shingles and links with nothing; with fewer
words than a shingle takes, the whole sequence is one shingle.  Rows without an id keep
their size, link with nothing, have no component and are kept.  Repeated rows share a
component; rows of one id with different texts count as one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.blocks import block_ids, fixed, groups
from waybill.llm.common import documents, partitions, small_batches, stage, table
from waybill.llm.graph import components, roots
from waybill.llm.words import hashed, mix, slices
from waybill.session import scratch_scope

WORDS = 3
PERCENT = 85
# Chance that a pair at the threshold shares no bucket, and of its early dismissal.
BAND_MISS = 1e-6
MISS = 1e-9
BATCH = 32
SEED = 20261201
# Bits of the filter that spares documents without candidates the second reading.
FILTER_BITS = 1 << 24
_BITMAP = 32768
# A block of a bucket: so many members, and about so many bytes of their sets.
BLOCK = 1024
BLOCK_BYTES = 4 << 20


def bands_for(percent: int, miss: float = BAND_MISS) -> tuple[int, int]:
    """(bands, rows) with the most rows that need no more than 200 hashes."""
    best = (200, 1)
    for rows in range(1, 13):
        hit = (percent / 100) ** rows
        bands = int(np.ceil(np.log(miss) / np.log1p(-hit)))
        if bands * rows <= 200:
            best = (bands, rows)
    return best


def least_matches(percent: int, hashes: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on) after each batch.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n+1, t) <= m).
    """
    t, out = percent / 100, []
    for n in [*range(batch, hashes, batch), hashes]:
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survives(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two signature tables that no batch dismisses."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in steps:
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        done = n
    return alive


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    values, firsts = hashed(texts)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        n = min(words, b - a)
        if not n:
            yield values[:0]
            continue
        own = values[a:b]
        total = np.full(b - a - n + 1, np.uint64(n))
        for k in range(n):
            total += own[k : b - a - n + 1 + k] * factors[k]
        yield np.unique(mix(total))


class Sketch:
    """MinHash with multiply-add permutations of 32 bits."""

    def __init__(self, hashes: int):
        rng = np.random.default_rng(SEED)
        self.hashes = hashes
        self.a = (rng.integers(0, 1 << 31, hashes, np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.hashes, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(x), 2048):
            part = self.a * x[start : start + 2048]
            part += self.b
            np.minimum(least, part.min(axis=1), out=least)
        return least


def _sketches(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint k1 and k2, signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(hashes)
        for batch in slices(batches):
            sizes, one, two, signatures = [], [], [], []
            for own in shingle_sets(batch.column("text"), words):
                sizes.append(len(own))
                one.append(int(own.sum()) if len(own) else None)
                two.append(int(mix(own ^ np.uint64(SEED)).sum()) if len(own) else None)
                signatures.append(sketch(own).tobytes() if len(own) else None)
            keys = (pa.array(k, pa.uint64()).view(pa.int64()) for k in (one, two))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *keys, pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "signature"],
            )

    return documents(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, signature binary"
    )


def _bands(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, rep) for every band of every class; the band is part of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        own = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))
        for batch in batches:
            if len(batch):
                signs = fixed(batch.column("signature"), np.uint32)[:, : bands * rows].astype(np.uint64)
                keys = mix((signs.reshape(len(signs), bands, rows) * factors).sum(axis=2) + own)
                reps = np.repeat(batch.column("rep").to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, "key long, rep long")


class IdFilter:
    """Bits of a set of ids: no id of the set is refused, few others pass.

    Its size is fixed, so it may be sent to all tasks; exact joins follow it.
    """

    def __init__(self, ids: DataFrame, column: str):
        bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
        rows = ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
        )
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for row in rows.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
            start = (row.bucket - 1) * (_BITMAP // 8)
            self.bits[start : start + _BITMAP // 8] = np.frombuffer(row.bits, np.uint8)

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with what ``passing`` needs, without rows that lack the id."""
        bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
        return df.filter(F.col(column).isNotNull()).withColumn("_bit", bit)

    def passing(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """For use in a task: rows of a batch of ``marked`` whose id may be in the set."""
        bits = self.bits

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column("_bit").to_numpy()
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            return batch.select([n for n in batch.schema.names if n != "_bit"]).filter(pa.array(keep.astype(bool)))

        return run

    def select(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose id may be in the set."""
        passing = self.passing()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(passing, batches)

        return self.marked(df, column).mapInArrow(run, df.schema)


def _pruned(pairs: DataFrame, signs: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """The (a, b) pairs that sequential verification of the signatures keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                left, right = (fixed(batch.column(c), np.uint32) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).take(pa.array(survives(left, right, steps)))

    joined = pairs.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame, words: int, packed: bool = False) -> DataFrame:
    """doc_id and the whole shingle set of every document named by ``ids`` (id), maybe repeated.

    ``packed`` sets are bytes of sorted 64-bit numbers instead of arrays.  Texts are
    refused and split in one pass: two would hold two Python workers for every core.
    """
    some = IdFilter(ids, "id")
    passing = some.passing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(b for b in map(passing, batches) if len(b)):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), words)]
            if packed:
                column = pa.array([s.tobytes() for s in sets], pa.binary())
            else:
                cuts = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate(sets) if sets else [], pa.int64())
                column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "shingles"])

    texts = some.marked(documents(docs, "doc_id", "text"), "doc_id")
    sets = texts.mapInArrow(run, f"doc_id long, shingles {'binary' if packed else 'array<long>'}")
    sets = sets.join(ids.distinct(), sets["doc_id"] == F.col("id"), "left_semi")
    return stage(sets.dropDuplicates(["doc_id", "shingles"]), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = _full_sets(ids, docs, words)
    joined = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - common
    return joined.filter(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b")


def forest(
    signs: np.ndarray, sets: list[np.ndarray], label: np.ndarray, block: np.ndarray | None, steps: list[tuple[int, int]], percent: int
) -> list[tuple[int, int]]:
    """Links (places) that join all components of the members which true pairs connect.

    Each member is compared with all later ones of other components: signatures batch by
    batch first, then the full sets of the survivors, all in a few array operations.
    Members that one component holds by now are not compared again.  With ``block`` only
    pairs of different blocks count; the rest meet in other groups.
    """
    root = np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    _, flat = np.unique(flat, return_inverse=True)
    marked = np.zeros(len(flat) + 1, bool)
    links = []
    for k in range(len(sets) - 1):
        left = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
        if block is not None:
            left = left[block[left] != block[k]]
        matches, done = np.zeros(len(left), np.int64), 0
        for n, least in steps:
            if not len(left):
                break
            matches += (signs[left, done:n] == signs[k, done:n]).sum(axis=1)
            left, matches, done = left[matches >= least], matches[matches >= least], n
        if not len(left):
            continue
        own = flat[starts[k] : starts[k] + sizes[k]]
        marked[own] = True
        many = sizes[left]
        at = np.arange(many.sum()) + np.repeat(starts[left] - (np.cumsum(many) - many), many)
        common = np.add.reduceat(marked[flat[at]].astype(np.int64), np.cumsum(many) - many)
        marked[own] = False
        near = left[100 * common >= percent * (many + sizes[k] - common)]
        for place in np.unique(root[near], return_index=True)[1]:
            links.append((k, int(near[place])))
        root[np.isin(root, root[near])] = root[k]
    return links


def _unsettled(
    members: DataFrame, labels: DataFrame, docs: DataFrame, words: int, steps: list[tuple[int, int]], percent: int
) -> DataFrame:
    """Links (a, b) that join the components which share a bucket; no pair is a row.

    Of buckets with the same members one is enough.  The full sets travel with the
    members and their signatures are made of them again, so that a task prunes and
    verifies its block pairs and gives back a spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(steps[-1][0])
        for g in groups(batches, ("shingles",)):
            rep = g["rep"]
            sets = [np.frombuffer(s.as_buffer(), np.int64) for s in g["shingles"]]
            signs = np.stack([sketch(s.view(np.uint64)) for s in sets])
            block = g["block"] if g["i"][0] != g["j"][0] else None
            found = np.array(forest(signs, sets, g["label"], block, steps, percent), np.int64).reshape(-1, 2)
            a, b = rep[found[:, 0]], rep[found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    marked = members.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # Count and two hashes without order tell sets of members apart.
    same = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"same{k}") for k in (1, 2)]
    open_ = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("rep").alias("many"), *same)
    open_ = open_.filter("x <> y").groupBy("many", "same1", "same2").agg(F.min("key").alias("key")).select("key")
    unsettled = stage(marked.join(open_, "key").select("key", "rep", "label"), "unsettled")
    sets = _full_sets(unsettled.select(F.col("rep").alias("id")), docs, words, packed=True).toDF("rep", "shingles")
    sets = sets.filter(F.length("shingles") > 0)
    # Blocks of a bucket are bounded by members and by bytes.
    sized = unsettled.join(sets.select("rep", F.length("shingles").alias("bytes")), "rep")
    weight = F.greatest(F.count("rep"), F.ceil(F.sum("bytes") * BLOCK / BLOCK_BYTES))
    dealt = block_ids(unsettled.join(sized.groupBy("key").agg(weight.alias("n")), "key"), "rep", BLOCK)
    whole = dealt.join(sets, "rep")
    count = partitions(members.sparkSession)
    whole = whole.repartition(count, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return whole.select("key", "i", "j", "block", "rep", "label", "shingles").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    bands, rows = bands_for(percent)
    hashes = -(-bands * rows // BATCH) * BATCH
    steps = least_matches(percent, hashes)
    sketches = stage(_sketches(docs, words, hashes), "sketches")
    known = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = stage(classes, "classes")
    with scratch_scope(docs.sparkSession) as keep:
        banded = stage(_bands(classes, bands, rows), "bands")
        shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("rep").alias("n")).filter("n > 1")
        members = keep(banded.join(shared.select("key", "pivot"), "key"), "members")
    signs = stage(IdFilter(members, "rep").select(classes.select("rep", "signature"), "rep"), "signatures")
    star = members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    star = stage(star, "star")
    # One pair a class settles most; a class it does not link tries its other pivots.
    first = stage(_pruned(star.groupBy("a").agg(F.min("b").alias("b")), signs, steps), "pairs")
    links = stage(_verified(first, docs, words, percent), "verified")
    labels = roots(links)
    others = stage(_pruned(star.join(links.select("a"), "a", "left_anti"), signs, steps), "pairs")
    if not others.isEmpty():
        labels = components(labels.toDF("a", "b").unionByName(_verified(others, docs, words, percent)))
    more = stage(_unsettled(members, labels, docs, words, steps, percent), "links")
    if not more.isEmpty():
        labels = components(labels.toDF("a", "b").unionByName(more))
    named = classes.select("k1", "k2", "rep").join(labels.toDF("rep", "label"), "rep", "left")
    named = named.select("k1", "k2", F.coalesce("label", "rep").alias("label"))
    found = sketches.drop("signature").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
