"""Benchmark passages in training texts, by a positional inverted index.

``build_index`` stores the postings of all training words in segments: one row per
slice of documents, with its terms in order and each term's word positions.  The
segments are dealt over the cluster as the documents are; nothing is shuffled.

``search`` answers the benchmark on every segment.  A window is alive where all its
terms occur.  The postings of its rarest term, moved by the term's place in the
window, are the first candidates; they are intersected with the moved postings of the
next rarest terms until all agree (exact phrases).  An item's ``NEAR_TERMS`` rarest
terms within ``NEAR_WORDS`` words of each other count as a proximity match.

The benchmark is measured first and passes through the driver in shards of about
``SHARD_BYTES`` of text, one at a time: its answers are written before the next one is
read, and the answers of a document are put together at the end.  Terms are 64-bit word
hashes.  ``contamination`` digests the exact matches, ``nearby_items`` lists the
proximity matches.

Null and empty texts have no words and no hits.  Items without id or words match
nothing; items with the same id count once.  One row comes back per document row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import documents, stage, table
from waybill.llm.words import ALNUM, hashed, slices

WINDOW = 10
NEAR_TERMS = 3
NEAR_WORDS = 25
SHARD_BYTES = 4 << 20
# Candidates looked at together.
_AT_ONCE = 1 << 20

_SEGMENT = "segment long, doc_ids array<long>, n_words binary, terms binary, counts binary, deltas binary"
_FOUND = "segment long, place int, spans binary, items array<string>, near array<string>"
_DIGEST = "segment long, place int, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment: documents, terms, counts and positions (as differences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            words, firsts = hashed(batch.column("text"), ALNUM)
            order = np.argsort(words, kind="stable").astype(np.int32)
            ordered = words[order]
            new = np.ones(len(ordered), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            begins = np.flatnonzero(new)
            counts = np.diff(np.append(begins, len(ordered))).astype(np.int32)
            deltas = np.diff(order, prepend=np.int32(0)).astype(np.int32)
            binary = [np.diff(firsts).astype(np.int64), ordered[begins], counts, deltas]
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *(pa.array([b.tobytes()], pa.binary()) for b in binary)],
                ["segment", "doc_ids", "n_words", "terms", "counts", "deltas"],
            )
            segment += 1

    return documents(docs, "doc_id", "text").mapInArrow(run, _SEGMENT)


@dataclass
class Shard:
    """Part of a benchmark: item words as numbers of its own vocabulary."""

    ids: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    starts: np.ndarray  # of windows, in words
    sizes: np.ndarray
    owners: np.ndarray  # item of each window
    rarity: np.ndarray = field(default=None)  # corpus count of each vocabulary word
    near_items: np.ndarray = field(default=None)  # items with enough terms, and the rarest of each
    near_words: np.ndarray = field(default=None)

    def weigh(self, counts: np.ndarray) -> None:
        """Take in the corpus counts; choose each item's rarest terms."""
        self.rarity = counts
        ends = np.append(np.flatnonzero(np.diff(self.owners)), len(self.owners) - 1)
        begins = np.append(0, ends[:-1] + 1)
        near = []
        for b, e in zip(begins, ends, strict=True):
            own = np.unique(self.words[self.starts[b] : self.starts[e] + self.sizes[e]])
            if len(own) >= NEAR_TERMS:
                # Words of equal count go by their hash, which no shard changes.
                near.append((int(self.owners[b]), own[np.lexsort((self.vocabulary[own], counts[own]))][:NEAR_TERMS]))
        self.near_items = np.array([i for i, _ in near], np.int64)
        self.near_words = np.array([w for _, w in near], np.int64).reshape(-1, NEAR_TERMS)


def make_shard(items: list[tuple[str, str]]) -> Shard | None:
    """Words and windows of (id, text) items; None if there are no words."""
    words, firsts = hashed(pa.array([t for _, t in items], pa.string()), ALNUM)
    if not len(words):
        return None
    vocabulary, words = np.unique(words, return_inverse=True)
    starts, sizes, owners = [], [], []
    for k, n in enumerate(np.diff(firsts)):
        if n:
            windows = max(1, n - WINDOW + 1)
            starts.append(firsts[k] + np.arange(windows))
            sizes.append(np.full(windows, min(n, WINDOW)))
            owners.append(np.full(windows, k))
    joined = (np.concatenate(x) for x in (starts, sizes, owners))
    return Shard([i for i, _ in items], vocabulary, words.astype(np.int64), *joined)


def benchmark_shards(bench: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Shard]:
    """The benchmark in shards of bounded size, one after the other on the driver."""
    items = (
        bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .filter("item_id IS NOT NULL AND text IS NOT NULL")
        .distinct()
    )
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-size // shard_bytes))
    for k in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        if shard := make_shard(sorted((r.item_id, r.text) for r in part.collect())):
            yield shard


def corpus_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each vocabulary word occurs in all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    total += np.where(terms[at] == vocabulary, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    rows = (
        index.select("terms", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    counts = np.zeros(len(vocabulary), np.int64)
    for row in rows.collect():  # at most one row per word of a shard
        counts[row.word] = row.n
    return counts


class Segment:
    """One stored segment, opened for a shard's words."""

    def __init__(self, row: dict, shard: Shard):
        self.ends = np.cumsum(np.frombuffer(row["n_words"], np.int64))
        terms, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32)
        self.positions = np.cumsum(np.frombuffer(row["deltas"], np.int32), dtype=np.int64)
        at = np.searchsorted(terms, shard.vocabulary)
        inside = np.minimum(at, max(0, len(terms) - 1))
        hit = (terms[inside] == shard.vocabulary) if len(terms) else np.zeros(len(at), bool)
        begins = np.cumsum(counts, dtype=np.int64) - counts
        self.term = np.where(hit, inside, -1)
        self.lo = np.where(hit, begins[inside] if len(terms) else 0, 0)
        self.n = np.where(hit, counts[inside] if len(terms) else 0, 0)
        self._keys, self._counts = None, counts

    def keys(self) -> np.ndarray:
        """Term number and position in one sorted key."""
        if self._keys is None:
            numbers = np.repeat(np.arange(len(self._counts), dtype=np.int64), self._counts)
            self._keys = (numbers << 32) | self.positions
        return self._keys

    def postings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of each given word, and which of them each position is of."""
        n = self.n[words]
        who = np.repeat(np.arange(len(words)), n)
        within = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        return self.positions[self.lo[words][who] + within], who

    def next_at(self, words: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First position of each word from ``least`` on; a huge number if none."""
        keys = self.keys()
        at = np.searchsorted(keys, (self.term[words] << 32) | np.maximum(least, 0))
        got = keys[np.minimum(at, len(keys) - 1)]
        ok = (at < len(keys)) & (got >> 32 == self.term[words])
        return np.where(ok, got & 0xFFFFFFFF, np.int64(1) << 40)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")


def phrases(segment: Segment, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and item of every exact occurrence of a window."""
    absent = np.cumsum(np.append(0, segment.term[shard.words] < 0))
    alive = np.flatnonzero(absent[shard.starts + shard.sizes] == absent[shard.starts])
    out = [(np.zeros(0, np.int64),) * 3]
    for size in np.unique(shard.sizes[alive]):
        windows = alive[shard.sizes[alive] == size]
        words = shard.words[shard.starts[windows][:, None] + np.arange(size)]
        rarest = np.argsort(shard.rarity[words], axis=1, kind="stable")
        seeds = segment.n[words[np.arange(len(words)), rarest[:, 0]]]
        groups = np.cumsum(seeds) // _AT_ONCE
        for group in np.unique(groups):
            rows = np.flatnonzero(groups == group)
            offset = rarest[rows, 0]
            positions, who = segment.postings(words[rows, offset])
            start, row = positions - offset[who], rows[who]
            for step in range(1, size):
                place = rarest[row, step]
                ok = (start >= 0) & (segment.next_at(words[row, place], start + place) == start + place)
                start, row = start[ok], row[ok]
                if not len(start):
                    break
            ok = start >= 0
            start, row = start[ok], row[ok]
            ok = segment.document(start) == segment.document(start + size - 1)
            start, row = start[ok], row[ok]
            out.append((start, np.full(len(start), size), shard.owners[windows[row]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def proximity(segment: Segment, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Document and item where the item's rarest terms stand near each other, all items together."""
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    alive = np.flatnonzero((segment.term[shard.near_words] >= 0).all(axis=1))
    words = shard.near_words[alive]
    groups = np.cumsum(segment.n[words[:, 0]]) // _AT_ONCE
    for group in np.unique(groups):
        own = words[groups == group]
        positions, who = segment.postings(own[:, 0])
        doc = segment.document(positions)
        begins = np.where(doc > 0, segment.ends[doc - 1], 0)
        for step in range(1, NEAR_TERMS):
            least = np.maximum(positions - NEAR_WORDS + 1, begins)
            got = segment.next_at(own[who, step], least)
            ok = got < np.minimum(positions + NEAR_WORDS, segment.ends[doc])
            positions, who, doc, begins = positions[ok], who[ok], doc[ok], begins[ok]
        docs.append(doc)
        items.append(shard.near_items[alive[groups == group][who]])
    return np.concatenate(docs), np.concatenate(items)


def _by_document(docs: np.ndarray, items: np.ndarray, ids: list[str], n: int) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(n)]
    for d, i in sorted(set(zip(docs.tolist(), items.tolist(), strict=True))):
        out[d].append(ids[i])
    return out


def search(index: DataFrame, shard: Shard) -> DataFrame:
    """Hit spans, items found and items nearby, of the documents that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                segment = Segment(row, shard)
                n = len(row["doc_ids"])
                start, size, item = phrases(segment, shard)
                doc = segment.document(start)
                local = start - np.where(doc > 0, segment.ends[doc - 1], 0)
                spans = np.stack([local, local + size], 1)
                near_doc, near_item = proximity(segment, shard)
                some = np.unique(np.concatenate([doc, near_doc]))
                listed = [np.unique(spans[doc == d], axis=0).tobytes() for d in some]
                found, near = _by_document(doc, item, shard.ids, n), _by_document(near_doc, near_item, shard.ids, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(some), pa.int64()), pa.array(some.astype(np.int32)),
                     pa.array(listed, pa.binary()), pa.array([found[d] for d in some], pa.list_(pa.string())),
                     pa.array([near[d] for d in some], pa.list_(pa.string()))],
                    ["segment", "place", "spans", "items", "near"],
                )

    return index.mapInArrow(run, _FOUND)


def documents_of(index: DataFrame) -> DataFrame:
    """segment, place, doc_id and n_words of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, ids, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()),
                     pa.array(ids, pa.int64()), pa.array(np.frombuffer(sizes, np.int64))],
                    ["segment", "place", "doc_id", "n_words"],
                )

    kinds = "segment long, place int, doc_id long, n_words long"
    return index.select("segment", "doc_ids", "n_words").mapInArrow(run, kinds)


def answers(index: DataFrame, bench: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What ``search`` finds of the whole benchmark, one row per document with any match."""
    spark, found = index.sparkSession, None
    for shard in benchmark_shards(bench, shard_bytes):
        shard.weigh(corpus_counts(index, shard.vocabulary))
        part = stage(search(index, shard), "answers")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    # Spans are fixed-size pairs, so the shards' bytes can follow each other.
    spans = F.unhex(F.concat_ws("", F.collect_list(F.hex("spans")))).alias("spans")
    return found.groupBy("segment", "place").agg(spans, *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near")))


def _covered(spans: bytes) -> int:
    """Words inside any span."""
    total = done = 0
    for start, end in sorted(np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()):
        total += max(0, end - max(start, done))
        done = max(done, end)
    return total


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [_covered(s) for s in batch.column("spans").to_pylist()]
        items = [sorted(set(i)) for i in batch.column("items").to_pylist()]
        near = [len(set(i)) for i in batch.column("near").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("segment"), batch.column("place"), pa.array(hits, pa.int64()),
             pa.array(map(len, items), pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
             pa.array([h > 0 for h in hits], pa.bool_()), pa.array(near, pa.int64())],
            ["segment", "place", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"],
        )


def contamination(docs: DataFrame, bench: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: words, words hit, items found, near items."""
    index = stage(build_index(docs), "postings")
    # Digested before the join: after it, in one pass with the documents, two Python
    # workers would be held for every core.
    digests = answers(index, bench, shard_bytes).select("segment", "place", "spans", "items", "near").mapInArrow(_digest, _DIGEST)
    found = documents_of(index).join(digests, ["segment", "place"], "left")
    none = {"n_hit": 0, "n_items": 0, "items_sha256": hashlib.sha256().hexdigest(), "contaminated": False, "n_near_items": 0}
    return found.na.fill(none).select("doc_id", "n_words", *none)


def nearby_items(docs: DataFrame, bench: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id and item_id of every document in which an item's rarest terms stand together."""
    index = stage(build_index(docs), "postings")
    found = answers(index, bench, shard_bytes).filter(F.size("near") > 0)
    named = documents_of(index).join(found, ["segment", "place"])
    return named.select("doc_id", F.explode("near").alias("item_id")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near_items")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Words are followed one by one from each place where a window's first word stands.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN windows w ON p.size = w.size AND p.phrase = w.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
