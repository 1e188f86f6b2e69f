"""Nearest neighbours by inner product: balanced posting lists in front of exact scores.

Every vector gets one more coordinate that brings all of them to one length (queries get
0), so that the nearest by distance is the one of the largest inner product.  A bounded
sample of at most ``SAMPLE`` rows (and ``SAMPLE_ENTRIES`` entries) is halved along the
line between two means until a part holds ``LIST`` vectors' share: at most ``LISTS``
lists of like size.  Their centres are searched through a graph in memory: some centres
spread over the tree as entries, then waves of the nearest and a few far links of each.

Every row is indexed: under its nearest centre and, if it lies near a border, under
further ones whose distance is at most 1 + ``BORDER`` times that, ``COPIES`` in all.  A
query reads all lists whose centre is at most 1 + ``RATIO`` times as far as the nearest;
this ratio alone decides, there is no limit on lists or candidates.  Neighbouring lists
share a bin of about ``BIN`` postings, a list beyond that is dealt over several bins, so
no task holds more than a bin and a block of queries.  Scores are exact inner products in
double precision, taken in an order that depends on no block.

Equal vectors are one class with its ids, so copies cost no comparisons; of a class only
its ``nearest`` + 1 smallest ids can be among a query's nearest.

Defined results: rows whose id or vector is null, or whose vector is empty, zero or holds
a null or non-finite entry, take no part; nor do vectors that do not have the most
frequent length (of equally frequent lengths the largest stays).  A row is an id with a
vector: repeated rows count once, an id with several vectors is answered and listed for
each of them.  Ties go to the smaller id.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waybill.llm.blocks import fixed, groups
from waybill.llm.common import partitions, stage, table

NEAREST = 20
QUERIES_OF = 20
LIST = 128
LISTS = 8192
SAMPLE = 131_072
SAMPLE_ENTRIES = 1 << 24
COPIES = 2
BORDER = 0.05
RATIO = 0.22
BIN = 4096
QUERY_BLOCK = 4096
LINKS, FAR_LINKS, BEAM, SLACK = 16, 4, 32, 1.08
SEED = 20261212
_LANES = 64


def plain(rows: DataFrame) -> DataFrame:
    """vec_id and raw, the vector's bytes as doubles, of every row that takes part; once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for vector in batch.column("embedding"):
                values = vector.values if vector.is_valid else None
                ok = values is not None and len(values) and not values.null_count
                array = values.to_numpy().astype(np.float64) + 0.0 if ok else None  # no negative zeros
                raw.append(array.tobytes() if ok and np.isfinite(array).all() and array.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = narrow.filter("vec_id IS NOT NULL").mapInArrow(run, "vec_id long, raw binary").filter("raw IS NOT NULL")
    found = stage(found.dropDuplicates(["vec_id", "raw"]), "vectors")
    most = found.groupBy(F.length("raw").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.filter(F.length("raw") == (most["size"] if most else 0))


def classes_of(rows: DataFrame, nearest: int, queries_of: int) -> DataFrame:
    """cls, raw, ids (the smallest ones) and asks (whether a query is in it) of every vector."""
    place = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    first = rows.withColumn("_place", place).filter(F.col("_place") <= nearest + 1)
    ids = first.groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most nearest + 1
    asks = rows.filter(F.col("vec_id") % queries_of == 0).select("raw", F.lit(True).alias("asks")).distinct()
    joined = ids.join(asks, "raw", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    # Written once: the numbers stay with their vectors whatever is run again later.
    return stage(joined.withColumn("cls", F.monotonically_increasing_id()), "classes")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return fixed(batch.column("raw"), np.float64)


class Space:
    """Vectors scaled to a largest length of 1, with the coordinate that evens lengths."""

    def __init__(self, classes: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    v = _vectors(batch)
                    top = np.abs(v).max(axis=1)
                    length = np.sqrt(((v / top[:, None]) ** 2).sum(axis=1))
                    # Logarithms: a very large vector has a length beyond a double.
                    yield pa.RecordBatch.from_pydict({"size": [float((np.log(top) + np.log(length)).max())], "n": [len(batch)]})

        row = classes.select("raw").mapInArrow(run, "size double, n long").agg(F.max("size"), F.sum("n")).first()
        self.size, self.n = row[0] or 0.0, row[1] or 0

    def scaled(self, v: np.ndarray) -> np.ndarray:
        half = np.exp(-self.size / 2)
        return v * half * half

    def rows(self, v: np.ndarray) -> np.ndarray:
        v = self.scaled(v)
        rest = np.sqrt(np.maximum(1 - (v * v).sum(axis=1), 0))
        return np.hstack([v, rest[:, None]]).astype(np.float32)

    def queries(self, v: np.ndarray) -> np.ndarray:
        """At the rows' length, as a query's own length changes no order."""
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.hstack([v, np.zeros((len(v), 1))]).astype(np.float32)


def halved(x: np.ndarray, lists: int, seed: int = SEED) -> list[np.ndarray]:
    """Rows of ``x`` in ``lists`` parts of nearly equal size, neighbouring parts side by side."""
    rng = np.random.default_rng(seed)
    open_, done = [(np.arange(len(x)), lists)], []
    while open_:
        rows, parts = open_.pop()
        if parts == 1:
            done.append(rows)
            continue
        own = x[rows]
        one, two = own[rng.integers(len(rows), size=2)]
        cut = len(rows) * (parts // 2) // parts
        for _ in range(6):
            order = np.argsort(own @ (two - one), kind="stable")
            one, two = own[order[:cut]].mean(axis=0), own[order[cut:]].mean(axis=0)
        open_ += [(rows[order[cut:]], parts - parts // 2), (rows[order[:cut]], parts // 2)]
    return done


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all rows."""
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


class Centres:
    """The lists' centres and their graph."""

    def __init__(self, x: np.ndarray, lists: int):
        parts = halved(x, lists)
        c = np.stack([x[p].mean(axis=0) for p in parts])
        for _ in range(2):  # each centre to the middle of what is nearest to it
            near = np.concatenate([distances(x[k : k + 4096], c).argmin(axis=1) for k in range(0, len(x), 4096)])
            counts = np.bincount(near, minlength=lists)
            sums = np.stack([np.bincount(near, col, lists) for col in x.T.astype(float)], 1)
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c).astype(np.float32)
        self.c = c
        k = min(LINKS + 1, lists)
        near = [np.argpartition(distances(c[s : s + 1024], c), k - 1, axis=1)[:, :k] for s in range(0, lists, 1024)]
        far = np.random.default_rng(SEED).integers(lists, size=(lists, FAR_LINKS))
        self.links = np.hstack([np.concatenate(near), far])
        self.entries = np.arange(0, lists, max(1, int(np.sqrt(lists))))

    def near(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of each list at most 1 + ratio times as far as the nearest."""
        found = [(s, *self._near(x[s : s + _LANES], ratio)) for s in range(0, len(x), _LANES)]
        rows, lists, far = ([f[k] for f in found] for k in (1, 2, 3))
        rows = [r + f[0] for r, f in zip(rows, found, strict=True)]
        return np.concatenate(rows), np.concatenate(lists), np.concatenate(far)

    def _near(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.c)
        far = np.full((len(x), k), np.inf, np.float32)
        apart = x[:, None, :] - self.c[self.entries]
        far[:, self.entries] = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
        opened = np.zeros(far.shape, bool)

        def wave(bound: np.ndarray) -> bool:
            """Visit the neighbours of all unopened centres within the bound."""
            rows, lists = np.nonzero((far <= bound[:, None]) & ~opened)
            if not len(rows):
                return False
            opened[rows, lists] = True
            to = (rows[:, None] * k + self.links[lists]).ravel()
            to = np.unique(to[np.isinf(far.ravel()[to])])
            for start in range(0, len(to), 1 << 15):
                row, at = np.divmod(to[start : start + (1 << 15)], k)
                apart = x[row] - self.c[at]
                far[row, at] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            return True

        beam = min(BEAM, k) - 1
        while wave(np.minimum(np.partition(far, beam, axis=1)[:, beam], np.finfo(np.float32).max)):
            pass
        # Somewhat beyond the ratio, as a way to a centre within it may lead outside.
        while wave(far.min(axis=1) * np.float32(SLACK * (1 + ratio))):
            pass
        rows, lists = np.nonzero(far <= far.min(axis=1, keepdims=True) * np.float32(1 + ratio))
        return rows, lists, far[rows, lists]


def fitted(classes: DataFrame, space: Space) -> Centres:
    """Centres from a bounded sample, drawn by a hash of the vector."""
    width = len(classes.select("raw").first().raw) // 8 + 1
    most = max(1, min(SAMPLE, SAMPLE_ENTRIES // width))
    drawn = F.pmod(F.xxhash64(F.lit(12), "raw"), F.lit(1 << 30))
    share = min(1.0, 1.2 * most / max(space.n, 1))
    some = classes.select("raw", drawn.alias("_drawn")).filter(F.col("_drawn") < int(share * (1 << 30)) + 1)
    got = some.orderBy("_drawn", "raw").limit(most).select("raw").collect()
    x = space.rows(np.stack([np.frombuffer(r.raw, np.float64) for r in got]))
    # A list of the whole table holds LIST vectors; one of the sample has four at least.
    return Centres(x, max(1, min(LISTS, -(-space.n // LIST), len(x) // 4)))


def postings(classes: DataFrame, space: Space, centres: Centres) -> DataFrame:
    """(list, cls, raw, first) for every class and list it stands in; first is its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 4096):
                batch = big.slice(start, 4096)
                row, at, far = centres.near(space.rows(_vectors(batch)), BORDER)
                order = np.lexsort((at, far, row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < COPIES], at[place < COPIES]
                some = batch.select(["cls", "raw", "first"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *some.columns], ["list", "cls", "raw", "first"])

    narrow = classes.select("cls", "raw", F.element_at("ids", 1).alias("first"))
    return narrow.mapInArrow(run, "list int, cls long, raw binary, first long")


class Bins:
    """Where each list's postings are: its first bin and over how many it is dealt."""

    def __init__(self, counts: np.ndarray, size: int):
        self.first, self.parts = np.zeros(len(counts), np.int64), np.maximum(-(-counts // size), 1)
        at = held = 0
        for k, n in enumerate(counts.tolist()):
            if held and held + n > size:
                at, held = at + 1, 0
            self.first[k] = at
            if self.parts[k] > 1:
                at, held = at + int(self.parts[k]), 0
            else:
                held += n


def _asked(classes: DataFrame, space: Space, centres: Centres, bins: Bins) -> DataFrame:
    """(key, lists, cls, raw) for every query and bin that it reads; lists are 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 512):
                batch = big.slice(start, 512)
                row, at, _ = centres.near(space.queries(_vectors(batch)), RATIO)
                times = bins.parts[at]
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, at = np.repeat(row, times), np.repeat(at, times)
                where = bins.first[at] + within
                order = np.lexsort((at, where, row))
                row, at, where = row[order], at[order].astype(np.int32), where[order]
                cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (where[1:] != where[:-1])]))
                ends = np.append(cuts[1:], len(row))
                lists = [at[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
                some = batch.select(["cls", "raw"]).take(pa.array(row[cuts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[cuts]), pa.array(lists, pa.binary()), *some.columns], ["key", "lists", "cls", "raw"]
                )

    return classes.filter("asks").select("cls", "raw").mapInArrow(run, "key long, lists binary, cls long, raw binary")


def _best(scores: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores, ties by the smaller id."""
    return np.lexsort((first, -scores))[:most]


def _scored(dealt: DataFrame, most: int) -> DataFrame:
    """(query, found): a query's best classes in a bin, as packed rows of (cls, first, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("raw", "lists")):
            asks = np.flatnonzero(g["kind"] == 1)
            rows = np.flatnonzero(g["kind"] == 0)
            if not len(asks) or not len(rows):
                continue
            v = fixed(g["raw"], np.float64)
            order = rows[np.argsort(g["list"][rows], kind="stable")]
            names, starts = np.unique(g["list"][order], return_index=True)
            ends = np.append(starts[1:], len(order))
            wanted = [np.frombuffer(g["lists"][int(k)].as_py(), np.int32) for k in asks]
            owner = np.repeat(np.arange(len(asks)), [len(w) for w in wanted])
            flat = np.concatenate(wanted)
            found: list[list[np.ndarray]] = [[] for _ in asks]
            for name, start, end in zip(names, starts, ends, strict=True):
                who = owner[flat == name]
                here = order[start:end]
                # The product picks somewhat more than are kept; kept ones are scored again
                # in an order of adding that no block decides.
                products = v[asks[who]] @ v[here].T
                few = min(len(here), most + 8)
                least = np.partition(products, len(here) - few, axis=1)[:, len(here) - few]
                for k, line, bound in zip(who.tolist(), products, least, strict=True):
                    found[k].append(here[line >= bound - 1e-12 * abs(bound)])
            names_of, packed = [], []
            for k, parts in enumerate(found):
                if not parts:
                    continue
                some = np.concatenate(parts)
                some = some[np.unique(g["cls"][some], return_index=True)[1]]
                scores = (v[some] * v[asks[k]]).sum(axis=1)
                best = some[keep := _best(scores, g["first"][some], most)]
                names_of.append(int(g["cls"][asks[k]]))
                packed.append(_pack(g["cls"][best], g["first"][best], scores[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(names_of, pa.int64()), pa.array(packed, pa.binary())], ["query", "found"])

    columns = ("key", "i", "j", "kind", "list", "lists", "cls", "first", "raw")
    return dealt.select(*columns).mapInArrow(run, "query long, found binary")


def _pack(cls: np.ndarray, first: np.ndarray, scores: np.ndarray) -> bytes:
    return np.stack([cls, first, scores.view(np.int64)], 1).tobytes()


def _merged(found: DataFrame, most: int) -> DataFrame:
    """(query, cls, score) of each query's best classes over all bins, kept while streaming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, np.zeros((0, 3), np.int64)
        done: list[tuple[int, np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            table = np.concatenate([h for _, h in done]) if done else held[:0]
            names = np.repeat(np.array([q for q, _ in done], np.int64), [len(h) for _, h in done])
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(table[:, 0]), pa.array(np.ascontiguousarray(table[:, 2]).view(np.float64))], ["query", "cls", "score"]
            )

        for batch in batches:
            for query, raw in zip(batch.column("query").to_pylist(), batch.column("found").to_pylist(), strict=True):
                if query != own:
                    if own is not None:
                        done.append((own, held))
                    own, held = query, held[:0]
                both = np.concatenate([held, np.frombuffer(raw, np.int64).reshape(-1, 3)])
                both = both[np.unique(both[:, 0], return_index=True)[1]]
                held = both[_best(np.ascontiguousarray(both[:, 2]).view(np.float64), both[:, 1], most)]
            if len(done) >= 1024:
                yield batch_of()
                done = []
        if own is not None:
            done.append((own, held))
        yield batch_of()

    count = partitions(found.sparkSession)
    ordered = found.repartition(count, "query").sortWithinPartitions("query")
    return ordered.mapInArrow(run, "query long, cls long, score double")


def neighbours(rows: DataFrame, nearest: int = NEAREST, queries_of: int = QUERIES_OF) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows found for every row of ``rows``
    (vec_id, embedding) whose id is divisible by ``queries_of``."""
    known = plain(rows)
    classes = classes_of(known, nearest, queries_of)
    space = Space(classes)
    spark = rows.sparkSession
    if not space.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = fitted(classes, space)
    posted = stage(postings(classes, space, centres), "postings")
    counts = np.zeros(len(centres.c), np.int64)
    for row in posted.groupBy("list").count().collect():  # at most LISTS rows
        counts[row["list"]] = row["count"]
    bins = Bins(counts, BIN)
    asked = stage(_asked(classes, space, centres, bins), "asked")
    # As many rows as lists: at most LISTS.
    places = F.broadcast(
        spark.createDataFrame(list(zip(range(len(counts)), bins.first.tolist(), bins.parts.tolist())), "list int, bin long, parts long")
    )
    # Bins that more than a block of queries reads are sent once for each block.
    blocks = asked.groupBy("key").agg(F.ceil(F.count("cls") / QUERY_BLOCK).cast("int").alias("blocks"))
    held = (
        posted.join(places, "list")
        .withColumn("key", F.col("bin") + F.pmod(F.xxhash64(F.lit("bin"), "cls"), F.col("parts")))
        .join(blocks, "key")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "i", F.lit(0).alias("kind"), "list", F.lit(b"").alias("lists"), "cls", "first", "raw")
    )
    asking = asked.join(blocks, "key").select(
        "key", F.pmod(F.xxhash64(F.lit("ask"), "cls"), F.col("blocks")).cast("int").alias("i"), F.lit(1).alias("kind"),
        F.lit(-1).alias("list"), "lists", "cls", F.lit(0).cast("long").alias("first"), "raw",
    )
    both = held.unionByName(asking).withColumn("j", F.lit(0))
    dealt = both.repartition(partitions(spark), "key", "i").sortWithinPartitions("key", "i")
    best = _merged(_scored(dealt, nearest + 1), nearest + 1)
    ids = best.join(classes.select("cls", F.explode("ids").alias("vec_id")), "cls")
    named = known.filter(F.col("vec_id") % queries_of == 0).join(classes.filter("asks").select("raw", "cls"), "raw")
    named = named.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query"))
    # Of all ids, those that can be among the nearest of some query of the class.
    inner = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ids = ids.withColumn("_place", inner).filter(F.col("_place") <= nearest + 1)
    pairs = named.join(ids, "query").filter((F.col("query_id") != F.col("vec_id")) | (F.col("query") != F.col("cls")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")).cast("int")
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
