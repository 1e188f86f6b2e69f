"""Frequent itemsets up to a length, counted in blocks of baskets.

A set that is frequent in all baskets is frequent in at least one block of them, in
proportion to the block.  So each block is mined by itself, never beyond the length
asked for, and the sets found anywhere are then counted exactly in all blocks.  A block
holds for every frequent item one bit per basket; a set's count is that of the bits all
its items share, so no pair of items of a basket ever becomes a row, and neither a low
support nor long baskets make sets beyond the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from waybill.operators.ranks import broadcast_if_small
from waybill.session import stage

# Baskets of a block, and the sets counted in one pass over the blocks.
BLOCK = 1 << 14
CHUNK = 100_000


def _blocks(coded: DataFrame, baskets: int, block: int) -> DataFrame:
    """(n, codes, bits): a block's number of baskets, its items and a row of bits for each."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        basket, codes = table.column("basket").combine_chunks(), table.column("code").to_numpy()
        same = pc.equal(basket[1:], basket[:-1]).to_numpy(zero_copy_only=False)
        number = np.concatenate([[0], np.cumsum(~same.astype(bool))])
        n = int(number[-1]) + 1
        items, row = np.unique(codes, return_inverse=True)
        bits = np.zeros((len(items), -(-n // 64) * 64), bool)
        bits[row, number] = True
        return pa.RecordBatch.from_pydict(
            {"n": pa.array([n], pa.int32()), "codes": [items.astype(np.int32).tobytes()], "bits": [np.packbits(bits, axis=1).tobytes()]}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        own = None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if own is not None and parts[start] != own:
                    yield packed(pa.concat_tables(held))
                    held = []
                own = parts[start]
                held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
        if held:
            yield packed(pa.concat_tables(held))

    part = F.pmod(F.xxhash64("basket"), F.lit(max(1, -(-baskets // block)))).alias("part")
    dealt = coded.select(part, "basket", "code").repartition("part").sortWithinPartitions("part", "basket")
    return dealt.mapInArrow(run, "n int, codes binary, bits binary")


def _unpacked(n: int, codes: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    items = np.frombuffer(codes, np.int32)
    return items, np.frombuffer(bits, np.uint8).reshape(len(items), -1).view(np.uint64)


def mined(items: np.ndarray, bits: np.ndarray, least: int, longest: int) -> list[list[int]]:
    """The sets of two to ``longest`` items that at least ``least`` baskets of a block hold."""
    out: list[list[int]] = []

    def extend(names: list[int], shared: np.ndarray, tail: np.ndarray) -> None:
        for k, place in enumerate(tail):
            rest = tail[k + 1 :]
            both = (bits[place] if shared is None else shared & bits[place])
            counts = np.bitwise_count(bits[rest] & both).sum(axis=1)
            more = rest[counts >= least]
            own = [*names, int(items[place])]
            out.extend([*own, int(items[p])] for p in more)
            if len(own) + 1 < longest and len(more) > 1:
                extend(own, both, more)

    single = np.bitwise_count(bits).sum(axis=1)
    extend([], None, np.flatnonzero(single >= least))
    return out


def counted(items: np.ndarray, bits: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Baskets of a block that hold each of the sets, which are sorted."""
    place = {int(c): k for k, c in enumerate(items)}
    counts = np.zeros(len(sets), np.int64)
    path: list[tuple[int, np.ndarray | None]] = []  # items of the last set and their shared bits
    for number, one in enumerate(sets):
        depth = 0
        while depth < min(len(path), len(one)) and path[depth][0] == one[depth]:
            depth += 1
        del path[depth:]
        for code in one[depth:]:
            before = path[-1][1] if path else None
            at = place.get(code)
            empty = at is None or (path and before is None)
            path.append((code, None if empty else bits[at] if not path else before & bits[at]))
        if path[-1][1] is not None:
            counts[number] = int(np.bitwise_count(path[-1][1]).sum())
    return counts


def frequent_itemsets(distinct: DataFrame, min_support: float, longest: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(items, baskets) of every set of up to ``longest`` items in at least that share of
    baskets, and the number of baskets.  ``distinct`` has each basket and item once."""
    total = distinct.agg(F.count_distinct("basket")).first()[0]
    least = ceil(total * min_support)
    singles = distinct.groupBy("item").agg(F.count(F.lit(1)).alias("baskets")).filter(F.col("baskets") >= max(least, 1))
    # At most mean basket size / min_support items, so one task can number them.
    singles = stage(singles.withColumn("code", F.row_number().over(Window.orderBy("item"))), "frequent-items")
    ones = singles.select(F.array("item").alias("items"), "baskets")
    if longest < 2:
        return ones, total
    coded = distinct.join(broadcast_if_small(singles.select("item", "code")), "item")
    blocks = stage(_blocks(coded, total, block), "basket-bits")
    held = blocks.agg(F.sum("n")).first()[0] or 0

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                share = max(1, ceil(least * row["n"] / held - 1e-9))
                sets = mined(*_unpacked(**row), share, longest)
                yield pa.RecordBatch.from_pydict({"codes": pa.array(sets, pa.list_(pa.int32()))})

    found = stage(blocks.mapInArrow(candidates, "codes array<int>").distinct(), "candidates")
    passes = -(-found.count() // CHUNK)
    names = [r.item for r in singles.orderBy("code").select("item").collect()]
    kept = [ones]
    for number in range(passes):
        some = found.filter(F.pmod(F.xxhash64("codes"), F.lit(passes)) == number)
        sets = sorted(tuple(r.codes) for r in some.collect())  # about CHUNK of them
        kept.append(_recounted(blocks, sets, names, max(least, 1), ones.schema["items"].dataType.simpleString()))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, total


def _recounted(blocks: DataFrame, sets: list[tuple[int, ...]], names: list, least: int, kind: str) -> DataFrame:
    """The frequent ones of the sets, with their items' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sets), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += counted(*_unpacked(**row), sets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"number": pa.array(some), "baskets": pa.array(total[some])})

    summed = blocks.mapInArrow(run, "number long, baskets long").groupBy("number").agg(F.sum("baskets").alias("baskets"))
    frequent = stage(summed.filter(F.col("baskets") >= least), "counted")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[names[c - 1] for c in sets[k]] for k in batch.column("number").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items), batch.column("baskets")], ["items", "baskets"])

    return frequent.mapInArrow(named, f"items {kind}, baskets long")
