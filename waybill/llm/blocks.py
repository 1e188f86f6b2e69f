"""Buckets of any size as bounded block pairs, and their streaming in a task.

A bucket of n members is cut into ceil(n / size) blocks by a hash of the member, and
every pair of blocks becomes a group of its own.  So each two members of a bucket meet
exactly once, and no task holds more than about two blocks of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waybill.llm.common import partitions

BLOCK = 256


def block_ids(members: DataFrame, member: str, size: int = BLOCK) -> DataFrame:
    """``members`` (key, n, ...) with their block pairs (key, i, j), in no order.

    Column ``block`` tells a member's own block; in a group with i < j only members of
    different blocks are to be compared.
    """
    blocks = F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int")
    return (
        members.withColumn("_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), member), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("i", F.least("block", "_other"))
        .withColumn("j", F.greatest("block", "_other"))
        .drop("_blocks", "_other")
    )


def block_pairs(members: DataFrame, member: str, size: int = BLOCK) -> DataFrame:
    """``block_ids`` with every block pair together in a task, sorted by it."""
    dealt = block_ids(members, member, size)
    count = partitions(members.sparkSession)
    return dealt.repartition(count, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def fixed(column: pa.Array, kind: type, width: int | None = None) -> np.ndarray:
    """A binary column of equal lengths as a two-dimensional array."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    flat = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
    return flat.view(kind).reshape(len(column), -1 if width is None else width)


def groups(batches: Iterator[pa.RecordBatch], binaries: tuple[str, ...] = ()) -> Iterator[dict]:
    """The sorted block pairs one after the other, as columns of arrays.

    ``binaries`` stay Arrow columns, since their lengths may differ between groups.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        marks = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        yield from _cut(table.slice(0, last), [0, *cuts.tolist()], binaries)
        held = table.slice(last)
    if held is not None:
        yield from _cut(held, [0, len(held)], binaries)


def _cut(table: pa.Table, cuts: list[int], binaries: tuple[str, ...]) -> Iterator[dict]:
    if not len(table):
        return
    table = table.combine_chunks()
    plain = {c: table.column(c).to_numpy() for c in table.column_names if c not in binaries}
    arrow = {c: table.column(c).chunk(0) for c in binaries}
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end - start > 1:
            yield {c: v[start:end] for c, v in plain.items()} | {c: v.slice(start, end - start) for c, v in arrow.items()}
