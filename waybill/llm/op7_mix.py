"""Mixing sources to target weights by highest quotients (Sainte-Laguë).

All words taken are counted in blocks of ``BLOCK`` words.  The blocks are allotted to
the sources by highest quotients target / (2 * given + 1), then those of a source to
its shards by size in the same way.  Inside a shard the documents stand in an order
drawn from the seed; the shard's quota is as many whole rounds over the shard as it
holds, and of a last round blocks evenly spaced from a seeded start.  How many of the first j blocks are taken
has a closed form, so each row's share needs only its running word count.

Sources in code point order, null last, weigh 1, 2, 3, repeating.  They share as many
words as there are; a target stops at ``MOST`` times its source's size and the excess
is shared again by weight.  Null and empty texts have size 0 and nothing is taken of
them.  A source has at most ``SHARDS`` shards, chosen by a hash of the id, so that no
source lands in one task; at most ``SOURCES`` sources are allowed, as their totals pass
through the driver.  Rows that agree in id and size may swap what is taken of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waybill.llm.common import documents, stage, table

BLOCK = 16
MOST = 3
SHARD_WORDS = 1 << 18
SHARDS = 4096
SOURCES = 100_000
SEED = "mix"
_PLAN = pa.schema(
    {"_source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "quota": pa.int64(), "shards": pa.int32()}
)


def size_of(text: Column) -> Column:
    """Words of a text, split at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], most: int = MOST) -> list[float]:
    """Words wanted of each source, given in code point order."""
    weights = [1 + k % 3 for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    rest, weight = sum(sizes), sum(weights)
    # A source stops sooner the smaller its size is against its weight.
    queue = sorted(range(len(sizes)), key=lambda k: (sizes[k] / weights[k], k))
    for place, k in enumerate(queue):
        if rest * weights[k] > most * sizes[k] * weight:
            out[k] = float(most * sizes[k])
            rest -= most * sizes[k]
            weight -= weights[k]
        else:
            for j in queue[place:]:
                out[j] = rest * weights[j] / weight
            break
    return out


def allot(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each weight by highest quotients; the earlier wins a tie.

    Rounding with a divisor that gives out no more than ``seats`` is a state the
    quotients pass through; the few seats left are then given one by one.
    """
    weights = np.asarray(weights, float)
    given = np.zeros(len(weights), np.int64)
    if not weights.sum():
        return given
    scale = max(0.0, seats - len(weights) / 2 - 1) / weights.sum()
    given = np.floor(weights * scale + 0.5).astype(np.int64) if scale else given
    queue = [(-w / (2 * g + 1), k) for k, (w, g) in enumerate(zip(weights, given, strict=True)) if w > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, k = queue[0]
        given[k] += 1
        heapq.heapreplace(queue, (-weights[k] / (2 * given[k] + 1), k))
    return given


def _source_plan(totals: DataFrame, block: int, most: int) -> pd.DataFrame:
    """Size, target, quota in blocks and number of shards of each source."""
    rows = totals.groupBy("_source", "source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in rows]
    wanted = targets(sizes, most)
    seats = allot(np.array(wanted), round(sum(wanted) / block))
    shards = [min(SHARDS, 1 << max(0, -(-s // SHARD_WORDS) - 1).bit_length()) for s in sizes]
    return pd.DataFrame(
        {"_source": [r["_source"] for r in rows], "source_size": sizes, "target": wanted, "quota": seats, "shards": shards}
    )


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """One source's blocks allotted to its shards; it has at most ``SHARDS`` rows."""
    shards = shards.sort_values("shard")
    quota = allot(shards["shard_size"].to_numpy(), int(shards["quota"].iloc[0]))
    return shards.assign(quota=quota)[["_source", "shard", "source_size", "target", "shard_size", "quota"]]


def mix(sized: DataFrame, block: int = BLOCK, seed: str = SEED, most: int = MOST, spans: bool = False) -> DataFrame:
    """``sized`` (doc_id, source, size, maybe more) with source_size, target and taken.

    Columns of ``sized`` that have one of the three new names are replaced; all others
    travel along, whatever their names.  With ``spans`` there are also rounds, how often
    the whole text is taken, and spans, the chosen blocks of the last round as pairs of
    first word and end in the text's words, in order; taken adds up both.
    """
    kept = [c for c in sized.columns if c not in ("source_size", "target", "taken", *(("rounds", "spans") if spans else ()))]
    sized = sized.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), "doc_id", "source", "size")
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sized.withColumn(
        "_source", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source")))
    ).withColumn("_drawn", drawn)
    bucket = F.conv(F.substring("_drawn", 1, 3), 16, 10).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    # At most 4096 rows a source, whatever the number of documents.
    totals = stage(rows.groupBy("_source", "source", "_bucket").agg(F.sum("size").alias("size")), "mix-totals")
    plan = _source_plan(totals, block, most)
    spark = sized.sparkSession
    # As an Arrow table, which the JVM reads by itself: a list of rows would pass through
    # Python workers of another kind, one more for every core beside those of the UDFs.
    plan_table = pa.Table.from_pandas(plan, _PLAN, preserve_index=False)
    # At most SOURCES rows, as checked; a shuffle by source would gather a large source.
    plan_df = F.broadcast(spark.createDataFrame(plan_table))
    shard = (F.col("_bucket") % F.col("shards")).alias("shard")
    quotas = (
        totals.join(plan_df, "_source")
        .groupBy("_source", shard, "source_size", "target", "quota")
        .agg(F.sum("size").alias("shard_size"))
        .groupBy("_source")
        .applyInPandas(
            _shard_quotas, "_source string, shard int, source_size long, target double, shard_size long, quota long"
        )
    )
    quotas = stage(quotas, "mix-quotas")
    numbers = F.broadcast(plan_df.select("_source", "shards"))
    placed = rows.join(numbers, "_source").withColumn("shard", shard)
    order = Window.partitionBy("_source", "shard").orderBy("_drawn", "doc_id", "size")
    placed = placed.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.drop("_bucket", "shards").join(quotas, ["_source", "shard"])
    blocks = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("long")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_source", "shard").cast("binary")), 1, 8), 16, 10)
    # The quota in words, as whole rounds over the shard and blocks of a last round.
    joined = (
        joined.withColumn("_want", F.least(F.col("quota") * block, F.col("shard_size") * most))
        .withColumn("_rounds", F.expr("_want div greatest(shard_size, 1)"))
        .withColumn("_rest", F.expr(f"(2 * (_want - _rounds * shard_size) + {block}) div {2 * block}"))
        .withColumn("_blocks", blocks)
        .withColumn("_start", start.cast("long") % F.col("_blocks"))
    )
    if spans:
        joined = joined.withColumn("_chosen", _chosen_blocks(block))
        own = F.aggregate("_chosen", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
        taken = F.expr("size * _rounds") + own
        return joined.select(
            "_row.*", "source_size", "target", taken.cast("long").alias("taken"),
            F.col("_rounds").cast("long").alias("rounds"), F.col("_chosen").alias("spans"),
        )
    before = _taken_before(F.col("_end") - F.col("size"), block)
    taken = F.expr("size * _rounds") + _taken_before(F.col("_end"), block) - before
    return joined.select("_row.*", "source_size", "target", taken.cast("long").alias("taken"))


def _chosen_blocks(block: int) -> Column:
    """The words of a document that lie in the shard's chosen blocks, by block.

    Block b is chosen where floor((b * rest + start) / blocks) rises from b to b + 1;
    the k-th rise comes at block ceil((k * blocks - start) / rest) - 1.
    """
    begin = "(_end - size)"
    first = f"({begin} div {block} * _rest + _start) div _blocks"
    last = f"(((_end - 1) div {block} + 1) * _rest + _start) div _blocks"
    at = "((k * _blocks - _start + _rest - 1) div _rest - 1)"
    return F.expr(
        f"CASE WHEN size > 0 AND _rest > 0 AND {last} > {first} THEN transform(sequence({first} + 1, {last}), k -> "
        f"named_struct('start', greatest({at} * {block} - {begin}, 0L), 'end', least(({at} + 1) * {block} - {begin}, size))) "
        "ELSE CAST(array() AS array<struct<start: bigint, end: bigint>>) END"
    )


def cut_text(text: Column) -> Column:
    """A text ``rounds`` times over and its ``spans``, each part on lines of its own.

    The words are a lambda's variable: named inside it as an expression, they would be
    split off the text again for every span.
    """
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def cut(own: Column) -> Column:
        return F.transform(
            "spans", lambda x: F.array_join(F.slice(own, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), " ")
        )

    pieces = F.element_at(F.transform(F.array(words), cut), 1)
    return F.array_join(F.concat(F.array_repeat(text, F.col("rounds").cast("int")), pieces), "\n")


def _taken_before(words: Column, block: int) -> Column:
    """Of a shard's first ``words`` words, those in the blocks of the last round."""
    whole = F.floor(words / block)

    def chosen(blocks: Column) -> Column:
        return F.floor((blocks * F.col("_rest") + F.col("_start")) / F.col("_blocks"))

    return block * chosen(whole) + (words - whole * block) * (chosen(whole + 1) - chosen(whole))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    # The word counts are written once; nothing after this reads a text.
    sized = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS drawn
  FROM documents
), src AS (
  SELECT s, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY s = '', s) - 1) % 3 AS w,
    row_number() OVER (ORDER BY s = '', s) AS k
  FROM d GROUP BY s
), ordered AS (
  SELECT *, sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS rest, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight,
    row_number() OVER o AS place
  FROM src WINDOW o AS (ORDER BY source_size / w, k)
), stop AS (
  SELECT min(place) AS place FROM ordered WHERE NOT rest * w > {MOST} * source_size * weight
), open AS (SELECT rest, weight FROM ordered JOIN stop USING (place)
), plan AS (
  SELECT s, k, source_size, 1 << ceil(log2(greatest(ceil(source_size / {SHARD_WORDS}.0), 1)))::INT AS shards,
    CASE WHEN (SELECT place FROM stop) IS NULL OR place < (SELECT place FROM stop)
      THEN ({MOST} * source_size)::DOUBLE
      ELSE ((SELECT rest FROM open) * w)::DOUBLE / (SELECT weight FROM open)::DOUBLE END AS target
  FROM ordered
), seats AS (
  SELECT s, count(*) AS quota FROM (
    SELECT s, row_number() OVER (ORDER BY target / (2 * g + 1) DESC, k) AS r,
      round_even(sum(target) FILTER (g = 0) OVER () / {BLOCK}, 0) AS total
    FROM (SELECT s, k, target, unnest(range(0, (target / {BLOCK})::BIGINT + 3)) AS g FROM plan)
  ) WHERE r <= total GROUP BY s
), sharded AS (
  SELECT d.*, ('0x' || left(drawn, 3))::INT % shards AS shard FROM d JOIN plan USING (s)
), sh AS (
  SELECT s, shard, sum(size)::BIGINT AS shard_size FROM sharded GROUP BY s, shard
), shq AS (
  SELECT s, shard, count(*) AS quota FROM (
    SELECT s, shard, quota, row_number() OVER (PARTITION BY s ORDER BY shard_size / (2 * g + 1) DESC, shard) AS r
    FROM (SELECT s, shard, shard_size, quota, unnest(range(0, {MOST} * shard_size // {BLOCK} + 3)) AS g
      FROM sh JOIN seats USING (s))
  ) WHERE r <= quota GROUP BY s, shard
), q AS (
  SELECT s, shard, n, rounds, (2 * (want - rounds * shard_size) + {BLOCK}) // {2 * BLOCK} AS rest,
    ('0x' || left(md5('{SEED}:' || s || ':' || shard), 8))::BIGINT % n AS start
  FROM (SELECT *, want // greatest(shard_size, 1) AS rounds FROM (
    SELECT s, shard, shard_size, greatest(ceil(shard_size / {BLOCK}.0), 1)::BIGINT AS n,
      least(coalesce(quota, 0) * {BLOCK}, {MOST} * shard_size) AS want
    FROM sh LEFT JOIN shq USING (s, shard)))
), rows AS (
  SELECT *, (sum(size) OVER (PARTITION BY s, shard ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e
  FROM sharded
), p AS (
  SELECT r.doc_id, r.s, r.size, rounds, rest, n, start, e, e - r.size AS b
  FROM rows r JOIN q ON r.s = q.s AND r.shard = q.shard
)
SELECT doc_id, size, source_size, target, (size * rounds
  + {BLOCK} * ((e // {BLOCK} * rest + start) // n) + e % {BLOCK} * (((e // {BLOCK} + 1) * rest + start) // n
  - (e // {BLOCK} * rest + start) // n)
  - {BLOCK} * ((b // {BLOCK} * rest + start) // n) - b % {BLOCK} * (((b // {BLOCK} + 1) * rest + start) // n
  - (b // {BLOCK} * rest + start) // n))::BIGINT AS taken
FROM p JOIN plan USING (s)
"""
