"""Repair of damaged conversations: bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, what the output ends in): nothing yet, a system
turn, a user turn, an assistant turn.  Keep and Rerole consume a row and write a turn,
Delete consumes one, Insert writes one.  Two searches, from the start and from the goal,
settle nodes by cost; each label also holds the least audit of its cost.  When the heaps
have met, all crossings of the least cost are finished and the least concatenated audit
is taken.  A path's letters between two nodes with the same number of rows can never be
a proper beginning of another path's of the same cost, so least parts make a least whole.

A conversation is cut into segments of ``SEGMENT`` rows, for every pair of border states
one search, so that the labels of a long conversation stay small; the segments' audits
join by the same rule.  Rows are streamed in order of their conversation: a task holds a
few bytes a row, and texts beyond ``HELD`` bytes wait in a file of the task, since the
digest of the repaired text needs the edits first.  One digest over all of a
conversation's text makes its rows one sequence, whatever its length.

Defined results: a null id, turn, role or text counts as one space where it is written or
compared; rows of a null id are one conversation.  Turns come with nulls first, rows of
the same turn by role and text.  An empty role has no initial.  A conversation of which
every row is dropped has zeros, an empty audit and the digest of nothing.  Other columns
are not read.  A repeated row is a duplicate of the first.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.llm.common import partitions, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT = 192
HELD = 8 << 20
SPACES = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
# What the output ends in, and where a further turn of an initial leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER},
}
GOALS = (NOTHING, ASSISTANT)

Node = tuple[int, int]
Label = tuple[int, str]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of every row after its damage."""

    def spaced(column: str, kind: str = "string") -> Column:
        return F.coalesce(F.col(column).cast(kind), F.lit(" "))

    key = F.concat_ws(":", spaced("conv_id"), spaced("turn"))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(fate == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def onward(codes: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """Steps from a node as (node, cost, letter); ``codes`` has two letters a row.

    The first is the role's initial, ``-`` for another; the second is ``x`` for a row that
    must go, ``t`` for a truncated one, ``.`` for a sound one.
    """
    at, state = node
    for turn in NEXT[state]:
        if turn != "s":
            yield (at, NEXT[state][turn]), INSERT, "I"
    if 2 * at == len(codes):
        return
    yield (at + 1, state), DELETE, "D"
    initial, fault = codes[2 * at], codes[2 * at + 1]
    if fault == "x":
        return
    extra = TRUNCATED if fault == "t" else 0
    for turn, after in NEXT[state].items():
        if turn == initial:
            yield (at + 1, after), extra, "K"
        if turn != "s":
            yield (at + 1, after), REROLE + extra, "R"


def backward(codes: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """Steps that lead to a node, as (from, cost, letter)."""
    at, _ = node
    for before in range(4):
        for row in (at, at - 1):
            if row >= 0:
                for to, cost, letter in onward(codes, (row, before)):
                    if to == node:
                        yield (row, before), cost, letter


class Side:
    """One of the two searches: a heap, labels, and which nodes are settled.

    Nodes of equal cost are settled in the order of the search's rows, so that a label is
    final when its node is settled although Keep may cost nothing.
    """

    def __init__(self, start: Node, sign: int):
        self.sign, self.settled = sign, set()
        self.labels: dict[Node, Label] = {start: (0, "")}
        self.heap = [(0, sign * start[0], start)]

    def top(self) -> int | None:
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def offer(self, node: Node, label: Label) -> None:
        old = self.labels.get(node)
        if old is None or label < old:
            self.labels[node] = label
            if old is None or label[0] < old[0]:
                heapq.heappush(self.heap, (label[0], self.sign * node[0], node))


@lru_cache(maxsize=1 << 15)
def cheapest(codes: str, start: int, goal: int) -> Label | None:
    """(cost, audit) of the cheapest way through the rows from one state to another.

    No letter is written after the last row unless ``goal`` is an end: such inserts
    belong to the segment that follows.
    """
    last = (len(codes) // 2, goal)
    ahead, behind = Side((0, start), 1), Side(last, -1)
    best: int | None = None
    while (a := ahead.top()) is not None and (b := behind.top()) is not None and (best is None or a + b <= best):
        side, steps, other = (ahead, onward, behind) if a <= b else (behind, backward, ahead)
        node = heapq.heappop(side.heap)[2]
        side.settled.add(node)
        cost, audit = side.labels[node]
        for to, step, letter in steps(codes, node):
            side.offer(to, (cost + step, audit + letter if side is ahead else letter + audit))
            if to in other.labels:
                total = cost + step + other.labels[to][0]
                best = total if best is None else min(best, total)
        if node in other.labels:
            total = cost + other.labels[node][0]
            best = total if best is None else min(best, total)
    if best is None:
        return None
    found, final = [], behind.settled | {last}
    for node in ahead.settled:
        cost, audit = ahead.labels[node]
        if node in final and cost + behind.labels[node][0] == best:
            found.append(audit + behind.labels[node][1])
        for to, step, letter in onward(codes, node):
            if to in final and cost + step + behind.labels[to][0] == best:
                found.append(audit + letter + behind.labels[to][1])
    return best, min(found)


def repair(codes: str, segment: int = SEGMENT) -> Label:
    """(cost, audit) of the cheapest repair of a whole conversation.

    The audit of a segment that is not the last one ends in a row's letter, since ways
    that write after the last row are taken as the next segment's first.
    """
    front: dict[int, Label] = {NOTHING: (0, "")}
    size = 2 * segment
    parts = [codes[k : k + size] for k in range(0, len(codes), size)] or [""]
    for part in parts[:-1]:
        reached: dict[int, Label] = {}
        for start, (cost, audit) in front.items():
            for goal in range(4):
                more = cheapest(part, start, goal)
                if more and not more[1].endswith("I"):
                    label = (cost + more[0], audit + more[1])
                    reached[goal] = min(reached.get(goal, label), label)
        front = reached
    ends = [
        (cost + more[0], audit + more[1])
        for start, (cost, audit) in front.items()
        for goal in GOALS
        if (more := cheapest(parts[-1], start, goal))
    ]
    return min(ends)


class Conversation:
    """One conversation's rows in order, as they stream by."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.least, self.most, self.last = 0, None, None, None
        self.lengths: list[tuple[int, int]] = []
        self.texts = tempfile.SpooledTemporaryFile(max_size=HELD)

    def add(self, turn: int | None, role: str, text: str) -> None:
        body = text.rstrip(SPACES)
        before, line = len(role.encode()), f"{role}:{text}".encode()
        # The role's length keeps "a:b" + "c" and "a" + "b:c" apart.
        same = hashlib.blake2b(before.to_bytes(8, "big") + line, digest_size=16).digest()
        fault = "blank" if not body else "duplicate" if same in self.seen else "truncated" if body[-1] not in ".!?" else None
        self.seen.add(same)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        if self.codes and self.codes[-1][0] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.codes.append(initial + {None: ".", "truncated": "t"}.get(fault, "x"))
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
            self.last = turn
        self.lengths.append((before, len(line)))
        self.texts.write(line)

    def result(self) -> tuple:
        cost, audit = repair("".join(self.codes))
        digest = self._digest(audit)
        self.texts.close()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        c = self.counts
        return gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, digest

    def _digest(self, audit: str) -> str:
        total, state, row, first = hashlib.sha256(), NOTHING, 0, True
        self.texts.seek(0)
        for letter in audit:
            before, line = 0, b":"
            initial = "a" if state == USER else "u"
            if letter != "I":
                before, length = self.lengths[row]
                line = self.texts.read(length)
                initial = self.codes[row][0] if letter == "K" else initial
                row += 1
            if letter == "D":
                continue
            if letter != "K":
                line = ROLES[initial].encode() + line[before:]
            state = NEXT[state][initial]
            total.update(line if first else b"\n" + line)
            first = False
        return total.hexdigest()


_COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation of
    ``rows`` (conv_id, turn, role, text), which may be damaged first by ``damaged`` and
    may have a column copies; without it each row counts once."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    narrow = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None
        done: list[tuple] = []
        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if own is None or conv != now:
                    if own is not None:
                        done.append((now, *own.result()))
                    own, now = Conversation(), conv
                for _ in range(copies):
                    own.add(turn, role, text)
            if len(done) >= 4096:
                yield _batch(done)
                done = []
        if own is not None:
            done.append((now, *own.result()))
        yield _batch(done)

    count = partitions(rows.sparkSession)
    ordered = narrow.repartition(count, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(run, _COLUMNS)


def _batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*done, strict=True)) or [()] * 9
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


# Each row's damage by crc32 bit by bit, then one step a row over the four states of the
# output, each with its least (cost, audit); inserts before a row are at most two.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, c: list_reduce(list_prepend(xor(x, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) % 20 AS fate
  FROM keyed
), d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    left(role, 1) AS c, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e
  FROM d
), f AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    i > 1 AND lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS bad
  FROM o
), s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, [{'c': 0, 'a': ''}, {'c': 999999999, 'a': ''}, {'c': 999999999, 'a': ''}, {'c': 999999999, 'a': ''}] AS b
  FROM conversations
), walk AS (
  SELECT conv_id, i, b FROM s
  UNION ALL
  SELECT conv_id, i, [
      {'c': p[1].c + 4, 'a': p[1].a || 'D'},
      least({'c': p[2].c + 4, 'a': p[2].a || 'D'}, {'c': p[1].c + x + IF(k = 's', 0, 999999999), 'a': p[1].a || 'K'}),
      least({'c': p[3].c + 4, 'a': p[3].a || 'D'}, least({'c': q.c + x + IF(k = 'u', 0, 999999999), 'a': q.a || 'K'}, {'c': q.c + x + 3, 'a': q.a || 'R'})),
      least({'c': p[4].c + 4, 'a': p[4].a || 'D'}, least({'c': p[3].c + x + IF(k = 'a', 0, 999999999), 'a': p[3].a || 'K'}, {'c': p[3].c + x + 3, 'a': p[3].a || 'R'}))] AS b
  FROM (
    SELECT conv_id, i, k, x, p, least(p[1], least(p[2], p[4])) AS q FROM (
      SELECT f.conv_id, f.i, f.c AS k, CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 999999999 END AS x, [b[1], b[2],
        least(b[3], least({'c': least(b[1], least(b[2], b[4])).c + 3, 'a': least(b[1], least(b[2], b[4])).a || 'I'}, {'c': b[3].c + 6, 'a': b[3].a || 'II'})),
        least(b[4], least({'c': b[3].c + 3, 'a': b[3].a || 'I'}, {'c': least(b[1], least(b[2], b[4])).c + 6, 'a': least(b[1], least(b[2], b[4])).a || 'II'}))] AS p
      FROM walk JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1)
  )
), finished AS (
  SELECT conv_id, i, least(b[1], least(b[4], least({'c': b[3].c + 3, 'a': b[3].a || 'I'},
    {'c': least(b[1], b[2]).c + 6, 'a': least(b[1], b[2]).a || 'II'}))) AS r
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), letters AS (
  SELECT conv_id, r, unnest(range(1, len(r.a) + 1)) AS j FROM finished
), edits AS (
  SELECT conv_id, j, r.a[j] AS l, len(replace(left(r.a, j), 'I', '')) AS i, len(replace(left(r.a, j), 'D', '')) AS written FROM letters
), lines AS (
  SELECT e.conv_id, e.j, l, f.text, f.role, written,
    count(CASE WHEN l = 'K' AND c = 's' THEN 1 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND l <> 'I'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (written - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t
  FROM lines WHERE l <> 'D' GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (bad) AS illegal
  FROM f GROUP BY conv_id
)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, r.c::BIGINT AS cost, r.a AS audit,
  sha256(coalesce(t, '')) AS repaired_sha256
FROM finished w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM w.conv_id
"""
