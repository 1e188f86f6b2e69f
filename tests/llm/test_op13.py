"""Conversation repair against exhaustive search and its SQL twin."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tests.llm.fixtures import SMALL
from waybill.llm import op13_conversations as op

KINDS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


@lru_cache(maxsize=None)
def exhaustive(codes):
    """Every edit sequence of at most the cost of deleting all rows, tried one by one."""
    rows = [codes[k : k + 2] for k in range(0, len(codes), 2)]
    best = (4 * len(rows), "D" * len(rows))
    stack = [(0, 0, "", "")]
    while stack:
        at, cost, audit, turns = stack.pop()
        if cost > best[0]:
            continue
        if at == len(rows) and GRAMMAR.fullmatch(turns):
            best = min(best, (cost, audit))
        for turn in "ua":
            stack.append((at, cost + 3, audit + "I", turns + turn))
        if at < len(rows):
            stack.append((at + 1, cost + 4, audit + "D", turns))
            initial, fault = rows[at]
            if fault != "x":
                more = 3 * (fault == "t")
                stack.append((at + 1, cost + more, audit + "K", turns + initial))
                for turn in "ua":
                    stack.append((at + 1, cost + more + 3, audit + "R", turns + turn))
    return best


def every_code(n):
    rng = random.Random(13)
    return ["".join(rng.choice("suau-") + rng.choice("...tx") for _ in range(rng.randrange(n + 1))) for _ in range(250)]


@pytest.mark.parametrize("segment", [1, 2, 192])
def test_cheapest_least_repair(segment):
    for codes in every_code(4):
        assert op.repair(codes, segment) == exhaustive(codes), codes


def test_segments_change_nothing():
    rng = random.Random(7)
    for n in (40, 333):
        codes = "".join(rng.choice("suaua-") + rng.choice("....tx") for _ in range(n))
        whole = op.repair(codes, n)
        assert op.repair(codes, 17) == whole and op.repair(codes, 64) == whole


def plain(rows):
    """The same results of one conversation, written without lattice or stream."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
    for _, role, text in out:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes += (role[:1] if role[:1] in tuple("sua") else "-") + {"": ".", "truncated": "t"}.get(fault, "x")
    turns = {t for t, _, _ in out if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in out]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = exhaustive(codes)
    lines, at = [], 0
    for letter in audit:
        role, text = None, ""
        if letter != "I":
            _, role, text = out[at]
            at += 1
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
        lines.append((role, text))
    joined = "\n".join(f"{r}:{t}" for r, t in lines)
    digest = hashlib.sha256(joined.encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def odd_conversations():
    rng = random.Random(5)
    said = ["Yes.", "No", "", " \n", None, "a:b! ", "Ünï 漢?", "x" * 100_000 + ".", "Why? Because."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "user:x"]
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "assistant", "Hi.")]
    for conv in range(2, 160):
        turns = [rng.choice([k, k + rng.randrange(2), None]) for k in range(rng.randrange(1, 5))]
        rows += [(conv, t, rng.choice(roles), rng.choice(said)) for t in turns]
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_whole_results_of_odd_rows(spark, clashing):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    if clashing:
        df = df.select("*", *(F.lit(2).alias(c) for c in ("copies", "cost", "gaps", "key", "row", "label")))
    got = {r.conv_id: tuple(r)[1:] for r in op.repaired(op.damaged(df)).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert got == {conv: plain(own) for conv, own in by.items()}


def test_empty_table_and_all_dropped(spark):
    assert op.repaired(op.damaged(spark.createDataFrame([], KINDS))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = op.repaired(op.damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], KINDS))).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_and_texts_on_disk(spark, monkeypatch):
    monkeypatch.setattr(op, "HELD", 1 << 12)
    talk = op.Conversation()
    for k in range(3000):
        talk.add(k, "user" if k % 2 == 0 else "assistant", f"{k} " * 50 + ".")
    gaps, *_, cost, audit, digest = talk.result()
    whole = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:" + f"{k} " * 50 + "." for k in range(3000))
    assert (gaps, cost, audit, digest) == (0, 0, "K" * 3000, hashlib.sha256(whole.encode()).hexdigest())


def test_twin(spark):
    assert differences(op.query(spark, SMALL), connect(SMALL), op.ORACLE_SQL) == []
    assert differences(op.query(spark, SMALL.replace("0.001", "0.01")), connect(SMALL.replace("0.001", "0.01")), op.ORACLE_SQL) == []
