"""Token counts of a byte-level pair encoding by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct new ones of a slice are held together
as one ragged array of symbols.  In each round every sequence merges all places of
its own lowest-rank pair at once.  What survives is the number of tokens.  Merging
all places of one pair together equals merging them one by one, since a pair that
contains a merged symbol has a higher rank than the merge that made it.

Null and empty texts have 0 bytes and 0 tokens.  The special string inside a text
is one token, as the tokenizer's default has it.  One row comes back per row given;
other columns are not read, so names cannot clash.  A text is read whole; a task
holds one slice of texts and a cache of at most ``CACHE`` pre-tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import documents, table
from waybill.llm.words import slices

LIMIT = 1024
CACHE = 600_000
# Longer pre-tokens are merged one by one with a heap of ranks.
RAGGED_BYTES = 2048
_NONE = np.int32(2**31 - 1)
# Pre-tokens held in one ragged array: enough for numpy, and fit for a CPU's cache.
_AT_ONCE = 8192

# The pre-token pattern and the printable stand-ins of byte-level pair encoding.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _stand_ins() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary file."""
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    return {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """Ranks of symbol pairs and the symbol each pair becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        shown = _stand_ins()
        self.of_byte = np.array([vocabulary[shown[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.size = np.int64(max(vocabulary.values()) + 1)
        self.becomes = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above all ranks."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NONE)


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


def ragged_counts(merges: Merges, tokens: list[bytes]) -> np.ndarray:
    """Symbols left of each non-empty pre-token after all merges."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    symbols = merges.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    out = lengths.copy()
    who = np.arange(len(tokens))
    last = np.cumsum(lengths) - 1
    ranks = np.full(len(symbols), _NONE, np.int32)
    if len(symbols) > 1:
        ranks[:-1] = merges.ranks(symbols[:-1], symbols[1:])
    ranks[last] = _NONE
    while len(who):
        starts = np.cumsum(lengths) - lengths
        lowest = np.minimum.reduceat(ranks, starts)
        active = lowest != _NONE
        if not active.all():  # sequences without a pair are done
            out[who[~active]] = lengths[~active]
            stays = np.repeat(active, lengths)
            symbols, ranks = symbols[stays], ranks[stays]
            who, lengths, lowest = who[active], lengths[active], lowest[active]
            if not len(who):
                break
        at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
        # In a run such as "aaaa" every second place merges, from the left.
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) != 1
        begins = np.flatnonzero(fresh)
        within = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at = at[within % 2 == 0]
        symbols[at] = merges.becomes[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        ends = np.cumsum(lengths) - 1
        gone = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(~keep, out=gone[1:])
        closing = ends - gone[ends + 1]  # last place of each sequence, afterwards
        lengths = np.diff(closing, prepend=-1)
        place = at - gone[at]
        symbols, ranks = symbols[keep], ranks[keep]
        closed = np.zeros(len(symbols), bool)
        closed[closing] = True
        changed = np.concatenate([place, place[place > 0] - 1])
        ranks[changed] = _NONE
        open_ = changed[~closed[changed]]
        ranks[open_] = merges.ranks(symbols[open_], symbols[open_ + 1])
    return out


def long_count(merges: Merges, token: bytes) -> int:
    """The same for one very long pre-token: ranks from a heap, places in a chain."""
    symbols = merges.of_byte[np.frombuffer(token, np.uint8)]
    first = merges.ranks(symbols[:-1], symbols[1:]).tolist() if len(symbols) > 1 else []
    chain = symbols.tolist()
    n = len(chain)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[int, list[int]] = {}
    for i, r in enumerate(first):
        if r != _NONE:
            places.setdefault(r, []).append(i)
    queue = list(places)
    heapq.heapify(queue)
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(merges.ranks(np.array([a]), np.array([b]))[0])
        return known[a, b]

    left = n
    while queue:
        r = heapq.heappop(queue)
        made = int(merges.becomes[r])
        for i in sorted(places.pop(r)):
            j = after[i] if chain[i] >= 0 else n
            if j >= n or rank(chain[i], chain[j]) != r:
                continue
            chain[i], chain[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    new = rank(chain[a], chain[b])
                    if new != _NONE:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(queue, new)
                        places[new].append(a)
    return left


class Counter:
    """Counts tokens of texts; remembers units and pre-tokens up to a fixed number.

    A unit is what stands between two single spaces, with the space before it.  No
    pre-token crosses the border of two units unless spaces stand side by side or
    end the text; such texts are cut by the pre-token pattern as a whole.
    """

    def __init__(self, path: str):
        self.merges = load(path)
        self.find = regex.compile(_PATTERN).findall
        self.tokens: dict[str, int] = {}
        self.units: dict[str, int] = {}

    def _learn_tokens(self, new: list[str]) -> None:
        if len(self.tokens) + len(new) > CACHE:
            self.tokens.clear()
        coded = [t.encode("utf-8", "surrogatepass") for t in new]
        small = [k for k, t in enumerate(coded) if len(t) <= RAGGED_BYTES]
        for start in range(0, len(small), _AT_ONCE):
            part = small[start : start + _AT_ONCE]
            counts = ragged_counts(self.merges, [coded[k] for k in part]).tolist()
            self.tokens.update(zip((new[k] for k in part), counts, strict=True))
        for k, t in enumerate(coded):
            if len(t) > RAGGED_BYTES:
                self.tokens[new[k]] = long_count(self.merges, t)

    def _sums(self, found: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        if len(self.tokens) > CACHE // 2:
            self.tokens.clear()
        self._learn_tokens(list({t for f in found for t in f if t not in self.tokens}))
        return [sum(map(self.tokens.__getitem__, f)) for f in found]

    def _learn_units(self, new: list[str]) -> None:
        """Units of letters are one pre-token; a comma or full stop after them is another."""
        words = {w for u in new if (w := u[:-1] if u.endswith((",", ".")) else u).isalpha()}
        fresh = [w for w in words if w not in self.units]
        coded = [(" " + w).encode() for w in fresh]
        for start in range(0, len(fresh), _AT_ONCE):
            part = coded[start : start + _AT_ONCE]
            if max(map(len, part)) <= RAGGED_BYTES:
                counts = ragged_counts(self.merges, part).tolist()
            else:
                counts = [self._one(t) for t in part]
            self.units.update(zip(fresh[start : start + _AT_ONCE], counts, strict=True))
        for start in range(0, len(new), CACHE // 8):
            part = [u for u in new[start : start + CACHE // 8] if u not in self.units]
            ended = [u for u in part if u.endswith((",", ".")) and u[:-1].isalpha()]
            self.units.update((u, self.units[u[:-1]] + 1) for u in ended)
            rest = [u for u in part if u not in self.units]
            self.units.update(zip(rest, self._sums([self.find(" " + u) for u in rest]), strict=True))

    def _one(self, token: bytes) -> int:
        if len(token) > RAGGED_BYTES:
            return long_count(self.merges, token)
        return int(ragged_counts(self.merges, [token])[0])

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        spaced: list[tuple[int, list[str]]] = []
        whole: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            pieces = [text or ""]
            for special in self.merges.specials:
                cut = [p.split(special) for p in pieces]
                out[k] += sum(len(c) - 1 for c in cut)
                pieces = [p for c in cut for p in c]
            for piece in pieces:
                if "  " in piece or piece.endswith(" "):
                    whole.append((k, self.find(piece)))
                elif piece:
                    head, *rest = piece.split(" ")
                    whole.append((k, self.find(head)))
                    spaced.append((k, rest))
        fresh: set[str] = set()
        for _, rest in spaced:
            fresh.update(rest)
        if len(self.units) > CACHE:
            self.units.clear()
        self._learn_units([u for u in fresh if u not in self.units])
        for k, rest in spaced:
            out[k] += sum(map(self.units.__getitem__, rest))
        for start in range(0, len(whole), 1000):
            part = whole[start : start + 1000]
            for (k, _), n in zip(part, self._sums([f for _, f in part]), strict=True):
                out[k] += n
        return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches, size=2 << 20):
            counts = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    return (
        documents(docs, "doc_id", "text")
        .select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
