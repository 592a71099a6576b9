"""Encoding a whole corpus with a public byte-level BPE tokenizer (problem 8).

Method: a hierarchical-bitmap rank queue. Each merge rank has a bucket of positions in the linked list of a
pre-token's symbols; a hierarchy of 64-bit words says which buckets hold any, so find-first-set from the top gives the
least rank in a fixed number of steps. Entries whose pair has changed since are stale and skipped when they come up.
A pre-token of n bytes costs O(n log n) at worst, whatever its length; nothing is cut or split.

Defined results: null and empty texts give an empty list; special tokens are ordinary text; no other text is changed.
"""

from __future__ import annotations

import json
import uuid
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronostrata.llm.workers import kept
from chronostrata.session import ship

#: Pre-tokens of byte-level BPE (a fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pre-tokens kept by a worker; only a matter of speed.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48


class RankQueue:
    """A priority queue over ranks 0..n-1 that gives the least rank and, of it, the leftmost position."""

    def __init__(self, n: int):
        self.levels = []
        while True:
            n = -(-n // 64)
            self.levels.append([0] * n)
            if n <= 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for words in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            if words[at]:
                words[at] |= bit
                return  # the levels above know of this word already
            words[at] = bit
            rank = at

    def pop(self) -> tuple[int, int] | None:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = at << 6 | ((word & -word).bit_length() - 1)
        bucket = self.buckets[at]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[at]
            rank = at
            for words in self.levels:
                words[rank >> 6] &= ~(1 << (rank & 63))
                if words[rank >> 6]:
                    break
                rank >>= 6
        return at, position


class Vocabulary:
    """Merges by pair of ids, and the ids of single bytes; small (50,000 merges) whatever the corpus."""

    def __init__(self, merges: dict[int, tuple[int, int]], of_byte: list[int]):
        self.merges, self.of_byte = merges, of_byte

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a ``tokenizers`` file of kind BPE with byte-level pre-tokens."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # bytes stand as printable characters: themselves where printable, else the code points from 256 on, in order
        plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
        other = iter(range(256, 512))
        return cls(merges, [ids[chr(b if b in plain else next(other))] for b in range(256)])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.merges, self.of_byte = vocabulary.merges, vocabulary.of_byte
        self.queue = RankQueue(len(self.merges) + 1)  # empty between two pre-tokens
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> list[int]:
        """The ids of one pre-token."""
        of_byte, merges, queue = self.of_byte, self.merges, self.queue
        ids = [of_byte[b] for b in text.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (m := merges.get(ids[i] << 32 | ids[i + 1])) is not None:
                queue.push(m[0], i)
        while (found := queue.pop()) is not None:
            rank, i = found
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merges.get(ids[i] << 32 | ids[j])
            if m is None or m[0] != rank:
                continue  # stale: another merge took one of its symbols
            ids[i], ids[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get(ids[i] << 32 | ids[k])) is not None:
                    queue.push(m[0], i)
            h = before[i]
            if h >= 0 and (m := merges.get(ids[h] << 32 | ids[i])) is not None:
                queue.push(m[0], h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.split(text or ""):
            got = known.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = tuple(got)
            out.extend(got)
        return out


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Column of token ids (array<int>, never null). The driver reads the vocabulary; executors get it as a broadcast."""
    ship(spark)
    shipped, name = spark.sparkContext.broadcast(Vocabulary.load(path or tokenizer_path())), uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = kept(name, lambda: Encoder(shipped.value))
        return pa.array([encoder.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)
