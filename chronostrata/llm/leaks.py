"""Evaluation texts leaking into training text (problem 9).

Method: windows of a passage's size begin at every word of every document and of every test item. Each window is put
through CGK embeddings - a random walk that writes the current word and steps on or stays by a random bit of (step,
word), so that windows at a small edit distance come out at a small Hamming distance and equal windows come out equal.
Repeated bit sampling hashes the embeddings into buckets; windows that share a bucket with a window of an item are
verified exactly: ``width`` words of the item against the document's words from there on, with at most ``max_edits``
inserted, deleted or substituted words, wherever the document's stretch ends.

Recall: with edits the number of trials is found by trying the walk on random passages with that many inserted, deleted
or substituted words until ``recall`` of each kind share a bucket. For ``max_edits=0``, where a passage is the same words
in order with none between, equal windows have equal embeddings under any walk, so one trial finds all of them.

Scale: one pass over the documents whatever the number of items. Up to ``HELD`` windows of items are sent to all
tasks, and documents don't move. Beyond it the items' windows stay distributed: a bitmap of their buckets, of at most
16 MB, is sent around, the documents' windows that it lets through meet the items' in a join by bucket (which AQE splits
where a bucket is hot), and what meets is verified. Words that no item holds cost one edit wherever they stand, so in
the first way windows with too many of them are passed over before embedding.

Words are the longest runs of letters and digits of the text's consistent form, compared without regard to case.
Because look-alikes differ by case (a Cyrillic capital looks Latin where its small letter doesn't), letters count as
equal if a chain of look-alikes and cases joins them. Null and empty texts and items shorter than a window leak nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.llm.forms import DRAWN_LIKE, by_table
from chronostrata.llm.workers import kept
from chronostrata.session import cut, ship

#: Windows of items that are sent to all tasks at most; about 30 MB.
HELD = 300_000
#: Bits of the bitmap of buckets at most.
BITMAP = 1 << 27
#: Words whose embedding is sampled at once, to bound memory.
CHUNK = 400_000
REMEMBERED = 500_000
#: Trials after which a search is refused as too wide.
MOST_TRIALS = 250
_RUN = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _case_closure() -> dict[int, str]:
    """Small letters whose capitals look like another letter's, mapped to that letter."""
    return {ord(a.casefold()): b.casefold() for a, b in DRAWN_LIKE.items() if len(a.casefold()) == 1 and a.casefold() != b.casefold()}


def words_of(token: str) -> list[str]:
    return _RUN.findall(by_table(token).casefold().translate(_case_closure()))


_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


@dataclass(frozen=True)
class Walk:
    """What the trials of one search share. A walk writes the first ``length`` words of a window, which no number of allowed
    edits can push out of a passage, and then nothing more."""

    width: int
    max_edits: int
    trials: int = 1
    seed: int = 0

    length = property(lambda self: self.width - self.max_edits)
    steps = property(lambda self: (2 if self.max_edits else 3) * self.length)
    sampled = property(lambda self: min(self.steps, {0: 16, 1: 6, 2: 4}.get(self.max_edits, 3)))

    def places(self, trial: int) -> np.ndarray:
        return np.sort(np.random.default_rng(self.seed + 7919 * (trial + 1)).choice(self.steps, size=self.sampled, replace=False))

    def bits(self, hashes: np.ndarray, trial: int) -> np.ndarray:
        """Random bits by (step, word)."""
        with np.errstate(over="ignore"):
            step = mixed(np.arange(self.steps, dtype=np.uint64) + np.uint64(1_000_003 * (trial + 1) + self.seed))
            return (mixed(hashes[None, :] ^ step[:, None]) >> np.uint64(63)).astype(np.int8)

    def signatures(self, ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, trial: int) -> np.ndarray:
        """Of the windows at ``starts``: a 64-bit hash of the sampled places of their embedding; ids are places in ``hashes``."""
        bits, chosen = self.bits(hashes, trial), self.places(trial)
        at = np.zeros(len(starts), dtype=np.int64)
        out = np.full(len(starts), np.uint64(trial), dtype=np.uint64)
        sampled = set(chosen.tolist())
        for j in range(int(chosen.max()) + 1):
            inside = at < self.length
            word = ids[starts + np.minimum(at, self.length - 1)]
            if j in sampled:
                out = mixed(out ^ np.where(inside, hashes[word], np.uint64(0)))
            at += np.where(inside, bits[j, word], 0)
        return out


def edited(rng: np.random.Generator, passage: np.ndarray, edits: int, kind: str, words: int) -> np.ndarray:
    """The passage with words inserted, deleted or substituted at random places, and other words after it."""
    out = passage.tolist()
    for _ in range(edits):
        at = int(rng.integers(0, len(out)))
        if kind == "insert":
            out.insert(at, int(rng.integers(0, words)))
        elif kind == "delete":
            del out[at]
        else:
            out[at] = int(rng.integers(0, words))
    return np.array(out + rng.integers(0, words, len(passage)).tolist())[: len(passage) + edits]


@lru_cache(maxsize=64)
def planned(width: int, max_edits: int, recall: float, seed: int) -> Walk:
    """A walk with the number of trials that reaches the recall."""
    if not 0 <= max_edits < width:
        raise ValueError("a passage needs more words than edits")
    if not max_edits:
        return Walk(width, 0, 1, seed)
    rng, walk, n, words = np.random.default_rng(seed), Walk(width, max_edits, 1, seed), 1000, 5000
    hashes = mixed(np.arange(words, dtype=np.uint64))
    whole, size = rng.integers(0, words, (n, width)), width + max_edits
    kinds = [np.stack([edited(rng, p, max_edits, kind, words) for p in whole]) for kind in ("insert", "delete", "substitute")]
    met = np.zeros((len(kinds), n), dtype=bool)
    trial, sure = 0, recall + 2 * (recall * (1 - recall) / n) ** 0.5  # beyond what chance may give a sample
    while met.mean(axis=1).min() < sure and trial < MOST_TRIALS:
        own = walk.signatures(whole.ravel(), np.arange(n) * width, hashes, trial)
        for k, rows in enumerate(kinds):
            met[k] |= walk.signatures(rows.ravel(), np.arange(n) * size, hashes, trial) == own
        trial += 1
    if met.mean(axis=1).min() < sure:
        raise ValueError(f"{MOST_TRIALS} trials don't reach a recall of {recall} for {max_edits} edits in {width} words")
    return Walk(width, max_edits, trial, seed)


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Where a row of b is at most ``limit`` edits from some beginning of the row of a; all rows at once, exact."""
    w = b.shape[1]
    if not limit:
        return (a[:, :w] == b).all(axis=1)
    n, m = len(b), a.shape[1]
    was = np.broadcast_to(np.arange(m + 1, dtype=np.int16), (n, m + 1)).copy()
    for i in range(w):
        now = np.empty_like(was)
        now[:, 0] = i + 1
        for j in range(m):
            now[:, j + 1] = np.minimum(np.minimum(was[:, j + 1], now[:, j]) + 1, was[:, j] + (b[:, i] != a[:, j]))
        was = now
    return was.min(axis=1) <= limit


class Items:
    """Windows of the items, hashed once for each trial. Word numbers are 0 for words that no item holds, and the last one for
    what lies behind a text's end."""

    def __init__(self, items: list[tuple[int, str]], walk: Walk):
        self.walk = walk
        self.vocabulary: dict[str, int] = {}
        flat, starts, owners = [], [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for t in (text or "").split() for w in words_of(t)]
            if len(ids) >= walk.width:
                starts.extend(range(len(flat), len(flat) + len(ids) - walk.width + 1))
                owners.extend([item] * (len(ids) - walk.width + 1))
                flat.extend(ids)
        self.end = len(self.vocabulary) + 1
        self.ids, self.starts, self.owners = (np.array(x, dtype=np.int64) for x in (flat, starts, owners))
        self.hashes = np.concatenate([[np.uint64(1)], word_hashes(list(self.vocabulary)), [np.uint64(2)]]).astype(np.uint64)
        self.trials = []
        for trial in range(walk.trials if len(self.starts) else 0):
            sign = walk.signatures(self.ids, self.starts, self.hashes, trial)
            order = np.argsort(sign, kind="stable")
            self.trials.append((sign[order], order))

    def leaked(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(document row, item) pairs, given the words of many documents one after the other, each with ``2 * max_edits`` ends
        behind it, and each word's row."""
        w, k = self.walk.width, self.walk.max_edits
        if len(ids) < w + k or not self.trials:
            return np.zeros((0, 2), dtype=np.int64)
        strange = np.concatenate([[0], np.cumsum((ids == 0) | (ids == self.end))])
        last = len(ids) - w - k + 1
        starts = np.flatnonzero((owner[:last] == owner[w + k - 1 :]) & (strange[w - k : w - k + last] - strange[:last] <= k))
        found = []
        for trial, (sign, order) in enumerate(self.trials):
            for c in range(0, len(starts), CHUNK):
                here = starts[c : c + CHUNK]
                own = self.walk.signatures(ids, here, self.hashes, trial)
                lo, hi = np.searchsorted(sign, own, "left"), np.searchsorted(sign, own, "right")
                met = np.flatnonzero(hi > lo)
                here, lo, n = here[met], lo[met], (hi - lo)[met]
                ends = np.cumsum(n)
                block = 0
                while block < len(here):  # exact verification of every candidate, a bounded number at once
                    stop = max(block + 1, int(np.searchsorted(ends, (ends[block - 1] if block else 0) + CHUNK, "right")))
                    counts = n[block:stop]
                    at = np.repeat(here[block:stop], counts)
                    pick = order[np.repeat(lo[block:stop] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
                    ok = edit_distance_within(ids[at[:, None] + np.arange(w + k)], self.ids[self.starts[pick][:, None] + np.arange(w)], k)
                    found.append(np.unique(np.stack([owner[at[ok]], self.owners[pick[ok]]], axis=1), axis=0))
                    block = stop
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


class Reader:
    """Texts to word numbers of a block's vocabulary, 0 for words that no item holds."""

    def __init__(self, items: Items):
        self.items, self.known = items, {}

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known, vocabulary = self.known, self.items.vocabulary
        for t in text.split():
            got = known.get(t)
            if got is None:
                got = [vocabulary.get(w, 0) for w in words_of(t)]
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(t) <= 64:
                    known[t] = got
            out += got
        return out


def _flat(texts: pa.Array, ids_of, least: int, ends: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, row of each) of many texts, whole ones, so that memory follows the longest text and not the batch."""
    flat: list[int] = []
    rows: list[tuple[int, int]] = []
    cut_off = lambda: (np.array(flat, dtype=np.int64), np.repeat([k for k, _ in rows], [n for _, n in rows]).astype(np.int64))
    for k, text in enumerate(texts):
        ids = ids_of(text.as_py())
        if len(ids) >= least:
            flat += ids
            flat += ends
            rows.append((k, len(ids) + len(ends)))
        if len(flat) >= CHUNK:
            yield cut_off()
            flat, rows = [], []
    yield cut_off()


def _sent_around(source: DataFrame, items: list[tuple[int, str]], walk: Walk, kind: T.StructType) -> DataFrame:
    shipped, name = source.sparkSession.sparkContext.broadcast((items, walk)), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(name, lambda: Reader(Items(*shipped.value)))
        ends = [reader.items.end] * (2 * walk.max_edits)
        for b in batches:
            for ids, owner in _flat(b.column(1), reader.ids, walk.length, ends):
                pairs = reader.items.leaked(ids, owner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], names=kind.names)

    return source.mapInArrow(scan, kind)


class Numbers:
    """Numbers of words as they come, anew for each batch; 0 is what lies behind a text's end."""

    def __init__(self):
        self.words = [""]
        self.known: dict[str, list[int]] = {}
        self.of: dict[str, int] = {}

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for t in text.split():
            got = self.known.get(t)
            if got is None:
                got = []
                for w in words_of(t):
                    if w not in self.of:
                        self.of[w] = len(self.words)
                        self.words.append(w)
                    got.append(self.of[w])
                self.known[t] = got
            out += got
        return out


def _windows(rows: DataFrame, walk: Walk, longer: int, let_through=None) -> DataFrame:
    """(id, sign, words) of every window and trial; ``longer``: how many words more than the width a window's text has. With a
    bitmap only the windows in its buckets."""
    kind = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("sign", T.LongType()), T.StructField("words", T.StringType())])
    size, least = walk.width + longer, walk.length if longer else walk.width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = Numbers()
            for ids, owner in _flat(b.column(1), numbers.ids, least, [0] * (size - least)):
                if len(ids) < size:
                    continue
                words, hashes = np.array(numbers.words, dtype=object), word_hashes(numbers.words)
                starts = np.flatnonzero(owner[: len(ids) - size + 1] == owner[size - 1 :])
                for trial in range(walk.trials):
                    for c in range(0, len(starts), CHUNK // 8):
                        here = starts[c : c + CHUNK // 8]
                        sign = walk.signatures(ids, here, hashes, trial)
                        if let_through is not None:
                            bits = let_through.value
                            at = sign & np.uint64(len(bits) * 64 - 1)
                            ok = bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0
                            here, sign = here[ok], sign[ok]
                        _, once = np.unique(np.stack([owner[here].astype(np.uint64), sign]), axis=1, return_index=True) if walk.max_edits == 0 and len(here) else (None, np.arange(len(here)))
                        here, sign = here[once], sign[once]
                        text = [" ".join(w).rstrip() for w in words[ids[here[:, None] + np.arange(size)]].tolist()]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[here])), pa.array(sign.view(np.int64)), pa.array(text, pa.string())], names=kind.names)

    return rows.mapInArrow(scan, kind)


def _joined(source: DataFrame, items: DataFrame, windows: int, walk: Walk) -> DataFrame:
    spark = source.sparkSession
    passages = cut(_windows(items, walk, 0).withColumnRenamed("id", "item").distinct())
    size = min(BITMAP, 1 << max(16, (16 * windows * walk.trials - 1).bit_length()))
    bits = np.zeros(size // 64, dtype=np.uint64)
    words = passages.selectExpr(f"sign & {size - 1}L AS at").groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L AS int)))").alias("b"))
    for row in words.collect():  # one for each 64 bits at most
        bits[row["w"]] = np.int64(row["b"]).view(np.uint64)
    met = _windows(source, walk, walk.max_edits, spark.sparkContext.broadcast(bits)).join(passages.withColumnRenamed("words", "passage"), "sign")
    if not walk.max_edits:
        return met.where("words = passage").select("id", "item")

    @F.arrow_udf("boolean")
    def near(words: pa.Array, passage: pa.Array) -> pa.Array:
        of: dict[str, int] = {}
        number = lambda texts, n: np.array([([of.setdefault(w, len(of)) for w in t.split(" ")] + [-1] * n)[:n] for t in texts.to_pylist()], dtype=np.int64).reshape(-1, n)
        return pa.array(edit_distance_within(number(words, walk.width + walk.max_edits), number(passage, walk.width), walk.max_edits))

    return met.where(near("words", "passage")).select("id", "item")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, width: int = 10, max_edits: int = 0, recall: float = 0.95, seed: int = 20_240_101) -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold ``width`` consecutive words of an item, up to ``max_edits`` inserted,
    deleted or substituted words."""
    spark = documents.sparkSession
    ship(spark)
    walk = planned(width, max_edits, recall, seed)
    source = documents.where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    tests = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()

    @F.arrow_udf("long")
    def windows(texts: pa.Array) -> pa.Array:
        return pa.array([max(0, sum(len(words_of(t)) for t in x.split()) - width + 1) for x in texts.to_pylist()], pa.int64())

    sized = cut(tests.withColumn("n", windows("text")).where("n > 0"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= HELD:
        kind = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("item", T.LongType())])
        found = _sent_around(source, [(r[0], r[1]) for r in sized.select(F.col("id").cast("bigint"), "text").collect()], walk, kind)
    else:
        found = _joined(source, sized.select("id", "text"), total, walk)
    return found.select(F.col("id").alias("doc_id"), F.col("item").cast(items.schema[item_id].dataType).alias("item_id")).distinct()
