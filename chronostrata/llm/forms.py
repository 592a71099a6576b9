"""One consistent form for texts that look the same (problem 10).

Method: the corpus's own frequent spellings form a trie. Each distinct token is run through it by a weighted edit
automaton in which look-alikes, width, ligatures and the two ways of writing an accent cost nothing, nor do invisible
characters; any other edit costs 1 and the budget (``max_cost``) is 0 by default. Of the words reached at no cost
the most frequent is the canonical spelling. Tokens that reach none are normalised by table. A free path exists exactly
between texts with the same skeleton, so the automaton chooses how a token is spelled in the result (a word of the
corpus, in its own script, instead of a bare skeleton) but which texts match follows from the skeleton alone: the table
would give the same classes. With ``max_cost`` over 0, which no query here uses, the vocabulary decides what is joined:
the result is exact for the words that are given, and the caller must give all that count.

Defined results: a null text has a null form; a text with nothing visible has the form ''. White space of any kind and
length is one space, none at the ends. Case, accents, digits, superscripts and other punctuation are kept apart.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.llm.workers import kept
from chronostrata.session import cut, ship, shuffle_width

# Letters of other scripts that are drawn like a Latin letter, and hyphens drawn like "-".
LOOK_ALIKES = (
    # Cyrillic
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ҮY ԚQ ԜW ԌG ӀI "
    # Greek
    "οo ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    # Latin
    "ɡg ɑa "
    # hyphens
    "‐- ‑- ﹣-"
)
DRAWN_LIKE = {pair[0]: pair[1:] for pair in LOOK_ALIKES.split()}
# Characters without a drawing that the general category doesn't mark as invisible.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}

#: Spellings that ``vocabulary`` gives at most. Tokens beyond it are normalised by table: they may be spelled otherwise than the corpus mostly
#: does, but at no cost, as here, the same texts have one form with any vocabulary.
VOCABULARY = 50_000
#: At most this many texts are ever hot; and the documents that a part of one should have.
HOT, HOT_ROWS = 10_000, 1_000_000
REMEMBERED = 500_000


@lru_cache(maxsize=65_536)
def skeleton(ch: str) -> str:
    """What one character is compared as: '' if invisible, else decomposed and with its look-alike in place."""
    if ord(ch) in _INVISIBLE or unicodedata.category(ch) in ("Cf", "Cc"):
        return ""
    kind, _, codes = unicodedata.decomposition(ch).rpartition("> ")
    if kind in ("<wide", "<narrow") or kind and "LIGATURE" in unicodedata.name(ch, ""):
        return "".join(skeleton(chr(int(c, 16))) for c in codes.split())
    return "".join(DRAWN_LIKE.get(c, c) for c in unicodedata.normalize("NFD", ch))


def by_table(token: str) -> str:
    """The form of a token (a text without white space) by table alone."""
    return token if token.isascii() and token.isprintable() else unicodedata.normalize("NFC", "".join(map(skeleton, token)))


def symbols(token: str) -> str:
    """The symbols the automaton reads: visible, decomposed, marks in canonical order, scripts kept apart."""
    return unicodedata.normalize("NFD", "".join(_plain(c) for c in token))


@lru_cache(maxsize=65_536)
def _plain(ch: str) -> str:
    if ord(ch) in _INVISIBLE or unicodedata.category(ch) in ("Cf", "Cc"):
        return ""  # ignorable: costs nothing, moves nowhere
    kind, _, codes = unicodedata.decomposition(ch).rpartition("> ")
    if kind in ("<wide", "<narrow") or kind and "LIGATURE" in unicodedata.name(ch, ""):
        return "".join(_plain(chr(int(c, 16))) for c in codes.split())
    return ch


class Trie:
    """Nodes are numbers; ``edges[node]`` maps what a symbol looks like to the (symbol, node) pairs below."""

    def __init__(self, words: list[tuple[str, int]]):
        self.edges: list[dict[str, list[tuple[str, int]]]] = [{}]
        self.word: list[tuple[int, str] | None] = [None]
        for spelled, count in words:
            if not (visible := symbols(spelled)):
                continue
            text, node = unicodedata.normalize("NFC", visible), 0
            for s in visible:
                below = self.edges[node].setdefault(DRAWN_LIKE.get(s, s), [])
                step = next((n for x, n in below if x == s), None)
                if step is None:
                    step = len(self.edges)
                    self.edges.append({})
                    self.word.append(None)
                    below.append((s, step))
                node = step
            if self.word[node] is None or (-count, text) < self.word[node]:
                self.word[node] = (-count, text)

    def nearest(self, token: str, max_cost: int = 0) -> str | None:
        """The canonical spelling: of the words at the least cost the most frequent, then the first in order."""
        at = self._free({0: 0}, max_cost)
        for s in symbols(token):
            look, then = DRAWN_LIKE.get(s, s), {}
            for node, cost in at.items():
                for _, below in self.edges[node].get(look, ()):
                    if cost < then.get(below, max_cost + 1):
                        then[below] = cost
                if cost < max_cost:  # a deletion, or another symbol in its place
                    if cost + 1 < then.get(node, max_cost + 1):
                        then[node] = cost + 1
                    for other, pairs in self.edges[node].items():
                        if other != look:
                            for _, below in pairs:
                                if cost + 1 < then.get(below, max_cost + 1):
                                    then[below] = cost + 1
            at = self._free(then, max_cost)
            if not at:
                return None
        ends = [(cost, *self.word[n]) for n, cost in at.items() if self.word[n] is not None]
        return min(ends)[2] if ends else None

    def _free(self, at: dict[int, int], max_cost: int) -> dict[int, int]:
        """With the insertions that the budget allows."""
        if not max_cost:
            return at
        todo = list(at)
        while todo:
            node = todo.pop()
            if at[node] < max_cost:
                for pairs in self.edges[node].values():
                    for _, below in pairs:
                        if at[node] + 1 < at.get(below, max_cost + 1):
                            at[below] = at[node] + 1
                            todo.append(below)
        return at


class Former:
    def __init__(self, words: list[tuple[str, int]], max_cost: int = 0):
        self.trie, self.max_cost, self.known = Trie(words), max_cost, {}

    def token(self, token: str) -> str:
        form = self.known.get(token)
        if form is None:
            form = self.trie.nearest(token, self.max_cost)
            form = by_table(token) if form is None else form
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = form
        return form

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        known, token = self.known, self.token
        return " ".join(f for t in text.split() if (f := known[t] if t in known else token(t)))


def script(token: str) -> str | None:
    """The one script of a token's letters, None if it mixes scripts or has none."""
    found = {unicodedata.name(c, "?").split()[0] for c in token if c.isalpha()}
    return found.pop() if len(found) == 1 else None


def vocabulary(documents: DataFrame, text: str, size: int = VOCABULARY) -> list[tuple[str, int]]:
    """(spelling, count) of the corpus's most frequent clean tokens: composed, of one script, seen at least twice.
    Counted over all documents, pre-aggregated in each task; the driver gets ``size`` short tokens at most."""

    ship(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(n: Counter) -> pa.RecordBatch:
            clean = [(t, k) for t, k in n.items() if len(t) <= 40 and t.isprintable() and script(t) in ("LATIN", "CYRILLIC", "GREEK") and unicodedata.normalize("NFC", symbols(t)) == t]
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in clean], pa.string()), pa.array([k for _, k in clean], pa.int64())], names=["token", "n"])

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    n.update(t.split())
            if len(n) > 300_000:
                yield flush(n)
                n.clear()
        yield flush(n)

    counts = documents.select(text).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    return [(r[0], r[1]) for r in counts.orderBy(F.desc("n"), "token").limit(size).collect()]


def consistent_form(spark: SparkSession, text: Column, words: list[tuple[str, int]], max_cost: int = 0) -> Column:
    """Column with the consistent form of ``text``, given a vocabulary."""
    ship(spark)
    shipped, name = spark.sparkContext.broadcast((words, max_cost)), uuid.uuid4().hex

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        former = kept(name, lambda: Former(*shipped.value))
        return pa.array([former.text(t) for t in texts.to_pylist()], pa.string())

    # kept from being evaluated twice, in a pushed-down filter and again for its value
    return form.asNondeterministic()(text).alias("form")


@dataclass(frozen=True)
class Looks:
    """rows (doc, t, f): every document with the hashes of its text and of its form; texts (f, t, n, least): the distinct
    texts with the numbers and least ids of their documents; hot: the texts with many documents."""

    rows: DataFrame
    texts: DataFrame
    hot: DataFrame
    salts: int

    def scattered(self, rows: DataFrame, text: str, salt: str) -> DataFrame:
        """Rows of documents, with a salt that divides those of a hot text."""
        there = rows.join(F.broadcast(self.hot.select(F.col("t").alias(text), F.lit(True).alias("is_hot"))), text, "left")
        return there.withColumn(salt, F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc"), F.lit(self.salts))).otherwise(0).cast("int")).drop("is_hot")

    def copied(self, rows: DataFrame, text: str, salt: str) -> DataFrame:
        """Rows of texts, once for each salt that their documents can have."""
        there = rows.join(F.broadcast(self.hot.select(F.col("t").alias(text), F.lit(True).alias("is_hot"))), text, "left")
        return there.withColumn(salt, F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0))))).drop("is_hot")


def looks(documents: DataFrame, doc_id: str, text: str) -> Looks:
    """Null texts and ids and texts with nothing visible take no part; repeated rows count once, and the same id with another
    text as another document. The list of hot texts has at most ``HOT`` rows, as each
    stands for over 1 / ``HOT`` of all documents."""
    spark = documents.sparkSession
    words = vocabulary(documents, text)
    rows = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.md5(F.col(text)).alias("t"), consistent_form(spark, F.col(text), words))
    rows = cut(rows.where("form <> ''").select("doc", F.unhex("t").alias("t"), F.unhex(F.md5("form")).alias("f")).distinct())
    texts = cut(rows.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least")))
    width, total = shuffle_width(spark), texts.agg(F.sum("n")).first()[0] or 0
    hot = texts.where(F.col("n") > max(total / HOT, min(HOT_ROWS, total / (4 * width)))).select("t").collect()
    return Looks(rows, texts, spark.createDataFrame(hot, rows.select("t").schema), max(width, -(-total // HOT_ROWS) if hot else 1))


def same_looking_classes(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each document: doc_id, class_id (the least id of those that look the same) and links, the number of
    documents that look the same but have another text."""
    found = looks(documents, doc_id, text)
    forms = found.texts.groupBy("f").agg(F.sum("n").alias("docs"), F.min("least").alias("class_id"))
    known = found.texts.join(forms, "f").select("t", "class_id", (F.col("docs") - F.col("n")).alias("links"))
    rows = found.scattered(found.rows.select("doc", "t"), "t", "s").join(found.copied(known, "t", "s"), ["t", "s"])
    return rows.select(F.col("doc").alias("doc_id"), "class_id", "links")


def same_looking_pairs(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: stored texts that differ and have one form. Exact copies aren't compared with each
    other: the distinct texts of a form are paired, and each pair of texts is then joined with its documents, those of a
    hot text in many parts. ``same_looking_classes`` says the same in one row a document."""
    found = looks(documents, doc_id, text)
    several = found.texts.groupBy("f").count().where("count > 1").select("f")
    texts = found.texts.select("f", "t").join(several, "f", "left_semi")
    pairs = texts.join(texts.select("f", F.col("t").alias("t2")), "f").where("t < t2").select("t", "t2")
    pairs = found.copied(found.copied(pairs, "t", "s"), "t2", "s2")
    docs = found.rows.select("doc", "t")
    a = found.scattered(docs, "t", "s").select(F.col("doc").alias("a"), "t", "s")
    b = found.scattered(docs.select("doc", F.col("t").alias("t2")), "t2", "s2").select(F.col("doc").alias("b"), "t2", "s2")
    both = pairs.join(a, ["t", "s"]).join(b, ["t2", "s2"]).where("a <> b")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
