"""Benchmark decontamination: every passage queries a BM25 index of the test items.

The items are indexed in shards of bounded size, each broadcast by itself; the number of
items, their mean length and the words' document frequencies are those of all items, so
shards change no score. A text is read
as overlapping passages, long enough that any item lies whole in one. A passage's distinct
words are the query; an item is retrieved if its BM25 score reaches a share of the score
that the item gives itself. Retrieval is document-at-a-time WAND: posting lists are walked
in item order, the pivot is where the sum of the lists' highest impacts can reach the bound,
and the highest impacts of the blocks there must reach it too before anything is scored.
A retrieved item is verified: word five-grams of its question and of its answer must both
occur in the passage to a share of at least ``OVERLAP``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, small, text_of, unused

K1, B = 1.2, 0.75
SHARE = 0.6  # of an item's own score
OVERLAP = 0.8
WIDTH = 5
BLOCK = 4
#: Characters of the items in one broadcast shard, at most (one longer item is a shard by itself).
SHARD_CHARS = 8 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's answer is its last sentence; of an item of one sentence, the last third of the words."""
    sentences = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def _grams(words: list[bytes]) -> set[bytes]:
    width = min(WIDTH, len(words))
    return {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} if width else set()


class Part:
    """One side of an item: its word five-grams, or the whole side if it is shorter."""

    def __init__(self, words: list[bytes]):
        self.width, self.grams = min(WIDTH, len(words)), _grams(words)

    def overlap(self, passage: list[bytes]) -> float:
        if not self.grams:
            return 1.0
        n = self.width
        return len(self.grams & {b" ".join(passage[k : k + n]) for k in range(len(passage) - n + 1)}) / len(self.grams)


class Statistics(NamedTuple):
    """Of all items that have words: their number, their words, the longest one's words, and each word's number of items."""

    items: int
    words: int
    longest: int
    frequency: dict[bytes, int]


class Index:
    """Inverted index of items in item order, with impacts and their maxima over blocks of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, whole: Statistics | None = None):
        self.ids, self.parts, counted = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.parts.append(tuple(map(Part, question_and_answer(text))))
                tf: dict[bytes, int] = {}
                for w in words:
                    tf[w] = tf.get(w, 0) + 1
                counted.append((len(words), tf))
        n = len(counted)
        df: dict[bytes, int] = {}
        for _, tf in counted:
            for w in tf:
                df[w] = df.get(w, 0) + 1
        whole = whole or Statistics(n, sum(size for size, _ in counted), max((size for size, _ in counted), default=0), df)
        self.longest, mean = whole.longest, whole.words / max(1, whole.items)
        self.term = {w: k for k, w in enumerate(sorted(df))}
        self.items: list[list[int]] = [[] for _ in df]
        self.impact: list[list[float]] = [[] for _ in df]
        own = [0.0] * n
        for k, (size, tf) in enumerate(counted):
            for w, f in tf.items():
                idf = math.log(1 + (whole.items - whole.frequency[w] + 0.5) / (whole.frequency[w] + 0.5))
                x = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
                self.items[self.term[w]].append(k)
                self.impact[self.term[w]].append(x)
                own[k] += x
        self.bound = [share * x for x in own]
        blocks = -(-n // BLOCK)
        self.block_bound = [min(self.bound[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)]
        self.most = np.array([max(x) for x in self.impact] + [0.0])
        self.block_most: list[dict[int, float]] = []
        self.block_at: list[dict[int, tuple[int, int]]] = []
        for items_, impact in zip(self.items, self.impact):
            most: dict[int, float] = {}
            place: dict[int, tuple[int, int]] = {}
            for at, (k, x) in enumerate(zip(items_, impact)):
                most[k // BLOCK] = max(x, most.get(k // BLOCK, 0.0))
                place[k // BLOCK] = (place.get(k // BLOCK, (at, at))[0], at + 1)
            self.block_most.append(most)
            self.block_at.append(place)
        self.least = min(self.bound, default=math.inf)
        # the blocks' maxima once more as flat arrays by term, for the bounds of a whole passage at once
        sizes = np.array([len(m) for m in self.block_most] + [0], np.int64)
        self.flat_start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.flat_size = sizes
        self.flat_block = np.array([b for m in self.block_most for b in m], np.int64)
        self.flat_most = np.array([x for m in self.block_most for x in m.values()])
        self.limits = np.array(self.block_bound)

    def reachable(self, terms: np.ndarray) -> list[int]:
        """Blocks whose bound the sum of the terms' block maxima reaches."""
        sizes = self.flat_size[terms]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.flat_start[terms] - ends + sizes, sizes)
        sums = np.bincount(self.flat_block[at], weights=self.flat_most[at], minlength=len(self.limits))
        return np.flatnonzero(sums >= self.limits - 1e-9).tolist()

    def search(self, terms: list[int], blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items, in these blocks, whose score by these distinct terms reaches their bound.

        Blocks default to all. WAND over the terms' posting lists, cut to the blocks.
        """
        lists = []  # [current item, place, items, impacts, highest impact, term]
        for t in terms:
            own, impact = self.items[t], self.impact[t]
            if blocks is not None:
                spans = [self.block_at[t][b] for b in blocks if b in self.block_at[t]]
                if not spans:
                    continue
                own = [k for lo, hi in spans for k in own[lo:hi]]
                impact = [x for lo, hi in spans for x in impact[lo:hi]]
            lists.append([own[0], 0, own, impact, max(impact) if blocks is not None else float(self.most[t]), t])
        found = []
        tiny = 1e-9
        key = lambda entry: entry[0]
        while lists:
            lists.sort(key=key)
            total, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                total += entry[4]
                if total >= self.least - tiny:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            at_most = sum(self.block_most[entry[5]].get(block, 0.0) for entry in lists[: pivot + 1])
            if at_most < self.block_bound[block] - tiny:
                # no item up to the block's end, or to the next list's item, can reach its bound
                target = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                target = max(target, item + 1)
            elif lists[0][0] == item:
                score = sum(entry[3][entry[1]] for entry in lists[: pivot + 1])
                if score >= self.bound[item] - tiny:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            alive = lists[pivot + 1 :]
            for entry in lists[: pivot + 1]:
                if entry[0] < target:
                    p = bisect_left(entry[2], target, entry[1])
                    if p == len(entry[2]):
                        continue
                    entry[0], entry[1] = entry[2][p], p
                alive.append(entry)
            lists = alive
        return found

    def scan(self, text: str | None, overlap: float = OVERLAP) -> list[tuple[int, float, float, float, int, int]]:
        """(item id, score, question overlap, answer overlap, first word, words) of each verified item's best passage."""
        words = words_of(text)
        if not self.ids or not words:
            return []
        get = self.term.get
        none = len(self.term)
        codes = np.array([get(w, none) for w in words], np.int64)
        reach = np.concatenate([[0.0], np.cumsum(self.most[codes])])
        if reach[-1] < self.least:
            return []
        stride = max(1, self.longest)
        best: dict[int, tuple] = {}
        for start in range(0, max(1, len(words) - stride), stride):
            end = min(len(words), start + 2 * stride)
            if reach[end] - reach[start] < self.least:
                continue
            terms = np.unique(codes[start:end])
            if terms[-1] == none:
                terms = terms[:-1]
            if self.most[terms].sum() < self.least or not (blocks := self.reachable(terms)):
                continue
            for item, score in self.search(terms.tolist(), blocks):
                passage = words[start:end]
                q, a = (part.overlap(passage) for part in self.parts[item])
                if q >= overlap and a >= overlap and score > best.get(item, (0.0,))[0]:
                    best[item] = (score, q, a, start, end - start)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]


def _counted(batches):
    for batch in small(batches):
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            own = sorted(set(words))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(own), pa.int32()), pa.array(own, pa.binary()), pa.array([len(words)] + [0] * (len(own) - 1) if own else [], pa.int64())], ["shard", "word", "size"])


def shards_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = SHARD_CHARS) -> Iterator[tuple[list, Statistics | None]]:
    """The items' rows, shard by shard, with the statistics of all items for the shard's words.

    There are as many shards, by the hash of the id, as the size needs; the driver holds
    one at a time. A single shard is all there is and counts for itself.
    """
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    count = max(1, -(-int(size * 1.25) // most))
    if count == 1:
        yield rows.orderBy("id", "text").collect(), None
        return
    dealt = cut(rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(count)).cast("int")), "items")
    words = cut(dealt.select("shard", "text").mapInArrow(released(_counted), "shard int, word binary, size long"), "words")
    total = words.agg(F.count_if(F.col("size") > 0).alias("items"), F.sum("size").alias("words"), F.max("size").alias("longest")).first()
    frequency = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    for k in range(count):
        own = frequency.join(words.where(F.col("shard") == k).select("word").distinct(), "word", "left_semi").collect()
        whole = Statistics(total["items"], total["words"] or 0, total["longest"] or 0, {bytes(r.word): r.n for r in own})
        yield dealt.where(F.col("shard") == k).select("id", "text").orderBy("id", "text").collect(), whole


FOUND = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:long,n_words:long>>"


def matches(df: DataFrame, items: DataFrame, text_col: str = "text", share: float = SHARE, overlap: float = OVERLAP, found_col: str = "_found", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """All rows and columns of ``df`` with ``found_col``, the verified items of the row's text (empty: clean).

    Null and empty texts are clean, null and empty items match nothing; items that share
    an id are items of their own; repeated rows stay; an empty table gives an empty result;
    a column of ``df`` named ``found_col`` is an error. Each shard of the items adds one
    pass of matching over the texts, in the same scan.
    """
    if found_col in df.columns:
        raise ValueError(f"{found_col} is a column of the table: name another found_col")
    out, found = df, []
    for rows, whole in shards_of(items, most=shard_chars):
        shared = df.sparkSession.sparkContext.broadcast(Index([(r.id, r.text) for r in rows], share, whole))
        found += unused(out, "_found0")
        out = out.withColumn(found[-1], _scanner(shared, overlap)(text_of(text_col)))
    return out.withColumn(found_col, F.concat(*found)).drop(*found)


_FIELDS = (("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()))


def _scanner(shared, overlap: float):
    names = [n for n, _ in _FIELDS]

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        index = shared.value
        rows = [[dict(zip(names, m)) for m in index.scan(t, overlap)] for k in range(0, len(texts), 256) for t in texts.slice(k, 256).to_pylist()]
        return pa.array(rows, pa.list_(pa.struct(_FIELDS)))

    return scanned


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap, first_word, n_words): a row per verified pair."""
    found = matches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), items, "_text")
    return found.select("id", F.explode("_found").alias("m")).select("id", "m.*")


def clean(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no verified item, with their columns."""
    (found,) = unused(df, "_found")
    return matches(df, items, text_col, found_col=found).where(F.size(found) == 0).select(*df.columns)
