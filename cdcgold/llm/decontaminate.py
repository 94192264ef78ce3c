"""Benchmark decontamination by suffix arrays over the training texts.

Every slice of documents is a shard.  Its suffix array holds the suffixes that begin with a word
of the test items; words that no item has count as 0, which nothing matches, and suffixes are
ordered only up to their first 0 or the length of the longest item.  All suffixes of the test
items are binary-searched at once: the neighbours of the place found give the longest verbatim
match, and where it has a whole window, a second search for the window gives all its locations.

Test items are read in blocks of bounded size, each block against all documents; the locations
found so far stay with the document as spans between blocks.

Null and empty texts have no words and match nothing.  Items without words have no window.  An
item without an id hits words, but is not counted or named.  Repeated ids are one item with the
windows of all its texts; repeated documents are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.llm.arrow import add_columns, keep_rows
from cdcgold.llm.quality import covered
from cdcgold.llm.text import ALNUM, Words, words
from cdcgold.session import materialise

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Bytes of test items searched for at a time.
BLOCK_BYTES = 4 << 20


@dataclass
class Tests:
    """Test items as numbers of words; every suffix of an item is a query."""

    ids: list  # by item
    vocabulary: np.ndarray  # sorted word hashes
    word: np.ndarray  # numbers from 1
    first: np.ndarray  # words of item i are first[i] .. first[i + 1]

    @classmethod
    def of(cls, ids: list, texts: list) -> Tests:
        w = words(pa.array(texts, pa.string()), ALNUM)
        vocabulary, number = np.unique(w.hash, return_inverse=True)
        return cls(ids, vocabulary, number.astype(np.int64) + 1, w.first)

    @cached_property
    def stop(self) -> np.ndarray:
        return np.repeat(self.first[1:], np.diff(self.first))

    @cached_property
    def item(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    @property
    def longest(self) -> int:
        return int(np.diff(self.first).max(initial=0))

    @cached_property
    def bits(self) -> int:
        return len(self.vocabulary).bit_length()

    def window(self) -> np.ndarray:
        """By query: the words of the window that begins there, 0 if none does."""
        size = np.diff(self.first)[self.item]
        left = self.stop - np.arange(len(self.word))
        return np.where(left >= WINDOW, WINDOW, np.where((size < WINDOW) & (left == size), size, 0))


def packed(number: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    """By position, the next words up to `stop` and the first 0 in one number."""
    key, alive, n = np.zeros(len(number), np.int64), np.ones(len(number), bool), len(number)
    at = np.arange(n)
    for d in range(63 // bits):
        then = at + d
        alive = alive & (then < stop)
        value = np.where(alive, number[np.minimum(then, n - 1)], 0)
        alive = value > 0
        key = key << bits | value
    return key


class Shard:
    """The suffix array of the words of some documents."""

    def __init__(self, w: Words, tests: Tests) -> None:
        at = np.minimum(np.searchsorted(tests.vocabulary, w.hash), len(tests.vocabulary) - 1)
        self.number = np.where(tests.vocabulary[at] == w.hash, at + 1, 0)
        self.stop = w.first[1:][w.owner()]
        self.tests, self.per = tests, 63 // tests.bits
        self.key = packed(self.number, self.stop, tests.bits)
        self.test_key = packed(tests.word, tests.stop, tests.bits)
        self.order = self._order()

    def _order(self) -> np.ndarray:
        at = np.flatnonzero(self.number)
        at = at[np.argsort(self.key[at], kind="stable")]
        key, n = self.key[at], len(self.number)
        edge = np.append(True, key[1:] != key[:-1])[: len(at)]
        rank, h = np.zeros(n + 1, np.int64), self.per
        rank[at] = np.flatnonzero(edge)[np.cumsum(edge) - 1] + 1
        full = (key & ((1 << self.tests.bits) - 1)) > 0  # no 0 in the words compared
        while h < self.tests.longest:
            tied = np.flatnonzero(~(edge & np.append(edge[1:], True)) & full)
            if not len(tied):
                break
            own = at[tied]
            then = own + h
            nxt = np.where(then < self.stop[own], rank[np.minimum(then, n)], 0)
            pair = rank[own] * (n + 2) + nxt
            by = np.argsort(pair, kind="stable")
            at[tied], pair = own[by], pair[by]
            edge[tied] = np.append(True, (pair[1:] != pair[:-1]) | (np.diff(tied) > 1))
            full[tied] = nxt[by] > 0
            starts = np.flatnonzero(edge)
            rank[at[tied]] = starts[np.searchsorted(starts, tied, "right") - 1] + 1
            h *= 2
        return at

    def _compare(self, query: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the first `size` words of queries stand to the suffixes at places."""
        sign, open_ = np.zeros(len(query), np.int8), np.arange(len(query))
        bits, per, d = self.tests.bits, self.per, 0
        while len(open_):
            q, p, left = query[open_] + d, place[open_] + d, size[open_] - d
            drop = np.maximum(per - left, 0) * bits
            a = self.test_key[np.minimum(q, len(self.test_key) - 1)] >> drop
            b = np.where(p < self.stop[place[open_]], self.key[np.minimum(p, len(self.key) - 1)], 0) >> drop
            sign[open_] = np.sign(a - b)
            open_, d = open_[(a == b) & (left > per)], d + per
        return sign

    def _search(self, query: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        """The first place of the order whose suffix is not before, or is after, the query."""
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.order))
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            sign = self._compare(query[open_], size[open_], self.order[mid])
            right = sign >= 0 if after else sign > 0
            lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]
        return lo

    def _shared(self, query: np.ndarray, place: np.ndarray) -> np.ndarray:
        total, open_ = np.zeros(len(query), np.int64), np.arange(len(query))
        while len(open_):
            q, p = query[open_] + total[open_], place[open_] + total[open_]
            ok = (q < self.tests.stop[query[open_]]) & (p < self.stop[place[open_]])
            ok[ok] = self.tests.word[q[ok]] == self.number[p[ok]]
            open_ = open_[ok]
            total[open_] += 1
        return total

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix: the words of its longest verbatim match, and a place of it."""
        query = np.arange(len(self.tests.word))
        if not len(self.order):
            return np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        to = self._search(query, self.tests.stop - query, False)
        before, at = self.order[np.maximum(to - 1, 0)], self.order[np.minimum(to, len(self.order) - 1)]
        left, right = self._shared(query, before), self._shared(query, at)
        return np.maximum(left, right), np.where(left > right, before, at)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of windows: word position, length and item of each."""
        size = self.tests.window()
        length, _ = self.longest()
        query = np.flatnonzero((size > 0) & (length >= size))
        lo, hi = (self._search(query, size[query], after) for after in (False, True))
        times = hi - lo
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = self.order[np.repeat(lo, times) + inside]
        return place, np.repeat(size[query], times), np.repeat(self.tests.item[query], times)


def _search(texts: pa.Array, tests: Tests) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    w = words(texts, ALNUM)
    if not len(tests.word) or not len(w.hash):
        none = np.zeros(0, np.int64)
        return w, none, none, none
    return (w, *Shard(w, tests).windows())


def _found(batch: pa.RecordBatch, text: str, tests: Tests) -> dict[str, pa.Array]:
    w, place, size, item = _search(batch.column(text), tests)
    step, n = np.zeros(len(w.hash) + 1, np.int64), len(w.hash)
    hit = covered(place, size, n) if n else step[:0] > 0
    owner, first = w.owner(), w.first[:-1]
    doc = owner[place]
    items: list[set[str]] = [set() for _ in range(len(first))]
    pairs = np.unique(doc.astype(np.int64) * (len(tests.ids) + 1) + item)
    for pair in pairs:
        i, k = divmod(int(pair), len(tests.ids) + 1)
        if tests.ids[k] is not None:
            items[i].add(str(tests.ids[k]))
    on = np.flatnonzero(hit)
    begin = on[(on == 0) | ~hit[on - 1] | (owner[on] != owner[on - 1])] if len(on) else on
    end = on[np.append(~hit[on[:-1] + 1] | (owner[on[:-1]] != owner[on[:-1] + 1]), True)] + 1 if len(on) else on
    spans: list[list] = [[] for _ in range(len(first))]
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        i = int(owner[a])
        spans[i].append({"start": a - int(first[i]), "stop": b - int(first[i])})
    if "_spans" in batch.schema.names:
        for i, (old, named) in enumerate(
            zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)
        ):
            spans[i], items[i] = _union(old + spans[i]), items[i] | set(named)
    return {
        "_words": pa.array(w.counts().astype(np.int64)),
        "_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        "_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    }


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[Tests]:
    """The test items, at most about `limit` bytes of text at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len((row[1] or "").encode())
        if size >= limit:
            yield Tests.of(ids, texts)
            ids, texts, size = [], [], 0
    yield Tests.of(ids, texts)


def locate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
    item_text: str = "text", limit: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns `keep` of every document, `_words`, and the hit word spans and items."""
    spark = docs.sparkSession
    out, added = docs.select(*dict.fromkeys([*keep, text])), []
    for tests in blocks(benchmark, item, item_text, limit):
        sent = spark.sparkContext.broadcast(tests)
        if added:
            out = materialise(out, "decontaminate")
        stay = list(dict.fromkeys([*keep, text]))
        out = add_columns(
            out,
            lambda b, sent=sent: _found(b, text, sent.value),
            "_words long, _spans array<struct<start:long,stop:long>>, _items array<string>",
            text,
            stay,
            SHARD_BYTES,
        )
        added = ["_words", "_spans", "_items"]
    return out.select(*keep, *added)


def report(located: DataFrame, key: str) -> DataFrame:
    """Counts and a digest of the items, one row a document."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return located.select(
        key,
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""

    def clean(batch: pa.RecordBatch, tests: Tests) -> pa.Array:
        w, place, _, _ = _search(batch.column(text), tests)
        ok = np.ones(batch.num_rows, bool)
        ok[w.owner()[place]] = False
        return pa.array(ok)

    out = docs
    for k, tests in enumerate(blocks(benchmark, item, item_text, limit)):
        sent = docs.sparkSession.sparkContext.broadcast(tests)
        out = materialise(out, "decontaminate") if k else out
        out = keep_rows(out, lambda b, sent=sent: clean(b, sent.value), text, SHARD_BYTES)
    return out
