"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Tasks count the word pairs of their texts in chunks; the hashes of pairs are dealt to shards, and
each shard adds up its counts and writes hashes, in order, and counts as plain arrays.  A second
pass over the texts looks its pairs up there and sums what each word needs: an occurrence of a pair
seen c times stands for 1 / c of a distinct pair, so sums over occurrences count distinct pairs.
Words are then dealt to shards and written the same way.  Tasks map these files into memory and
look the sorted distinct pairs and words of some texts up in them, so no task holds the model.

The files must be in a folder that every machine can open, by default under the folder in
`spark.checkpoint.dir`.  A file is written under another name and then renamed, so a task that is
run again, or twice at once, leaves the same whole file.

Tokens are lower-cased words and one end per text; the first word follows a start that is no token.
Discounts are the modified ones, from the counts of counts; where a corpus is too small for them
they fall back to 1/2.  Unseen words share what the lowest order discounts, evenly over all known
words and one more.

Defined cases: null and empty texts have the end only; a null id counts as the empty text in the
choice of training rows; without training rows every word is unseen.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcgold.llm.arrow import add_columns
from cdcgold.llm.text import U, mix, noise, slices, words
from cdcgold.session import materialise, workspace

START, END = (int(x) for x in noise(2, 9))
#: Pairs counted at a time; and tokens whose pairs are looked up at a time, which takes more memory.
CHUNK = 1 << 22
LOOK_UP = 1 << 19
#: Training tokens to a shard.
SHARD = 1 << 20
SCORE_BYTES = 4 << 20


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) + word)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and ends, the word before each, and where each text begins."""
    w = words(texts)
    n = len(texts)
    first = w.first + np.arange(n + 1)
    word = np.empty(first[-1], U)
    is_end = np.zeros(first[-1], bool)
    is_end[first[1:] - 1] = True
    word[is_end], word[~is_end] = U(END), w.hash
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first[:-1]] = U(START)
    return word, before, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _grouped(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    by = np.argsort(key) if times is not None else None
    key = np.sort(key) if by is None else key[by]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if by is None:
        return key[edge], np.diff(np.append(edge, len(key)))
    return key[edge], np.add.reduceat(times[by], edge) if len(edge) else edge


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and the words before them, about `LOOK_UP` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in slices(batches, text):
        held.append(tokens(part.column(text))[:2])
        size += len(held[-1][0])
        if size >= LOOK_UP:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """The leading bits of a hash, so that shards follow one another in order."""
    bits = (shards - 1).bit_length()
    return (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _pairs(docs: DataFrame, text: str, shards: int) -> DataFrame:
    """A row per chunk and shard: the chunk's pairs and their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, text):
            word, before, _ = tokens(part.column(text))
            held.append(pair_key(before, word))
            size += len(word)
            if size >= CHUNK:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if held:
            yield packed(np.concatenate(held))

    def packed(keys: np.ndarray) -> pa.RecordBatch:
        key, n = _grouped(keys)
        edge = np.searchsorted(_shard_of(key, shards), np.arange(shards + 1))
        spans = [(i, a, b) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        columns = [
            pa.array([i for i, _, _ in spans], pa.int32()),
            pa.array([key[a:b].tobytes() for _, a, b in spans], pa.binary()),
            pa.array([n[a:b].astype(np.uint32).tobytes() for _, a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "keys", "counts"])

    return docs.select(text).mapInArrow(run, "shard int, keys binary, counts binary")


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    own = TaskContext.get().taskAttemptId()
    for k, v in arrays.items():
        path = os.path.join(folder, f"{name}.{k}.npy")
        with open(f"{path}.{own}", "wb") as f:
            np.save(f, v)
        os.replace(f"{path}.{own}", path)


def _pair_shards(pairs: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes the pair arrays of each shard; gives the shard, and how many pairs it has by count from 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(shard, []).append((np.frombuffer(keys, U), np.frombuffer(counts, np.uint32)))
        for shard in list(held):
            parts = held.pop(shard)
            key, n = _grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            _save(folder, f"pairs-{shard}", {"key": key, "n": n.astype(np.min_scalar_type(int(n.max())))})
            of = [int((n == k).sum()) for k in range(1, 5)]
            columns = [pa.array([shard], pa.int32()), *(pa.array([x]) for x in of)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", *(f"n{k}" for k in range(1, 5))])

    return pairs.repartition(shards, "shard").mapInArrow(run, "shard int, n1 long, n2 long, n3 long, n4 long")


_TOTALS = ("total", "one", "two", "more", "uses", "times")


def _word_parts(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """What a chunk adds to each word's totals.

    By word: as a context its total and its distinct followers seen once, twice, more often; as a
    word the number of distinct words it follows and its count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, before in _chunks(batches, text):
            key, pair = np.unique(pair_key(before, word), return_inverse=True)
            (count,) = model._find("pairs", model.pair_shards, key, ("n",))
            count = count[pair]
            share = 1.0 / count
            everyone, at = np.unique(np.concatenate([word, before]), return_inverse=True)
            at_w, at_b, n = at[: len(word)], at[len(word) :], len(everyone)
            by_context = (np.ones(len(count)), share * (count == 1), share * (count == 2), share * (count > 2))
            columns = [np.bincount(at_b, weights=x, minlength=n) for x in by_context]
            columns += [np.bincount(at_w, weights=share, minlength=n), np.bincount(at_w, minlength=n).astype(float)]
            whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (everyone.view(np.int64), *columns)], ["word", *_TOTALS])
            for i in range(0, n, 1 << 17):
                yield whole.slice(i, 1 << 17)

    return docs.select(text).mapInArrow(run, "word long, " + ", ".join(f"{c} double" for c in _TOTALS))


def discounts(counts: list[int]) -> np.ndarray:
    """By 1, 2 and 3 or more what is taken off, from how many counts are 1 to 4."""
    n1, n2, n3, n4 = counts
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        made = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        out[1:] = [d if 0 < d < k else 0.5 for k, d in enumerate(made, 1)]
    return out


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all tasks need."""

    folder: str
    pair_shards: int
    word_shards: int
    tokens: int
    distinct: int  # different training tokens
    pairs: int  # different pairs
    discount: list[float]
    low_discount: list[float]
    low_weight: float  # what the lowest order discounts, as a share
    stored: frozenset[str] = frozenset()  # the shards that were written, as pairs-3 or words-0; others are empty
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _array(self, name: str) -> np.ndarray | None:
        """None for a shard without rows; a shard that was written and is not there is an error."""
        if name not in self._open:
            path = os.path.join(self.folder, f"{name}.npy")
            if name.split(".")[0] not in self.stored:
                return None
            if not os.path.exists(path):
                raise FileNotFoundError(f"{path} is not there: the model's folder must be shared by all machines")
            self._open[name] = np.load(path, mmap_mode="r")
        return self._open[name]

    def _find(self, kind: str, shards: int, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values for sorted keys, 0 for those that are not there."""
        out = [np.zeros(len(keys)) for _ in columns]
        edges = np.searchsorted(_shard_of(keys, shards), np.arange(shards + 1))
        for s in range(shards):
            lo, hi = edges[s], edges[s + 1]
            stored = self._array(f"{kind}-{s}.key") if hi > lo else None
            if stored is None or not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[lo:hi]), len(stored) - 1)
            hit = np.flatnonzero(stored[at] == keys[lo:hi])
            for values, c in zip(out, columns, strict=True):
                values[lo + hit] = self._array(f"{kind}-{s}.{c}")[at[hit]]
        return out

    def log10(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the model's log10 probability and its training count."""
        everyone, at = np.unique(np.concatenate([word, before]), return_inverse=True)
        total, back, uses, times = self._find("words", self.word_shards, everyone, ("total", "back", "uses", "times"))
        at_w, at_b = at[: len(word)], at[len(word) :]
        low_d = np.array(self.low_discount)
        low = np.maximum(uses - low_d[np.minimum(uses, 3).astype(int)], 0) / max(1, self.pairs)
        low += self.low_weight / (self.distinct + 1)
        keys, pair = np.unique(pair_key(before, word), return_inverse=True)
        (n,) = self._find("pairs", self.pair_shards, keys, ("n",))
        high = np.maximum(n - np.array(self.discount)[np.minimum(n, 3).astype(int)], 0)[pair]
        context = total[at_b]
        p = np.where(context > 0, high / np.maximum(context, 1) + back[at_b] * low[at_w], low[at_w])
        return np.log10(p), times[at_w]


def shared_folder(df: DataFrame) -> str:
    """A new folder that tasks can open by its path."""
    where = urlparse(workspace(df.sparkSession, "kneser-ney"))
    if where.scheme not in ("", "file"):
        raise ValueError(f"give a folder that every machine can open; {where.scheme}: paths are not")
    return where.path


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    folder = folder or shared_folder(docs)
    os.makedirs(folder, exist_ok=True)
    spark = docs.sparkSession
    # shards follow the size of the texts, six bytes or so to a token
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = 1 << max(0, int(size / 6 / SHARD)).bit_length()
    written = _pair_shards(_pairs(docs, text, shards), folder, shards)
    *of, found = written.agg(*[F.sum(f"n{k}") for k in range(1, 5)], F.collect_set("shard")).first()
    discount = discounts([n or 0 for n in of])
    stored = frozenset(f"pairs-{s}" for s in found)
    model = Model(folder, shards, 1, 0, 0, 0, discount.tolist(), [], 1.0, stored)

    stats = _word_parts(docs, text, model).groupBy("word")
    # sums of shares are whole numbers but for rounding
    stats = materialise(stats.agg(*[F.round(F.sum(c)).cast("long").alias(c) for c in _TOTALS]), "word-totals")
    seen = F.col("times") > 0
    s = stats.agg(
        F.sum("times").alias("tokens"),
        F.count(F.when(seen, 1)).alias("distinct"),
        F.sum("uses").alias("pairs"),
        *[F.count(F.when(F.col("uses") == k, 1)).alias(f"n{k}") for k in range(1, 5)],
        F.count(F.when(F.col("uses") > 2, 1)).alias("more"),
    ).first()
    low = discounts([s[f"n{k}"] for k in range(1, 5)])
    model.tokens, model.distinct, model.pairs = s["tokens"] or 0, s["distinct"], s["pairs"] or 0
    model.word_shards = 1 << max(0, s["distinct"] // SHARD).bit_length()
    model.low_discount = low.tolist()
    taken = float(low[1:] @ np.array([s["n1"], s["n2"], s["more"]]))
    model.low_weight = taken / model.pairs if model.pairs else 1.0
    model.stored |= {f"words-{s}" for s in _word_shards(stats, folder, model.word_shards, discount)}
    return model


def _word_shards(stats: DataFrame, folder: str, shards: int, discount: np.ndarray) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if not held:
            return
        shard, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        for s in np.unique(shard).tolist():
            word, total, one, two, more, uses, times = (x[shard == s] for x in rest)
            by = np.argsort(word.view(U))
            back = (discount[1] * one + discount[2] * two + discount[3] * more) / np.maximum(total, 1)
            own = {"key": word.view(U), "total": total, "back": back, "uses": uses, "times": times}
            _save(folder, f"words-{s}", {k: v[by] for k, v in own.items()})
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], ["shard"])

    shard = F.shiftrightunsigned("word", 64 - (shards - 1).bit_length()).cast("int") if shards > 1 else F.lit(0)
    dealt = stats.select(shard.alias("shard"), "word", *_TOTALS)
    return dealt.repartition(shards, "shard").mapInArrow(run, "shard int").agg(F.collect_set("shard")).first()[0]


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, token counts, and the scores of each whole text."""

    def scores(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        word, before, first = tokens(batch.column(text))
        log, times = model.log10(word, before)
        base = np.log10((times + 1) / (model.tokens + model.distinct + 1))
        return {
            "n_tokens": pa.array(np.diff(first).astype(np.int64)),
            "n_known": pa.array(_sums((times > 0).astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(base, first[:-1])),
            "score": pa.array(np.add.reduceat(log, first[:-1])),
        }

    schema = "n_tokens long, n_known long, base_score double, score double"
    return add_columns(docs.select(*dict.fromkeys([*keep, text])), scores, schema, text, keep, SCORE_BYTES)


def fold(doc_id: Column, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def held_out_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: int = 2) -> DataFrame:
    """Scores of all documents by a model of those outside fold `out`, with the perplexity."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("held_out", fold(F.col("doc_id")) == out)
    model = train(own.filter("not held_out"), "text")
    scored = score(own, model, ["doc_id", "held_out"], "text")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
