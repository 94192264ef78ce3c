"""Hard negatives: for an anchor and each of its best positives, the best rows of other labels in a score window.

Vectors become integers; a score is an integer inner product.  Anchors and candidates meet as
tiles, int64 matrices padded with zeros, multiplied by Strassen's recursion: seven half-size
products in place of eight.  Its additions are exact, in the ring of integers modulo 2^64, so
sums inside may wrap; only the scores must fit in 64 bits, which is checked before multiplying.

Anchors come in blocks of a fixed number of bytes, one broadcast at a time, and every task meets
a block with its candidates, batch by batch.  A heap of the best `k` entries per anchor, first of
positives, then per positive of the rows in its window, is all that a task keeps; heaps of tasks
merge as rows ranked per key.  No pairs are written, no side is collected whole, and a hot label
only makes some products larger.  The work is anchors times rows by nature.

Rows without id, label or vector and rows with a null or non-finite component take no part.  A
vector shorter than others counts as padded with zeros, an empty one scores 0.  Equal rows count
once; a row with the anchor's id is never its positive or negative.  Ties go to the smaller id,
and rows that share id and score count once.  Empty tables, or no anchors, give no rows.  Other
columns are not read.  Components or scores beyond 64 bits raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcgold.llm.ranks import numbered
from cdcgold.session import materialise, scratch

#: Products with a side this small are done directly.
LEAF = 48
#: Rows of a tile of anchors and of candidates.
TILE = 512
CANDIDATES = 2048
#: Anchors that are broadcast at a time, and bytes of their components.
BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 8 << 20

SCHEMA = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)
_LOW = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    #: a negative's score is between these hundredths of the positive's
    low: int = 30
    high: int = 90
    scale: int = 256


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of int64 matrices, exact modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        wide = strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))
        return wide[:m, :n]
    i, j, l = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out


def _reach(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices; the narrower one is padded with zeros."""
    width = max(a.shape[1], c.shape[1])
    if _reach(a) * _reach(c) * width >= 1 << 63:
        raise OverflowError("scores do not fit in 64 bits")
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    return strassen(a, np.ascontiguousarray(c.T))


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have finite components only, and those as rows of floor(scale * x)."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    whole = vectors.is_valid().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    values = vectors.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    owner = np.repeat(np.arange(len(size)), size)
    whole &= np.bincount(owner[~np.isfinite(values)], minlength=len(size)) == 0
    own = whole[owner]
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    scaled = np.floor(values[own] * scale)
    if len(scaled) and np.abs(scaled).max() >= 2.0**63:
        raise OverflowError("a component does not fit in 64 bits")
    line = np.cumsum(whole) - 1
    out = np.zeros((int(whole.sum()), int(size[whole].max(initial=0))), np.int64)
    out[line[owner[own]], place[own]] = scaled.astype(np.int64)
    return whole, out


class Heaps:
    """The best `k` (score, id) of each of `n` keys: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.size = np.zeros(n, np.int64)
        self.least = np.full(n, _LOW, np.int64)  # what a score must reach to matter

    def offer(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Entries of any keys, merged with what those keys hold; equal entries count once."""
        own = np.unique(key)
        held = np.arange(self.k) < self.size[own][:, None]
        key = np.concatenate([np.repeat(own, self.size[own]), key])
        score = np.concatenate([self.score[own][held], score])
        ids = np.concatenate([self.id[own][held], ids])
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        new = np.append(True, (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
        key, score, ids = key[new], score[new], ids[new]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        best = rank < self.k
        self.score[key[best], rank[best]], self.id[key[best], rank[best]] = score[best], ids[best]
        self.size[own] = np.minimum(np.diff(np.append(begins, len(key))), self.k)
        full = rank == self.k - 1
        self.least[key[full]] = score[full]

    def offer_tile(self, tile: np.ndarray, allowed: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        """Row i of the tile, where allowed, to key `keys[i]`; column j has id `ids[j]`."""
        hit = allowed & (tile >= self.least[keys][:, None])
        if tile.shape[1] > self.k and hit.sum() > 2 * self.k * len(keys):
            # most of it cannot stay: a row's own k-th best is a bound as well
            masked = np.where(hit, tile, _LOW)
            hit &= tile >= np.partition(masked, tile.shape[1] - self.k, axis=1)[:, [tile.shape[1] - self.k]]
        row, column = np.nonzero(hit)
        if len(row):
            self.offer(keys[row], tile[row, column], ids[column])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.arange(self.k) < self.size[:, None]
        return np.repeat(np.arange(len(self.size)), self.size), self.id[held], self.score[held]


@dataclass
class Anchors:
    """A block of anchors, and later their positives, best first."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    positive_id: np.ndarray | None = None  # (anchor, place)
    positive_score: np.ndarray | None = None
    known: np.ndarray | None = None  # whether there is such a positive


def _batches(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of candidates: ids, labels and integer vectors of the rows that take part."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            whole, vectors = integers(part.column("vector"), scale)
            ids, label = (part.column(c).to_numpy(zero_copy_only=False)[whole] for c in ("id", "label"))
            if len(ids):
                yield ids, label, vectors


def _offer_positives(heaps: Heaps, block: Anchors, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
    for value in np.intersect1d(label, block.label):
        a = np.flatnonzero(block.label == value)
        c = np.flatnonzero(label == value)
        for at in range(0, len(a), TILE):
            rows = a[at : at + TILE]
            tile = scores(block.vector[rows], vectors[c])
            heaps.offer_tile(tile, block.id[rows][:, None] != ids[c], rows, ids[c])


def _offer_negatives(
    heaps: Heaps, block: Anchors, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray, how: Mining
) -> None:
    for at in range(0, len(block.id), TILE):
        rows = np.arange(at, min(at + TILE, len(block.id)))
        tile = scores(block.vector[rows], vectors)
        other = (block.label[rows][:, None] != label) & (block.id[rows][:, None] != ids)
        for place in range(how.positives):
            low, high = _window(block.positive_score[rows, place], how)
            inside = other & block.known[rows, place][:, None] & (tile >= low[:, None]) & (tile <= high[:, None])
            heaps.offer_tile(tile, inside, rows * how.positives + place, ids)


def _window(score: np.ndarray, how: Mining) -> tuple[np.ndarray, np.ndarray]:
    """The scores s with low * score <= 100 s <= high * score."""
    whole, rest = np.divmod(score, 100)  # score = 100 whole + rest; no product leaves 64 bits
    return how.low * whole - (-how.low * rest) // 100, how.high * whole + how.high * rest // 100


def _best(candidates: DataFrame, block: Anchors, how: Mining, negatives: bool) -> DataFrame:
    """The best entries of all tasks' heaps: (anchor, positive) numbers in the block, place, id, score."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    width, k = (how.positives, how.negatives) if negatives else (1, how.positives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        heaps = Heaps(len(block.id) * width, k)
        for ids, label, vectors in _batches(batches, how.scale):
            if negatives:
                _offer_negatives(heaps, block, ids, label, vectors, how)
            else:
                _offer_positives(heaps, block, ids, label, vectors)
        key, ids, score = heaps.entries()
        columns = [pa.array(x, pa.int64()) for x in (key // width, key % width, ids, score)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "positive", "id", "score"])

    rows = candidates.mapInArrow(run, "anchor long, positive long, id long, score long")
    run_of = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    again = (F.lag("score").over(run_of) == F.col("score")) & (F.lag("id").over(run_of) == F.col("id"))
    once = rows.withColumn("again", again).where("again IS NOT TRUE").drop("again")
    best = once.withColumn("place", F.row_number().over(run_of)).where(F.col("place") <= k)
    out = materialise(best, "best")
    shared.destroy()
    return out


def _block(rows: pa.Table, scale: int) -> Anchors:
    rows = rows.sort_by("number").combine_chunks()
    ids, label = (rows.column(c).to_numpy() for c in ("id", "label"))
    return Anchors(ids, label, integers(rows.column("vector").combine_chunks(), scale)[1])


def _mined(candidates: DataFrame, block: Anchors, how: Mining) -> DataFrame:
    best = _best(candidates, block, how, negatives=False).toArrow()  # a few rows per anchor of the block
    at = best.column("anchor").to_numpy(), best.column("place").to_numpy() - 1
    shape = len(block.id), how.positives
    block.positive_id, block.positive_score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    block.known = np.zeros(shape, bool)
    block.positive_id[at], block.positive_score[at] = (best.column(c).to_numpy() for c in ("id", "score"))
    block.known[at] = True
    names = pa.table(
        {
            "anchor": np.repeat(np.arange(shape[0]), shape[1]), "positive": np.tile(np.arange(shape[1]), shape[0]),
            "anchor_id": np.repeat(block.id, shape[1]), "positive_id": block.positive_id.ravel(),
            "positive_score": block.positive_score.ravel(),
        }
    )
    negatives = _best(candidates, block, how, negatives=True)
    found = negatives.join(candidates.sparkSession.createDataFrame(names), ["anchor", "positive"])
    return found.select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def mine(rows: DataFrame, id: Column, label: Column, vector: Column, anchor: Column, how: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `anchor` tells the anchors."""
    spark = rows.sparkSession
    named = rows.select(
        id.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), anchor.alias("anchor")
    ).dropna(subset=["id", "label", "vector"])
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    with scratch(spark) as keep:
        chosen = named.where("anchor").where(finite).select("id", "label", "vector", F.lit(0).alias("all")).distinct()
        anchors = materialise(numbered(chosen, "all", ["id", "label", "vector"], "number"), "anchors")
        size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
        per_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, size["width"] or 1))))
        parts = []
        for begin in range(0, size["n"], per_block):
            own = anchors.where((F.col("number") >= begin) & (F.col("number") < begin + per_block))
            block = _block(own.toArrow(), how.scale)
            parts.append(materialise(_mined(named.drop("anchor"), block, how), "mined"))
        if not parts:
            return spark.createDataFrame([], SCHEMA)
        return keep(reduce(DataFrame.unionByName, parts), "negatives")
