"""Mixing sources to target weights: raking of token counts, then calibrated sampling.

Tokens are counted by source, language and topic.  Iterative proportional fitting scales the cells
of this table, one margin after the other, until source, language and topic each have their target
share of the tokens.  A document's probability is min(1, c * factor of its cell), with c solved so
that the expected share of tokens kept is `keep`; its weight factor / probability makes weighted
totals of the sample meet the targets also where a cell would need more than all its documents.
Rows without a weight meet them only as far as cells do not need more than they have: `miss` bounds
how much of the sample may be missing from such cells, and less than `keep` is kept where need be.

The topic is the form of the text (`topic_of`).  A target is either shares by value, where
values not named keep the share they have, or an exponent that draws the natural shares together.

Defined cases: a null source or language is a value of its own; empty texts count one token, so
that they have a probability.  The draw depends on id and text, so equal rows share their fate and
a row without an id has its own.  No input rows give no output rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcgold.llm.arrow import add_columns
from cdcgold.llm.text import LOWER, NOT_SPACE, raw
from cdcgold.session import materialise, materialise_counted, release

Target = float | Mapping[str, float]
SOURCE, LANGUAGE, TOPIC = "_source", "_lang", "topic"
TARGETS: dict[str, Target] = {SOURCE: 0.7, LANGUAGE: 0.8, TOPIC: 0.9}
KEEP = 0.9
#: For samples without weights: each source, language and topic has its share but for this much.
MISS = 0.005
SWEEPS = 60
CLOSE = 1e-6
POINTS = 32

_BYTES = np.arange(256)
_KINDS = {
    "upper": LOWER != _BYTES,
    "digit": (_BYTES >= 0x30) & (_BYTES <= 0x39),
    "bar": _BYTES == ord("|"),
    "mark": np.isin(_BYTES, np.frombuffer(b"#*$%&<>{}=;", np.uint8)),
    "line": _BYTES == 0x0A,
}


def measure(texts: pa.Array) -> dict[str, pa.Array]:
    """Number of words (1 at least), topic and checksum of each text."""
    data, offset = raw(texts)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offset[1:]] - total[offset[:-1]]

    inside = NOT_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offset[(offset > 0) & (offset < len(data))]
    starts[edge] = inside[edge]
    size = np.maximum(count(inside), 1)
    share = {k: count(v[data]) / size for k, v in _KINDS.items()}
    topic = np.select(
        [share["bar"] > 0.03, share["mark"] > 0.05, share["upper"] > 0.5, share["digit"] > 0.1, share["line"] > 0.03],
        ["table", "symbols", "capitals", "figures", "lines"],
        "prose",
    )
    body = memoryview(np.ascontiguousarray(data))
    mark = [zlib.crc32(body[a:b]) for a, b in zip(offset[:-1], offset[1:], strict=True)]
    return {
        "_tokens": pa.array(np.maximum(count(starts), 1)),
        TOPIC: pa.array(topic.astype(object), pa.string()),
        "_mark": pa.array(mark, pa.int64()),
    }


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def measured(docs: DataFrame, keep: list[str], text: str, source: str, lang: str) -> DataFrame:
    out = docs.select(*keep, F.col(text).alias("_text"), _named(source).alias(SOURCE), _named(lang).alias(LANGUAGE))
    kept = [*keep, SOURCE, LANGUAGE]
    return add_columns(
        out, lambda b: measure(b.column("_text")), f"_tokens long, {TOPIC} string, _mark long", "_text", kept
    )


def _shares(cells: DataFrame, column: str, target: Target) -> DataFrame:
    """(value, share): the target share of each value that occurs, adding up to 1."""
    natural = cells.groupBy(column).agg(F.sum("tokens").alias("n"))
    want = F.pow("n", F.lit(float(target))) if not isinstance(target, Mapping) else F.lit(None).cast("double")
    if isinstance(target, Mapping):
        for k, v in target.items():
            want = F.when(F.col(column) == (f"={k}" if column != TOPIC else k), F.lit(float(v))).otherwise(want)
        total = cells.agg(F.sum("tokens")).first()[0] or 1
        want = F.coalesce(want, F.col("n") / F.lit(float(total)))
    wanted = natural.select(column, want.alias("want"))
    whole = wanted.agg(F.sum("want")).first()[0] or 1.0
    return wanted.select(column, (F.col("want") / F.lit(float(whole))).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, Target], sweeps: int = SWEEPS) -> DataFrame:
    """Cells with `fitted` tokens whose margins have the target shares of all tokens.

    Where the targets contradict one another, the last sweep's table is returned; then the first
    margin is met only as far as that allows.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("fitted", F.col("tokens").cast("double"))
    out = state.columns
    # the shares go along with the cells: a margin then needs one broadcast a sweep, not two
    shares = {c: f"_share{i}" for i, c in enumerate(targets)}
    for c, name in shares.items():
        state = state.join(_shares(cells, c, targets[c]).withColumnRenamed("share", name), c)
    state = materialise(state, "shares")
    for _ in range(sweeps):
        before = state.columns
        state = state.withColumn("moved", F.lit(0.0))
        for c, name in shares.items():
            factor = (F.max(name) * F.lit(float(total)) / F.sum("fitted")).alias("factor")
            state = state.join(state.groupBy(c).agg(factor), c).withColumn("fitted", F.col("fitted") * F.col("factor"))
            state = state.withColumn("moved", F.greatest("moved", F.abs(F.col("factor") - 1))).drop("factor")
        state = materialise(state, "raked")
        worst = state.agg(F.max("moved")).first()[0]
        state = state.select(*before)
        # a broadcast table takes a page of each executor's memory until the driver drops it
        release(cells.sparkSession)
        if worst is None or worst < CLOSE:
            break
    state = state.select(*out)
    return state.withColumn("factor", F.col("fitted") / F.col("tokens"))


def calibrate(cells: DataFrame, keep: float) -> float:
    """c with the sum of tokens * min(1, c * factor) the share `keep` of all tokens.

    The sum is evaluated at many c in one pass over the cells, then within the step found.
    """
    total, least = cells.agg(F.sum("tokens"), F.min("factor")).first()
    if not total:
        return 1.0
    lo, hi = keep, max(keep, 1.0 / least)
    for _ in range(4):
        points = np.geomspace(lo, hi, POINTS).tolist()
        sums = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * c)) for c in points]).first()
        over = next((i for i, s in enumerate(sums) if s >= keep * total), POINTS - 1)
        lo, hi = points[max(over - 1, 0)], points[over]
    return hi


def reachable(cells: DataFrame, most: float, miss: float) -> float:
    """The largest c, `most` at most, where cells that need more than they have lack `miss` of the sample."""
    total, largest = cells.agg(F.sum("tokens"), F.max("factor")).first()
    if not total or most * largest <= 1.0:
        return most
    lo, hi = 1.0 / largest, most
    for _ in range(4):
        points = np.geomspace(lo, hi, POINTS).tolist()
        lacks = [F.sum(F.col("tokens") * F.greatest(F.lit(0.0), F.col("factor") * c - 1)) for c in points]
        over = next((i for i, x in enumerate(cells.agg(*lacks).first()) if x > miss * points[i] * total), None)
        if over is None:
            return hi
        lo, hi = points[max(over - 1, 0)], points[over]
    return lo


def probabilities(
    sized: DataFrame, targets: Mapping[str, Target], keep: float, miss: float | None = None
) -> DataFrame:
    """(source, language, topic, probability, weight) of every cell of measured documents."""
    cells, n = materialise_counted(
        sized.groupBy(*targets).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "cells"
    )
    fitted = materialise(rake(cells, targets), "fitted")
    c = calibrate(fitted, keep) if n else 1.0
    c = reachable(fitted, c, miss) if n and miss is not None else c
    p = F.least(F.lit(1.0), F.col("factor") * c)
    return materialise(fitted.select(*targets, p.alias("probability"), (F.col("factor") / p).alias("weight")), "mix")


def _draw(doc_id: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.col("_mark"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def sample(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
    targets: Mapping[str, Target] | None = None, keep: float = KEEP, seed: int = 7,
) -> DataFrame:
    """One row a sampled document: its cell, tokens, probability and weight."""
    targets = targets or TARGETS
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(lang).alias("lang")
    )
    sized = materialise(measured(own, ["doc_id", "source", "lang"], "text", "source", "lang"), "measured")
    out = sized.join(probabilities(sized, targets, keep), list(targets))
    out = out.filter(_draw("doc_id", seed) < F.col("probability"))
    return out.select("doc_id", "source", "lang", TOPIC, F.col("_tokens").alias("n_tokens"), "probability", "weight")


def sample_rows(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
    targets: Mapping[str, Target] | None = None, keep: float = KEEP, seed: int = 7,
    miss: float | None = None,
) -> DataFrame:
    """The sampled documents with all their columns; without weights, so give `miss` to meet the targets."""
    targets = targets or TARGETS
    mix = probabilities(measured(docs, [], text, source, lang), targets, keep, miss)
    whole = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    whole = whole.select("_row", F.col(f"_row.`{doc_id}`").alias("_id"), text, source, lang).toDF(
        "_row", "_id", "_t", "_s", "_l"
    )
    sized = measured(whole, ["_row", "_id"], "_t", "_s", "_l")
    kept = sized.join(mix, list(targets)).filter(_draw("_id", seed) < F.col("probability"))
    return kept.select("_row.*")
