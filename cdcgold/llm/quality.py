"""Quality rules from the repeated substrings of each text, found in a suffix array of its words.

All texts of a slice share one suffix array: a word's first rank also tells its text apart, so no
repeat crosses texts.  Ranks are refined by doubling, and only where suffixes still tie.  The
longest common prefixes of neighbours give, for every word, the longest repeated substring that
begins there; intervals of neighbours that share `min_repeat` words or more are the maximal
repeats, and the union of their occurrences is the covered part of the text.

Null and empty texts have no words: they fail the base rule.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cdcgold.llm.arrow import add_columns, keep_rows
from cdcgold.llm.text import U, Words, mix, words

#: The characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rules:
    """Limits; a repeat has at least `min_repeat` words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 10
    #: words covered by repeats: as many are one short line said twice; beyond, their share of the text counts
    max_covered: int = 30
    #: well below the base rule's share, since words covered are also words of repeated runs of three
    max_covered_percent: int = 20
    max_longest: int = 100
    #: a longest repeat beyond the limit counts only in a text of which it is this share
    max_longest_percent: int = 5


@dataclass
class Suffixes:
    order: np.ndarray  # positions in the order of their suffixes
    shared: np.ndarray  # words shared by neighbours t and t + 1 of the order
    longest: np.ndarray  # by position: longest repeated substring beginning there


def suffixes(w: Words) -> Suffixes:
    n, owner = len(w.hash), w.owner()
    if n == 0:
        return Suffixes(*(np.zeros(0, np.int64),) * 3)
    stop = w.first[1:][owner]
    key = mix(w.hash + mix(owner.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    edge = np.append(True, key[order][1:] != key[order][:-1])
    levels, h = [], 1
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    while True:
        levels.append(rank)
        open_ = np.flatnonzero(~(edge & np.append(edge[1:], True)))
        if not len(open_):
            break
        at = order[open_]
        then = at + h
        nxt = np.where(then < stop[at], rank[np.minimum(then, n - 1)].astype(np.int64) + 1, 0)
        pair = rank[at].astype(np.int64) * (n + 1) + nxt
        by = np.argsort(pair, kind="stable")
        order[open_], pair = at[by], pair[by]
        # a gap between open places also begins a new group
        edge[open_] = np.append(True, (pair[1:] != pair[:-1]) | (np.diff(open_) > 1))
        rank = rank.copy()
        starts = np.flatnonzero(edge)
        rank[order[open_]] = starts[np.searchsorted(starts, open_, "right") - 1]
        h *= 2
    i, j = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        step = same.astype(np.int64) << k
        shared, i, j = shared + step, i + step, j + step
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(np.append(0, shared), np.append(shared, 0))
    return Suffixes(order, shared, longest)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def facts(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    w = words(texts, lower=False)
    s = suffixes(w)
    n, first, count = len(w.hash), w.first, w.counts()
    three = np.flatnonzero(s.longest >= 3)
    long = np.flatnonzero(s.longest >= rules.min_repeat)
    in_repeat = covered(long, s.longest[long], n)
    begins = in_repeat & ~np.append(False, in_repeat[:-1])[:n]
    begins[first[:-1][count > 0]] = in_repeat[first[:-1][count > 0]]
    longest = np.zeros(len(count), np.int64)
    np.maximum.at(longest, w.owner(), s.longest)
    deep = s.shared >= rules.min_repeat
    opens = np.flatnonzero(deep & ~np.append(False, deep[:-1])[: len(deep)])
    intervals = np.bincount(w.owner()[s.order[opens]], minlength=len(count)) if n else np.zeros(len(count), np.int64)
    points = (w.data & 0xC0) != 0x80
    space = (w.data == 0x20) | ((w.data >= 0x09) & (w.data <= 0x0D))
    body, lo = w.data.tobytes(), w.offset
    out = {
        "n_words": count,
        "word_chars": _sums(points & ~space, lo),
        "n_symbols": _sums(SYMBOLS[w.data], lo),
        "n_dup_lines": np.array([_dup_lines(body[a:b]) for a, b in zip(lo[:-1], lo[1:], strict=True)], np.int64),
        "n_repeat_words": _sums(covered(three, np.full(len(three), 3), n), first),
        "covered_words": _sums(in_repeat, first),
        "covered_spans": _sums(begins, first),
        "repeat_intervals": intervals,
        "longest_repeat": longest,
    }
    out = {k: v.astype(np.int64) for k, v in out.items()}
    words_, repeat = out["n_words"], out["n_repeat_words"]
    out["base_failed"] = (words_ < rules.min_words) | (100 * repeat > rules.max_repeat_percent * words_)
    cover = out["covered_words"]
    repetitive = ((cover > rules.max_covered) & (100 * cover > rules.max_covered_percent * words_)) | (
        (longest > rules.max_longest) & (100 * longest > rules.max_longest_percent * words_)
    )
    out["kept"] = ~out["base_failed"] & ~repetitive
    return out


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long,"
    " covered_spans long, repeat_intervals long, longest_repeat long, base_failed boolean, kept boolean"
)


def judge(df: DataFrame, keep: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The columns `keep`, the facts of each text and the verdict `kept`."""
    return add_columns(
        df.select(*keep, text),
        lambda b: {k: pa.array(v) for k, v in facts(b.column(text), rules).items()},
        SCHEMA,
        text,
        keep,
    )


def filter_rows(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    return keep_rows(df, lambda b: pa.array(facts(b.column(text), rules)["kept"]), text)
