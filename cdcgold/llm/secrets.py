"""Secrets in texts: known forms, and strings too random to be words.

The known forms are three patterns (`BASE`).  Beyond them, a candidate string is a run of the
characters of a class (hexadecimal digits, capitals and digits, base64 characters), and a window slides over it.  The
window's Shannon entropy follows from the sum of c log2 c over the counts c of its characters: a
step takes one character out of its count and one into another, and changes the sum by table
entries.  The sums are whole numbers, so they do not depend on where a walk began, and long runs
are walked in pieces side by side.  Windows at or over the class's entropy that hold a character
of each kind the class wants are united to spans.

A span inside a match of an allow-list pattern (digests, embedded data, alphabets, examples, file
paths) is suppressed, and so is one inside a span of a known form, which says it already.  Known
forms always stay.  A known form's span is its whole match; positions are code points, the end
exclusive.

Null and empty texts have no spans.  Texts are read whole: time grows with their length, memory
with the longest text of a task.  Equal spans do not occur twice, repeated rows are scanned one
by one, an empty table gives no rows, and columns are taken by name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cdcgold.llm.arrow import add_columns
from cdcgold.llm.text import raw

# The known forms, with the group and the least length that it must have.
BASE = {
    "assign": (rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (rb"AKIA[A-Z0-9]+", 0, 16),
    "hex": (rb"[0-9a-f]+", 0, 32),
}
#: A text without any of these (in small letters) has no assignment.
_WORDS = (b"passw", b"secret", b"token", b"api")
_ASSIGN, _ACCESS = re.compile(BASE["assign"][0]), re.compile(BASE["access"][0])

#: Spans inside matches of these are no secrets; a match begins at a fixed word, so the search is linear.
ALLOW = (
    r"(?i)\bsha-?(1|224|256|384|512)[-:=]\s?[A-Za-z0-9+/=]+",  # digests are public
    r"(?i)\b(commit|md5|digest|checksum|etag)\b[\"':=\s]{1,4}[0-9a-f]+",
    r"(?i);base64,[A-Za-z0-9+/=]+",  # embedded files
)
#: Spans within NEAR bytes of a match of this are no secrets: examples, alphabets, counting.
ALLOW_NEAR = r"(?i)example|placeholder|changeme|your[_-]?key|abcdefgh|0123456789|123456789a"
NEAR = 16
#: Bytes before a candidate that an allow-list pattern may begin in.
BEFORE = 64
#: A candidate of three or more parts between slashes, each this short, is a path.
PATH_PART = 15
#: Windows of a run that are walked in one go; longer runs are cut.
PIECE = 256
_SCALE = 1 << 20


@dataclass(frozen=True)
class CharClass:
    """`symbols`: strings whose i-th characters count as one symbol; `wants`: one of each in a window."""

    name: str
    symbols: tuple[str, ...]
    window: int
    bits: float
    wants: tuple[str, ...]

    def codes(self) -> np.ndarray:
        out = np.full(256, -1, np.int64)
        for line in self.symbols:
            out[np.frombuffer(line.encode(), np.uint8)] = np.arange(len(line))
        return out

    def kinds(self) -> np.ndarray:
        """By byte: which of `wants` it is, and one more for none."""
        out = np.full(256, len(self.wants), np.int64)
        for i, line in enumerate(self.wants):
            out[np.frombuffer(line.encode(), np.uint8)] = i
        return out


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("entropy_hex", (_DIGITS + "abcdef", _DIGITS + "ABCDEF"), 20, 2.9, (_DIGITS, "abcdefABCDEF")),
    CharClass("entropy_base32", (_UPPER + _DIGITS,), 20, 3.75, (_UPPER, _DIGITS)),
    CharClass("entropy_base64", (_UPPER + _LOWER + _DIGITS + "+/_-=",), 24, 3.9, (_UPPER, _LOWER, _DIGITS)),
)


def runs(data: np.ndarray, offset: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes that `inside` has, of `least` bytes, within one text."""
    mask = inside[data]
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    cut = offset[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[mask[cut] & mask[cut - 1]]) if len(cut) else cut
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    long = end - start >= least
    return start[long], end[long]


def random_spans(data: np.ndarray, offset: np.ndarray, kind: CharClass) -> list[tuple[int, int, int, int]]:
    """Unions of the windows whose entropy reaches the class's, and the runs they are in, as byte positions."""
    code, sort, width = kind.codes(), kind.kinds(), kind.window
    start, end = runs(data, offset, code >= 0, width)
    if not len(start):
        return []
    windows = end - start - width + 1
    pieces = -(-windows // PIECE)
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + at * PIECE
    n = np.minimum(np.repeat(windows, pieces) - at * PIECE, PIECE)
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]

    symbols, sorts = int(code.max()) + 1, len(kind.wants) + 1
    table = np.array([0] + [round(c * math.log2(c) * _SCALE) for c in range(1, width + 1)], np.int64)
    limit = math.floor(width * (math.log2(width) - kind.bits) * _SCALE)
    first = data[begin[:, None] + np.arange(width)]
    line = np.arange(len(begin))
    counts = np.bincount((line[:, None] * symbols + code[first]).ravel(), minlength=len(begin) * symbols)
    counts = counts.reshape(len(begin), symbols)
    wanted = np.bincount((line[:, None] * sorts + sort[first]).ravel(), minlength=len(begin) * sorts)
    wanted = wanted.reshape(len(begin), sorts)
    total = table[counts].sum(axis=1)
    hits = []
    for step in range(int(n[0])):
        live = int(np.searchsorted(-n, -step, "left"))  # pieces with more than `step` windows come first
        own = line[:live]
        if step:
            gone, come = data[begin[:live] + step - 1], data[begin[:live] + step + width - 1]
            for byte, by in ((gone, -1), (come, 1)):
                now = counts[own, code[byte]]
                total[:live] += table[now + by] - table[now]
                counts[own, code[byte]] = now + by
                wanted[own, sort[byte]] += by
        good = (total[:live] <= limit) & (wanted[:live, :-1] > 0).all(axis=1)
        hits.append(begin[:live][good] + step)
    hit = np.sort(np.concatenate(hits))
    if not len(hit):
        return []
    run = np.searchsorted(start, hit, "right")  # runs of neighbouring texts may touch
    head = np.append(True, (hit[1:] > hit[:-1] + width) | (run[1:] != run[:-1]))
    tail = np.append(head[1:], True)
    own = run[head] - 1
    return list(zip(*(x.tolist() for x in (hit[head], hit[tail] + width, start[own], end[own])), strict=True))


def base_spans(text: bytes, hexes: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the known forms, given those of the runs of hexadecimal digits."""
    out = list(hexes)
    small = text.lower()
    if any(w in small for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m.group(2)) >= BASE["assign"][2]:
                out.append(("assign", *m.span()))
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m.group()) >= BASE["access"][2]]
    return out


class AllowList:
    """What the patterns cover in the candidates of one text; each candidate is searched once."""

    def __init__(self, patterns: Iterable[str], near: str):
        self.patterns, self.near = [re.compile(p.encode()) for p in patterns], re.compile(near.encode())

    def ranges(self, text: bytes, begin: int, stop: int) -> list[tuple[int, int]]:
        shift = max(0, begin - BEFORE)
        around = text[shift:stop]
        out = [(m.start() + shift, m.end() + shift) for p in self.patterns for m in p.finditer(around)]
        parts = text[begin:stop].split(b"/")
        if len(parts) > 2 and max(map(len, parts)) <= PATH_PART:
            out.append((begin, stop))
        return out

    def passes(self, text: bytes, spans: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int]]:
        """The spans (kind, begin, end, their candidate's begin, end) that no pattern covers."""
        known: dict[tuple[int, int], list[tuple[int, int]]] = {}
        out = []
        for kind, a, b, begin, stop in spans:
            if (begin, stop) not in known:
                known[begin, stop] = self.ranges(text, begin, stop)
            covered = any(x <= a and b <= y for x, y in known[begin, stop])
            if not covered and not self.near.search(text[max(begin, a - NEAR) : min(stop, b + NEAR)]):
                out.append((kind, a, b))
        return out


def _outside(spans: list[tuple], base: list[tuple[str, int, int]]) -> list[tuple]:
    """The spans that lie in no span of a known form."""
    begins = sorted((a, b) for _, a, b in base)
    reach = list(accumulate((b for _, b in begins), max))
    known = [a for a, _ in begins]
    return [s for s in spans if not (n := bisect_right(known, s[1])) or reach[n - 1] < s[2]]


def _in_order(spans: Iterable[tuple[str, int, int]], kinds: list[str]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def scan(
    rows: DataFrame,
    text: str = "text",
    keep: Iterable[str] = ("doc_id",),
    classes: tuple[CharClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
    near: str = ALLOW_NEAR,
) -> DataFrame:
    """The columns `keep` with n_assign, n_access, n_hex, base_sha256 and spans."""
    kinds = [*BASE, *(c.name for c in classes)]
    hexadecimal = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))

    def of(part: pa.RecordBatch) -> dict[str, pa.Array]:
        listed = AllowList(allow, near)
        data, offset = raw(part.column(text))

        def dealt(spans: list[tuple]) -> list[list[tuple]]:
            """By text: the kind and the positions, from the text's begin."""
            out: list[list[tuple]] = [[] for _ in range(part.num_rows)]
            owner = np.searchsorted(offset, [s[1] for s in spans], "right") - 1
            for i, (kind, *places) in zip(owner.tolist(), spans, strict=True):
                out[i].append((kind, *(p - int(offset[i]) for p in places)))
            return out

        start, end = runs(data, offset, hexadecimal, BASE["hex"][2])
        hexes = dealt([("hex", a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        random = dealt([(c.name, *s) for c in classes for s in random_spans(data, offset, c)])
        counts, digests, joined = [], [], []
        for i in range(part.num_rows):
            body = data[offset[i] : offset[i + 1]]
            own = body.tobytes()
            base = base_spans(own, hexes[i])
            more = listed.passes(own, _outside(random[i], base))
            if base or more:
                place = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                base, more = ([(k, int(place[a]), int(place[b])) for k, a, b in s] for s in (base, more))
            counts.append([sum(k == name for k, _, _ in base) for name in BASE])
            digests.append(hashlib.sha256(_in_order(base, kinds).encode()).hexdigest())
            joined.append(_in_order(base + more, kinds))
        numbers = np.array(counts, np.int64).reshape(-1, len(BASE))
        made = {f"n_{name}": pa.array(numbers[:, j], pa.int64()) for j, name in enumerate(BASE)}
        return made | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(joined, pa.string())}

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    keep = list(keep)
    return add_columns(rows.select(*keep, text), of, schema, text, keep)
