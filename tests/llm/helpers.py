"""Plain, slow versions of what the operators compute, and small tables with every odd case."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, shard string, _row long"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = lower(text or "").encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, int]:
    """The lowest id that each id reaches, over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    lead = {i: i for i, _ in sets}

    def top(x: int) -> int:
        while lead[x] != x:
            x = lead[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                lead[y] = x
    return {i: top(i) for i, _ in sets}


def longest_repeats(w: list) -> list[int]:
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def near_copies(seed: int = 1) -> list[tuple]:
    """Documents with exact and near copies, chains, a shared passage, tiny, empty and null ones."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n: int) -> list[str]:
        return [rnd.choice(vocabulary) for _ in range(n)]

    texts: list[str | None] = [None, "", " \t\n", "a", "A", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    passage = prose(60)
    for n in (12, 40, 120, 400):
        base = prose(n)
        for _ in range(6):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + n // 30)):
                own[rnd.randrange(n)] = "x" + str(rnd.random())
            texts.append(" ".join(own))
        chain = list(base)
        for _ in range(5):  # each near the one before, not near the first
            chain = [*chain[max(1, n // 12) :], *prose(max(1, n // 12))]
            texts.append(" ".join(chain))
    texts += [" ".join(prose(rnd.randrange(5, 30)) + passage + prose(rnd.randrange(5, 30))) for _ in range(25)]
    texts += [" ".join(passage)] * 4 + [" ".join(passage).upper(), " ".join(["same"] * 500), "same " * 300]
    long = prose(12_000)
    texts += [" ".join(long), " ".join([*long[:4000], "changed", *long[4000:]])]
    rows = [(i * 3, t, "en", "s", None, "x", None, None) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def kneser_ney(rows: list[tuple[int, str | None]], held_out) -> dict[int, tuple]:
    import math

    texts = [(i, [*lower(t or "").encode().split(), "end"]) for i, t in rows]
    pairs, single = Counter(), Counter()
    for i, s in texts:
        if not held_out(i):
            pairs.update(zip(["start", *s], s, strict=False))
            single.update(s)
    n, v = sum(single.values()), len(single)
    uses, total, kinds = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (p, w), c in pairs.items():
        uses[w] += 1
        total[p] += c
        kinds[p][min(c, 3) - 1] += 1

    def discounts(values) -> list[float]:
        a, b, c, d = (sum(x == k for x in values) for k in (1, 2, 3, 4))
        if not (a and b and c):
            return [0, 0.5, 0.5, 0.5]
        y = a / (a + 2 * b)
        made = [1 - 2 * y * b / a, 2 - 3 * y * c / b, 3 - 4 * y * d / c]
        return [0] + [x if 0 < x < k else 0.5 for k, x in enumerate(made, 1)]

    high, low, m = discounts(pairs.values()), discounts(uses.values()), len(pairs)
    rest = sum(low[min(u, 3)] for u in uses.values()) / m if m else 1.0
    out = {}
    for i, s in texts:
        score = base = 0.0
        for p, w in zip(["start", *s], s, strict=False):
            q = (max(uses[w] - low[min(uses[w], 3)], 0) / m if m else 0) + rest / (v + 1)
            if total[p]:
                back = sum(high[k + 1] * kinds[p][k] for k in range(3)) / total[p]
                q = max(pairs[p, w] - high[min(pairs[p, w], 3)], 0) / total[p] + back * q
            score += math.log10(q)
            base += math.log10((single[w] + 1) / (n + v + 1))
        out[i] = (len(s), sum(single[w] > 0 for w in s), n, base, score)
    return out
