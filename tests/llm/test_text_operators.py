"""Jaccard join, quality rules, decontamination and scoring against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOC_SCHEMA, groups, kneser_ney, longest_repeats, lower, near_copies, shingles

from cdcgold.llm import decontaminate, jaccard, kneser_ney as lm, quality, text


def test_words_of_odd_texts():
    texts = ["Ab c\tab  D", None, "", " x ", "éa\x0bÉ é", "\u00a0 \u2003", "q" * 300 + " " + "q" * 301]
    w = text.words(pa.array(texts))
    for i, t in enumerate(texts):
        own = [w.bytes_of(k) for k in range(w.first[i], w.first[i + 1])]
        assert own == (t or "").encode().split()
    seen = {}
    for k, h in enumerate(w.hash.tolist()):
        assert seen.setdefault(w.bytes_of(k).lower(), h) == h
    assert len(set(w.hash.tolist())) == len(seen)


@pytest.mark.parametrize("top,least", [(1 << 20, 8), (1 << 20, 2), (64, 3)])
def test_groups_match_all_pairs(spark, monkeypatch, top, least):
    monkeypatch.setattr(jaccard, "TOP", top)
    monkeypatch.setattr(jaccard, "LEAST", least)
    rows = near_copies()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    want = groups([r[:2] for r in rows])
    got = {r["doc_id"]: r for r in jaccard.link_groups(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert (got[i]["component_id"], got[i]["n_shingles"]) == (want[i], len(shingles(t)))


def test_linked_sets_share_a_signature_and_pass_the_bit_maps():
    rng = np.random.default_rng(1)
    for _ in range(800):
        n, change = int(rng.integers(2, 400)), rng.random() * 0.4
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        more = rng.integers(0, 2**63, int(n * change * rng.random())).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > change], more]))
        common = len(np.intersect1d(a, b))
        if len(b) < 2 or len(a) < 2 or 100 * common < 75 * (len(a) + len(b) - common):
            continue
        assert jaccard.may_link(jaccard.bit_map(a), jaccard.bit_map(b), len(a), len(b), 75)
        every = np.unique(np.concatenate([a, b]))
        top = np.sort(rng.choice(every, int(len(every) * rng.random()), replace=False))
        place = rng.permutation(len(top))
        (sa, pa_), (sb, pb) = (jaccard.signatures(x, top, place) for x in (a, b))
        slack = [len(x) - -(-75 * (len(a) + len(b)) // 175) for x in (a, b)]
        assert len(np.intersect1d(sa[pa_ <= slack[0]], sb[pb <= slack[1]]))


def test_one_of_each_keeps_lowest_and_rows_without_id(spark):
    rows = [(4, "a b c d e f", "en", "s", 1, "l", "k", 0), (2, "A b c d e f", "en", "s", 1, "l", "k", 0)]
    rows += [rows[1], (None, "a b c d e f", None, None, None, None, None, None), (9, None, None, None, None, None, None, None)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, DOC_SCHEMA))
    assert kept.columns == [c.split()[0] for c in DOC_SCHEMA.split(", ")]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, None, 9])
    none = jaccard.link_groups(spark.createDataFrame([], DOC_SCHEMA))
    assert none.columns == ["doc_id", "n_shingles", "component_id"] and none.count() == 0


def test_an_id_with_several_texts_links_through_each_of_them(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, "a text of its own that is linked with nothing")]
    docs = spark.createDataFrame(rows + rows[2:3], "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.link_groups(docs).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 3, (3, 1): 1, (4, 4): 1})
    assert [r["doc_id"] for r in jaccard.one_of_each(docs).orderBy("doc_id").collect()] == [1, 4]


def test_equal_sets_of_one_task_are_indexed_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string").coalesce(1)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    index = jaccard._index(docs, "text", 5, 75, spark.sparkContext.broadcast(none))
    assert index.count() == 1
    assert jaccard._members(index, 75).count() == 0


def _repeats(t: str | None) -> dict:
    t = t or ""
    w = t.encode().split()
    threes = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + d for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return {
        "n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
    }


def test_quality_facts_match_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "x", "a b a b a b", "a " * 70, "é # é\n\n \n# é\né # é", "a\x0bb\x0cc\rd\u00a0e"]
    texts += [" ".join(rnd.choice("abc") for _ in range(n)) for n in (30, 70, 120)]
    texts += [" ".join(rnd.choice("abcdefghijkl") for _ in range(60)) for _ in range(5)]
    unique = " ".join(f"w{i}" for i in range(200))
    texts += [unique, unique + "\n" + unique, unique + " " + " ".join(f"w{i}" for i in range(120))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rules = quality.Rules()
    for r in quality.judge(docs, ["doc_id"]).collect():
        t = texts[r["doc_id"]]
        want = _repeats(t)
        assert {k: r[k] for k in want} == want
        longest = longest_repeats((t or "").encode().split())
        covered = {i + d for i, n in enumerate(longest) if n >= rules.min_repeat for d in range(n)}
        assert (r["longest_repeat"], r["covered_words"]) == (max(longest, default=0), len(covered))
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        bad = 100 * len(covered) > 50 * want["n_words"] or (
            max(longest, default=0) > rules.max_longest and 100 * max(longest) > 15 * want["n_words"]
        )
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not bad)


def _said_twice(n: int, repeats: list[int]) -> str:
    """n words, all different but for repeats of the given lengths, each there twice."""
    fresh = (f"w{i}" for i in range(n))
    parts = [[next(fresh) for _ in range(k)] for k in repeats]
    rest = [next(fresh) for _ in range(n - 2 * sum(repeats))]
    gap = len(rest) // (2 * len(parts) + 1)
    out = []
    for i, part in enumerate(parts + parts):
        out += rest[i * gap : (i + 1) * gap] + part
    return " ".join(out + rest[2 * len(parts) * gap :])


def test_each_quality_rule_rejects_alone():
    texts = [_said_twice(500, [20] * 4), _said_twice(400, [50]), _said_twice(4000, [250])]
    texts += [_said_twice(80, [13]), _said_twice(500, [20, 20]), _said_twice(4000, [150])]
    f = quality.facts(pa.array(texts), quality.Rules())
    assert f["covered_words"].tolist() == [160, 100, 500, 26, 80, 300]
    assert f["longest_repeat"].tolist() == [20, 50, 250, 13, 20, 150]
    assert not f["base_failed"].any()
    # covered share, covered share, longest repeat; a doubled line, little repeated, a passage in a long text
    assert f["kept"].tolist() == [False, False, False, True, True, True]


def test_quality_keeps_all_columns_of_kept_rows(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, t, "en", "s", 5, "l", "k", i) for i, t in enumerate([good, None, "short", good])]
    kept = quality.filter_rows(spark.createDataFrame(rows, DOC_SCHEMA))
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]
    assert quality.filter_rows(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hits(doc: str | None, items: list[tuple]) -> tuple:
    w, hit, named = _WORD.findall(lower(doc or "")), set(), set()
    for k, t in items:
        q = _WORD.findall(lower(t or ""))
        for x in [q] if 0 < len(q) < 10 else [q[i : i + 10] for i in range(len(q) - 9)]:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    named |= {str(k)} if k is not None else set()
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(w), len(hit), len(named), digest, bool(hit)


@pytest.mark.parametrize("letters,limit", [("ab", 1 << 22), ("abcdefgh", 1 << 22), ("abcdefgh", 40)])
def test_decontamination_matches_brute_force(spark, letters, limit):
    rnd = random.Random(len(letters) + limit)
    items = [(k, " ".join(rnd.choice(letters) for _ in range(n))) for k, n in enumerate((0, 1, 3, 9, 10, 11, 15, 30, 30))]
    items += [(None, "one null id here to be found in ten words"), (12, None), (8, "Second text of an ID, with punctuation; é")]
    texts = [" ".join(rnd.choice(letters + "z") for _ in range(n)) for n in (0, 1, 9, 40, 80, 200)]
    texts += [f"z q, {t} - {t[6:]}" for _, t in items if t] + [t.upper() for _, t in items if t] + [None, "", " , "]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(decontaminate.locate(docs, tests, ["doc_id"], limit=limit), "doc_id")
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    want = {i: _hits(t, items) for i, t in enumerate(texts)}
    assert got == want
    left = decontaminate.remove(docs, tests, limit=limit)
    assert {r["doc_id"] for r in left.collect()} == {i for i, x in want.items() if not x[-1]}


def test_decontamination_of_and_by_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    tests = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.report(decontaminate.locate(docs, tests, ["doc_id"]), "doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in rows] == [(2, 0, False), (0, 0, False)]
    assert decontaminate.remove(docs.limit(0), tests).count() == 0


def test_longest_matches_of_a_shard():
    tests = decontaminate.Tests.of([1], ["a b c d e f"])
    w = text.words(pa.array(["x b c d y", "e f", None, "b c z"]), text.ALNUM)
    length, place = decontaminate.Shard(w, tests).longest()
    assert length.tolist() == [0, 3, 2, 1, 2, 1]
    assert place[1] == 1


def test_kneser_ney_matches_plain_sums(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("the of and A b c d e f g h".split()) for _ in range(rnd.randrange(40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "rare Words é only"), (103, "the " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = kneser_ney(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    got = {r["doc_id"]: r for r in lm.held_out_scores(docs).collect()}
    assert got.keys() == want.keys()
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_kneser_ney_shards_do_not_matter(spark, monkeypatch):
    rows = [(i, f"a b c w{i % 7} w{i} end of w{i % 3}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = {r[0]: r["score"] for r in lm.held_out_scores(docs).collect()}
    monkeypatch.setattr(lm, "SHARD", 20)
    many = {r[0]: r["score"] for r in lm.held_out_scores(docs).collect()}
    assert one == pytest.approx(many)
    assert lm.held_out_scores(docs.limit(0)).count() == 0
    probabilities = lm.train(docs).log10(np.zeros(1, np.uint64), np.ones(1, np.uint64))[0]
    assert -3 < probabilities[0] < 0


def test_a_model_without_one_of_its_arrays_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c a b", None, "s", None, "", "", 0)], DOC_SCHEMA)
    model = lm.train(docs, folder=str(tmp_path / "m"))
    assert lm.score(docs, model, ["doc_id"]).count() == 1
    for name in ("words-0.total", "pairs-0.n"):
        (tmp_path / "m" / f"{name}.npy").rename(tmp_path / "away")
        with pytest.raises(Exception, match="is not there"):
            lm.score(docs, model, ["doc_id"]).collect()
        (tmp_path / "away").rename(tmp_path / "m" / f"{name}.npy")
