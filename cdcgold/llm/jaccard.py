"""N-gram Jaccard join with prefixes of single tokens and of token combinations.

A token is the hash of a run of words.  Tokens have one global order: rare ones first, then the
frequent ones by their count.  If two sets link, the smaller of them misses at most `slack` of
its tokens in the other, so their prefixes share a signature, provided each prefix has a weight
of slack + 1, where a rare token weighs 1, and of the frequent tokens, which are dealt to small
classes by their hash, every one but the first of its class weighs 1.  Signatures are the rare
tokens themselves and the pairs of frequent tokens within a class.  The number of classes follows
the set's size level, so classes stay small however large the set is; a set is indexed under its
own level and the one below, as linked sets are at most one level apart.

A signature's place is the weight of the prefix that it completes, less one.  Two sets of n and m
tokens must share a signature whose places are within the slack that this very pair has, so every
signature bounds the size of a partner (`reach`), and pairs beyond it are never made.

Frequent tokens are those that take a share `1 / TOP` or more of some chunk of token occurrences:
all chunks of all documents are counted, and a list of at most `TOP` tokens can result, which is
the proven bound of what is broadcast.

Equal sets are one class from the start, a node named by its digest; a task indexes the first of the
equal sets that it meets.  Signatures go through one exchange, and windows over it find those that
several nodes share.  Sets that share a signature form a bucket.  Not all its pairs are compared: first each set with the bucket's centre, which has the signature earliest, and
after the links found have been contracted to components, the pairs of sets of different components
that are left, so a group of n near copies costs about n comparisons while no link between
components is missed.

Candidates are thinned out by bit maps: a set's map has the parity of its tokens at each of about
n places, two maps differ in no more places than the sets in tokens, and so a pair whose maps
differ in too many cannot link.  What is left is verified on the whole texts.

Defined cases: null, empty and wordless texts have empty sets and link with nothing; fewer than
`SHINGLE` words are one token; rows without an id have no component; rows that share an id count
as one document, linked to whatever any of its texts links to; repeated rows count once; ties go to the
lowest id.  Texts are read in slices of bounded size and a longer text alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cdcgold.llm.components import components
from cdcgold.llm.text import U, mix, slices, windows, words
from cdcgold.session import materialise, release, scratch

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Tokens with at least this share of a chunk's occurrences are frequent.
TOP = 1 << 22
CHUNK = 1 << 22
#: Below this many occurrences no token is frequent.
LEAST = 8
LEVEL_BASE = 4 / 3
#: Average class size aimed at: frequent tokens of a prefix to a class.
CLASS_SIZE = 8


def sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    token, first = windows(words(texts), k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(token[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    """The name of a class of equal sets; should two classes share one, both are compared under it."""
    return int.from_bytes(digest[:8], "little", signed=True)


def bit_map(own: np.ndarray) -> bytes:
    """Parities of a set's tokens at 2^k places, as many as the set has tokens or a bit more."""
    places = max(8, 1 << (len(own) - 1).bit_length()) if len(own) else 8
    count = np.bincount((mix(own) & U(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(count & 1).tobytes()


def may_link(bits_a: bytes, bits_b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    """Whether set sizes and maps leave room for a link."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    a, b = (np.frombuffer(x, np.uint8) for x in (bits_a, bits_b))
    size = min(len(a), len(b))
    # the lower part of a place is its place in a smaller map
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    differ = int(np.bitwise_count(a ^ b).sum())
    common = (n_a + n_b - differ) // 2
    return 100 * common >= percent * (n_a + n_b - common)


def _counted(chunk: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are frequent in a chunk, and how often they occur there."""
    token = np.sort(np.concatenate(chunk)) if chunk else np.zeros(0, U)
    edge = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(token)))
    often = times >= max(2, -(-len(token) // TOP))
    return token[edge[often]].view(np.int64), times[often]


_FACTS = "doc_id {id}, n long, digest binary, node long, bits binary, token array<long>, times array<long>"


def _facts(docs: DataFrame, text: str, k: int) -> DataFrame:
    """One row a document: set size and digest; one row a chunk: its frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, kind = [], 0, None

        def counts() -> pa.RecordBatch:
            token, times = _counted(chunk)
            one = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (token, times)]
            none = [pa.nulls(1, t) for t in (pa.binary(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([size], pa.int64()), *none, *one], names)

        names = ["doc_id", "n", "digest", "node", "bits", "token", "times"]
        for part in slices(batches, text):
            own, kind = sets(part.column(text), k), part.column("doc_id").type
            digest = [_digest(x) for x in own]
            blank = pa.nulls(len(own), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in own], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(map(_node, digest), pa.int64()),
                    pa.array(map(bit_map, own), pa.binary()),
                    blank,
                    blank,
                ],
                names,
            )
            chunk += own
            size += sum(map(len, own))
            if size >= CHUNK:
                yield counts()
                chunk, size = [], 0
        if size:
            yield counts()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, _FACTS.format(id=kind))


def frequent(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens in the order of their hashes, and each one's place by count."""
    chunks = facts.filter("token is not null")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    counts = chunks.select(F.explode(F.arrays_zip("token", "times")).alias("x")).select("x.*")
    counts = counts.groupBy("token").agg(F.sum("times").alias("times"))
    # counts add up to the total at most, so no more than TOP tokens pass
    rows = counts.filter(F.col("times") >= max(LEAST, -(-total // TOP))).toArrow()
    token = rows["token"].to_numpy().astype(np.int64).view(U)
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, rows["times"].to_numpy()))] = np.arange(len(token))
    by = np.argsort(token)
    return token[by], place[by]


def level(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(LEVEL_BASE) + 1e-9))


def signatures(
    own: np.ndarray, top: np.ndarray, place: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set of two tokens or more, and their places.

    Smaller sets link with equal ones only.
    """
    n = len(own)
    need = n + percent * n // -100 + 1  # slack + 1
    at = np.minimum(np.searchsorted(top, own), len(top) - 1) if len(top) else None
    often = top[at] == own if at is not None else np.zeros(n, bool)
    rare = own[~often][:need]
    if len(rare) == need:
        return rare, np.arange(need)
    tokens = own[often][np.argsort(place[at[often]])]
    out, places = [rare], [np.arange(len(rare))]
    for lvl in (level(n), level(n) - 1):
        classes = U(max(1, int(LEVEL_BASE**lvl / CLASS_SIZE)))
        deal = mix(tokens ^ U(lvl + 1)) % classes
        by = np.argsort(deal, kind="stable")
        again = np.zeros(len(tokens), bool)
        again[by[1:]] = deal[by[1:]] == deal[by[:-1]]
        weight = len(rare) + np.cumsum(again)
        by = by[by <= int(np.searchsorted(weight, need))]
        deal, prefix, weight = deal[by], tokens[by], weight[by]
        step = 1
        while step < len(by) and (same := deal[step:] == deal[:-step]).any():
            a, b = prefix[:-step][same], prefix[step:][same]
            out.append(mix(mix(np.minimum(a, b) + U(lvl + 2)) + np.maximum(a, b)))
            places.append(weight[step:][same] - 1)  # the later token of a pair completes it
            step += 1
    return np.concatenate(out), np.concatenate(places)


def _index(docs: DataFrame, text: str, k: int, percent: int, top: Broadcast) -> DataFrame:
    """The node, set size, signatures and their places of the sets of two tokens or more.

    Of equal sets in a task's part of the rows only the first is indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, text):
            own = {}
            for s in sets(part.column(text), k):
                if len(s) > 1 and (digest := _digest(s)) not in seen:
                    seen.add(digest)
                    own[digest] = s
            if not own:
                continue
            made = [signatures(s, *top.value, percent) for s in own.values()]
            first = pa.array(np.concatenate([[0], np.cumsum([len(s) for s, _ in made])]), pa.int32())
            sig = np.concatenate([s for s, _ in made]).view(np.int64)
            place = np.concatenate([p for _, p in made]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (sig, place)]
            node = pa.array(map(_node, own), pa.int64())
            n = pa.array(map(len, own.values()), pa.int32())
            yield pa.RecordBatch.from_arrays([node, n, *lists], ["node", "n", "sig", "place"])

    return docs.select(text).mapInArrow(run, "node long, n int, sig array<long>, place array<int>")


def _members(index: DataFrame, percent: int) -> DataFrame:
    """The members of buckets of several nodes: (sig, node, n, reach), the bucket's count `m` and centre.

    The centre has the signature earliest, for its size; ties are settled by the node.
    """
    bucket = Window.partitionBy("sig")
    rows = index.select("node", "n", F.explode(F.arrays_zip("sig", "place")).alias("x")).select("x.sig", "node", "n", "x.place")
    rows = rows.select("*", F.min("node").over(bucket).alias("low"), F.max("node").over(bucket).alias("high"))
    # equal sets out of several tasks; the exchange above serves this and the next window too
    rows = rows.filter("low <> high").groupBy("sig", "node", "n").agg(F.min("place").alias("place"))
    reach = F.floor((F.col("n") - F.col("place")) * ((100 + percent) / percent) + 1e-6).cast("int") - F.col("n")
    rank = F.floor(F.col("place").cast("long") * (1 << 20) / F.col("n"))
    rows = rows.withColumn("reach", reach).select(
        "sig",
        "node",
        "n",
        "reach",
        F.count(F.lit(1)).over(bucket).alias("m"),
        F.min("n").over(bucket).alias("least"),
        F.min(F.struct(rank.alias("rank"), "node", "n", "reach")).over(bucket).alias("centre"),
    )
    centre = [F.col(f"centre.{c}").alias(f"centre_{c}") for c in ("node", "n", "reach")]
    return rows.filter("reach >= least").select("sig", "node", "n", "reach", "m", *centre)


#: Places of the table that tells which documents are needed.
WANTED = 1 << 22


def _wanted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of documents in pairs, and some others, without a shuffle of all texts.

    Ids are hashed to `WANTED` places, so what is broadcast has that many rows at most; where
    nearly all places are taken, nearly all rows pass, and the joins that follow decide.
    """
    ids = pairs.select(F.col("doc_a").alias("id")).union(pairs.select("doc_b")).distinct()
    places = materialise(ids.select(F.pmod(F.xxhash64("id"), F.lit(WANTED)).cast("int").alias("_place")).distinct(), "wanted")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(WANTED)).cast("int")
    return texts.withColumn("_place", place).join(F.broadcast(places), "_place", "left_semi").drop("_place")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """The pairs whose texts link, compared on the whole sets."""
    texts = _wanted(docs.select(F.col("doc_id"), F.col(text).alias("text")), pairs)
    both = pairs.join(texts.toDF("doc_b", "text_b"), "doc_b").join(texts.toDF("doc_a", "text_a"), "doc_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, U))
        for part in slices(batches, "text_b"):
            a = part.column("text_a")
            keep = np.zeros(part.num_rows, bool)
            for i, mine in enumerate(sets(part.column("text_b"), k)):
                if (text_a := a[i].as_py()) != last[0]:
                    last = (text_a, sets(a.slice(i, 1), k)[0])
                other = last[1]
                small, large = sorted((len(mine), len(other)))
                if small and 100 * small >= percent * large:
                    common = small + large - len(np.unique(np.concatenate([mine, other])))
                    keep[i] = 100 * common >= percent * (small + large - common)
            yield part.select(pairs_of).filter(pa.array(keep))

    pairs_of = pairs.columns
    return both.select(*pairs_of, "text_a", "text_b").mapInArrow(run, pairs.schema)


def _in_components(df: DataFrame, column: str, found: DataFrame, to: str) -> DataFrame:
    """A column's component, itself where it has no link."""
    other = found.select(F.col("node").alias(column), F.col("component").alias(to))
    return df.join(other, column, "left").withColumn(to, F.coalesce(to, column))


def _left_over(members: DataFrame, tried: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of one bucket and of different components that have not been compared yet.

    Only in buckets with three sets or more can there be such pairs, if they have more than one
    component.
    """
    rows = members.filter("m > 2").select("sig", F.col("node").alias("doc"), "n", "reach")
    bucket = Window.partitionBy("sig")
    rows = _in_components(rows, "doc", found, "comp")
    rows = rows.select("*", F.min("comp").over(bucket).alias("a"), F.max("comp").over(bucket).alias("b"))
    rows = rows.filter("a <> b").select("sig", "doc", "comp", "n", "reach")
    rows = materialise(rows, "buckets")
    kinds = rows.groupBy("sig", "comp").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    kinds = (
        kinds.toDF("sig", "comp_a", "n_a", "reach_a")
        .join(kinds.toDF("sig", "comp_b", "n_b", "reach_b"), "sig")
        .filter(f"comp_a < comp_b and {_IN_REACH}")
    )
    # a set goes on only if some set of the other component is within reach
    pairs = (
        kinds.select("sig", "comp_a", "comp_b", "n_b", "reach_b")
        .join(rows.toDF("sig", "a", "comp_a", "n_a", "reach_a"), ["sig", "comp_a"])
        .filter(_IN_REACH)
        .drop("n_b", "reach_b")
        .join(rows.toDF("sig", "b", "comp_b", "n_b", "reach_b"), ["sig", "comp_b"])
        .filter(_IN_REACH)
    )
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


#: Both sizes are within what the shared signature allows.
_IN_REACH = "n_a <= reach_b and n_b <= reach_a"


def link_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        return keep(_linked(docs, k, percent), "groups")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    facts = materialise(_facts(docs, "text", k), "shingle-facts")
    top = docs.sparkSession.sparkContext.broadcast(frequent(facts))

    rows = facts.filter("token is null").select("doc_id", "n", "digest", "node", "bits")
    linked = rows.filter("doc_id is not null and n > 0")
    classes = linked.groupBy("digest").agg(
        F.min("doc_id").alias("doc"),
        F.max("doc_id").alias("last"),
        *(F.first(c).alias(c) for c in ("node", "n", "bits")),
    )
    classes = materialise(classes, "classes")
    sizes = classes.filter("n > 1").select("node", "doc", "n", "bits")

    index = _index(docs.filter("doc_id is not null"), "text", k, percent, top)
    members = materialise(_members(index, percent), "members")
    release(docs.sparkSession)

    first = members.filter("node <> centre_node and n <= centre_reach and centre_n <= reach")
    ends = [F.least("node", "centre_node").alias("a"), F.greatest("node", "centre_node").alias("b")]
    first = materialise(first.select(*ends).distinct(), "candidates")
    near = materialise(_near(first, sizes, percent), "near")
    links = materialise(_verified(near, docs, "text", k, percent), "verified")
    found = materialise(components(links, "a", "b"), "components")

    rest = materialise(_near(_left_over(members, first, found), sizes, percent), "left-over")
    links = links.union(_verified(rest, docs, "text", k, percent)).select("doc_a", "doc_b")
    # a written table has a known size, and nothing stands between the rows' exchange and the join: a large group splits
    copied = materialise(classes.filter("doc <> last").select("digest", F.col("doc").alias("doc_a")), "copied")
    copies = linked.select("digest", F.col("doc_id").alias("doc_b")).join(copied, "digest").filter("doc_a <> doc_b")
    found = components(links.union(copies.select("doc_a", "doc_b")), "doc_a", "doc_b")
    out = _in_components(rows.select("doc_id", F.col("n").alias("n_shingles")), "doc_id", found, "component_id")
    return out.select("doc_id", "n_shingles", "component_id")


def _near(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes whose set sizes and bit maps allow a link, and a document of either."""
    both = pairs.join(sizes.toDF("a", "doc_a", "n_a", "bits_a"), "a").join(sizes.toDF("b", "doc_b", "n_b", "bits_b"), "b")
    both = both.filter(f"doc_a <> doc_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    names, ends = ["bits_a", "bits_b", "n_a", "n_b"], ["a", "b", "doc_a", "doc_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in names], strict=True)
            keep = pa.array([may_link(*row, percent) for row in rows], pa.bool_())
            yield batch.select(ends).filter(keep)

    return both.select(*ends, *names).mapInArrow(run, both.select(*ends).schema)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the lowest document of each group, with all their columns.

    Rows of that document with the same text are one, its other texts stay; rows without an id all stay.
    """
    stay = link_groups(docs, text, doc_id).filter("doc_id = component_id").select("doc_id").distinct()
    stay = stay.withColumnRenamed("doc_id", doc_id)
    kept = docs.join(stay, doc_id, "left_semi").dropDuplicates([doc_id, text])
    return kept.select(*docs.columns).union(docs.filter(F.col(doc_id).isNull()))
