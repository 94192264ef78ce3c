"""Balanced label propagation: linked documents move towards their neighbours' shards.

Links are given by hubs: documents of one hub are linked to each other, so a hub of n documents is
n rows and not n * n links.  Hubs are equal texts, or whatever the caller names, such as the sentences
that several texts share; a document may have any number of them.  Every round counts each hub's documents by
shard, sums the counts of a document's hubs to votes, and lets documents move to the shard with
most votes, as many from a to b as from b to a, and more as far as b has room; where more want to
move than may, those with most to gain go first, by a table of demand by gain.  In every other round
full shards are no aim, so that their would-be members gather where there is room.  Documents without links fill the shards up.

The law is `rows`: counts of any two shards differ by one at most.  A hub larger than a shard is
spread over shards, as it must be.

Defined cases: a null text has size 1 and no links; an empty text is a text, so empty ones are equal
texts, and has no sentences; equal texts are linked also if a row is repeated; a null id is an id like
any other.  Texts are only split and hashed, so long ones need no more than themselves.  Ties fall by
hashes of rows and hubs.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcgold.llm.ranks import numbered
from cdcgold.session import materialise, materialise_counted

ROUNDS = 12
#: Propagation ends when less than this share of the linked documents moves.
STILL = 0.001


def _unit(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _argmax(votes: list[Column], node: Column) -> Column:
    """The shard with most votes; ties fall by a hash, so that they do not crowd the first shards."""
    best = F.lit(None)
    for k, v in enumerate(votes):
        this = F.struct(v.alias("v"), F.xxhash64(node, F.lit(k)).alias("h"), F.lit(k).alias("k"))
        best = this if k == 0 else F.greatest(best, this)
    return best["k"]


def propagate(members: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, hub, shard) for every node of `members` (node, hub); hub is the node's lowest hub.

    No shard is meant to hold more than `room` of these nodes.
    """
    nodes = members.groupBy("node").agg(F.min("hub").alias("hub"))
    start = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(shards)).cast("int")
    labels, n = materialise_counted(nodes.select("node", "hub", start.alias("shard")), "labels")
    if not n:
        return labels
    each, quiet = range(shards), 0
    for turn in range(rounds):
        load = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}  # a row a shard
        free = {k: room - load.get(k, 0) for k in each}
        counts = (
            members.join(labels.select("node", "shard"), "node")
            .groupBy("hub")
            .agg(*[F.count(F.when(F.col("shard") == k, 1)).alias(f"c{k}") for k in each])
        )
        votes = members.join(counts, "hub").groupBy("node").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in each])
        here = labels.join(votes, "node")
        # a shard that a hub fills alone takes no more of it, so the next best is sought
        closed = [k for k in each if turn % 2 and free[k] <= 0]
        open_ = [
            F.when(
                ((F.col(f"c{k}") < 0.98 * room) & F.lit(k not in closed)) | (F.col("shard") == k), F.col(f"c{k}")
            ).otherwise(-1)
            for k in each
        ]
        own = F.element_at(F.array(*[F.col(f"c{k}") for k in each]), F.col("shard") + 1)
        here = here.withColumn("to", _argmax(open_, F.col("hub")))
        gain = F.element_at(F.array(*[F.col(f"c{k}") for k in each]), F.col("to") + 1) - own + 1
        step = F.floor(F.log2(F.greatest(gain, F.lit(1)))).cast("int")
        wish = (F.col("to") != F.col("shard")) & (gain > 0)
        here = materialise(
            here.select("node", "hub", "shard", "to", step.alias("step"), wish.alias("wish")), "wishes"
        )
        demand = here.filter("wish").groupBy("shard", "to", "step").count().collect()  # some forty rows a pair of shards
        part, moved = _quotas(demand, free)
        quiet = quiet + 1 if moved < STILL * n else 0
        if quiet == 2:
            break
        if not part:
            continue
        share = F.create_map(*[x for (a, b, s), p in part.items() for x in (F.lit((a * shards + b) * 64 + s), F.lit(p))])
        wanted = (F.col("shard") * shards + F.col("to")) * 64 + F.col("step")
        chance = F.coalesce(F.try_element_at(share, wanted), F.lit(0.0))
        # a hub moves as one, but for hubs that take a good part of a shard
        big = F.pow(F.lit(2.0), F.col("step")) > room / 100
        coin = F.when(big, _unit(F.col("node"), F.lit(turn))).otherwise(_unit(F.col("hub"), F.lit(turn)))
        go = F.col("wish") & (coin < chance)
        labels, _ = materialise_counted(
            here.select("node", "hub", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels"
        )
    return labels


def _quotas(demand: list, free: dict[int, int]) -> tuple[dict[tuple[int, int, int], float], float]:
    """By from, to and step of gain: the share of those who wish so that may move; and their number.

    As many move from a to b as from b to a, and more as far as b has room.
    """
    wish: dict[tuple[int, int], int] = {}
    for r in demand:
        wish[r["shard"], r["to"]] = wish.get((r["shard"], r["to"]), 0) + r["count"]
    quota = {(a, b): float(min(n, wish.get((b, a), 0))) for (a, b), n in wish.items()}
    for to in free:
        rest = {ab: n - quota[ab] for ab, n in wish.items() if ab[1] == to}
        if free[to] > 0 and sum(rest.values()):
            for ab, n in rest.items():
                quota[ab] += n * min(1.0, free[to] / sum(rest.values()))
    part, moved = {}, sum(quota.values())
    for r in sorted(demand, key=lambda r: -r["step"]):
        ab = r["shard"], r["to"]
        take = min(float(r["count"]), quota[ab])
        quota[ab] -= take
        part[*ab, r["step"]] = take / r["count"]
    return part, moved


#: Shorter sentences are phrases that link nothing.
SENTENCE = 8


def sentences(text: str = "text", least: int = SENTENCE) -> Column:
    """Hubs for `assign`: the digests of a text's sentences and lines of `least` words or more."""
    parts = F.transform(F.split(F.lower(F.col(text)), r"[\n.!?]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(F.filter(parts, lambda x: F.size(F.split(x, " ")) >= least), lambda x: F.xxhash64(x))


def _equal_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, hub) of texts that occur again, and (hub, n) of those hubs."""
    # the three digests together tell texts apart
    key = ["hub", "text_crc32", "size"]
    shared = rows.filter("hub is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    members = rows.join(shared.filter("n > 1"), key).select("node", F.col("first").alias("hub"))
    return members, shared.select(F.col("first").alias("hub"), "n")


def _given(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of the hubs that the caller named."""
    every = rows.select("node", F.explode(F.array_distinct("hubs")).alias("hub")).filter("hub is not null")
    shared = materialise(every.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shard-hubs")
    return every.join(shared.select("hub"), "hub").select("node", "hub"), shared


def assign(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = 8, hubs: Column | None = None
) -> DataFrame:
    """Every document's shard and its slot there, counted from 0 without gaps.

    `hubs` is a list of longs for every row, the hubs that link it; without, equal texts are linked.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.xxhash64(body)).alias("hub"),
        F.monotonically_increasing_id().alias("node"),
        *([] if hubs is None else [hubs.alias("hubs")]),
    )
    rows, n = materialise_counted(rows, "shard-rows")
    members, shared = _equal_texts(rows) if hubs is None else _given(rows)
    rows, members = rows.drop("hubs"), materialise(members, "shard-members")
    labels = propagate(members, shards, n // shards)

    quota = [n // shards + (k < n % shards) for k in range(shards)]
    # what is beyond a shard's quota is taken from its largest hubs
    sized = labels.join(shared, "hub")
    placed = materialise(numbered(sized, "shard", ["n", "hub", "node"], "slot"), "placed")
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    placed = placed.filter(F.col("slot") < limit).select("node", "shard", "slot")
    has = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}  # a row a shard

    rest = rows.join(placed, "node", "left_anti").select("node", F.lit(0).alias("pool"))
    rest = numbered(rest, "pool", ["node"], "at")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for k in range(shards):
        inside = (F.col("at") >= begin) & (F.col("at") < begin + quota[k] - has.get(k, 0))
        shard = F.when(inside, F.lit(k)).otherwise(shard)
        slot = F.when(inside, F.col("at") - begin + has.get(k, 0)).otherwise(slot)
        begin += quota[k] - has.get(k, 0)
    where = placed.union(rest.select("node", shard.alias("shard"), slot.alias("slot")))
    return rows.join(where, "node").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
