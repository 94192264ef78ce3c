"""Do builds of the same documents by different paths agree?  Digests first, rows only where needed.

Each side is a table of facts (``checks.facts`` of documents, or ``relational_facts`` of rows that
were never folded).  Facts are dealt to buckets by their document's key; a bucket's digest counts
them and adds and xors two independent hashes, so it depends neither on order nor on partitions,
and combines before the shuffle.  Only facts of buckets whose digests differ are compared one by one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcgold.operators.checks import _pairs
from cdcgold.session import materialise
from cdcgold.spec import ProfileSpec

BUCKETS = 4096
FACT = ("key", "child", "child_key", "field")


def relational_facts(spec: ProfileSpec, tables: Mapping[str, DataFrame], root_fields: list[str]) -> DataFrame:
    """The facts that documents should hold, from current rows by plain joins; no document is built.

    A child's key is its first key column, as in the elements' facts.
    """
    root = tables[spec.root].where(F.col(spec.key).isNotNull())
    key = F.col(spec.key).cast("string").alias("key")
    parts = [root.select(key, F.inline(_pairs("", F.lit(""), {f: F.col(f) for f in root_fields})))]
    for c in spec.children:
        rows = tables[c.table].join(root.select(F.col(spec.key).alias(c.fk)), c.fk, "left_semi")
        own = {n: F.col(f) for f, n in c.pairs(rows.columns) if f != c.pk[0]}
        pk = F.col(c.pk[0]).cast("string")
        parts.append(rows.select(F.col(c.fk).cast("string").alias("key"), F.inline(_pairs(c.array, pk, own))))
    return reduce(DataFrame.unionByName, parts)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def digests(facts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, total, mixed): the multiset of each bucket's facts as three numbers."""
    # a null value leaves a hash as it was, so nulls are told apart by a flag
    parts = [*FACT, F.col("value").isNull(), "value"]
    a, b = F.xxhash64(F.lit("a"), *parts), F.xxhash64(F.lit("b"), *parts)
    return facts.groupBy(_bucket(buckets)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(38,0)")).alias("total"), F.bit_xor(b).alias("mixed")
    )


class Parity:
    """Two or more named sides, digested once."""

    def __init__(self, sides: Mapping[str, DataFrame], buckets: int = BUCKETS):
        self.sides, self.buckets = dict(sides), buckets
        named = [digests(facts, buckets).withColumn("side", F.lit(s)) for s, facts in self.sides.items()]
        #: at most ``buckets`` rows a side
        self.digests = materialise(reduce(DataFrame.unionByName, named), "digests")

    def differing_buckets(self) -> DataFrame:
        """Buckets that not all sides have alike."""
        kinds = F.count_distinct("n", "total", "mixed") > 1
        return self.digests.groupBy("bucket").agg((kinds | (F.count(F.lit(1)) < len(self.sides))).alias("d")).where("d")

    def differences(self) -> DataFrame:
        """Facts on which the sides disagree: each side's value, and how often it has the fact (n_<side>)."""
        buckets = materialise(self.differing_buckets().select("bucket"), "differing")
        rows = [
            facts.withColumn("bucket", _bucket(self.buckets)).join(buckets, "bucket", "left_semi")
            .select(*FACT, F.struct("value").alias("v"), F.lit(s).alias("side"))
            for s, facts in self.sides.items()
        ]
        own = {s: F.when(F.col("side") == s, F.col("v")) for s in self.sides}
        found = reduce(DataFrame.unionByName, rows).groupBy(*FACT).agg(
            *(F.max(v).alias(s) for s, v in own.items()),
            *(F.min(v).alias(f"_min_{s}") for s, v in own.items()),
            *(F.count(v).alias(f"n_{s}") for s, v in own.items()),
        )
        first, *rest = self.sides
        same = [F.col(first).eqNullSafe(F.col(s)) & F.col(f"_min_{first}").eqNullSafe(F.col(f"_min_{s}"))
                & (F.col(f"n_{first}") == F.col(f"n_{s}")) for s in rest]
        return found.where(~reduce(Column.__and__, same)).select(
            *FACT, *(F.col(s)["value"].alias(s) for s in self.sides), *(f"n_{s}" for s in self.sides)
        )

    def summary(self) -> DataFrame:
        """Per side its number of facts, and of its buckets that not all sides have alike."""
        apart = self.digests.join(self.differing_buckets(), "bucket", "left")
        return apart.groupBy("side").agg(
            F.sum("n").alias("n_facts"), F.count_if("d").alias("n_buckets_differing")
        )
