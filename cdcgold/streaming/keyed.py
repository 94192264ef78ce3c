"""A keyed table as parquet folders: one per applied batch, the newest row of a key being current.

Plain parquet has no MERGE.  Each batch is written whole under its own id, so running a
batch again after a failure overwrites only what that batch wrote, and readers take just
the folders whose write was committed.  ``compact`` folds the batches so far into one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.operators.latest import latest

_BUCKET = "_bucket"


def _folders(spark: SparkSession, pattern: str) -> dict[int, str]:
    """Committed folders ``name=<number>`` matching the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getParent() for s in fs.globStatus(path) or []]
    return {int(p.getName().split("=")[1]): p.toString() for p in found}


class KeyedTable:
    """``by`` is the document key rows are bucketed on, so reads of some documents prune files.

    ``whole``: the rows of a key in its newest batch replace all its earlier rows (documents
    of several segments); otherwise each key has one row and ``order`` decides the newest.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        *,
        by: str,
        order: Sequence[str] = ("batch_id",),
        whole: bool = False,
        buckets: int = 64,
    ):
        if whole and list(keys) != [by]:
            raise ValueError("whole replacement is by the bucketed key")
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), list(keys), by
        self.order, self.whole, self.buckets = list(order), whole, buckets
        fields = [f for f in schema.fields if f.name not in ("batch_id", _BUCKET)]
        self.schema = T.StructType([*fields, T.StructField("batch_id", T.LongType())])

    def _bucket_of(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    def batches(self) -> list[int]:
        return sorted(_folders(self.spark, f"{self.path}/batch=*"))

    def newest(self) -> int | None:
        """Id of the newest committed batch."""
        return max([*self.batches(), *self._bases()], default=None)

    def _bases(self) -> dict[int, str]:
        return _folders(self.spark, f"{self.path}/base=*")

    def _write(self, rows: DataFrame, folder: str) -> None:
        spread = rows.withColumn(_BUCKET, self._bucket_of(self.by)).hint("rebalance", _BUCKET)
        spread.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write one batch; running the newest batch again replaces it, older ids are refused."""
        newest = self.newest()
        if newest is not None and batch_id < newest:
            raise ValueError(f"batch {batch_id} is older than {newest} in {self.path}")
        names = [f.name for f in self.schema.fields if f.name != "batch_id"]
        numbered = rows.select(*names).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        self._write(numbered, f"batch={batch_id}")

    def buckets_of(self, touched: DataFrame) -> list[int]:
        """Buckets of some document keys; at most ``buckets`` numbers reach the driver."""
        numbers = touched.select(self._bucket_of(touched.columns[0]).alias(_BUCKET)).distinct()
        return [r[0] for r in numbers.collect()]

    def rows(self, wanted: list[int] | None = None, before: int | None = None) -> DataFrame:
        """All committed rows, or only the folders of some buckets, or of earlier batches."""
        bases = {n: p for n, p in self._bases().items() if before is None or n < before}
        base = max(bases, default=None)
        later = _folders(self.spark, f"{self.path}/batch=*")
        later = {n: p for n, p in later.items() if before is None or n < before}
        parts = [] if base is None else [self._read([bases[base]], bases[base], wanted)]
        paths = [p for n, p in sorted(later.items()) if base is None or n > base]
        if paths:
            parts.append(self._read(paths, self.path, wanted))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, parts)

    def _read(self, paths: list[str], base_path: str, wanted: list[int] | None = None) -> DataFrame:
        folder = [T.StructField("batch", T.LongType()), T.StructField(_BUCKET, T.IntegerType())]
        reader = self.spark.read.option("basePath", base_path)
        df = reader.schema(T.StructType([*self.schema.fields, *folder])).parquet(*paths)
        if wanted is not None:
            df = df.where(F.col(_BUCKET).isin(wanted))
        return df.select(*self.schema.names)

    def batch(self, batch_id: int) -> DataFrame:
        return self._read([f"{self.path}/batch={batch_id}"], self.path)

    def _newest_of(self, rows: DataFrame) -> DataFrame:
        if not self.whole:
            return latest(rows, self.keys, self.order)
        version = rows.groupBy(self.by).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(version, [self.by, "batch_id"], "left_semi").select(*rows.columns)

    def current(
        self, touched: DataFrame | None = None, wanted: list[int] | None = None, before: int | None = None
    ) -> DataFrame:
        """Newest rows, of all keys or of the document keys in ``touched``.

        ``wanted`` saves asking for the buckets again when several tables share ``touched``.
        ``before`` leaves out a batch and all later ones, so that a rerun does not read its own rows.
        Restricting first is only right while every row of a key has the same document key.
        """
        if touched is None:
            return self._newest_of(self.rows(before=before))
        mine = touched.toDF(self.by)
        rows = self.rows(self.buckets_of(mine) if wanted is None else wanted, before)
        return self._newest_of(rows.join(mine, self.by, "left_semi"))

    def compact(self, needed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Fold everything committed so far into one base; the newest batch id is kept.

        ``needed`` says which of the newest rows are still needed.
        """
        newest = self.newest()
        if newest is not None and newest not in self._bases():
            rows = self._newest_of(self.rows())
            self._write(rows if needed is None else needed(rows), f"base={newest}")

    def vacuum(self, keep: int = 0) -> None:
        """Remove folders a newer base has replaced, but for those that `keep` bases before it need.

        With ``keep=1`` the newest batch can be run again, and readers of the base before go on.
        """
        bases = sorted(self._bases().items(), reverse=True)
        if len(bases) <= keep:
            return
        base = bases[keep][0]
        stale = [p for _, p in bases[keep + 1 :]]
        stale += [p for n, p in _folders(self.spark, f"{self.path}/batch=*").items() if n <= base]
        for p in stale:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_batch(df: DataFrame, path: str, batch_id: int, by: Sequence[str] = ()) -> DataFrame:
    """Append-only rows of one batch under its id; a rerun replaces them."""
    target = f"{path.rstrip('/')}/batch_id={batch_id}"
    df.write.mode("overwrite").partitionBy(*by).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    numbered = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(numbered).option("basePath", path).parquet(f"{path.rstrip('/')}/batch_id=*")
