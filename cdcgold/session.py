"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_BASE: dict[str, str] = {}
# Folders of the scratch blocks that are open, innermost last.
_SCRATCH: list[list[str]] = []


def session(app: str = "cdcgold", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; the cluster's own values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the cluster's shared checkpoint folder.

    All folders of one application are below one, to be removed when it has ended.
    Only a local master, where driver and tasks share one disk, may fall back to a
    temporary folder.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        if app not in _LOCAL_BASE:
            _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="cdcgold-")
        base = _LOCAL_BASE[app]
    path = f"{base.rstrip('/')}/cdcgold-{app}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a written table.

    The copy survives lost executors, and its file size tells the planner truthfully
    whether a join with it may be a broadcast.
    """
    return materialise_counted(df, name)[0]


def materialise_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``materialise``, and the number of rows, counted while they are written."""
    path, rows = workspace(df.sparkSession, name), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows.get["n"]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of DataFrames that nothing refers to any more.

    It does so whenever the driver's garbage is collected, which may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose folders are removed at its end.

    It gives a function that writes a table which outlives the block, for its result: a
    result that still reads a removed folder would fail.
    """
    own: list[str] = []
    _SCRATCH.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        _SCRATCH.remove(own)
        try:
            return materialise(df, name)
        finally:
            _SCRATCH.append(own)

    try:
        yield keep
    finally:
        _SCRATCH.remove(own)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        release(spark)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
