"""Change logs: several topics as one table of records, in batch or as a stream.

Every form has the columns topic, partition, offset, key, value, timestamp.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
)


def kafka_options(brokers: str, topics: Sequence[str], *, per_trigger: int | None = None) -> dict:
    """Read from the earliest record; a stream continues from its checkpoint."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def _records(df: DataFrame) -> DataFrame:
    return df.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "timestamp",
    )


def stream_kafka(spark: SparkSession, brokers: str, topics: Sequence[str], **kw) -> DataFrame:
    reader = spark.readStream.format("kafka").options(**kafka_options(brokers, topics, **kw))
    return _records(reader.load())


def read_kafka(spark: SparkSession, brokers: str, topics: Sequence[str]) -> DataFrame:
    return _records(spark.read.format("kafka").options(**kafka_options(brokers, topics)).load())


def stream_files(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of record files, each file read once as it appears."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).parquet(path)


def once(records: DataFrame, within: str) -> DataFrame:
    """A stream of records without those delivered again, remembering coordinates for a bounded time.

    ``within`` bounds both how late a record may come and how long after a record its repeats are
    told: repeats within it are dropped by their coordinates, later ones are behind the watermark
    and dropped as late.  Records more than ``within`` behind the newest timestamp seen in earlier
    batches are dropped too, so it must exceed the disorder of the topic; a null timestamp is
    never late, and its repeats are told while the state lasts.
    """
    marked = records.withWatermark("timestamp", within)
    return marked.dropDuplicatesWithinWatermark(["topic", "partition", "offset"])


def publish_kafka(docs: DataFrame, brokers: str, topic: str) -> None:
    """Write (key, value) rows to a topic."""
    writer = docs.write.format("kafka").option("kafka.bootstrap.servers", brokers)
    writer.option("topic", topic).save()
