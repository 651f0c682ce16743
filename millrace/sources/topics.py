"""Topic sources and sinks: Kafka options, and a file stream of the same shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.constants import CLIENT_MAX_BYTES, CONSUMER_TIMEOUT_MS, DEFAULT_LISTENER


def choose_topics(configured: Sequence[str], override: str | None = None) -> list[str]:
    """A single named topic replaces the configured list."""
    return [override] if override is not None else list(configured)


def choose_group(groups: Mapping[str, str], topic: str | None = None, override: str | None = None) -> str:
    """The group id named, else the one configured for the topic, else the listener's."""
    return override if override is not None else groups[topic or DEFAULT_LISTENER]


def read_options(brokers: str, topics: Sequence[str], group: str | None = None) -> dict[str, str]:
    """Options of a subscription from the earliest offset that fails on lost data."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "kafka.session.timeout.ms": str(CONSUMER_TIMEOUT_MS),
        "kafka.max.poll.interval.ms": str(CONSUMER_TIMEOUT_MS),
    }
    if group is not None:
        options["kafka.group.id"] = group
    return options


def write_options(brokers: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "kafka.max.request.size": str(CLIENT_MAX_BYTES)}


def subscribe(spark: SparkSession, brokers: str, topics: Sequence[str], group: str | None = None) -> DataFrame:
    """A stream of topic records; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**read_options(brokers, topics, group)).load()


def publish(messages: DataFrame, brokers: str) -> None:
    """Write topic, key, value rows to their topics."""
    messages.select("topic", "key", "value").write.format("kafka").options(**write_options(brokers)).save()


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    files_per_trigger: int | None = None,
    name_glob: str | None = None,
) -> DataFrame:
    """A stream of the parquet files in directory ``path``, each read once."""
    reader = spark.readStream.schema(schema)
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def subscribe_files(
    spark: SparkSession, path: str, schema: StructType | str, topics: Sequence[str], **options
) -> DataFrame:
    """The records of the given topics out of a file stream."""
    return file_stream(spark, path, schema, **options).where(F.col("topic").isin(list(topics)))
