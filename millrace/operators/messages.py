"""Topic messages: decode, fan out, guard, route, deliver and summarise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.constants import CLIENT_MAX_BYTES, DEFAULT_REPLAY_TOPIC, MONITOR_MAX_BYTES
from millrace.functions.jsons import canonical_json, canonical_or_raw, pretty_json
from millrace.sources.files import read_named


@dataclass(frozen=True)
class Topic:
    """One configured topic."""

    name: str
    num_partitions: int = 1
    other_channels: int = 0
    replication_factor: int = 1
    verbose: bool = False
    config: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Group:
    """One configured consumer group and the topics it works with."""

    name: str
    subscribe: Sequence[str]
    publish: Sequence[str] = ()


TOPIC_SCHEMA = (
    "topic string, num_partitions int, other_channels int, replication_factor int,"
    " verbose boolean, config map<string,string>"
)


def config_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a local relation, whose size the optimiser knows.

    So a join with it is broadcast while it is small, and only then.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in col], f.type) for col, f in zip(columns, kind)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kind))


def topics_frame(spark: SparkSession, topics: Sequence[Topic]) -> DataFrame:
    """Configured topics as rows."""
    rows = [
        (t.name, t.num_partitions, t.other_channels, t.replication_factor, t.verbose, dict(t.config))
        for t in topics
    ]
    return config_frame(spark, rows, TOPIC_SCHEMA)


def groups_frame(spark: SparkSession, groups: Sequence[Group]) -> DataFrame:
    rows = [(g.name, list(g.publish), list(g.subscribe)) for g in groups]
    return config_frame(spark, rows, "group string, publish array<string>, subscribe array<string>")


def decode_record(records: DataFrame) -> DataFrame:
    """Key and value bytes as UTF-8 text, with where the record stands. NULL stays NULL."""
    return records.select(
        "topic",
        "partition",
        "offset",
        F.decode("key", "UTF-8").alias("key"),
        F.decode("value", "UTF-8").alias("value"),
    )


def fan_out(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Every message to every topic, as sink columns.

    The topic names are configuration, so they travel as one literal array and
    each row repeats itself inside its task: nothing is joined or shuffled.
    """
    names = F.array(*[F.lit(t) for t in topics]) if topics else F.array().cast("array<string>")
    return messages.select(
        F.explode(names).alias("topic"),
        F.encode(F.col("key").cast("string"), "UTF-8").alias("key"),
        F.encode(F.col("value").cast("string"), "UTF-8").alias("value"),
    )


def publish_all(messages: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """``fan_out`` to each topic of the catalog."""
    return fan_out(messages, [t.name for t in topics])


def publish_json(documents: DataFrame, key: str, body: str, topic: str) -> DataFrame:
    """One message per well-formed JSON document, its text written anew.

    A malformed document sends nothing: a NULL value would delete its key. ``rejected_json`` names it.
    """
    return _parsed(documents, key, body).where("value IS NOT NULL").select(F.lit(topic).alias("topic"), "key", "value")


def rejected_json(documents: DataFrame, key: str, body: str, topic: str) -> DataFrame:
    """Key and text of each document that ``publish_json`` does not send."""
    bad = _parsed(documents, key, body).where("value IS NULL")
    return bad.select(F.lit(topic).alias("topic"), "key", "body", F.when(F.col("body").isNull(), "missing").otherwise("malformed").alias("error"))


def _parsed(documents: DataFrame, key: str, body: str) -> DataFrame:
    return documents.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body"), canonical_json(F.col(body)).alias("value"))


def replay_documents(
    ids: DataFrame,
    documents: DataFrame,
    root: str,
    topic: str | None = None,
) -> DataFrame:
    """A message per id whose file ``<root><id>.json`` is there and well formed.

    ``status`` is sent, missing or malformed; only sent rows carry a value.
    """
    wanted = ids.withColumn("path", F.concat(F.lit(root), F.col("id"), F.lit(".json")))
    found = wanted.join(documents, "path", "left")
    value = canonical_json(F.col("body"))
    return found.select(
        F.col("id").alias("key"),
        F.lit(topic or DEFAULT_REPLAY_TOPIC).alias("topic"),
        value.alias("value"),
        F.when(F.col("body").isNull(), "missing")
        .when(value.isNull(), "malformed")
        .otherwise("sent")
        .alias("status"),
    )


def replay_files(ids: DataFrame, root: str, topic: str | None = None) -> DataFrame:
    """As ``replay_documents``, with the files opened by their names: nothing is listed, and no table of bodies is needed.

    ``status`` is sent, missing, malformed, or unreadable.
    """
    wanted = ids.withColumn("path", F.concat(F.lit(root), F.col("id").cast("string"), F.lit(".json")))
    found = wanted.join(read_named(wanted), "path", "left")
    value = canonical_json(F.col("body"))
    return found.select(
        F.col("id").cast("string").alias("key"), F.lit(topic or DEFAULT_REPLAY_TOPIC).alias("topic"), value.alias("value"),
        F.when(F.col("error").isNotNull(), "unreadable").when(F.col("body").isNull(), "missing").when(value.isNull(), "malformed").otherwise("sent").alias("status"),
    )


def size_guard(messages: DataFrame, topics: DataFrame, client_limit: int = CLIENT_MAX_BYTES) -> DataFrame:
    """Accept a message if key and value fit the client's and its topic's byte limit."""
    limits = topics.select(
        "topic", F.try_element_at("config", F.lit("max_message_bytes")).cast("long").alias("topic_limit")
    )
    size = F.octet_length(F.coalesce(F.col("key"), F.lit(""))) + F.octet_length(
        F.coalesce(F.col("value"), F.lit(""))
    )
    limit = F.least(F.lit(client_limit).cast("long"), F.coalesce("topic_limit", F.lit(client_limit)))
    return (
        messages.join(limits, "topic", "left")
        .withColumn("n_bytes", size.cast("long"))
        .withColumn("max_bytes", limit)
        .withColumn("accepted", F.col("n_bytes") <= F.col("max_bytes"))
        .drop("topic_limit")
    )


def delivery_report(guarded: DataFrame) -> DataFrame:
    """Delivered and failed messages per topic, with the reason of a failure."""
    error = F.when(~F.col("accepted"), F.lit("message too large"))
    return (
        guarded.groupBy("topic", "accepted", error.alias("error"))
        .agg(F.count(F.lit(1)).alias("n_messages"), F.sum("n_bytes").alias("n_bytes"))
        .select(
            "topic",
            F.when(F.col("accepted"), "delivered").otherwise("failed").alias("status"),
            "error",
            "n_messages",
            "n_bytes",
        )
    )


def observe_delivery(guarded: DataFrame, observation) -> DataFrame:
    """Count deliveries while a sink writes, without a second pass over the rows."""
    return guarded.observe(
        observation,
        F.count_if("accepted").alias("delivered"),
        F.count_if(~F.col("accepted")).alias("failed"),
        F.sum(F.when(F.col("accepted"), F.col("n_bytes"))).alias("bytes_delivered"),
    )


def topic_catalog(topics: DataFrame) -> DataFrame:
    """Partitions to create per topic, and its configuration with dotted names."""
    return topics.select(
        "topic",
        (F.col("num_partitions") + F.coalesce("other_channels", F.lit(0))).alias("partitions"),
        "replication_factor",
        F.transform_keys("config", lambda k, v: F.replace(k, F.lit("_"), F.lit("."))).alias("config"),
    )


def route_by_verbosity(records: DataFrame, topics: DataFrame, indent: bool = False) -> DataFrame:
    """Header for each record, and its body where the topic is verbose.

    A topic without configuration counts as not verbose. The body is canonical
    JSON, or indented if asked for, or the raw value if it is not JSON.
    """
    flags = topics.select("topic", "verbose")
    body = pretty_json(F.col("value")) if indent else canonical_or_raw(F.col("value"))
    header = F.concat(
        F.lit("topic: "), F.col("topic"),
        F.lit(", partition: "), F.col("partition"),
        F.lit(", offset: "), F.col("offset"),
        F.lit(", key: "), F.coalesce("key", F.lit("")),
    )
    verbose = F.coalesce("verbose", F.lit(False))
    return records.join(flags, "topic", "left").select(
        "topic",
        "partition",
        "offset",
        header.alias("header"),
        F.when(verbose, body).alias("body"),
    )


def deliver_to_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Each record once per group that subscribes to its topic."""
    edges = groups.select("group", F.explode("subscribe").alias("topic")).distinct()
    return records.join(edges, "topic")


def topic_summary(records: DataFrame) -> DataFrame:
    """First and last offset and the number of records per topic partition."""
    return records.groupBy("topic", "partition").agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.count(F.lit(1)).alias("n_records"),
    )


def last_message(records: DataFrame, by: Sequence[str] = ("topic", "partition")) -> DataFrame:
    """The newest record of each topic partition, or of what else ``by`` names."""
    rest = [c for c in records.columns if c not in (*by, "offset")]
    return records.groupBy(*by).agg(
        F.max("offset").alias("offset"), *[F.max_by(c, "offset").alias(c) for c in rest]
    )


def drop_topics(records: DataFrame, deleted: Sequence[str]) -> DataFrame:
    """Records that remain once topics are deleted."""
    topic: Column = F.col("topic")
    return records.where(~topic.isin(list(deleted))) if deleted else records


def indented_values(records: DataFrame) -> DataFrame:
    return records.withColumn("value", pretty_json(F.col("value")))


__all__ = [
    "MONITOR_MAX_BYTES", "Group", "Topic", "decode_record", "deliver_to_groups", "delivery_report",
    "drop_topics", "fan_out", "groups_frame", "indented_values", "last_message", "observe_delivery",
    "publish_all", "publish_json", "rejected_json", "replay_documents", "route_by_verbosity", "size_guard",
    "topic_catalog", "topic_summary", "topics_frame",
]
