"""Posts as queue messages: key and JSON value."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from feedlode.functions.fixed_values import KIND_POST
from feedlode.functions.text import default_text, text_or_empty
from feedlode.operators.rows import assign_post_id, instant, keep_where
from feedlode.schema import POST_COLUMNS, QUEUE_SCHEMA
from feedlode.sources.payloads import Parsed

# Times in messages are RFC 3339 in UTC.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
WRITE_OPTIONS = {"timestampFormat": TIME_FORMAT, "timeZone": "UTC", "ignoreNullFields": "false"}
READ_OPTIONS = {"columnNameOfCorruptRecord": "_bad"}
TEXTS = ["id", "platform", "channel", "content_kind", "title", "content", "url", "author"]


def to_queue(posts: DataFrame, ingested_at: datetime | Column) -> DataFrame:
    """(key, value): the post id, filled in if missing, and the post as JSON."""
    filled = assign_post_id(posts).withColumns(
        {
            "content_kind": default_text(F.col("content_kind"), KIND_POST),
            "ingested_at": instant(ingested_at),
        }
    )
    message = F.struct(*POST_COLUMNS, "ingested_at")
    return filled.select(F.col("id").alias("key"), F.to_json(message, WRITE_OPTIONS).alias("value"))


def from_queue(messages: DataFrame) -> Parsed:
    """Posts from messages; what cannot be decoded goes to the rejects."""
    read = messages.withColumn(
        "_read", F.from_json(F.col("value").cast("string"), QUEUE_SCHEMA + ", _bad string", READ_OPTIONS)
    )
    bad = F.col("_read").isNull() | F.col("_read._bad").isNotNull()
    columns = [
        text_or_empty(F.col(f"_read.{c}")).alias(c) if c in TEXTS else F.col(f"_read.{c}").alias(c)
        for c in POST_COLUMNS
    ]
    return Parsed(
        keep_where(read, ~bad).select(*columns),
        keep_where(read, bad).select("key", "value", F.lit("undecodable message").alias("error")),
    )


def read_topic(spark: SparkSession, servers: str, topic: str, max_per_trigger: int) -> DataFrame:
    """Messages of a Kafka topic as a stream; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_per_trigger)
        .load()
    )


def write_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Messages to a Kafka topic; needs Spark's Kafka package on the class path."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
