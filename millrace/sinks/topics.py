"""Producing to a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.topics import RECORD_SCHEMA, BrokerTopic, RecordFiles, Topic


def as_records(
    rows: DataFrame,
    topic: str,
    value: Column,
    offset: Column,
    key: Column | None = None,
    partition: Column | None = None,
    timestamp: Column | None = None,
) -> DataFrame:
    """Rows in the shape of topic records, ``value`` and ``key`` as bytes."""
    parts = {
        "key": F.lit(None) if key is None else key,
        "value": value,
        "topic": F.lit(topic),
        "partition": F.lit(0) if partition is None else partition,
        "offset": offset,
        "timestamp": F.current_timestamp() if timestamp is None else timestamp,
        "timestampType": F.lit(0),
    }
    return rows.select(
        *[parts[f.name].cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields]
    )


def produce(records: DataFrame, topic: Topic) -> None:
    """Append records to a topic; a broker assigns offsets itself, files keep the given ones."""
    if isinstance(topic, RecordFiles):
        records.write.mode("append").parquet(topic.path)
    elif isinstance(topic, BrokerTopic):
        (
            records.select("key", "value")
            .write.format("kafka")
            .option("kafka.bootstrap.servers", topic.servers)
            .option("topic", topic.topic)
            .save()
        )
    else:
        raise TypeError(f"not a topic: {topic!r}")
