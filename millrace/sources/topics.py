"""Message topics.

A topic is read with the Kafka connector, or from a folder of record files with the
same seven columns; every function takes both, so jobs do not change between them.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import path_exists
from millrace.sources.rows import literal_rows

# For each partition the first and the last offset.
Spans = dict[int, tuple[int, int]]

# Fixed value: the columns Spark's Kafka connector yields.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class BrokerTopic:
    """A topic on a broker; needs the Kafka connector jar."""

    servers: str
    topic: str
    options: dict[str, str] = field(default_factory=dict)

    def stream(self, spark: SparkSession, starting: str | None = "earliest") -> DataFrame:
        """Unbounded records; ``starting=None`` leaves the connector's default (latest)."""
        reader = self._configured(spark.readStream)
        if starting is not None:
            reader = reader.option("startingOffsets", starting)
        return reader.load()

    def batch(self, spark: SparkSession) -> DataFrame:
        """Every record there is now."""
        return (
            self._configured(spark.read)
            .option("startingOffsets", "earliest")
            .option("endingOffsets", "latest")
            .load()
        )

    def records(self, spark: SparkSession, spans: Spans) -> DataFrame:
        """The records within ``spans``; the broker is asked for no others."""
        if not spans:
            return self.batch(spark).limit(0)
        from_ = {self.topic: {str(p): low for p, (low, _) in spans.items()}}
        to = {self.topic: {str(p): high + 1 for p, (_, high) in spans.items()}}
        reader = self._configured(spark.read, assign={self.topic: list(spans)})
        return reader.option("startingOffsets", json.dumps(from_)).option("endingOffsets", json.dumps(to)).load()

    def _configured(self, reader, assign: dict[str, list[int]] | None = None):
        # The connector's names of its options.
        return (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option(*(("assign", json.dumps(assign)) if assign else ("subscribe", self.topic)))
            .options(**self.options)
        )


@dataclass(frozen=True)
class RecordFiles:
    """A topic kept as record files; ``options`` go to the file stream source.

    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` there bounds one micro-batch.
    """

    path: str
    options: dict[str, str] = field(default_factory=dict)

    def stream(self, spark: SparkSession, starting: str | None = "earliest") -> DataFrame:
        if starting not in (None, "earliest"):
            raise ValueError("record files are always read from the earliest record")
        return spark.readStream.schema(RECORD_SCHEMA).options(**self.options).parquet(self.path)

    def batch(self, spark: SparkSession) -> DataFrame:
        """Every record there is now; none if nothing was ever written."""
        if not path_exists(spark, self.path):
            return literal_rows(spark, [], RECORD_SCHEMA)
        return spark.read.schema(RECORD_SCHEMA).parquet(self.path)

    def records(self, spark: SparkSession, spans: Spans) -> DataFrame:
        """The records within ``spans``; the condition reaches the files' statistics."""
        found = F.lit(False)
        for partition, (low, high) in spans.items():
            found |= (F.col("partition") == partition) & F.col("offset").between(low, high)
        return self.batch(spark).filter(found)


Topic = BrokerTopic | RecordFiles


def _first(spark: SparkSession, topic: Topic, max_messages: int) -> tuple[Spans, int]:
    """The span that the first records have in each partition, and their number."""
    places = topic.batch(spark).select("partition", "offset").orderBy("partition", "offset").limit(max_messages)
    told = places.groupBy("partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.count("*").alias("n"))
    rows = told.collect()  # one a partition
    return {r["partition"]: (r["low"], r["high"]) for r in rows}, sum(r["n"] for r in rows)


def consume(
    spark: SparkSession, topic: Topic, max_messages: int, timeout: float = 0.0, every: float = 0.2
) -> DataFrame:
    """The first ``max_messages`` records from the beginning of a topic.

    While there are fewer, the topic is looked at again, up to ``timeout`` seconds; then what there is is
    returned, also nothing.  Which records they are is decided on partitions and offsets alone, a
    read without the values; then only their spans are fetched.
    """
    deadline = time.monotonic() + timeout
    while True:
        spans, n = _first(spark, topic, max_messages)
        left = deadline - time.monotonic()
        if n >= max_messages or left <= 0:
            break
        time.sleep(min(every, left))
    # The last span may hold a repeated offset beyond the number.
    return topic.records(spark, spans).orderBy("partition", "offset").limit(max_messages)
