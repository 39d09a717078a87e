"""Topic to table, with the events table as the topic."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.messages import decode_json, encode_json, raw_messages
from millrace.plans.registry import query, table
from millrace.scratch import fresh_dir
from millrace.sinks.topics import as_records, produce
from millrace.sources.tables import versioned_table
from millrace.sources.topics import RecordFiles, consume
from millrace.streaming.append import drain_append
from millrace.streaming.quarantine import KEPT, QUARANTINED, start_sorting

EVENT_MESSAGE = T.StructType(
    [T.StructField("message", T.StringType()), T.StructField("event_id", T.LongType())]
)


def _event_topic(spark: SparkSession, sf_dir: str, value: Column) -> RecordFiles:
    events = table(spark, sf_dir, "events")
    topic = RecordFiles(fresh_dir(spark, "topic"))
    produce(
        as_records(
            events,
            "events",
            value=value,
            offset=F.col("event_id"),
            key=F.col("user_id").cast("string"),
            timestamp=F.col("ts"),
        ),
        topic,
    )
    return topic


def _drained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path, checkpoint = fresh_dir(spark, "appended"), fresh_dir(spark, "stream")
    drain_append(rows, path, checkpoint, fmt="parquet")
    return versioned_table(spark, path, fmt="parquet")


@query('SELECT event_id AS "offset", event_type AS message, event_id FROM events')
def stream_json_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode JSON messages from a stream and append them to a table."""
    value = encode_json(F.col("event_type").alias("message"), "event_id")
    topic = _event_topic(spark, sf_dir, value)
    return _drained(spark, decode_json(topic.stream(spark), EVENT_MESSAGE, keep=("offset",)))


@query("SELECT props AS msg FROM events")
def stream_raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append messages as they are."""
    topic = _event_topic(spark, sf_dir, F.col("props"))
    return _drained(spark, raw_messages(topic.stream(spark, starting=None)))


@query(
    """
    SELECT message, count(*) AS n
    FROM (SELECT event_type AS message FROM events
          UNION ALL SELECT o_orderpriority FROM orders)
    GROUP BY message
    """
)
def stream_restart_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream stopped, given more records, and started twice again, loses and repeats none."""
    topic = _event_topic(spark, sf_dir, encode_json(F.col("event_type").alias("message")))
    path, checkpoint = fresh_dir(spark, "appended"), fresh_dir(spark, "stream")

    def run() -> None:
        rows = decode_json(topic.stream(spark))
        drain_append(rows, path, checkpoint, fmt="parquet")

    run()
    later = as_records(
        table(spark, sf_dir, "orders"),
        "events",
        value=encode_json(F.col("o_orderpriority").alias("message")),
        offset=F.col("o_orderkey"),
    )
    produce(later, topic)
    run()
    run()
    appended = versioned_table(spark, path, fmt="parquet")
    return appended.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


MESSAGES_PER_FILE = 250_000

# Message shapes a decoder meets, as Spark SQL over the events table.
MESSAGE_SHAPES = {
    "object": """ '{"message":"' || event_type || '"}' """,
    "number": """ '{"message":' || event_id || '}' """,
    "nested": """ '{"message":{"a":' || event_id || '}}' """,
    "trailing": """ '{"message":"' || event_type || '"} and more' """,
    "text": "event_type",
    "other_key": """ '{"other":"' || event_type || '"}' """,
    "null_field": """ '{"message":null}' """,
    "array": """ '[' || event_id || ']' """,
    "empty": "''",
    "missing": "CAST(NULL AS STRING)",
}


@query(
    """
    SELECT event_id, 'object' AS shape, event_type AS message FROM events
    UNION ALL SELECT event_id, 'number', CAST(event_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'nested', '{"a":' || event_id || '}' FROM events
    UNION ALL SELECT event_id, 'trailing', event_type FROM events
    UNION ALL SELECT event_id, shape, CAST(NULL AS VARCHAR)
              FROM events, (VALUES ('text'), ('other_key'), ('null_field'), ('array'),
                                   ('empty'), ('missing')) s(shape)
    """
)
def json_decode_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in every message shape, decoded; what does not decode is a NULL row."""
    shapes = F.array(
        *[
            F.struct(F.lit(name).alias("shape"), F.expr(sql).alias("text"))
            for name, sql in MESSAGE_SHAPES.items()
        ]
    )
    shaped = table(spark, sf_dir, "events").select("event_id", F.explode(shapes).alias("s"))
    records = shaped.select("event_id", "s.shape", F.col("s.text").cast("binary").alias("value"))
    return decode_json(records, keep=("event_id", "shape"))


def _shaped_topic(spark: SparkSession, sf_dir: str) -> RecordFiles:
    """Every event in every message shape, as a topic of files that tasks can share out."""
    shapes = F.posexplode(F.array(*[F.expr(sql) for sql in MESSAGE_SHAPES.values()]))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    files = -(-events.count() * len(MESSAGE_SHAPES) // MESSAGES_PER_FILE)
    shaped = events.repartition(max(1, files)).select("event_id", "ts", shapes.alias("shape", "text"))
    place = F.col("event_id") * len(MESSAGE_SHAPES) + F.col("shape")
    topic = RecordFiles(fresh_dir(spark, "topic"))
    produce(as_records(shaped, "events", value=F.col("text"), offset=place, timestamp=F.col("ts")), topic)
    return topic


@query(
    """
    SELECT outcome, count(*) AS n, count(DISTINCT event_id) AS events
    FROM events, (VALUES ('kept', 0), ('kept', 1), ('kept', 2), ('kept', 3), ('kept', 4), ('kept', 5),
                         ('malformed', 6), ('malformed', 7), ('empty', 8), ('missing', 9)) s(outcome, shape)
    GROUP BY outcome
    """
)
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that decode and those that do not, in two tables, after a stop in the middle of a batch."""
    topic, path, checkpoint = _shaped_topic(spark, sf_dir), fresh_dir(spark, "sorted"), fresh_dir(spark, "stream")

    def stop(batch: int) -> None:
        raise RuntimeError("stopped between the two writes")

    for between in (stop, None):
        try:
            start_sorting(topic.stream(spark), path, checkpoint, drain=True, between=between).awaitTermination()
        except StreamingQueryException:
            if between is None:
                raise
    kept = spark.read.parquet(f"{path}/{KEPT}").select("offset", F.lit(KEPT).alias("outcome"))
    rest = spark.read.parquet(f"{path}/{QUARANTINED}").select("offset", F.col("reason").alias("outcome"))
    event = F.floor(F.col("offset") / len(MESSAGE_SHAPES))
    return kept.unionByName(rest).groupBy("outcome").agg(
        F.count("*").alias("n"), F.count_distinct(event).alias("events")
    )


@query(
    """
    SELECT 0 AS "partition", event_id AS "offset", props AS msg
    FROM events ORDER BY event_id LIMIT 1
    """
)
def bounded_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Produce a topic, then take one message from its beginning."""
    topic = _event_topic(spark, sf_dir, F.col("props"))
    first = consume(spark, topic, max_messages=1, timeout=5)
    return first.select("partition", "offset", F.col("value").cast("string").alias("msg"))
