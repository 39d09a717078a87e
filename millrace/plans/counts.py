"""Row, group and element counts, and a function applied in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import plus_one
from millrace.operators.counts import element_count_lines, element_counts, row_counts
from millrace.plans.registry import TABLES, query, table
from millrace.scratch import fresh_dir
from millrace.sinks.files import text_report
from millrace.sources.rows import integer_range, literal_rows
from millrace.sources.tables import text_lines

# What the order status letters mean.
ORDER_STATUS = [("O", "open"), ("F", "filled"), ("P", "partial")]


@query(
    """
    SELECT count(*) AS n_ids,
           (SELECT count(DISTINCT event_id) FROM events
            WHERE event_id >= 0 AND event_id < (SELECT count(*) FROM events)) AS n_present
    FROM events
    """
)
def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many ids from 0 on as there are events, and how many of them an event has.

    The range is as long as the table, whatever its ids are.
    """
    events = table(spark, sf_dir, "events")
    present = events.select(F.col("event_id").alias("id")).distinct().withColumn("present", F.lit(1))
    return (
        integer_range(spark, 0, events.count())
        .join(present, "id", "left")
        .agg(F.count(F.lit(1)).alias("n_ids"), F.count("present").alias("n_present"))
    )


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)
)
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({t: table(spark, sf_dir, t) for t in TABLES})


@query(
    """
    SELECT count(*) AS n
    FROM orders JOIN (VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial')) s(code, label)
      ON o_orderstatus = code
    """
)
def literal_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal rows joined with a table, counted as one group."""
    statuses = literal_rows(spark, ORDER_STATUS, ["o_orderstatus", "label"])
    orders = table(spark, sf_dir, "orders").join(F.broadcast(statuses), "o_orderstatus")
    return orders.groupBy().count().withColumnRenamed("count", "n")


@query("SELECT event_type AS element, count(*) AS n FROM events GROUP BY event_type")
def value_counts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type || ':' || count(*) AS line FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count per element, as ``element:count`` lines in one text file, read back."""
    path = fresh_dir(spark, "value-counts")
    text_report(element_count_lines(table(spark, sf_dir, "events"), "event_type"), path, shards=1)
    return text_lines(spark, path).select(F.col("value").alias("line"))


@query(
    """
    SELECT element || ':' || n AS line FROM (
        SELECT w AS element, count(*) AS n
        FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM conversations)
        WHERE w <> '' GROUP BY w)
    """
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count per word over whole texts: the same job with many distinct elements."""
    words = table(spark, sf_dir, "conversations").select(
        F.explode(F.split("text", r"\s+")).alias("word")
    )
    path = fresh_dir(spark, "word-counts")
    text_report(element_count_lines(words.filter("word <> ''"), "word"), path)
    return text_lines(spark, path).select(F.col("value").alias("line"))


@query(
    """
    SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 1 AS BIGINT) AS plus_one
    FROM lineitem
    """
)
def parallel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over every value, in Arrow batches."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return items.withColumn("plus_one", plus_one(F.col("l_linenumber")))
