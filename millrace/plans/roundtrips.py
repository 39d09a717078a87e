"""Tables written and read back, and models stored as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.operators.counts import element_count_lines, lines_per_file, row_count
from millrace.operators.models import materialize
from millrace.plans.registry import query, table
from millrace.scratch import fresh_dir
from millrace.sinks import files as sink
from millrace.sources import tables as source

# Fixed value: a model, as a SELECT over literal rows and a table.
STATUS_MODEL = """
    WITH statuses AS (
        SELECT 'O' AS code, 'open' AS status
        UNION ALL SELECT 'F', 'filled'
        UNION ALL SELECT 'P', 'partial'
    )
    SELECT o_orderkey AS id, status
    FROM {orders} JOIN statuses ON o_orderstatus = code
"""


@query("SELECT * FROM orders")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "orders")
    sink.parquet(table(spark, sf_dir, "orders"), path)
    return source.parquet(spark, path)


@query("SELECT * FROM customer")
def table_format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite a versioned table twice and read its latest version."""
    path = fresh_dir(spark, "customer")
    customers = table(spark, sf_dir, "customer")
    sink.versioned_table(customers.select(F.lit("old").alias("c_name")), path, fmt="parquet")
    sink.versioned_table(customers, path, fmt="parquet")
    return source.versioned_table(spark, path, fmt="parquet")


def _status_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = f"parquet.`{sf_dir}/orders.parquet`"
    name = f"order_status_{uuid.uuid4().hex}"
    return materialize(spark, name, STATUS_MODEL.format(orders=orders), fresh_dir(spark, name))


@query(STATUS_MODEL.format(orders="orders"))
def model_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status_model(spark, sf_dir)


@query(f"SELECT count(*) AS n FROM ({STATUS_MODEL.format(orders='orders')})")
def model_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count(*)`` in SQL on the stored model."""
    model = _status_model(spark, sf_dir)
    return spark.sql("SELECT count(*) AS n FROM {model}", model=model)


@query(
    """
    SELECT count(*) AS n_lines,
           count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent
    FROM orders
    """
)
def text_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order written as text; all lines and matching lines counted."""
    path = fresh_dir(spark, "priorities")
    table(spark, sf_dir, "orders").select("o_orderpriority").write.text(path)
    lines = source.text_lines(spark, path)
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("value") == "1-URGENT").alias("n_urgent"),
    )


@query("SELECT count(*) AS n FROM events")
def file_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every written file, summed."""
    path = fresh_dir(spark, "props")
    table(spark, sf_dir, "events").select("props").write.text(path)
    return lines_per_file(source.text_lines(spark, path)).agg(F.sum("n").alias("n"))


@query(
    """
    SELECT 'orders kept' AS "check", 0::BIGINT AS expected, 0::BIGINT AS actual, true AS ok
    UNION ALL SELECT 'customers', (SELECT count(*) FROM customer),
                     (SELECT count(*) FROM customer), true
    UNION ALL SELECT 'model rows', 1, count(*), count(*) >= 1 FROM orders
              WHERE o_orderstatus IN ('O', 'F', 'P')
    UNION ALL SELECT 'clicks listed', 1,
                     (SELECT count(DISTINCT event_type) FROM events WHERE event_type = 'click'),
                     EXISTS (SELECT 1 FROM events WHERE event_type = 'click')
    UNION ALL SELECT 'open orders lost', 0, count(*), count(*) = 0 FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'one more customer', (SELECT count(*) + 1 FROM customer),
                     (SELECT count(*) FROM customer), false
    UNION ALL SELECT 'too few orders', (SELECT count(*) + 1 FROM orders),
                     (SELECT count(*) FROM orders), false
    UNION ALL SELECT 'no such event', 1, count(*), count(*) >= 1 FROM events WHERE event_type = 'none'
    """
)
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of checks over written tables, each met once and failed once."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    (n_customers,) = row_count(customers).first()
    lines = element_count_lines(table(spark, sf_dir, "events"), "event_type")
    return checks.report(
        checks.same_rows(orders, parquet_roundtrip(spark, sf_dir), "orders kept"),
        checks.row_count_is(table_format_roundtrip(spark, sf_dir), n_customers, "customers"),
        checks.row_count_at_least(_status_model(spark, sf_dir), 1, "model rows"),
        checks.has_row(lines, F.col("line").startswith("click:"), "clicks listed"),
        checks.same_rows(orders, orders.filter("o_orderstatus <> 'O'"), "open orders lost"),
        checks.row_count_is(customers, n_customers + 1, "one more customer"),
        checks.row_count_at_least(orders, row_count(orders).first()[0] + 1, "too few orders"),
        checks.has_row(lines, F.col("line").startswith("none:"), "no such event"),
    )
