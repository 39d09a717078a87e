"""What runs leave behind: failures by reason, and a table of runs with metrics over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import epoch_now
from millrace.operators.crawl import Crawl
from millrace.sinks.files import replace_partitions

RUNS = (
    "attempted bigint, fetched bigint, emitted bigint, failed bigint, left_by_pages bigint, left_by_queue bigint, "
    "destination string, errors map<string,bigint>, started bigint, seconds double, recorded bigint, run_id string"
)


def by_reason(failed: DataFrame) -> DataFrame:
    return failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def record_run(run: Crawl, path: str, destination: str = "") -> None:
    """The run's counters, failures by reason, start, duration and time of writing in the table at ``path``.

    A run that is repeated under its ``run_id`` replaces its own row and no other.
    """
    row = run.manifest(destination).withColumns(
        {
            "started": F.lit(run.run_ts).cast("bigint"),
            "seconds": F.lit(float(run.seconds)),
            "recorded": epoch_now(),
        }
    )
    replace_partitions(row, path, "run_id")


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def errors(runs: DataFrame) -> DataFrame:
    """``reason`` and ``n`` over all runs, from what each run noted."""
    noted = runs.select(F.explode("errors").alias("reason", "n"))
    return noted.groupBy("reason").agg(F.sum("n").alias("n"))


def metrics(runs: DataFrame) -> DataFrame:
    """One row over all runs: how many, what they emitted, their error rate and their pace."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("attempted").alias("attempted"),
        F.sum("emitted").alias("emitted"),
        (F.sum("failed") / F.sum("attempted")).alias("error_rate"),
        (F.sum("emitted") / F.sum("seconds")).alias("emitted_per_second"),
        F.max("recorded").alias("last_recorded"),
    )
