"""Files and tables written by batches.

Every writer replaces or extends a whole folder; none reads the folder it writes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import day_stamp, hour_stamp

# Fixed value: what Spark writes as %XX in the names of partition folders.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def versioned_table(df: DataFrame, path: str, fmt: str = "delta", mode: str = "overwrite") -> None:
    """Replace or extend the table at ``path``; ``fmt="parquet"`` needs no extra jar."""
    df.write.format(fmt).mode(mode).save(path)


def text_report(lines: DataFrame, path: str, shards: int | None = None) -> None:
    """Write a one-column frame as text, in ``shards`` files if that is given.

    Gathering into few files costs an exchange of the finished lines; computing them keeps its
    full parallelism.
    """
    if len(lines.columns) != 1:
        raise ValueError("text output takes exactly one column")
    out = lines if shards is None else lines.repartition(shards)
    out.write.mode("overwrite").text(path)


def replace_partitions(
    df: DataFrame, path: str, *parts: str, fmt: str = "parquet", options: Mapping[str, str] | None = None
) -> None:
    """Write ``df`` under ``path`` in folders by ``parts``; the folders it has rows for are replaced, no others."""
    (
        df.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(options or {}))
        .partitionBy(*parts)
        .save(path)
    )


def dated_json_lines(
    records: DataFrame,
    path: str,
    run_id: str,
    epoch_seconds: Column | int,
    hourly: bool = False,
) -> None:
    """JSON lines under ``dt=<yyyyMMdd>[/hour=<HH>]/run_id=<run>``; runs do not overwrite each other.

    A run that is repeated replaces what it wrote, also by nothing: with one time for all records, such
    as the run's start, its folder is written anew.  With a column of times only the folders that
    get records are.
    """
    lines = {"ignoreNullFields": "false"}
    stamps = {"dt": day_stamp, **({"hour": hour_stamp} if hourly else {})}
    if isinstance(epoch_seconds, int):
        moment = datetime.fromtimestamp(epoch_seconds, UTC)
        parts = {"dt": f"{moment:%Y%m%d}", **({"hour": f"{moment:%H}"} if hourly else {}), "run_id": run_id}
        folder = "/".join(f"{name}={ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value)}" for name, value in parts.items())
        records.write.mode("overwrite").options(**lines).json(f"{path}/{folder}")
        return
    dated = records.withColumns({name: stamp(epoch_seconds) for name, stamp in stamps.items()})
    dated = dated.withColumn("run_id", F.lit(run_id))
    replace_partitions(dated, path, *stamps, "run_id", fmt="json", options=lines)


def managed_table(df: DataFrame, name: str, path: str, fmt: str = "parquet") -> None:
    """Store ``df`` under ``path`` as the table ``name``, replacing an earlier table.

    The rows go to a folder of their own, and the name moves there only when they are complete
    and can be read.  A run that fails leaves the earlier table as it was, and a table may be
    rebuilt from itself.  Folders of earlier versions stay, for readers that still use them.
    """
    spark: SparkSession = df.sparkSession
    version = f"{path}/version-{uuid.uuid4().hex}"
    df.write.format(fmt).save(version)
    schema = spark.read.format(fmt).load(version).schema
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # only the name: the files are the caller's
    spark.catalog.createTable(name, version, fmt, schema)
