"""Session factory.

Jobs run in whatever session they are handed; this factory is for the command
line, the benchmark and the tests.  Object-store credentials, table-format
extensions and cluster settings pass through unchanged as session conf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# What every job relies on.  AQE splits skewed join partitions and
# coalesces small shuffle partitions, so the initial partition count may be generous.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str, master: str | None = None, conf: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with ``BASE_CONF`` overlaid by ``conf``; ``master`` None keeps spark-submit's."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def object_store_conf(
    endpoint: str,
    access_key: str,
    secret_key: str,
    path_style: bool = True,
    tls: bool = False,
) -> dict[str, str]:
    """Session conf for ``s3a://`` paths; needs the Hadoop S3A jar on the cluster."""
    # The connector's names of its settings and of its class.
    return {
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(tls).lower(),
    }


def lakehouse_conf() -> dict[str, str]:
    """Session conf for ``format("delta")``; needs the Delta jar on the cluster."""
    # The table format's names of its classes.
    return {
        "spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension",
        "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog",
    }
