"""Where jobs put intermediate tables.

Intermediate results are written tables in the folder the cluster shares
(``spark.checkpoint.dir``), so they survive the loss of any executor.  A
machine-local folder is used only when that setting is absent *and* the session
runs in one process, as in the tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach; "
            "a machine-local folder would not survive on a cluster"
        )
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_roots[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path nobody has written to yet; the caller decides what to put there."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
