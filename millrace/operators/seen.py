"""A stored table of attempted addresses, shared by the levels of a run and by runs."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.frontier import unseen
from millrace.scratch import path_exists

COLUMNS = "url string, depth int, run_id string"


@dataclass(frozen=True)
class SeenTable:
    """``url``, ``depth`` and ``run_id``, partitioned by run and bucketed by address.

    New addresses are spread by address once, to be made distinct; the table already lies so, and
    an anti-join with it moves none of its rows, however many runs it holds.
    """

    spark: SparkSession
    name: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int | None = None) -> SeenTable:
        """The table at ``path``, created if need be; ``buckets`` is fixed when it is created.

        A table is known to a session by a name made from its path.
        """
        name = f"seen_{sha256(path.encode()).hexdigest()[:16]}"
        noted = f"{path}/buckets"
        exists = path_exists(spark, noted)
        if not exists:
            chosen = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(chosen).cast("string").alias("value")).write.text(noted)
        count = int(spark.read.text(noted).first()["value"])
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({COLUMNS}) USING parquet PARTITIONED BY (run_id) "
                f"CLUSTERED BY (url) INTO {count} BUCKETS LOCATION '{path}/rows'"
            )
            if exists:
                spark.sql(f"MSCK REPAIR TABLE {name}")
        return SeenTable(spark, name, count)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def level(self, run_id: str, depth: int) -> DataFrame:
        """``url`` and ``depth`` of what a run attempted at one depth."""
        found = self.rows().filter((F.col("run_id") == run_id) & (F.col("depth") == depth))
        return found.select("url", "depth")

    def start(self, level: DataFrame, run_id: str) -> int:
        """Add the first level of a run; what an earlier attempt at the same run left is replaced."""
        return self._insert(level, run_id, "OVERWRITE")

    def add(self, level: DataFrame, run_id: str) -> int:
        """Add a level to a run; the number of its addresses."""
        return self._insert(level, run_id, "INTO")

    def _insert(self, level: DataFrame, run_id: str, how: str) -> int:
        counted = Observation()
        rows = level.repartition(self.buckets, "url").select("url", "depth")
        rows.observe(counted, F.count(F.lit(1)).alias("n")).createOrReplaceTempView(f"{self.name}_new")
        run = run_id.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"INSERT {how} TABLE {self.name} PARTITION (run_id = '{run}') SELECT * FROM {self.name}_new"
        )
        self.spark.catalog.dropTempView(f"{self.name}_new")
        return counted.get["n"]

    def unseen(self, candidates: DataFrame, without_run: str | None = None) -> DataFrame:
        """Candidates that no run has attempted; ``without_run`` is a run whose rows do not count."""
        rows = self.rows() if without_run is None else self.rows().filter(F.col("run_id") != without_run)
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            candidates = candidates.repartition(self.buckets, "url")
        return unseen(candidates, rows)

    def forget(self) -> None:
        """Drop the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
