"""A table that grows columns and widens types, with its schema kept beside it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import path_exists

# The types that a file's values may be read as, besides their own.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"),
    "smallint": ("int", "bigint", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp_ntz",),
}


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrower of two types that holds the values of both; an error if neither does."""
    if a == b or b.simpleString() in WIDER.get(a.simpleString(), ()):
        return b
    if a.simpleString() in WIDER.get(b.simpleString(), ()):
        return a
    raise ValueError(f"neither {a.simpleString()} nor {b.simpleString()} holds the other")


def united(old: T.StructType, new: T.StructType) -> T.StructType:
    """All columns of both, each of the wider type; those of ``old`` come first."""
    fields = {field.name: field.dataType for field in old}
    for field in new:
        known = fields.get(field.name)
        fields[field.name] = field.dataType if known is None else wider_type(known, field.dataType)
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@dataclass(frozen=True)
class EvolvingTable:
    """Rows in ``path/rows``; each version of the schema, as JSON, in ``path/schemas``.

    A read states the latest schema, so no file is opened to find out: a column that a file lacks
    is NULL, and its narrower values are widened by the reader.
    """

    spark: SparkSession
    path: str

    def versions(self) -> DataFrame:
        """``version`` and ``schema`` of every version."""
        stored = self.spark.read.schema("value string, version int").text(f"{self.path}/schemas")
        return stored.select("version", F.col("value").alias("schema"))

    def _latest(self) -> tuple[int, T.StructType]:
        if not path_exists(self.spark, f"{self.path}/schemas"):
            return 0, T.StructType()
        row = self.versions().orderBy(F.desc("version")).first()
        return row["version"], T.StructType.fromJson(json.loads(row["schema"]))

    def schema(self) -> T.StructType:
        return self._latest()[1]

    def append(self, rows: DataFrame) -> None:
        """Add rows; a new column or a wider type makes a new version of the schema, written before them.

        Types that do not widen raise an error and nothing is written; of two writers of one version the
        later fails.
        """
        version, known = self._latest()
        merged = united(known, rows.schema)
        if merged != known:
            text = self.spark.range(1).select(F.lit(merged.json()).alias("value"))
            text.write.mode("error").text(f"{self.path}/schemas/version={version + 1}")
        rows.write.mode("append").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(f"{self.path}/rows")
