"""A stream of messages into two tables: those that decode, and those that do not with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.messages import MESSAGE_SCHEMA, as_text

KEPT, QUARANTINED = "kept", "quarantined"
PLACE = ("partition", "offset", "timestamp")
_CORRUPT = "_corrupt_record"


def decoded(value: Column, schema: T.StructType) -> Column:
    """The fields of a message, with its text in ``_corrupt_record`` if it is not of that shape.

    A text without ``{`` holds no object, so it is not parsed and has no fields.
    """
    marked = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(as_text(value), marked, {"columnNameOfCorruptRecord": _CORRUPT})
    return F.when(as_text(value).contains("{"), parsed)


def reason(value: Column, fields: Column) -> Column:
    """Why a message does not decode: ``missing``, ``empty`` or ``malformed``; NULL if it does."""
    return (
        F.when(value.isNull(), "missing")
        .when(F.trim(as_text(value)) == "", "empty")
        .when(fields.isNull() | fields[_CORRUPT].isNotNull(), "malformed")
    )


def start_sorting(
    records: DataFrame,
    path: str,
    checkpoint: str,
    schema: T.StructType = MESSAGE_SCHEMA,
    drain: bool = False,
    between: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Start sorting the records of a topic into ``path/kept`` and ``path/quarantined``.

    Kept rows have the place of the message and its fields, quarantined ones its place, bytes and
    reason.  A batch has a folder of its own in each table, which a repetition of the batch
    replaces, so a stop between the two writes neither loses a message nor doubles it.
    ``between`` is called there with the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Conditions are not moved below a generator, so each write decodes a message once.
        told = batch.withColumn("fields", F.explode(F.array(decoded(F.col("value"), schema))))
        told = told.withColumn("reason", reason(F.col("value"), F.col("fields")))
        names = [F.col("fields")[name].alias(name) for name in schema.names]
        kept = told.filter("reason IS NULL").select(*PLACE, *names)
        kept.write.mode("overwrite").parquet(f"{path}/{KEPT}/batch={number}")
        if between is not None:
            between(number)
        rest = told.filter("reason IS NOT NULL").select(*PLACE, "key", "value", "reason")
        rest.write.mode("overwrite").parquet(f"{path}/{QUARANTINED}/batch={number}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()
