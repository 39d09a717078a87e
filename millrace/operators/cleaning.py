"""Bodies and texts: each once, cleaned, and dealt to splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def body_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def distinct_bodies(rows: DataFrame, body: str, order: str) -> DataFrame:
    """``order`` (the smallest), ``body_hash`` and ``copies`` of each body; a missing one is none.

    Copies combine before the exchange, so a body that most rows share is no hot key.
    """
    hashed = rows.filter(F.col(body).isNotNull()).select(order, body_hash(F.col(body)).alias("body_hash"))
    return hashed.groupBy("body_hash").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def cleaned(text: Column) -> Column:
    """The text with each run of white space as one space, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def split_of(key: Column, train: int = 90, validation: int = 5) -> Column:
    """``train``, ``validation`` or ``test``, by percent, from the hash of a key."""
    place = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 100
    return F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test")


def clean_split(rows: DataFrame, text: str, key: str, least_chars: int) -> DataFrame:
    """``key``, ``n_chars``, ``body_hash``, ``copies`` and ``split`` of each cleaned text, once.

    Texts of fewer than ``least_chars`` characters are dropped.  The split goes by the text's hash,
    so copies cannot end up in different splits.
    """
    clean = rows.select(key, cleaned(F.col(text)).alias("_text"))
    long = clean.filter(F.char_length("_text") >= least_chars)
    hashed = long.select(key, body_hash(F.col("_text")).alias("body_hash"), F.char_length("_text").cast("bigint").alias("n_chars"))
    once = hashed.groupBy("body_hash", "n_chars").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    return once.select(key, "n_chars", "body_hash", "copies", split_of(F.col("body_hash")).alias("split"))
