"""Benchmark decontamination by winnowed fingerprints.

Of every ``window - k + 1`` consecutive k-grams of words the one with the smallest hash is a
fingerprint, in documents and in benchmark items alike, so a shared span of ``window`` words
shares one.  Documents are matched with the items' fingerprints where they lie.  A match is
extended to the windows that contain it, and those that are windows of an item, compared word
by word, are hits.  Items shorter than a window are one window of their own length.

The benchmark is the stated set of the search: it is read in blocks of bounded size, each of
which is sent to all tasks; several blocks mean several passes and the same result.

Defined cases: a null or empty text, or one without a word, has no words and no hits; an item
without words matches nothing; a null ``item_id`` is written as an empty text; repeated items
and ids count once; an empty benchmark hits nothing; other columns pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.rows import add_struct, bytes_of
from millrace.llm.spans import STEP, Words, fold_table, gram_hashes, mixed
from millrace.scratch import fresh_dir

WINDOW = 10
K = 5
BLOCK_BYTES = 2 << 20

WORD_TABLE = fold_table(lambda b: b >= 128 or chr(b).isalnum())
LAST = np.uint64(2**64 - 1)

OUT = "n_words bigint, n_hit bigint, runs array<bigint>, items array<string>"


@dataclass
class Family:
    """Windows of one size: their fingerprints, their hashes, and whose they are."""

    size: int
    k: int
    prints: np.ndarray | list = field(default_factory=list)
    hashes: np.ndarray | list = field(default_factory=list)
    items: dict[bytes, set[str]] = field(default_factory=lambda: defaultdict(set))


def _slide(values: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` over each ``n`` consecutive values."""
    out = values[: len(values) - n + 1]
    for j in range(1, n):
        out = pick(out, values[j : len(values) - n + 1 + j])
    return out


def winnowed(grams: np.ndarray, n: int) -> np.ndarray:
    """Places whose value is the smallest of some ``n`` consecutive ones."""
    if len(grams) < n:
        return np.empty(0, np.int64)
    least = _slide(grams, n, np.minimum)
    fill = np.zeros(n - 1, np.uint64)
    around = _slide(np.concatenate((fill, least, fill)), n, np.maximum)
    return np.flatnonzero(grams == around)


def index(items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K) -> list[Family]:
    """The families of a block of ``(item_id, text)``."""
    words = Words([text for _, text in items], WORD_TABLE)
    families: dict[int, Family] = {}
    for (name, _), first, n in zip(items, words.first.tolist(), words.counts.tolist()):
        if not n:
            continue
        size = min(window, n)
        family = families.setdefault(size, Family(size, min(k, size)))
        own = words.hashes[first : first + n]
        grams = gram_hashes(own, family.k)
        family.prints.append(grams[winnowed(grams, size - family.k + 1)])
        family.hashes.append(gram_hashes(own, size))
        for at in range(first, first + n - size + 1):
            family.items[words.joined(at, size)].add(name)
    for family in families.values():
        family.prints = np.unique(np.concatenate(family.prints))
        family.hashes = np.unique(np.concatenate(family.hashes))
        family.items = dict(family.items)
    return list(families.values())


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def search(texts: list[bytes], families: list[Family]) -> list[dict]:
    """For each text its words, the runs of words that are hit, and the items that hit them."""
    words = Words(texts, WORD_TABLE)
    ends, total = words.ends_of_texts, len(words.hashes)
    change = np.zeros(total + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    last_words = words.first + words.counts
    for family in families:
        size, k = family.size, family.k
        grams = gram_hashes(words.hashes, k)
        if len(grams) < size - k + 1:
            continue
        grams[np.arange(k, len(grams) + k) > ends[: len(grams)]] = LAST
        marks = winnowed(grams, size - k + 1)
        marks = marks[_among(grams[marks], family.prints)]
        starts = np.unique(marks[:, None] - np.arange(size - k + 1))
        starts = starts[starts >= 0]
        starts = starts[starts + size <= ends[starts]]
        whole = np.zeros(len(starts), np.uint64)
        for j in range(size):
            whole = whole * np.uint64(STEP) + words.hashes[starts + j]
        starts = starts[_among(mixed(whole), family.hashes)]
        for at, text in zip(starts.tolist(), np.searchsorted(last_words, starts, "right").tolist()):
            names = family.items.get(words.joined(at, size))
            if names:
                change[at] += 1
                change[at + size] -= 1
                items[text] |= names
    hit = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    n_hit = hit[last_words] - hit[words.first]
    out = []
    for i, (first, n) in enumerate(zip(words.first.tolist(), words.counts.tolist())):
        runs = []
        if n_hit[i]:
            inside = np.diff(hit[first : first + n + 1]) > 0
            runs = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])))).tolist()
        out.append({"n_words": n, "n_hit": int(n_hit[i]), "runs": runs, "items": sorted(items.get(i, ()))})
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """``(item_id, text)`` of the benchmark, a bounded block at a time; one at least."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    for name, text in rows.toLocalIterator():
        block.append((name, (text or "").encode()))
        held += len(block[-1][1])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    yield block


def _pass(docs: DataFrame, families: list[Family]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(families)

    def work(rows: pa.RecordBatch) -> list[dict]:
        return search(bytes_of(rows.column("text")), shared.value)

    return add_struct(docs, work, T.StructType.fromDDL(OUT))


def _united(rows: pa.RecordBatch) -> list[dict]:
    """Hits of several passes over one text as one."""
    out = []
    for out_of, more in zip(rows.column("out").to_pylist(), rows.column("more").to_pylist()):
        parts = [out_of, *(more or [])]
        places = {w for p in parts for a, b in zip(p["runs"][::2], p["runs"][1::2]) for w in range(a, b)}
        ends = sorted(places ^ {w + 1 for w in places})
        names = sorted({name for p in parts for name in p["items"]})
        out.append(out_of | {"n_hit": len(places), "runs": ends, "items": names})
    return out


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the columns of ``docs``, among them ``text``) and ``out``, described by ``OUT``.

    ``runs`` holds first words and ends of the runs of hit words, ``items`` the item ids, both
    in order.
    """
    found, more = None, []
    work = fresh_dir(docs.sparkSession, "decontamination")
    digest = F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256)
    for number, block in enumerate(blocks(benchmark, block_bytes)):
        part = _pass(docs if number == 0 else docs.select("text"), index(block))
        if number == 0:
            found = part
            continue
        hits = part.filter("out.n_hit > 0").select(digest.alias("digest"), "out")
        hits.groupBy("digest").agg(F.first("out").alias("out")).write.parquet(f"{work}/{number}")
        more.append(f"{work}/{number}")
    if not more:
        return found
    spark = docs.sparkSession
    later = spark.read.schema(f"digest string, out struct<{_ddl_fields()}>").parquet(*more)
    later = later.groupBy("digest").agg(F.collect_list("out").alias("more"))  # one row a block at most
    joined = found.withColumn("digest", digest).join(later, "digest", "left").select("row", "out", "more")
    united = add_struct(joined, _united, T.StructType.fromDDL(OUT))
    return united.select("row.row", "out")


def _ddl_fields() -> str:
    return ", ".join(f"{a}: {b}" for a, b in (part.split() for part in OUT.split(", ")))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find``, a row per document."""
    names = F.concat_ws(",", "out.items")
    return found.select(
        "row.doc_id",
        "out.n_words",
        "out.n_hit",
        F.size("out.items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("out.n_hit") > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were."""
    return find(docs, benchmark).filter("out.n_hit = 0").select("row.*")
