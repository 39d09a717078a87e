"""URL verdicts by host rules and, where none fits, by gradient-boosted trees.

A rule names a host and the beginning of a path; it fits the host and its subdomains.  The URLs
that rules decide are the labelled ones.  The trees are fitted on lexical features of a sample
of them: lengths, depth, digit ratio, entropy, parameter counts, and how often URLs below the
same host suffixes were blocked, counted over all labelled URLs.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is judged by its features; of equally long rules the first in the list wins; where the
rules label URLs with one verdict only, or none, all others get that verdict, or ``allow``;
other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.rows import add_struct, texts_of
from millrace.scratch import fresh_dir

TRAIN_ROWS = 50_000
TREES = 12
DEPTH = 4
PRIOR = 20.0
SUFFIXES = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEXICAL = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "digit_run",
    "entropy", "hyphens", "parameters", "query_length", "fragment", "longest_part",
]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def of(verdict: str, pattern: str) -> Rule:
        host, slash, path = pattern.partition("/")
        return Rule(verdict, host.lower(), slash + path)

    @property
    def pattern(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        below = host.endswith("." + self.host) | (host == self.host)
        return below & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z in lower case, and path of a URL."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, PARTS, 2)


def ruled(rules: list[Rule], host: Column, path: Column) -> Column:
    """``pattern`` and ``verdict`` of the longest rule that fits; null if none does."""
    kind = "struct<pattern: string, verdict: string>"
    ordered = sorted(rules, key=lambda rule: -len(rule.pattern))
    said = lambda rule: F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))
    return reduce(
        lambda rest, rule: F.when(rule.fits(host, path), said(rule)).otherwise(rest),
        reversed(ordered),
        F.lit(None).cast(kind),
    )


def lexical(url: str) -> list[float]:
    """The values of ``LEXICAL`` for one URL."""
    raw = url.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=1) if raw else np.zeros(1)
    share = counts[counts > 0] / max(1, len(raw))
    rest = url.partition("://")[2] or url
    before, _, fragment = rest.partition("#")
    address, _, query = before.partition("?")
    host, _, path = address.partition("/")
    digits = sum(c.isdigit() for c in url)
    return [
        float(x)
        for x in (
            len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / max(1, len(url)),
            max((len(run) for run in re.findall(r"[0-9]+", url)), default=0), -(share * np.log2(share)).sum(),
            url.count("-"), len(query.split("&")) if query else 0, len(query), len(fragment) > 0,
            max(map(len, re.split(r"[./?&=#-]", rest))),
        )
    ]


def with_features(urls: DataFrame) -> DataFrame:
    """``row`` (the columns of ``urls``, among them ``url`` and ``host``) and its features."""

    def work(rows: pa.RecordBatch) -> list[dict]:
        return [dict(zip(LEXICAL, lexical(url))) for url in texts_of(rows.column("url"))]

    found = add_struct(urls, work, T.StructType([T.StructField(c, T.DoubleType()) for c in LEXICAL]))
    suffix = [F.substring_index("row.host", ".", -(n + 1)).alias(f"suffix_{n}") for n in range(SUFFIXES)]
    return found.select("row", "out.*", *suffix)


def _with_suffix_statistics(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """For each host suffix how often labelled URLs below it were blocked, and how many they are.

    Suffixes are counted before the exchange; the join has one row per suffix on one side, so
    a suffix that most URLs share can be split on the other.
    """
    for n in range(SUFFIXES):
        name = f"suffix_{n}"
        stats = labelled.groupBy(name).agg(
            F.log1p(F.count("*")).alias(f"seen_{n}"),
            ((F.sum("label") + PRIOR / 2) / (F.count("*") + PRIOR)).alias(f"blocked_{n}"),
        )
        rows = rows.join(stats, name, "left").fillna({f"seen_{n}": 0.0, f"blocked_{n}": 0.5})
    return rows


def _fitted(rows: DataFrame, names: list[str], train_rows: int) -> GBTClassificationModel:
    """Trees from about ``train_rows`` labelled URLs, chosen by the hash of the URL."""
    steps = 1 << 30
    share = int(steps * min(1.0, train_rows / max(1, rows.count())))
    place = F.pmod(F.xxhash64("row.url", "row.page_id"), F.lit(steps))
    sample = VectorAssembler(inputCols=names, outputCol="features").transform(rows.filter(place < share))
    path = fresh_dir(rows.sparkSession, "url-sample")
    sample.select("features", "label").coalesce(8).write.parquet(path)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=64)
    return learner.fit(rows.sparkSession.read.parquet(path))


def judge(pages: DataFrame, rules: list[Rule], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for every row of ``pages``."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    told = split.withColumn("rule", ruled(rules, F.col("host"), F.col("path")))
    place = fresh_dir(spark, "urls")
    with_features(told).write.parquet(place)
    rows = spark.read.parquet(place).withColumn("label", (F.col("row.rule.verdict") == "block").cast("double"))
    labelled = rows.filter("label IS NOT NULL")
    known = [row["label"] for row in labelled.select("label").distinct().collect()]
    if len(known) < 2:
        own = F.lit("block" if known == [1.0] else "allow")
    else:
        full = _with_suffix_statistics(rows, labelled)
        names = [*LEXICAL, *(f"{kind}_{n}" for n in range(SUFFIXES) for kind in ("seen", "blocked"))]
        model = _fitted(full.filter("label IS NOT NULL"), names, train_rows)
        rows = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(full))
        own = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return rows.select(
        "row.page_id",
        "row.host",
        "row.path",
        F.col("row.rule.pattern").alias("rule"),
        F.coalesce(F.col("row.rule.verdict"), own).alias("verdict"),
    )
