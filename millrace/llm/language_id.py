"""Language identification by interpolated Kneser-Ney character models.

A model per language gives the probability of each letter or word boundary after the three
before it: discounted counts at the highest order, continuation counts below, each order
interpolated with the next.  The tables of an order are arrays sorted by the hash of the
character run, one probability per language and run.  A text's language is the one with the
lowest cross-entropy per character.

The models are fitted on about ``docs_per_lang`` labelled documents of each language, chosen by
the hash of their ids; a fifth of them is set aside and gives, by length, the cross-entropy that
labelled texts stay under.  A text beyond that limit is rejected.

Defined cases: a text that is null, empty or without a letter is ``und``, scores 0 and is
rejected; equal cross-entropies go to the language first in order; without labelled documents
every text is ``und``; a null ``doc_id`` is neither held out nor learned from; other columns
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.rows import add_struct, chunks, texts_of
from millrace.llm.spans import mixed

ORDER = 4
DOCS_PER_LANG = 2_000
CALIBRATION = 5
SLACK = 1.4
SURE_CHARS = 40
UNKNOWN = "und"
LOWER_BITS = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]

OUT = "lang string, score double, entropy double, n_letters bigint, accepted boolean"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """For each code point its lower-case letter in 16 bits, 0 for anything else."""
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[point] = low if low < 0xE000 else 0xE000 + low % 0x1900
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one 0 between words, and where each text starts.

    A text that has letters ends with a 0; one that has none is a 0.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = "\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    codes = _symbols()[np.frombuffer(raw, np.uint32)]
    starts = np.cumsum(sizes) - sizes
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    total = np.concatenate(([0], np.cumsum(keep)))
    bare = total[starts + sizes] == total[starts]
    keep[(starts + sizes - 1)[bare]] = True
    return codes[keep], (np.cumsum(keep) - keep)[starts]


def runs(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each symbol the ``ORDER`` symbols that end with it; before a text stand zeros."""
    out = codes.astype(np.uint64)
    for back in range(1, ORDER):
        earlier = np.zeros(len(codes), np.uint64)
        earlier[back:] = codes[:-back]
        for j in range(back):
            at = starts + j
            earlier[at[at < len(codes)]] = 0
        out |= earlier << np.uint64(16 * back)
    return out


@dataclass
class Table:
    """Rows found by the hash of a run of symbols; ``rest`` for a run that is not there."""

    hashes: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        h = mixed(keys)
        order = np.argsort(h)
        return Table(h[order], values[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each run, -1 if there is none."""
        h = mixed(keys)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1) if len(self.hashes) else np.full(len(h), -1)


@dataclass
class Models:
    langs: list[str]
    probabilities: list[Table]  # by order, of runs seen in any language
    backoffs: list[Table]  # by order, of contexts seen in any language
    unseen: np.ndarray  # of a symbol that no language has
    limits: np.ndarray | None = None

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The probability of each run's last symbol after the others, a column per language."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(keys), len(self.langs)))
        table = self.probabilities[order]
        at = table.find(keys)
        out = table.values[at] if len(table.values) else np.ones((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lower = self.probability(keys[miss] & LOWER_BITS[order - 1], order - 1)
            context = self.backoffs[order]
            where = context.find(keys[miss] >> np.uint64(16))
            weight = context.values[where] if len(context.values) else np.ones_like(lower)
            out[miss] = np.where((where >= 0)[:, None], weight, 1) * lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text under each language, and the number of its letters."""
        codes, starts = symbols(texts)
        bits = -np.log2(self.probability(runs(codes, starts)))
        size = np.diff(np.append(starts, len(codes)))
        letters = np.add.reduceat((codes != 0).astype(np.int64), starts)
        return np.add.reduceat(bits.astype(np.float64), starts, axis=0) / size[:, None], letters

    def judge(self, texts: list[str]) -> list[dict]:
        nothing = {"lang": UNKNOWN, "score": 0.0, "entropy": None, "n_letters": 0, "accepted": False}
        if not texts or not self.langs:
            return [nothing] * len(texts)
        bits, letters = self.entropies(texts)
        best = bits.argmin(1)
        lowest = bits[np.arange(len(texts)), best]
        weight = np.exp2(-(bits - lowest[:, None]) * np.minimum(letters, SURE_CHARS)[:, None])
        score = 1 / weight.sum(1)
        fine = lowest <= self.limits[np.log2(np.maximum(letters, 1)).astype(int)]
        return [
            {"lang": self.langs[b], "score": s, "entropy": h, "n_letters": n, "accepted": ok}
            if n
            else nothing
            for b, s, h, n, ok in zip(best.tolist(), score.tolist(), lowest.tolist(), letters.tolist(), fine.tolist())
        ]


def fit(langs: list[str], keys: np.ndarray, counts: np.ndarray) -> Models:
    """Models from the counts of the highest order: ``counts[i, l]`` of run ``keys[i]``."""
    by_order = {ORDER: (keys, counts.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols stand before
        above, n = by_order[order + 1]
        lower, group = np.unique(above & LOWER_BITS[order], return_inverse=True)
        kinds = np.zeros((len(lower), len(langs)))
        np.add.at(kinds, group, n > 0)
        by_order[order] = (lower, kinds)
    vocabulary = len(by_order[1][0]) + 1
    empty = Table(np.empty(0, np.uint64), np.empty((0, len(langs)), np.float32))
    models = Models(langs, [empty], [empty], np.full(len(langs), 1 / vocabulary, np.float32))
    for order in range(1, ORDER + 1):
        keys, n = by_order[order]
        once, twice = (n == 1).sum(0), (n == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        context, group = np.unique(keys >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(context), len(langs))), np.zeros((len(context), len(langs)))
        np.add.at(total, group, n)
        np.add.at(kinds, group, n > 0)
        backoff = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
        lower = models.probability(keys & LOWER_BITS[order - 1], order - 1)
        own = np.maximum(n - discount, 0) / np.maximum(total[group], 1)
        models.probabilities.append(Table.of(keys, (own + backoff[group] * lower).astype(np.float32)))
        models.backoffs.append(Table.of(context, backoff.astype(np.float32)))
    return models


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a quarter of all, by its id."""
    part = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(part == 2, F.lit(False))


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Models:
    """Models and limits from the documents that are not held out."""
    labelled = docs.select("doc_id", "text", "lang").filter(
        ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    found = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return Models([], [], [], np.empty(0, np.float32))
    steps = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(steps))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(steps * min(1, docs_per_lang / found[lang])))])
    sample = labelled.withColumn("_place", place).filter(F.col("_place") < share[F.col("lang")])
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(CALIBRATION)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                names = np.array(part.column(1).to_pylist(), object)
                texts = texts_of(part.column(0))
                for lang in sorted(set(names)):
                    codes, starts = symbols([texts[i] for i in np.flatnonzero(names == lang)])
                    keys, n = np.unique(runs(codes, starts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "run", "n"]
                    )

    counted = sample.filter(~aside).select("text", "lang").mapInArrow(count, "lang string, run bigint, n bigint")
    rows = counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    keys, group = np.unique(rows["run"].to_numpy().view(np.uint64), return_inverse=True)
    number = np.searchsorted(langs, np.array(rows["lang"].to_pylist(), str)) if len(group) else np.empty(0, int)
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (group, number), rows["n"].to_numpy())
    models = fit(langs, keys, counts)
    models.limits = np.full(64, np.inf)
    judged = _judged(sample.filter(aside).select("text"), models).select("out.entropy", "out.n_letters")
    size = F.floor(F.log2("n_letters"))
    most = judged.filter("n_letters > 0").groupBy(size.alias("size")).agg(F.max("entropy").alias("most"))
    known = sorted((row["size"], row["most"]) for row in most.collect())
    limits = np.full(64, np.inf)
    for step, _ in known:  # shorter texts vary more, so a limit holds for all longer ones
        limits[step:] = SLACK * max(worst for at, worst in known if at >= step)
    models.limits = limits
    return models


def _judged(docs: DataFrame, models: Models) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(rows: pa.RecordBatch) -> list[dict]:
        return shared.value.judge(texts_of(rows.column("text")))

    return add_struct(docs, work, T.StructType.fromDDL(OUT))


def identify(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """``row`` (the columns of ``docs``) and ``out``, described by ``OUT``.

    Only ``text`` takes part in a judgement.
    """
    return _judged(docs, learn(docs, docs_per_lang))


def accepted_rows(docs: DataFrame) -> DataFrame:
    """``docs`` without those that no language accepts, all columns as they were."""
    return identify(docs).filter("out.accepted").select("row.*")
