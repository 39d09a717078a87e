"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words that a license notice is made of.  A template of ``n`` distinct words
has the size class of the next power of two; texts are cut into blocks of two such sizes that
overlap by one, so any run of words of a template's size lies within a block.  A block meets a
template if it holds at least the template's threshold of its words.

Words are ordered by their number of occurrences in all texts, rarest first.  Of a template that
must share ``o`` of its ``n`` words with a block, the first ``n - o + 1`` are its prefix, and the first
common word lies in the prefixes of both (prefix filter).  A block with fewer than ``o`` words of any
template is out (length filter), and so is a pair whose first common word leaves fewer than
``o - 1`` words behind it on either side (positional filter).  Blocks without a prefix word are never
built; the pairs that pass are a Spark join on that word, and are then decided on their full sets.

Besides the blocks, fixed phrases are found wherever their words stand consecutively.

Templates and phrases are a stated set of at most ``TEMPLATE_BYTES``; more is an error, so what tasks
are sent is bounded.  Nothing is limited by documents: all blocks of whole texts are looked at.

Defined cases: a null or empty text, or one without words, has no places, labels or blocks and score
0; a template without words matches nothing; equal templates with two labels give both; repeated
rows and ids are rows of their own; an empty table gives no rows; other columns pass through
untouched.  Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.ranking import stored
from millrace.llm.rows import add_struct, bytes_of, map_parts
from millrace.llm.spans import Words, fold_table, gram_hashes
from millrace.scratch import fresh_dir
from millrace.sources.rows import literal_rows

PERCENT = 80
SHORT = 10  # templates of fewer distinct words must be there whole
LEAST_CLASS = 8
TEMPLATE_BYTES = 8 << 20

WORD_TABLE = fold_table(lambda b: b >= 128 or chr(b).isalnum())

OUT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
    "blocks array<struct<class: int, block: bigint, words: array<int>>>"
)


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for, and the percent of its distinct words a block must hold."""

    label: str
    text: str
    percent: int | None = None


# Notices that licenses ask to be attached, and phrases naming them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    Template(
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 100),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", 100),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
    ),
    Template("mit", "released under the MIT License"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    Template("cc-by-4.0", "licensed under CC BY 4.0"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    Template("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    Template("all-rights-reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Entry:
    """A template's distinct words, the number of them a block must hold, and its size class."""

    number: int
    label: str
    words: tuple[bytes, ...]
    needed: int
    size: int


def entries(templates: Sequence[Template], percent: int = PERCENT) -> list[Entry]:
    if sum(len(t.text) for t in templates) > TEMPLATE_BYTES:
        raise ValueError(f"templates hold more than {TEMPLATE_BYTES} characters")
    out = []
    for number, template in enumerate(templates):
        found = Words([template.text.encode()], WORD_TABLE)
        words = tuple(dict.fromkeys(found.joined(i, 1) for i in range(len(found.starts))))
        if not words:
            continue
        share = template.percent or (100 if len(words) < SHORT else percent)
        size = max(LEAST_CLASS, 1 << (len(words) - 1).bit_length())
        out.append(Entry(number, template.label, words, -(-len(words) * share // 100), size))
    return out


class Vocabulary:
    """The words of all templates, found among words by their hashes and confirmed by their bytes."""

    def __init__(self, words: Sequence[bytes]) -> None:
        hashes = Words(list(words), WORD_TABLE).hashes
        self.order = np.argsort(hashes)
        self.hashes, self.words = hashes[self.order], list(words)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are of the vocabulary, and their numbers in it."""
        at = np.searchsorted(self.hashes, words.hashes)
        at[at == len(self.hashes)] = 0
        places = np.flatnonzero(self.hashes[at] == words.hashes)
        return places, self.order[at[places]]


def frequencies(docs: DataFrame, words: Sequence[bytes]) -> np.ndarray:
    """How often each of ``words`` occurs in all texts."""
    if not words:
        return np.zeros(0, np.int64)
    vocabulary = Vocabulary(words)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, numbers = vocabulary.find(Words(bytes_of(part.column(0)), WORD_TABLE))
        total = np.bincount(numbers, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], ["word", "n"])

    schema = T.StructType.fromDDL("word bigint, n bigint")
    counted = map_parts(docs.select("text"), run, schema).groupBy("word").agg(F.sum("n").alias("n"))
    total = np.zeros(len(words), np.int64)
    for word, n in counted.collect():  # one row a word of the templates
        total[word] = n
    return total


def phrase_places(words: Words, phrases: dict[bytes, str]) -> list[tuple[int, bytes]]:
    """First word and phrase of every place where a phrase's words stand consecutively."""
    out, ends = [], words.ends_of_texts
    sizes: dict[int, list[bytes]] = {}
    for phrase in phrases:
        sizes.setdefault(phrase.count(b" ") + 1, []).append(phrase)
    for size, wanted in sizes.items():
        known = [gram_hashes(Words([phrase], WORD_TABLE).hashes, size)[0] for phrase in wanted]
        for at in np.flatnonzero(np.isin(gram_hashes(words.hashes, size), known)).tolist():
            if at + size <= ends[at] and (phrase := words.joined(at, size)) in phrases:
                out.append((at, phrase))
    return sorted(out)


def _blocks(words: Words, vocabulary: Vocabulary, ranks: np.ndarray, classes: dict) -> Iterator[tuple]:
    """Text, class, block and ordered template words of the blocks that may meet a template.

    ``classes`` gives for each class the words of its templates, their prefixes, and the least
    number of words a block must hold.
    """
    places, numbers = vocabulary.find(words)
    texts = np.searchsorted(words.first + words.counts, places, "right")
    offsets = places - words.first[texts]
    for size, (members, prefix, least) in classes.items():
        own = members[numbers]
        at, rank, text = offsets[own], ranks[numbers[own]], texts[own]
        place, number = places[own], numbers[own]
        cell = at // size
        marked = prefix[number]
        wanted = np.stack([np.tile(text[marked], 2), np.concatenate([cell[marked], cell[marked] - 1])])
        wanted = np.unique(wanted[:, wanted[1] >= 0], axis=1)
        keys = np.stack([text, cell])
        low = _lower(keys, wanted)
        high = _lower(keys, wanted + np.array([[0], [2]]))
        for (doc, block), start, end in zip(wanted.T.tolist(), low.tolist(), high.tolist()):
            if len(np.unique(rank[start:end])) < least:
                continue
            span = zip(place[start:end].tolist(), number[start:end].tolist(), rank[start:end].tolist())
            # Words that only share a hash are left out.
            held = sorted({r for p, w, r in span if words.joined(p, 1) == vocabulary.words[w]})
            if len(held) >= least:
                yield doc, size, block, held


def _lower(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each (text, cell) of ``wanted`` begins among ``keys``, which are in that order."""
    step = max(int(keys[1].max(initial=0)), int(wanted[1].max(initial=0))) + 1
    return np.searchsorted(keys[0] * step + keys[1], wanted[0] * step + wanted[1])


def scanned(docs: DataFrame, phrases: dict[str, str], known: list[Entry]) -> tuple[DataFrame, dict[bytes, int]]:
    """``row`` (the columns of ``docs``) and ``out`` (``OUT``); and the rank of every template word."""
    vocabulary_words = sorted({word for entry in known for word in entry.words})
    counts = frequencies(docs, vocabulary_words)
    ordered = sorted(range(len(vocabulary_words)), key=lambda i: (counts[i], vocabulary_words[i]))
    ranks = np.empty(len(ordered), np.int64)
    ranks[ordered] = np.arange(len(ordered))
    rank_of = {word: int(rank) for word, rank in zip(vocabulary_words, ranks)}
    vocabulary = Vocabulary(vocabulary_words) if vocabulary_words else None
    classes = {}
    for size in sorted({entry.size for entry in known}):
        own = [entry for entry in known if entry.size == size]
        members, prefix = np.zeros(len(ranks), bool), np.zeros(len(ranks), bool)
        for entry in own:
            numbers = sorted((rank_of[word] for word in entry.words))
            members[[ordered[r] for r in numbers]] = True
            prefix[[ordered[r] for r in numbers[: len(numbers) - entry.needed + 1]]] = True
        classes[size] = members, prefix, min(entry.needed for entry in own)
    named = {phrase.encode(): label for phrase, label in phrases.items()}

    def work(rows: pa.RecordBatch) -> list[dict]:
        words = Words(bytes_of(rows.column("text")), WORD_TABLE)
        out = [
            {"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base": set(), "blocks": []}
            for n in words.counts.tolist()
        ]
        ends = words.first + words.counts
        for at, phrase in phrase_places(words, named):
            text = int(np.searchsorted(ends, at, "right"))
            found, place = out[text], at - int(words.first[text])
            found["n_base"] += 1
            found["first_word"] = place if found["first_word"] is None else found["first_word"]
            found["last_word"] = place
            found["base"].add(named[phrase])
        if vocabulary:
            for text, size, block, held in _blocks(words, vocabulary, ranks, classes):
                out[text]["blocks"].append({"class": size, "block": block, "words": held})
        return [found | {"base": sorted(found["base"])} for found in out]

    return add_struct(docs, work, T.StructType.fromDDL(OUT)), rank_of


def matches(blocks: DataFrame, known: list[Entry], rank_of: dict[bytes, int]) -> DataFrame:
    """``id``, ``size``, ``block``, ``template``, ``label``, ``shared``, ``of`` of every block (``id``, ``size``,
    ``block``, ``words``) and every template that it meets."""
    prefixes, sets = [], []
    for entry in known:
        ordered = sorted(rank_of[word] for word in entry.words)
        sets.append((entry.number, entry.label, ordered))
        for at, word in enumerate(ordered[: len(ordered) - entry.needed + 1]):
            prefixes.append((entry.size, word, len(ordered) - at, entry.number, entry.needed))
    spark = blocks.sparkSession
    prefix = literal_rows(spark, prefixes, "size int, word int, left int, template int, needed int")
    template = literal_rows(spark, sets, "template int, label string, wanted array<int>")
    tokens = blocks.select("*", F.posexplode("words").alias("place", "word"))
    behind = F.least(F.size("words") - F.col("place"), F.col("left"))
    pairs = tokens.join(F.broadcast(prefix), ["size", "word"]).filter(behind >= F.col("needed"))
    pairs = pairs.join(F.broadcast(template), "template")  # both at most TEMPLATE_BYTES of words
    pairs = pairs.withColumn("common", F.array_intersect("words", "wanted"))
    pairs = pairs.filter(F.col("common")[0] == F.col("word"))  # each pair once, at its first common word
    pairs = pairs.withColumn("shared", F.size("common")).filter(F.col("shared") >= F.col("needed"))
    return pairs.select("id", "size", "block", "template", "label", "shared", F.size("wanted").alias("of"))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: Sequence[Template] = TEMPLATES,
    percent: int = PERCENT,
) -> tuple[DataFrame, DataFrame]:
    """Documents and matches.

    Documents: ``id`` (a number of the row's own), ``row`` (the columns of ``docs`` but its text)
    and ``out``.
    Matches are those of ``matches``; a block counts for the templates of which it holds the
    greatest share, and of these for the longest.
    """
    work = fresh_dir(docs.sparkSession, "licenses")
    known = entries(templates, percent)
    found, rank_of = scanned(docs, phrases, known)
    found = found.withColumn("row", F.col("row").dropFields("text"))
    narrow = stored(found.withColumn("id", F.monotonically_increasing_id()), f"{work}/scanned")
    blocks = narrow.select("id", F.explode("out.blocks").alias("b")).select(
        "id", F.col("b.class").alias("size"), "b.block", "b.words"
    )
    met = matches(blocks, known, rank_of)
    share = F.col("shared") / F.col("of")
    best = met.groupBy("id", "size", "block").agg(F.max(F.struct(share, "shared")).alias("best"))
    best = best.select("id", "size", "block", "best.*").toDF("id", "size", "block", "share", "best_shared")
    kept = met.join(best, ["id", "size", "block"])
    kept = kept.filter((share == F.col("share")) & (F.col("shared") == F.col("best_shared")))
    return narrow, kept.drop("best_shared")


def labelled(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """``row``, ``out``, ``labels`` (all, in order) and ``score``: the greatest share of a template's words
    that a block holds, 1 where a phrase stands."""
    method = kept.groupBy("id").agg(F.collect_set("label").alias("method"), F.max("share").alias("share"))
    joined = documents.join(method, "id", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("out.base", F.coalesce("method", none)))
    score = F.when(F.col("out.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("row", "out", every.alias("labels"), score.alias("score"))


def report(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The digest columns, a row per document."""
    return labelled(documents, kept).select(
        "row.doc_id",
        "out.n_words",
        "out.n_base",
        "out.first_word",
        "out.last_word",
        F.concat_ws(",", "out.base").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )
