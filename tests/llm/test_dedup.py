"""Removal of repeated bytes, exact and near copies, next to brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_dedup, substring_dedup
from millrace.llm.near_dedup import common_counts, registers_of, shingle_sets
from millrace.scratch import fresh_dir

DOCS = "doc_id long, text string, row string, `out` string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(*r, f"r{i}", "o") for i, r in enumerate(rows)], DOCS).repartition(3)


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(9)}" for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = text(rng, 40)
    rows = []
    for i in range(60):
        body = text(rng, rng.randrange(0, 60))
        if i % 3 == 0:
            body = f"{body} {shared} {text(rng, 5)}"
        rows.append((i, body))
    rows += [(60, rows[0][1]), (61, rows[0][1]), (62, None), (63, ""), (64, "ab" * 300), (65, "é" * 200), (66, "x")]
    rows += [(67, f"{shared[:150]}é{shared[:150]}"), (68, shared[:99]), (69, shared[3:110])]
    return rows


def brute_removed(rows, span):
    seen, out = set(), []
    for doc_id, body in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (body or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - span + 1):
            gram = raw[s : s + span]
            if gram in seen:
                covered[s : s + span] = b"\1" * span
            seen.add(gram)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((doc_id, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_of_a_long_span(spark):
    rng = random.Random(3)
    rows = [(i, bytes(rng.choices(b"abcdefgh", k=3000)).decode()) for i in range(12)]
    rows += [(100 + i, f"{i}{rows[i][1][i : 1500 + i]}{i}") for i in range(12)]
    rows += [(200, "z" * 2000), (201, "z" * 399), (202, "z" * 400)]
    got = substring_dedup.deduplicate(frame(spark, rows), span=400).collect()
    assert sorted(map(tuple, got)) == brute_removed(rows, 400)


@pytest.mark.parametrize("options", [{}, {"hot_cells": 2, "shard_bytes": 2000, "small_rows": 0}])
def test_repeated_bytes(spark, options):
    rows = corpus(1)
    got = substring_dedup.deduplicate(frame(spark, rows), **options).collect()
    assert sorted(map(tuple, got)) == brute_removed(rows, 100)


def test_repeated_bytes_of_repeated_and_missing_ids(spark):
    body = text(random.Random(5), 60)
    rows = [(None, body), (1, body), (1, body), (1, "short"), (2, body[7:])]
    got = sorted(map(tuple, substring_dedup.deduplicate(frame(spark, rows)).collect()), key=repr)
    whole = len(body.encode())
    assert sum(r[0] == 1 and r[2] == 0 and r[1] == whole for r in got) == 1
    assert sum(r[2] == r[1] == whole for r in got) == 2 and len(got) == 5
    empty = frame(spark, rows).limit(0)
    assert substring_dedup.deduplicate(empty).count() == 0


def test_long_texts_are_cut_into_windows(spark):
    rng = random.Random(2)
    shared = text(rng, 60, 10_000)
    long = " ".join(f"{rng.random()}" for _ in range(90_000))
    assert len(long) > substring_dedup.WINDOW
    cut = substring_dedup.WINDOW - 120
    rows = [(1, shared), (2, long[:cut] + shared + long[cut:])]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(frame(spark, rows)).collect()}
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (len(shared), 1)
    assert got[2]["kept_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def folded(body):
    return re.sub(r"[\x20\x09-\x0D]+", " ", body or "")


COPIES = [
    (5, "a  b"), (3, "a\tb"), (4, "a b "), (9, None), (8, ""), (7, " "), (2, "\x0b"), (1, "x" * 100_000),
    (6, "x" * 100_000), (3, "a b"), (None, "a\n\nb"), (11, "a\u00a0b"),
]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda text: F.pmod(F.length(text), F.lit(2)).cast("string")])
def test_exact_copies(spark, digest):
    """With a digest that nearly all texts share, the bytes decide."""
    path = fresh_dir(spark, "docs")
    frame(spark, COPIES).write.parquet(path)
    got = exact_dedup.decide(spark, path, digest=digest, batch_bytes=1).collect()
    groups = {}
    for doc_id, body in COPIES:
        groups.setdefault(folded(body), []).append(doc_id)
    assert len(got) == len(COPIES)
    for row in got:
        (ids,) = [g for t, g in groups.items() if row["doc_id"] in g and len(g) == row["group_size"]][:1]
        assert row["keep_id"] == min(i for i in ids if i is not None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and sorted(r["keep_id"] for r in kept) == sorted(r["doc_id"] for r in kept)
    assert {r["text_sha256"] for r in got} >= {hashlib.sha256(t.encode()).hexdigest() for t in groups} - (
        set() if digest is exact_dedup.sha256_hex else {None}
    )


def test_a_restarted_stream_goes_on(spark):
    path, work = fresh_dir(spark, "docs"), fresh_dir(spark, "work")
    frame(spark, COPIES[:4]).write.parquet(path)
    exact_dedup.run_stream(spark, path, work)
    frame(spark, COPIES[4:]).write.mode("append").parquet(path)
    entries = exact_dedup.run_stream(spark, path, work)
    assert entries.count() == len({folded(t) for _, t in COPIES})
    assert entries.agg(F.sum("n")).first()[0] == len(COPIES)


def test_exact_copies_of_rows(spark):
    docs = frame(spark, COPIES)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len({folded(t) for _, t in COPIES})
    assert exact_dedup.kept_rows(docs.limit(0)).count() == 0


def shingles(body, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_groups(rows, size, percent):
    sets = [(i, shingles(body, size)) for i, body in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def near_corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(12):
        base = text(rng, rng.choice([1, 2, 3, 6, 12, 80, 200])).split()
        rows.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy))
    chain = text(rng, 60).split()
    for i in range(12):  # each is near the next, the ends are far apart
        rows.append(" ".join(chain[: 60 - 2 * i] + [f"c{j}" for j in range(2 * i)]))
    rows += [None, "", "  ", "Word", "word", "word word", "Word WORD"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], body) for i, body in enumerate(rows)]


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 5)])
def test_near_copies(spark, seed, size):
    rows = near_corpus(seed)
    got = near_dedup.groups(frame(spark, rows), size, 80, block_rows=2, small_rows=0)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute_groups(rows, size, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_copies_of_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "z y x w v"), (3, None)]
    docs = frame(spark, rows)
    kept = near_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2, 3]
    assert near_dedup.kept_rows(docs.limit(0)).count() == 0


def test_a_hot_group_of_near_copies(spark):
    rng = random.Random(4)
    base = text(rng, 120).split()
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(200)]
    rows += [(1000 + i, text(rng, 100)) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(frame(spark, rows), 2, 80).collect()}
    assert all(got[i] == (0 if i < 1000 else i) for i, _ in rows)


def test_a_family_below_the_threshold(spark):
    """Documents that share 70 in 100 are one cluster by their sketches; only real links are told."""
    rng = random.Random(8)
    base = text(rng, 140, 5000).split()
    rows = [(i, " ".join(base + text(rng, 42, 10**6).split())) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more words") for i in range(0, 300, 3)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(frame(spark, rows), 2, 80, block_rows=8).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(3)
    sets = {}
    for i in range(120):
        known = rng.choice(list(sets.values())) if sets and rng.random() < 0.8 else set()
        kept = set(rng.sample(sorted(known), k=len(known) * rng.randrange(80, 101) // 100)) if known else set()
        sets[i] = kept | {rng.randrange(10**6) for _ in range(rng.randrange(1, 12) if known else rng.randrange(5, 60))}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    stored = [(i, np.array(sorted(s), np.int64).tobytes()) for i, s in sets.items()]
    spark.createDataFrame(stored, near_dedup.SETS).write.parquet(path := fresh_dir(spark, "sets"))
    clustered = spark.createDataFrame([(7, i, i) for i in sets], "key long, node long, component long")
    clustered = clustered.withColumn("component", F.col("node"))
    for block_rows in (2, 256):
        pairs = near_dedup._within(clustered, spark.read.parquet(path), block_rows, 80, fresh_dir(spark, "within"))
        assert {(min(r), max(r)) for r in pairs.collect()} == links and len(links) > 10
    alike = near_dedup._prefixes(clustered.join(spark.read.parquet(path), "node"), 80, fresh_dir(spark, "prefixes"))
    found = {r["node"] for r in alike.collect()}
    assert {i for pair in links for i in pair} <= found and len(found) < len(sets)
    joined = clustered.withColumn("component", F.lit(1))
    assert near_dedup._within(joined, spark.read.parquet(path), 2, 80, fresh_dir(spark, "within")).count() == 0


def test_zero_bytes_belong_to_words():
    bodies = ["a\0 b a\x01 b", "a\0 b a\0 b", "\0 \x01 \0", "\0", "\x01", "x\0y xy x\x01y", "a\0", "a"]
    sets = shingle_sets([b.encode() for b in bodies], 2)
    assert [len(s) for s in sets] == [len(shingles(b, 2)) for b in bodies]
    for a, x in zip(bodies, sets):
        for b, y in zip(bodies, sets):
            assert len(set(x.tolist()) & set(y.tolist())) == len(shingles(a, 2) & shingles(b, 2))


@pytest.mark.parametrize("percent", [0, 50, 79, 101])
@pytest.mark.parametrize("operator", [near_dedup.groups, near_dedup.kept_rows])
def test_a_percent_that_bands_are_not_made_for_is_refused(spark, operator, percent):
    with pytest.raises(ValueError, match=f"not at {percent}"):
        operator(frame(spark, [(1, "a b c"), (2, "a b d")]), 2, percent)


def test_sketches_agree_with_sets():
    rng = random.Random(6)
    bodies = [text(rng, n).encode() for n in (1, 5, 50, 500)]
    sets = shingle_sets(bodies, 2)
    assert [len(s) for s in sets] == [len(shingles(b.decode(), 2)) for b in bodies]
    assert (registers_of(sets) == registers_of(shingle_sets(bodies, 2))).all()
    assert common_counts(sets, sets).diagonal().tolist() == [len(s) for s in sets]
