"""License scans, importance resampling and the Merkle manifest, next to brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import license_scan, manifest, resampling
from millrace.llm.spans import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `out` string, row string, id string, key string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with what operators add."""
    more = [(*r, "s", len(r[1] or ""), "o", f"r{i}", "i", "k") for i, r in enumerate(rows)]
    return spark.createDataFrame(more, DOCS).repartition(3)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


# --- license scans


def brute_scan(text, templates=license_scan.TEMPLATES, percent=license_scan.PERCENT):
    found = words(text)
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        wanted = phrase.split()
        at = [i for i in range(len(found)) if found[i : i + len(wanted)] == wanted]
        places += at
        base |= {label} if at else set()
    method, share = set(), 0.0
    known = [(e, {w.decode() for w in e.words}) for e in license_scan.entries(templates, percent)]
    for size in {e.size for e, _ in known}:
        for low in range(0, len(found), size):
            block, met = set(found[low : low + 2 * size]), []
            for e, wanted in known:
                common = len(block & wanted)
                if e.size == size and common >= e.needed:
                    met.append((common / len(e.words), common, e.label))
            if met:
                best = max(m[:2] for m in met)
                method |= {label for *key, label in met if tuple(key) == best}
                share = max(share, best[0])
    ends = (min(places), max(places)) if places else (None, None)
    labels = ",".join(sorted(base | method))
    return len(found), len(places), *ends, ",".join(sorted(base)), labels, 1.0 if places else share


def license_rows():
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(50)] + ["the", "of", "License", "software", "version", "in", "or", "copyright", "notice"]

    def prose(n):
        return " ".join(rng.choices(filler, k=n))

    rows = []
    for i, template in enumerate(license_scan.TEMPLATES * 2):
        parts = template.text.split(" ")
        lost = set(rng.sample(range(len(parts)), k=len(parts) * rng.randrange(0, 30) // 100))
        notice = " ".join(p for j, p in enumerate(parts) if j not in lost)
        rows.append((i, f"{prose(rng.randrange(70))}\n{notice}. {prose(rng.randrange(70))}", "en"))
    rows += [(100, None, None), (101, "", "en"), (102, "?!", "en"), (103, "CC-BY cc by; MIT\nLicense Apache license", "en")]
    rows += [(104, "gnu general public license " * 3, "en"), (104, "gnu general public license " * 3, "en")]
    rows += [(None, "Released under the GPL license.", "en"), (105, prose(30000) + license_scan.TEMPLATES[0].text, "en")]
    return rows


@pytest.mark.parametrize("percent", [80, 60])
def test_license_scan(spark, percent):
    rows = license_rows()
    got = license_scan.report(*license_scan.scan(frame(spark, rows), percent=percent)).collect()
    wanted = [(i, *brute_scan(text, percent=percent)) for i, text, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert sum(r.labels != r.base_labels for r in got) > 20


def test_license_scan_of_other_templates(spark):
    rows = [(1, "alpha beta gamma delta", "en"), (2, "delta gamma", "en"), (3, None, None)]
    made = [license_scan.Template("greek", "Alpha, beta, gamma, delta", 50), license_scan.Template("none", "...")]
    made.append(license_scan.Template("twin", "delta gamma beta alpha", 50))
    documents, kept = license_scan.scan(frame(spark, rows), {}, made)
    assert sorted((r.row.doc_id, r.row.id, r.labels, r.score) for r in license_scan.labelled(documents, kept).collect()) == [
        (1, "i", ["greek", "twin"], 1.0), (2, "i", ["greek", "twin"], 0.5), (3, "i", [], 0.0)]
    assert license_scan.report(*license_scan.scan(frame(spark, rows).limit(0))).count() == 0
    assert license_scan.report(*license_scan.scan(frame(spark, rows), {}, [])).count() == 3
    with pytest.raises(ValueError):
        license_scan.entries([license_scan.Template("x", "a " * license_scan.TEMPLATE_BYTES)])


# --- importance resampling


def grams(text):
    found = words(text)
    return [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute_draw(rows, target, percent=5):
    own, wanted = (Counter(bucket(f) for text in texts for f in grams(text)) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(own.values()) + 10000, sum(wanted.values()) + 10000
    out = []
    for doc_id, text, _ in rows:
        found = grams(text)
        weight = sum(
            math.floor(1000 * math.log((wanted[b] + 1.0) * s_all / ((own[b] + 1.0) * t_all))) for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words(text))])
    eligible = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(n=260):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(400)] + ["É", "ünd", "x" * 1500, "日本"]
    rows = [(i, " , ".join(rng.choices(pool, k=rng.randrange(60))), "en") for i in range(n)]
    rows += [(900, None, None), (901, "", "en"), (902, "one", "en"), (903, "one two", "en"), (None, rows[1][1] + " a b" * 20, "en")]
    rows += [(905, rows[3][1] + " z" * 30, "de")] * 2 + [(906, " ".join(rng.choices(pool, k=30000)), "en")]
    return rows, [" ".join(rng.choices(pool[:80], k=30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("percent", [5, 60])
def test_draw(spark, percent):
    rows, target = corpus()
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.report(resampling.draw(frame(spark, rows), items, percent)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_draw(rows, target, percent)
    drawn = resampling.drawn_rows(frame(spark, rows), items, percent=percent)
    assert drawn.columns == frame(spark, rows).columns
    unique = [r.doc_id for r in drawn.collect() if r.doc_id != 905]
    assert sorted(map(repr, unique)) == sorted(repr(r.doc_id) for r in got if r["rank"] and r.doc_id != 905)


def test_draw_of_empty_tables(spark):
    rows, target = corpus(5)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.draw(frame(spark, rows).limit(0), items).count() == 0
    got = resampling.report(resampling.draw(frame(spark, rows), items.limit(0))).collect()
    assert sorted(map(tuple, got), key=repr) == brute_draw(rows, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1é日 .\n", max_size=60), max_size=6), st.integers(1, 9))
def test_buckets(texts, size):
    before, resampling.SLICE = resampling.SLICE, size
    try:
        found = Counter()
        for _, values in resampling.buckets(Words([t.encode() for t in texts], resampling.WORD_TABLE)):
            found.update(values.tolist())
    finally:
        resampling.SLICE = before
    assert found == Counter(bucket(f) for t in texts for f in grams(t))


def test_crcs_of_long_and_short_spans():
    raw = random.Random(1).randbytes(5000)
    spans = [(1, 1), (5, 1), (7, 1024), (9, 1025), (100, 4900), (3, 17), (4, 17)]
    got = resampling.span_crcs(np.frombuffer(raw, np.uint8), *np.array(spans).T)
    assert got.tolist() == [zlib.crc32(raw[s : s + n]) for s, n in spans]


def test_words_that_share_a_hash():
    buf = np.frombuffer(b"ab cd ab ", np.uint8)
    numbers = resampling.word_numbers(buf, np.array([0, 3, 6]), np.array([2, 2, 2]), np.zeros(3, np.uint64))
    assert numbers.tolist() == [0, 1, 0]


# --- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    values = (row[0], "s", row[2], len(row[1] or ""), text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, at, node):
    """Top of a tree, siblings of leaf ``at`` from below, and the top when that leaf is ``node``."""
    proof = []
    while len(level) > 1:
        low = at // 8 * 8
        run = level[low : low + 8]
        proof += run[: at - low] + run[at - low + 1 :]
        node = digest(*run[: at - low], node, *run[at - low + 1 :])
        level, at = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)], at // 8
    return level[0], proof, node


def brute_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, brute_leaf(row, row[1]), row))
    langs = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: sorted(trees[lang], key=lambda leaf: leaf[:3]) for lang in langs}
    levels = {lang: [leaf[2] for leaf in trees[lang]] for lang in langs}
    subroots = [climb(levels[lang], 0, "")[0] for lang in langs]
    out = []
    for number, lang in enumerate(langs):
        for at, (_, _, leaf, row) in enumerate(trees[lang]):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            subroot, low, node = climb(levels[lang], at, brute_leaf(row, text))
            root, high, node = climb(subroots, number, node)
            out.append((row[0], leaf, subroot, root, digest(*low, *high), node, node == root))
    return sorted(out, key=repr)


def audited(docs, depth=manifest.DEPTH):
    built = manifest.Manifest.build(docs, manifest.lowered_every_third(), depth)
    return sorted(map(tuple, built.audit().collect()), key=repr)


@pytest.mark.parametrize("depth", [manifest.DEPTH, 1])
def test_manifest(spark, depth):  # with superblocks of 8 the small trees take several rounds
    rng = random.Random(2)
    rows = [(i, rng.choice("Ab") * rng.randrange(9), "en") for i in range(75)]
    rows += [(100 + i, "É Text", "de") for i in range(9)] + [(200, "Lone", "é"), (201, None, None), (202, "", None)]
    rows += [(203, "X", "en")] * 3 + [(None, "A", "en"), (None, None, "en"), (204, "Z", ""), (205, "Long " * 30000, "zz")]
    rows += [(300 + i, "Y", f"l{i}") for i in range(6)]
    assert audited(frame(spark, rows), depth) == brute_manifest(rows)


def test_small_manifests(spark):
    rows = [(7, "One", "en")]
    assert audited(frame(spark, rows)) == brute_manifest(rows)
    built = manifest.Manifest.build(frame(spark, rows).limit(0), F.lit(None).cast("string"))
    assert built.audit().count() == 0 and built.root().count() == 0


def test_manifest_without_tampering(spark):
    rows = [(2**53 + i, "Text", "en") for i in range(20)] + [(None, "Text", "en")]
    built = manifest.Manifest.build(frame(spark, rows), F.lit(None).cast("string"))
    got = built.audit().collect()
    assert all(r.verified for r in got) and {r.doc_id for r in got} == {r[0] for r in rows}
