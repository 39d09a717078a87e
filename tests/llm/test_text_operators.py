"""Decontamination, language, pages, URLs, archives, token files, packing and the pipeline."""

import base64
import hashlib
import html
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import decontamination, language_id, main_text, packing, queries, token_files, url_filter, warc
from millrace.llm.tokens import encoder, vocabulary_path
from millrace.scratch import fresh_dir
from tests.oracle import connection, mismatch

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row string, `out` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, f"r{i}", "o") for i, r in enumerate(rows)], DOCS).repartition(3)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    assert mismatch(queries.QUERIES[name](spark, SF_DIR), connection(SF_DIR), queries.ORACLES[name]) is None


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(docs, items):
    out = {}
    for key, text in docs:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            want = words(item)
            size = min(10, len(want))
            windows = {tuple(want[i : i + size]) for i in range(len(want) - size + 1)} if want else ()
            for i in range(len(own) - size + 1):
                if windows and tuple(own[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names.add("" if name is None else str(name))
        joined = ",".join(sorted(names))
        out[key] = (len(own), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, block_bytes):
    rng = random.Random(1)
    text = lambda n: " ".join(f"W{rng.randrange(30)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 10, 11, 3, 1, 0, 25])] + [(7, None), (None, "Only this"), (8, "...")]
    items.append((0, items[0][1]))
    docs = [(i, text(rng.randrange(40))) for i in range(30)]
    docs += [(100 + i, f"{text(8)}, {(item or '').upper()}! {text(8)}") for i, (_, item) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "!?"), (203, "only  THIS"), (200, None), (204, items[0][1] + " " + items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = decontamination.find(frame(spark, docs), benchmark, block_bytes)
    got = decontamination.report(found).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_hits(docs, items)
    clean = decontamination.clean_rows(frame(spark, docs), benchmark)
    assert clean.columns == ["doc_id", "text", "row", "out"]
    assert clean.count() == sum(not r["contaminated"] for r in got)
    assert decontamination.report(decontamination.find(frame(spark, docs), benchmark.limit(0))).filter("n_hit > 0").count() == 0


def test_every_long_shared_span_has_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(200):
        grams = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        marks = set(decontamination.winnowed(grams, 6).tolist())
        assert all(marks & set(range(i, i + 6)) for i in range(len(grams) - 5))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs)
    held = out.filter(language_id.held_out(F.col("row.doc_id")))
    right = held.filter("out.lang = row.lang").count() / held.count()
    assert right >= 0.97
    assert language_id.accepted_rows(docs).count() >= 0.995 * docs.count()


def test_language_edges(spark):
    train = [(i, t, "xx" if i % 2 else "yy") for i in range(400) for t in ["aba caba abc"] if True]
    train = [(i, ("aba caba abc " if i % 2 else "zzy yzx xyz ") * 3, "xx" if i % 2 else "yy") for i in range(400)]
    rows = [*train, (1000, None, None), (1001, "", "xx"), (1002, "12 !?", "xx"), (1003, "zyz", None), (None, "aba", "yy"), (1003, "zyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.identify(docs).select("row.doc_id", "out.*").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i]["lang"], by[i]["score"], by[i]["accepted"]) == ("und", 0.0, False)
    assert by[1003]["lang"] == "yy" and by[None]["lang"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got)
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang"] for r in none.select("out.lang").collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    codes, starts = language_id.symbols(["abab ba", "bbb a", ""])
    keys, n = np.unique(language_id.runs(codes, starts), return_counts=True)
    models = language_id.fit(["x"], keys, n[:, None].astype(float))
    unseen = 0xFFFF  # stands for all symbols that the texts do not have
    letters = [0, ord("a"), ord("b"), unseen]
    for context in keys >> np.uint64(16):
        total = models.probability(np.array([(int(context) << 16) | c for c in letters], np.uint64)).sum()
        assert abs(total - 1) < 1e-5


PAGE = """<!DOCTYPE html><html lang=en><head><title>t</title><style>p{}</style></head><body class="with-sidebar">
<header><h1>Site name</h1></header><nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies</div>%s
<form><p>Your name please</p></form><aside><p>Other stories of the day</p></aside>
<section class="comments"><p>A reader says a lot of things here</p></section><footer>&copy; f</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="post">%s</div>'])
def test_main_text(wrap):
    body = "<h2>Title &amp; more</h2><p>%s<br>end<p>Short.<div class=ad>Buy</div><ul><li>one<li>two %s</ul>" % (
        "long text " * 30,
        "item text " * 20,
    )
    want = f"Title & more {' '.join(['long text'] * 30)} end Short. one two {' '.join(['item text'] * 20)}"
    assert main_text.main_text(PAGE % (wrap % body)) == want


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"<(?!/?b>)[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())


def test_main_text_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    for row in main_text.extract(pages).select("row.html", "out.text").collect():
        assert row["text"] == article(row["html"])


def test_main_text_without_semantic_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = [(r["html"], article(r["html"])) for r in pages.collect()]
    assert len(found) == 250
    for tag in ("", "<div>", "<section>"):
        bare = [(re.sub("</?article>", lambda m: tag.replace("<", m[0][: m[0].index("a")]), page), want) for page, want in found]
        assert sum(main_text.main_text(page) == want for page, want in bare) >= 245


# Nothing here says by name what it is.
PLAIN = """<body><div>{menu}</div><div>Go</div><div>Login</div><div>{menu}</div><p>{long}</p><p>Short one.</p><p>{long}</p>
<div>{menu}</div><div>{menu}</div><div>{menu}</div><div>Legal</div><div>Contact</div></body>"""


def plain_page(rng):
    def prose(n):
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))

    menu = "".join(f"<div><a href=/{i}>{prose(rng.randrange(1, 6))}</a></div>" for i in range(12))
    texts = [prose(80), "Short one.", prose(120)]
    page = PLAIN.replace("{menu}", menu).replace("{long}", texts[0], 1).replace("{long}", texts[2], 1)
    return page, " ".join(texts)


def test_ratios_decide(monkeypatch):
    pages = [plain_page(random.Random(i)) for i in range(30)]
    assert all(main_text.main_text(page) == want for page, want in pages)
    monkeypatch.setattr(main_text, "smoothed", lambda ratios: np.ones(len(ratios)))
    assert not any(main_text.main_text(page) == want for page, want in pages)
    rng = np.random.default_rng(1)
    monkeypatch.setattr(main_text, "smoothed", lambda ratios: rng.random(len(ratios)))
    assert not any(main_text.main_text(page) == want for page, want in pages)


SHAPES = ["<div>", "</x>", "<a ", "<b>", '<a href="', "<!--", "<![CDATA[", "<?", "</", "&#", "<script>", "<p><b>", "<b><hr>", "</p>", "<li>"]


@pytest.mark.parametrize("shape", [*SHAPES, ("<div>", "</x>"), ("<i><div><b>", "</i>"), ("<b>", "<hr>"), ("<p>x", "</b>")])
@pytest.mark.parametrize("end", ["", ">", "-->"])
def test_hostile_pages_take_linear_time(shape, end):
    parts = (shape,) if isinstance(shape, str) else shape
    page = "".join(part * ((1 << 20) // len(parts) // len(part)) for part in parts) + end
    started = time.time()
    main_text.main_text(page)
    assert time.time() - started < 15  # a quadratic one takes hours


def test_main_text_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "plain &eacute;", "c"), (3, "<p>x", "d"), (None, "<script>x", "e"), (5, "<" * 2000, "f")]
    rows += [(6, "<p>" + "word " * 400_000, "g"), (7, "<p>same", "h"), (7, "<p>same", "h")]
    pages = spark.createDataFrame([(*r, "o", "t") for r in rows], "page_id long, html string, url string, out string, text string")
    report = main_text.report(main_text.extract(pages)).collect()
    assert len(report) == len(rows) and sum(r["text"] == "same" for r in report) == 2
    got = {r["url"]: (r["text"], r["n_chars"]) for r in report}
    assert got["a"] == got["b"] == got["e"] == ("", 0)
    assert got["c"] == ("plain é", 7) and got["d"] == ("x", 1) and got["g"][1] == 5 * 400_000 - 1
    assert main_text.report(main_text.extract(pages.limit(0))).count() == 0


RULES = queries.URL_RULES


def test_url_parts_and_rules(spark):
    cases = [
        ("http://A.Example.org/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://COM/fr/#a", "com", "/fr/", "com/fr/", "allow"),
        ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"),
        ("http://b.com/en/", "b.com", "/en/", None, None),
        ("http://example.org", "example.org", "", None, None),
        ("example.org/es/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://example.org?x=http://b/c", "example.org", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    unruled = url_filter.judge(pages, [])
    assert {r["verdict"] for r in unruled.collect()} == {"allow"}


def test_learned_verdicts(spark):
    rng = random.Random(1)
    name = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    bad = [(i, f"http://{name(5)}.net/b/{rng.randrange(10**8)}?a=1&b={rng.randrange(99)}&c=2") for i in range(300)]
    good = [(1000 + i, f"http://{name(6)}.net/g/{name(8)}") for i in range(300)]
    unknown = [(2000, "http://abc.net/u/99887766?a=1&b=2&c=2"), (2001, "http://abcdef.net/u/abcabc")]
    pages = spark.createDataFrame(bad + good + unknown, "page_id long, url string").repartition(3)
    rules = [url_filter.Rule.of("block", "net/b/"), url_filter.Rule.of("allow", "net/g/")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules, train_rows=400).collect()}
    assert (got[2000], got[2001]) == ("block", "allow")


INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAYLOADS = [
    "", None, "plain", "é" * 50, "plain", "x\r\n\r\ny\r\n\r\n", "WARC/1.0\r\n", f"<p>{INNER}</p>", INNER * 3,
    "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n", f"{INNER}WARC/1.0\r\n", "\r\n\r\n", "WARC/1.0", "a" * 5000, "plain",
]


@pytest.mark.parametrize("min_bytes,split", [(0, None), (6, "700b")])
def test_archives(spark, min_bytes, split):
    rows = [(i, f"http://h/é\r\n{i}" if i % 2 else None, p, "x") for i, p in enumerate(PAYLOADS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string").repartition(2)
    path = fresh_dir(spark, "warc")
    warc.write(pages, path, min_bytes, small_rows=0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = sorted(map(tuple, warc.read(spark, path, small_rows=0).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, first = [], {}
    for i, payload in enumerate(PAYLOADS):
        raw = (payload or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        seen = first.setdefault(raw, i) if len(raw) >= min_bytes else i
        kind = "response" if seen == i else "revisit"
        want.append((i, len(raw), digest, kind, None if seen == i else seen))
    assert got == want


def test_archives_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_dir(spark, "warc")
    warc.write(pages, path)
    assert warc.read(spark, path).count() == 0


FILE_DOCS = [(5, "a b c"), (1, None), (3, ""), (2, "é" * 3000), (9, "word " * 20_000), (7, "x"), (3, "again"), (None, "none")]


def test_an_added_token_in_a_text_is_one_id(spark):
    docs = [(0, "a b<|endoftext|>c d"), (1, "plain"), (2, "<|endoftext|>" * 50)]
    path = fresh_dir(spark, "tokens")
    token_files.write(frame(spark, docs), path, vocabulary_path(), 0)
    untouched = Tokenizer.from_file(vocabulary_path())
    ids = [untouched.encode(text, add_special_tokens=False).ids for _, text in docs]
    start, expected = 0, []
    for (doc_id, _), own in zip(docs, ids):
        expected.append((doc_id, start, len(own) + 1, zlib.crc32(np.array([*own, 0], "<u4").tobytes())))
        start += len(own) + 1
    assert sorted(map(tuple, token_files.digests(spark, path).collect())) == expected
    got = packing.pieces(frame(spark, docs), vocabulary_path(), 32, 2).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == [(doc_id, len(own) + 1) for (doc_id, _), own in zip(docs, ids)]


def test_token_files_round_trip(spark):
    path = fresh_dir(spark, "tokens")
    token_files.write(frame(spark, FILE_DOCS), path, vocabulary_path(), 0)
    got = token_files.digests(spark, path).orderBy("start").collect()
    ordered = sorted(FILE_DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    ids = {}
    for doc_id, text in FILE_DOCS:
        encoded = encoder(vocabulary_path()).encode([(text or "").encode()])[0]
        ids.setdefault(doc_id, []).append(np.append(encoded, 0).astype("<u4"))
    assert [r["doc_id"] for r in got] == [d[0] for d in ordered]
    start = 0
    for row in got:
        assert row["start"] == start
        assert row["ids_crc32"] in {zlib.crc32(x.tobytes()) for x in ids[row["doc_id"]] if len(x) == row["n_tokens"]}
        start += row["n_tokens"]
    fetched = token_files.fetch(spark, path, [2, 9])
    assert {k: v.tolist() for k, v in fetched.items()} == {k: ids[k][0].tolist() for k in (2, 9)}
    empty = fresh_dir(spark, "tokens")
    token_files.write(frame(spark, FILE_DOCS).limit(0), empty, vocabulary_path(), 0)
    assert token_files.digests(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_lower_bound_and_best_fit(lengths):
    sizes, capacity = np.array(lengths), 12
    bins, offsets = packing.best_fit_decreasing(sizes, capacity)
    fill = {}
    for size, b, o in sorted(zip(lengths, bins.tolist(), offsets.tolist()), key=lambda t: t[1:]):
        assert fill.get(b, 0) == o
        fill[b] = o + size
    assert max(fill.values()) <= capacity

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = fewest(rest[1:], [*rooms, capacity - rest[0]])
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in rooms[:i]:
                best = min(best, fewest(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]]))
        return best

    assert packing.lower_bound(sizes, capacity) <= fewest(sorted(lengths, reverse=True), []) <= bins.max() + 1


@pytest.mark.parametrize("group_pieces", [100_000, 7])
def test_packing(spark, group_pieces):
    rng = random.Random(1)
    docs = [(i, "word " * rng.choice([0, 1, 5, 30, 31, 32, 33, 90])) for i in range(80)] + [(80, None), (3, "again"), (None, "x")]
    found = packing.pieces(frame(spark, docs), vocabulary_path(), 32, 2)
    got = packing.pack(found, 32, group_pieces=group_pieces).collect()
    by_row = {}
    for r in got:
        by_row.setdefault((r["doc_id"], r["start"] == 0), []).append(r)
    assert sum(r["piece"] == 0 for r in got) == len(docs)
    sequences = {}
    for r in got:
        assert 1 <= r["length"] <= 32
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 32
    ids = np.append(encoder(vocabulary_path()).encode([docs[5][1].encode()])[0], 2).astype("<u4")
    own = sorted((r for r in got if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert [r["length"] for r in own[1:]] == [32] * (len(own) - 1)
    assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    bound = packing.lower_bound(np.array([r["length"] for r in got]), 32)
    assert len(sequences) <= bound * (1.03 if group_pieces > 100 else 1.6) + 1
    assert packing.pack_documents(frame(spark, docs).limit(0), vocabulary_path(), 32, 2).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    work = fresh_dir(spark, "stages")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    db = duckdb.connect()
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF_DIR).write.parquet(f"{work}/{name}")
        kept = spark.read.parquet(f"{work}/{name}")
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "language_id":
            assert len(ids) >= 0.99 * len(before)
        if name == "exact_dedup":
            folded = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in before.items()}
            assert ids == {min(j for j in folded if folded[j] == t) for t in set(folded.values())}
        if name == "decontamination":
            items = db.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
            hits = brute_hits(list(before.items()), items)
            assert ids == {i for i in before if not hits[i][-1]}
        if name == "packing":
            assert ids == set(before)
        docs = kept
