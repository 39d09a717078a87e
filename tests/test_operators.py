import pytest
from pyspark.sql import functions as F

from millrace.functions.scalars import apply_parallel, plus_one
from millrace.functions.text import day_stamp, epoch_now, key_count, strip, words
from millrace.operators import checks
from millrace.operators.allowlist import semi_join_allowed
from millrace.operators.caps import first_rows, head
from millrace.operators.counts import element_count_lines, element_counts, row_count, row_counts
from millrace.operators.probe import bitmaps_of, possible, without
from millrace.operators.frontier import first_parents, first_visits, unseen, with_seen
from millrace.operators.models import materialize
from millrace.scratch import fresh_dir
from millrace.sources.rows import integer_range, literal_elements, literal_rows, seed_urls


def test_counts(spark):
    assert row_count(integer_range(spark, 0, 1000)).first()[0] == 1000
    two = literal_rows(spark, [(1, "a"), (2, "b")], ["id", "val"])
    assert two.groupBy().count().first()[0] == 2
    lines = element_count_lines(literal_elements(spark, ["a", "b", "c", "a"]), "element")
    assert {r["line"] for r in lines.collect()} == {"a:2", "b:1", "c:1"}
    assert {tuple(r) for r in row_counts({"x": two, "y": two.limit(1)}).collect()} == {("x", 2), ("y", 1)}


def test_counts_of_a_missing_element(spark):
    rows = spark.createDataFrame([(None,), ("a",)], "element string")
    assert {tuple(r) for r in element_counts(rows, "element").collect()} == {(None, 1), ("a", 1)}


@pytest.mark.parametrize("n", [0, 1, 7, 99, 100, 101, 499, 500, 501])
@pytest.mark.parametrize("sorted_rows", [0, 10_000])
def test_first_rows_is_exact(spark, n, sorted_rows):
    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("url"))
    expected = sorted(r["url"] for r in rows.collect())[:n]
    got = first_rows(rows, "url", n, sorted_rows=sorted_rows)
    assert sorted(r["url"] for r in got.collect()) == expected


def test_head(spark):
    assert [r["id"] for r in head(spark.range(100), "id", 3).collect()] == [0, 1, 2]


HOSTS = ["ex.org", "a.ex.org", "b.a.ex.org", "notex.org", "net.com", "x.net.com", "com", "", "zz"]
LISTED = ["EX.org", "a.ex.org", "net.com", "x.net.com", ""]


@pytest.mark.parametrize("broadcast_domains", [0, 100])
def test_semi_join_allowed(spark, broadcast_domains):
    """Nested entries do not repeat rows, and copies of a row all stay."""
    rows = [(i, f"http://{h}/p") for i in range(3) for h in HOSTS]
    urls = spark.createDataFrame(rows + rows, "id int, url string")
    domains = spark.createDataFrame([(d,) for d in LISTED], "domain string")
    got = semi_join_allowed(urls, domains, broadcast_domains=broadcast_domains, salts=4)
    listed = [d.lower() for d in LISTED if d]
    expected = [
        (i, u)
        for i, u in rows + rows
        if any(u[7:-2] == d or u[7:-2].endswith("." + d) for d in listed)
    ]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert got.columns == ["id", "url"]


def test_frontier(spark):
    candidates = spark.createDataFrame(
        [("u", 2, "b"), ("u", 1, "z"), ("u", 1, "c"), ("v", 3, "a")],
        "url string, depth int, src_url string",
    )
    assert {tuple(r) for r in first_visits(candidates).collect()} == {("u", 1), ("v", 3)}
    assert {tuple(r) for r in first_parents(candidates).collect()} == {("u", 1, "c"), ("v", 3, "a")}
    seen = with_seen(candidates.select("url").limit(0), candidates.select("url", "depth").filter("depth = 3"))
    assert {r["url"] for r in unseen(candidates, seen).collect()} == {"u"}


def test_checks(spark):
    rows = spark.range(5)
    report = checks.report(
        checks.row_count_is(rows, 5, "five"),
        checks.row_count_at_least(rows, 6, "six"),
        checks.has_row(rows, F.col("id") == 3, "three"),
        checks.same_rows(rows, rows.union(rows.limit(1)), "same"),
        checks.same_rows(rows, rows, "equal"),
    )
    got = {r["check"]: (r["expected"], r["actual"], r["ok"]) for r in report.collect()}
    assert got == {
        "five": (5, 5, True),
        "six": (6, 5, False),
        "three": (1, 1, True),
        "same": (0, 1, False),
        "equal": (0, 0, True),
    }
    with pytest.raises(AssertionError, match="six: 5 vs 6"):
        checks.require(report)
    checks.require(report.filter("ok"))


def test_model(spark):
    name = "a_model"
    path = fresh_dir(spark, name)
    for status in ("old", "ok"):
        model = materialize(spark, name, f"SELECT 1 AS id, '{status}' AS status", fresh_dir(spark, name))
    assert [tuple(r) for r in model.collect()] == [(1, "ok")]
    assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == 1
    assert path != fresh_dir(spark, name)


def test_parallel_function(spark):
    rows = spark.createDataFrame([(41,), (None,)], "x int")
    assert [r[0] for r in rows.select(plus_one(F.col("x"))).collect()] == [42, None]
    doubled = apply_parallel(lambda s: s * 2, "double")
    assert spark.range(3).select(F.sum(doubled(F.col("id").cast("double")))).first()[0] == 6.0


def test_text(spark):
    row = spark.createDataFrame([("　 a b \n", 1_700_000_000, 86_399)], "t string, s long, d long")
    got = row.select(
        strip(F.col("t")), words(F.col("t")), key_count(F.lit("k"), F.lit(2)),
        day_stamp(F.col("s")), day_stamp(F.col("d")), epoch_now() > 1_700_000_000,
    ).first()
    assert got[:] == ("a b", ["a", "b"], "k:2", "20231114", "19700101", True)


def test_day_stamp_ignores_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
        assert spark.range(1).select(day_stamp(F.lit(1_700_000_000))).first()[0] == "20231114"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_seeds(spark):
    texts = spark.createDataFrame([(" http://A.org\thttp://a.org/ ",), ("b.org http://c.org/x",), ("",)], "seeds string")
    assert {tuple(r) for r in seed_urls(texts).collect()} == {("http://a.org/", 0), ("http://c.org/x", 0)}


def test_probes_lose_nothing_and_drop_exactly(spark):
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("may"), F.lit("b").alias("bits"))
    wanted = spark.range(0, 3000, 7).withColumn("more", F.lit(1))
    may = possible(rows.drop("may"), bitmaps_of(wanted, "id"), "id")
    assert 429 <= may.count() < 440 and may.join(wanted, "id").count() == 429
    left = without(rows.select("id", F.lit(1).alias("x y")), wanted, "id")
    assert left.columns == ["id", "x y"] and left.count() == 3000 - 429
    assert left.filter("id % 7 = 0").count() == 0
    assert without(rows.select("id"), wanted.limit(0), "id").count() == 3000
    assert possible(rows.select("id"), bitmaps_of(wanted.limit(0), "id"), "id").count() == 0
