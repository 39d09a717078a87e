import threading
import time

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from millrace import session
from millrace.functions.messages import decode_json, raw_messages
from millrace.operators.checks import require, same_rows
from millrace.operators.counts import lines_per_file
from millrace.plans import ingest
from millrace.scratch import fresh_dir, shared_root
from millrace.sinks import files as sink
from millrace.sinks.topics import as_records, produce
from millrace.sources import tables as source
from millrace.sources.evolving import EvolvingTable
from millrace.sources.topics import RECORD_SCHEMA, BrokerTopic, RecordFiles, consume
from millrace.streaming.append import drain_append, start_append
from millrace.streaming.quarantine import KEPT, QUARANTINED, start_sorting


def part_files(spark, path):
    return source.text_lines(spark, path).select("_metadata.file_path").distinct().count()


def test_parquet_and_table_roundtrips(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, None)], "id long, val string")
    path = fresh_dir(spark, "t")
    sink.parquet(rows, path)
    require(same_rows(rows, source.parquet(spark, path), "parquet"))
    sink.parquet(rows.limit(1), path)
    assert source.parquet(spark, path, schema=rows.schema).count() == 1
    sink.versioned_table(rows, path, fmt="parquet", mode="append")
    assert source.versioned_table(spark, path, fmt="parquet").count() == 5


def test_table_format_without_its_jar_is_refused(spark):
    with pytest.raises(Exception, match="(?i)delta"):
        sink.versioned_table(spark.range(5), fresh_dir(spark, "d"))


def test_report_has_the_files_it_is_asked_for(spark):
    lines = spark.range(100).repartition(4).select(F.col("id").cast("string").alias("line"))
    path = fresh_dir(spark, "report")
    sink.text_report(lines, path, shards=1)
    assert part_files(spark, path) == 1
    sink.text_report(lines, path)
    assert part_files(spark, path) > 1
    assert source.text_lines(spark, path).count() == 100
    assert lines_per_file(source.text_lines(spark, path)).agg(F.sum("n")).first()[0] == 100
    with pytest.raises(ValueError):
        sink.text_report(spark.range(2).withColumn("x", F.lit(1)), path)


def test_dated_json_lines_keep_runs_apart(spark):
    path = fresh_dir(spark, "raw")
    rows = spark.createDataFrame([("http://é/", None)], "url string, title string")
    for run in ("r1", "r2", "r1"):  # the last repeats the first
        sink.dated_json_lines(rows, path, run, 1_700_000_000)
    back = source.json_lines(spark, path, "url string, title string, dt string, run_id string")
    assert {tuple(r) for r in back.collect()} == {
        ("http://é/", None, "20231114", "r1"),
        ("http://é/", None, "20231114", "r2"),
    }
    assert source.text_lines(spark, path).first()["value"] == '{"url":"http://é/","title":null}'
    sink.dated_json_lines(rows.limit(0), path, "r1", 1_700_000_000)  # repeated with nothing to write
    assert {r["run_id"] for r in back.sparkSession.read.schema(back.schema).json(path).collect()} == {"r2"}


@pytest.mark.parametrize("run", ["a/b", "x=1 y:'z'", "100%", "é", "plain"])
def test_repeated_runs_replace_their_folders(spark, run):
    path = fresh_dir(spark, "raw")
    rows = spark.createDataFrame([("u", 1_700_000_000), ("v", 1_700_090_000)], "url string, at long")
    schema = "url string, at long, dt string, hour string, run_id string"
    for times in (F.col("at"), F.col("at"), 1_700_000_000):  # the last replaces one hour of two
        sink.dated_json_lines(rows, path, run, times, hourly=True)
        sink.dated_json_lines(rows, path, "other", 5, hourly=True)
    back = {tuple(r) for r in source.json_lines(spark, path, schema).collect()}
    assert {r for r in back if r[4] == run} == {
        ("u", 1_700_000_000, "20231114", "22", run), ("v", 1_700_090_000, "20231114", "22", run),
        ("v", 1_700_090_000, "20231115", "23", run),
    }
    assert len(back) == 5 == source.json_lines(spark, path, schema).count()


def test_managed_table_is_replaced(spark):
    for n in (3, 5):
        sink.managed_table(spark.range(n), "replaced", fresh_dir(spark, "replaced"))
    assert spark.table("replaced").count() == 5


def test_a_failed_rebuild_leaves_the_table(spark):
    path = fresh_dir(spark, "kept")
    sink.managed_table(spark.range(3), "kept", path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sink.managed_table(broken, "kept", path)
    assert spark.table("kept").count() == 3


def test_a_table_rebuilt_from_itself(spark):
    path = fresh_dir(spark, "own")
    sink.managed_table(spark.range(3), "own", path)
    sink.managed_table(spark.sql("SELECT id, id * 2 AS twice FROM own"), "own", path)
    assert sorted(map(tuple, spark.table("own").collect())) == [(0, 0), (1, 2), (2, 4)]


def records(spark, low, high):
    rows = spark.range(low, high)
    return as_records(
        rows, "t", value=F.concat(F.lit('{"message":"m'), F.col("id"), F.lit('"}')), offset=F.col("id")
    )


def test_records_have_the_connector_columns(spark):
    assert records(spark, 0, 1).schema == RECORD_SCHEMA or [
        (f.name, f.dataType) for f in records(spark, 0, 1).schema
    ] == [(f.name, f.dataType) for f in RECORD_SCHEMA]


def test_stream_equals_batch_and_restarts(spark):
    topic = RecordFiles(fresh_dir(spark, "topic"), {"maxFilesPerTrigger": "1"})
    path, checkpoint = fresh_dir(spark, "out"), fresh_dir(spark, "ck")

    def run():
        drain_append(decode_json(topic.stream(spark)), path, checkpoint, fmt="parquet", timeout=120)
        return source.versioned_table(spark, path, fmt="parquet")

    produce(records(spark, 0, 1000).repartition(4), topic)
    require(same_rows(run(), decode_json(topic.batch(spark)), "stream = batch"))
    assert run().count() == 1000
    produce(records(spark, 1000, 1007), topic)
    require(same_rows(run(), decode_json(topic.batch(spark)), "stream = batch"))
    assert run().count() == 1007


def test_running_stream(spark):
    topic = RecordFiles(fresh_dir(spark, "topic"))
    path = fresh_dir(spark, "out")
    produce(records(spark, 0, 10), topic)
    query = start_append(
        raw_messages(topic.stream(spark, starting=None)), path, fresh_dir(spark, "ck"), fmt="parquet", every="1 second"
    )
    try:
        query.processAllAvailable()
        assert source.versioned_table(spark, path, fmt="parquet").count() == 10
    finally:
        query.stop()


def test_consume_is_bounded_and_ordered(spark):
    topic = RecordFiles(fresh_dir(spark, "topic"))
    produce(records(spark, 5, 50).repartition(4), topic)
    produce(records(spark, 0, 5), topic)
    assert [r["offset"] for r in consume(spark, topic, 1).collect()] == [0]
    assert [r["offset"] for r in consume(spark, topic, 7).collect()] == list(range(7))
    with pytest.raises(ValueError):
        topic.stream(spark, starting="latest")


def test_consume_waits_for_a_bounded_time(spark):
    topic = RecordFiles(fresh_dir(spark, "topic"))
    started = time.monotonic()
    assert consume(spark, topic, 1, timeout=2).count() == 0  # never filled
    assert 2 <= time.monotonic() - started < 20
    assert consume(spark, topic, 1).count() == 0
    filler = threading.Timer(1.5, lambda: produce(records(spark, 0, 3), topic))
    filler.start()
    late = consume(spark, topic, 2, timeout=60)
    filler.join()
    assert [r["offset"] for r in late.collect()] == [0, 1]
    started = time.monotonic()
    assert consume(spark, topic, 5, timeout=1).count() == 3  # fewer than asked for
    assert time.monotonic() - started >= 1


def test_consume_spans_partitions(spark):
    topic = RecordFiles(fresh_dir(spark, "topic"))
    both = [records(spark, 0, 4).withColumn("partition", F.lit(p).cast("int")) for p in (1, 0)]
    produce(both[0].union(both[1]).union(both[1].filter("offset = 3")), topic)
    for n, wanted in ((4, [(0, 0), (0, 1), (0, 2), (0, 3)]), (7, [(0, 0), (0, 1), (0, 2), (0, 3), (0, 3), (1, 0), (1, 1)])):
        assert [(r["partition"], r["offset"]) for r in consume(spark, topic, n).collect()] == wanted


def test_messages_are_sorted_once_whatever_stops(spark):
    topic = RecordFiles(fresh_dir(spark, "topic"), {"maxFilesPerTrigger": "1"})
    path, checkpoint = fresh_dir(spark, "sorted"), fresh_dir(spark, "ck")
    texts = ['{"message":"a"}', "{", "", "  ", None, '{"message":5}', '[{"message":"b"}', '"x"', '{"message":{"a":1}}', "{}"]
    for part in range(3):
        rows = spark.createDataFrame([(10 * part + i, t) for i, t in enumerate(texts)], "id long, text string")
        produce(as_records(rows, "t", value=F.col("text"), offset=F.col("id")).coalesce(1), topic)
    stopped = []

    def stop(batch):
        if batch not in stopped:
            stopped.append(batch)
            raise RuntimeError("stopped")

    for _ in range(4):
        try:
            start_sorting(topic.stream(spark), path, checkpoint, drain=True, between=stop).awaitTermination()
        except StreamingQueryException:
            pass
    assert stopped == [0, 1, 2]
    kept = spark.read.parquet(f"{path}/{KEPT}").collect()
    rest = spark.read.parquet(f"{path}/{QUARANTINED}").collect()
    assert sorted(r["offset"] for r in kept + rest) == sorted(10 * part + i for part in range(3) for i in range(len(texts)))
    reasons = {r["offset"] % 10: (r["reason"], r["value"]) for r in rest}
    assert {i: bytes(v).decode() if v is not None else None for i, (_, v) in reasons.items()} == {i: texts[i] for i in reasons}
    assert {i: why for i, (why, _) in reasons.items()} == {
        1: "malformed", 2: "empty", 3: "empty", 4: "missing", 6: "malformed", 7: "malformed"}
    assert {r["message"] for r in kept} == {"a", "5", '{"a":1}', None}


def test_a_write_of_sorted_messages_decodes_each_message_once(spark):
    topic, path = RecordFiles(fresh_dir(spark, "topic")), fresh_dir(spark, "sorted")
    texts = ['{"message":"a"}', "a", "[1]", "[{}]", "{", '[{"message":"b"}]', "[null]", "[]", " {} ", '"a"', "null"]
    rows = spark.createDataFrame(list(enumerate(texts)), "offset long, value string")
    produce(as_records(rows, "t", value=F.col("value"), offset=F.col("offset")), topic)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    start_sorting(topic.stream(spark), path, fresh_dir(spark, "stream"), drain=True).awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList()
    plans = [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]
    seen = [text.split("== Physical Plan ==")[-1].count("from_json(") for text in plans if "from_json(" in text]
    assert len(seen) >= 2 and set(seen) == {1}
    kept = spark.read.parquet(f"{path}/{KEPT}").select("offset", "message").collect()
    assert sorted(map(tuple, kept), key=str) == [(0, "a"), (8, None)]
    rest = spark.read.parquet(f"{path}/{QUARANTINED}").select("offset", "reason").collect()
    assert sorted(map(tuple, rest)) == [(i, "malformed") for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)]


def test_a_topic_of_many_messages_is_a_topic_of_files(spark, monkeypatch):
    monkeypatch.setattr(ingest, "MESSAGES_PER_FILE", 2_500)
    events = spark.range(1_000).selectExpr("id AS event_id", "now() AS ts", "'view' AS event_type")
    path = fresh_dir(spark, "tables")
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    records = ingest._shaped_topic(spark, path).batch(spark)
    assert records.select("_metadata.file_path").distinct().count() == 4
    assert sorted(r["offset"] for r in records.select("offset").collect()) == list(range(10_000))


def test_evolving_table(spark):
    table = EvolvingTable(spark, fresh_dir(spark, "evolving"))
    table.append(spark.createDataFrame([(1, "a", 1.5)], "n int, t string, f float"))
    table.append(spark.createDataFrame([(2, "b")], "n smallint, t string"))
    assert table.versions().count() == 1  # nothing new
    table.append(spark.createDataFrame([(2**40, 2.5, True)], "n long, f double, more boolean"))
    assert table.schema().simpleString() == "struct<n:bigint,t:string,f:double,more:boolean>"
    assert sorted(tuple(r) for r in table.read().collect()) == [
        (1, "a", 1.5, None), (2, "b", None, None), (2**40, None, 2.5, True)]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("x",)], "n string"))
    assert table.read().count() == 3 and table.versions().count() == 2


def test_broker_topic_needs_its_connector(spark):
    topic = BrokerTopic("localhost:9092", "events")
    for use in (
        lambda: topic.stream(spark),
        lambda: topic.stream(spark, starting=None),
        lambda: topic.batch(spark),
        lambda: produce(records(spark, 0, 1), topic),
    ):
        with pytest.raises((AnalysisException, StreamingQueryException), match="(?i)kafka"):
            use()


def test_session_settings(spark):
    conf = session.object_store_conf("http://store:9000", "key", "secret")
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert "spark.sql.extensions" in session.lakehouse_conf()
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_scratch_is_the_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    assert fresh_dir(spark, "x").startswith(shared_root(spark))
