from pyspark.sql import functions as F

from millrace.functions.messages import decode_json, encode_json, raw_messages

VALUES = [
    (b'{"message":"hello"}', "hello"),
    (b'{"message":5}', "5"),
    (b'{"message":{"a":1}}', '{"a":1}'),
    (b'{"message":"a"} trailing', "a"),
    (b"not json", None),
    (b'{"other":1}', None),
    (b'{"message":null}', None),
    (b"null", None),
    (b"[1]", None),
    (b"\xff\xfe", None),
    (b"", None),
    (None, None),
]


def test_decode_keeps_every_record(spark):
    records = spark.createDataFrame(
        [(i, bytearray(v) if v is not None else None) for i, (v, _) in enumerate(VALUES)],
        "offset int, value binary",
    )
    got = {r["offset"]: r["message"] for r in decode_json(records, keep=("offset",)).collect()}
    assert got == {i: e for i, (_, e) in enumerate(VALUES)}


def test_raw(spark):
    records = spark.createDataFrame([(bytearray("é".encode()),)], "value binary")
    assert raw_messages(records).collect()[0]["msg"] == "é"


def test_encode_keeps_null_fields(spark):
    row = spark.createDataFrame([("é", None)], "a string, b int")
    assert row.select(encode_json("a", "b")).first()[0] == '{"a":"é","b":null}'
    assert row.select(encode_json(F.col("b").alias("c"))).first()[0] == '{"c":null}'
