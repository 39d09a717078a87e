"""Append a topic to a table, decoding JSON messages or keeping them as they are.

    spark-submit millrace/jobs/ingest.py --servers kafka:9092 --topic events \\
        --table s3a://data/events --checkpoint s3a://data/checkpoints/events

``--records`` reads a folder of record files instead of a broker.  Without ``--drain`` the
stream runs until it is stopped; with it, until what is there now has been read.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from millrace.functions.messages import MESSAGE_SCHEMA, decode_json, raw_messages
from millrace.session import build_session
from millrace.sources.topics import BrokerTopic, RecordFiles
from millrace.streaming.append import start_append


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Append a topic to a table.")
    parser.add_argument("--servers", help="broker addresses")
    parser.add_argument("--topic")
    parser.add_argument("--records", help="folder of record files, instead of a broker")
    parser.add_argument("--table", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--format", default="delta", help="table format; parquet needs no jar")
    parser.add_argument("--schema", help="fields of the JSON messages, as DDL")
    parser.add_argument("--raw", action="store_true", help="keep messages undecoded")
    parser.add_argument("--starting", default="earliest", choices=["earliest", "latest"])
    parser.add_argument("--every", help='one micro-batch per interval, such as "30 seconds"')
    parser.add_argument("--drain", action="store_true")
    args = parser.parse_args(argv)
    if not args.records and not (args.servers and args.topic):
        parser.error("give --servers and --topic, or --records")
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    topic = RecordFiles(args.records) if args.records else BrokerTopic(args.servers, args.topic)
    records = topic.stream(spark, starting=args.starting)
    if args.raw:
        rows = raw_messages(records)
    else:
        rows = decode_json(records, T.StructType.fromDDL(args.schema) if args.schema else MESSAGE_SCHEMA)
    query = start_append(
        rows, args.table, args.checkpoint, fmt=args.format, every=args.every, drain=args.drain
    )
    query.awaitTermination()


def main() -> None:
    run(build_session("ingest"), arguments())


if __name__ == "__main__":
    main()
