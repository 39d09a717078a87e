"""Crawl a stored page snapshot and write its records as JSON lines.

    spark-submit millrace/jobs/crawl.py --snapshot s3a://web/pages --out s3a://crawl/raw

The knobs also come from the environment: SEEDS, ALLOWED_DOMAINS, MAX_PAGES, MAX_DEPTH and
MAX_ENQUEUE.  With ``--seen`` a run leaves out what runs before it attempted.  The snapshot is a
table with the columns of ``millrace.sources.web`` and a column without repeats, by default
``page_id``, that decides between rows for one address.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from millrace.operators.crawl import MAX_DEPTH, crawl
from millrace.operators.runs import record_run
from millrace.operators.seen import SeenTable
from millrace.session import build_session
from millrace.sinks.files import dated_json_lines
from millrace.sources.tables import versioned_table


# The job's own caps; "none" lifts one.
MAX_PAGES = 20
MAX_ENQUEUE = 10_000


def cap(text: str) -> int | None:
    return None if text.lower() == "none" else int(text)


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    knob = os.environ.get
    parser = argparse.ArgumentParser(description="Crawl a stored page snapshot.")
    parser.add_argument("--snapshot", required=True, help="folder of the snapshot table")
    parser.add_argument("--snapshot-format", default="parquet")
    parser.add_argument("--order", default="page_id", help="column deciding between copies")
    parser.add_argument("--out", required=True, help="folder for dt=/run_id= JSON lines")
    parser.add_argument("--seeds", default=knob("SEEDS"), help="white-space-separated addresses")
    parser.add_argument("--allowed", default=knob("ALLOWED_DOMAINS"), help="white-space-separated domains")
    parser.add_argument("--max-pages", type=cap, default=knob("MAX_PAGES", str(MAX_PAGES)))
    parser.add_argument("--max-depth", type=int, default=knob("MAX_DEPTH", MAX_DEPTH))
    parser.add_argument("--max-enqueue", type=cap, default=knob("MAX_ENQUEUE", str(MAX_ENQUEUE)))
    parser.add_argument("--run-id", help="name of the run; a run repeated under its name replaces what it left")
    parser.add_argument("--run-ts", type=int, help="when the run began, in seconds; a repeated run is given the same")
    parser.add_argument("--seen", help="folder of the table of addresses that runs have attempted")
    parser.add_argument("--runs", help="folder of the table of runs")
    args = parser.parse_args(argv)
    if not args.seeds or not args.allowed:
        parser.error("--seeds and --allowed (or SEEDS and ALLOWED_DOMAINS) are needed")
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> Row:
    """Crawl, write the records, and return the run's counters."""
    snapshot = versioned_table(spark, args.snapshot, args.snapshot_format)
    for name, kind in (("final_url", "string"), ("status", "int")):
        if name not in snapshot.columns:
            snapshot = snapshot.withColumn(name, F.lit(None).cast(kind))
    result = crawl(
        snapshot,
        order=args.order,
        seeds=args.seeds,
        allowed=args.allowed,
        max_pages=args.max_pages,
        max_depth=args.max_depth,
        max_enqueue=args.max_enqueue,
        run_id=args.run_id,
        run_ts=args.run_ts,
        seen=SeenTable.open(spark, args.seen) if args.seen else None,
    )
    dated_json_lines(result.records, args.out, result.run_id, result.run_ts)
    if args.runs:
        record_run(result, args.runs, args.out)
    return result.manifest(args.out).first()


def main() -> None:
    args = arguments()
    counters = run(build_session("crawl"), args)
    print(
        f"run {counters['run_id']}: attempted {counters['attempted']}, "
        f"fetched {counters['fetched']}, emitted {counters['emitted']}, "
        f"failed {counters['failed']}, left by caps {counters['left_by_pages']} and "
        f"{counters['left_by_queue']} -> {counters['destination']}"
    )


if __name__ == "__main__":
    main()
