"""Jobs for spark-submit: ``millrace/jobs/crawl.py`` and ``millrace/jobs/ingest.py``."""
