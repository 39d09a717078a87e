"""Table, stream and crawl jobs written for Spark."""
