"""DataFrame operators: counts, frontier algebra, allowlists, caps, checks, the crawl."""
