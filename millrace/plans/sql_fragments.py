"""SQL the web and crawl oracles share.

Written for the addresses and documents of the test tables, on purpose without the
library's own patterns: links there are root-relative and in double quotes.
"""

from __future__ import annotations


def normal(url: str) -> str:
    """The visiting key of an absolute address."""
    authority = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    host = f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':.*$', ''))"
    path = f"regexp_replace(regexp_extract({url}, '^[^:]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    scheme = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    return f"({scheme} || '://' || {host} || coalesce(nullif(rtrim({path}, '/'), ''), '/'))"


def origin(url: str) -> str:
    return f"regexp_extract({url}, '^[^/]*//[^/]*')"


def host(url: str) -> str:
    return f"regexp_extract({url}, '^[^/]*//([^/?#]*)', 1)"


def in_domains(url: str, domains: str) -> str:
    tests = [f"({host(url)} = '{d}' OR {host(url)} LIKE '%.{d}')" for d in domains.split()]
    return "(" + " OR ".join(tests) + ")"


def title(html: str) -> str:
    text = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title', 1)"
    return f"trim(replace({text}, '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))"


def hrefs(html: str) -> str:
    return f"""regexp_extract_all({html}, '<a [^>]*href="([^"]*)"', 1)"""


# One row per normalised address, and the links of each.
KEYED = f"SELECT page_id, {normal('url')} AS url, html FROM pages"
FIRST_PAGES = f"SELECT url, arg_min(html, page_id) AS html FROM ({KEYED}) GROUP BY url"
EDGES = f"""
    SELECT DISTINCT src_url, {normal('link')} AS dst_url FROM (
        SELECT url AS src_url, {origin('url')} || unnest({hrefs('html')}) AS link
        FROM ({FIRST_PAGES}))
"""
