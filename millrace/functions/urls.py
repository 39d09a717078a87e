"""URL expressions built from JVM string functions; no Python workers.

Addresses are taken apart with one anchored pattern.  ``normalize_url`` gives the
key under which an address is visited, ``resolve_link`` turns the text of a link into
an address, and ``host_allowed`` is the crawl's scope test.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import bind

# Generic URL syntax (RFC 3986) and the characters browsers drop.
SCHEME = r"\A([A-Za-z][A-Za-z0-9+.-]*):"
ABSOLUTE = SCHEME + r"//([^/?#]*)([^?#]*)"
LEADING_JUNK = r"\A[\x00-\x20]+"
REMOVED_ANYWHERE = r"[\t\r\n]"
WITH_PARAMS = r"(?s)\A((?:.*/)?[^/;]*);[^/]*\z"
PARAMS = r"(?:\A|/)[^/;]*;([^/]*)\z"
NORMAL_ALREADY = r"\Ahttps?://[a-z0-9.-]++/(?:[^?#;\t\r\n]*[^?#;/\t\r\n])?\z"
PLAIN_ROOTED = r"\A/(?![/.])(?:[^?#;/\t\r\n]|/(?!\.))*+\z"
PLAIN_ABSOLUTE = (
    r"\Ahttps?://[^/?#;\[\]\x00-\x20]++(?:/[^?#;\t\r\n]*+)?"
    r"(?:\?[^#\t\r\n]++)?(?:#[^\t\r\n]++)?\z"
)
PLAIN_RELATIVE = (
    r"\A[^/?#;:.\x00-\x20](?:[^/?#;:\t\r\n]|/(?![./]))*+"
    r"(?:\?[^#\t\r\n]++)?(?:#[^\t\r\n]++)?\z"
)
IPV6_AUTHORITY = r"\A\[[0-9A-Fa-f:.%]+\](?::.*)?\z"

HOST_CHARS = 253  # no host name is longer, so the entries of a list are bounded in bytes too


def _clean(url: Column) -> Column:
    """``url`` without the characters that never count."""
    return F.regexp_replace(F.regexp_replace(url, REMOVED_ANYWHERE, ""), LEADING_JUNK, "")


def _host_of_authority(authority: Column) -> Column:
    """Lower-case host without userinfo and port; NULL when brackets do not match."""

    def host(place: Column) -> Column:
        bracketed = F.when(
            place.rlike(IPV6_AUTHORITY), F.regexp_extract(place, r"\A(\[[^\]]*\])", 1)
        )
        plain = F.regexp_replace(place, r"(?s):.*\z", "")
        return F.lower(F.when(place.rlike(r"[\[\]]"), bracketed).otherwise(plain))

    return bind(F.regexp_replace(authority, r"(?s)\A.*@", ""), host)


def _normal_path(path: Column) -> Column:
    def rooted(path: Column) -> Column:
        return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))

    without_params = F.regexp_replace(path, WITH_PARAMS, "$1")
    return bind(F.regexp_replace(without_params, r"(?<!/)/++\z", ""), rooted)


def normalize_url(url: Column) -> Column:
    """The visiting key of an address, or NULL if it has no ``scheme://host``.

    Scheme and host go to lower case; userinfo, port, path parameters, query and
    fragment go away; trailing slashes go away unless the path is the root.
    """

    def key(text: Column) -> Column:
        scheme = F.lower(F.regexp_extract(text, ABSOLUTE, 1))
        path = _normal_path(F.regexp_extract(text, ABSOLUTE, 3))
        host = _host_of_authority(F.regexp_extract(text, ABSOLUTE, 2))
        return bind(
            host, lambda h: F.when(h != "", F.concat(scheme, F.lit("://"), h, path))
        )

    return F.when(url.rlike(NORMAL_ALREADY), url).otherwise(
        bind(_clean(url), lambda text: F.when(text.rlike(ABSOLUTE), key(text)))
    )


def url_host(url: Column) -> Column:
    """Lower-case host; the empty string when there is none."""
    host = _host_of_authority(F.regexp_extract(_clean(url), ABSOLUTE, 2))
    return F.coalesce(host, F.lit(""))


def url_origin(url: Column) -> Column:
    """``scheme://host`` of an already normalised address."""
    return F.regexp_extract(url, r"\A([^/]*//[^/]*)", 1)


def domain_list(domains: str | Iterable[str]) -> list[str]:
    """Allowed domains in lower case, from a white-space-separated string or a list.

    Entries longer than any host name can be are left out, as they are of a list in a table.
    """
    given = domains.split() if isinstance(domains, str) else list(domains)
    return sorted({d.lower() for d in given if 0 < len(d) <= HOST_CHARS})


def host_allowed(url: Column, domains: str | Iterable[str]) -> Column:
    """Whether the host is one of ``domains`` or below one; False without a host.

    For a short list known to the driver.  A list held in a table goes through
    ``operators.allowlist.semi_join_allowed``.
    """

    def covered(host: Column) -> Column:
        allowed = F.lit(False)
        for domain in domain_list(domains):
            allowed = allowed | (host == domain) | host.endswith("." + domain)
        return allowed & (host != "")

    return bind(url_host(url), covered)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``; the parents an allowlist entry could name."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _merged_path(base_path: Column, path: Column) -> Column:
    """``path`` seen from ``base_path``, dot segments resolved."""
    base_parts = F.split(base_path, "/", -1)
    folder = F.when(F.element_at(base_parts, -1) == "", base_parts).otherwise(
        F.slice(base_parts, F.lit(1), F.size(base_parts) - 1)
    )
    parts = F.split(path, "/", -1)

    def without_empty_middles(joined: Column) -> Column:
        inner = F.slice(joined, F.lit(2), F.size(joined) - 2)
        return F.concat(
            F.slice(joined, 1, 1), F.filter(inner, lambda s: s != ""), F.slice(joined, -1, 1)
        )

    def step(done: Column, segment: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(segment == "..", parent)
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    def without_dots(segments: Column) -> Column:
        walked = F.aggregate(segments, F.array().cast("array<string>"), step)
        folder_mark = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit("")))
        return F.array_join(
            F.concat(walked, F.coalesce(folder_mark, F.array().cast("array<string>"))), "/"
        )

    def never_empty(joined: Column) -> Column:
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    segments = F.when(path.startswith("/"), parts).otherwise(
        bind(F.concat(folder, parts), without_empty_middles)
    )
    merged = bind(bind(segments, without_dots), never_empty)
    return F.when(path.startswith("/") & ~path.contains("/."), path).otherwise(merged)


def _page_parts(base: Column) -> Column:
    """``folder`` is what a plain relative link is put behind; NULL if that is not enough."""

    def parts(page: Column) -> Column:
        full_path = F.regexp_extract(page, ABSOLUTE, 3)
        return F.struct(
            F.lower(F.regexp_extract(page, SCHEME, 1)).alias("scheme"),
            F.regexp_extract(page, ABSOLUTE, 2).alias("authority"),
            F.regexp_replace(full_path, WITH_PARAMS, "$1").alias("path"),
            F.regexp_extract(full_path, PARAMS, 1).alias("params"),
            F.regexp_extract(page, r"\A[^?#]*\?([^#]*)", 1).alias("query"),
        )

    def with_prefixes(page: Column) -> Column:
        origin = F.concat(page["scheme"], F.lit("://"), page["authority"])
        folder = F.regexp_extract(page["path"], r"(?s)\A/(?:.*/)?", 0)
        plain = F.when(~page["path"].rlike(r"//|/\."), folder)
        return F.struct(
            page["scheme"].alias("scheme"),
            page["authority"].alias("authority"),
            page["path"].alias("path"),
            page["params"].alias("params"),
            page["query"].alias("query"),
            base.alias("given"),
            origin.alias("origin"),
            F.concat(origin, F.when(plain == "", F.lit("/")).otherwise(plain)).alias("folder"),
        )

    return bind(bind(_clean(base), parts), with_prefixes)


def _link_parts(rest: Column) -> Column:
    """Parts of a link text whose scheme has been taken off."""
    full_path = F.regexp_extract(rest, r"\A(?://[^/?#]*)?([^?#]*)", 1)
    return F.struct(
        F.regexp_extract(rest, r"\A//([^/?#]*)", 1).alias("authority"),
        F.regexp_replace(full_path, WITH_PARAMS, "$1").alias("path"),
        F.regexp_extract(full_path, PARAMS, 1).alias("params"),
        F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1).alias("query"),
        F.regexp_extract(rest, r"(?s)\A[^#]*#(.*)\z", 1).alias("fragment"),
    )


def _marked(mark: str, part: Column) -> Column:
    return F.when(part != "", F.concat(F.lit(mark), part)).otherwise(F.lit(""))


def _unreadable(authority: Column) -> Column:
    place = F.regexp_replace(authority, r"(?s)\A.*@", "")
    return authority.rlike(r"[\[\]]") & ~place.rlike(IPV6_AUTHORITY)


def _resolved(page: Column, link: Column) -> Column:
    """``link``, which has the scheme of ``page`` or none, as an absolute address."""

    def address(authority: Column, path: Column, params: Column, query: Column) -> Column:
        rooted = F.when((path == "") | path.startswith("/"), path).otherwise(
            F.concat(F.lit("/"), path)
        )
        return F.concat(
            page["scheme"],
            F.lit("://"),
            authority,
            rooted,
            _marked(";", params),
            _marked("?", query),
            _marked("#", link["fragment"]),
        )

    same_page_query = F.when(link["query"] != "", link["query"]).otherwise(page["query"])
    merged = _merged_path(page["path"], link["path"])
    return (
        F.when(
            link["authority"] != "",
            address(link["authority"], link["path"], link["params"], link["query"]),
        )
        .when(
            (link["path"] == "") & (link["params"] == ""),
            address(page["authority"], page["path"], page["params"], same_page_query),
        )
        .otherwise(
            bind(
                merged,
                lambda path: address(page["authority"], path, link["params"], link["query"]),
            )
        )
    )


def _resolve(page: Column, href: Column) -> Column:
    def with_scheme(link: Column) -> Column:
        scheme = F.lower(F.regexp_extract(link, SCHEME, 1))
        rest = F.when(scheme == "", link).otherwise(F.regexp_replace(link, SCHEME, ""))
        other_scheme = (scheme != "") & (scheme != page["scheme"])
        return bind(
            _link_parts(rest),
            lambda parts: F.when(_unreadable(parts["authority"]), F.lit(None).cast("string"))
            .when(other_scheme, href)
            .otherwise(_resolved(page, parts)),
        )

    return (
        F.when(href == "", page["given"])
        .when(href.rlike(PLAIN_ROOTED), F.concat(page["origin"], href))
        .when(href.rlike(PLAIN_ABSOLUTE), href)
        .when(
            page["folder"].isNotNull() & href.rlike(PLAIN_RELATIVE),
            F.concat(page["folder"], href),
        )
        .otherwise(bind(_clean(href), with_scheme))
    )


def resolve_link(base: Column, href: Column) -> Column:
    """The address a link text means on the page ``base``; NULL if it cannot be read.

    ``base`` is an absolute ``scheme://host...`` address.  Follows the usual reference
    resolution: same-scheme, protocol-relative, root-relative, relative, query-only
    and empty links; a link with another scheme comes back as it is.
    """
    return bind(_page_parts(base), lambda page: _resolve(page, href))


def resolve_links(base: Column, hrefs: Column) -> Column:
    """``resolve_link`` over an array; ``base`` is taken apart once."""
    return bind(_page_parts(base), lambda page: F.transform(hrefs, lambda h: _resolve(page, h)))


def is_web_address(url: Column) -> Column:
    """Whether a resolved link is worth visiting at all."""
    return url.startswith("http")
