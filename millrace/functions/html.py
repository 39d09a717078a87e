"""HTML expressions built from JVM string functions; no Python workers.

Each pattern reads a document once from its start.  The loops are possessive, so
they neither back-track nor recurse, whatever the document's length, and anchored,
so a document without a match is not searched again from every position.
Comments, scripts, styles and quoted attribute values are stepped over.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import bind
from millrace.functions.text import strip

# What may stand inside a tag after its name: anything up to ``>``, where a quoted
# value after ``=`` may hold ``>`` itself.
_INSIDE_TAG = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
_COMMENT = r"<!--(?:-?>|.*?(?:-->|\z))"
# Declarations, marked sections and processing instructions.  An open section runs to the end.
_DECLARATION = (
    r"<!\[(?:cdata|temp|ignore|include|rcdata)(?![-_.a-z0-9]).*?(?:\]\s*+\]\s*+>|\z)"
    r"|<!\[(?:if|else|endif)(?![-_.a-z0-9]).*?(?:\]\s*+>|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
)


def _raw_text(group: int) -> str:
    """A script or style element; ``group`` is the number its name capture gets."""
    return rf"<(script|style)(?=[\s/>]){_INSIDE_TAG}>.*?(?:</\{group}(?=[\s/>])|\z)"


TITLE = (
    rf"(?is)\A(?:[^<]++|{_COMMENT}|{_DECLARATION}|{_raw_text(1)}"
    rf"|<(?!title[\s/>])(?:[a-z/]{_INSIDE_TAG}(?:>|\z))?+)*+"
    rf"<title(?=[\s/>]){_INSIDE_TAG}>(.*?)(?:</title(?=[\s/>])|\z)"
)
ANCHOR_TAGS = (
    rf"(?is)\G(?:[^<]++|{_COMMENT}|{_DECLARATION}|{_raw_text(1)}"
    rf"|<(?!a[\s/])(?:[a-z/]{_INSIDE_TAG}(?:>|\z))?+)*+"
    rf"<a(?=[\s/])({_INSIDE_TAG})>"
)
ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s]*+))?+"""
HREF = r"(?i)\Ahref(?:\z|[\s=])"
HREF_VALUE = r"""(?is)\Ahref\s*+=*+\s*+(?:"([^"]*)"|'([^']*)'|(.*))\z"""
# The text of an element that holds one text node, possibly inside nested elements.
ONLY_TEXT = r"(?s)\A(?:<[A-Za-z][^>]*+>)*+([^<]*+)(?:</[A-Za-z][^>]*+>)*+\z"

REFERENCE = r"\A(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Windows-1252 for code points 0x80-0x9F, as HTML reads them; the five
# places that encoding leaves open stay control characters.
_C1 = "".join(
    bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)
)


def _is_dropped(code: Column) -> Column:
    """Code points that are not characters; a reference to one gives nothing."""
    return (
        code.between(0x1, 0x8)
        | code.between(0xE, 0x1F)
        | code.between(0x7F, 0x9F)
        | code.between(0xFDD0, 0xFDEF)
        | (code == 0xB)
        | (code % 0x10000 >= 0xFFFE)
    )


def _character(code: Column) -> Column:
    """The text of a numeric reference; ``code`` is NULL if it was too long to be one."""
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.substring(F.lit(_C1), code.cast("int") - 0x7F, F.lit(1)))
        .when(code == 0x0D, F.lit("\r"))
        .when(_is_dropped(code), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _numeric(digits: Column, base: int) -> Column:
    def code(significant: Column) -> Column:
        return F.when(F.length(significant) <= 8, F.conv(significant, base, 10).cast("bigint"))

    return bind(bind(F.regexp_replace(digits, r"\A0+(?=.)", ""), code), _character)


def _named(name: Column) -> Column:
    """What ``name`` (with its ``;`` if any) stands for; NULL if nothing.

    The standard library's table serves; it includes old names that need no ``;`` and
    so may be followed by other letters.
    """
    names = html.entities.html5
    unclosed = {n: names[n] for n in sorted(names, key=len, reverse=True) if not n.endswith(";")}

    def table(entries: dict[str, str]) -> Column:
        return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")

    def by_prefix(prefix: Column) -> Column:
        tail = F.substring(name, F.length(prefix) + 1, F.length(name))
        return F.when(prefix != "", F.concat(F.try_element_at(table(unclosed), prefix), tail))

    return F.coalesce(
        F.try_element_at(table(names), name),
        bind(F.regexp_extract(name, rf"\A({'|'.join(unclosed)})", 1), by_prefix),
    )


def _decode_piece(piece: Column) -> Column:
    """``piece`` is what followed one ``&``."""

    def decoded(reference: Column) -> Column:
        body = F.regexp_replace(reference, r";\z", "")
        rest = F.substring(piece, F.length(reference) + 1, F.length(piece))
        meaning = (
            F.when(body.rlike(r"\A#[0-9]"), _numeric(F.substring(body, 2, 2**31 - 1), 10))
            .when(body.startswith("#"), _numeric(F.substring(body, 3, 2**31 - 1), 16))
            .when(reference != "", _named(reference))
        )
        return F.coalesce(F.concat(meaning, rest), F.concat(F.lit("&"), piece))

    def after(length: int) -> Column:
        return F.substring(piece, length + 1, 2**31 - 1)

    return (
        F.when(piece.startswith("amp;"), F.concat(F.lit("&"), after(4)))
        .when(piece.startswith("lt;"), F.concat(F.lit("<"), after(3)))
        .when(piece.startswith("gt;"), F.concat(F.lit(">"), after(3)))
        .when(piece.startswith("quot;"), F.concat(F.lit('"'), after(5)))
        .otherwise(bind(F.regexp_extract(piece, REFERENCE, 1), decoded))
    )


def unescape(text: Column) -> Column:
    """Character references replaced by what they stand for."""

    def joined(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        return F.concat(
            F.element_at(pieces, 1), F.array_join(F.transform(rest, _decode_piece), "")
        )

    return F.when(text.contains("&"), bind(F.split(text, "&", -1), joined)).otherwise(text)


def _title_text(document: Column) -> Column:
    """Text of the first title element as written; empty if it has none or several nodes."""
    return F.regexp_extract(F.regexp_extract(document, TITLE, 2), ONLY_TEXT, 1)


def _href_of_tag(inside: Column) -> Column:
    """The href value of one tag as written, or NULL; the last one if it is given twice."""
    attributes = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))
    href = F.try_element_at(F.filter(attributes, lambda a: a.rlike(HREF)), F.lit(-1))
    return F.regexp_replace(href, HREF_VALUE, "$1$2$3")


def _hrefs(document: Column) -> Column:
    tags = F.regexp_extract_all(document, F.lit(ANCHOR_TAGS), F.lit(2))
    return F.filter(F.transform(tags, _href_of_tag), lambda href: href.isNotNull())


def page_title(document: Column) -> Column:
    """Text of the first title element, stripped; empty if it has none or several nodes."""
    return F.coalesce(strip(bind(_title_text(document), unescape)), F.lit(""))


def link_texts(document: Column) -> Column:
    """The ``href`` texts of a document's ``<a>`` tags, in order, repeats included."""
    return F.transform(_hrefs(document), unescape)


def _raw_attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag's text as written, without its quotes; NULL without one."""
    value = rf"""(?is)(?:\A|[\s"'/]){name}\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(value), F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)]))


def _first_of_names(entries: Column) -> Column:
    """``name`` and ``content`` of each name's first entry, in order of names."""
    placed = F.transform(entries, lambda e, i: F.struct(e["name"].alias("name"), i.alias("at"), e["content"].alias("content")))

    def first(ordered: Column) -> Column:
        return F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i - 1)["name"] != e["name"], F.lit(True)))

    return bind(F.array_sort(placed), first)


RECORD_TAGS = ANCHOR_TAGS.replace(r"<(?!a[\s/])", r"<(?!(?:html|meta|link|a)[\s/])").replace(
    rf"<a(?=[\s/])({_INSIDE_TAG})>", rf"<((?:html|meta|link|a)(?=[\s/]){_INSIDE_TAG})>"
)


def page_language(document: Column) -> Column:
    """The ``lang`` of the root element; NULL if it has none."""
    tags = F.regexp_extract_all(document, F.lit(RECORD_TAGS), F.lit(2))
    root = F.get(F.filter(tags, lambda tag: tag.rlike(r"(?i)\Ahtml[\s/]")), F.lit(0))
    return unescape(_raw_attribute(root, "lang"))


def page_record(document: Column) -> Column:
    """The wide record of a document, as a struct.

    ``title``, ``lang`` (of the root element), ``charset`` (of the first ``meta`` that has one),
    ``canonical`` (of the first ``link`` that names it), ``links`` (as ``link_texts``) and ``meta``: the
    content of every ``meta`` element with a ``name`` or else a ``property``, by that name in lower case;
    of several with one name the first counts.  NULL where there is none; ``links`` and ``meta`` may be
    empty.  All but the title come from one pass over the document, and all texts go through one
    ``unescape``.
    """
    def named(tags: Column, name: str) -> Column:
        return F.filter(tags, lambda tag: tag.rlike(rf"(?i)\A{name}[\s/]"))

    def first(values: Column) -> Column:
        return F.get(F.filter(values, lambda value: value.isNotNull()), F.lit(0))

    def canonical(tag: Column) -> Column:
        return F.when(F.lower(_raw_attribute(tag, "rel")) == "canonical", _raw_attribute(tag, "href"))

    def entry(tag: Column) -> Column:
        name = F.lower(F.coalesce(_raw_attribute(tag, "name"), _raw_attribute(tag, "property")))
        return F.struct(name.alias("name"), _raw_attribute(tag, "content").alias("content"))

    def parts(tags: Column) -> Column:
        metas = named(tags, "meta")
        entries = F.filter(F.transform(metas, entry), lambda e: e["name"].isNotNull() & e["content"].isNotNull())
        single = [
            _title_text(document),
            F.get(F.transform(named(tags, "html"), lambda tag: _raw_attribute(tag, "lang")), F.lit(0)),
            first(F.transform(metas, lambda tag: _raw_attribute(tag, "charset"))),
            first(F.transform(named(tags, "link"), canonical)),
        ]
        links = F.filter(F.transform(named(tags, "a"), _href_of_tag), lambda href: href.isNotNull())
        return F.struct(
            F.array(*single).alias("single"), links.alias("links"), _first_of_names(entries).alias("meta")
        )

    def record(found: Column) -> Column:
        single, links, meta = found["single"], found["links"], found["meta"]
        written = F.concat(single, links, F.transform(meta, lambda e: e["content"]))
        names = F.transform(meta, lambda e: e["name"])

        def fields(texts: Column) -> Column:
            contents = F.slice(texts, F.size(links) + 5, F.size(meta))
            return F.struct(
                F.coalesce(strip(F.get(texts, F.lit(0))), F.lit("")).alias("title"),
                *[F.get(texts, F.lit(i)).alias(name) for i, name in enumerate(("lang", "charset", "canonical"), 1)],
                F.slice(texts, F.lit(5), F.size(links)).alias("links"),
                F.map_from_arrays(names, contents).alias("meta"),
            )

        return bind(F.transform(written, unescape), fields)

    tags = F.regexp_extract_all(document, F.lit(RECORD_TAGS), F.lit(2))
    return F.when(document.isNotNull(), bind(bind(tags, parts), record))


def title_and_links(document: Column) -> Column:
    """``page_title`` and ``link_texts`` as the fields ``title`` and ``hrefs``.

    All texts go through one ``unescape``, whose table of names makes up most of a plan.
    """
    written = F.concat(F.array(_title_text(document)), _hrefs(document))
    return bind(
        F.transform(written, unescape),
        lambda texts: F.struct(
            strip(F.element_at(texts, 1)).alias("title"),
            F.slice(texts, F.lit(2), F.size(texts) - 1).alias("hrefs"),
        ),
    )
