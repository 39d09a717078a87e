"""Small text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters the Unicode standard counts as white space, plus the
# four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Whitespace-separated parts of ``text``; none of them empty."""
    return F.filter(F.split(text, f"[{WHITESPACE}]+"), lambda w: w != "")


def key_count(key: Column | str, count: Column | str) -> Column:
    """``key:count``."""
    return F.concat_ws(":", key, count)


def day_stamp(epoch_seconds: Column) -> Column:
    """``yyyyMMdd`` of the UTC day, whatever the session's time zone is."""
    days = F.floor(epoch_seconds / F.lit(86400)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyyMMdd")


def hour_stamp(epoch_seconds: Column) -> Column:
    """``HH`` of the UTC hour, whatever the session's time zone is."""
    return F.lpad(F.pmod(F.floor(epoch_seconds / F.lit(3600)), F.lit(24)).cast("string"), 2, "0")


def epoch_now() -> Column:
    """Whole seconds since 1970; one value for the whole query."""
    return F.unix_timestamp(F.current_timestamp())
