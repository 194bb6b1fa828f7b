"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FORMAT = "yyyy-MM-dd"

# Layouts found in feeds after the weekday has been cut off and the zone been
# made a number: RFC 822, with four and two digits of the year, then ISO 8601.
FEED_FORMATS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yy HH:mm Z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd'T'HH:mm:ssZ",
    "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]
# Zone names of RFC 822, and India's.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "EST": "-0500", "EDT": "-0400",
         "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800",
         "PDT": "-0700", "IST": "+0530"}


def parse_date(c: Column, strict: bool = True) -> Column:
    """A date; an unreadable value raises, or is null when not ``strict``."""
    return F.to_date(c, DAY_FORMAT) if strict else F.try_to_date(c, DAY_FORMAT)


def feed_time(c: Column) -> Column:
    """Moment written in a feed; null for an unknown layout or zone name."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]+\.?, *", "")
    name = F.regexp_extract(bare, r" ([A-Z]{2,4})$", 1)
    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), name)
    bare = F.when(name == "", bare).otherwise(F.concat(F.regexp_replace(bare, r"[A-Z]+$", ""), offset))
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FEED_FORMATS])


def feed_date(published: Column, updated: Column, ingested: Column) -> Column:
    """Day of publication, else of the last update, else of ingestion (UTC)."""
    when = F.coalesce(feed_time(published), feed_time(updated), ingested)
    return F.date_format(when, DAY_FORMAT)


def date_is_known(published: Column, updated: Column) -> Column:
    """Whether :func:`feed_date` comes from the feed and not from the ingestion."""
    return F.coalesce(feed_time(published), feed_time(updated)).isNotNull()


def month_end(c: Column) -> Column:
    return F.last_day(c)


def week_end(c: Column) -> Column:
    """The Sunday that closes the week of the date."""
    return F.next_day(F.date_sub(c, 1), "SUN")
