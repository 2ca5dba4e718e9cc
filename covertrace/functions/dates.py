"""Publication times as delivered, day indexes relative to a campaign's publication."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of a timestamp in the order in which they are tried; the first of each pair says whether
# the form has an offset.
FORMS = (
    (True, "yyyy-MM-dd'T'HH:mm:ssXX"),
    (False, "yyyy-MM-dd'T'HH:mm:ss"),
    (True, "yyyy-MM-dd HH:mm:ssXX"),
    (False, "yyyy-MM-dd HH:mm:ss"),
    (False, "yyyy-MM-dd HH:mm"),
    (False, "yyyy-MM-dd"),
    (False, "d/M/yyyy HH:mm"),
    (False, "d/M/yyyy"),
    (False, "d-M-yyyy"),
    (False, "M/d/yyyy"),
    (False, "d MMMM yyyy"),
    (False, "d MMM yyyy"),
    (False, "MMMM d, yyyy"),
    (False, "MMM d, yyyy"),
)


def prepared(text: Column) -> Column:
    """A timestamp's text with Z and colons of offsets in the one spelling that the forms know."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, "[Zz]$", "+0000")
    return F.regexp_replace(t, r"([+-]\d{2}):(\d{2})$", "$1$2")


def has_offset(text: Column) -> Column:
    return prepared(text).rlike(r"\d{2}:?\d{2}.*[+-]\d{4}$") & prepared(text).rlike(r"[T ]")


def wall_clock(text: Column) -> Column:
    """The wall clock as written (no conversion); null where no form fits. Day comes before month where both fit."""
    t = prepared(text)
    bare = F.regexp_replace(t, r"[+-]\d{4}$", "")
    tries = []
    for offset, form in FORMS:
        if offset:
            shape = form.removesuffix("XX")
            tries.append(F.when(t.rlike(r"[+-]\d{4}$"), F.try_to_timestamp(bare, F.lit(shape)).cast("timestamp_ntz")))
        else:
            tries.append(F.try_to_timestamp(t, F.lit(form)).cast("timestamp_ntz"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)?([+-]\d{4})?$"), F.regexp_replace(bare, ",", ".").try_cast("timestamp_ntz"))
    compact = F.when(t.rlike(r"^\d{8}T\d{6}([+-]\d{4})?$"), F.try_to_timestamp(bare, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"))
    return F.coalesce(*tries, iso, compact)


def offset_minutes(text: Column) -> Column:
    """The offset east of UTC in minutes; null for a naive time."""
    t = prepared(text)
    sign = F.when(F.substring(t, -5, 1) == "-", -1).otherwise(1)
    return F.when(has_offset(text), sign * (F.substring(t, -4, 2).try_cast("int") * 60 + F.substring(t, -2, 2).try_cast("int")))


def known_zone(zone: Column) -> Column:
    """``zone`` if it is an IANA name, else UTC."""
    return F.when(zone.isin(sorted(available_timezones())), zone).otherwise("UTC")


def local_date(text: Column, zone: Column) -> Column:
    """The calendar date in ``zone``: a naive time has its own date, one with an offset is moved."""
    wall, off = wall_clock(text), offset_minutes(text)
    utc = wall - F.make_dt_interval(mins=off)
    return F.when(off.isNull(), wall.cast("date")).otherwise(F.convert_timezone(F.lit("UTC"), known_zone(zone), utc).cast("date"))


def day_index(published: Column, campaign_published: Column, zone: Column) -> Column:
    """Days from the campaign's publication, by local calendar date; null where either can't be placed."""
    return F.datediff(local_date(published, zone), local_date(campaign_published, zone))


def date_of_day(campaign_published: Column, zone: Column, day: Column) -> Column:
    return F.date_add(local_date(campaign_published, zone), day)


def feed_date(text: Column) -> Column:
    """The wall clock of a feed's date: RFC 822 (any weekday), else as ``wall_clock``."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    clock = F.regexp_extract(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)", 1)
    rfc = F.coalesce(F.try_to_timestamp(clock, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(clock, F.lit("d MMM yyyy HH:mm")))
    return F.coalesce(F.when(clock != "", rfc).cast("timestamp_ntz"), wall_clock(text))
