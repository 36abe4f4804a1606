"""Posting dates and freshness."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode.functions.text import bind, clean

LAST_EPOCH_SECOND = 253402300799  # 9999-12-31T23:59:59Z

# The common form, which the engine's own cast reads as it is.
_USUAL = r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)$"

_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}-\d|\d{4}W\d{3}|\d{4}-W\d{2}|\d{4}W\d{2})"
_CLOCK = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_OFFSET = r"([+-]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?|\d{2}(?:\d{2})?)?)"
_ISO = rf"^(?!0000){_DATE}(?:.{_CLOCK}{_OFFSET}?)?$"


def _epoch_seconds(digits: Column) -> Column:
    """Ten digits are seconds, more are milliseconds."""
    number = digits.try_cast("decimal(38,0)")
    return F.when(F.length(digits) > 10, F.floor(number / 1000)).otherwise(number)


def _in_range(seconds: Column) -> Column:
    return F.coalesce(seconds <= LAST_EPOCH_SECOND, F.lit(False))


def _week_day(digits: Column) -> Column:
    """yyyy-mm-dd of an ISO week date given as year, week and optional weekday digits."""
    year = F.substring(digits, 1, 4)
    week = F.substring(digits, 5, 2).cast("int")
    weekday = F.rpad(F.substr(digits, F.lit(7)), 1, "1").cast("int")
    monday = F.date_trunc("week", F.concat(year, F.lit("-01-04")).cast("date")).cast("date")
    right = (week >= 1) & weekday.between(1, 7)
    return bind(
        F.date_add(monday, (week - 1) * 7 + weekday - 1),
        lambda day: F.when(right & (F.extract(F.lit("YEAROFWEEK"), day) == year.cast("int")), day.cast("string")),
    )


def _calendar_day(text: Column) -> Column:
    """yyyy-mm-dd from the calendar or week form of a date."""
    digits = F.regexp_replace(text, "[-W]", "")
    return F.when(text.contains("W"), bind(digits, _week_day)).otherwise(
        F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    )


def _clock_text(text: Column) -> Column:
    """hh:mm:ss.ffffff from the plain or compact form; missing parts are zero."""
    whole = F.rpad(F.regexp_replace(F.regexp_replace(text, "[.,].*$", ""), ":", ""), 6, "0")
    fraction = F.rpad(F.regexp_extract(text, r"[.,](\d{1,6})", 1), 6, "0")
    return F.concat(F.regexp_replace(whole, r"^(\d{2})(\d{2})(\d{2})$", "$1:$2:$3"), F.lit("."), fraction)


def _offset_seconds(text: Column) -> Column:
    """Signed seconds of ±hh[mm[ss]], zero for no offset."""
    digits = F.rpad(F.regexp_replace(F.regexp_replace(text, r"\..*$", ""), "[-+:]", ""), 6, "0")
    size = bind(
        digits,
        lambda d: F.substring(d, 1, 2).cast("int") * 3600
        + F.substring(d, 3, 2).cast("int") * 60
        + F.substring(d, 5, 2).cast("int"),
    )
    return F.when(text.startswith("-"), -size).otherwise(size)


def _from_iso(text: Column) -> Column:
    def moment(part: Column) -> Column:
        local = F.concat(
            _calendar_day(part[0]),
            F.lit(" "),
            F.when(part[1] == "", "00:00:00").otherwise(_clock_text(part[1])),
            F.lit("Z"),
        ).try_cast("timestamp")
        return bind(
            F.struct(local.alias("local"), _offset_seconds(part[2]).alias("offset")),
            lambda m: F.when(
                F.abs(m.offset) < 86400,
                F.timestamp_micros(F.unix_micros(m.local) - m.offset.cast("bigint") * 1000000),
            ),
        )

    def parse(iso: Column) -> Column:
        groups = F.array(*(F.regexp_extract(iso, _ISO, group) for group in (1, 2, 3)))
        return F.when(iso.rlike(_ISO), bind(groups, moment))

    return bind(F.replace(text, F.lit("Z"), F.lit("+00:00")), parse)


def posted_at(raw: Column) -> Column:
    """Timestamp from epoch digits or ISO text, NULL when neither; a missing offset means UTC."""

    def parse(text: Column) -> Column:
        return F.when(
            text.rlike("^[0-9]+$"),
            bind(_epoch_seconds(text), lambda s: F.when(_in_range(s), F.timestamp_seconds(s.cast("bigint")))),
        ).otherwise(_from_iso(text))

    return F.when(raw.rlike(_USUAL), raw.try_cast("timestamp")).otherwise(bind(clean(raw), parse))


def epoch_out_of_range(raw: Column) -> Column:
    """Digits that name a moment past the last supported year: the record is rejected, not NULLed."""
    eleven_or_more = raw.rlike(r"^\D*[0-9]{11,}\D*$")
    late = bind(clean(raw), lambda text: text.rlike("^[0-9]+$") & ~_in_range(_epoch_seconds(text)))
    return F.coalesce(F.when(eleven_or_more, late), F.lit(False))


def utc_moment(as_of: datetime | date) -> datetime:
    """Clock parameter as an aware UTC datetime; naive values are taken as UTC."""
    if not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    return as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of.astimezone(timezone.utc)


def freshness_days(posted: Column, as_of: datetime | date) -> Column:
    """Whole days since posting, never negative; fixed at ingest."""
    today = F.lit(utc_moment(as_of).date())
    return F.when(posted.isNotNull(), F.greatest(F.date_diff(today, F.to_date(posted)), F.lit(0)))


def audit_moment(as_of: datetime | date) -> Column:
    return F.lit(utc_moment(as_of)).cast("timestamp")


def iso_text(moment: Column) -> Column:
    """ISO text with a Z suffix, the export form of a timestamp."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))
