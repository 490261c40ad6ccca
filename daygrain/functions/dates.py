"""Date and time column functions over zone-less wall-clock timestamps."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
_END_OF_DAY = time(23, 59, 59, 999000)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The shapes of dates that the sources write, each as (pattern, rewritten as ISO).  Both the column
# functions and ``window_bounds`` read them from here; day-first comes before month-first.
ZONE = r"(?i)\s*(?:Z|(?<=\d:\d{2}(?:[.:]\d{1,9})?)[+-]\d{2}:?\d{2})$"
YEAR_FIRST = r"^(\d{4})[:/](\d{1,2})[:/](\d{1,2})(?=\D|$)"
SHORT_YEAR = r"^(\d{1,2})/(\d{1,2})/(\d{2})(?=\D|$)"
SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
HALF_DAY = r"(?i)^(\S+)[ T]+(\d{1,2})((?::\d{2}){1,2}(?:\.\d+)?)\s*([ap])\.?m\.?$"
HALF_DAY_FORMAT = "yyyy-M-d h:mm[:ss][.SSS][ ]a"
FINER_THAN_MS = r"(\.\d{3})\d+$"
MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:t(?:ember)?)?",
          "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
_SEP, _END, _YEAR, _CLOCK = r"[\s\-./,]", r"(?=\D|$)", r"(\d{4}|\d{2})", r"(?:,\s*|\s+(?=\d{1,2}\s*[ap]))"
# Rarer shapes, rewritten one after the other: names first, then what stands where, then the year, then the clock.
# Numbers without slashes are month first, unless the first can be no month (then the day); "=" marks what is settled.
# Two-digit years are of this century.
REWRITES = (
    (r"(?i)\s*(?:UTC|GMT)$", ""),
    (r"(?i)^(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+", ""),
    (r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", r"\1"),
    *[(rf"(?i)(?<![a-z]){name}\.?(?![a-z])", f"~{i:02d}~") for i, name in enumerate(MONTHS, 1)],
    (r"^~(\d\d)~\s+(\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s+(\d{4})$", r"=\4-\1-\2 \3"),
    (rf"^~(\d\d)~{_SEP}*(\d{{1,2}}){_SEP}+{_YEAR}{_END}", r"=\3-\1-\2"),
    (rf"(?i)^(\d{{1,2}}){_SEP}*(?:of\s+)?~(\d\d)~{_SEP}*{_YEAR}{_END}", r"=\3-\2-\1"),
    (rf"^(\d{{4}}){_SEP}*~(\d\d)~{_SEP}*(\d{{1,2}}){_END}", r"=\1-\2-\3"),
    (r"^(\d{4})(\d\d)(\d\d)[Tt\s]?(\d\d)(\d\d)(\d\d)(?=\.|$)", r"=\1-\2-\3 \4:\5:\6"),
    (r"^(\d{4})(\d\d)(\d\d)[Tt\s]?(\d\d)(\d\d)$", r"=\1-\2-\3 \4:\5"),
    (r"^(\d{4})(\d\d)(\d\d)(?=[Tt\s,]|$)", r"=\1-\2-\3"),
    (r"^(\d\d)(\d\d)(\d\d)$", r"\1.\2.\3"),
    (rf"^(\d{{4}})\.(\d{{1,2}})\.(\d{{1,2}}){_END}", r"=\1-\2-\3"),
    (rf"^(1[3-9]|2\d|3[01])[.-](\d{{1,2}})[.-]{_YEAR}{_END}", r"=\3-\2-\1"),
    (rf"^(0?[1-9]|1[0-2])[.-](\d{{1,2}})[.-]{_YEAR}{_END}", r"=\3-\1-\2"),
    (rf"(?i)^(\d{{1,2}})/(0?[1-9]|1[0-2])/{_YEAR}{_CLOCK}", r"=\3-\2-\1 "),
    (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/{_YEAR}{_CLOCK}", r"=\3-\1-\2 "),
    (r"^=(\d\d)-", r"20\1-"),
    (r"^=", ""),
    (r"^(\d{4}-\d{1,2}-\d{1,2})\s*,\s*", r"\1 "),
    (r"(?i)(?<=[Tt\s])(\d{1,2})\s*([ap])\.?m\.?$", r"\1:00 \2m"),
)
DATE_ONLY = r"^(\d{4}-\d{2}-\d{2}|\d{4}[:/]\d{1,2}[:/]\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4})$"


def std_ts(c: Column | str, fmt: str | None = None) -> Column:
    """Parse raw text to ``TIMESTAMP_NTZ`` at millisecond precision.

    Slash dates are day first (month first only where day first is no date)
    unless they begin with the year; ``YYYY:MM:DD`` camera dates, ISO text and
    12-hour clocks are accepted, and the shapes of ``REWRITES``: month names,
    dots and dashes (month first), digits without separators, two-digit years.
    A trailing zone is dropped, not converted.  Texts without a day, month and
    year are not read.
    Empty and unparseable text gives NULL.  ``fmt`` overrides the guess with an
    explicit Spark datetime pattern.
    """
    text = F.trim(_col(c).cast("string"))
    if fmt is not None:
        return F.date_trunc("millisecond", F.try_to_timestamp(text, F.lit(fmt))).cast("timestamp_ntz")
    text = F.regexp_replace(text, ZONE, "")
    rare = _rare_shapes(text)
    text = F.regexp_replace(text, YEAR_FIRST, "$1-$2-$3")
    text = F.regexp_replace(text, FINER_THAN_MS, "$1")
    wide = F.regexp_replace(text, SHORT_YEAR, "$1/$2/20$3")
    read = []
    for iso in (F.regexp_replace(wide, SLASHES, "$3-$2-$1"), F.regexp_replace(wide, SLASHES, "$3-$1-$2")):
        dated = F.when(iso.rlike(r"^\d{4}-"), iso)
        read += [dated.try_cast("timestamp_ntz"), F.try_to_timestamp(dated, F.lit(HALF_DAY_FORMAT)).cast("timestamp_ntz")]
    return F.coalesce(*read, rare)


def _rare_shapes(text: Column) -> Column:
    """The shapes of ``REWRITES``.

    They come last and are bound in functions over a list of one, which are
    called where no other shape fits and add nothing to the generated code.
    """
    def spelled(c: Column) -> Column:
        iso = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1].replace("\\", "$")), REWRITES, c)
        return F.regexp_replace(iso, FINER_THAN_MS, "$1")

    def read(iso: Column) -> Column:
        dated = F.when(iso.rlike(r"^\d{4}-"), iso)
        return F.coalesce(dated.try_cast("timestamp_ntz"), F.try_to_timestamp(dated, F.lit(HALF_DAY_FORMAT)).cast("timestamp_ntz"))

    return F.transform(F.transform(F.array(text), spelled), read)[0]


def std_text(ts: Column | str) -> Column:
    """The canonical ``YYYY-MM-DD HH:MM:SS.fff`` text of a timestamp."""
    return F.date_format(_col(ts), TEXT_FORMAT)


def is_date_only(c: Column | str) -> Column:
    """True when the text is a date without a time."""
    return F.trim(_col(c)).rlike(DATE_ONLY)


class Bounds(NamedTuple):
    """A time window; ``upper`` belongs to it only when ``inclusive``."""

    lower: datetime
    upper: datetime
    inclusive: bool


def _parse_bound(text: str) -> tuple[datetime, bool]:
    """One window bound given by the caller, in the shapes of ``std_ts``, and whether it names a whole day."""
    text = text.strip()
    whole_day = re.fullmatch(DATE_ONLY, text) is not None
    text = re.sub(r"\s*(?:Z|(?<=:\d\d)[+-]\d{2}:?\d{2})$", "", text, flags=re.IGNORECASE)
    text = re.sub(YEAR_FIRST, r"\1-\2-\3", text)
    text = re.sub(SHORT_YEAR, r"\1/\2/20\3", text)
    if not re.match(r"\d{4}-\d|\d{1,2}/", text) or text[-1:].isalpha() or "," in text:
        for pattern, shape in REWRITES:
            text = re.sub(pattern, shape, text)
    slashes = re.match(SLASHES, text)
    if slashes:
        day, month, year = map(int, slashes.groups())
        if month > 12:
            day, month = month, day
        text = f"{year:04d}-{month:02d}-{day:02d}{text[slashes.end():]}"
    clock = re.fullmatch(HALF_DAY, text)
    if clock:
        hour = int(clock[2]) % 12 + (12 if clock[4].lower() == "p" else 0)
        text = f"{clock[1]} {hour:02d}{clock[3]}"
    text = re.sub(r"(?<=\d)[ T]+(\d):", r" 0\1:", text)
    text = re.sub(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?=\D|$)", lambda m: f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}", text)
    parsed = datetime.fromisoformat(text).replace(tzinfo=None)
    return parsed.replace(microsecond=parsed.microsecond // 1000 * 1000), whole_day


def day_of(text: str) -> date | None:
    """The calendar day of a raw date in the shapes of ``std_ts``, None where it is not readable."""
    try:
        return _parse_bound(text)[0].date()
    except ValueError:
        return None


def window_bounds(start: str, end: str | None = None) -> Bounds:
    """Resolve report arguments to a window.

    Without ``end`` the window runs to the end of the start day; a date-only
    end is inclusive to its last millisecond; an end with a time is exclusive.
    """
    lower, _ = _parse_bound(start)
    if end is None:
        return Bounds(lower, datetime.combine(lower.date(), _END_OF_DAY), True)
    upper, whole_day = _parse_bound(end)
    if whole_day:
        return Bounds(lower, datetime.combine(upper.date(), _END_OF_DAY), True)
    return Bounds(lower, upper, False)


def bound_columns(start: Column | str, end: Column | str) -> list[Column]:
    """``window_bounds`` for a table of windows: lower, upper, inclusive."""
    start, end = _col(start), _col(end)
    lower = std_ts(start)
    day_end = F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")
    upper = (F.when(end.isNull(), F.to_date(lower).cast("timestamp_ntz") + day_end)
             .when(is_date_only(end), F.to_date(std_ts(end)).cast("timestamp_ntz") + day_end)
             .otherwise(std_ts(end)))
    return [lower.alias("lower"), upper.alias("upper"),
            (end.isNull() | is_date_only(end)).alias("inclusive")]


def ntz(value: datetime | date) -> Column:
    """A zone-less timestamp literal, so comparisons stay pushable."""
    if not isinstance(value, datetime):
        value = datetime.combine(value, time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_window(ts: Column | str, bounds: Bounds) -> Column:
    """Range predicate of one window; plain comparisons, so it reaches the scan."""
    ts = _col(ts)
    upper = ts <= ntz(bounds.upper) if bounds.inclusive else ts < ntz(bounds.upper)
    return (ts >= ntz(bounds.lower)) & upper


def day(ts: Column | str) -> Column:
    """Calendar day of a timestamp."""
    return F.to_date(_col(ts))


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since the epoch, for exact gap arithmetic."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Signed gap in seconds as a double."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1e6)


def minute(ts: Column | str) -> Column:
    """Timestamp floored to its minute."""
    return F.date_trunc("minute", _col(ts)).cast("timestamp_ntz")


def minute_of_day(ts: Column | str) -> Column:
    """Minute number 0..1439 inside the day."""
    return F.hour(_col(ts)) * 60 + F.minute(_col(ts))


def dow(d: Column | str) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(_col(d))


def weekend_bin(d: Column | str) -> Column:
    """1 on Friday, Saturday and Sunday."""
    return F.weekday(_col(d)).isin(4, 5, 6).cast("int")


def day_name(d: Column | str) -> Column:
    """English weekday name."""
    return F.date_format(_col(d), "EEEE")


def hour_of_day(ts: Column | str) -> Column:
    """Hour of day as a float with two decimals."""
    ts = _col(ts)
    return F.round(F.hour(ts) + F.minute(ts) / F.lit(60.0)
                   + F.floor(F.second(ts)) / F.lit(3600.0), 2)


def midsleep(onset: Column | str, offset: Column | str) -> Column:
    """Circular midpoint of two hours of day, two decimals."""
    onset, offset = _col(onset), _col(offset)
    length = F.pmod(offset - onset, F.lit(24.0))
    return F.round(F.pmod(onset + length / 2, F.lit(24.0)), 2)


def lag_days(log_date: Column | str, submitted: Column | str) -> Column:
    """Days between the logged date and the submission (may be negative)."""
    return F.round(seconds_between(log_date, submitted) / F.lit(86400.0), 2)


def days_between_inclusive(start: str, end: str) -> int:
    """Number of calendar days of a horizon, both ends counted."""
    first, _ = _parse_bound(start)
    last, _ = _parse_bound(end)
    return (last.date() - first.date()) // timedelta(days=1) + 1
