"""Small scalar functions shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Backoff bounds and the jitter fraction.
BACKOFF_BASE_SECONDS = 60
BACKOFF_MAX_SECONDS = 3600
JITTER_FRACTION = 0.25

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Date and time with an optional fraction and an optional zone; nothing else counts.
_ISO = r"^\s*(-?\d+)-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|[+-]\d\d(?::?\d\d)?)?\s*\z"


def is_blank(text: Column) -> Column:
    """True for null, empty and all-whitespace text, Unicode whitespace included."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def present(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def casefold_ascii(text: Column) -> Column:
    """Lower-case A to Z only; other letters keep their case."""
    return F.translate(text, _UPPER, _UPPER.lower())


def iso8601(ts: Column) -> Column:
    """UTC text to the second, the form every report uses."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso8601_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _rolled_over(text: Column) -> Column:
    """A date-time whose day, hour or second runs past its unit, carried into the next one."""
    parts = F.split(F.regexp_replace(text, _ISO, "$1,$2,$3,$4,$5,$6,$7,$8"), ",")

    def instant(p: Column) -> Column:
        year, month, day, hour, minute, second = (p[i].try_cast("int") for i in range(6))
        legal = (
            year.between(0, 9999) & month.between(1, 12) & day.between(1, 31)
            & minute.between(0, 59) & second.between(0, 60)
            & (hour.between(0, 23) | ((hour == 24) & (minute == 0) & (second == 0))))
        digits = F.regexp_replace(p[7], r"\D", "")
        ahead = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(
            F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
        offset = F.coalesce(F.when(p[7].startswith("-"), -ahead).otherwise(ahead), F.lit(0))
        micros = F.coalesce(F.rpad(F.substring(p[6], 2, 6), 6, "0").try_cast("long"), F.lit(0))
        start = F.unix_micros(F.date_add(F.make_date(year, month, F.lit(1)), day - 1).cast("timestamp"))
        seconds = (hour * 3600 + minute * 60 + second - offset).cast("long")
        return F.when(legal, F.timestamp_micros(start + seconds * 1_000_000 + micros))

    # The one-element transform binds the parts once instead of spelling them out in every use.
    return F.transform(F.array(parts), instant)[0]


def parse_iso8601(text: Column) -> Column:
    """Strict date-time text to an instant, null when it is not one.

    A calendar overflow the plain parser refuses (30 February, hour 24, second 60)
    rolls over into the next unit.
    """
    return F.when(text.rlike(_ISO), F.coalesce(
        F.try_to_timestamp(F.translate(F.trim(text), "tz", "TZ")), _rolled_over(text)))


def pct(numerator: Column, denominator: Column) -> Column:
    """Percentage to two places; null, never zero, on an empty base."""
    return F.round(F.lit(100.0) * numerator / F.nullif(denominator, F.lit(0)), 2)


def rate_per_hour(count: Column, seconds: Column) -> Column:
    return F.round(count * F.lit(3600.0) / F.nullif(seconds, F.lit(0)), 2)


def age_seconds(ts: Column, now: Column) -> Column:
    """Whole seconds from ``ts`` to ``now``, never negative, null kept."""
    micros = F.unix_micros(now) - F.unix_micros(ts)
    return F.when(micros.isNotNull(),
                  F.greatest(F.floor(micros / F.lit(1_000_000)).cast("long"), F.lit(0).cast("long")))


def seconds_before(now: Column, seconds: int | Column) -> Column:
    return shift_seconds(now, -(F.lit(seconds) if isinstance(seconds, int) else seconds))


def shift_seconds(ts: Column, seconds: int | Column) -> Column:
    """``ts`` moved by a number of seconds, fractions kept to the microsecond."""
    amount = F.lit(seconds) if isinstance(seconds, (int, float)) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + F.round(amount.cast("double") * F.lit(1_000_000)).cast("long"))


def backoff(attempts: Column, base: int = BACKOFF_BASE_SECONDS, ceiling: int = BACKOFF_MAX_SECONDS,
            jitter: Column | None = None) -> Column:
    """Delay in seconds after ``attempts`` failures.

    ``jitter`` is a fraction in [0, 1) such as ``F.rand(seed)``; left out, the delay is
    the exact doubling series, which is what replays and tests need.
    """
    exponent = F.greatest(F.coalesce(attempts, F.lit(1)).cast("double"), F.lit(1.0)) - 1
    plain = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), exponent), F.lit(float(ceiling)))
    spread = plain * F.lit(JITTER_FRACTION) * (F.lit(0.0) if jitter is None else jitter)
    return F.least(plain + spread, F.lit(float(ceiling)))


def truncate_text(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots when anything was lost."""
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
