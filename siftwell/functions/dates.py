"""Ages and date buckets.  Nothing reads a clock: every function that needs one takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of a relative date.
UNIT_SECONDS = {
    "second": 1, "sec": 1, "s": 1,
    "minute": 60, "min": 60, "m": 60,
    "hour": 3_600, "hr": 3_600, "h": 3_600,
    "day": 86_400, "d": 86_400,
    "week": 604_800, "w": 604_800,
    "month": 2_630_016, "mo": 2_630_016, "mos": 2_630_016,
    "year": 31_557_600, "yr": 31_557_600, "y": 31_557_600,
}
_UNITS = "|".join(sorted(UNIT_SECONDS, key=lambda u: (-len(u), u)))
RELATIVE = rf"(?iU)(\d+)\s*({_UNITS})s?\b"


def relative_age(text: Column) -> Column:
    """Days in ``3 weeks ago``, ``1mo``, ``yesterday``, ``just now``; null without a date.

    A word for now counts only without an explicit unit; ``yesterday`` wins over a unit.
    """
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    amount, unit = F.regexp_extract(low, RELATIVE, 1), F.lower(F.regexp_extract(low, RELATIVE, 2))
    seconds = F.create_map(*(F.lit(x) for pair in UNIT_SECONDS.items() for x in pair))[F.when(unit != "", unit)]
    return F.when((amount == "") & low.rlike("now|today|just posted"), 0.0).when(low.contains("yesterday"), 1.0).when(amount != "", amount.try_cast("double") * seconds / 86_400)


def age_days(stamp: Column, as_of: Column) -> Column:
    """Days from ``stamp`` to ``as_of`` (timestamps), never negative; null stays null."""
    return F.when(stamp.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / F.lit(86_400e6)))


def iso_age_days(text: Column, as_of: Column) -> Column:
    """Like :func:`age_days` for ISO text; what can't be read is null, what has no zone is UTC."""
    return age_days(F.try_to_timestamp(F.trim(text)), as_of)


def post_age(stamp: Column, label: Column, description: Column, as_of: Column) -> Column:
    """The machine-readable stamp first, then its label, then the description."""
    return F.coalesce(iso_age_days(stamp, as_of), relative_age(label), relative_age(description))


def humanised(days: Column) -> Column:
    """``5h ago``: truncated, in the largest unit that fits; null is ``unknown``."""

    def say(value: Column, unit: str) -> Column:
        return F.concat(value.cast("long").cast("string"), F.lit(unit + " ago"))

    return (
        F.when(days.isNull(), F.lit("unknown"))
        .when(days < 1 / 24, say(days * 1440, "m"))
        .when(days < 1, say(days * 24, "h"))
        .when(days < 7, say(days, "d"))
        .when(days < 30, say(days / 7, "w"))
        .otherwise(say(days / 30.44, "mo"))
    )


def date_bucket(days: Column) -> Column:
    """The narrowest coarse window that does not cut inside ``days``; null beyond a month."""
    return F.when(days <= 1, "past-24h").when(days <= 7, "past-week").when(days <= 31, "past-month")


def is_recent(days: Column, most: float, keep_undated: bool) -> Column:
    """Whether a record is inside the window; an age equal to ``most`` is."""
    return F.coalesce(days <= most, F.lit(keep_undated))
