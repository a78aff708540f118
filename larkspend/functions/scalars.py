"""Column functions: distances, guarded ratios, money and duration texts, enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import DAY_MS
from ..schemas import DEFAULTS, SYMBOLS

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance of two points in degrees."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def implied_kmh(km, ms) -> Column:
    """Speed over ``ms`` milliseconds; infinite for a jump in no time, 0 for no jump."""
    still = F.when(km > 0, F.lit(float("inf"))).otherwise(0.0)
    return F.when(ms <= 0, still).otherwise(km / (ms / 3_600_000.0))


def epoch_day(t) -> Column:
    return F.floor(t / DAY_MS)


def ratio(part, whole) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def rounded(number, digits: int = 6) -> Column:
    """A double to ``digits`` decimals: number * 10^digits to the nearest whole number, halves away from zero. Spark's own
    rounding starts from the shortest decimal text of the number, so that large numbers are rounded twice."""
    scale = 10.0**digits
    return F.round(number * scale, 0) / scale


def minor_units(amount) -> Column:
    """Decimal text to hundredths, half up."""
    return F.round(amount.cast("decimal(18,6)") * 100, 0).cast("long")


def money(minor, currency) -> Column:
    whole = F.when(minor < 0, F.ceil(minor / 100)).otherwise(F.floor(minor / 100))
    return F.format_string("%s %d.%02d", currency, whole.cast("long"), F.abs(minor % 100))


def duration(ms) -> Column:
    minutes, seconds = F.floor(ms / 60_000), F.floor(ms / 1000) % 60
    return F.when(minutes > 0, F.format_string("%dm %ds", minutes, seconds)).otherwise(F.format_string("%ds", seconds))


def percentage(share) -> Column:
    """Two digits below one percent, else one."""
    p = share * 100
    return F.when((F.abs(p) < 1) & (p != 0), F.format_string("%.2f%%", p)).otherwise(F.format_string("%.1f%%", p))


def thousands(n) -> Column:
    return F.format_number(n, 0)


def dollars(minor) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(minor / 100), 0))


def shorten(text, most: int = 1000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def symbol(column: str) -> Column:
    """The column's symbol, or its enumeration's default."""
    return F.when(F.col(column).isin(*SYMBOLS[column]), F.col(column)).otherwise(DEFAULTS[column])
