"""Clock readings by integer arithmetic on microseconds (independent of the session zone).

All functions take and return SQL expression text.
"""

from __future__ import annotations

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US


def floor_div(value: str, width: int | str) -> str:
    """Floor division (plain `div` truncates, which differs before 1970)."""
    return f"(({value}) - pmod({value}, {width})) div {width}"


def hour_of_day(local_us: str) -> str:
    return f"cast(pmod({local_us}, {DAY_US}) div {HOUR_US} AS int)"


def weekday(local_us: str) -> str:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return f"cast(pmod({floor_div(local_us, DAY_US)} + 3, 7) AS int)"


def fractional_hour(local_us: str) -> str:
    """Hour plus minutes as a fraction; seconds are dropped."""
    return f"({hour_of_day(local_us)} + (pmod({local_us}, {HOUR_US}) div {MINUTE_US}) / 60D)"
