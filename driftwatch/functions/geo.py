"""Great-circle distance and implied travel speed as SQL expressions.

Expressions are text, so they fit `selectExpr`, `F.expr` and `spark.sql` alike; arguments are
column names or any other expressions.
"""

from __future__ import annotations

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half_chord = (
        f"sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    # rounding may push the half chord of antipodes a hair past 1, where asin is undefined;
    # not `least`, which would turn an unknown place into an antipode
    return f"{2 * EARTH_RADIUS_KM}D * asin(IF({half_chord} > 1D, 1D, {half_chord}))"


def speed_kmh(distance_km: str, elapsed_us: str, *, strict: bool = False) -> str:
    """Speed over an elapsed time; a non-positive time gives 0, or an error when `strict`."""
    otherwise = "cast(raise_error('elapsed time must be positive') AS double)" if strict else "0D"
    return (
        f"CASE WHEN {elapsed_us} > 0 THEN {distance_km} / ({elapsed_us} / 3600000000D) "
        f"ELSE {otherwise} END"
    )
