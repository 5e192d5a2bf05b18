"""Most likely attack pattern of a suspicious event, with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftwatch.functions.text import present, quote, whole
from driftwatch.operators.risk import feature

# Attack types in tie order, and the least score that names one.
ATTACK_TYPES = (
    "brute_force",
    "credential_stuffing",
    "impossible_travel",
    "lateral_movement",
    "device_spoofing",
)
MIN_CONFIDENCE = 0.40
# End of fixed values.


def signatures(df: DataFrame) -> dict[str, list[tuple[float, str, str | None]]]:
    """Weight, condition and wording of every sign, per attack type (SQL expressions).

    Weights are doubles added in this order, so that equal sums tie exactly.
    """
    failed = feature(df, "failed_logins_10m")
    events = feature(df, "events_10m")
    fanout = feature(df, "source_ip_entity_fanout_10m")
    speed = feature(df, "implied_speed_kmh")
    distance = feature(df, "distance_from_previous_km")
    mismatch = feature(df, "device_fingerprint_mismatch")
    new_device = feature(df, "is_new_device")
    new_resource = feature(df, "is_new_resource")
    resources = feature(df, "unique_resources_30m")
    velocity = feature(df, "resource_access_velocity_30m")
    return {
        "brute_force": [
            (0.65, f"{failed} >= 5", f"concat({whole(failed)}, ' failed logins occurred within 10 minutes')"),
            (0.20, f"{events} >= 6", f"concat({whole(events)}, ' events occurred within 10 minutes')"),
        ],
        "credential_stuffing": [
            (
                0.70,
                f"{fanout} >= 4",
                f"concat('Source IP accessed ', {whole(fanout)}, ' entities within 10 minutes')",
            ),
            (
                0.20,
                f"{fanout} >= 4 AND {failed} >= 1",
                quote("Multi-entity activity included authentication failures"),
            ),
        ],
        "impossible_travel": [
            (0.75, f"{speed} >= 1000", f"concat('Travel would require ', {whole(speed)}, ' km/h')"),
            (
                0.20,
                f"{distance} >= 3000",
                f"concat('Consecutive activity occurred ', {whole(distance)}, ' km apart')",
            ),
        ],
        "lateral_movement": [
            (
                0.40,
                f"{resources} >= 4",
                f"concat({whole(resources)}, ' unique resources were accessed within 30 minutes')",
            ),
            (0.30, f"{velocity} >= 0.15D", quote("Resource access velocity was unusually high")),
            (
                0.20,
                f"{new_resource} >= 1",
                quote("Entity accessed a resource outside its behavioral baseline"),
            ),
        ],
        "device_spoofing": [
            (0.80, f"{mismatch} >= 1", quote("Known device ID presented a different fingerprint")),
            (0.10, f"{mismatch} >= 1 AND {new_device} >= 1", None),
        ],
    }


def classify(df: DataFrame) -> DataFrame:
    """Add `anomaly_type`, `classification_confidence` and `classification_evidence`.

    Needs `is_suspicious`; events that are not suspicious are `normal` with confidence 1.
    """
    found = signatures(df)
    scores = {
        kind: " + ".join(f"IF({when}, {weight}D, 0D)" for weight, when, _ in found[kind])
        for kind in ATTACK_TYPES
    }
    texts = {
        kind: present(*[f"IF({when}, {text}, NULL)" for _, when, text in found[kind] if text])
        for kind in ATTACK_TYPES
    }
    # the first type that reaches the best score wins a tie
    named = " ".join(f"WHEN score_{kind} = best THEN '{kind}'" for kind in ATTACK_TYPES)
    shown = " ".join(f"WHEN '{kind}' THEN {texts[kind]}" for kind in ATTACK_TYPES)
    inner = ["best", *[f"score_{kind}" for kind in ATTACK_TYPES]]
    return df.selectExpr(
        "*",
        *[f"{score} AS score_{kind}" for kind, score in scores.items()],
        f"greatest({', '.join(inner[1:])}) AS best",
        f"CASE WHEN NOT is_suspicious THEN 'normal' WHEN best < {MIN_CONFIDENCE}D THEN 'unknown' "
        f"{named} END AS anomaly_type",
        "IF(is_suspicious, least(best, 1D), 1D) AS classification_confidence",
        f"CASE anomaly_type {shown} ELSE cast(array() AS array<string>) END AS classification_evidence",
    ).drop(*inner)
