"""Rule scores, thresholds and the tunable policy."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the rule set.
SCORES = {
    "UNKNOWN_CARD": 50,
    "CARD_NOT_ACTIVE": 100,
    "VELOCITY": 45,
    "CARD_TESTING": 60,
    "DAILY_LIMIT": 80,
    "GEO_VELOCITY": 80,
    "MERCHANT_RISK": 20,
    "CUSTOMER_RISK_TIER": 10,
}
VELOCITY_MS = 60_000
VELOCITY_MOST = 5
TESTING_MS = 600_000
TESTING_BELOW_MINOR = 200
TESTING_ATTEMPTS = 4
TESTING_MERCHANTS = 3
GEO_LEAST_KM = 100.0
GEO_MOST_KMH = 900.0
HIGH_RISK = ("7995", "6051", "4829", "shopping_net", "misc_net")
REVIEW_FROM = 40
DECLINE_FROM = 71
MOST_SCORE = 100
DAY_MS = 86_400_000
LOCATION_TTL_MS = 7 * DAY_MS
ATTEMPT_TTL_MS = 3_600_000


@dataclass(frozen=True)
class Policy:
    """From ``certain_km`` on an impossible speed is certain; below it, it scores ``short_hop_score``."""

    certain_km: float = 500.0
    short_hop_score: int = 45

    def __post_init__(self):
        if not self.certain_km >= GEO_LEAST_KM:
            raise ValueError(f"certain_km must be at least {GEO_LEAST_KM:g}")
        if not 0 <= self.short_hop_score <= MOST_SCORE:
            raise ValueError(f"short_hop_score must lie between 0 and {MOST_SCORE}")


DEFAULT = Policy()
ORIGINAL = Policy(100.0, 0)
