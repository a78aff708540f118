"""The sequential part: what a card's earlier verdicts allow. One small pure-Python step, shared by batch and stream."""

from __future__ import annotations

import math
from collections import Counter, deque
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from .. import policy as P
from .attempts import Attempts


class Row(NamedTuple):
    """An enriched transaction. ``attempts`` is None where the card's own log (``attempts.Attempts``) has to count, for feeds
    whose rows come in any order of time."""

    t: int | None
    amount: int | None
    merchant: Any
    currency: str | None
    lat: float | None
    lon: float | None
    has_profile: bool
    status: str | None
    limit: int | None
    tier: str | None
    known: bool
    country: str | None
    category: str | None
    attempts: int | None = None


class Small:
    """Small amounts of the last ten minutes and their merchants, for rows in order of time; constant work a row."""

    def __init__(self):
        self.recent: deque[tuple[int, Any]] = deque()
        self.shops: Counter = Counter()

    def add(self, t: int, amount: int | None, merchant: Any) -> tuple[int, int]:
        if amount is not None and amount < P.TESTING_BELOW_MINOR:
            self.recent.append((t, merchant))
            self.shops[merchant] += 1
        while self.recent and self.recent[0][0] < t - P.TESTING_MS:
            gone = self.recent.popleft()[1]
            self.shops[gone] -= 1
            if not self.shops[gone]:
                del self.shops[gone]
        return len(self.recent), len(self.shops)


@dataclass
class Card:
    """What is known of a card between two transactions."""

    day: int | None = None
    spent: int = 0
    lat: float = 0.0
    lon: float = 0.0
    seen: int | None = None
    place: str | None = None
    attempts: Attempts = field(default_factory=Attempts)
    small: Small = field(default_factory=Small)


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    y, x = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    a = math.sin(y) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(x) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def _money(minor: int, currency: str) -> str:
    return f"{currency} {int(minor / 100)}.{abs(minor) % 100:02d}"


def step(card: Card, row: Row, policy: P.Policy = P.DEFAULT) -> tuple[str, int, list[tuple[str, int, str]]]:
    """Verdict, score and reasons of ``row``; ``card`` then is as the verdict leaves it: a declined transaction neither
    spends nor moves the card, but counts as an attempt.

    A null status is ACTIVE and a null limit no limit. Without an amount nothing is spent and no small amount tried;
    without a place the card doesn't move and no speed follows; without a time only the rules that need none apply, and
    the card stays as it is.
    """
    hits: list[tuple[str, int, str]] = []

    def hit(rule: str, detail: str, score: int | None = None) -> None:
        hits.append((rule, P.SCORES[rule] if score is None else score, detail))

    if not row.has_profile:
        hit("UNKNOWN_CARD", "card is not in the reference data")
    elif row.status is not None and row.status != "ACTIVE":
        hit("CARD_NOT_ACTIVE", f"card status is {row.status}")

    amount = row.amount or 0
    day, spent = None, 0
    if row.t is not None:
        attempts, small, shops = card.attempts.add(row.t, row.amount, row.merchant) if row.attempts is None else (row.attempts, *card.small.add(row.t, row.amount, row.merchant))
        if attempts > P.VELOCITY_MOST:
            hit("VELOCITY", f"{attempts} attempts in {P.VELOCITY_MS // 1000}s (max {P.VELOCITY_MOST})")
        if small >= P.TESTING_ATTEMPTS and shops >= P.TESTING_MERCHANTS:
            hit("CARD_TESTING", f"{small} attempts under EUR 2.00 across {shops} merchants in {P.TESTING_MS // 60_000} min")
        day = row.t // P.DAY_MS
        spent = card.spent if card.day == day else 0
        if row.has_profile and row.limit is not None and spent + amount > row.limit:
            hit("DAILY_LIMIT", f"{_money(spent, row.currency)} spent today + {_money(amount, row.currency)} would exceed the {_money(row.limit, row.currency)} limit")

    placed = row.t is not None and row.lat is not None and row.lon is not None
    if placed and card.seen is not None:
        km = km_between(card.lat, card.lon, row.lat, row.lon)
        if km >= P.GEO_LEAST_KM:
            gap = abs(row.t - card.seen)
            kmh = km / (gap / 3_600_000) if gap else math.inf
            if kmh > P.GEO_MOST_KMH:
                minutes, seconds = divmod(gap // 1000, 60)
                took = f"{minutes}m {seconds}s" if minutes else f"{seconds}s"
                speed = "Infinity" if math.isinf(kmh) else f"{kmh:.0f}"
                detail = f"{km:.0f} km from {card.place or 'last location'} to {(row.country if row.known else None) or 'here'} in {took} implies {speed} km/h"
                if km >= policy.certain_km:
                    hit("GEO_VELOCITY", detail)
                else:
                    hit("GEO_SHORT_HOP", detail, policy.short_hop_score)

    if row.category in P.HIGH_RISK:
        hit("MERCHANT_RISK", f"high-risk merchant category {row.category}")
    if hits and row.has_profile and row.tier == "HIGH":
        hit("CUSTOMER_RISK_TIER", "customer is HIGH risk tier")

    score = min(P.MOST_SCORE, sum(h[1] for h in hits))
    verdict = "DECLINE" if score >= P.DECLINE_FROM else "REVIEW" if score >= P.REVIEW_FROM else "APPROVE"
    if verdict != "DECLINE" and row.t is not None:
        if row.has_profile and not (card.day is not None and card.day > day):
            card.day, card.spent = day, spent + amount
        if placed and (card.seen is None or row.t >= card.seen):
            card.lat, card.lon, card.seen, card.place = row.lat, row.lon, row.t, row.country if row.known else None
    return verdict, score, hits
