"""A card's log of attempts in order of time, for feeds whose rows come in any order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from typing import Any

from .. import policy as P

#: Times are kept in buckets of a minute; an hour and ten minutes of them is all that is ever looked at.
BUCKET_MS = 60_000


class Times:
    """Sorted times in buckets, with a count for each: a range is counted from the buckets it spans."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}

    def add(self, t: int) -> None:
        insort(self.buckets.setdefault(t // BUCKET_MS, []), t)

    def between(self, low: int, high: int) -> int:
        """Times from ``low`` to ``high``, both included."""
        first, last = low // BUCKET_MS, high // BUCKET_MS
        n = sum(len(self.buckets.get(b, ())) for b in range(first, last))
        return n + bisect_right(self.buckets.get(last, ()), high) - bisect_left(self.buckets.get(first, ()), low)

    def upto(self, high: int) -> int:
        last = high // BUCKET_MS
        return sum(len(x) for b, x in self.buckets.items() if b < last) + bisect_right(self.buckets.get(last, ()), high)

    def forget(self, before: int) -> int:
        """Drops the buckets below ``before``; returns how many times were in them."""
        return sum(len(self.buckets.pop(b)) for b in [b for b in self.buckets if b < before])


class Attempts:
    """Attempts of one card: how many in the last minute, and of the last ten minutes the small ones and their merchants.

    Every row costs about the same, however long the log and whatever the order of rows. A merchant counts at a time t
    if t lies in one of the ten minutes after its small attempts, so a new attempt adds the part of its own ten minutes
    that the merchant's others don't cover: one start and one end. Merchants at t are the starts up to t less the ends.

    A row up to an hour older than the card's newest is counted exactly; an older one finds no log, counts itself alone and
    isn't kept, as attempts are kept for an hour.
    """

    def __init__(self):
        self.newest: int | None = None
        self.all, self.small, self.starts, self.ends = Times(), Times(), Times(), Times()
        self.shops: dict[Any, list[int]] = {}
        self.shops_of: dict[int, list[tuple[int, Any]]] = {}
        self.open = 0
        self.forgotten = 0

    def late(self, t: int) -> bool:
        return self.newest is not None and t < self.newest - P.ATTEMPT_TTL_MS

    def log(self, t: int, amount: int | None, merchant: Any) -> None:
        """Keeps an attempt without counting, as when a log is read back."""
        self.all.add(t)
        if amount is not None and amount < P.TESTING_BELOW_MINOR:
            self.small.add(t)
            self._cover(t, merchant)

    def _cover(self, t: int, merchant: Any) -> None:
        own = self.shops.setdefault(merchant, [])
        at = bisect_right(own, t)
        low = max(t, own[at - 1] + P.TESTING_MS + 1) if at else t
        high = min(t + P.TESTING_MS, own[at] - 1) if at < len(own) else t + P.TESTING_MS
        own.insert(at, t)
        self.shops_of.setdefault(t // BUCKET_MS, []).append((t, merchant))
        if low <= high:
            self.starts.add(low)
            self.ends.add(high + 1)

    def add(self, t: int, amount: int | None, merchant: Any) -> tuple[int, int, int]:
        """Attempts in the last minute, small ones in the last ten minutes and their merchants, this one included."""
        if self.late(t):
            few = int(amount is not None and amount < P.TESTING_BELOW_MINOR)
            return 1, few, few
        self.log(t, amount, merchant)
        if self.newest is None or t > self.newest:
            self.newest = t
            self._forget((t - P.ATTEMPT_TTL_MS - P.TESTING_MS) // BUCKET_MS)
        return self.all.between(t - P.VELOCITY_MS, t), self.small.between(t - P.TESTING_MS, t), self.open + self.starts.upto(t) - self.ends.upto(t)

    def _forget(self, bucket: int) -> None:
        if bucket <= self.forgotten:
            return
        self.forgotten = bucket
        self.all.forget(bucket)
        self.small.forget(bucket)
        self.open += self.starts.forget(bucket) - self.ends.forget(bucket)
        for b in [b for b in self.shops_of if b < bucket]:
            for t, merchant in self.shops_of.pop(b):
                own = self.shops[merchant]
                del own[bisect_left(own, t)]
                if not own:
                    del self.shops[merchant]
