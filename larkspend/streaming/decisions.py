"""The decision stream: each card's state in a keyed state store, folded by the kernel that batches use."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, StringType, StructType, TimestampType

from ..operators.attempts import BUCKET_MS
from ..operators.decide import flatten
from ..operators.kernel import Card, Row, step
from ..policy import ATTEMPT_TTL_MS, DAY_MS, DEFAULT, LOCATION_TTL_MS, TESTING_MS, VELOCITY_MS, Policy
from ..schemas import REASON

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a session that runs these streams needs: state on disk, of which a batch uploads its changes alone. ``state_changes``
#: reads these.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: State variables of a card, as ``live_state`` names them.
VARIABLES = ("location", "spend", "attempts", "newest")
_ROWS = "t array<long>, amount array<long>, merchant array<string>"
#: Decisions that are handed on at once.
OUT_ROWS = 10_000


@dataclass(frozen=True)
class Ages:
    """How long what is known of a card is kept, and how often that is looked at. Spend goes when its day is further back
    than ``spend_days`` before the current one; all ages must be multiples of a minute where they bound attempts."""

    location_ms: int = LOCATION_TTL_MS
    spend_days: int = 1
    attempts_ms: int = ATTEMPT_TTL_MS
    every_ms: int = 3_600_000

    def due(self, seen: int | None, day: int | None, oldest: int | None) -> int | None:
        """The first sweep that finds any of these too old: last location, day of spend, start of the oldest bucket of
        attempts."""
        ends = [x for x in (None if seen is None else seen + self.location_ms, None if day is None else (day + self.spend_days + 1) * DAY_MS - 1, None if oldest is None else oldest + BUCKET_MS - 1 + self.attempts_ms) if x is not None]
        return (min(ends) // self.every_ms + 1) * self.every_ms if ends else None


#: Columns that rows are ordered by start so; a struct has one a field.
_ORDER = "order_"


def _ordered(rows: DataFrame) -> DataFrame:
    """``seq`` as plain columns, which pandas sorts without an object a row."""
    kind = rows.schema["seq"].dataType
    parts = [F.col("seq").getField(f) for f in kind.fieldNames()] if isinstance(kind, StructType) else [F.col("seq")]
    return rows.select(*(c.alias(f"{_ORDER}{k}") for k, c in enumerate(parts)), *(c for c in rows.columns if c != "seq"))


def _plain(column: pd.Series) -> list:
    """Values with None for what is missing."""
    return [None if x is None or x is pd.NA or x != x else x for x in column.tolist()]


def _stored(state) -> tuple | None:
    """A state variable's value, None if it has none."""
    return state.get() if state.exists() else None


def _whole(value):
    return None if value is None else int(value)


class Decider(StatefulProcessor):
    """Folds a card's new rows, in ``seq`` order inside a batch. ``t`` of late rows is theirs: nothing is filtered by it,
    every transaction gets a decision.

    Location, spend and attempts are state variables of their own. Attempts are a map by minute, of which a batch reads the
    minutes that its rows look back to and writes those that it adds to and a later row can look back to, whatever the
    length of the log. With ``ages``, one
    timer a card stands at the next sweep that finds something too old; it drops that, and no more.
    """

    def __init__(self, policy: Policy, names: list[str], ages: Ages | None = None, kept: str | None = None, wall: bool = False):
        self.policy, self.names, self.ages, self.kept, self.wall = policy, names, ages, kept, wall

    def init(self, handle) -> None:
        self.handle = handle
        self.spend = handle.getValueState("spend", "day long, spent long")
        self.location = handle.getValueState("location", "lat double, lon double, seen long, place string")
        self.newest = handle.getValueState("newest", "t long")
        self.attempts = handle.getMapState("attempts", "minute long", _ROWS)

    def _load(self, times: list[int]) -> tuple[Card, set[int], list[tuple]]:
        """The card as it was left, the minutes of attempts that are kept, and the attempts that ``times`` look back to. A card that was never seen costs one
        question, whatever its rows."""
        card, newest = Card(), _stored(self.newest)
        if newest is None:
            return card, set(), []
        card.attempts.newest = newest[0]
        spend, location = _stored(self.spend), _stored(self.location)
        if spend is not None:
            card.day, card.spent = spend
        if location is not None:
            card.lat, card.lon, card.seen, card.place = location
        known = {k[0] for k in self.attempts.keys()}  # noqa: SIM118
        wanted = {b for t in times if not card.attempts.late(t) for b in range((t - TESTING_MS) // BUCKET_MS, t // BUCKET_MS + 1)}
        log = sorted((row for b in wanted & known for row in zip(*self.attempts.getValue((b,)), strict=True)), key=lambda row: row[0])
        return card, known, log

    def _keep(self, card: Card, before: int | None, known: set[int], more: dict[int, list]) -> set[int]:
        """Writes what changed; returns the minutes of attempts that are kept now. What no later row can look back to, and
        no age holds longer, isn't kept: it goes here, before a sweep would find it."""
        if card.day is not None:
            self.spend.update((card.day, card.spent))
        if card.seen is not None:
            self.location.update((card.lat, card.lon, card.seen, card.place))
        if card.attempts.newest is not None and card.attempts.newest != before:
            self.newest.update((card.attempts.newest,))
        if card.attempts.newest is not None:
            held = ATTEMPT_TTL_MS + TESTING_MS if self.ages is None else max(ATTEMPT_TTL_MS + TESTING_MS, self.ages.attempts_ms)
            low = (card.attempts.newest - held) // BUCKET_MS
            more = {b: rows for b, rows in more.items() if b >= low}
            for b in [b for b in known if b < low]:
                self.attempts.removeKey((b,))
                known.discard(b)
        for b, rows in more.items():
            old = self.attempts.getValue((b,)) if b in known else ([], [], [])
            self.attempts.updateValue((b,), tuple([*o, *n] for o, n in zip(old, zip(*rows, strict=True), strict=True)))
        return known | more.keys()

    def _set_timer(self, seen: int | None, day: int | None, minutes: set[int], timers: list[int]) -> None:
        """One timer a card, at its next due sweep."""
        due = self.ages.due(seen, day, min(minutes) * BUCKET_MS if minutes else None)
        for at in timers:
            if at != due:
                self.handle.deleteTimer(at)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        feed = pd.concat(list(rows), ignore_index=True)
        keys = list(zip(*([(x is not None, x) for x in _plain(feed[c])] for c in feed.columns if c.startswith(_ORDER) or c == "txn_id"), strict=True))
        feed = feed.iloc[sorted(range(len(keys)), key=keys.__getitem__)]
        fields = ("t", "amount_minor", "merchant_id", "currency", "lat", "lon", "has_profile", "status", "daily_limit", "tier", "known", "country", "category")
        columns = [_plain(feed[c]) for c in fields]
        times = [int(t) for t in columns[0] if t is not None]
        card, minutes, log = self._load(times)
        before = card.attempts.newest
        # rows in order of time are counted as batches count them, others by the ordered log
        sliding = all(a <= b for a, b in pairwise(times if before is None else [before, *times]))
        recent = deque(row[0] for row in log) if sliding else None
        for row in log:
            card.small.add(*row) if sliding else card.attempts.log(*row)
        made, more = [], {}
        for t, amount, merchant, currency, lat, lon, has, status, limit, tier, known, country, category in zip(*columns, strict=True):
            t, amount, merchant = _whole(t), _whole(amount), str(merchant)
            if t is not None and not card.attempts.late(t):
                more.setdefault(t // BUCKET_MS, []).append((t, amount, merchant))
            attempts = None
            if sliding and t is not None:
                card.attempts.newest = t
                recent.append(t)
                while recent[0] < t - VELOCITY_MS:
                    recent.popleft()
                attempts = len(recent)
            verdict, score, hits = step(card, Row(t, amount, merchant, currency, lat, lon, bool(has), status, _whole(limit), tier, bool(known), country, category, attempts), self.policy)
            made.append((verdict, score, [{"rule": a, "score": b, "detail": c} for a, b, c in hits]))
        minutes = self._keep(card, before, minutes, more)
        if self.ages is not None:
            self._set_timer(card.seen, card.day, minutes, [] if before is None else list(self.handle.listTimers()))
        out = feed[["txn_id", "merchant_id", "t", "amount_minor", "labelled_fraud", *([self.kept] if self.kept else [])]].reset_index(drop=True)
        out.insert(1, "card_id", key[0])
        for name, values in zip(("decision", "score", "reasons"), zip(*made, strict=True), strict=True):
            out[name] = list(values)
        for low in range(0, len(out), OUT_ROWS):
            yield out.iloc[low : low + OUT_ROWS][self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A sweep, of this card alone: the last one that is due by now, which finds all that those before it would."""
        now = timerValues.getCurrentProcessingTimeInMs() if self.wall else timerValues.getCurrentWatermarkInMs()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), now // self.ages.every_ms * self.ages.every_ms)
        location, spend = _stored(self.location), _stored(self.spend)
        seen, day = None if location is None else location[2], None if spend is None else spend[0]
        if seen is not None and seen < now - self.ages.location_ms:
            self.location.clear()
            seen = None
        if day is not None and day < now // DAY_MS - self.ages.spend_days:
            self.spend.clear()
            day = None
        minutes = {k[0] for k in self.attempts.keys()}  # noqa: SIM118
        old = {b for b in minutes if (b + 1) * BUCKET_MS <= now - self.ages.attempts_ms}
        for b in old:
            self.attempts.removeKey((b,))
        self._set_timer(seen, day, minutes - old, list(self.handle.listTimers()))
        yield from ()

    def close(self) -> None:
        pass


def decide_stream(enriched: DataFrame, policy: Policy = DEFAULT, order: str = "seq", ages: Ages | None = None, clock: Column | None = None, event_time: bool = False, slack: str = "1 millisecond") -> DataFrame:
    """A streaming DataFrame of decisions (without ``evaluated_at``, which the sink knows).

    With ``ages``, state is swept: by the wall clock, or by ``clock``, a timestamp of each row's arrival that doesn't go
    back from one micro-batch to the next (for a replay, its own times; rows that go back are dropped, as late). By the
    wall clock a query runs until it is stopped. With ``event_time`` decisions have that clock as ``event_time``, with a
    watermark ``slack`` behind it, so that windows can follow in the same query.
    """
    if event_time and clock is None:
        raise ValueError("event_time needs a clock")
    rows = flatten(enriched, order)
    names = ["txn_id", "card_id", "merchant_id", "t", "amount_minor", "labelled_fraud"]
    schema = StructType([rows.schema[c] for c in names]).add("decision", StringType()).add("score", "integer").add("reasons", ArrayType(REASON))
    mode, kept, more = "none", None, {}
    if clock is not None:
        # a row at the watermark counts as late; a millisecond less keeps rows at the newest arrival
        rows = flatten(enriched.withColumn("__clock", clock), order, outer=("__clock",)).withColumnRenamed("__clock", "event_time").withWatermark("event_time", slack)
        mode = "eventTime"
        if event_time:
            kept, schema, more = "event_time", schema.add("event_time", TimestampType()), {"eventTimeColumnName": "event_time"}
    elif ages is not None:
        mode = "processingTime"
    decider = Decider(policy, schema.fieldNames(), ages, kept, mode == "processingTime")
    return _ordered(rows).groupBy("card_id").transformWithStateInPandas(decider, schema, "append", mode, **more)


def live_state(spark: SparkSession, checkpoint: str, name: str = "spend", operator: int = 0, batch: int | None = None) -> DataFrame:
    """One state variable (``VARIABLES``) of a running or stopped stream as of its last batch, or of ``batch``: key and value,
    for the map of attempts user_map_key and user_map_value."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def card_state(spark: SparkSession, checkpoint: str, card_id, operator: int = 0, batch: int | None = None) -> DataFrame:
    """What a stream knows of one card: spend_day, spent_minor, last_lat, last_lon, last_seen, last_place and attempts
    (t, amount, merchant, in order of time); no row if it knows nothing. Every variable is filtered by the key before
    they are put together."""
    state = {v: live_state(spark, checkpoint, v, operator, batch).where(F.col("key.card_id") == card_id) for v in VARIABLES[:3]}
    own = F.col("key.card_id").alias("card_id")
    spend = state["spend"].select(own, F.col("value.day").alias("spend_day"), F.col("value.spent").alias("spent_minor"))
    place = state["location"].select(own, *(F.col(f"value.{c}").alias(f"last_{c}") for c in ("lat", "lon", "seen", "place")))
    log = state["attempts"].select(own, F.explode(F.arrays_zip("user_map_value.t", "user_map_value.amount", "user_map_value.merchant")).alias("a"))
    log = log.groupBy("card_id").agg(F.array_sort(F.collect_list("a")).alias("attempts"))
    return spend.join(place, "card_id", "full").join(log, "card_id", "full")


def state_changes(spark: SparkSession, checkpoint: str, name: str = "spend", operator: int = 0, first: int = 0, last: int | None = None) -> DataFrame:
    """What the batches from ``first`` to ``last`` changed of a state variable: batch_id, change_type (update, delete), key
    and value."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).option("readChangeFeed", True).option("changeStartBatchId", first)
    return (reader if last is None else reader.option("changeEndBatchId", last)).load(checkpoint)
