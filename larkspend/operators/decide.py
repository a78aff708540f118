"""Decisions over a whole feed: every card folded in its order, all cards side by side."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..policy import DAY_MS, DEFAULT, LOCATION_TTL_MS, Policy
from ..schemas import REASON
from ..sources.shared import kept
from .features import attempt_counts, risk_category
from .hot import fold_hot
from .kernel import Card, Row, step

#: A card of more transactions is worth several tasks. Ids up to so many are broadcast to pick cards.
HOT_ROWS, BROADCAST_CARDS = 1_000_000, 100_000
_STATE = ("spend_day", "spent_minor", "last_lat", "last_lon", "last_seen", "last_place")


def flatten(enriched: DataFrame, order: str = "seq", keep: tuple[str, ...] = (), outer: tuple[str, ...] = ()) -> DataFrame:
    """The columns that a fold reads, one row a transaction; ``keep`` names fields of it that go along, ``outer`` columns
    beside it."""
    x = lambda c: F.col(f"transaction.{c}")
    return enriched.select(
        x("transaction_id").alias("txn_id"), x("card_id").alias("card_id"), x(order).alias("seq"), x("merchant_id").alias("merchant_id"), x("t").alias("t"), x("amount_minor").alias("amount_minor"), x("currency").alias("currency"),
        x("lat").alias("lat"), x("lon").alias("lon"), x("labelled_fraud").alias("labelled_fraud"), F.col("card_profile").isNotNull().alias("has_profile"), F.col("card_profile.status").alias("status"), F.col("card_profile.daily_limit_minor").alias("daily_limit"),
        F.col("card_profile.risk_tier").alias("tier"), F.col("merchant").isNotNull().alias("known"), F.col("merchant.country").alias("country"), risk_category().alias("category"), *(x(k).alias(k) for k in keep if k != "seq"), *outer,
    )


_ROW = ("t", "amount_minor", "merchant_id", "currency", "lat", "lon", "has_profile", "status", "daily_limit", "tier", "known", "country", "category", "attempts_60s")


def decide_each(enriched: DataFrame, policies: Mapping[str, Policy], ordered: bool = True, evaluated_at_ms: int = 0, order: str = "seq", keep: tuple[str, ...] = (), hot: DataFrame | None = None) -> DataFrame:
    """One decision a transaction and policy, with the card's state after it; the feed is read, shuffled and sorted once
    for all policies, each of which has its own state of a card.

    ``ordered`` says that each card's transactions arrive in event-time order (ties by id); attempt counts are then
    window expressions and a sliding count. Otherwise each card's own log counts them, in the order of ``seq``. The fold
    streams through sorted partitions and holds one card's state, never one card's rows.

    ``hot`` (card_id, as ``hot_cards`` finds them) names cards that are too long for one task: in an ordered feed their
    days are folded side by side (``hot.fold_hot``), with the same result.
    """
    if hot is not None and not ordered:
        raise ValueError("only a feed in order of time can be cut by days")
    flat = flatten(enriched, order, keep)
    if hot is not None:
        named = hot.select(F.col("card_id").alias("__hot")).distinct()
        few = F.broadcast(named) if named.count() <= BROADCAST_CARDS else named
        long = flat.join(few, F.col("card_id") == F.col("__hot"), "left_semi")
        flat = flat.join(few, F.col("card_id") == F.col("__hot"), "left_anti")
    # one shuffle: the windows by card and the sort before the fold keep this partitioning
    rows = flat.repartition("card_id")
    if ordered:
        rows, sort = attempt_counts(rows), ["card_id", "t", "txn_id"]
    else:
        rows, sort = rows.withColumn("attempts_60s", F.lit(None).cast("long")), ["card_id", "seq", "txn_id"]
    own = [c for c in rows.columns if c != "seq"] + [k for k in keep if k == "seq"]
    passed = ["txn_id", "card_id", "merchant_id", "t", "amount_minor", "labelled_fraud", *keep]
    schema = StructType([rows.schema[c] for c in passed]).add("policy", StringType())
    schema = schema.add("decision", StringType()).add("score", IntegerType()).add("reasons", ArrayType(REASON))
    schema = schema.add("evaluated_at_ms", LongType()).add("spend_day", LongType()).add("spent_minor", LongType()).add("last_lat", DoubleType()).add("last_lon", DoubleType()).add("last_seen", LongType()).add("last_place", StringType())
    reasons = pa.list_(pa.struct([("rule", pa.string()), ("score", pa.int32()), ("detail", pa.string())]))
    named_policies = list(policies.items())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cards = object(), []
        for batch in batches:
            keys = batch.column(own.index("card_id")).to_pylist()
            out: list[list[tuple]] = [[] for _ in named_policies]
            for key, *fields in zip(keys, *(batch.column(own.index(n)).to_pylist() for n in _ROW), strict=True):
                if key != now:
                    now, cards = key, [Card() for _ in named_policies]
                row = Row(*fields)
                for card, made, (_, policy) in zip(cards, out, named_policies, strict=True):
                    verdict, score, hits = step(card, row, policy)
                    moved = card.seen is not None
                    made.append((verdict, score, [{"rule": r, "score": s, "detail": d} for r, s, d in hits], card.day, card.spent if card.day is not None else None, card.lat if moved else None, card.lon if moved else None, card.seen, card.place))
            cols = [batch.column(own.index(n)) for n in passed]
            kinds = (pa.string(), pa.int32(), reasons, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string())
            n = len(keys)
            for (name, _), made in zip(named_policies, out, strict=True):
                new = [pa.array([r[j] for r in made], k) for j, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([name] * n, pa.string()), *new[:3], pa.array([evaluated_at_ms] * n, pa.int64()), *new[3:]], schema.fieldNames())

    made = rows.sortWithinPartitions(*sort).select(*own).mapInArrow(fold, schema)
    if hot is not None:
        long = kept(long)
        for name, policy in named_policies:
            made = made.unionByName(fold_hot(long, schema, passed, policy, name, evaluated_at_ms))
    return made


def hot_cards(transactions: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """card_id of cards with more than ``rows`` transactions; counted before they are shuffled."""
    return transactions.groupBy("card_id").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("card_id")


def decide(enriched: DataFrame, policy: Policy = DEFAULT, ordered: bool = True, evaluated_at_ms: int = 0, order: str = "seq", keep: tuple[str, ...] = (), hot: DataFrame | None = None) -> DataFrame:
    """``decide_each`` for one policy, without its name."""
    return decide_each(enriched, {"": policy}, ordered, evaluated_at_ms, order, keep, hot).drop("policy")


def reasons(decisions: DataFrame) -> DataFrame:
    """txn_id, position, rule, rule_score, detail: one row a reason, in firing order."""
    return decisions.select("txn_id", F.posexplode("reasons").alias("position", "r")).select("txn_id", "position", F.col("r.rule").alias("rule"), F.col("r.score").alias("rule_score"), F.col("r.detail").alias("detail"))


def final_state(decisions: DataFrame) -> DataFrame:
    """The last state of each card and its latest decision, by arrival."""
    last = F.max_by(F.struct("txn_id", "decision", "score", "reasons", *_STATE), F.struct("t", "txn_id"))
    return decisions.groupBy("card_id").agg(last.alias("v")).select("card_id", "v.*")


def evict(state: DataFrame, now_ms: int | Column) -> DataFrame:
    """What a sweep at ``now_ms`` leaves: locations of the last week, spend of today and yesterday."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    stale = F.col("last_seen") < now - LOCATION_TTL_MS
    old = F.col("spend_day") < F.floor(now / DAY_MS) - 1
    kept = {c: F.when(stale, None).otherwise(F.col(c)) for c in ("last_lat", "last_lon", "last_place", "last_seen")}
    return state.withColumns(kept | {c: F.when(old, None).otherwise(F.col(c)) for c in ("spent_minor", "spend_day")})
