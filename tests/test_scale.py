"""Parts that must not depend on one task or grow with a card's rows: the ordered log, days side by side, ranks."""

import math
import random
import time

import pytest
from larkspend import policy as P
from larkspend.operators import decide, enrich, evaluation, hot, latency, quantiles
from larkspend.operators.attempts import Attempts
from larkspend.operators.kernel import Card, Row, step
from larkspend.sources import shared
from pyspark.sql import functions as F

DAY = 86_400_000


def counted(rows):
    """Attempts, small ones and their merchants of each row, by looking at all rows before it."""
    out, seen, newest = [], [], None
    for t, amount, merchant in rows:
        few = int(amount is not None and amount < 200)
        if newest is not None and t < newest - P.ATTEMPT_TTL_MS:
            out.append((1, few, few))
            continue
        seen.append((t, amount, merchant))
        newest = t if newest is None else max(newest, t)
        near = [x for x in seen if t - P.TESTING_MS <= x[0] <= t]
        small = [x[2] for x in near if x[1] is not None and x[1] < 200]
        out.append((sum(x[0] >= t - 60_000 for x in near), len(small), len(set(small))))
    return out


@pytest.mark.parametrize("span", [100_000, 3_000_000, 20_000_000])
@pytest.mark.parametrize("mixed", [True, False])
def test_counts_of_a_shuffled_feed(span, mixed):
    r = random.Random(span)
    for shops in (2, 60):
        rows = [(r.randrange(span) + 10**9, r.choice([None, 50, 150, 500]), r.randrange(shops)) for _ in range(700)]
        if not mixed:
            rows.sort(key=lambda x: x[0] // 50_000)
        log = Attempts()
        assert [log.add(*x) for x in rows] == counted(rows)


def test_a_long_burst_takes_time_in_proportion():
    def took(n):
        r = random.Random(1)
        rows = [(r.randrange(7_200_000), r.choice([50, 500]), r.randrange(n)) for _ in range(n)]
        began, log = time.process_time(), Attempts()
        for x in rows:
            log.add(*x)
        return time.process_time() - began

    took(5_000)
    assert took(100_000) < 10 * took(25_000)


def feed(spark, cards, per_card, days, hot_share=0.0, seed=3):
    """Enriched transactions of ``cards``; the first has ``hot_share`` of all. Some days hold declines only."""
    r, rows = random.Random(seed), []
    n = cards * per_card
    for i in range(n):
        c = 0 if r.random() < hot_share else r.randrange(cards)
        day = r.randrange(days)
        at = r.choice([r.randrange(DAY), DAY - 1 - r.randrange(300_000), r.randrange(300_000)])
        away = 30.0 if day % 3 == 1 else r.choice([0.0, 0.0, 0.0, 3.0, 30.0])
        rows.append((i, f"k{c}", f"m{r.randrange(5)}", r.choice([50, 150, 9_000]), "EUR", None if r.random() < 0.1 else 10.0 + away, 5.0, None, None, None if r.random() < 0.02 else day * DAY + at))
    txns = spark.createDataFrame(rows, "transaction_id long, card_id string, merchant_id string, amount_minor long, currency string, lat double, lon double, category string, labelled_fraud boolean, t long").withColumn("seq", F.struct("t", "transaction_id"))
    profiles = spark.createDataFrame([(f"k{c}", "BLOCKED" if c == 2 else "ACTIVE", 40_000, "HIGH" if c % 2 else "LOW") for c in range(cards) if c != 3], "card_id string, status string, daily_limit_minor long, risk_tier string")
    shops = spark.createDataFrame([(f"m{m}", "7995" if m == 0 else "5411", f"C{m}") for m in range(4)], "merchant_id string, mcc string, country string")
    return txns, enrich.enrich(txns, profiles, shops)


def test_days_side_by_side_equal_the_fold(spark):
    txns, joined = feed(spark, 6, 150, 9)
    joined = shared.kept(joined)
    names = ["txn_id", "card_id", "decision", "score", "reasons", "spend_day", "spent_minor", "last_lat", "last_lon", "last_seen", "last_place", "policy"]
    policies = {"default": P.DEFAULT, "original": P.ORIGINAL}
    want = decide.decide_each(joined, policies).select(*names)
    got = decide.decide_each(joined, policies, hot=decide.hot_cards(txns, 120)).select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < decide.hot_cards(txns, 120).count() <= 6 and decide.decide(joined, hot=decide.hot_cards(txns, 10**6)).count() == joined.count()
    with pytest.raises(ValueError):
        decide.decide(joined, ordered=False, hot=decide.hot_cards(txns, 1))


def test_a_hot_card_uses_several_tasks(spark, monkeypatch):
    """A third of the rows on one card: its days are folded in several tasks, and only days with a wrong start again."""
    txns, joined = feed(spark, 20, 60, 12, hot_share=0.35)
    rows = []
    monkeypatch.setattr(hot, "fold_segments", lambda counted, starts, *a, f=hot.fold_segments: rows.append((starts.count(), f(counted, starts, *a))) or rows[-1][1])
    cards = decide.hot_cards(txns, 300)
    assert [r["card_id"] for r in cards.collect()] == ["k0"]
    assert decide.decide(shared.kept(joined), hot=cards).count() == joined.count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these partitions are small enough for one
    try:
        tasks = rows[0][1].groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks >= 3 and len(rows) <= 4 and all(n < rows[0][0] for n, _ in rows[1:])


def test_ranks_equal_sorting(spark):
    r = random.Random(5)
    values = [("a", r.randrange(10**12)) for _ in range(500)] + [("b", r.randrange(3)) for _ in range(301)] + [(None, -7), ("c", None)] + [("d", -(2**40)), ("d", 2**40)]
    df = spark.createDataFrame(values, "g string, value long").repartition(4)
    ranks = spark.createDataFrame([(g, f"r{k}", k) for g in ("a", "b", None, "d", "e") for k in (1, 2, 250, 301, 500, 0)], "g string, name string, rank long")
    got = {(x["g"], x["name"]): x["value"] for x in quantiles.at_ranks(df, ranks, "g").collect()}
    want = {}
    for g in ("a", "b", None, "d"):
        own = sorted(v for k, v in values if k == g and v is not None)
        want |= {(g, f"r{k}"): own[k - 1] for k in (1, 2, 250, 301, 500) if k <= len(own)}
    assert got == want
    medians = {x["g"]: x["median"] for x in quantiles.medians(df.where("g is not null"), "g").collect()}
    a, b = (sorted(v for k, v in values if k == g) for g in ("a", "b"))
    assert medians == {"a": (a[249] + a[250]) / 2, "b": float(b[150]), "d": 0.0}


def test_latency_percentiles(spark):
    r = random.Random(2)
    values = [r.randrange(10_000) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 4, "latency_ms long")
    got = latency.summary(df).first()
    rank = lambda p: sorted(values)[math.ceil(p * len(values)) - 1]
    assert tuple(got) == (337, 333, 4, rank(0.5), rank(0.95), rank(0.99), max(values))
    assert tuple(latency.summary(df.where("false")).first()) == (0, 0, 0, None, None, None, None)


def test_overall_comes_from_sums(spark):
    """Grouping sets stand over rows that are sums already; a period without a name stays apart from the overall row."""
    rows = [("train", "DECLINE", True), ("train", "APPROVE", None), (None, "REVIEW", True)]
    df = spark.createDataFrame([(*x, 10, i, "c", "m", []) for i, x in enumerate(rows)], "period string, decision string, labelled_fraud boolean, amount_minor long, txn_id long, card_id string, merchant_id string, reasons array<struct<rule string, score int, detail string>>")
    got = {(r["period"], r["point"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in evaluation.confusion(df).collect()}
    assert got == {("train", "declined"): (1, 0, 0, 1), ("train", "flagged"): (1, 0, 0, 1), (None, "declined"): (0, 0, 1, 0), (None, "flagged"): (1, 0, 0, 0), ("**all**", "declined"): (1, 0, 1, 1), ("**all**", "flagged"): (2, 0, 0, 1)}
    assert evaluation.confusion(df.where("false")).count() == 0 and evaluation.rule_stats(df).count() == 0


def test_unordered_kernel_uses_the_log():
    """Rows of a card in any order of time are counted as their arrival allows."""
    r, card, rows = random.Random(4), Card(), []
    for _ in range(300):
        t = 10**10 + r.randrange(1_500_000)
        rows.append((t, 100, f"m{r.randrange(4)}"))
        _, _, hits = step(card, Row(*rows[-1], "EUR", None, None, True, "ACTIVE", None, "LOW", True, "DE", "5411"))
        n, small, shops = counted(rows)[-1]
        assert {h[0] for h in hits} == ({"VELOCITY"} if n > 5 else set()) | ({"CARD_TESTING"} if small >= 4 and shops >= 3 else set())
