"""Spark forms of the engine on small feeds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larkspend.functions import scalars
from larkspend.operators import analytics, decide, enrich, evaluation, latency, views
from larkspend.operators.kernel import km_between
from larkspend.plans import demo_data as demo
from larkspend.plans import evaluate
from larkspend.schemas import TRANSACTION
from larkspend.sources import labelled, quarantine, tables

T0 = 1_789_725_600_000
M = 60_000


def decisions(spark, rows):
    """(txn_id, card, merchant, decision, fraud, minutes after T0, reasons, amount)"""
    return spark.createDataFrame(
        [(i, c, m, d, f, T0 + int(t * M), [{"rule": r, "score": 1, "detail": ""} for r in rs], a, "p") for i, (c, m, d, f, t, rs, a) in enumerate(rows)],
        "txn_id long, card_id string, merchant_id string, decision string, labelled_fraud boolean, t long, reasons array<struct<rule:string,score:int,detail:string>>, amount_minor long, period string",
    )


def rows_of(df, *sort):
    return [tuple(r) for r in df.orderBy(*sort).collect()]


def reference(spark, limit=70_000):
    cards = spark.createDataFrame([("k1", "u1", "ACTIVE", limit, "USD"), ("k2", "gone", "ACTIVE", 1, "USD")], "card_id string, customer_id string, status string, daily_limit_minor long, currency string")
    customers = spark.createDataFrame([("u1", "HIGH", "EC", 1.0, 2.0)], "customer_id string, risk_tier string, home_country string, home_lat double, home_lon double")
    shops = spark.createDataFrame([("s1", "Ferry kiosk", "7995", "EC", 1.0, 2.0)], "merchant_id string, name string, mcc string, country string, lat double, lon double")
    return enrich.card_profiles(cards, customers), shops


def test_enrichment_keeps_unknown_cards_and_merchants(spark):
    txns = spark.createDataFrame([("a", "k1", "s1"), ("b", "k1", "s9"), ("c", "k2", "s1"), (None, "k1", "s1")], "transaction_id string, card_id string, merchant_id string")
    got = enrich.enrich(txns, *reference(spark))
    got = {r["transaction"]["transaction_id"]: (r["card_profile"] and r["card_profile"]["risk_tier"], r["merchant"] and r["merchant"]["mcc"]) for r in got.collect()}
    assert got == {"a": ("HIGH", "7995"), "b": ("HIGH", None), "c": (None, "7995")}


def test_nearby_merchants_against_all_pairs(spark):
    """Clusters, lonely homes, the date line and both poles; no merchant is too far to be one of the nearest."""
    r = random.Random(3)
    shops = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)] + [(100 + i, 10 + r.uniform(-0.3, 0.3), 179.9 + r.uniform(-0.3, 0.1)) for i in range(20)] + [(200, 89.9, 0.0), (201, -89.9, 90.0), (202, None, 1.0)]
    homes = [(1, 10.0, -179.95), (2, 10.0, 179.9), (3, 90.0, 10.0), (4, -90.0, 0.0), (5, 0.0, 0.0), (6, None, 0.0)] + [(10 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(30)]
    got = enrich.nearby_merchants(spark.createDataFrame(homes, "card_id int, home_lat double, home_lon double"), spark.createDataFrame(shops, "merchant_id int, lat double, lon double"))
    found = {}
    for x in got.collect():
        found.setdefault(x["card_id"], []).append((x["rank"], x["merchant_id"]))
    for c, y, x in homes:
        if y is None:
            assert c not in found
            continue
        far = sorted((km_between(y, x, v, u), m) for m, v, u in shops if v is not None)
        near = [p for p in far if p[0] <= enrich.NEAR_KM]
        want = near if len(near) >= enrich.LEAST_NEAR else far[: enrich.LEAST_NEAR]
        assert sorted(found[c]) == [(k + 1, m) for k, (_, m) in enumerate(want)], c
    none = spark.createDataFrame([], "merchant_id int, lat double, lon double")
    assert enrich.nearby_merchants(spark.createDataFrame(homes, "card_id int, home_lat double, home_lon double"), none).count() == 0


def test_places_are_paired_once(spark, monkeypatch):
    """Cards at one home and merchants at one place add no pairs; ties go to the smaller merchant, near ones all count."""
    pairs, within = [], enrich.within
    monkeypatch.setattr(enrich, "within", lambda *a: pairs.append(within(*a).count()) or within(*a))
    homes = spark.range(60).selectExpr("id card_id", "if(id < 40, 0D, 80D) home_lat", "0D home_lon")
    shops = spark.range(50).selectExpr("id merchant_id", "if(id < 45, 3D, 80.1D) lat", "0D lon")
    got = {}
    for r in enrich.nearby_merchants(homes, shops).collect():
        got.setdefault(r["card_id"], []).append((r["rank"], r["merchant_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(1, 0), (2, 1), (3, 2)] if k < 40 else [(i + 1, 45 + i) for i in range(5)] for k in range(60)}
    assert max(pairs) <= 4


def test_nulls_in_the_feed(spark):
    """Batch decisions of rows without a place, amount or time, in both orders."""
    rows = [(i, "k1", "s2", a, t, y, y) for i, (a, t, y) in enumerate([(10, 0, 1.0), (None, 1000, 1.0), (10, 2000, None), (10, None, 60.0), (10, 3000, 60.0)])]
    txns = spark.createDataFrame(rows, "transaction_id long, card_id string, merchant_id string, amount_minor long, t long, lat double, lon double")
    txns = txns.withColumns({"currency": F.lit("USD"), "category": F.lit(None).cast("string"), "labelled_fraud": F.lit(None).cast("boolean"), "seq": F.col("transaction_id")})
    for ordered in (True, False):
        made = decide.decide(enrich.enrich(txns, *reference(spark)), ordered=ordered)
        assert rows_of(made.select("txn_id", "decision", F.array_join("reasons.rule", ",")), "txn_id") == [(0, "APPROVE", ""), (1, "APPROVE", ""), (2, "APPROVE", ""), (3, "APPROVE", ""), (4, "DECLINE", "GEO_VELOCITY,CUSTOMER_RISK_TIER")]


def test_event_time_in_small_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, 1]), *((None, -1) if r.random() < 0.4 else (r.randint(1, 10**6), 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, src_partition int, e long, i long").select("seq", "src_partition", F.timestamp_millis("e").alias("event_time"), F.timestamp_millis("i").alias("ingest_time"))
    got = {x[0]: x[1] for x in tables.with_event_time(df, bucket_rows=37).select("seq", F.unix_millis("ts")).collect()}
    top = {}
    for i, p, e, _ in rows:
        top[p] = max(top.get(p, e) or 0, e or 0) or None
        assert got[i] == (e if e is not None else top[p])


def test_final_windows_drop_late_rows(spark):
    feed = decisions(spark, [("c", "SHOP", "APPROVE", None, 1, [], 1), ("c", "OTHER", "APPROVE", None, 5 + 1 / 6, [], 1), ("c", "SHOP", "DECLINE", None, 4, [], 1), ("c", "OTHER", "APPROVE", None, 6, [], 1), ("c", "SHOP", "APPROVE", None, 2, [], 1), ("c", "OTHER", "APPROVE", None, 11, [], 1)])
    got = analytics.final_windows(feed, ordered=False, order="txn_id").collect()
    shop = [r for r in got if r["merchant_id"] == "SHOP"]
    assert [(r["total"], r["declined"], r["window_start"]) for r in shop] == [(2, 1, T0)]
    small = analytics.in_grace(feed, "txn_id", bucket_rows=2)
    assert small.count() == 5


def test_latest_windows(spark):
    feed = decisions(spark, [("c", "SHOP", "APPROVE", None, 5 * i, [], 1) for i in range(14)])
    got = analytics.latest_windows(feed, T0 + 8 * 86_400_000).orderBy("position").collect()
    assert len(got) == 12 and got[0]["window_start"] == T0 + 65 * M and all(r["closed"] for r in got)
    live = analytics.latest_windows(decisions(spark, [("c", "S", "APPROVE", None, 1, [], 1), ("c", "S", "DECLINE", None, 2, [], 1)]), T0 + 3 * M).collect()
    assert [(r["total"], r["closed"]) for r in live] == [(2, False)]


def test_scorecard(spark):
    feed = decisions(
        spark,
        [("a", "m", "DECLINE", True, 0, ["MERCHANT_RISK"], 10_000), ("b", "m", "DECLINE", False, 1, ["MERCHANT_RISK"], 100), ("c", "m", "REVIEW", True, 2, ["CARD_TESTING"], 5000), ("d", "m", "APPROVE", True, 3, [], 2000), ("e", "m", "APPROVE", False, 4, [], 1), ("f", "m", "APPROVE", None, 5, [], 1)],
    )
    points = {r["point"]: r for r in evaluation.confusion(feed).collect()}
    d, f = points["declined"], points["flagged"]
    assert (d["tp"], d["fp"], d["fn"], d["tn"], d["caught_minor"], d["fraud_minor"]) == (1, 1, 2, 2, 10_000, 17_000)
    assert (round(f["precision"], 3), round(f["recall"], 3), f["caught_minor"]) == (0.667, 0.667, 15_000)
    rules = {r["rule"]: (r["hits"], r["fraud_hits"]) for r in evaluation.rule_stats(feed).collect()}
    assert rules == {"MERCHANT_RISK": (2, 1), "CARD_TESTING": (1, 1)}
    assert rows_of(evaluation.verdict_distribution(feed), "period") == [("**all**", 3, 1, 2), ("p", 3, 1, 2)]
    none = evaluation.confusion(feed.where("false")).collect()
    assert none == []


def test_episodes(spark):
    feed = decisions(spark, [("A", "m", "APPROVE", True, 0, [], 1), ("A", "m", "APPROVE", True, 1, [], 1), ("A", "m", "REVIEW", True, 2, [], 1), ("B", "m", "DECLINE", True, 3, [], 1), ("C", "m", "APPROVE", True, 4, [], 1), ("D", "m", "APPROVE", False, 5, [], 1)])
    assert rows_of(evaluation.catch_summary(evaluation.episodes(feed, "t")), "period") == [("**all**", 3, 2, 1.0), ("p", 3, 2, 1.0)]


def test_csv_to_report(spark, tmp_path):
    """Two files, the test file sorting before the training file by name; six quick payments of one card among others."""
    head = ",trans_date_trans_time,cc_num,merchant,category,amt,first,lat,long,trans_num,unix_time,merch_lat,merch_long,is_fraud\n"
    line = lambda i, cc, amt, fraud, sec: f"{i}, x, {cc}, fraud_Depot{i % 4}, hobby, {amt}, Ann, 12.5, -3.25, P{i}, {1_400_000_000 + sec}, 12.6, -3.5, {fraud}\n"
    (tmp_path / "bTrain.csv").write_text(head + "".join(line(i, "41", "8.20", int(i > 2), 9 * i) for i in range(6)) + line(6, "42", "77.70", 0, 80))
    (tmp_path / "aTest.csv").write_text(head + line(0, "41", "5.00", 1, 100) + line(1, "43", "6.00", 0, 110))
    rows = labelled.read(spark, str(tmp_path))
    feed = labelled.transactions(rows).orderBy("seq").collect()
    assert [(x["period"], x["transaction_id"]) for x in feed] == [("bTrain", f"P{i}") for i in range(7)] + [("aTest", "P0"), ("aTest", "P1")]
    assert labelled.merchants(rows).count() == 4 and labelled.profiles(rows).count() == 3
    assert [x["period"] for x in labelled.read(spark, str(tmp_path), limit=8).orderBy("seq").collect()] == ["bTrain"] * 7 + ["aTest"]
    assert labelled.read(spark, str(tmp_path), period="ATEST").count() == 2
    with pytest.raises(ValueError):
        labelled.read(spark, str(tmp_path), period="nope")
    report = evaluate.evaluate(spark, str(tmp_path), limit=9)
    data = report["dataset"].where("period = 'bTrain'").first()
    assert (data["transactions"], data["frauds"], data["cards"]) == (7, 3, 2)
    flagged = report["flagged"].where("period = '**all**'").first()
    assert (flagged["tp"], flagged["fn"], flagged["fp"]) == (1, 3, 0)  # the sixth try in a minute
    cards = report["cards"].where("period = '**all**'").first()
    assert (cards["cards_hit"], cards["cards_caught"], cards["median_before"]) == (1, 1, 2.0)
    assert dict(rows_of(report["setup"], "name"))["rows"] == "first 9" and dict(rows_of(report["setup"], "name"))["certain_km"] == "500.0"
    text = report["summary"].where("period = '**all**'").first()
    assert (text["transactions"], text["frauds"], text["fraud"], text["flagged_recall"]) == ("9", "4", "$30", "25.0%")


def test_quarantine(spark):
    ok = '{"transaction_id":"1","card_id":"c","merchant_id":"m","amount_minor":5}'
    rows = [(None, bytearray(x.encode()), "txns", 0, i, None) for i, x in enumerate(('{"half": "a record"}', "x" * 3000, ok))]
    records = spark.createDataFrame(rows, "key binary, value binary, src_topic string, src_partition int, src_offset long, src_timestamp timestamp")
    good, bad = quarantine.split(records, TRANSACTION)
    assert [r["transaction_id"] for r in good.collect()] == ["1"]
    bad = {r["src_offset"]: r for r in bad.collect()}
    assert bytes(bad[0]["value"]) == rows[0][1] and bad[0]["exception_class"] == "MissingField"
    assert len(bad[1]["message"]) == 1003 and bad[1]["message"].endswith("...")
    assert rows_of(views.dead_letter_totals(quarantine.split(records, TRANSACTION)[1]), "n") == [("txns", 2)]

    wrote = []

    def fail(*_):
        raise OSError("quarantine is down")

    with pytest.raises(OSError):
        quarantine.writer(TRANSACTION, fail, lambda *batch: wrote.append(batch))(records, 0)
    assert wrote == []


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z"), ("b", 9, None)], "k string, seq long, v string")
    assert rows_of(tables.latest(v, "k"), "k") == [("a", 5, "y"), ("b", 9, None)]
    assert rows_of(tables.latest(v, "k", live="v"), "k") == [("a", 5, "y")]
    r = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 7), (4, "q", 3)], "id long, k string, seq long")
    assert rows_of(tables.as_of(r, v, "k", "id").select("id", "v"), "id") == [(1, None), (2, "x"), (3, "y"), (4, None)]
    old = spark.createDataFrame([("1", "c", "m", 5, "ODD")], "transaction_id string, card_id string, merchant_id string, amount_minor long, extra string")
    got = tables.evolve(old, TRANSACTION).first()
    assert got["device_fingerprint"] is None and got["currency"] == "EUR" and "extra" not in got.asDict()


def test_latency(spark):
    sent = spark.createDataFrame([(i, 1000 * i) for i in range(1, 101)], "txn_id long, sent_ms long")
    decided = spark.createDataFrame([(i, 1000 * i + i + k) for i in range(1, 100) for k in (0, 50)], "txn_id long, decided_ms long")
    got = latency.summary(latency.match(sent, decided)).first()
    assert tuple(got) == (100, 99, 1, 50, 95, 99, 99)


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.money(F.lit(-205), F.lit("EUR")), scalars.duration(F.lit(125_000)), scalars.percentage(F.lit(0.00123)), scalars.percentage(F.lit(0.5)), scalars.dollars(F.lit(123_456)), scalars.epoch_day(F.lit(-1)), scalars.implied_kmh(F.lit(1.0), F.lit(0)), scalars.minor_units(F.lit("1.005")), F.round(scalars.haversine_km(F.lit(52.52), F.lit(13.405), F.lit(53.5511), F.lit(9.9937)), 1)
    ).first()
    assert tuple(one) == ("EUR -2.05", "2m 5s", "0.12%", "50.0%", "$1,235", -1, float("inf"), 101, 255.3)


def test_rounding_of_large_numbers(spark, tmp_path):
    """The text of 71245 / 19 * 36000 ends in 5 behind six digits, the number itself is below that."""
    from larkspend.plans.registry import QUERIES

    event = next(i for i in range(500_000) if i * 7919 % 500_000 == 1019)
    rows = spark.createDataFrame([(event, 712.45, 0), (0, 712.45, 0)], "event_id long, value double, s long")
    rows.select("event_id", F.timestamp_seconds("s").alias("ts"), "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["kmh"] for r in QUERIES["scalar_texts"](spark, str(tmp_path)).collect()}
    assert got == {event: 134990526.315789, 0: float("inf")}
    halves = spark.createDataFrame([(0.5,), (-0.5,), (2.5,), (float("nan"),), (None,)], "x double").select(scalars.rounded(F.col("x"), 0)).collect()
    assert [str(r[0]) for r in halves] == ["1.0", "-1.0", "3.0", "nan", "None"]


def test_event_time(spark):
    rows = [(1, 0, 1000, 5000), (2, 0, 0, 7000), (3, 0, None, -1), (4, 1, -5, None)]
    df = spark.createDataFrame(rows, "seq long, src_partition int, e long, i long").select("seq", "src_partition", F.timestamp_millis("e").alias("event_time"), F.timestamp_millis("i").alias("ingest_time"))
    assert [r[0] for r in tables.with_event_time(df).orderBy("seq").select(F.unix_millis("ts")).collect()] == [1000, 7000, 7000, None]


def test_both_fold_modes_agree(spark):
    """Counts as windows, and counts from each card's own log, on a feed in time order."""
    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    txns = demo.transactions(demo.events(spark, path))
    joined = enrich.enrich(txns, enrich.card_profiles(demo.cards(txns), demo.customers(txns)), demo.merchants(txns))
    a, b = (rows_of(decide.decide(joined, ordered=x).select("txn_id", "decision", "score", "reasons"), "txn_id") for x in (True, False))
    assert a == b
    verdicts = [r[1] for r in a]
    assert [verdicts.count(v) for v in ("APPROVE", "REVIEW", "DECLINE")] == [484, 187, 329]


def test_card_view(spark):
    profiles = spark.createDataFrame([("A", "ACTIVE", "LOW", 100_000), ("QUIET", "ACTIVE", "LOW", 5)], "card_id string, status string, risk_tier string, daily_limit_minor long")
    state = spark.createDataFrame([("A", "t3", "DECLINE", 80, [{"rule": "DAILY_LIMIT"}], T0 // 86_400_000, 50_000, 52.5, 13.4, T0, "DE")], "card_id string, txn_id string, decision string, score int, reasons array<struct<rule:string>>, spend_day long, spent_minor long, last_lat double, last_lon double, last_seen long, last_place string")
    attempts = spark.createDataFrame([("A", T0), ("A", T0 + 30_000), ("A", T0 + 240_000)], "card_id string, t long")
    view = {r["card_id"]: r for r in views.card_risk(profiles, state, attempts, T0 + 240_000).collect()}
    a = view["A"]
    assert (a["spent_today"], a["remaining"], a["last_place"], a["attempts_10m"], a["attempts_60s"], a["last_decision"], a["last_rules"]) == (50_000, 50_000, "DE", 3, 1, "DECLINE", ["DAILY_LIMIT"])
    assert (view["QUIET"]["remaining"], view["QUIET"]["last_seen"]) == (5, None)
    assert views.card_risk(profiles, state, attempts, T0, "nobody").count() == 0
    assert views.card_risk(profiles, state, attempts, T0 + 86_400_000, "A").first()["spent_today"] == 0
