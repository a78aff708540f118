"""The stream equals the batch, however the feed is cut into files, also across a restart."""

import os
import time

import pytest
from pyspark.sql import functions as F

from larkspend.operators import decide, enrich
from larkspend.plans import demo_data as demo
from larkspend.streaming import decisions as stream


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    txns = demo.transactions(demo.events(spark, path)).drop("source_day")
    profiles, shops = enrich.card_profiles(demo.cards(txns), demo.customers(txns)), demo.merchants(txns)
    want = {tuple(r) for r in decide.decide(enrich.enrich(txns, profiles, shops)).select("txn_id", "decision", "score").collect()}
    a, b = txns.selectExpr("percentile_disc(0.33) within group (order by t)", "percentile_disc(0.7) within group (order by t)").first()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        for low, high in ((None, a), (a, b), (b, None)):
            part = txns.where(f"{'true' if low is None else f't > {low}'} and {'true' if high is None else f't <= {high}'}")
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
            live = spark.readStream.schema(txns.schema).parquet(str(tmp_path / "feed"))
            made = stream.decide_stream(enrich.enrich(live, profiles, shops))
            made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("txn_id", "decision", "score").collect()]
        assert len(got) == len(want) and set(got) == want
        assert stream.live_state(spark, str(tmp_path / "ck")).count() >= 1 and stream.live_state(spark, str(tmp_path / "ck"), "newest").count() == 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def small_feed(spark, tmp_path, rows):
    cols = "transaction_id long, card_id string, merchant_id string, amount_minor long, t long, lat double, lon double, currency string, category string, labelled_fraud boolean, seq long"
    made = spark.createDataFrame([(i, c, "s1", a, t, y, y, "USD", None, None, i) for i, c, a, t, y in rows], cols)
    made.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return spark.readStream.schema(made.schema).parquet(str(tmp_path / "feed"))


def test_changed_reference_data_reaches_later_batches(spark, tmp_path):
    """Limits are read anew for each micro-batch; the enriched feed then is the decision stream's source."""
    from larkspend.sources import tables
    from larkspend.streaming import enriched

    versions = [("k", 1, "ACTIVE", 1000)]
    profile = lambda: tables.latest(spark.createDataFrame(versions, "card_id string, seq long, status string, daily_limit_minor long"), "card_id").drop("seq").withColumn("risk_tier", F.lit("LOW"))
    shops = lambda: spark.createDataFrame([("s1", "5411", "EC")], "merchant_id string, mcc string, country string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        for rows, limit in (([(1, "k", 900, 0, 1.0), (2, "k", 200, 1, None)], 1000), ([(3, "k", 200, 2, 1.0)], 5000), ([(4, "k", None, 3, 1.0)], 5000)):
            versions.append(("k", len(versions) + 1, "ACTIVE", limit))
            live = small_feed(spark, tmp_path, rows)
            enriched.enrich_stream(live, profile, shops, str(tmp_path / "enriched"), str(tmp_path / "ck1")).trigger(availableNow=True).start().awaitTermination()
            schema = spark.read.parquet(str(tmp_path / "enriched" / "feed")).schema
            made = stream.decide_stream(enriched.read_enriched(spark, str(tmp_path / "enriched"), schema))
            made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["txn_id"], r["decision"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(1, "APPROVE"), (2, "DECLINE"), (3, "APPROVE"), (4, "APPROVE")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state_of_idle_cards_is_dropped(spark, tmp_path):
    """A sweep by the wall clock, against which the spend of 1970 is too old."""
    profile = spark.createDataFrame([("k", "ACTIVE", 1000, "LOW")], "card_id string, status string, daily_limit_minor long, risk_tier string")
    shops = spark.createDataFrame([("s1", "5411", "EC")], "merchant_id string, mcc string, country string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    query = None
    try:
        live = small_feed(spark, tmp_path, [(0, "k", 900, 0, 1.0)])
        made = stream.decide_stream(enrich.enrich(live, profile, shops), ages=stream.Ages(every_ms=1000))
        # state by processing time keeps the query running: it is stopped once the rows are out
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        for k in range(2):
            until = time.monotonic() + 60
            while time.monotonic() < until and query.exception() is None:
                made_so_far = spark.read.schema("txn_id long, decision string").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata" / "0").exists() else []
                if len(made_so_far) > k:
                    break
                time.sleep(0.5)
            if k == 0:
                small_feed(spark, tmp_path, [(1, "k", 900, 1, 1.0)])
        assert sorted((r["txn_id"], r["decision"]) for r in made_so_far) == [(0, "APPROVE"), (1, "APPROVE")]
    finally:
        if query is not None:
            query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_live_counts_take_the_last_batch(spark, tmp_path):
    from larkspend.streaming import windows

    for k in range(2):
        rows = spark.createDataFrame([("m", "DECLINE", 1000 * k), ("m", "APPROVE", 2000 * k + 1)], "merchant_id string, decision string, t long")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "made"))
        live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "made"))
        windows.live_windows(live, str(tmp_path / "live"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = windows.latest_counts(spark, str(tmp_path / "live")).first()
        assert (got["merchant_id"], got["total"], got["declined"]) == ("m", 2 + 2 * k, 1 + k)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in stream.SETTINGS}
    for k, v in stream.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


DAY, HOUR = 86_400_000, 3_600_000
START = 19_700 * DAY


def replayed(spark, tmp_path, batches, ages=None):
    """Decisions of batches of (id, card, amount, t, lat), one micro-batch each, swept by the feed's own clock."""
    profile = spark.createDataFrame([(k, "ACTIVE", 1000, "LOW") for k in "abc"], "card_id string, status string, daily_limit_minor long, risk_tier string")
    shops = spark.createDataFrame([("s1", "5411", "EC")], "merchant_id string, mcc string, country string")
    for rows in batches:
        live = small_feed(spark, tmp_path, rows)
        made = stream.decide_stream(enrich.enrich(live, profile, shops), ages=ages, clock=F.timestamp_millis("transaction.t"))
        run(made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
    state = {v: {r["key"]["card_id"]: r for r in stream.live_state(spark, str(tmp_path / "ck"), v).collect()} for v in ("location", "spend")}
    log = {}
    for r in stream.live_state(spark, str(tmp_path / "ck"), "attempts").collect():
        log.setdefault(r["key"]["card_id"], []).extend(r["user_map_value"]["t"])
    return state, log


def test_three_ages(spark, tmp_path, state_store):
    """Location goes after seven days, spend after yesterday, attempts after an hour, each on its own; not before."""
    first = [(1, "a", 100, START, 1.0), (2, "b", 100, START + DAY, 1.0)]
    state, log = replayed(spark, tmp_path, [first], stream.Ages())
    assert set(state["location"]) == {"a", "b"} and set(log) == {"b"}  # b's attempt is the newest; a's is a day old
    state, log = replayed(spark, tmp_path, [[(3, "c", 100, START + 2 * DAY + 1, 1.0)]], stream.Ages())
    assert set(state["location"]) == {"a", "b", "c"} and set(state["spend"]) == {"b", "c"} and set(log) == {"c"}
    state, log = replayed(spark, tmp_path, [[(4, "c", 100, START + 7 * DAY + HOUR + 2, 1.0)]], stream.Ages())
    assert set(state["location"]) == {"b", "c"} and set(state["spend"]) == {"c"} and log["c"] == [START + 7 * DAY + HOUR + 2]
    assert {r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"APPROVE"}


def test_exact_grace_over_batches(spark, tmp_path, state_store):
    """A row counts up to the grace of its window by the clock of its own arrival, and a window comes once: at a window's
    end and grace to the millisecond, and late rows in other micro-batches."""
    from larkspend.operators import analytics
    from larkspend.sources.committed import CommittedFolder
    from larkspend.streaming import windows

    m, s = 60_000, 1000
    cases = [
        [("shop", 1 * m, "APPROVE"), ("other", 5 * m + 10 * s, "APPROVE")],
        [("shop", 4 * m, "DECLINE"), ("other", 5 * m + 30 * s - 1, "APPROVE"), ("shop", 2 * m, "APPROVE")],
        [("other", 5 * m + 30 * s, "APPROVE"), ("shop", 2 * m, "DECLINE")],
        [("shop", 9 * m, "APPROVE"), ("shop", 3 * m, "DECLINE"), ("other", 10 * m + 29 * s, "DECLINE")],
        [("shop", 9 * m + 1, "DECLINE"), ("other", 16 * m, "APPROVE"), ("shop", 9 * m + 2, "DECLINE"), ("other", 14 * m, "DECLINE")],
    ]
    rows, seen = [], []
    for k, part in enumerate(cases):
        made = [(len(rows) + j, *r) for j, r in enumerate(part)]
        rows += made
        df = spark.createDataFrame(made, "seq long, merchant_id string, t long, decision string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "made"))
        run(windows.clocked(spark.readStream.schema(df.schema).parquet(str(tmp_path / "made")), str(tmp_path / "clocked"), str(tmp_path / "ck1")))
        timed = CommittedFolder(spark, str(tmp_path / "clocked"))
        run(windows.exact_windows(timed.stream(timed.read().schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")))
        want = analytics.final_windows(spark.createDataFrame(rows, df.schema), ordered=False)
        got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())), k
        seen.append(len(got))
    assert seen == [0, 0, 1, 1, 4]


def test_a_batch_that_failed_is_seen_once(spark, tmp_path):
    """Failures after writing and before commit, and between commit and publishing: the next stream reads each row once."""
    from larkspend.sources.committed import CommittedFolder

    class Fails(CommittedFolder):
        at = None

        def commit(self, *a):
            if self.at == "commit":
                raise RuntimeError("before commit")
            super().commit(*a)

        def publish(self, *a):
            if self.at == "publish":
                raise RuntimeError("after commit")
            super().publish(*a)

    folder = Fails(spark, str(tmp_path / "committed"))
    rows = spark.createDataFrame([(0, "x")], "number long, name string")

    def write(batch, number):
        folder.write(batch, number)

    for k, at in enumerate((None, "commit", "publish", None)):
        rows.withColumn("number", F.lit(k).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "ck1")).foreachBatch(write)
        folder.at = at
        if at is not None:
            with pytest.raises(Exception, match="commit"):
                run(live())
            folder.at = None
        run(live())
        run(folder.stream(rows.schema).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")))
    assert sorted(r["number"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]
    assert folder.numbers() == [0, 1, 2, 3] and not folder.write(rows, 2)


def test_live_counts_are_compacted(spark, tmp_path):
    from larkspend.sources.committed import CommittedFolder
    from larkspend.streaming import windows

    for k in range(5):
        rows = spark.createDataFrame([("m", "DECLINE", 1000 * k), (f"m{k}", "APPROVE", 2000 * k + 1)], "merchant_id string, decision string, t long")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "made"))
        live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "made"))
        run(windows.live_windows(live, str(tmp_path / "live"), str(tmp_path / "ck"), compact_every=2))
    got = {r["merchant_id"]: (r["total"], r["declined"]) for r in windows.latest_counts(spark, str(tmp_path / "live")).collect()}
    assert got == {"m": (5, 5), **{f"m{k}": (1, 0) for k in range(5)}}
    assert max(CommittedFolder(spark, str(tmp_path / "live" / "compacted")).numbers()) >= 3


def test_profiles_follow_both_sides(spark, tmp_path, state_store):
    """Only profiles that change come out: a card moves, its customers come, change and go, the card ends."""
    from larkspend.streaming import profiles

    steps = [
        ([("k", 1, True, "A")], [], set()),  # no customer yet
        ([], [("A", 1, True, "LOW")], {("k", "A", "LOW")}),
        ([("k", 2, True, "B")], [], set()),  # moved to one that isn't there
        ([("l", 1, True, "A")], [("B", 1, True, "HIGH")], {("k", "B", "HIGH"), ("l", "A", "LOW")}),
        ([], [("A", 2, False, None), ("B", 2, True, "MEDIUM")], {("k", "B", "MEDIUM")}),
        ([("k", 3, False, None)], [("A", 3, True, "HIGH")], {("l", "A", "HIGH")}),
        ([("k", 4, True, "A"), ("l", 1, True, "Z")], [], {("l", "A", "HIGH"), ("k", "A", "HIGH")}),  # an old version is ignored
    ]
    kinds = ("card_id string, seq long, live boolean, customer_id string", "customer_id string, seq long, live boolean, risk_tier string")
    n = []
    for cards, customers, want in steps:
        live = []
        for name, rows, kind in (("cards", cards, kinds[0]), ("customers", customers, kinds[1])):
            df = spark.createDataFrame(rows, kind)
            df = df.selectExpr("*", "'ACTIVE' status", "100L daily_limit_minor", "'EUR' currency") if name == "cards" else df.selectExpr("*", "'DE' home_country", "1.0D home_lat", "2.0D home_lon")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            live.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
        run(profiles.profile_changes(*live).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
        changes = spark.read.schema("card_id string, card_seq long, customer_seq long, live boolean, customer_id string, risk_tier string").parquet(str(tmp_path / "out"))
        n.append(changes.count())
        assert {(r["card_id"], r["customer_id"], r["risk_tier"]) for r in profiles.current(changes).collect()} == want, len(n)
    assert n == [0, 1, 2, 4, 6, 8, 9]


def test_limits_stay_in_the_state_of_profiles(spark, tmp_path, state_store):
    """Limits come in batches that have rows without one, and are shown again when the customer changes later."""
    from larkspend.streaming import profiles

    big = 2**53 + 1
    for cards, customers in (([("k", 1, 7), ("l", 1, None), ("m", 1, big)], [("A", 1, "LOW")]), ([], [("A", 2, "HIGH")]), ([], [("A", 3, "MEDIUM")])):
        live = []
        for name, df in (("cards", spark.createDataFrame(cards, "card_id string, seq long, daily_limit_minor long").selectExpr("*", "true live", "'A' customer_id", "'ACTIVE' status", "'EUR' currency")), ("customers", spark.createDataFrame(customers, "customer_id string, seq long, risk_tier string").selectExpr("*", "true live", "'DE' home_country", "1.0D home_lat", "2.0D home_lon"))):
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            live.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
        run(profiles.profile_changes(*live).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
        got = {(r["card_id"], r["daily_limit_minor"], r["risk_tier"]) for r in profiles.current(spark.read.parquet(str(tmp_path / "out"))).collect()}
        assert got == {("k", 7, customers[0][2]), ("l", None, customers[0][2]), ("m", big, customers[0][2])}


class Store:
    """State of one card in memory; counts what a step asks of it."""

    def __init__(self):
        self.values, self.maps, self.timers, self.asked = {}, {}, set(), 0

    def _ask(self, answer):
        self.asked += 1
        return answer

    def getValueState(self, name, schema):
        kind = type("Value", (), {"exists": lambda _: self._ask(name in self.values), "get": lambda _: self._ask(self.values.get(name)), "update": lambda _, v: self._ask(self.values.update({name: v})), "clear": lambda _: self._ask(self.values.pop(name, None))})
        return kind()

    def getMapState(self, name, key, value):
        own = self.maps.setdefault(name, {})
        kind = type("Map", (), {"containsKey": lambda _, k: self._ask(k in own), "getValue": lambda _, k: self._ask(own[k]), "updateValue": lambda _, k, v: self._ask(own.update({k: v})), "removeKey": lambda _, k: self._ask(own.pop(k, None)), "keys": lambda _: self._ask(list(own))})
        return kind()

    def listTimers(self):
        return self._ask(list(self.timers))

    def registerTimer(self, at):
        self._ask(self.timers.add(at))

    def deleteTimer(self, at):
        self._ask(self.timers.discard(at))


@pytest.mark.parametrize("ages", [None, stream.Ages(60_000, 0, 60_000, 60_000)])
def test_a_card_asks_its_state_a_few_times(ages):
    """A month of bursts costs a new card no question a minute; cut into batches it gets the same verdicts."""
    import random

    import pandas as pd

    r = random.Random(5)
    rows = sorted((d * DAY + r.randrange(360_000), i) for d in range(30) for i in range(d * 20, d * 20 + 20))
    feed = pd.DataFrame([(t, i, i, t, r.choice((100, 150, 5000)), f"s{i % 5}", "EUR", 10.0, 10.0, True, "ACTIVE", 90_000, "LOW", True, "DE", None, None) for t, i in rows])
    feed.columns = ["order_0", "order_1", "txn_id", "t", "amount_minor", "merchant_id", "currency", "lat", "lon", "has_profile", "status", "daily_limit", "tier", "known", "country", "category", "labelled_fraud"]
    feed["seq"] = list(zip(feed["order_0"], feed["order_1"], strict=True))
    names = ["txn_id", "card_id", "decision", "score", "reasons"]

    def verdicts(parts):
        store, out = Store(), []
        decider = stream.Decider(stream.DEFAULT, names, ages)
        decider.init(store)
        for part in parts:
            store.asked = 0
            out += [f for f in decider.handleInputRows(("k",), iter([part.sample(frac=1, random_state=1)]), None)]
            yield store.asked
        yield pd.concat(out)[["txn_id", "decision", "score"]].values.tolist(), {k: store.values[k] for k in ("spend", "location", "newest")}, store.maps["attempts"].keys() if ages is None else None

    asked, whole = verdicts([feed])
    assert asked <= 20
    *_, cut = verdicts([feed[:211], feed[211:215], feed[215:400], feed[400:]])
    assert cut == whole
    assert any(score for _, _, score in whole[0])
