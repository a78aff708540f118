"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL equivalents.

Outputs are flat, doubles are rounded to six digits and times are epoch milliseconds, so that they can be compared.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analytics, decide, enrich, evaluation, features, latency, views
from ..policy import DEFAULT, ORIGINAL
from ..schemas import TRANSACTION
from ..sources import labelled, quarantine, shared, tables
from . import demo_data as demo
from .oracle import CARD, EVERY, MERCHANT, NOW_MS


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: scalars.rounded(F.col(c)) for c in columns})


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.transactions(demo.events(spark, sf_dir))


def _profiles(txns: DataFrame) -> DataFrame:
    return enrich.card_profiles(demo.cards(txns), demo.customers(txns))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns = _txns(spark, sf_dir)
    return enrich.enrich(txns, _profiles(txns), demo.merchants(txns))


def _decisions(spark: SparkSession, sf_dir: str, policy=DEFAULT) -> DataFrame:
    return decide.decide(_enriched(spark, sf_dir), policy, evaluated_at_ms=NOW_MS)


def _judged(spark: SparkSession, sf_dir: str, policies=None) -> DataFrame:
    """Decisions of each policy with their period, which goes along through the fold."""
    txns = demo.with_period(_txns(spark, sf_dir))
    joined = enrich.enrich(txns, _profiles(txns), demo.merchants(txns))
    return decide.decide_each(joined, policies or {"default": DEFAULT}, evaluated_at_ms=NOW_MS, keep=("period",))


def txn_event_time(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    raw = demo.events(spark, sf_dir).select("event_id", (i % 4).alias("src_partition"), i.alias("seq"), F.timestamp_millis(F.when(i % 7 == 0, None).when(i % 11 == 0, -5).otherwise(ms)).alias("event_time"), F.timestamp_millis(F.when(i % 77 == 0, -1).otherwise(ms + 250)).alias("ingest_time"))
    return tables.with_event_time(raw).select("event_id", "src_partition", F.unix_millis("ts").alias("ts_ms"))


def latest_reference(spark, sf_dir):
    versions = demo.events(spark, sf_dir).select("user_id", "event_id", scalars.rounded(F.col("value")).alias("value"), "event_type", F.when(F.col("event_type") != "error", F.col("event_type")).alias("live"))
    return tables.latest(versions, "user_id", "event_id", "live").select("user_id", "event_type", "value", "event_id")


def card_profiles(spark, sf_dir):
    return _profiles(_txns(spark, sf_dir)).drop("currency")


def _flat(joined: DataFrame) -> DataFrame:
    x, p, m = "transaction", "card_profile", "merchant"
    cols = [F.col(f"{x}.transaction_id").alias("txn_id"), *(F.col(f"{x}.{c}") for c in ("card_id", "merchant_id", "amount_minor", "t")), scalars.rounded(F.col(f"{x}.lat")).alias("lat"), scalars.rounded(F.col(f"{x}.lon")).alias("lon")]
    cols += [F.col(p).isNotNull().alias("has_profile"), *(F.col(f"{p}.{c}") for c in ("status", "daily_limit_minor", "risk_tier")), F.col(m).isNotNull().alias("has_merchant"), F.col(f"{m}.mcc"), F.col(f"{m}.country")]
    return joined.select(*cols)


def enriched(spark, sf_dir):
    return _flat(_enriched(spark, sf_dir))


def asof_reference(spark, sf_dir):
    raw = demo.events(spark, sf_dir)
    versions = raw.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("version"))
    rows = raw.where("event_id % 3 <> 0").select("event_id", "user_id", F.col("event_id").alias("seq"))
    return tables.as_of(rows, versions, "user_id", "event_id").select("event_id", "user_id", "version")


def nearby_merchants(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    shops = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.alias("merchant_id"), (s * 37 % 1200 / 10.0 - 60.0).alias("lat"), (s * 91 % 3600 / 10.0 - 180.0).alias("lon"))
    homes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("card_id"), (c * 53 % 1100 / 10.0 - 55.0).alias("home_lat"), (c * 17 % 3600 / 10.0 - 180.0).alias("home_lon"))
    return _round(enrich.nearby_merchants(homes, shops), "km")


def _feed(spark, sf_dir):
    return _txns(spark, sf_dir).withColumnRenamed("transaction_id", "txn_id")


def velocity_attempts(spark, sf_dir):
    return features.attempt_counts(_feed(spark, sf_dir)).select("txn_id", "card_id", "t", "attempts_60s")


def card_testing(spark, sf_dir):
    got = features.small_attempts(_feed(spark, sf_dir))
    return got.select("txn_id", "small_10m", "small_merchants_10m", ((F.col("small_10m") >= 4) & (F.col("small_merchants_10m") >= 3)).alias("card_testing"))


def static_rules(spark, sf_dir):
    return features.static_rules(_enriched(spark, sf_dir)).withColumnRenamed("transaction_id", "txn_id")


def decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("txn_id", "card_id", "merchant_id", "t", "amount_minor", "decision", "score", F.size("reasons").alias("n_reasons"))


def decision_reasons(spark, sf_dir):
    return decide.reasons(_decisions(spark, sf_dir))


def decisions_with_gaps(spark, sf_dir):
    """Transactions without a place or amount, cards without a status or limit."""
    txns = demo.with_gaps(_txns(spark, sf_dir))
    cards = demo.cards_with_gaps(demo.cards(txns))
    joined = enrich.enrich(txns, enrich.card_profiles(cards, demo.customers(txns)), demo.merchants(txns))
    return decide.decide(joined).select("txn_id", "card_id", "decision", "score", F.array_join("reasons.rule", ",").alias("rules"), "spent_minor", "last_seen")


def _state(spark, sf_dir):
    return decide.final_state(_decisions(spark, sf_dir))


def _filled(state):
    return state.withColumn("rules", F.array_join("reasons.rule", ",")).drop("reasons").fillna({"spend_day": -1, "spent_minor": -1, "last_lat": -999.0, "last_lon": -999.0, "last_seen": -1, "last_place": "?"})


def decision_state(spark, sf_dir):
    return _round(_filled(_state(spark, sf_dir)), "last_lat", "last_lon")


def state_after_sweep(spark, sf_dir):
    """The sweep 5,000 s before the feed's last accepted transaction."""
    state = _state(spark, sf_dir)
    now = F.broadcast(state.agg((F.max("last_seen") - 5_000_000).alias("now")))
    return _filled(decide.evict(state.crossJoin(now), F.col("now"))).select("card_id", "spend_day", "spent_minor", "last_seen")


def merchant_windows_final(spark, sf_dir):
    return _round(analytics.final_windows(_decisions(spark, sf_dir), feed=_feed(spark, sf_dir)), "decline_rate")


def merchant_windows_late(spark, sf_dir):
    """Arrival in the order of ids, which isn't that of time."""
    return _round(analytics.final_windows(_decisions(spark, sf_dir), ordered=False, order="txn_id", feed=_feed(spark, sf_dir)), "decline_rate")


def merchant_windows_latest12(spark, sf_dir):
    return _round(analytics.latest_windows(_decisions(spark, sf_dir), NOW_MS), "decline_rate")


def card_risk_view(spark, sf_dir):
    txns = _txns(spark, sf_dir)
    now = txns.agg(F.max("t")).first()[0]
    view = views.card_risk(_profiles(txns), _state(spark, sf_dir), txns.select("card_id", "t"), now)
    return _round(view.withColumn("last_rules", F.array_join("last_rules", ",")), "last_lat", "last_lon")


def card_lookup(spark, sf_dir):
    """One card by id: its transactions alone are joined and folded."""
    txns = _txns(spark, sf_dir)
    now = txns.agg(F.max("t")).first()[0]
    own = txns.where(F.col("card_id") == CARD)
    profiles = _profiles(own)
    state = decide.final_state(decide.decide(enrich.enrich(own, profiles, demo.merchants(own)), evaluated_at_ms=NOW_MS))
    return views.card_risk(profiles, state, own.select("card_id", "t"), now, CARD).select("card_id", "spent_today", "remaining", "last_txn", "last_decision", F.array_join("last_rules", ",").alias("last_rules"))


def merchant_lookup(spark, sf_dir):
    return _round(analytics.latest_windows(_decisions(spark, sf_dir), NOW_MS, merchant_id=MERCHANT), "decline_rate")


def decision_totals(spark, sf_dir):
    return _round(views.verdict_totals(_decisions(spark, sf_dir)), "share")


def rule_totals(spark, sf_dir):
    return _round(views.rule_totals(decide.reasons(_decisions(spark, sf_dir))), "bar")


def feed_snapshot(spark, sf_dir):
    made = _decisions(spark, sf_dir).withColumn("evaluated_at_ms", F.col("t") + 40)
    return views.feed(made).select("txn_id", "card_id", "decision", "score", "evaluated_at_ms")


def feed_tail(spark, sf_dir):
    made = _decisions(spark, sf_dir).select("txn_id", (F.col("card_id") % 6).alias("src_partition"), F.struct("t", "txn_id").alias("src_offset"))
    return views.feed_tail(made).select("txn_id", "src_partition", "position")


_RATES = ("precision", "recall", "false_positive_rate", "base_rate", "money_stopped", "f1")


def confusion(spark, sf_dir):
    return _round(evaluation.confusion(_judged(spark, sf_dir)), *_RATES)


def rule_stats(spark, sf_dir):
    return _round(evaluation.rule_stats(_judged(spark, sf_dir)), "precision", "lift", "fraud_share")


def card_episodes(spark, sf_dir):
    return evaluation.episodes(_judged(spark, sf_dir), "t", "txn_id")


def fraud_catch_summary(spark, sf_dir):
    return evaluation.catch_summary(card_episodes(spark, sf_dir))


def dataset_summary(spark, sf_dir):
    return _round(evaluation.dataset_summary(_judged(spark, sf_dir)), "base_rate")


def verdict_distribution(spark, sf_dir):
    return evaluation.verdict_distribution(_judged(spark, sf_dir))


def policy_comparison(spark, sf_dir):
    rows = _judged(spark, sf_dir, {"default": DEFAULT, "original": ORIGINAL})
    return _round(evaluation.compare_policies(evaluation.confusion(rows, "policy"), "original"), "precision", "recall", "fewer_wrong_declines")


def latency_summary(spark, sf_dir):
    sent = demo.events(spark, sf_dir).select(F.col("event_id").alias("txn_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("sent_ms"))
    decided = sent.where("txn_id % 50 <> 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("txn_id", (F.col("sent_ms") + F.col("txn_id") * 7919 % 1000 + F.col("k") * 500).alias("decided_ms"))
    return latency.summary(latency.match(sent, decided))


def replay_shift(spark, sf_dir):
    return tables.replay(_feed(spark, sf_dir), NOW_MS).select("txn_id", "t")


def first_n(spark, sf_dir):
    return tables.first_rows(_feed(spark, sf_dir), 500, "t", "txn_id").select("txn_id", "card_id", "t")


def _shared_folder(spark: SparkSession) -> str:
    return f"{shared.shared_folder(spark)}/{uuid.uuid4().hex}"


def _records(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    whole = F.to_json(F.struct(i.cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), (i % 13).cast("string").alias("merchant_id"), F.lit(100).alias("amount_minor")))
    value = F.when(i % 10 == 0, F.concat(F.lit('{"this is": not json '), i)).when(i % 15 == 1, F.regexp_replace(whole, '"amount_minor":100', '"other":1')).otherwise(whole)
    headers = F.map_from_arrays(F.array(F.lit("trace")), F.array(F.encode(i.cast("string"), "UTF-8")))
    return demo.events(spark, sf_dir).select(F.lit(None).cast("binary").alias("key"), value.cast("binary").alias("value"), headers.alias("headers"), F.lit("transactions").alias("src_topic"), (i % 4).alias("src_partition"), i.alias("src_offset"), F.col("ts").cast("timestamp").alias("src_timestamp"))


def dlq_split(spark, sf_dir):
    good, bad = quarantine.split(_records(spark, sf_dir), TRANSACTION)
    return good.select("src_partition", "src_offset", F.lit("good").alias("outcome")).unionByName(bad.select("src_partition", "src_offset", F.col("exception_class").alias("outcome")))


def dead_letters(spark, sf_dir):
    bad = quarantine.split(_records(spark, sf_dir), TRANSACTION)[1]
    return bad.select("src_offset", F.col("value").cast("string").alias("value"), F.decode(F.element_at("headers", "trace"), "UTF-8").alias("trace"), "exception_class", "message")


def dead_letter_totals(spark, sf_dir):
    return views.dead_letter_totals(quarantine.split(_records(spark, sf_dir), TRANSACTION)[1])


def schema_evolution(spark, sf_dir):
    i = F.col("event_id")
    raw = demo.events(spark, sf_dir).select(i.cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), F.lit("m").alias("merchant_id"), F.lit(1).cast("long").alias("amount_minor"), F.col("event_type").alias("device_fingerprint"), F.when(i % 3 == 0, "USD").alias("currency"), i)
    old = raw.where(i % 2 == 0).drop("device_fingerprint", "currency")
    new = raw.where(i % 2 == 1).withColumn("not_known_yet", F.lit(1))
    read = tables.evolve(old, TRANSACTION).unionByName(tables.evolve(new, TRANSACTION))
    return read.select("transaction_id", "device_fingerprint", "currency")


def _csv(spark, sf_dir) -> str:
    """Payments written as CSV files of two periods in the shared folder, in order of their ids."""
    i = F.col("event_id")
    raw = demo.events(spark, sf_dir).select(
        i.alias("_c0"), F.col("user_id").alias("cc_num"), F.concat(F.lit("fraud_m"), i % 9).alias("merchant"), F.concat(F.lit("cat"), i % 4).alias("category"), F.col("value").cast("decimal(18,3)").alias("amt"), F.col("user_id").cast("decimal(9,1)").alias("lat"), F.lit(2.5).alias("long"), i.alias("trans_num"),
        F.expr("unix_millis(cast(ts as timestamp)) div 1000").alias("unix_time"), F.lit(1.0).alias("merch_lat"), i.cast("decimal(9,1)").alias("merch_long"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"),
    )
    folder = _shared_folder(spark)
    for name, part in (("paymentsTrain", raw.where("event_id < 700")), ("paymentsTest", raw.where("event_id >= 700"))):
        part.orderBy("_c0").write.option("header", True).csv(f"{folder}/{name}.csv")
    return f"{folder}/*.csv"


def csv_ingest(spark, sf_dir):
    """Both periods in one read, as a user would, with their order."""
    rows = labelled.transactions(labelled.read(spark, _csv(spark, sf_dir)))
    return rows.select("transaction_id", "card_id", "merchant_id", "amount_minor", "t", "labelled_fraud", "period", F.col("seq.file_rank").alias("file_rank"))


def csv_first_n(spark, sf_dir):
    """The first rows in feed order: all of the training file stands before the test file."""
    return labelled.transactions(labelled.read(spark, _csv(spark, sf_dir), limit=750)).select("transaction_id", "period")


def csv_period(spark, sf_dir):
    return labelled.transactions(labelled.read(spark, _csv(spark, sf_dir), limit=100, period="PaymentsTest")).select("transaction_id", "period")


def csv_profiles(spark, sf_dir):
    return labelled.profiles(labelled.read(spark, _csv(spark, sf_dir))).drop("currency")


def csv_merchants(spark, sf_dir):
    return labelled.merchants(labelled.read(spark, _csv(spark, sf_dir)))


def scalar_texts(spark, sf_dir):
    """The column functions on amounts and times of the feed."""
    c, i = F.round(F.col("value") * 100).cast("long"), F.col("event_id")
    rows = demo.events(spark, sf_dir).select("event_id", c.alias("c"), (i * 7919 % 500_000).alias("ms"), (F.col("event_id") % 1000 / 1000.0).alias("share"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    texts = {"money": scalars.money(F.col("c"), F.lit("EUR")), "took": scalars.duration(F.col("ms")), "percent": scalars.percentage(F.col("share")), "many": scalars.thousands(F.col("ms")), "whole": scalars.dollars(F.col("c"))}
    numbers = {"day": scalars.epoch_day(F.col("t")), "kmh": scalars.rounded(scalars.implied_kmh(F.col("c") / 100.0, F.col("ms") - 1000))}
    return rows.select("event_id", *(v.alias(k) for k, v in (texts | numbers).items()))


@contextmanager
def _state_store(spark):
    """What stateful steps need of the session; its own choice is set back."""
    from ..streaming.decisions import SETTINGS

    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _live(spark, sf_dir, folder: str):
    """The feed as files, as a stream finds them, enriched."""
    txns = _txns(spark, sf_dir)
    txns.drop("source_day").write.parquet(f"{folder}/feed")
    return enrich.enrich(spark.readStream.schema(txns.drop("source_day").schema).parquet(f"{folder}/feed"), _profiles(txns), demo.merchants(txns))


def _stream(spark, sf_dir, sink: str, **how) -> str:
    """Decisions of the whole feed by the stateful stream, as Parquet in the shared folder."""
    from ..streaming import decisions as stream

    folder = _shared_folder(spark)
    with _state_store(spark):
        made = stream.decide_stream(_live(spark, sf_dir, folder), **how)
        _run(made.writeStream.format("parquet").option("path", f"{folder}/{sink}").option("checkpointLocation", f"{folder}/checkpoint"))
    return f"{folder}/{sink}"


def stream_decisions(spark, sf_dir):
    made = spark.read.parquet(_stream(spark, sf_dir, "decisions"))
    return made.select("txn_id", "card_id", "merchant_id", "t", "amount_minor", "decision", "score", F.size("reasons").alias("n_reasons"))


def stream_merchant_windows(spark, sf_dir):
    from ..streaming import windows

    path = _stream(spark, sf_dir, "decisions")
    made = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    windows.final_windows(made, f"{path}-windows", f"{path}-windows-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _round(spark.read.parquet(f"{path}-windows"), "decline_rate")


def stream_enriched(spark, sf_dir):
    from ..streaming import enriched as stream

    txns, folder = _txns(spark, sf_dir), _shared_folder(spark)
    txns.write.parquet(f"{folder}/feed")
    live = spark.readStream.schema(txns.schema).parquet(f"{folder}/feed")
    stream.enrich_stream(live, lambda: _profiles(txns), lambda: demo.merchants(txns), f"{folder}/enriched", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _flat(spark.read.parquet(f"{folder}/enriched/feed"))


def stream_live_windows(spark, sf_dir):
    from ..streaming import windows

    path = _stream(spark, sf_dir, "decisions")
    made = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    windows.live_windows(made, f"{path}-live", f"{path}-live-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _round(windows.latest_counts(spark, f"{path}-live"), "decline_rate")


def stream_live_state(spark, sf_dir):
    """Each card's state as the stream left it."""
    from ..streaming import decisions as stream

    path = _stream(spark, sf_dir, "decisions")
    return _state_rows(spark, stream, f"{path.rpartition('/')[0]}/checkpoint").drop("n_attempts")


def _state_rows(spark, stream, checkpoint: str) -> DataFrame:
    """Every card with what is known of it, -1 for what isn't."""
    card = F.col("key.card_id").alias("card_id")
    part = {v: stream.live_state(spark, checkpoint, v) for v in stream.VARIABLES}
    rows = part["newest"].select(card)
    rows = rows.join(part["spend"].select(card, F.col("value.day").alias("spend_day"), F.col("value.spent").alias("spent_minor")), "card_id", "left")
    rows = rows.join(part["location"].select(card, F.col("value.seen").alias("last_seen")), "card_id", "left")
    rows = rows.join(part["attempts"].groupBy(card).agg(F.sum(F.size("user_map_value.t")).alias("n_attempts")), "card_id", "left")
    return rows.fillna({"spend_day": -1, "spent_minor": -1, "last_seen": -1, "n_attempts": 0})


def stream_swept_state(spark, sf_dir):
    """State after the sweeps of a replay, by short ages, as the feed's bursts last minutes."""
    from ..streaming import decisions as stream

    ages = stream.Ages(location_ms=60_000, spend_days=0, attempts_ms=60_000, every_ms=60_000)
    path = _stream(spark, sf_dir, "decisions", ages=ages, clock=F.timestamp_millis("transaction.t"))
    return _state_rows(spark, stream, f"{path.rpartition('/')[0]}/checkpoint")


def stream_card_state(spark, sf_dir):
    """One card's live state, its attempts too."""
    from ..streaming import decisions as stream

    path = _stream(spark, sf_dir, "decisions")
    found = stream.card_state(spark, f"{path.rpartition('/')[0]}/checkpoint", CARD)
    return found.select("card_id", "spend_day", "spent_minor", "last_seen", F.size("attempts").alias("n_attempts"), F.get("attempts.t", F.lit(0)).alias("first_attempt"))


def stream_state_changes(spark, sf_dir):
    """What the first batch changed of every card's last location."""
    from ..streaming import decisions as stream

    path = _stream(spark, sf_dir, "decisions")
    found = stream.state_changes(spark, f"{path.rpartition('/')[0]}/checkpoint", "location", last=0)
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), "change_type", F.col("key.card_id").alias("card_id"), F.col("value.seen").alias("last_seen"))


def stream_restart(spark, sf_dir):
    """The decision stream ended and started again twice, as more of the feed comes; state and output go on."""
    from ..streaming import decisions as stream

    folder, txns = _shared_folder(spark), _txns(spark, sf_dir).drop("source_day")
    profiles, shops = _profiles(txns), demo.merchants(txns)
    a, b = txns.selectExpr("approx_percentile(t, 0.3)", "approx_percentile(t, 0.7)").first()
    with _state_store(spark):
        for part in (F.col("t") <= a, (F.col("t") > a) & (F.col("t") <= b), F.col("t") > b):
            txns.where(part).write.mode("append").parquet(f"{folder}/feed")
            live = enrich.enrich(spark.readStream.schema(txns.schema).parquet(f"{folder}/feed"), profiles, shops)
            _run(stream.decide_stream(live).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out").select("txn_id", "card_id", "merchant_id", "t", "amount_minor", "decision", "score", F.size("reasons").alias("n_reasons"))


def stream_chained_windows(spark, sf_dir):
    """Decisions and their windows in one query: the fold's output keeps its event time."""
    from ..streaming import decisions as stream
    from ..streaming import windows

    folder = _shared_folder(spark)
    with _state_store(spark):
        made = stream.decide_stream(_live(spark, sf_dir, folder), clock=F.timestamp_millis("transaction.t"), event_time=True, slack="30 seconds")
        _run(windows.final_windows(made, f"{folder}/windows", f"{folder}/checkpoint"))
    return _round(spark.read.parquet(f"{folder}/windows"), "decline_rate")


def stream_windows_late(spark, sf_dir):
    """Windows with exact grace over four micro-batches that arrive in the order of ids, which isn't that of time."""
    from ..sources.committed import CommittedFolder
    from ..streaming import windows

    folder = _shared_folder(spark)
    made = shared.kept(_decisions(spark, sf_dir).select("txn_id", "merchant_id", "t", "decision"))
    cuts = [None, *made.selectExpr("approx_percentile(txn_id, array(0.25, 0.5, 0.75))").first()[0], None]
    with _state_store(spark):
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = made.where(F.lit(True) if low is None else F.col("txn_id") > low).where(F.lit(True) if high is None else F.col("txn_id") <= high)
            part.write.mode("append").parquet(f"{folder}/decisions")
            live = spark.readStream.schema(made.schema).parquet(f"{folder}/decisions")
            _run(windows.clocked(live, f"{folder}/clocked", f"{folder}/checkpoint-clock", "txn_id"))
            timed = CommittedFolder(spark, f"{folder}/clocked")
            done = windows.exact_windows(timed.stream(timed.read().schema))
            _run(done.writeStream.format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint-windows"))
    return _round(spark.read.parquet(f"{folder}/windows"), "decline_rate")


def stream_totals(spark, sf_dir):
    """Live totals by verdict and by rule."""
    from ..streaming import windows

    path = _stream(spark, sf_dir, "decisions")
    made = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    _run(windows.totals(made, f"{path}-totals", f"{path}-totals-checkpoint"))
    return windows.latest_totals(spark, f"{path}-totals")


def stream_profiles(spark, sf_dir):
    """Profiles in force after updates, moves and deletes of cards and customers in three rounds of changes."""
    from ..streaming import profiles as stream

    folder, i, u = _shared_folder(spark), F.col("event_id"), F.col("user_id")
    raw, text = demo.events(spark, sf_dir), lambda c: c.cast("string")
    cards = raw.where(i % 3 == 0).select(text(u).alias("card_id"), i.alias("seq"), (F.col("event_type") != "error").alias("live"), text(i * 31 % 97).alias("customer_id"), F.col("event_type").alias("status"), i.alias("daily_limit_minor"), F.lit("EUR").alias("currency"))
    customers = raw.where(i % 3 == 1).select(text(i * 7 % 97).alias("customer_id"), i.alias("seq"), (i % 5 != 0).alias("live"), F.col("event_type").alias("risk_tier"), text(i % 11).alias("home_country"), (i % 90).cast("double").alias("home_lat"), (i % 180).cast("double").alias("home_lon"))
    a, b = raw.selectExpr("approx_percentile(event_id, array(0.4, 0.7))").first()[0]
    with _state_store(spark):
        for part in (F.col("seq") <= a, (F.col("seq") > a) & (F.col("seq") <= b), F.col("seq") > b):
            live = []
            for name, rows in (("cards", cards), ("customers", customers)):
                rows.where(part).write.mode("append").parquet(f"{folder}/{name}")
                live.append(spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}"))
            _run(stream.profile_changes(*live).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint"))
    return stream.current(spark.read.parquet(f"{folder}/changes")).drop("currency")


def stream_dead_letters(spark, sf_dir):
    """Good and bad records of a stream of bytes, each set aside once."""
    folder, records = _shared_folder(spark), _records(spark, sf_dir)
    records.write.parquet(f"{folder}/records")
    _run(quarantine.split_stream(spark.readStream.schema(records.schema).parquet(f"{folder}/records"), TRANSACTION, f"{folder}/split", f"{folder}/checkpoint"))
    good, bad = (spark.read.parquet(f"{folder}/split/{side}/feed") for side in ("good", "bad"))
    return good.select("src_partition", "src_offset", F.lit("good").alias("outcome")).unionByName(bad.select("src_partition", "src_offset", F.col("exception_class").alias("outcome")))


def decisions_by_days(spark, sf_dir):
    """All cards above a number of transactions cut by days, as very long ones are."""
    txns = _txns(spark, sf_dir)
    made = decide.decide(_enriched(spark, sf_dir), evaluated_at_ms=NOW_MS, hot=decide.hot_cards(txns, 300))
    made = made.select("txn_id", "card_id", "decision", "score", F.size("reasons").alias("n_reasons"), "spend_day", "spent_minor", scalars.rounded(F.col("last_lat")).alias("last_lat"), "last_seen", "last_place")
    return made.fillna({"spend_day": -1, "spent_minor": -1, "last_lat": -999.0, "last_seen": -1, "last_place": "?"})


def null_guard(spark, sf_dir):
    """Records without a transaction get no decision."""
    txns = _txns(spark, sf_dir)
    with_nulls = txns.withColumn("transaction_id", F.when(F.col("transaction_id") % 10 != 0, F.col("transaction_id")))
    return _flat(enrich.enrich(with_nulls, _profiles(txns), demo.merchants(txns))).select("txn_id", "has_profile", "has_merchant")


def evaluation_summary(spark, sf_dir):
    """The report's headline texts."""
    made = evaluation.report(_judged(spark, sf_dir), "t", "txn_id")
    return evaluation.summary(made["dataset"], made["declined"], made["flagged"])


def long_messages(spark, sf_dir):
    """Dead letters' messages on both sides of their longest length."""
    i = F.col("event_id")
    values = demo.events(spark, sf_dir).select(i, F.concat(F.lit("{"), F.repeat(F.lit("x"), (i % 1500).cast("int"))).cast("binary").alias("value"))
    records = values.select(F.lit(None).cast("binary").alias("key"), "value", F.lit("t").alias("src_topic"), F.lit(0).alias("src_partition"), i.alias("src_offset"), F.lit(None).cast("timestamp").alias("src_timestamp"))
    return quarantine.split(records, TRANSACTION)[1].select("src_offset", "message")


def symbols(spark, sf_dir):
    """Symbols of an enumeration, and its default for unknown ones and none."""
    t = F.col("event_type")
    rows = demo.events(spark, sf_dir).select("event_id", F.when(t == "click", "BLOCKED").when(t == "view", "EXPIRED").when(t == "error", "LOST").alias("status"), F.upper(t).alias("risk_tier"))
    return rows.select("event_id", scalars.symbol("status").alias("status"), scalars.symbol("risk_tier").alias("risk_tier"))


def schema_evolution_files(spark, sf_dir):
    """Files of an old, a new and a later version in one folder, read as the current schema."""
    folder, i = _shared_folder(spark), F.col("event_id")
    raw = demo.events(spark, sf_dir).select(i.cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("card_id"), F.lit("m").alias("merchant_id"), F.lit(1).cast("long").alias("amount_minor"), F.col("event_type").alias("device_fingerprint"), F.when(i % 3 == 0, "USD").alias("currency"), i)
    raw.where(i % 2 == 0).drop("device_fingerprint", "currency", "event_id").write.mode("append").parquet(f"{folder}/rows")
    raw.where(i % 4 == 1).drop("event_id").write.mode("append").parquet(f"{folder}/rows")
    raw.where(i % 4 == 3).drop("event_id").withColumn("not_known_yet", F.lit(1)).write.mode("append").parquet(f"{folder}/rows")
    return tables.read_versions(spark, f"{folder}/rows", TRANSACTION).select("transaction_id", "device_fingerprint", "currency")


QUERIES = {
    f.__name__: f
    for f in (
        txn_event_time, latest_reference, card_profiles, enriched, asof_reference, nearby_merchants, velocity_attempts, card_testing, static_rules, decisions, decision_reasons, decisions_with_gaps, decision_state, state_after_sweep,
        merchant_windows_final, merchant_windows_late, merchant_windows_latest12, card_risk_view, card_lookup, merchant_lookup, decision_totals, rule_totals, feed_snapshot, feed_tail, confusion, rule_stats, card_episodes, fraud_catch_summary,
        dataset_summary, verdict_distribution, policy_comparison, latency_summary, replay_shift, first_n, dlq_split, dead_letters, dead_letter_totals, schema_evolution, csv_ingest, csv_first_n, csv_period, csv_profiles, csv_merchants, scalar_texts,
        stream_decisions, stream_merchant_windows, stream_enriched, stream_live_windows, stream_live_state, stream_swept_state, stream_card_state, stream_state_changes, stream_restart, stream_chained_windows, stream_windows_late, stream_totals,
        stream_profiles, stream_dead_letters, decisions_by_days, null_guard, evaluation_summary, long_messages, symbols, schema_evolution_files,
    )
}
ORACLE_SQL = {k: EVERY[k] for k in QUERIES}
