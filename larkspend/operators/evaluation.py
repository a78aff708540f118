"""Decisions against labels: confusion, rule statistics, episodes of fraud, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dollars, percentage, ratio, thousands
from ..sources.shared import kept
from .quantiles import medians

OVERALL = "**all**"


def _fraud():
    """A missing label counts as honest."""
    return F.coalesce("labelled_fraud", F.lit(False))


def with_overall(per: DataFrame, *keys: str) -> DataFrame:
    """Sums per ``keys`` and period, and over all periods: grouping sets over rows that are sums of a period already, so
    no decision is expanded. All other columns are added up."""
    sums = [c for c in per.columns if c not in (*keys, "period")]
    sets = per.groupingSets([[F.col(c) for c in (*keys, "period")], [F.col(c) for c in keys]], *(F.col(c) for c in (*keys, "period")))
    both = sets.agg(F.grouping("period").alias("__all"), *(F.sum(c).alias(c) for c in sums))
    # without keys the overall row is there for an empty input too, as sums of nothing
    return both.withColumn("period", F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("period"))).drop("__all").where(F.coalesce(*sums).isNotNull())


def confusion(decisions: DataFrame, *keys: str) -> DataFrame:
    """Per period, and overall, and operating point (declined, flagged): counts, money and the measures derived from them."""
    fraud, amount = _fraud(), F.col("amount_minor")
    counts = [F.coalesce(F.sum(F.when(fraud, amount)), F.lit(0)).alias("fraud_minor")]
    for point, hit in (("declined", F.coalesce(F.col("decision") == "DECLINE", F.lit(False))), ("flagged", F.coalesce(F.col("decision") != "APPROVE", F.lit(False)))):
        counts += [F.count_if(c).alias(f"{point}_{name}") for name, c in (("tp", hit & fraud), ("fp", hit & ~fraud), ("fn", ~hit & fraud), ("tn", ~hit & ~fraud))]
        counts.append(F.coalesce(F.sum(F.when(hit & fraud, amount)), F.lit(0)).alias(f"{point}_caught_minor"))
    both = with_overall(decisions.groupBy(*keys, "period").agg(*counts), *keys)
    names = ("tp", "fp", "fn", "tn", "caught_minor")
    points = F.array(*(F.struct(F.lit(p).alias("point"), *(F.col(f"{p}_{n}").alias(n) for n in names)) for p in ("declined", "flagged")))
    per = both.select(*keys, "period", "fraud_minor", F.explode(points).alias("p")).select(*keys, "period", "p.*", "fraud_minor")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    per = per.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_positive_rate": ratio(fp, fp + tn), "base_rate": ratio(tp + fn, tp + fp + fn + tn), "money_stopped": ratio(F.col("caught_minor"), F.col("fraud_minor"))})
    return per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rule_stats(decisions: DataFrame) -> DataFrame:
    """Per period, and overall, and rule: hits, frauds among them, precision, lift over the base rate and share of all fraud."""
    # a row without a rule for each decision gives the totals in the same pass
    each = decisions.select("period", _fraud().alias("fraud"), F.explode(F.concat(F.coalesce("reasons.rule", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("rule"))
    per = kept(with_overall(each.groupBy("period", "rule").agg(F.count("*").alias("hits"), F.count_if("fraud").alias("fraud_hits")), "rule"))
    totals = per.where("rule is null").select("period", F.col("hits").alias("rows"), F.col("fraud_hits").alias("frauds"))
    per = per.where("rule is not null").join(F.broadcast(totals), "period").withColumn("precision", ratio(F.col("fraud_hits"), F.col("hits")))
    base = ratio(F.col("frauds"), F.col("rows"))
    return per.select("period", "rule", "hits", "fraud_hits", "precision", F.when(base > 0, F.col("precision") / base).alias("lift"), ratio(F.col("fraud_hits"), F.col("frauds")).alias("fraud_share"))


def episodes(decisions: DataFrame, *order: str) -> DataFrame:
    """Per period, and overall, and card hit by fraud: its frauds, and which of them was the first to be flagged. Frauds
    alone are ranked, once in their period and once in all."""
    fraud = decisions.where(_fraud()).withColumn("period", F.explode(F.array(F.col("period"), F.lit(OVERALL))))
    fraud = fraud.withColumn("nth", F.row_number().over(Window.partitionBy("period", "card_id").orderBy(*order)))
    return fraud.groupBy("period", "card_id").agg(F.count("*").alias("frauds"), F.min(F.when(F.col("decision") != "APPROVE", F.col("nth"))).cast("long").alias("first_flagged"))


def catch_summary(per_card: DataFrame) -> DataFrame:
    """Per period: cards hit, cards caught, exact median of frauds that went through before the catch."""
    per_card = kept(per_card.select("period", (F.col("first_flagged") - 1).alias("value")))
    n = per_card.groupBy("period").agg(F.count("*").alias("cards_hit"), F.count("value").alias("cards_caught"))
    return n.join(medians(per_card, "period").withColumnRenamed("median", "median_before"), "period", "left")


def dataset_summary(decisions: DataFrame) -> DataFrame:
    """Per period, and overall: transactions, frauds and their money, cards and merchants. Decisions are reduced once, to a
    row for each period, card and merchant."""
    few = kept(decisions.groupBy("period", "card_id", "merchant_id").agg(F.count("*").alias("transactions"), F.count_if(_fraud()).alias("frauds"), F.coalesce(F.sum(F.when(_fraud(), F.col("amount_minor"))), F.lit(0)).alias("fraud_minor")))
    per = with_overall(few.groupBy("period").agg(*(F.sum(c).alias(c) for c in ("transactions", "frauds", "fraud_minor"))))
    for key, name in (("card_id", "cards"), ("merchant_id", "merchants")):
        ids = few.select("period", key).distinct()
        n = ids.groupingSets([[F.col("period")], []], F.col("period")).agg(F.grouping("period").alias("all"), F.count_distinct(key).alias(name))
        per = per.join(n.select(F.when(F.col("all") == 1, OVERALL).otherwise(F.col("period")).alias("period"), name), "period")
    return per.withColumn("base_rate", ratio(F.col("frauds"), F.col("transactions")))


def verdict_distribution(decisions: DataFrame) -> DataFrame:
    from ..schemas import VERDICTS

    per = decisions.groupBy("period").pivot("decision", list(VERDICTS)).count()
    return with_overall(per.fillna(0)).select("period", *(F.col(v).alias(v.lower()) for v in VERDICTS))


def compare_policies(confusions: DataFrame, original: str) -> DataFrame:
    """Declined operating point of each policy and period, with the change of good customers declined against the
    original policy."""
    declined = confusions.where("point = 'declined'").select("policy", "period", "tp", "fp", "precision", "recall")
    first = F.max(F.when(F.col("policy") == original, F.col("fp"))).over(Window.partitionBy("period"))
    return declined.withColumn("__fp", first).where("__fp is not null").withColumn("fewer_wrong_declines", F.when(F.col("__fp") > 0, 1 - F.col("fp") / F.col("__fp"))).drop("__fp")


def summary(dataset: DataFrame, declined: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per period the headline figures as texts: counts with thousands separators, shares, money."""
    caught = lambda df, name: df.select("period", percentage(F.col("recall")).alias(f"{name}_recall"), percentage(F.col("precision")).alias(f"{name}_precision"), dollars(F.col("caught_minor")).alias(f"{name}_caught"))
    rows = dataset.select("period", thousands(F.col("transactions")).alias("transactions"), thousands(F.col("frauds")).alias("frauds"), percentage(F.col("base_rate")).alias("base_rate"), dollars(F.col("fraud_minor")).alias("fraud"))
    return rows.join(caught(declined, "declined"), "period").join(caught(flagged, "flagged"), "period")


def report(decisions: DataFrame, *order: str) -> dict[str, DataFrame]:
    """The tables of an evaluation report, per period and overall; decisions need ``period``. They are made once."""
    decisions = kept(decisions.select("txn_id", "card_id", "merchant_id", "amount_minor", "labelled_fraud", "decision", "reasons", "period", *(c for c in order if c in decisions.columns and c not in ("txn_id", "card_id"))))
    cards = kept(episodes(decisions, *order))
    points = confusion(decisions)
    return {"dataset": dataset_summary(decisions), "declined": points.where("point = 'declined'"), "flagged": points.where("point = 'flagged'"), "rules": rule_stats(decisions), "cards": catch_summary(cards), "episodes": cards, "decisions": verdict_distribution(decisions)}
