"""From labelled payment files to the evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import decide, enrich, evaluation
from ..policy import DEFAULT, Policy
from ..sources import labelled


def decisions(spark: SparkSession, paths, policy: Policy = DEFAULT, limit: int | None = None, seed: int = 42, period: str | None = None) -> DataFrame:
    """One decision a row, in feed order; one continuous state a card across files."""
    rows = labelled.read(spark, paths, limit, period)
    txns = labelled.transactions(rows)
    joined = enrich.enrich(txns, labelled.profiles(rows, seed), labelled.merchants(rows))
    return decide.decide(joined, policy, ordered=False, keep=("period", "seq"))


def setup(spark: SparkSession, paths, policy: Policy, limit: int | None, seed: int, period: str | None) -> DataFrame:
    """name, value of what a run was started with."""
    given = {"files": paths if isinstance(paths, str) else ", ".join(paths), "rows": "all" if limit is None else f"first {limit}", "period": period or "all", "seed": seed, "certain_km": policy.certain_km, "short_hop_score": policy.short_hop_score}
    return spark.createDataFrame([(k, str(v)) for k, v in given.items()], "name string, value string")


def evaluate(spark: SparkSession, paths, policy: Policy = DEFAULT, limit: int | None = None, seed: int = 42, period: str | None = None) -> dict[str, DataFrame]:
    """The report's tables, with texts as a reader wants them in ``summary``."""
    report = evaluation.report(decisions(spark, paths, policy, limit, seed, period), "seq")
    return report | {"setup": setup(spark, paths, policy, limit, seed, period), "summary": evaluation.summary(report["dataset"], report["declined"], report["flagged"])}
