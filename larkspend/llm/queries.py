"""Registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from . import langid, lexical, lm, mixing, ngram_join, packing, pii, quality, simhash, spans, spelling, topk, toxicity


def _documents(operator, *more):
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/documents.parquet"), *more)


QUERIES = {
    "op1_ngram_join": _documents(ngram_join.op1_ngram_join),
    "op2_mixing": _documents(mixing.op2_mixing),
    "op3_pii": _documents(pii.op3_pii),
    "op4_langid": _documents(langid.op4_langid),
    "op5_topk": lambda spark, sf_dir: topk.op5_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op6_packing": _documents(packing.op6_packing),
    "op7_lm": _documents(lm.op7_lm),
    "op8_quality": _documents(quality.op8_quality),
    "op9_spans": _documents(spans.op9_spans),
    "op10_toxicity": lambda spark, sf_dir: toxicity.op10_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op11_simhash": _documents(simhash.op11_simhash),
    "op12_lexical": lambda spark, sf_dir: lexical.op12_lexical(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op13_spelling": _documents(spelling.op13_spelling),
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_topk": topk.OP5_SQL,
    "op8_quality": quality.OP8_SQL,
    "op12_lexical": lexical.OP12_SQL,
}
