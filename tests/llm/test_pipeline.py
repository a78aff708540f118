"""The pipeline's stages on a small corpus."""

import os
import random
import re

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    syllables = {"aa": ["ba", "bo", "bi", "lu"], "bb": ["tz", "kö", "schü", "ver"]}
    rows = []
    for i in range(160):
        k = r.choice(list(syllables))
        text = " ".join("".join(r.choices(syllables[k], k=r.randint(1, 5))) for _ in range(r.randint(20, 90)))
        rows.append((i, text, k, r.choice(["s1", "s2", None]), len(text)))
    rows += [(160, rows[0][1], "aa", "s1", 1), (161, "1234 5678", "aa", "s1", 9), (162, None, "aa", "s1", None), (163, rows[1][1] + " a@b.co", "aa", "s2", 5)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
    assert {r["doc_id"] for r in seen[0].collect()} == set(range(161)) | {163}
    left = {r["doc_id"] for r in seen[1].collect()}
    assert 0 in left and 160 not in left and left <= set(range(161)) | {163}
    assert all("@" not in r["text"] for r in seen[2].collect()) and seen[2].count() == len(left)
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert abs(size(seen[3]) - size(seen[2])) <= 3
    assert seen[4].selectExpr("sum(length) = sum(if(start = 0, doc_tokens, 0))").first()[0]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_whole_package_stands_without_corpus_part():
    """Nothing outside the corpus part imports it."""
    import larkspend

    root = os.path.dirname(larkspend.__file__)
    for d, _, names in os.walk(root):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(d, n)) as f:
                        assert ".llm" not in f.read()


def test_run_on_empty_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
