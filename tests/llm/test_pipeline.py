"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import pytest
from pyspark.core.rdd import RDD
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marginalia.llm import common, graph, jaccard, langid, packing, pii


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("rank", docs_extra())
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, small)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert out.count() > 0.5 * seen.count(), name
        seen = out
    last = cp.STAGES[-1][1](spark, seen, small)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(last.columns) and last.count() >= seen.count()


def test_language_stage_keeps_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    out = {r.doc_id for r in cp.identify_language(spark, docs.unionByName(junk), small).collect()}
    assert len(out) >= 0.99 * docs.count() and not out & {10**6, 10**6 + 1}


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_unlabelled_documents_are_not_lost_silently(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="no document has a language"):
        cp.identify_language(spark, docs, small)


def test_odd_rows_and_clashing_names(spark, small):
    clean = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(None, "the same words again and again in this text", "en", "a", 1), (None, None, None, None, None), (-5, "", "en", "a", 0), (-6, "x" * 200_000, "en", "b", 7), (-7, "word " * 60_000, None, None, 7)]
    rows += [(-8, "a text that stands here twice with all of its words", "en", "a", 3)] * 2
    docs = clean.unionByName(spark.createDataFrame(rows, clean.schema))
    for name in ("rank", "comp", "bucket", "rejected", "copy", "further", "__h", "rows"):
        docs = docs.withColumn(name, F.lit(1))
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        seen = stage(spark, seen, small)
        assert sorted(seen.columns) == sorted(docs.columns), name
    ids = [r.doc_id for r in seen.collect()]
    assert ids and cp.STAGES[-1][1](spark, seen, small).count() >= len(ids)


def python_steps(node, above=0):
    """The most Python steps that one task of the plan runs at once: those between two exchanges."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return python_steps(node.initialPlan(), above)
    above = 0 if "Exchange" in node.nodeName() else above + (node.nodeName() in ("MapInArrow", "MapInPandas", "ArrowEvalPython"))
    below = node.children()
    return max([above, *(python_steps(below.apply(k), above) for k in range(below.length()))])


def test_a_task_needs_one_python_worker(spark, small, monkeypatch):
    """Executors keep every worker that they ever started, so a task with two Python steps doubles what all later stages hold."""
    most = {}

    def noted(df, tag):
        most[tag] = max(most.get(tag, 0), python_steps(df._jdf.queryExecution().executedPlan()))
        return common.materialise(df, tag)

    for module in (graph, jaccard, langid, packing, pii):
        monkeypatch.setattr(module, "materialise", noted)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = noted(stage(spark, docs, small), name)
    assert max(most.values()) == 1, {k: v for k, v in most.items() if v > 1}


def test_packing_plan_reaches_executors_without_rdd_workers(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows of the driver go through Python workers")

    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "word " * 3000)], "doc_id long, text string").localCheckpoint()
    monkeypatch.setattr(RDD, "map", refused)
    out = packing.pack(docs).collect()
    assert {r.doc_id for r in out} == {1, 2, 3} and {r.offset for r in out if r.doc_id == 3} != set()
    assert packing.pack(docs.limit(0)).count() == 0


def docs_extra():
    return F.lit(7)
