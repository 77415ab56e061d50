"""The registered queries beside their SQL, and the pipeline's stages."""

import os
import sys
from types import SimpleNamespace

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from slopecast.llm.quality import BITS, Fitted

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OPS = sorted(n for n in entry.queries() if n.startswith("op") and n[2:].split("_")[0].isdigit())


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in OPS} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", OPS)
def test_query(spark, name):
    res = compare(spark, duck(SF), SimpleNamespace(fn=entry.queries()[name], sql=entry.oracle_sql().get(name)), SF)
    assert not res.startswith("FAIL"), res


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, kept = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.reused(stage(spark, now, SF), "stage")
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        kept.append(out.count())
        assert out.join(now, "doc_id", "left_anti").count() == 0
        now = out
    assert kept[0] > kept[1] > kept[2] > kept[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == kept[-1]
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("level", [-30.0, 30.0])
def test_texts_without_features_stay_whatever_the_fit(spark, monkeypatch, level):
    """Null, empty and blank texts pass all filters under a model that scores no features low, and one that scores them high."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bare = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t")], "doc_id long, text string")
    docs = docs.limit(20).unionByName(bare, allowMissingColumns=True).select(docs.columns)
    none = np.zeros(1 << BITS, np.float32)
    monkeypatch.setattr(corpus_pipeline, "quality_model", lambda *_: Fitted(none, none, 0.0, 1.0, level))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.count() == (23 if level > 0 else 3)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = corpus_pipeline.reused(stage(spark, kept, SF), "stage")
    assert {r.doc_id for r in kept.where("doc_id < 0").collect()} == {-1, -2, -3}


def test_blank_leftovers_go_and_own_columns_stay(spark):
    """A document of which only line feeds are left goes; columns named like a stage's own come back unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    line = "one two three four five six seven"
    few = spark.createDataFrame([(-5, line, "a"), (-4, f"{line}\n\n{line}\n", "b"), (-3, "\n\n", "c"), (-2, None, "d")], "doc_id long, text string, n_removed string")
    few = few.withColumns({"_score": few.n_removed, "n_lines": few.n_removed, "removed": few.n_removed, "n_chars": few.doc_id})
    few = docs.limit(0).drop("n_chars").unionByName(few, allowMissingColumns=True)
    out = corpus_pipeline.reused(corpus_pipeline.STAGES[1][1](spark, few, SF), "stage")
    assert out.columns == few.columns and {(r.doc_id, r.n_removed, r.n_lines, r.removed) for r in out.collect()} == {(-5, "a", "a", "a"), (-3, "c", "c", "c"), (-2, "d", "d", "d")}
    kept = corpus_pipeline.STAGES[0][1](spark, few, SF)
    assert kept.columns == few.columns and {r["_score"] for r in kept.where("doc_id in (-3, -2)").collect()} == {"c", "d"}
