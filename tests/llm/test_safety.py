"""Clashing columns, hostile input, repeated rows and bounds of the training-data operators."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, mixing, quality, simhash, toxicity
from tracewright.llm.wrappers import DEEPEST, Page

from test_operators import SMALL, labels_of, odd_docs

NAMES = ["evidence", "posterior", "host_prior", "path_prior", "__posterior", "copy", "words", "position", "__copies", "row", "id", "fp", "size", "n", "kind", "target", "__id", "__fp", "a.b", "s"]


def crowded(spark):
    """odd_docs with every name that operators use, each with values of its own."""
    docs = odd_docs(spark)
    for i, n in enumerate(NAMES):
        docs = docs.withColumn(n, F.concat(F.lit(f"own{i}-"), F.coalesce(F.substring("text", 1, 9), F.lit("null"))))
    return docs


def rows(df):
    return Counter(tuple(r) for r in df.select(*[F.col(common.quoted(c)) for c in df.columns]).collect())


def test_stages_return_the_values_of_clashing_columns(spark):
    import corpus_pipeline

    docs = crowded(spark)
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        got = rows(out)
        if name == "mixing":
            at, cut, long = docs.columns.index("text"), docs.columns.index("n_chars"), lambda r: tuple(x for i, x in enumerate(r) if i not in (at, cut))
            whole = {long(r) for r in before}
            assert got and all(long(r) in whole and r[cut] == len(r[at]) for r in got)
            assert got == rows(stage(spark, docs.repartition(7), SMALL)), "reruns agree"
        else:
            assert all(n <= before[r] for r, n in got.items()), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_keep_one_leaves_one_row_of_each_component(spark):
    docs = crowded(spark)
    classes = simhash.near_duplicates(docs).collect()
    kept = simhash.keep_one(docs).collect()
    named = {r.component_id for r in classes if r.component_id is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(named)
    assert len(kept) - len(named) == len({r.fingerprint for r in classes if r.component_id is None})


def test_twins_are_cut_alike_on_reruns(spark):
    docs = [(7, f"text {i} of a twin with the same number of words {i}", "en", "s", None) for i in range(20)] + [(i + 100, "b " * 30, "en", "t", None) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    want = rows(mixing.mix(df, weights=(1, 9)))
    assert want == rows(mixing.mix(df.orderBy(F.desc("text")).repartition(5), weights=(1, 9)))


def test_samples_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(i, "x") for i in range(2, 9)], "doc_id long, text string")
    labels = labels_of(spark, [(i, 1, 1) for i in range(1, 9)] + [(i, 1, 0) for i in range(1000, 1100)])
    sample = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 5).collect()
    assert len(sample) == len({r.id for r in sample}) == 5  # absent documents take no seats


def test_html_is_read_in_one_pass(spark):
    began = time.time()
    for source in ('<a "' * 100_000, "<div>" * 50_000 + "x" + "</p>" * 50_000, "<" * 300_000, "</a" * 100_000, "<!--" * 100_000, "<p>" * 50_000):
        Page(source)
    assert time.time() - began < 20
    page = Page("<div>" * 2000 + "deep" + "</div>" * 2000 + "after")
    assert [(len(p), t) for p, t, _ in page.blocks] == [(DEEPEST, "deep"), (0, "after")]
    assert [b[1] for b in Page('<p>one</p><a href="x>two</a><p>three').blocks] == ["one", "two", "three"]


def test_scratch_folder_is_named_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})()

    with pytest.raises(ValueError):
        common.scratch_dir(Session())


def test_settled_tables_can_be_removed(spark):
    from pathlib import Path

    t = common.settle(spark.range(3), "removed")
    folder = Path(t._tw_path.removeprefix("file://"))
    assert folder.exists() and t.count() == 3
    common.unsettle(t, None)
    assert not folder.exists()


def test_quality_ignores_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "s", -50.0), (2, "other words here", "en", "s", 50.0)], "doc_id long, text string, lang string, source string, evidence double")
    assert [r.evidence for r in quality.classify(docs, labels_of(spark, [])).collect()] == [0.0, 0.0]
