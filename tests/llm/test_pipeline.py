"""The pipeline stage by stage against brute force, and over rows with nulls, repeats and clashing columns."""

from collections import defaultdict

import corpus_pipeline
from incidentry.llm.crf_language import train_on
from incidentry.llm.mixing import mix_plan
from incidentry.session import scratch_path
from test_first_ops import brute_components, edge_rows, fold, plain_fingerprint

SF = "/root/testdata/sf0.001"


def reread(spark, df):
    path = scratch_path(spark, "test-pipeline")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    kept = reread(spark, stages["language_id"](spark, docs, SF))
    lettered = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in kept.collect()} <= lettered and kept.count() > 0.98 * len(lettered)

    exact = reread(spark, stages["exact_dedup"](spark, kept, SF))
    top = defaultdict(int)
    for r in kept.collect():
        top[fold(r.text)] = max(top[fold(r.text)], r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(top.values())

    near = reread(spark, stages["simhash_near_dedup"](spark, exact, SF))
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in exact.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(brute_components(prints)))

    mixed = reread(spark, stages["mixing"](spark, near, SF))
    copies = {r.doc_id: r.copies for r in mix_plan(near).collect()}
    counted = defaultdict(int)
    for r in mixed.collect():
        counted[r.doc_id] += 1
    assert counted == {k: v for k, v in copies.items() if v}
    assert all(x.columns == docs.columns for x in (kept, exact, near, mixed))

    packed = stages["packing"](spark, mixed, SF).toPandas()
    whole = mixed.select("doc_id").toPandas().doc_id.value_counts()
    sizes = packed.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (sizes.n == sizes.t * whole.loc[sizes.index]).all() and set(sizes.index) == set(whole.index)


def test_edges_go_through_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _row_pos int, rate string"
    for rows in (edge_rows(), []):
        docs = reread(spark, spark.createDataFrame(rows, schema).repartition(3))
        for name, stage in corpus_pipeline.STAGES:
            out = reread(spark, stage(spark, docs, SF))
            assert name == "packing" or out.columns == docs.columns
            assert rows or out.count() == 0
            docs = out


def test_language_stage_without_labels_keeps_lettered_documents(spark):
    texts = ["one two three", "ÉÉ", "привет", "a" * 25_000, None, "", "12 -- 34", "_ _"]
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    for lang, rows in ((None, texts), ("en", ["word " * 5_000, "12 " * 9_000])):  # no labels; too long to learn from
        docs = spark.createDataFrame([(i, t, lang, "s") for i, t in enumerate(rows)],
                                     "doc_id long, text string, lang string, source string")
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == ([0, 1, 2, 3] if lang is None else [0])


def test_run(spark):
    from incidentry.llm.queries import QUERIES
    assert "pipeline" not in QUERIES
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert train_on(spark.read.parquet(f"{SF}/documents.parquet")).languages == ["de", "en", "es", "fr"]
