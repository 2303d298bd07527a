"""The pipeline's stages, each against a plain version on its own input."""

from collections import defaultdict

from test_join import brute

import corpus_pipeline as pipeline
from vellum.llm import mixing


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    want = {i for i, _, c in brute(rows) if i == c}
    out = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == want and len(out) == len(want)


def test_language_stage(spark, odd):
    got = pipeline.identify_language(spark, odd, "")
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    left = sorted(str(r.doc_id) for r in got.collect())
    lettered = sorted(str(r.doc_id) for r in odd.collect() if any(c.isalpha() for c in r.text or ""))
    assert set(left) <= set(lettered) and {"1", "2", "3", "8", "11", "15"} <= set(left)


def test_duplicates_stage(spark, odd):
    got = pipeline.drop_near_duplicates(spark, odd, "")
    assert got.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    want = {i for i, _, c in brute(rows) if i == c} | {None}
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, want))


def test_mixing_stage_is_the_order(spark, odd, tmp_path):
    got = pipeline.mix_sources(spark, odd, "")
    assert got.columns == odd.columns and got.count() == odd.count()
    place = defaultdict(list)
    for r in mixing.mix(odd, mixing.WEIGHTS).collect():
        place[r.doc_id].append(r.position)
    order = [min(place[r.doc_id]) for r in got.collect()]
    assert order == sorted(order)


def test_empty_table(spark, none):
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
