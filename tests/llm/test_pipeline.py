"""Each stage of the pipeline against brute force over its own input, then the whole."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_near_dup import _brute
from test_ops_b import _windows
from transcriba.llm.decontaminate import shingle_counts, word_list
from transcriba.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in cp.STAGES:
        rows = f(spark, docs, SF).collect()
        out.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema) if f is not cp.tokens else None
    return out


def test_quality_stage(spark, steps):
    before, after = steps[0]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    known = [r.doc_id for r in before if r.doc_id in quality]
    assert sum((d in kept) == (quality[d] == 1) for d in known) >= 0.95 * len(known)
    assert len(after[0]) == len(before[0])


def test_near_duplicate_stage(steps):
    before, after = steps[1]
    want = _brute([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {c for c, _ in want.values()}


def test_decontamination_stage(spark, steps):
    before, after = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    anchors = {g for _, t in items for g in shingle_counts(word_list(t or ""))}
    clean = [r.doc_id for r in before if not anchors & set(shingle_counts(word_list(r.text))) or not _windows(r.text, items, 0.8)]
    assert {r.doc_id for r in after} == set(clean)


def test_mixture_stage(steps):
    before, after = steps[3]
    times = Counter(r.doc_id for r in after)
    assert set(times) == {r.doc_id for r in before} and set(times.values()) <= {1, 2}


def test_token_stage(steps):
    from tokenizers import Tokenizer

    before, after = steps[4]
    tok, start = Tokenizer.from_file(tokenizer_path()), 0
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after)
    want = []
    for r in sorted(before, key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_run(spark, steps):
    assert Counter(map(tuple, cp.run(spark, SF).drop("shard").collect())) == Counter(tuple(r)[:4] for r in steps[4][1])


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """The edge rows with columns named like the stages' own ones, a contaminated null id and an id that stands for two texts."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    more = spark.createDataFrame([(None, item, "en", "a", 1, "x", "y", "z"), (5, item, "en", "a", 1, "x", "y", "z")], docs.schema)
    out = docs.unionByName(more)
    for c in ("gone", "bad", "score", "hits", "stay", "c", "class_id", "_stat_upper", "_hits", "mix_k", "label"):
        out = out.withColumn(c, F.lit(7.0))
    return out


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:4]])
def test_stages_keep_edge_rows(spark, clashing, stage):
    before = Counter(map(tuple, clashing.collect()))
    out = stage(spark, clashing, SF)
    after = Counter(map(tuple, out.collect()))
    assert out.columns == clashing.columns and set(after) <= set(before)
    gone = before - after
    if stage is cp.decontaminate:
        assert sorted((r[0] is None, sum(gone.values())) for r in gone) == [(False, 2), (True, 2)]
    if stage is cp.near_duplicate:  # 2 repeats 1, and 3, 4 are as empty as a row without an id
        assert {r[0] for r in gone} == {2, 3, 4}
    if stage is cp.mixture:
        assert not gone
    assert stage(spark, clashing.limit(0), SF).count() == 0


def test_token_stage_of_edge_rows(spark, clashing):
    assert cp.tokens(spark, clashing, SF).count() == 14 and cp.tokens(spark, clashing.limit(0), SF).count() == 0
