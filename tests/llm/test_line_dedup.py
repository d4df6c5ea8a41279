"""The edit join of lines against all pairs; distance, keys, bounded groups, edge rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transcriba.llm import exact_dedup as ed
from transcriba.llm import line_dedup as ld
from transcriba.llm import token_store as ts
from transcriba.llm.queries import op7_line_dedup, tokenizer_path


def test_banded_distance_against_table():
    rng = random.Random(1)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "d"])
        b = "".join(b)
        for k in (1, 2, 3):
            assert ld.within(a, b, k) == (ld._plain(a, b) <= k), (a, b, k)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_keys_miss_no_pair(k):
    rng = random.Random(k)
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(8, 30)))
        b = list(a)
        for _ in range(rng.randrange(k + 1)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        if min(len(a), len(b)) > k and ld._plain(a, b) <= k:
            which, key, role = ld.line_keys([a, b], k)
            lists = [{x for x, w in zip(key.tolist(), which.tolist()) if w == i} for i in (0, 1)]
            filed = {x for x, r in zip(key.tolist(), role.tolist()) if r}
            assert a == b or lists[0] & lists[1] & filed
            bags = ld.bag([a, b])
            assert ld.bag_distance(bags[:1], bags[1:])[0] <= 2 * k


def test_bounded_groups():
    rng = random.Random(5)
    for _ in range(200):
        key = np.repeat(np.arange(12), [rng.choice([1, 2, 3, 9, 25]) for _ in range(12)])
        batches, at = [], 0
        while at < len(key):
            n = rng.randrange(1, 20)
            batches.append(pa.record_batch([pa.array(key[at : at + n])], ["key"]))
            at += n
        seen = []
        for t, whole in ld._bounded(iter(batches), 8):
            k = t.column(0).to_numpy()
            seen += k.tolist()
            for x in np.unique(k):
                assert ((key == x).sum() <= 8) == whole
                if whole:
                    assert (k == x).sum() == (key == x).sum()
        assert sorted(seen) == key.tolist()


def _brute(rows, k, per_edit=ld.PER_EDIT, least=1):
    lines = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                lines.setdefault(x, (d, i))
    names, root = list(lines), {x: x for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            limit = min(k, min(len(a), len(b)) // per_edit)
            if abs(len(a) - len(b)) <= limit and ld._plain(a, b) <= limit:
                root[top(a)] = top(b)
    first = {}
    for x, at in lines.items():
        first[top(x)] = min(first.get(top(x), at), at)
    return {d: [i for i, x in enumerate((t or "").split("\n")) if len(x) >= least and (d, i) != first[top(x)]] for d, t in rows}


@pytest.mark.parametrize("key_rows", [4096, 6])
def test_decisions_against_all_pairs(spark, monkeypatch, key_rows):
    monkeypatch.setattr(ld.line_links, "__defaults__", (ld.EDITS, ld.PER_EDIT, key_rows))
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(3, 40))) for _ in range(24)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
            lines.append("".join(x))
        rows.append((d, "\n".join(lines)))
    want = _brute(rows, ld.EDITS)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in ld.line_decisions(frame).collect()}
    assert got == want and sum(map(len, want.values())) > 30
    if key_rows == 4096:
        texts = {r.doc_id: r.text for r in ld.line_dedup(frame).collect()}
        assert texts == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]) for d, t in rows}


def test_edge_rows(docs, no_docs):
    got = ld.line_decisions(docs).collect()
    assert len(got) == 12 and all(not r.removed for r in got if r.doc_id in (3, 4, 7, 8))
    assert ld.line_decisions(no_docs).count() == 0
    assert ld.line_dedup(docs).columns == docs.columns and ld.line_dedup(docs).count() == 12


def test_clashing_and_dotted_names(spark, docs):
    rows = docs.withColumns({"removed": F.lit(7), "gone_id": F.lit(8), "_gone_id": F.lit(9)}).withColumnsRenamed({"doc_id": "a.id", "text": "a.text"})
    out = ld.line_dedup(rows, id_col="a.id", text_col="a.text")
    assert out.columns == rows.columns and out.count() == 12 and {r.removed for r in out.collect()} == {7}
    assert ed.exact_dedup(rows, "a.id", "a.text").count() == 12
    assert ts.write_tokens(rows, tokenizer_path(), 2, "a.id", "a.text").records(rows.select("`a.id`")).count() == 12


def test_near_lines_of_every_length(spark):
    """The query's own settings against all pairs, around the lengths where the limit changes."""
    rng, rows = random.Random(11), []
    for n in (0, 1, 5, 7, 8, 9, 14, 15, 16, 17, 18, 23, 24, 31):
        for copy in range(3):
            base = "".join(rng.choice("abcdefghijkl") for _ in range(n))
            for d in range(4):
                x = list(base)
                for _ in range(d):
                    at = rng.randrange(len(x) + 1)
                    x[at : at + rng.randrange(2)] = rng.choice(["", "z", "y"])
                rows.append((len(rows), "".join(x) + "\n" + base))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in ld.line_decisions(frame).collect()}
    assert got == _brute(rows, ld.EDITS)


def test_query_removes_short_lines(spark, tmp_path):
    rows = [(1, "All rights reserved.\n\nab\nAll rights reserved."), (2, "All rights reserved!\n\nab"), (3, "ab\nxy"), (4, "All rights reserved.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed for r in op7_line_dedup(spark, str(tmp_path)).collect()} == {1: "3", 2: "0,2", 3: "0", 4: "0"}
