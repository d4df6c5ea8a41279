"""Licences, quality, decontamination, mixing: edge rows and brute-force counterparts."""

import hashlib
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriba.llm import decontaminate as dc
from transcriba.llm import licenses as li
from transcriba.llm import mixing as mx
from transcriba.llm import quality as qu
from transcriba.llm.queries import QUERIES


def test_license_scan(spark, docs, no_docs):
    mit = dict(li.known_texts())["MIT"].upper().replace("SUBLICENSE", "sub-licence").replace("<YEAR>", "1999")
    rows = [(1, mit), (2, "Intro.\nReleased under the MIT Licence!\nrest\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "the mit license is nice"), (2, "© 2020 me\n"), (None, "SPDX-License-Identifier: ISC")]
    got = {(r.doc_id, r.license, r.n_notices, r.notices) for r in li.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", 1, "MIT"), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (2, None, 0, ""), (None, "ISC", 1, "ISC")}
    out = li.license_scan(docs).collect()
    assert len(out) == 12 and {r.text_digest for r in out if r.doc_id in (3, 4)} == {hashlib.sha256(b"").hexdigest()}
    assert li.license_scan(no_docs).count() == 0


def test_whole_license_texts_in_many_guises(spark):
    """Every known text in another wrapping, case, punctuation, with other owners, and without its title."""
    rows, want = [], {}
    for k, (spdx, text) in enumerate(li.known_texts()):
        owner = "Copyright (C) 2001-2009 Some Body, Inc.\n(c) 2010 Else\nAll rights reserved.\n"
        wrapped = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        for g, guise in enumerate((text, owner + text.upper(), wrapped if "opyright" not in text[:200] else text, text.replace(",", " ;").replace('"', "'"), text.replace("license", "licence").replace("License", "Licence"))):
            rows.append((10 * k + g, guise))
            want[10 * k + g] = spdx
        rows.append((10 * k + 9, text.replace("software", "hardware").replace("Software", "Hardware").replace("work", "toil").replace("SOFTWARE", "HARDWARE") + " and more"))
        want[10 * k + 9] = None
    got = {r.doc_id: r.license for r in li.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    bsd = dict(li.known_texts())["BSD-3-Clause"].partition("\n\n")[2]
    isc = "Copyright 2020 Me\n\n" + "\n".join(textwrap.wrap(dict(li.known_texts())["ISC"].split("\n\n", 2)[2], 68)).replace("provided that the above\ncopyright", "provided that the above\n copyright")
    gpl = dict(li.known_texts())["GPL-3.0"]
    gpl = gpl[: gpl.index("END OF TERMS")]
    out = li.license_scan(spark.createDataFrame([(1, bsd), (2, isc), (3, gpl)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in out} == {1: "BSD-3-Clause", 2: "ISC", 3: "GPL-3.0"}


def test_license_plan_is_native(docs):
    plan = li.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("BroadcastHashJoin") == 2
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def _labelled(spark, n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_learns_and_compiles(spark, docs, no_docs):
    data = _labelled(spark)
    model = qu.train_quality(data.drop("quality"), data.select("doc_id", "quality", F.lit(0).alias("toxic")))
    out = qu.quality_scores(data, model).withColumn("h", qu.held_out(F.col("doc_id"))).toPandas()
    held = out[out.h]
    assert 0.2 < len(held) / len(out) < 0.5 and ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.97
    stats = data.select(*[c.cast("double").alias(k) for k, c in qu.statistics(F.col("text")).items()]).toPandas().to_numpy()
    assert np.allclose(model.predict(stats), out.score)
    edge = qu.quality_scores(docs, model).collect()
    assert len(edge) == 12 and all(0 <= r.score <= 1 for r in edge)
    assert qu.quality_scores(no_docs, model).count() == 0


def test_quality_ignores_held_out_labels(spark):
    data = _labelled(spark)
    labels = data.select("doc_id", "quality")
    other = labels.withColumn("quality", F.when(qu.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert qu.train_quality(data, labels) == qu.train_quality(data, other)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 0), (2, None), (3, 7)]])
def test_quality_without_labels(spark, docs, labels):
    model = qu.train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(0 < r.score < 1 for r in qu.quality_scores(docs, model).collect())


def _windows(text, items, threshold):
    words, out = dc.word_list(text or ""), {}
    for i, t in items:
        w = dc.word_list(t or "")
        if w:
            spans = [words[x : x + len(w)] for x in range(len(words) - len(w) + 1)] or ([words] if len(words) >= dc.K else [])
            sims = [dc.weighted_jaccard(dc.shingle_counts(v), dc.shingle_counts(w)) for v in spans]
            if sims and max(sims) >= threshold:
                out[i] = max(sims)
    return out


def test_decontamination_against_all_windows(spark, docs, no_docs):
    rng = random.Random(4)
    word = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(word) for _ in range(rng.randrange(30, 60)))) for i in range(30)] + [(97, None), (98, ""), (99, "a b c"), (100, "w1 W2"), (101, "a b c")]
    rows = [(900, "x a B c y"), (901, "a b"), (902, "a b c"), (903, "a bc"), (904, "w1 w2 w3 w4")]
    for d in range(150):
        body = [rng.choice(word) for _ in range(rng.randrange(0, 200))]
        if d % 2:
            it = items[rng.randrange(30)][1].split(" ")
            for _ in range(rng.randrange(2)):
                it[rng.randrange(len(it))] = "edited"
            at = rng.randrange(len(body) + 1)
            body[at:at] = it
        rows.append((d, " \n"[d % 2].join(body).title()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: _windows(t, items, 0.8) for d, t in rows}
    assert sum(map(bool, want.values())) > 25
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (dc.PASS_CHARS, 5000):
        got = {r.doc_id: {h.item_id: h.similarity for h in r.hits} for r in dc.contamination(frame, bench, pass_chars=chars).collect()}
        assert got == want
    assert len(dc.contamination(docs, bench).collect()) == 12
    assert dc.contamination(no_docs, bench).count() == 0
    assert all(not r.hits for r in dc.contamination(docs, bench.limit(0)).collect())


def test_texts_shorter_than_an_item(spark):
    item = [f"w{i}" for i in range(59)]
    cut = {1: item[:58], 2: item[2:], 3: item[:47], 4: item[:30], 5: item[1:58], 6: item[:4]}
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[::-1]))], "item_id long, text string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in cut.items()], "doc_id long, text string")
    got = {r.doc_id: [(h.item_id, h.similarity, h.word) for h in r.hits] for r in dc.contamination(frame, bench).collect()}
    assert got == {1: [(1, 54 / 55, 0)], 2: [(1, 53 / 55, 0)], 3: [], 4: [], 5: [(1, 53 / 55, 0)], 6: []}


def test_many_items_make_several_tables(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(20))) for i in range(120)]
    monkeypatch.setattr(dc, "TABLE_ITEMS", 16)
    index = dc.ItemIndex(items)
    texts = [" ".join([f"q{d}"] * 9 + items[d % 120][1].split() + [f"r{d}"] * 3 + items[(d * 7) % 120][1].split()) for d in range(60)]
    assert [{i: s for i, s, _ in f} for f in index.scan(texts, 0.8)] == [_windows(t, items, 0.8) for t in texts]


def test_hits_leave_all_columns_and_decide_by_row(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(None, item, 1), (None, "clean words that are not in any item", 2), (5, item, 3), (5, "other clean words here now", 4), (None, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumn("hits", F.lit("own")).withColumn("bad", F.lit(1))
    out = dc.with_hits(frame, spark.createDataFrame([(1, item)], "item_id long, text string"), hits_col="_hits").collect()
    assert [(r["a.b"], r.hits, r.bad) for r in out if not r._hits] == [(2, "own", 1), (4, "own", 1), (5, "own", 1)] and len(out) == 5


def test_block_tables_find_all_within_radius():
    rng = np.random.default_rng(1)
    items = dc.ItemIndex([(i, " ".join(f"x{v}" for v in rng.integers(0, 99, 20))) for i in range(40)])
    index = items.block_tables(np.arange(40))[1]
    probes = index.prints[rng.integers(0, 40, 300)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 26), False)) for _ in range(300)], np.uint64)
    want = {(w, i) for w in range(300) for i in range(40) if bin(int(probes[w] ^ index.prints[i])).count("1") <= dc.RADIUS}
    assert set(index.candidates(probes, 20)) == want


def test_mixing_solves_limits(spark):
    tokens = {"a": 9000, "b": 1000, "c": 500, "d": 0, None: 700}
    totals = spark.createDataFrame(list(tokens.items()), "s string, n long")
    for limit in (1.2, 2.0, 3.5):
        e, most = mx.exponent(totals, limit, None)
        r = mx.repetitions(tokens, e)
        assert abs(max(r.values()) - limit) < 1e-6 and min(r.values()) == 1.0 and most == 9000
        w = mx.temperature_weights(tokens, e)  # passes times tokens are the weights
        assert all(abs(r[s] * n / sum(r[s] * n for s, n in tokens.items()) - w[s]) < 1e-9 for s, n in tokens.items())
    for want in (0.9, 1.2):
        e, _ = mx.exponent(totals, None, want)
        assert abs(mx.entropy(mx.temperature_weights(tokens, e)) - want) < 1e-6
    assert mx.exponent(totals.limit(0), 2.0, None) == (1.0, 0) and mx.exponent(totals.where("n = 0"), 2.0, None) == (1.0, 0)
    assert mx.exponent(totals, None, 9.0)[0] < 1e-6 and mx.exponent(totals, None, 0.0)[0] > 1 - 1e-6


def _mixed(rows, limit, block_tokens, key, block_key):
    """Passes of each row by brute force: whole passes, then blocks in permuted order until the budget ends."""
    total = Counter()
    for _, t, s in rows:
        total[s] += len((t or "").split())
    e, out = mx.bisect(lambda e: (max(total.values()) / min(n for n in total.values() if n)) ** (1 - e), limit, False), Counter()
    for s, n in total.items():
        r = mx.repetitions(dict(total), e)[s]
        full, blocks = int(r + 1e-9), max(1, -(-n // block_tokens))
        mine = sorted(((block_key[s, key[d] % blocks], key[d], d, len((t or "").split())) for d, t, q in rows if q == s))
        left = (r - full) * n if (r - full) * n >= 1 else -1
        for _, _, d, size in mine:
            left -= size
            out[d] = 1 if not size else full + (left >= 0)
    return out


def test_registered_mixture_against_brute_force(spark):
    """Every row's number of passes, as blocks and keys order them."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in frame.collect()]
    key = {r[0]: r[1] for r in frame.select("doc_id", mx._row_key("doc_id", 11)).collect()}
    pairs = spark.createDataFrame([(s, b) for s in {r[2] for r in rows} for b in range(8)], "s string, b long")
    block_key = {(r[0], r[1]): r[2] for r in pairs.select("s", "b", mx._block_key(F.col("s"), F.col("b"), 11)).collect()}
    for got, tokens in ((QUERIES["op9_mix_sources"](spark, "/root/testdata/sf0.001"), mx.BLOCK_TOKENS), (mx.mix_sources(frame, block_tokens=9000), 9000)):
        assert Counter(r.doc_id for r in got.collect()) == _mixed(rows, 1.5, tokens, key, block_key)


def test_mixing_realises_weights(spark, docs, no_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 9)), rng.choice(["hot"] * 8 + ["s1", "s2", None])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    want = mx.repetitions(dict(total), mx.bisect(lambda e: (max(total.values()) / min(total.values())) ** (1 - e), 2.3, False))
    out = mx.mix_sources(frame, 2.3, block_tokens=500).collect()
    got, passes = Counter(), defaultdict(set)
    for r in out:
        got[r.source] += len(r.text.split())
        passes[r.doc_id].add(r.mix_pass)
    for s, n in total.items():  # within one row of the budget, never beyond it
        assert 0 <= want[s] * n - got[s] < 10
    assert all(p == set(range(1, len(p) + 1)) for p in passes.values()) and len(passes) == 4000
    assert Counter(len(passes[i]) for i, _, s in rows if s == "hot") == {1: sum(s == "hot" for _, _, s in rows)}
    edge = mx.mix_sources(docs).collect()
    assert {r.doc_id for r in edge} == {r.doc_id for r in docs.collect()} and edge[0].__fields__[:8] == docs.columns
    assert mx.mix_sources(no_docs).count() == 0


def test_registered_quality_query(spark):
    """held_out by Python's crc32, predicted by the score, and most held-out labels right."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) > 50


def test_quality_of_clashing_columns_and_ties(spark, docs):
    data = _labelled(spark, 90)
    model = qu.train_quality(data, data.select("doc_id", "quality"))
    odd = docs.withColumn("score", F.lit("own")).withColumn("_stat_upper", F.lit(1)).withColumn("a.b", F.lit(2))
    out = qu.quality_scores(odd, model, score_col="_score")
    assert out.columns == [*odd.columns, "_score"] and {r.score for r in out.collect()} == {"own"}
    assert qu.quality_scores(odd, model).columns == [*[c for c in odd.columns if c != "score"], "score"]
    assert len({r._score for r in out.where("doc_id = 8").collect()}) == 1


def test_registered_decontamination_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    anchors = {g for _, t in items for g in dc.shingle_counts(dc.word_list(t or ""))}
    got = {r.doc_id: r for r in QUERIES["op5_decontaminate"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = _windows(r.text, items, 0.8) if anchors & set(dc.shingle_counts(dc.word_list(r.text or ""))) else {}
        x = got[r.doc_id]
        assert (x.contaminated, sorted(x.item_ids), x.similarity) == (bool(want), sorted(want), max(want.values(), default=0.0))
