"""The near-duplicate join: planted groups against all pairs, edge rows, trie and components."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from transcriba.llm import near_dup as nd
from transcriba.llm.queries import QUERIES


def _shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(rows, threshold=0.8):
    texts = {t or "" for _, t in rows}
    sets = {t: _shingles(t) for t in texts}
    links, root = defaultdict(set), {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) >= threshold * u - 1e-9:
                links[a].add(b)
                links[b].add(a)
                root[top(a)] = top(b)
    least = {}
    for d, t in rows:
        k = top(t or "")
        least[k] = min(least.get(k, d), d)
    return {d: (least[top(t or "")], len(links[t or ""])) for d, t in rows}


def _planted(rng, groups, copies, words=120):
    vocab, rows = [f"w{i}" for i in range(900)], []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    return rows


def test_links_and_classes_against_all_pairs(spark):
    rng = random.Random(8)
    rows = _planted(rng, 40, 9) + [(5000, "Short Text"), (5001, "short text"), (5002, ""), (5003, None), (5004, "short text")]
    rows += [(6000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    want = _brute(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_recall_over_all_pairs_of_documents(spark):
    """Every link of two distinct documents at the threshold is found, and nothing else; likewise at a lower threshold."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = _brute([(r.doc_id, r.text) for r in frame.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op3_near_duplicates"](spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("block", [40, 256])
def test_large_nodes_are_cut_into_blocks(spark, block):
    rng = random.Random(9)
    rows = _planted(rng, 1, 400, 200)
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"e{i}" for w in rows[0][1].split())) for i in range(150)]
    want = _brute(rows)
    members, counts, edges = nd.near_links(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    got = {r.rid: r.n_links for r in counts.collect()}
    least = {t: i for i, t in reversed(rows)}
    total = sum(want[d][1] for d in least.values())  # a text counts once, whatever its copies
    assert all(got.get(d, 0) <= n for d, (_, n) in want.items()) and sum(got.values()) >= 0.995 * total
    assert edges.count() < 0.2 * total


def test_edge_rows(docs, no_docs):
    got = nd.near_duplicates(docs).collect()
    assert len(got) == 12 and nd.near_duplicates(no_docs).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].class_id == 1 and by[2].class_id == 1 and by[1].n_links == 1
    assert by[3].class_id == by[4].class_id and by[8].class_id == 8


def test_rounds_end_at_the_target():
    d = nd.shallowest(0.8, 0.999)
    assert nd.meeting(0.8, d) >= 0.999 > nd.meeting(0.8, d + 1)
    assert nd.measured_recall({}, 0.8, 10) == 0
    assert nd.measured_recall({nd.BINS: 5}, 0.8, 10) == 1  # equal sets meet at any depth
    near, far = nd.measured_recall({0: 100}, 0.8, 10), nd.measured_recall({0: 100}, 0.8, 9)
    assert abs(near - nd.meeting(0.8, 10)) < 1e-9 and near < far < 1


def test_prefixes_are_shortened_until_links_at_the_threshold_meet(spark, monkeypatch):
    """Rounds find what whole labels miss, each link once, and stop early where links are close."""
    depths = []
    decide = nd._decide
    monkeypatch.setattr(nd, "_decide", lambda cells, sketch, bodies, depth, *more: depths.append(depth) or decide(cells, sketch, bodies, depth, *more))
    rows = []
    for g in range(60):
        base = [f"g{g}x{i}" for i in range(104)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-30], *(f"e{g}x{i}" for i in range(30))]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    _, counts, _ = nd.near_links(frame, threshold=0.5, target=0.99)
    assert len(depths) > 2 and depths == list(range(nd.DEPTH, nd.DEPTH - len(depths), -1))
    got = [r.n_links for r in counts.collect()]
    assert set(got) == {1} and len(got) >= 0.95 * len(rows)
    depths.clear()
    near = [(i, " ".join([f"w{k}" for k in range(400)] + [f"own{i}"])) for i in range(20)]
    _, counts, _ = nd.near_links(spark.createDataFrame(near, "doc_id long, text string"), target=0.99)
    assert depths == [nd.DEPTH] and [r.n_links for r in counts.collect()] == [19] * 20


def test_sorted_tries_find_company_in_any_partition(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, (60, nd.TREES * nd.DEPTH), dtype=np.uint8)
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(label)], "rid long, label binary")
    got = {(r.rid, r.tree): r.company for r in nd._sorted_tries(frame, 1).collect()}
    for t in range(nd.TREES):
        part = label[:, t * nd.DEPTH : (t + 1) * nd.DEPTH]
        shared = np.cumprod(part[:, None] == part[None], axis=2).sum(2)
        np.fill_diagonal(shared, 0)
        want = shared.max(1)
        assert all(got.get((i, t), 0) >= want[i] for i in range(60))
        assert sum(got.get((i, t), 0) > want[i] for i in range(60)) <= 2 * 4  # the ends of four partitions


def test_labels_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    mul, add = nd._multipliers()
    x, y = (np.frombuffer(b, np.uint8) for b in nd.labels([a[:1800], a[200:]], mul, add))
    assert abs((x == y).mean() - 0.8) < 0.08


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {x: top(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in want} == want and Counter(got.values())
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0
