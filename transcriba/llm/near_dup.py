"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its five-word shingles. Each distinct text gets TREES labels of DEPTH one-byte
MinHash values. All labels of all trees are sorted, which makes every tree a prefix trie laid out in
order: what a label shares with its neighbours is the deepest node that it shares with any other text,
and labels without company down to the shallowest depth leave at once. Texts under one node are
candidates of each other. The first round matches whole labels; each further round shortens the matched
prefix by one value and looks only at pairs whose labels part right there. After a round, the links
found so far tell the recall: a link of similarity s meets at depth d with probability
1 - (1 - s^d)^TREES, so found links stand for so many links in all. Rounds end once that recall reaches
the target, at the latest at the depth at which links at the threshold itself meet that surely.

Nodes with many texts are cut into blocks, and a cell (a pair of blocks) is one unit of work, so no task
gathers a whole node. A pair is decided once, in the first round and the first tree in which it meets:
first on its labels alone, which estimate the similarity, then exactly on the shingles. Cells give a
count of links for each text and a spanning set of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, named, partitions, release
from .words import hashed_words, mix64, shingles

K = 5
TREES = 40
DEPTH = 10
THRESHOLD = 0.8
TARGET_RECALL = 0.999
#: Texts of one block of a trie node, about.
BLOCK = 256
#: Candidates whose labels agree less than this far below the threshold are not verified: over five standard deviations.
SLACK = 0.12
#: Bins of the similarities of found links, from the threshold to 1.
BINS = 64
#: Tasks that share the edges of one node of many edges.
HUB_SALTS = 64
#: Bytes of candidate ids and digests up to which they are broadcast to find the candidates' texts.
BROADCAST_BYTES = 64 << 20
#: What stands for a null id.
NULL_ID = -(1 << 63)


def meeting(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The probability that labels of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shallowest(threshold: float, target: float) -> int:
    """The greatest depth at which even a pair at the threshold meets with the target probability."""
    for d in range(DEPTH, 0, -1):
        if meeting(threshold, d) >= target:
            return d
    raise ValueError("too few trees for this recall")


def measured_recall(found: dict[int, int], threshold: float, depth: int) -> float:
    """The share of all links that the found ones are, by what each found link stands for; 0 without links.

    found: links by bin of similarity. A bin counts as its lower end, so recall is never overstated.
    """
    whole = sum(n / meeting(threshold + (1 - threshold) * b / BINS, depth) for b, n in found.items())
    return sum(found.values()) / whole if whole else 0.0


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def labels(sets: list[np.ndarray], mul: np.ndarray, add: np.ndarray) -> list[bytes]:
    """TREES * DEPTH one-byte MinHash values of each set of shingles; an empty set has none."""
    out = []
    for s in sets:
        if not len(s):
            out.append(b"")
            continue
        low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        for a in range(0, len(x), 256):
            h = x[a : a + 256, None] * mul + add
            np.minimum(low, h.min(0), out=low)
        z = low * np.uint32(0x9E3779B1)
        out.append((z >> np.uint32(24)).astype(np.uint8).tobytes())
    return out


#: Characters that are hashed at a time: hashing takes some forty bytes for each.
HASHED_CHARS = 1_000_000


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes; a text of one to four words has one shingle, all its words. Texts are hashed block by block."""
    out, at = [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= HASHED_CHARS):
            size += len(texts[stop])
            stop += 1
        out += _block_sets(texts[at:stop])
        at = stop
    return out


def _block_sets(texts: list[str]) -> list[np.ndarray]:
    h, first = hashed_words(texts)
    s = shingles(h, K)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= K:
            out.append(np.unique(s[a : b - K + 1]))
        elif b > a:
            out.append(mix64(shingles(h[a:b], b - a)[:1] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal key, several at a time; rows come sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        cut = _runs(k)[-2]  # the last group may go on in the next batch
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def owned_pairs(cell: np.ndarray, side: np.ndarray, tree: np.ndarray, own: np.ndarray, depth: int, deepest: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are decided here, in parts of bounded size.

    Rows lie sorted by cell. A pair belongs to its cell if its sides differ, or the cell has one side;
    it is decided here if no tree joins it at a greater depth (deepest: there is none), no earlier tree
    joins it at this depth, and its labels promise the threshold.
    """
    cuts = _runs(cell)
    size = np.diff(cuts)
    if not len(size):
        return
    prefix = _prefixes(own, depth)
    longer = None if deepest else _prefixes(own, depth + 1)
    child = None if deepest else longer[np.arange(len(own)), tree]
    small = np.repeat(size <= 16, size)
    gid = np.repeat(np.arange(len(size)), size)
    two = np.repeat(np.minimum.reduceat(side, cuts[:-1]) != np.maximum.reduceat(side, cuts[:-1]), size)

    def keep(i: np.ndarray, j: np.ndarray):
        ok = ~two[i] | (side[i] != side[j])
        if not deepest:
            ok &= child[i] != child[j]
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            hit = (prefix[x] == prefix[y]).argmax(1) == tree[x]
            x, y = x[hit], y[hit]
            if not deepest:
                new = ~(longer[x] == longer[y]).any(1)
                x, y = x[new], y[new]
            agree = (own[x] == own[y]).mean(1) if len(x) else np.zeros(0)
            near = (agree - 1 / 256) / (1 - 1 / 256) >= threshold - SLACK
            if near.any():
                yield x[near], y[near]

    for step in range(1, 16):
        i = np.flatnonzero((gid[:-step] == gid[step:]) & small[:-step]) if len(gid) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        yield from keep(i, i + step)
    for g in np.flatnonzero(size > 16):
        a, b = cuts[g], cuts[g + 1]
        for lo in range(a, b, 128):
            i, j = np.meshgrid(np.arange(lo, min(lo + 128, b)), np.arange(a, b), indexing="ij")
            up = i < j
            yield from keep(i[up], j[up])


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), TREES * DEPTH)


def _sorted_tries(sketch: DataFrame, floor: int) -> DataFrame:
    """rid, tree, part, company of the labels that share a prefix of at least floor values with another text's.

    Labels are sorted over all partitions by (tree, label), an identical label by text, so a crowded
    node spreads over tasks. company is the longest prefix shared with a neighbour in that order; the
    first and last label of a partition, whose neighbour is elsewhere, count as having company.
    """
    n = partitions(sketch.sparkSession)
    parts = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("label", t * DEPTH + 1, F.lit(DEPTH)))
    every = sketch.select("rid", F.posexplode(parts).alias("tree", "part"))

    def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last label so far, whose next neighbour has not come, and what it shares with the one before
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held[0], batch])
            if not batch.num_rows:
                continue
            tree = batch.column(1).to_numpy()
            label = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, DEPTH)
            same = np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.uint8).sum(1).astype(np.int8)
            same[tree[1:] != tree[:-1]] = 0
            before = np.concatenate([[DEPTH if held is None else held[1]], same]).astype(np.int8)
            shared = np.maximum(before[:-1], same)
            keep = np.flatnonzero(shared >= floor)
            yield pa.record_batch([*batch.slice(0, batch.num_rows - 1).take(pa.array(keep)).columns, pa.array(shared[keep])], ["rid", "tree", "part", "company"])
            held = batch.slice(batch.num_rows - 1), int(before[-1])
        if held is not None:
            yield pa.record_batch([*held[0].columns, pa.array([DEPTH], pa.int8())], ["rid", "tree", "part", "company"])

    dealt = every.repartitionByRange(n, "tree", "part", "rid").sortWithinPartitions("tree", "part", "rid")
    return dealt.mapInArrow(company, "rid long, tree int, part binary, company byte")


def _cells(tries: DataFrame, depth: int, deepest: bool, block: int) -> DataFrame:
    """rid, tree, side, cell of the texts under nodes of this depth that have a pair to decide in this round."""
    at = tries.where(F.col("company") >= depth)
    nodes = at.select("rid", "tree", F.xxhash64("tree", F.substring("part", 1, depth)).alias("node"), F.substring("part", depth + 1, 1).alias("child"))
    more = F.count("*") > 1 if deepest else F.min("child") != F.max("child")
    busy = nodes.groupBy("node").agg(F.count("*").alias("count"), more.alias("more")).where("more").select("node", "count")
    under = nodes.join(busy, "node").withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int"))
    under = under.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = under.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("rid", "tree", F.col("own").alias("side"), F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))


def near_links(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, counts, edges), materialised.

    members: doc_id, rid - the row's text, named by the least id that has it. counts: rid, n_links - other
    distinct texts linked. edges: a, b - links that join all that are linked, spanning each cell.
    """
    spark = docs.sparkSession
    n, floor = partitions(spark), shallowest(threshold, target)
    mul, add = _multipliers()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 4_000_000):
                    size += len(texts[stop])
                    stop += 1
                yield pa.record_batch([batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), pa.array(labels(shingle_sets(texts[at:stop]), mul, add), pa.binary())], ["doc_id", "digest", "label"])
                at = stop

    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    signed = materialise(spark, rows.mapInArrow(sign, "doc_id long, digest binary, label binary"))
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("label").alias("label"))
    texts = materialise(spark, texts)
    # An id that stands for several texts names one of them; the others get a number of their own.
    first = texts.groupBy("least").agg(F.min("digest").alias("named"))
    given = materialise(spark, texts.join(first, "least").select("digest", F.when(F.col("digest") == F.col("named"), F.col("least")).otherwise(F.xxhash64("least", "digest")).alias("rid"), "least", "label"))
    members = materialise(spark, signed.select("doc_id", "digest").join(given.select("digest", "rid"), "digest").select("doc_id", "rid"))
    release(spark, signed, texts)
    sketch = given.where(F.length("label") > 0).select("rid", "label")
    tries = materialise(spark, _sorted_tries(sketch, floor))

    # The whole texts of all that have company, one row for each, found by id and digest.
    wanted = given.join(tries.select("rid").distinct(), "rid", "left_semi").select("rid", "least", "digest")
    few = wanted.count() * 64 <= BROADCAST_BYTES
    same = (F.col("doc_id") == F.col("least")) & (F.col("digest") == F.col("wanted"))
    wanted = wanted.withColumnRenamed("digest", "wanted")
    bodies = rows.join(F.broadcast(wanted) if few else wanted, same).select("rid", "text")
    bodies = materialise(spark, bodies)

    links, found = [], {}
    for depth in range(DEPTH, floor - 1, -1):
        cells = _cells(tries, depth, depth == DEPTH, block)
        part = _decide(cells, sketch, bodies, depth, depth == DEPTH, threshold, n)
        links.append(part)
        for b, count in part.where("b is null").groupBy("a").agg(F.sum("n")).collect():  # BINS + 1 rows at most
            found[b] = found.get(b, 0) + count
        if measured_recall(found, threshold, depth) >= target:
            break
    release(spark, tries, bodies, given)
    every = reduce(DataFrame.unionByName, links).where("b is not null")
    counts = every.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    return members, counts, every.where("a <> b").select("a", "b")


def _decide(cells: DataFrame, sketch: DataFrame, bodies: DataFrame, depth: int, deepest: bool, threshold: float, n: int) -> DataFrame:
    """a, b, n of one round: text, a text it is joined to, links it has in a cell; rows without b count links by bin of similarity."""
    spark = cells.sparkSession

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 0):
            used = np.zeros(t.num_rows, bool)
            for i, j in owned_pairs(t.column(0).to_numpy(), t.column(3).to_numpy(), t.column(2).to_numpy(), _labels(t.column(4)), depth, deepest, threshold):
                used[i] = used[j] = True
            yield from t.filter(pa.array(used)).to_batches()

    dealt = cells.join(sketch, "rid").select("cell", "rid", "tree", "side", "label").repartition(n, "cell").sortWithinPartitions("cell")
    chosen = materialise(spark, dealt.mapInArrow(pick, "cell long, rid long, tree int, side int, label binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS + 1, np.int64)
        for t in _groups(batches, 0):
            rid = t.column(1).to_numpy()
            sets = _cached_sets(rid, t.column(5).to_pylist())
            count, root = np.zeros(len(rid), np.int64), np.arange(len(rid))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = int(root[x])
                return x

            for i, j in owned_pairs(t.column(0).to_numpy(), t.column(3).to_numpy(), t.column(2).to_numpy(), _labels(t.column(4)), depth, deepest, threshold):
                sim = similarity(sets, i, j, threshold)
                ok = sim >= threshold - 1e-9
                i, j = i[ok], j[ok]
                np.add.at(count, i, 1)
                np.add.at(count, j, 1)
                np.add.at(bins, np.clip((sim[ok] - threshold) / (1 - threshold) * BINS, 0, BINS).astype(np.int64), 1)
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = top(x), top(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            hit = np.flatnonzero(count)
            tops = np.array([top(int(x)) for x in hit], np.int64)
            yield pa.record_batch([pa.array(rid[hit]), pa.array(rid[tops] if len(hit) else rid[:0]), pa.array(count[hit])], ["a", "b", "n"])
        own = np.flatnonzero(bins)
        yield pa.record_batch([pa.array(own.astype(np.int64)), pa.nulls(len(own), pa.int64()), pa.array(bins[own])], ["a", "b", "n"])

    dealt = chosen.join(bodies, "rid").select("cell", "rid", "tree", "side", "label", "text").repartition(n, "cell").sortWithinPartitions("cell")
    links = materialise(spark, dealt.mapInArrow(verify, "a long, b long, n long"))
    release(spark, chosen)
    return links


def _prefixes(own: np.ndarray, depth: int) -> np.ndarray:
    """One integer for each tree's prefix: equal exactly when the prefixes are, up to a 64-bit mix."""
    part = own.reshape(len(own), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    out = np.zeros((len(own), TREES), np.uint64)
    for d in range(depth):
        out = out * np.uint64(0xD6E8FEB86659FD93) + part[:, :, d] + np.uint64(1)
    return out


def _cached_sets(rid: np.ndarray, text: list[str]) -> list[np.ndarray]:
    """Shingle sets of rows, made once for each text."""
    _, first, back = np.unique(rid, return_index=True, return_inverse=True)
    made = shingle_sets([text[i] for i in first])
    return [made[i] for i in back]


def similarity(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Exact Jaccard similarity of pairs of sorted sets; 0 where their sizes alone rule the threshold out."""
    out = np.zeros(len(i))
    order = np.argsort(i, kind="stable")
    last, own = -1, np.zeros(0, np.uint64)
    for k in order.tolist():
        if i[k] != last:
            last, own = i[k], sets[i[k]]
        other = sets[j[k]]
        a, b = len(own), len(other)
        if min(a, b) < threshold * max(a, b) - 1e-9:
            continue
        at = np.searchsorted(own, other)
        at[at == a] = a - 1
        shared = int((own[at] == other).sum())
        out[k] = shared / (a + b - shared)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root for all ends of edges: root is the least id of the connected component.

    Rounds of large-star and small-star linking, each materialised; a component of any size is handled
    by joins and partial aggregates over its edges.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(spark, both), None
    while True:
        # Large star: a node's larger neighbours link to its least neighbour.
        sym = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(sym, F.least(F.min("v"), F.col("u"))).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        small = _with_least(large, F.min("v")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        small = materialise(spark, small.distinct())
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark, now)
        now = small
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state


def _with_least(edges: DataFrame, least: Column) -> DataFrame:
    """edges (u, v) with m, the least of each u by the aggregate of v; salts deal a hub's edges to HUB_SALTS tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int"))
    part = salted.groupBy("u", "salt").agg(F.min("v").alias("v"))
    own = part.groupBy("u").agg(least.alias("m"))
    return salted.join(part.select("u", "salt").join(own, "u"), ["u", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links of every row.

    Two distinct texts are linked when their sets of five-word shingles (lower case, cut at ASCII white
    space) have Jaccard similarity of at least the threshold. class_id is the least doc_id among the
    rows of all texts joined by links; n_links counts the distinct other texts that a row's text is
    linked to, so copies count once. Identical texts are one class whatever their length. A text of
    under five words is its only shingle; null and empty texts are equal and link to nothing else. A
    null doc_id counts as less than all others and gives a null class_id where it is the least. Where
    one id stands for different texts, class_id may be a number that is no row's id; it is still equal
    exactly for rows of one class. Other columns are ignored; repeated rows give repeated results.
    """
    members, counts, edges = near_links(docs, threshold, id_col=id_col, text_col=text_col)
    roots = components(edges)
    info = counts.join(roots, F.col("rid") == F.col("node"), "left").select("rid", "n_links", F.coalesce("root", "rid").alias("root"))
    out = members.join(info, "rid", "left")
    null = F.lit(NULL_ID)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), F.nullif(F.coalesce("root", "rid"), null).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
