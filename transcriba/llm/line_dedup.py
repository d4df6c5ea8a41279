"""Line deduplication by a segment-partition edit join.

Equal lines are one line. Two distinct lines are linked by one edit for every PER_EDIT characters of the
shorter one, EDITS at most. For a limit of k edits lines are cut into k + 1 segments: if two lines are within the limit, some segment of the shorter one occurs unchanged in the longer one, at a place that the
lengths bound; so each line files its segments under (length, segment, content) and probes, for each
length that a partner may have, the few substrings that the multi-match-aware selection leaves. Lines
that meet under a key and whose character counts allow the distance are verified by a banded
bit-parallel edit distance. A key with many lines is cut into blocks, pairs of which are units of work;
a unit gives links that span what it has verified, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, named, partitions, release
from .near_dup import _groups, _runs, components
from .words import _B, _INV, _powers, mix64

EDITS = 2
#: Characters of the shorter line for each edit: 0 edits under 8 characters, 1 from 8 on, 2 from 16 on.
PER_EDIT = 8
#: Lines under one key up to which one task compares them; beyond, blocks of half as many.
KEY_ROWS = 4096
#: Bytes of ids of lines with candidates up to which they are broadcast.
BROADCAST_BYTES = 16 << 20


# -- distance ---------------------------------------------------------------------------------------


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k, by bit vectors of one band of 2k + 1 diagonals."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    m, n, width = len(a), len(b), 2 * k + 1
    if n <= k:
        return _plain(a, b) <= k
    full, low = (1 << width) - 1, 1 << (width - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    # Bit r of the vectors for row j of b is the cell of column j - k + r of a; above the table, deltas are +1.
    vp, vn, score = full & ~((1 << k) - 1), 0, k
    for j in range(n):
        shift = j - k
        eq = at.get(b[j], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + k < m:
            score += not d0 & low  # along the band's last diagonal
        else:
            bit = 1 << (m - 1 - shift)  # along the last column of a
            score += bool(hp & bit) - bool(hn & bit)
        if score > k + width:
            return False
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = hp & (d0 >> 1)
    return score <= k


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


# -- keys -------------------------------------------------------------------------------------------


def segments(length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the k + 1 segments of lines of the given lengths: the last ones take what is over."""
    parts = k + 1
    base, over = length // parts, length % parts
    size = base[:, None] + (np.arange(parts) >= parts - over[:, None])
    return np.concatenate([np.zeros((len(length), 1), np.int64), np.cumsum(size, 1)[:, :-1]], 1), size


def line_keys(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, role) rows: role 1 files a line under a key of its own segments, 0 probes, for shorter or equal partners."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in lines]
    data = np.frombuffer(b"".join(raw), "<u4").astype(np.uint64) + np.uint64(1)
    length = np.array([len(r) // 4 for r in raw], np.int64)
    base = np.concatenate([[0], np.cumsum(length)])
    run = np.concatenate([[np.uint64(0)], np.cumsum(data * _powers(_B, len(data)))]).astype(np.uint64)
    inverse = _powers(_INV, len(data) + 1)

    def key(which, start, size, partner, segment):
        a = base[which] + start
        h = (run[a + size] - run[a]) * inverse[a]
        return mix64(h * np.uint64(0x9E3779B97F4A7C15) + (partner * (k + 1) + segment).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    every = np.arange(len(lines))
    start, size = segments(length, k)
    out = [(every, key(every, start[:, s], size[:, s], length, np.full(len(lines), s)), np.ones(len(lines), np.int8)) for s in range(k + 1)]
    for delta in range(k + 1):
        partner = length - delta
        at, size = segments(partner, k)
        for s in range(k + 1):
            # Segment s (from 0) may move by s edits to its left and k - s to its right, given the length difference.
            for move in range(-k, k + 1):
                p = at[:, s] + move
                ok = (p >= 0) & (p + size[:, s] <= length) & (size[:, s] > 0)
                ok &= (abs(move) <= s) & (abs(move - delta) <= k - s)
                if delta == 0 and move == 0:
                    continue  # lines of one length meet where both file this segment
                w = every[ok]
                if len(w):
                    out.append((w, key(w, p[w], size[w, s], partner[w], np.full(len(w), s)), np.zeros(len(w), np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def limited_keys(lines: list[str], k: int, per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_keys for a limit that grows with the shorter line: a line has keys for each limit that a pair of its length may have."""
    length, out = np.array([len(t) for t in lines], np.int64), []
    for j in range(1, k + 1):
        ok = length >= per_edit * j
        if j < k:  # the longer line of a pair has up to j characters more than the longest shorter one
            ok &= length < per_edit * (j + 1) + j
        if ok.any():
            at = np.flatnonzero(ok)
            which, key, role = line_keys([lines[i] for i in at.tolist()], j)
            out.append((at[which], mix64(key + np.uint64(j)), role))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bag(lines: list[str]) -> np.ndarray:
    """Counts of characters in 16 classes, each modulo 16, in one integer: within k edits they differ by 2k at most."""
    out = np.zeros(len(lines), np.uint64)
    for i, t in enumerate(lines):
        c = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") & 15, minlength=16) & 15
        out[i] = (c.astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum()
    return out


def bag_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for i in range(16):
        s = np.uint64(4 * i)
        d = (((a >> s) & np.uint64(15)).astype(np.int64) - ((b >> s) & np.uint64(15)).astype(np.int64)) & 15
        total += np.minimum(d, 16 - d)
    return total


def key_pairs(key: np.ndarray, role: np.ndarray, side: np.ndarray, lid: np.ndarray, bags: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows under one key, at least one of them filed there, whose character counts allow k edits.

    side -1: all pairs; otherwise pairs of different sides, or all pairs where one side alone is there.
    """
    cuts = _runs(key)
    size = np.diff(cuts)
    if not len(size):
        return
    gid = np.repeat(np.arange(len(size)), size)
    two = np.repeat(np.minimum.reduceat(side, cuts[:-1]) != np.maximum.reduceat(side, cuts[:-1]), size)

    def keep(i, j):
        ok = ((role[i] | role[j]) == 1) & (lid[i] != lid[j]) & (~two[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = bag_distance(bags[i], bags[j]) <= 2 * k
        return i[ok], j[ok]

    small = np.repeat(size <= 16, size)
    for step in range(1, 16):
        i = np.flatnonzero((gid[:-step] == gid[step:]) & small[:-step]) if len(gid) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        yield keep(i, i + step)
    for g in np.flatnonzero(size > 16):
        a, b = int(cuts[g]), int(cuts[g + 1])
        for lo in range(a, b, 64):
            i, j = np.meshgrid(np.arange(lo, min(lo + 64, b)), np.arange(a, b), indexing="ij")
            up = i < j
            yield keep(i[up], j[up])


# -- the operator -----------------------------------------------------------------------------------


def _occurrences(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """doc_id, pos, line of lines long enough to be grouped."""
    line = F.split(F.coalesce(named(text_col).cast("string"), F.lit("")), "\n")
    out = docs.select(named(id_col).cast("long").alias("doc_id"), F.posexplode(line).alias("pos", "line"))
    return out.where(F.length("line") >= least)


def _names() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line", F.length("line")).alias("h2")]


def line_links(lines: DataFrame, k: int = EDITS, per_edit: int = PER_EDIT, key_rows: int = KEY_ROWS) -> DataFrame:
    """a, b: links between lid of lines (lid, line) within the limit of their lengths, spanning what each unit of work verified."""
    spark = lines.sparkSession
    n = partitions(spark)
    schema = "key long, lid long, role byte, side int, bag long"

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lid, text, at = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
            while at < len(text):
                stop, size = at, 0
                while stop < len(text) and (stop == at or size + len(text[stop]) <= 1_000_000):
                    size += len(text[stop])
                    stop += 1
                which, key, role = limited_keys(text[at:stop], k, per_edit)
                bags = bag(text[at:stop]).view(np.int64)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(lid[at:stop][which]), pa.array(role), pa.array(np.full(len(key), -1, np.int32)), pa.array(bags[which])], ["key", "lid", "role", "side", "bag"])
                at = stop

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have a partner under their key; rows of a key with too many rows pass, marked by side -2."""
        for t, whole in _bounded(batches, key_rows):
            if not whole:
                yield pa.record_batch([*(t.column(i).combine_chunks() for i in (0, 1, 2)), pa.array(np.full(t.num_rows, -2, np.int32)), t.column(4).combine_chunks()], ["key", "lid", "role", "side", "bag"])
                continue
            used = np.zeros(t.num_rows, bool)
            for i, j in key_pairs(t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(1).to_numpy(), t.column(4).to_numpy().view(np.uint64), k):
                used[i] = used[j] = True
            yield from t.filter(pa.array(used)).to_batches()

    filed = lines.mapInArrow(file, schema)
    met = materialise(spark, filed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(pick, schema))
    # Crowded keys: every pair of blocks is a cell.
    crowd = met.where("side = -2")
    blocks = crowd.groupBy("key").agg(F.ceil(F.count("*") / F.lit(key_rows // 2)).cast("int").alias("blocks"))
    split = crowd.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "lid", "role", F.col("own").alias("side"), "bag")
    split = split.repartition(n, "key").sortWithinPartitions("key").mapInArrow(pick_cells(k), schema)
    ready = materialise(spark, met.where("side = -1").unionByName(split))
    release(spark, met)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 0):
            lid, text = t.column(1).to_numpy(), t.column(5)
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            links = []
            for i, j in key_pairs(t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(), lid, t.column(4).to_numpy().view(np.uint64), k):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = top(int(lid[x])), top(int(lid[y]))
                    if a == b:
                        continue
                    p, q = text[x].as_py(), text[y].as_py()
                    if within(p, q, min(k, min(len(p), len(q)) // per_edit)):
                        root[max(a, b)] = min(a, b)
                        links.append((int(lid[x]), int(lid[y])))
            yield pa.record_batch([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    # The texts of lines that have a candidate; their ids are broadcast while they are few.
    wanted = ready.select("lid").distinct()
    few = 8 * wanted.count() <= BROADCAST_BYTES
    texts = lines.join(F.broadcast(wanted) if few else wanted, "lid", "left_semi")
    dealt = ready.join(texts, "lid").select("key", "lid", "role", "side", "bag", "line").repartition(n, "key").sortWithinPartitions("key")
    links = materialise(spark, dealt.mapInArrow(verify, "a long, b long"))
    release(spark, ready)
    return links


def pick_cells(k: int):
    """Keeps the rows of cells that have a partner there; a cell has a bounded number of rows."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 0):
            used = np.zeros(t.num_rows, bool)
            for i, j in key_pairs(t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(1).to_numpy(), t.column(4).to_numpy().view(np.uint64), k):
                used[i] = used[j] = True
            yield from t.filter(pa.array(used)).to_batches()

    return pick


def _bounded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by their first column, as (whole groups, True), or (part of a group of more than limit rows, False)."""
    held: list[pa.RecordBatch] = []  # rows of the last key met so far
    crowded = None
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        cuts = _runs(key)
        ready: list[pa.RecordBatch] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(cuts) <= 3 else [(0, int(cuts[1])), (int(cuts[1]), int(cuts[-2])), (int(cuts[-2]), int(cuts[-1]))]:
            part, first = batch.slice(a, b - a), key[a]
            one = key[a] == key[b - 1]
            if one and crowded is not None and first == crowded:
                yield pa.Table.from_batches([part]), False
                continue
            if held and held[0].column(0)[0].as_py() != first:
                ready += held
                held = []
            if one:
                held.append(part)
                if sum(h.num_rows for h in held) > limit:
                    yield pa.Table.from_batches(held), False
                    held, crowded = [], first
            else:  # a middle stretch of whole groups; crowded ones among them go their own way
                for x, y in _stretches(key[a:b], limit):
                    if y - x > limit and key[a + x] == key[a + y - 1]:
                        yield pa.Table.from_batches([part.slice(x, y - x)]), False
                    else:
                        ready.append(part.slice(x, y - x))
        if ready:
            yield pa.Table.from_batches(ready), True
    if held:
        yield pa.Table.from_batches(held), True


def _stretches(key: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of groups of at most limit rows, and larger groups alone."""
    cuts = _runs(key)
    big = np.flatnonzero(np.diff(cuts) > limit)
    at = 0
    for g in big.tolist():
        if at < cuts[g]:
            yield at, int(cuts[g])
        yield int(cuts[g]), int(cuts[g + 1])
        at = int(cuts[g + 1])
    if at < len(key):
        yield at, len(key)


def line_decisions(docs: DataFrame, k: int = EDITS, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text", equal_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, removed array<int> of every row: positions of lines that an earlier line stands for.

    Lines end at a newline. Two lines are alike if equal, or within one edit for every per_edit characters of
    the shorter one and k edits at most. Lines alike, directly or through others, are one
    class; its first occurrence by (doc_id, position) stays and all other occurrences are removed.
    Lines under equal_chars characters always stay: empty ones, unless that is 0. A null doc_id comes first. Null and empty texts have
    one empty line. Repeated rows share one fate: where a row's id and position are the first of its
    class, all rows of that id keep the line. Other columns are ignored.
    """
    spark = docs.sparkSession
    met = _occurrences(docs, id_col, text_col, equal_chars).select("doc_id", "pos", "line", *_names())
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "pos"))
    lines = met.groupBy("h1", "h2").agg(F.min("line").alias("line"), first.alias("first"), F.count("*").alias("n")).withColumn("lid", F.monotonically_increasing_id())
    # Lines too short for an edit are written if they repeat, and without their texts.
    long = F.length("line") >= per_edit
    lines = materialise(spark, lines.where(long | (F.col("n") > 1)).withColumn("line", F.when(long, F.col("line"))))
    roots = components(line_links(lines.where(F.col("line").isNotNull()).select("lid", "line"), k, per_edit))
    # Only lines with a link or a second occurrence decide anything.
    linked = lines.select("lid", "h1", "h2", "first").join(roots, F.col("lid") == F.col("node")).select("lid", "h1", "h2", "first", "root")
    heads = lines.select("lid", "h1", "h2", "first").join(roots.select(F.col("root").alias("lid")).distinct(), "lid", "left_semi").withColumn("root", F.col("lid"))
    linked = materialise(spark, linked.unionByName(heads))
    least = linked.groupBy("root").agg(F.min("first").alias("stays"))
    near = linked.join(least, "root").select("h1", "h2", "stays")
    again = lines.where("n > 1").select("lid", "h1", "h2", F.col("first").alias("stays")).join(linked.select("lid"), "lid", "left_anti").drop("lid")
    stays = near.unionByName(again)
    rows = _occurrences(docs, id_col, text_col, equal_chars).select("doc_id", "pos", *_names())
    same = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("stays.doc_id")) & (F.col("pos") == F.col("stays.pos"))
    gone = rows.join(stays, ["h1", "h2"]).where(~same).select("doc_id", "pos").distinct()
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("gone_id")).agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    count = F.size(F.split(F.coalesce(named(text_col).cast("string"), F.lit("")), "\n"))
    out = docs.select(named(id_col).cast("long").alias("doc_id"), count.alias("n_lines"))
    out = out.join(gone, F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("gone_id"), "left")
    return out.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def line_dedup(docs: DataFrame, k: int = EDITS, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text", equal_chars: int = 1) -> DataFrame:
    """docs with the removed lines cut from their texts; null texts stay null, other columns of any name as they are."""
    key, cut = fresh(docs, "gone_id"), fresh(docs, "removed")
    gone = line_decisions(docs, k, per_edit, id_col, text_col, equal_chars).where(F.size("removed") > 0)
    gone = gone.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(key), F.col("removed").alias(cut)).distinct()
    text = named(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.array_contains(F.col(cut), i), F.lit(False))), "\n")
    out = docs.join(gone, F.coalesce(named(id_col).cast("long"), F.lit(-(1 << 63))) == F.col(key), "left")
    result = F.when(F.col(cut).isNull(), text).otherwise(kept).alias(text_col)
    return out.select(*[result if c == text_col else named(c) for c in docs.columns])
