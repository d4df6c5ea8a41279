"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

Every item of the benchmark has a 64-bit SimHash of its five-word shingles. Windows of a document with
as many words as an item get the same fingerprint; for items of more words than the document has, the
whole document is the window. The fingerprint is cut into four blocks of 16 bits:
two fingerprints within 19 bits differ by at most 4 bits in some block, and a table of each block lists
the items within 4 bits of every block value, so no item within the radius is missed. Candidates are
verified on the words themselves: weighted Jaccard similarity of shingles, weights being their counts.

A window that shares no shingle with an item has similarity 0 to it. So an index from shingles to items
says which items a batch of texts can hold at all; block tables are made of those alone, and one pass
over the documents serves every item. An item of under five words is one shingle, its words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialise, named
from .words import hashed_words, mix64, shingles

K = 5
BLOCK_RADIUS = 4
RADIUS = 4 * (BLOCK_RADIUS + 1) - 1
#: Items of one set of block tables, which take about 20 MB; a batch that can hold more makes several sets.
TABLE_ITEMS = 512
#: Characters of the items of one pass over the documents: the size bound of what executors are sent.
PASS_CHARS = 64 << 20


def word_list(text: str) -> list[str]:
    """Words as the hashed form sees them: lower case, cut at ASCII white space."""
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.lower().split(" ") if w]


def shingle_counts(words: list[str]) -> Counter:
    """Shingles of K words and their counts; fewer words are one shingle."""
    return Counter(zip(*(words[i:] for i in range(min(K, len(words)))), strict=False))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Sum of least weights over sum of largest weights."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    whole = sum(a.values()) + sum(b.values()) - shared
    return shared / whole if whole else 0.0


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle hash."""
    bits = np.unpackbits(mix64(h ^ np.uint64(0x5DEECE66D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def _masks() -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(16), r)], np.uint16)


class BlockTables:
    """For each 16-bit block of a fingerprint, which of some items lie within BLOCK_RADIUS of each of its values."""

    def __init__(self, prints: np.ndarray, words: np.ndarray) -> None:
        self.prints, self.words, self.blocks = prints, words, []
        masks = _masks()
        for b in range(4):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            near = (value[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            self.blocks.append((np.searchsorted(near[order], np.arange(65537)), (order // len(masks)).astype(np.int32)))

    def candidates(self, prints: np.ndarray, size: int, longer: bool = False) -> list[tuple[int, int]]:
        """(window, item) with fingerprints within RADIUS, for items of the given number of words, or of more."""
        found = []
        for b, (first, owner) in enumerate(self.blocks):
            v = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = first[v + 1] - first[v]
            window = np.repeat(np.arange(len(v)), n)
            item = owner[np.repeat(first[v] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(window))] if len(window) else np.zeros(0, np.int32)
            keep = self.words[item] > size if longer else self.words[item] == size
            window, item = window[keep], item[keep]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(np.column_stack([window[near], item[near]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return [(int(w), int(i)) for w, i in pairs]


class ItemIndex:
    """The items of one pass: shingles with the items that hold them, fingerprints, and words on demand."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, " ".join(w)) for i, t in items if (w := word_list(t or ""))]
        h, first = hashed_words([t for _, t in self.items])
        self.words = np.diff(first)
        s, prints, pairs = shingles(h), [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            if b - a < K:
                self.short.setdefault(int(b - a), {}).setdefault(int(shingles(h[a:b], int(b - a))[0]), []).append(i)
                prints.append(np.uint64(0))
                continue
            own = s[a : b - K + 1]
            prints.append(fingerprints(signs(own).sum(0, keepdims=True))[0])
            own = np.unique(own)
            pairs.append((own, np.full(len(own), i, np.int32)))
        self.prints = np.array(prints, np.uint64)
        shingle = np.concatenate([p for p, _ in pairs]) if pairs else np.zeros(0, np.uint64)
        owner = np.concatenate([o for _, o in pairs]) if pairs else np.zeros(0, np.int32)
        order = np.argsort(shingle, kind="stable")
        self.known, self.at = np.unique(shingle[order], return_index=True)
        self.owner = owner[order]
        self.at = np.append(self.at, len(order))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.tables: tuple[np.ndarray, BlockTables] | None = None

    def block_tables(self, items: np.ndarray) -> tuple[np.ndarray, BlockTables]:
        """Tables of at least the given items; the last ones made serve while they cover what is asked."""
        if self.tables is None or not np.isin(items, self.tables[0]).all():
            if self.tables is not None and len(self.tables[0]) + len(items) <= TABLE_ITEMS:
                items = np.union1d(items, self.tables[0])
            self.tables = (items, BlockTables(self.prints[items], self.words[items]))
        return self.tables

    def scan(self, texts: list[str], threshold: float) -> list[list[tuple[int, float, int]]]:
        """For each text the items it holds: (item id, similarity, first word of the best window)."""
        best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        h, first = hashed_words(texts)
        self._short_items(texts, h, first, best)
        if len(self.known):
            self._anchored(texts, h, first, threshold, best)
        return [sorted((self.items[i][0], sim, x) for i, (sim, x) in b.items()) for b in best]

    def _short_items(self, texts: list[str], h: np.ndarray, first: np.ndarray, best: list[dict]) -> None:
        """Items of under five words: the windows that equal them."""
        for n, known in self.short.items():
            s = shingles(h, n)
            for p in np.flatnonzero(np.isin(s, np.array(list(known), np.uint64))).tolist():
                d = int(np.searchsorted(first, p, side="right")) - 1
                if p + n > first[d + 1]:
                    continue
                for i in known[int(s[p])]:
                    if i not in best[d] and " ".join(word_list(texts[d])[p - int(first[d]) :][:n]) == self.items[i][1]:
                        best[d][i] = (1.0, p - int(first[d]))

    def _anchored(self, texts: list[str], h: np.ndarray, first: np.ndarray, threshold: float, best: list[dict]) -> None:
        s = shingles(h)
        at = np.flatnonzero(self.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        ok = self.known[slot] == s[at]
        at, slot = at[ok], slot[ok]
        text_of = np.searchsorted(first, at, side="right") - 1
        inside = at + K <= first[text_of + 1]
        at, slot, text_of = at[inside], slot[inside], text_of[inside]
        if not len(at):
            return
        n = self.at[slot + 1] - self.at[slot]
        item = self.owner[np.repeat(self.at[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        anchor, text_of = np.repeat(at, n), np.repeat(text_of, n)
        every = np.unique(item)
        for lo in range(0, len(every), TABLE_ITEMS):
            some = every[lo : lo + TABLE_ITEMS]
            use = np.isin(item, some)
            order = np.lexsort((anchor[use], text_of[use]))
            self._windows(texts, s, first, anchor[use][order], item[use][order], text_of[use][order], self.block_tables(some), threshold, best)

    def _windows(self, texts, s, first, anchor, item, text_of, tables, threshold, best) -> None:
        """Windows around the anchors of each text, of the sizes of the items anchored there."""
        numbers, table = tables
        for d in np.unique(text_of).tolist():
            a, b = np.searchsorted(text_of, [d, d + 1])
            lo, hi, words = int(first[d]), int(first[d + 1]), None
            places, owners = anchor[a:b], item[a:b]
            widest = int(self.words[owners].max())
            cut = np.flatnonzero(np.diff(places) > 2 * widest) + 1
            for part, of in zip(np.split(places, cut), np.split(owners, cut), strict=True):  # regions with anchors
                x, y = max(lo, int(part[0]) - widest), min(hi, int(part[-1]) + K + widest)
                total = np.zeros((y - x - K + 2, 64), np.int32)
                np.cumsum(signs(s[x : y - K + 1]), axis=0, out=total[1:])
                has = np.zeros(y - x - K + 2, np.int64)
                has[part - x + 1] = 1
                has = np.cumsum(has)
                found = []
                for size in np.unique(self.words[of]).tolist():
                    n = size - K + 1
                    if size <= y - x:
                        starts = np.flatnonzero(has[n:] > has[:-n])
                        found += [(x - lo + int(starts[w]), size, int(numbers[i])) for w, i in table.candidates(fingerprints(total[starts + n] - total[starts]), size)]
                if hi - lo < widest:  # the region is the whole text, the only window for longer items
                    found += [(0, hi - lo, int(numbers[i])) for _, i in table.candidates(fingerprints(total[-1:]), hi - lo, longer=True)]
                for start, size, i in found:
                    words = word_list(texts[d]) if words is None else words
                    sim = weighted_jaccard(shingle_counts(words[start : start + size]), shingle_counts(self.items[i][1].split(" ")))
                    if sim >= threshold and sim > best[d].get(i, (0.0, 0))[0]:
                        best[d][i] = (sim, start)


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", hits_col: str = "hits", pass_chars: int = PASS_CHARS) -> DataFrame:
    """docs, every column as it is, with hits_col array<struct<item_id, similarity, word>>.

    A hit: some window with as many words as the item, or the whole text if it has fewer, has weighted
    five-word-shingle similarity of at least the threshold to it; word is the first word of the best
    window, the earliest of equals. Items of under five words are one shingle, so a window that equals
    them is a hit; so is a text of under five words only for its equals. Null and empty items and texts
    match nothing; texts of any length are read whole; repeated rows give repeated results; an empty
    table or benchmark gives no hits. Each row is decided by its own text, whatever its id. hits_col
    must be free in docs (common.fresh gives a free name).

    Only texts go to Python and only hits come back. The benchmark is a stated query set: all its items
    serve in one pass over docs while they have at most pass_chars characters; beyond, docs is passed
    over again for each further part, so what executors are sent stays bounded.
    """
    spark = docs.sparkSession
    out, first, part, size = docs, True, [], 0

    def apply(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(items)  # plain data, of bounded size
        found = _scanner(index, uuid.uuid4().hex, threshold)(named(text_col).cast("string"))
        return rows.select(*columns(rows), found.alias(hits_col)) if first else rows.withColumn(hits_col, F.concat(F.col(hits_col), found))

    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if part and size + len(r[1]) > pass_chars:
            out, first, part, size = materialise(spark, apply(out, part)), False, [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    return apply(out, part)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id and hits of every row of docs, as with_hits finds them; other columns are ignored."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return with_hits(rows, benchmark, threshold, pass_chars=pass_chars).select("doc_id", "hits")


_HITS = "array<struct<item_id: bigint, similarity: double, word: bigint>>"


#: The index that this worker made last, under the name of its items.
_made: dict[str, ItemIndex] = {}


def _index(name: str, items: list[tuple[int, str]]) -> ItemIndex:
    if name not in _made:
        _made.clear()
        _made[name] = ItemIndex(items)
    return _made[name]


def _scanner(index, name: str, threshold: float):
    hit = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word", pa.int64())]))

    @F.arrow_udf(_HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _index(name, index.value)
        for batch in batches:
            texts, at, parts = [t or "" for t in batch.to_pylist()], 0, []
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                parts += [[{"item_id": i, "similarity": s, "word": w} for i, s, w in f] for f in own.scan(texts[at:stop], threshold)]
                at = stop
            yield pa.array(parts, hit)

    return scan
