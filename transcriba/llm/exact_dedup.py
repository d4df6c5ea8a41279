"""Exact deduplication by Grace hashing over complete contents.

Map tasks fold the copies that they see into one record per content. Those records are dealt by a
64-bit hash of the content; each task then partitions its records recursively to spill files until a
bucket fits an open-addressing table, which compares complete contents. Only digests go back to the
rows: a hot group of copies therefore meets as one record per map task, not as its rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, partitions, text_bytes

#: Bytes of content that one table may hold before it hands over or spills.
TABLE_BYTES = 48 << 20
#: Spill files of one level.
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing: content -> [largest id, rows]."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.slots: list[int] = [-1] * slots
        self.keys: list[bytes] = []
        self.hashes: list[int] = []
        self.best: list[int | None] = []
        self.rows: list[int] = []
        self.bytes = 0

    def _seek(self, h: int, key: bytes) -> tuple[int, int]:
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.keys[i] == key:
                return at, i
            at = (at + 1) & mask
        return at, -1

    def find(self, h: int, key: bytes) -> int:
        return self._seek(h, key)[1]

    def add(self, h: int, key: bytes, best: int | None, rows: int) -> None:
        at, i = self._seek(h, key)
        if i >= 0:
            if best is not None and (self.best[i] is None or best > self.best[i]):
                self.best[i] = best
            self.rows[i] += rows
            return
        self.slots[at] = len(self.keys)
        self.keys.append(key)
        self.hashes.append(h)
        self.best.append(best)
        self.rows.append(rows)
        self.bytes += len(key) + 160
        if 2 * len(self.keys) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def grace(records: Iterator[tuple[int, bytes, int | None, int]], budget: int = TABLE_BYTES, fanout: int = FANOUT, level: int = 0) -> Iterator[OpenTable]:
    """Tables that together hold every content once.

    A table that is full keeps absorbing copies of what it holds; other contents go to spill files by
    the next bits of their hash, and each file is treated alike. After all 64 bits, what is left has
    one hash and stays in one table, which still compares contents.
    """
    table, files, folder = OpenTable(), [], ""
    shift = level * (fanout.bit_length() - 1)
    try:
        for h, key, best, rows in records:
            if table.bytes < budget or shift >= 64 or table.find(h, key) >= 0:
                table.add(h, key, best, rows)
                continue
            if not files:
                folder = tempfile.mkdtemp(prefix="grace-")
                files = [open(os.path.join(folder, str(i)), "w+b") for i in range(fanout)]  # noqa: SIM115
            pickle.dump((h, key, best, rows), files[(h >> shift) & (fanout - 1)], protocol=5)
        yield table
        del table
        for f in files:
            f.seek(0)
            yield from grace(_reread(f), budget, fanout, level + 1)
            f.close()
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _reread(f) -> Iterator[tuple[int, bytes, int | None, int]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: one record per content, as far as a table of bounded size goes."""
    table = OpenTable()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = text.lower()
            table.add(xxhash.xxh3_64_intdigest(key), key, doc, 1)
            if table.bytes >= TABLE_BYTES:
                yield from _partial(table)
                table = OpenTable()
    yield from _partial(table)


def _partial(table: OpenTable, step_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    start = size = 0
    for i, key in enumerate(table.keys):
        size += len(key)
        if size >= step_bytes or i == len(table.keys) - 1:
            part = slice(start, i + 1)
            signed = [h - (1 << 64) if h >> 63 else h for h in table.hashes[part]]
            yield pa.record_batch([pa.array(signed, pa.int64()), pa.array(table.keys[part], pa.binary()), pa.array(table.best[part], pa.int64()), pa.array(table.rows[part], pa.int64())], ["h", "content", "best", "n"])
            start, size = i + 1, 0


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            yield from zip((h & 0xFFFFFFFFFFFFFFFF for h in batch.column(0).to_pylist()), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)

    for table in grace(records()):
        multi = [i for i, n in enumerate(table.rows) if n > 1]
        yield pa.record_batch([pa.array([hashlib.sha256(table.keys[i]).digest() for i in multi], pa.binary()), pa.array([table.best[i] for i in multi], pa.int64()), pa.array([table.rows[i] for i in multi], pa.int64())], ["g_sha", "g_keep", "g_size"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([hashlib.sha256(t.lower()).digest() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "sha"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per content that two or more rows hold: g_sha, g_keep (its largest id), g_size."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_bytes(text_col))
    folded = rows.mapInArrow(_fold, "h long, content binary, best long, n long")
    dealt = folded.repartition(partitions(docs.sparkSession), "h")
    return dealt.mapInArrow(_resolve, "g_sha binary, g_keep long, g_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when identical after lower-casing A-Z alone; null counts as empty, so all null and
    empty texts are one group. The row with the largest id stays; a null id is less than any other and
    never stays unless it is alone in its group; repeated rows that share the kept id are all marked
    kept. Further columns of the input are ignored. An empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per input row.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_bytes(text_col)).mapInArrow(_digest, "doc_id long, sha binary")
    out = rows.join(exact_groups(docs, id_col, text_col), F.col("sha") == F.col("g_sha"), "left")
    # A content of one row has no group record: its row stays. With a group, its largest id decides.
    grouped = F.col("g_size").isNotNull()
    keep = F.when(grouped, F.col("g_keep")).otherwise(F.col("doc_id"))
    kept = F.when(grouped, F.coalesce(F.col("doc_id") == F.col("g_keep"), F.lit(False))).otherwise(F.lit(True))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
