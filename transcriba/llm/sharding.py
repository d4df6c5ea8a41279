"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Input partition p sends exactly M[p, c] rows to cell c, where M is drawn from the multivariate
hypergeometric law that a uniform permutation of all rows would give. Tasks permute locally and deal
by their row of M; after the exchange each cell is permuted again, by Spark's sort of random keys, which
spills. A shard is a run of cells, so no task ever holds a whole shard; cells are MOST_CELLS at most, so a
task's row of M and the number of reducers do not grow with the table. A task derives its own row of M by walking a seeded binary splitting
tree over the partitions: no matrix is kept anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import named, partitions

#: Rows of one cell at most, and bytes of its texts on average at most: what one task permutes at a time.
CELL_ROWS = 1 << 16
CELL_BYTES = 16 << 20
#: Cells at most, whatever the table holds: a task's row of the matrix and the number of reducers stop growing there.
MOST_CELLS = 1 << 14


def cell_sizes(rows: int, shards: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of each cell: shards differ by one row at most, cells of a shard too."""
    shard, first, size = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        k = max(1, -(-n // cell_rows))
        at = 0
        for c in range(k):
            m = n // k + (c < n % k)
            shard.append(s)
            first.append(at)
            size.append(m)
            at += m
    return np.array(shard, np.int32), np.array(first, np.int64), np.array(size, np.int64)


def matrix_row(counts: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix: how many rows partition p sends to each cell.

    Each node of the splitting tree draws how the capacity left to its partitions is divided between
    its halves. The draw's seed is the node, so every task sees the same tree.
    """
    lo, hi, left, before = 0, len(counts), cells.copy(), np.concatenate([[0], np.cumsum(counts)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        take = int(before[mid] - before[lo])
        part = rng.multivariate_hypergeometric(left, take, method="marginals") if 0 < take < left.sum() else (left.copy() if take else np.zeros_like(left))
        if p < mid:
            hi, left = mid, part
        else:
            lo, left = mid, left - part
    return left


def row_bytes(docs: DataFrame) -> Column:
    """About the bytes of a row: those of its strings and binaries, and 16 of each other column."""
    total = F.lit(0).cast("long")
    for f in docs.schema.fields:
        known = isinstance(f.dataType, (StringType, BinaryType))
        total = total + (F.coalesce(F.octet_length(named(f.name)), F.lit(0)) if known else F.lit(16))
    return total


def uniform_shards(docs: DataFrame, shards: int, seed: int = 1, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES, most_cells: int = MOST_CELLS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """docs with shard and slot: a uniform random permutation of all rows, cut into shards.

    Shard sizes differ by one row at most; slots of a shard run from 0 without a gap. Rows are counted,
    not compared, so nulls, repeated rows and extra columns of any name travel as they are; an input column
    already named shard_col or slot_col gives way, so name others to keep it. Texts of any length travel
    whole; a cell's rows are fewer where rows are long. An empty table gives an empty result. The input must list the same rows in each partition when it is read twice (any scan
    does); a task that finds another number of rows than was counted raises an error.
    """
    spark = docs.sparkSession
    taken = {shard_col.lower(), slot_col.lower()}
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() not in taken])
    counted = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(row_bytes(docs)).alias("bytes")).collect()  # a row for each partition
    found, held = {r.p: r.n for r in counted}, sum(r.bytes for r in counted)
    total = sum(found.values())
    if held:  # cells take a random choice of rows, so their bytes are near the mean
        cell_rows = max(1, min(cell_rows, cell_bytes * total // held))
    # Cells stay few: beyond, they grow, and Spark's sort of a cell spills.
    cell_rows = max(cell_rows, -(-total // max(1, most_cells - shards)))
    width = max(found, default=0) + 1
    counts = np.array([found.get(i, 0) for i in range(width)], np.int64)
    shard_of, first_of, sizes = cell_sizes(total, shards, cell_rows)
    names = [f"c{i}" for i in range(len(docs.columns))]  # names that mean nothing, so any name may be an input's

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        n = int(counts[p]) if p < width else 0
        if n:
            row = matrix_row(counts, sizes, p, seed)
            rng = np.random.Generator(np.random.PCG64([seed, p, 1 << 40]))
            target = np.repeat(np.arange(len(row), dtype=np.int32), row)
            rng.shuffle(target)  # the local permutation: which row goes to which of the cells' places
        at = 0
        for batch in batches:
            m = batch.num_rows
            if at + m > n:
                raise RuntimeError(f"partition {p} has more than the {n} rows counted")
            cell = target[at : at + m]
            key = rng.integers(-(1 << 63), (1 << 63) - 1, m, dtype=np.int64, endpoint=True)
            at += m
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(shard_of[cell]), pa.array(first_of[cell]), pa.array(key)], [*names, "cell", "shard", "first", "key"])
        if at != n:
            raise RuntimeError(f"partition {p} has {at} rows; {n} were counted")

    own = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, docs.schema.fields, strict=True))
    dealt = docs.toDF(*names).mapInArrow(deal, f"{own}cell int, shard int, first long, key long")
    dealt = dealt.repartition(max(partitions(spark), len(sizes)), "cell")
    slot = F.col("first") + F.row_number().over(Window.partitionBy("cell").orderBy("key")) - 1
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return dealt.select(*back, F.col("shard").alias(shard_col), slot.alias(slot_col))
