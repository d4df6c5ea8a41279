"""Voices: average linkage of regions, a recording at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge_runs, relabel


def linkage_merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """V5: the n - 1 merges of average linkage by cosine distance: height and a row of either side, by nearest-neighbour chains.

    Rows of length one make it cheap: the mean distance of two clusters is 1 less the product of their sums over
    that of their sizes. So a cluster is its sum and its size, memory is that of the rows, and a step is one
    product of a matrix with a vector. Two clusters that are each other's nearest merge at once; average linkage never makes
    a merged cluster nearer to others than its parts were, so the merges are those of the greedy order.
    """
    n = len(x)
    total = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    size, row, merges, chain = np.ones(n), np.arange(n), [], []
    alive = np.ones(n, bool)
    left = n
    while left > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            c = chain[-1]
            far = 1 - (total @ total[c]) / (size * size[c])
            far[~alive] = np.inf
            far[c] = np.inf
            near = int(far.argmin())
            if len(chain) > 1 and far[chain[-2]] <= far[near]:  # on equal distances the one before, so a chain ends
                near = chain.pop(-2)
                chain.pop()
                break
            chain.append(near)
        merges.append((float(far[near]), int(row[near]), int(row[c])))
        total[near] += total[c]
        size[near] += size[c]
        alive[c] = False
        left -= 1
        if len(alive) > 64 and left < len(alive) // 2:  # what has merged away is not multiplied again
            place = np.cumsum(alive) - 1
            total, size, row = total[alive], size[alive], row[alive]
            chain = [int(place[i]) for i in chain]
            alive = np.ones(left, bool)
    return merges


def average_linkage(x: np.ndarray, threshold: float, k: int = 0) -> np.ndarray:
    """V5: clusters of rows by cosine distance and average linkage, to k clusters or up to a distance; numbered by their first rows."""
    n = len(x)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    done = sorted(linkage_merges(x), key=lambda m: m[0])
    for height, a, b in done[: max(0, n - max(1, min(k, n)))] if k else done:
        if k == 0 and height > threshold:
            break
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def cluster_voices(regions: DataFrame, threshold: float = 0.75, k: int = 0, min_s: float = 0.6, max_s: float = 30.0) -> DataFrame:
    """Regions (video_id, start_time, end_time, embedding) of at least min_s with a cluster.

    One video's regions are one group: a recording bounds their number. end_time is clipped to max_s
    after the start: what a voice is embedded from.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_time", "end_time"])
        out = rows[["video_id", "start_time", "end_time"]].copy()
        out["cluster"] = average_linkage(np.stack(rows["embedding"].to_list()).astype(float), threshold, k)
        return out

    kept = regions.where(F.col("end_time") - F.col("start_time") >= min_s).select("video_id", "start_time", F.least("end_time", F.col("start_time") + max_s).alias("end_time"), "embedding")
    return kept.groupBy("video_id").applyInPandas(run, "video_id long, start_time double, end_time double, cluster int")


def diarize(regions: DataFrame, threshold: float = 0.75, k: int = 0, min_s: float = 0.6) -> DataFrame:
    """Turns (video_id, start_time, end_time, speaker) of voice regions (video_id, start_time, end_time, embedding).

    Regions of min_s or more are clustered, neighbours of one voice become one turn, and voices are named by first
    appearance. Shorter regions belong to nobody and part no turn. A video without a longer one has no turns.
    """
    found = cluster_voices(regions, threshold, k, min_s, float("inf"))
    named = found.select("video_id", "start_time", "end_time", F.concat(F.lit("c"), "cluster").alias("speaker"))
    return relabel(merge_runs(named))


def scatter(rows: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """V9: i, j, within, between: the scatter matrices of labelled vectors, entry by entry (from 0), i <= j.

    Each task sums the products of its vectors as one matrix; these and the sums of the classes are added up by
    i and j, so what is shuffled is a matrix for each task, whatever the number of vectors. Null labels and vectors do not count.
    """
    kept = rows.where(F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(F.col(label).cast("string").alias("c"), F.col(embedding).cast("array<double>").alias("x"))

    def products(batches):
        total = None
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    squares = kept.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("all"))
    sums = kept.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))  # a row for each class and dimension
    a, b = sums.select("c", "i", "s", "n"), sums.select("c", F.col("i").alias("j"), F.col("s").alias("t"))
    own = a.join(b, "c").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("s") * F.col("t") / F.col("n")).alias("classes"), F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    out = squares.join(own, ["i", "j"])
    return out.select("i", "j", (F.col("all") - F.col("classes")).alias("within"), (F.col("classes") - F.col("s") * F.col("t") / F.col("n")).alias("between"))


def discriminants(matrices: DataFrame, k: int) -> np.ndarray:
    """V9: the k directions (as columns) that most part the classes against their own spread, from scatter's rows: d by d, on the driver."""
    rows = matrices.collect()  # a row for each pair of dimensions
    d = max(r.i for r in rows) + 1
    w, b = np.zeros((d, d)), np.zeros((d, d))
    for r in rows:
        w[r.i, r.j] = w[r.j, r.i] = r.within
        b[r.i, r.j] = b[r.j, r.i] = r.between
    value, vector = np.linalg.eigh(w)
    white = vector / np.sqrt(np.maximum(value, 1e-6 * max(value.max(), 1e-12)))
    share, turn = np.linalg.eigh(white.T @ b @ white)
    return white @ turn[:, np.argsort(-share)[:k]]


def projected(rows: DataFrame, directions: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """V9: rows with their vectors projected and of length one."""
    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        p = np.array(x.to_pylist(), float).reshape(len(x), -1) @ directions
        return pa.array((p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-10)).tolist(), pa.list_(pa.float64()))

    return rows.withColumn(embedding, project(F.col(embedding)))


def tune_projection(regions: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8), base: float = 0.75) -> tuple[np.ndarray | None, float, tuple[int, int], tuple[int, int]]:
    """Directions and threshold for regions (video_id, start_time, end_time, person, embedding), with errors before and after.

    The first half of each person's regions teaches, the second measures: fusions and fragmentations of the clusters of all regions,
    counted there. A projection that does not make fewer errors than the vectors as they are, at the base threshold, is not kept: None.
    """
    from .catalogue import diarization_errors, holdout

    parts = holdout(regions.where(F.col("person").isNotNull()), "person", "start_time").select("video_id", "start_time", "end_time", "person", "part")
    known = regions.join(parts.where("part = 'train'").select("video_id", "start_time", "end_time"), ["video_id", "start_time", "end_time"], "left_semi")
    tested = parts.where("part = 'test'").select("video_id", "start_time", "person")

    def errors(rows: DataFrame, at: float) -> tuple[int, int]:
        found = cluster_voices(rows, at).select("video_id", "start_time", F.concat_ws("-", "video_id", "cluster").alias("cluster"))
        r = diarization_errors(found.join(tested, ["video_id", "start_time"])).first()
        return r.fusions, r.fragmentations

    before = errors(regions, base)
    people = known.select("person").distinct().count()
    if people < 3:
        return None, base, before, before
    directions = discriminants(scatter(known, "person"), people - 1)
    turned = projected(regions, directions)
    tried = {at: errors(turned, at) for at in thresholds}  # a run for each threshold
    best = min(tried, key=lambda at: (sum(tried[at]), at))
    return (directions, best, before, tried[best]) if sum(tried[best]) < sum(before) else (None, base, before, tried[best])
