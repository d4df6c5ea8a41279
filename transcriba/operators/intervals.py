"""Interval and run operators on transcripts: joins by overlap, filling, merging, grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import overlap

#: Width of the time buckets in which intervals of one video meet.
BUCKET_S = 300.0


def _bucketed(df: DataFrame, start: str, end: str, margin: float = 0.0) -> DataFrame:
    """Rows repeated for each time bucket that they touch: an equi-key that keeps a long video in many tasks."""
    lo, hi = F.floor((F.col(start) - margin) / BUCKET_S), F.floor((F.col(end) + margin) / BUCKET_S)
    return df.withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def overlapping(left: DataFrame, right: DataFrame, key: str = "video_id", margin: float = 0.0) -> DataFrame:
    """Pairs of intervals (start_time, end_time) and (r_start, r_end) of one video that share time, with _overlap.

    A pair appears once, in the first bucket that both touch.
    """
    a = _bucketed(left, "start_time", "end_time", margin)
    b = _bucketed(right, "r_start", "r_end")
    shared = overlap(F.col("start_time") - margin, F.col("end_time") + margin, F.col("r_start"), F.col("r_end"))
    first = F.greatest(F.floor((F.col("start_time") - margin) / BUCKET_S), F.floor(F.col("r_start") / BUCKET_S))
    return a.join(b, [key, "_bucket"]).withColumn("_overlap", shared).where((F.col("_overlap") > 0) & (F.col("_bucket") == first)).drop("_bucket")


def assign_speakers(segments: DataFrame, turns: DataFrame, id_col: str = "segment_id") -> DataFrame:
    """Each segment's speaker is that of the turn with the largest overlap, the earliest turn on ties.

    Without any overlap the previous segment's speaker holds; before the first match it is null. Videos
    without turns keep their speakers.
    """
    t = turns.select("video_id", F.col("start_time").alias("r_start"), F.col("end_time").alias("r_end"), F.col("speaker").alias("r_speaker"))
    hits = overlapping(segments.select("video_id", id_col, "start_time", "end_time"), t)
    best = hits.groupBy("video_id", id_col).agg(F.min_by("r_speaker", F.struct((-F.col("_overlap")).alias("o"), "r_start")).alias("_hit"))
    known = turns.select("video_id").distinct().withColumn("_known", F.lit(True))
    rows = segments.join(best, ["video_id", id_col], "left").join(known, "video_id", "left")
    w = Window.partitionBy("video_id").orderBy("start_time", id_col).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last("_hit", ignorenulls=True).over(w)
    return rows.withColumn("speaker", F.when(F.col("_known"), filled).otherwise(F.col("speaker"))).drop("_hit", "_known")


def dominant_speaker(windows: DataFrame, turns: DataFrame, id_col: str, margin: float = 0.0) -> DataFrame:
    """The speaker with the most summed overlap in each window, the first seen on ties, and the seconds."""
    t = turns.select("video_id", F.col("start_time").alias("r_start"), F.col("end_time").alias("r_end"), "speaker")
    hits = overlapping(windows.select("video_id", id_col, "start_time", "end_time"), t, margin=margin)
    per = hits.groupBy("video_id", id_col, "speaker").agg(F.sum("_overlap").alias("seconds"), F.min("r_start").alias("_first"))
    best = per.groupBy("video_id", id_col).agg(F.min_by(F.struct("speaker", "seconds"), F.struct((-F.col("seconds")).alias("s"), "_first")).alias("b"))
    out = windows.select("video_id", id_col).join(best, ["video_id", id_col], "left")
    return out.select("video_id", id_col, F.col("b.speaker").alias("speaker"), F.coalesce("b.seconds", F.lit(0.0)).alias("seconds"))


def first_label(regions: DataFrame, labels: DataFrame, id_col: str, margin: float = 6.0) -> DataFrame:
    """The first label in list order (label_ord) whose window, widened by margin, overlaps the region."""
    b = labels.select("video_id", (F.col("start_time") - margin).alias("r_start"), (F.col("end_time") + margin).alias("r_end"), "name", "label_ord")
    hits = overlapping(regions.select("video_id", id_col, "start_time", "end_time"), b)
    return hits.groupBy("video_id", id_col).agg(F.min_by("name", "label_ord").alias("name"))


def active_citation(utterances: DataFrame, citations: DataFrame, id_col: str, before: float = 4.0) -> DataFrame:
    """The first citation whose start lies from `before` seconds ahead of the utterance to its end."""
    a = _bucketed(utterances.select("video_id", id_col, "start_time", "end_time"), "start_time", "end_time", before)
    b = citations.select("video_id", F.col("start_time").alias("c_start"), "citation_id").withColumn("_bucket", F.floor(F.col("c_start") / BUCKET_S))
    hits = a.join(b, ["video_id", "_bucket"]).where(F.col("c_start").between(F.col("start_time") - before, F.col("end_time")))
    return hits.groupBy("video_id", id_col).agg(F.min_by("citation_id", F.struct("c_start", "citation_id")).alias("citation_id"))


def _runs(df: DataFrame, change: Column, order: list[str], key: str = "video_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(change.cast("int"))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def merge_runs(regions: DataFrame, label: str = "speaker") -> DataFrame:
    """Neighbours with one label become one region that ends with the latest of them; null labels are skipped."""
    w = Window.partitionBy("video_id").orderBy("start_time", "end_time")
    rows = _runs(regions.where(F.col(label).isNotNull()), F.lag(label).over(w) != F.col(label), ["start_time", "end_time"])
    return rows.groupBy("video_id", "run").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.first(label).alias(label)).drop("run")


def relabel(turns: DataFrame, label: str = "speaker") -> DataFrame:
    """Labels become SPEAKER_00, SPEAKER_01, ... by first start, ties by label."""
    first = turns.groupBy("video_id", label).agg(F.min("start_time").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("_first", label)) - 1
    names = first.select("video_id", label, F.format_string("SPEAKER_%02d", rank).alias("_name"))
    return turns.join(names, ["video_id", label]).withColumn(label, F.col("_name")).drop("_name")


def numbered(rows: DataFrame, order: list[str], uses: list[str], begin: Callable[[], Callable[..., int]], out: str, key: str = "video_id") -> DataFrame:
    """rows with a number that depends on all earlier rows of the key: a fold whose state is as small as one row.

    begin makes the function that is called with the values of `uses`, row by row in order, and gives the
    number. Spark sorts and spills; a task streams through its keys, holds one state, and takes time in
    proportion to its rows, so a key of any length is read once.
    """
    fields = rows.schema.fieldNames()
    at, own = [fields.index(c) for c in uses], fields.index(key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = None, None
        for batch in batches:
            got = []
            for k, *values in zip(batch.column(own).to_pylist(), *(batch.column(i).to_pylist() for i in at), strict=True):
                if step is None or k != last:
                    step, last = begin(), k
                got.append(step(*values))
            yield pa.record_batch([*batch.columns, pa.array(got, pa.int64())], [*fields, out])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kinds}, `{out}` bigint")


def utterances(segments: DataFrame, pause: float = 0.0, max_s: float = 0.0, text: str = "text", id_col: str = "segment_id") -> DataFrame:
    """Segments of one speaker in a row, cut at pauses longer than `pause` and at spans of `max_s` or more.

    Null speakers are one speaker. An utterance ends with its last segment; its text is their trimmed
    texts joined by spaces. Zero switches a limit off. With a limit on the span the cut depends on the
    previous cut, so a fold over the video decides; without, windows do.
    """
    if max_s > 0:
        def begin() -> Callable[..., int]:
            held: list = []

            def step(start: float, end: float, speaker: str | None) -> int:
                if not held:
                    held[:] = [0, start, end, speaker]
                elif speaker != held[3] or (pause > 0 and start - held[2] > pause) or held[2] - held[1] >= max_s:
                    held[:] = [held[0] + 1, start, end, speaker]
                else:
                    held[2] = end
                return held[0]

            return step

        rows = numbered(segments.select("video_id", id_col, "start_time", "end_time", "speaker", F.col(text).alias("text")), ["start_time", id_col], ["start_time", "end_time", "speaker"], begin, "run")
    else:
        w = Window.partitionBy("video_id").orderBy("start_time", id_col)
        change = ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))
        if pause > 0:
            change = change | (F.col("start_time") - F.lag("end_time").over(w) > pause)
        rows = _runs(segments.withColumn("text", F.col(text)), change, ["start_time", id_col])
    item = F.struct("start_time", F.col(id_col).alias("id"), "end_time", F.trim("text").alias("text"))
    runs = rows.groupBy("video_id", "run", "speaker").agg(F.array_sort(F.collect_list(item)).alias("items"))
    nonblank = F.filter(F.transform("items", lambda x: x["text"]), lambda x: x != "")
    return runs.select("video_id", "speaker", F.get("items", F.lit(0))["start_time"].alias("start_time"), F.element_at("items", -1)["end_time"].alias("end_time"), F.array_join(nonblank, " ").alias("text"), F.transform("items", lambda x: x["id"]).alias("segment_ids"))


def segment_chunks(segments: DataFrame, pause: float, min_s: float, max_s: float, by_speaker: bool = True, id_col: str = "segment_id") -> DataFrame:
    """W1, rules 1 to 3: video_id, segment id, chunk number. semantic_chunks has the fourth, which needs an encoder.

    After a segment the chunk is cut if it spans max_s, or if the pause to the next segment is longer
    than `pause` and it spans min_s, or if the speaker changes (two null speakers do not).
    """
    def begin() -> Callable[..., int]:
        held: list = []

        def step(start: float, end: float, speaker: str | None) -> int:
            if not held:
                held[:] = [0, start, end, speaker]
                return 0
            spans = held[2] - held[1]
            if spans >= max_s or (start - held[2] > pause and spans >= min_s) or (by_speaker and speaker != held[3]):
                held[:2] = [held[0] + 1, start]
            held[2:] = [end, speaker]
            return held[0]

        return step

    rows = numbered(segments.select("video_id", id_col, "start_time", "end_time", "speaker"), ["start_time", id_col], ["start_time", "end_time", "speaker"], begin, "chunk")
    return rows.select("video_id", id_col, F.col("chunk").cast("int").alias("chunk"))


def semantic_chunks(segments: DataFrame, encode: Callable[[list[str]], object], pause: float = K.SEGMENT_PAUSE_S, min_s: float = K.SEGMENT_MIN_S, max_s: float = K.SEGMENT_MAX_S, by_speaker: bool = True, cosine: float = K.SEGMENT_COSINE, window: int = K.SEGMENT_WINDOW, id_col: str = "segment_id") -> DataFrame:
    """W1, all four rules: video_id, segment id, chunk number.

    Rules 1 to 3 are those of segment_chunks. By the fourth, a chunk that spans min_s is cut after a
    segment if the cosine of the texts before (up to `window` segments of the chunk) and after it is
    below `cosine`. encode takes texts and gives a vector for each. Where a chunk begins only says how
    far the window before reaches, so all windows of a video are encoded in one call, whatever the cuts.
    A recording bounds a video's segments, which are one Arrow group.
    """

    def joined(part: list[str]) -> str:
        return " ".join(t for t in (p.strip() for p in part) if t)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["start_time", id_col], kind="stable")
        start, end, text = t["start_time"].to_numpy(), t["end_time"].to_numpy(), [x or "" for x in t["text"]]
        who, n = [x if isinstance(x, str) else None for x in t["speaker"]], len(t)
        before = [[joined(text[max(0, i - m) : i + 1]) for m in range(window)] for i in range(n - 1)]
        after = [joined(text[i + 1 : i + 1 + window]) for i in range(n - 1)]
        every = sorted({*after, *(x for row in before for x in row)})
        vectors = np.asarray(encode(every), float).reshape(len(every), -1) if every else np.zeros((0, 1))
        unit = dict(zip(every, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10), strict=True))
        chunk, first = np.zeros(n, np.int32), 0
        for i in range(n - 1):
            spans = end[i] - start[first]
            cut = spans >= max_s or (start[i + 1] - end[i] > pause and spans >= min_s) or (by_speaker and who[i] != who[i + 1])
            if not cut and spans >= min_s:
                cut = float(unit[before[i][min(window - 1, i - first)]] @ unit[after[i]]) < cosine
            chunk[i + 1] = chunk[i] + cut
            first = i + 1 if cut else first
        return pd.DataFrame({"video_id": t["video_id"], id_col: t[id_col], "chunk": chunk})

    kept = segments.select("video_id", id_col, "start_time", "end_time", "text", "speaker")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.groupBy("video_id").applyInPandas(run, f"video_id {kinds['video_id']}, {id_col} {kinds[id_col]}, chunk int")


def sessions(readings: DataFrame, gap: float, key: str = "video_id", t: str = "t") -> DataFrame:
    """Readings with the number of their session: a new one when the gap to the previous reading is longer."""
    w = Window.partitionBy(key).orderBy(t)
    return _runs(readings, F.col(t) - F.lag(t).over(w) > gap, [t], key).withColumnRenamed("run", "session")


def sample_frames(frames: DataFrame, every: float) -> DataFrame:
    """Greedy sampling: each kept frame sets the next target to its own time plus `every`."""
    def begin() -> Callable[..., int]:
        after: list = []

        def step(t: float) -> int:
            take = not after or t >= after[0]
            if take:
                after[:] = [t + every]
            return int(take)

        return step

    return numbered(frames.select("video_id", "t", "luma"), ["t", "luma"], ["t"], begin, "kept").where("kept = 1").drop("kept")


def content_start(frames: DataFrame, luma: float = 16.0, every: float = 1.0, until: float = 120.0) -> DataFrame:
    """The first sampled instant brighter than luma; 0 where none is."""
    kept = sample_frames(frames.where(F.col("t") <= until), every)
    found = kept.where(F.col("luma") > luma).groupBy("video_id").agg(F.min("t").alias("s"))
    return frames.select("video_id").distinct().join(found, "video_id", "left").select("video_id", F.coalesce("s", F.lit(0.0)).alias("content_start_s"))
