"""Labels on screen: readings of frames to stable labels, variants of names to one, names to voices."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import constants as K
from ..functions import text as T
from ..functions.numbers import clock
from ..sources.tables import materialise
from .intervals import dominant_speaker, sessions
from .readings import read_lines

#: Characters of the texts of one cell, on each side: a scope with more is dealt into blocks that meet pair by pair.
BLOCK_CHARS = 1 << 18


def _first_containers(texts: list[str], sides: list[int]) -> Iterator[tuple[int, int]]:
    """Positions of the texts asked for (side 0 or 1) and of the first of those looked in (side 0 or 2) that contains each.

    All that are looked in become one string in their order, so the first place where a text is found lies in its container.
    """
    within = [i for i, s in enumerate(sides) if s != 1]
    ends = list(accumulate(len(texts[i]) + 1 for i in within))
    blob = "\n".join(texts[i] for i in within)
    for i, s in enumerate(sides):
        at = blob.find(texts[i]) if s != 2 else -1
        while at >= 0:
            j = bisect_right(ends, at)
            if at + len(texts[i]) < ends[j]:
                yield i, within[j]
                break
            at = blob.find(texts[i], at + 1)  # across two texts: only where a text holds a line feed


def containment(texts: DataFrame, key: str, seat: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, key, head, seat: for each distinct key of a scope the first of the longest texts that contain it, itself if none does.

    Of equal lengths the lower seat is first; seat in the result is the head's. What contains a text's container contains
    the text, so the longest container is contained in nothing. The texts of a scope meet in one cell, sorted by Spark; a
    scope of more than BLOCK_CHARS characters is dealt into blocks by a hash of the text, each pair of blocks is a cell of its
    own, and the first container of all cells counts. So no task holds more than a cell. Blank and null keys give no row.
    """
    rows = texts.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(*scope, F.col(key).alias("k")).agg(F.min(seat).alias("seat"))
    rows = rows.withColumn("_scope", F.xxhash64(F.lit(0), *scope))
    large = rows.groupBy("_scope").agg(F.sum(F.length("k")).alias("chars")).where(F.col("chars") > BLOCK_CHARS)
    blocks = F.coalesce(F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1)).cast("int")
    dealt = rows.join(large, "_scope", "left").withColumn("n", blocks).withColumn("b", F.pmod(F.xxhash64("k"), "n").cast("int"))
    other = F.sequence(F.lit(0), F.col("n") - 1)
    asks = F.transform(other, lambda j: F.struct(F.col("b").alias("i"), j.alias("j"), F.when(j == F.col("b"), 0).otherwise(1).alias("side")))
    holds = F.transform(F.filter(other, lambda i: i != F.col("b")), lambda i: F.struct(i.alias("i"), F.col("b").alias("j"), F.lit(2).alias("side")))
    cells = dealt.select("_scope", *scope, "k", "seat", F.explode(F.concat(asks, holds)).alias("c")).select("_scope", *scope, "k", "seat", "c.*")
    cells = cells.repartition("_scope", "i", "j").sortWithinPartitions("_scope", "i", "j", *scope, -F.length("k"), "seat", "k")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([StructField(c, kinds[c]) for c in (*scope, "k")] + [StructField("head", kinds["k"]), StructField("seat", kinds["seat"])])

    def solved(t: pa.Table, runs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        words, sides, found = t.column("k").to_pylist(), t.column("side").to_pylist(), []
        for a, b in runs:
            found += [(a + i, a + j) for i, j in _first_containers(words[a:b], sides[a:b])]
        own, head = (pa.array([p[x] for p in found], pa.int64()) for x in (0, 1))
        got = [t.column(c).take(own) for c in (*scope, "k")] + [t.column(c).take(head) for c in ("k", "seat")]
        yield from pa.table(got, names=out.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last cell so far, which may go on
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            at = list(zip(*(t.column(c).to_pylist() for c in (*scope, "i", "j")), strict=True))
            starts = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1]]
            yield from solved(t, list(pairwise(starts)))
            held = t.slice(starts[-1]) if starts else None
        if held is not None:
            yield from solved(held, [(0, held.num_rows)])

    met = cells.mapInArrow(run, out)
    first = F.min(F.struct((-F.length("head")).alias("n"), "seat", "head")).alias("best")
    return met.groupBy(*scope, F.col("k").alias(key)).agg(first).select(*scope, key, F.col("best.head").alias("head"), F.col("best.seat").alias("seat"))


def _in_order(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """Rows of one key in one task, in order: sums of fractions that follow have the same last digits however rows arrive."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def label_families(readings: DataFrame) -> DataFrame:
    """Variants of on-screen lines within a session: video_id, session, text, sightings, confidence, y, place.

    readings: video_id, session, t, text, conf, y. A folded text joins the first longest one that contains it; families seen fewer than
    two times go; a family's text is its longest, as first read, without short edge words, dropped under three letters.
    sightings and confidence are those of all its readings, y is the least; place orders equal y.
    """
    scope = ("video_id", "session")
    rows = readings.withColumn("norm", T.normalize_ocr(F.col("text")))  # blank ones have no family
    seen = F.struct("t", "y", "text")
    texts = materialise(_in_order(rows, (*scope, "norm"), "t", "y", "text", "conf").groupBy(*scope, "norm").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.min("y").alias("y"), F.min(seen).alias("seat")))
    own = texts.withColumnRenamed("seat", "seen").join(containment(texts, "norm", "seat", scope), [*scope, "norm"])
    per = _in_order(own, (*scope, "head"), "seen").groupBy(*scope, "head", "seat").agg(F.sum("n").alias("sightings"), F.sum("conf").alias("conf"), F.min("y").alias("y"))
    out = per.select(*scope, T.strip_edges(F.col("seat.text")).alias("text"), "sightings", (F.col("conf") / F.col("sightings")).alias("confidence"), "y", F.struct((-F.length("head")).alias("n"), "seat").alias("place"))
    return out.where((F.col("sightings") >= K.LABEL_SIGHTINGS) & (F.length("text") >= 3))


def stable_labels(readings: DataFrame, gap: float = K.LABEL_GAP_S) -> DataFrame:
    """Labels of readings (video_id, t, text, conf, y): video_id, label_ord, start_time, end_time, lines, confidence, sightings.

    Readings at most gap seconds apart are one label, from the first to the last of them; its lines are the
    families seen, from the top down, confidence their mean, sightings their most. A label without a line gives no row.
    """
    rows = materialise(sessions(readings, gap))
    span = rows.groupBy("video_id", "session").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"))
    lines = F.array_sort(F.collect_list(F.struct("y", "place", "text")))
    at = ("video_id", "session")
    per = _in_order(label_families(rows), at, "y", "place").groupBy(*at).agg(lines.alias("lines"), F.avg("confidence").alias("confidence"), F.max("sightings").alias("sightings"))
    out = span.join(per, ["video_id", "session"])
    return out.select("video_id", F.col("session").alias("label_ord"), "start_time", "end_time", F.transform("lines", lambda x: x["text"]).alias("lines"), "confidence", "sightings")


def detect_labels(words: DataFrame, gap: float = K.LABEL_GAP_S) -> DataFrame:
    """Q9: stable labels of the words read from frames (video_id, t, block, line, ord, text, conf, top)."""
    return stable_labels(read_lines(words), gap)


def canonical_names(names: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Scope, name, canonical of each distinct name: the longest name whose key contains this one's.

    Of names with one key the longest counts, as the one with its spaces, then the first. A name without a key has no row.
    """
    keyed = materialise(names.select(*scope, "name").distinct().withColumn("key", T.name_key(F.col("name")))).where("key <> ''")
    seat = F.struct((-F.length("name")).alias("n"), "name")
    best = keyed.groupBy(*scope, "key").agg(F.min(seat).alias("seat"))
    named = containment(best, "key", "seat", scope).select(*scope, "key", F.col("seat.name").alias("canonical"))
    return keyed.join(named, [*scope, "key"]).select(*scope, "name", "canonical")


def identities(turns: DataFrame, labels: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """Each voice with the name that labels or speech give it, its confidence and the evidence in order.

    turns: video_id, speaker, start_time, end_time. labels: video_id, label_ord, start_time, end_time, lines,
    confidence, sightings, as stable_labels gives them. spoken: video_id, segment_id, start_time, text, if mentions count.

    A label names the dominant voice around it; variants of a name within a video are one. The first label
    of a voice sets its name, surely (ALTO) if it has a role and shares two seconds, else MEDIO; another
    name, or a name that two voices claim, makes MEDIO. A name said aloud goes to the dominant
    voice of the next seconds and names it, MEDIO, if no label did. No name leaves BAJO, and a nameless voice of 60 seconds is off screen.
    """
    at_voice = ["video_id", "speaker"]
    voice = turns.groupBy(*at_voice).agg(F.min("start_time").alias("first_s"), F.max("end_time").alias("last_s"), F.sum(F.col("end_time") - F.col("start_time")).alias("spoken_s"))
    for c, kind in (("confidence", "double"), ("sightings", "long")):
        labels = labels if c in labels.columns else labels.withColumn(c, F.lit(0).cast(kind))
    # What lines and texts say is worked out once and kept: several joins below need it, and a filter would work it out again.
    read = materialise(labels.withColumn("p", T.read_label(F.col("lines")))).where(F.col("p").isNotNull()).withColumn("name", F.col("p.name"))
    read = materialise(read.join(canonical_names(read, ("video_id",)), ["video_id", "name"], "left").withColumn("name", F.coalesce("canonical", "name")))
    heard = dominant_speaker(read, turns, "label_ord", K.LABEL_MARGIN_S).where(F.col("speaker").isNotNull())
    claims = read.select("video_id", "label_ord", "start_time", "name", "p", "lines", "confidence", "sightings").join(heard, ["video_id", "label_ord"])
    at = Window.partitionBy(*at_voice)
    claims = claims.withColumn("c", F.first(F.struct("label_ord", "name", "p.role", "p.institution", "seconds")).over(at.orderBy("label_ord")))
    by_name = Window.partitionBy("video_id", "name")
    claims = claims.withColumns({"who": F.array_sort(F.collect_set("speaker").over(by_name)), "since": F.min("label_ord").over(by_name)})

    stamp, none = clock(F.col("start_time")), F.array().cast("array<string>")
    percent = F.bround(F.col("confidence") * 100).cast("int").cast("string")
    told = F.when(F.col("label_ord") == F.col("c.label_ord"), F.format_string(K.EVIDENCE_LABEL, stamp, F.array_join("lines", " / "), F.col("sightings").cast("long"), percent))
    told = told.when(F.col("name") != F.col("c.name"), F.format_string(K.EVIDENCE_CONFLICT, stamp, F.col("name"))).otherwise(F.format_string(K.EVIDENCE_REPEATED, stamp))
    two = F.size("who") > 1
    shared = F.when(two, F.struct("since", F.format_string(K.EVIDENCE_SHARED, F.col("name"), F.size("who"), F.array_join("who", ", ")).alias("note")))
    seen = claims.groupBy(*at_voice).agg(F.first("c").alias("c"), F.max(F.col("name") != F.col("c.name")).alias("conflict"), F.max(two).alias("doubted"), F.array_sort(F.collect_list(F.struct("label_ord", told.alias("note")))).alias("shown"), F.array_sort(F.collect_set(shared)).alias("shared"))
    out = voice.join(seen, at_voice, "left")
    sure = F.col("c.role").isNotNull() & (F.col("c.seconds") >= K.SHARED_S) & ~F.col("conflict") & ~F.col("doubted")
    named, notes = F.col("c").isNotNull(), [F.transform("shown", lambda x: x["note"]), F.transform("shared", lambda x: x["note"])]
    name, level = F.col("c.name"), F.when(~named, "BAJO").when(sure, "ALTO").otherwise("MEDIO")

    if spoken is not None:
        told_names = materialise(spoken.select("video_id", "segment_id", "start_time", T.spoken_names(F.coalesce("text", F.lit(""))).alias("names")))
        said = told_names.select("video_id", "segment_id", "start_time", F.posexplode("names").alias("pos", "said"))
        said = said.select("video_id", F.struct("start_time", "segment_id", "pos").alias("mention"), "start_time", (F.col("start_time") + K.SPOKEN_WINDOW_S).alias("end_time"), F.trim("said").alias("said"))
        near = dominant_speaker(said, turns, "mention").where(F.col("speaker").isNotNull())
        said = said.join(near.select("video_id", "mention", "speaker"), ["video_id", "mention"])
        note = F.format_string(K.EVIDENCE_SPOKEN, stamp, F.col("said"))
        aloud = said.groupBy(*at_voice).agg(F.array_sort(F.collect_list(F.struct("mention", "said", note.alias("note")))).alias("said"))
        out = out.join(aloud, at_voice, "left")
        notes.append(F.transform("said", lambda x, i: F.concat(x["note"], F.when(named | (i > 0), K.EVIDENCE_SPOKEN_AGAIN).otherwise(""))))
        name, level = F.coalesce(name, F.get("said", F.lit(0))["said"]), F.when(~named & F.col("said").isNotNull(), "MEDIO").otherwise(level)

    off = name.isNull() & (F.col("spoken_s") >= K.OFF_SCREEN_S)
    narrates = F.format_string(K.EVIDENCE_OFF_SCREEN, F.bround(F.col("spoken_s") / 60).cast("int").cast("string"))
    evidence = F.concat(*[F.coalesce(x, none) for x in notes], F.when(off, F.array(narrates)).otherwise(none))
    return out.select(*at_voice, name.alias("name"), F.col("c.role").alias("role"), F.col("c.institution").alias("institution"), level.alias("confidence"), "first_s", "last_s", "spoken_s", off.alias("off_screen"), evidence.alias("evidence"))
