"""Sinks: knowledge bundles, files of documents, review lists, process reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.numbers import clock
from .names import free_names


def bundle(media: DataFrame, mentions: DataFrame) -> DataFrame:
    """Path, content of a bundle: a page for each video, and one for each entity across all videos.

    media: video_id, title. mentions: video_id, label_norm, surface, start_time. An entity's appearances
    are ordered by title and time; the entity's first label names its page.
    """
    rows = mentions.join(media, "video_id")
    per = rows.groupBy("label_norm").agg(F.array_sort(F.collect_list(F.struct("title", "start_time", "surface"))).alias("a"), F.countDistinct("video_id").alias("videos"))
    body = F.array_join(F.transform("a", lambda x: F.concat(F.lit("- "), x["title"], F.lit(" "), clock(x["start_time"]))), "\n")
    name = F.get("a", F.lit(0))["surface"]
    entities = per.select(F.concat(F.lit("entities/"), T.slug(name, F.md5(F.col("label_norm").cast("binary"))), F.lit(".md")).alias("path"), F.concat(F.lit("---\ntitle: "), T.yaml_value(name), F.lit("\nvideos: "), F.col("videos").cast("string"), F.lit("\n---\n"), body).alias("content"))
    listed = rows.groupBy("video_id", "title").agg(F.array_sort(F.collect_set("label_norm")).alias("e"))
    videos = listed.select(F.concat(F.lit("videos/"), T.slug(F.col("title"), F.md5(F.col("video_id").cast("string").cast("binary"))), F.lit(".md")).alias("path"), F.concat(F.lit("---\ntitle: "), T.yaml_value(F.col("title")), F.lit("\n---\n"), F.array_join(F.transform("e", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("content"))
    return videos.unionByName(entities)


def write_documents(docs: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """K2, K3: a file for each row, in a partition of its safe name, written by the tasks; the names (name, ord, file) that they got.

    Rows whose names become the same when made safe get names of their own, by content and name: none overwrites another.
    """
    rows = docs.select(F.col(name).alias("_given"), T.safe_file_name(F.col(name)).alias("name"), F.struct(name, content).alias("ord"))
    rows = free_names(rows, rows.select("name").limit(0)).select("_given", "ord", F.col("free").alias("file"))
    rows.select("file", F.col(f"ord.{content}").alias("value")).write.mode("overwrite").partitionBy("file").text(folder, lineSep="\n")
    return rows.select(F.col("_given").alias("name"), "file")


def completed_documents(media: DataFrame, documents: DataFrame) -> DataFrame:
    """K3: title, json of the media of a project that are completed, from corpus_json's rows."""
    return media.where("processing_status = 'completed'").select("video_id", "title").join(documents, "video_id").select("title", "json")


def participants(identities: DataFrame) -> DataFrame:
    """The sheet of participants, in order of first appearance."""
    who = T.editorial_label(F.col("name"), F.col("off_screen"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("first_s", "speaker"))
    return identities.select("video_id", n.alias("number"), who.alias("label"), "name", "role", "institution", "confidence", clock(F.col("first_s")).alias("first"), clock(F.col("last_s")).alias("last"), "off_screen")


def review_list(segments: DataFrame, identities: DataFrame, citations: DataFrame | None = None, dropped: DataFrame | None = None, suggestions: DataFrame | None = None) -> DataFrame:
    """video_id, number, issue, at_s, what, note, issues: what a person must decide, in order.

    Six kinds, one after the other: voices without a name (off-screen ones too), names below the surest
    class with their evidence, texts read aloud, passages left out as probably invented, names that a
    glossary suggests (each once, sorted), and the LISTED_LOW segments recognised worst. issues is how
    many there are of a video. identities: speaker, name, confidence, off_screen, spoken_s, first_s,
    last_s, evidence. citations: start_time, title, author, year. dropped: start_time, text.
    suggestions: hint. Tables that are not given count as empty.
    """

    def kind(rank: int, issue: str, rows: DataFrame, at: Column, what: Column, note: Column, order: Column | None = None) -> DataFrame:
        place = F.coalesce(order, at) if order is not None else at
        return rows.select("video_id", F.lit(rank).alias("rank"), place.cast("double").alias("place"), F.lit(issue).alias("issue"), at.cast("double").alias("at_s"), what.alias("what"), note.alias("note"))

    nameless = identities.where("name is null or name = ''")
    seat = F.row_number().over(Window.partitionBy("video_id").orderBy("speaker"))
    out = [kind(1, "voice without name", nameless.withColumn("seat", seat), F.col("first_s"), F.col("speaker"), F.when(F.col("off_screen"), "off-screen voice").otherwise("no clear function"), F.col("seat"))]
    doubt = identities.where("name <> '' and confidence <> 'ALTO'").withColumn("seat", seat)
    out.append(kind(2, "name in doubt", doubt, F.col("first_s"), F.col("name"), F.concat_ws(": ", "confidence", F.nullif(F.array_join("evidence", "; "), F.lit(""))), F.col("seat")))
    if citations is not None:
        known = F.concat(F.coalesce("author", F.lit("No identificado")), F.coalesce(F.concat(F.lit(" ("), "year", F.lit(")")), F.lit("")))
        out.append(kind(3, "text read aloud", citations, F.col("start_time"), F.col("title"), known, F.lit(0)))
    if dropped is not None:
        out.append(kind(4, "probably invented", dropped, F.col("start_time"), clock(F.col("start_time")), F.left("text", F.lit(160))))
    if suggestions is not None:
        once = suggestions.select("video_id", "hint").distinct()
        out.append(kind(5, "name to correct", once, F.lit(None), F.col("hint"), F.lit(None).cast("string"), F.lit(0)))
    worst = Window.partitionBy("video_id").orderBy("confidence", "start_time")
    low = segments.where(F.col("confidence") < K.LOW_CONFIDENCE).withColumn("seat", F.row_number().over(worst)).where(F.col("seat") <= K.LISTED_LOW)
    out.append(kind(6, "low confidence", low, F.col("start_time"), clock(F.col("start_time")), F.trim("text"), F.col("seat")))
    rows = reduce(DataFrame.unionByName, out)
    whole = Window.partitionBy("video_id")
    number = F.row_number().over(whole.orderBy("rank", "place", "what", "at_s"))
    return rows.select("video_id", number.alias("number"), "issue", "at_s", "what", "note", F.count("*").over(whole).alias("issues"))


def process_report(media: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts of a run."""
    per = segments.groupBy("video_id").agg(F.count("*").alias("segments"), F.countDistinct("speaker").alias("voices"), F.avg("confidence").alias("confidence"), F.max("end_time").alias("seconds"))
    return media.join(per, "video_id", "left").select("video_id", "title", F.coalesce("segments", F.lit(0)).cast("long").alias("segments"), F.coalesce("voices", F.lit(0)).cast("long").alias("voices"), "confidence", "seconds")


def published(segments: DataFrame, end: float | None = None) -> DataFrame:
    """Q10: segments before the end of content with a flag for those that are probably invented."""
    rows = segments if end is None else segments.where(F.col("start_time") < end)
    return rows.withColumn("invented", T.is_hallucination(F.col("text")))


def content_end(labels: DataFrame, duration: DataFrame, tail: float = 0.20) -> DataFrame:
    """The first credit label in the last fifth after which no label identifies anybody.

    labels: video_id, start_time, lines. duration: video_id, duration_seconds. Videos without one give no row.
    """
    rows = labels.join(duration, "video_id").where(F.col("start_time") >= F.col("duration_seconds") * (1 - tail))
    credit = F.exists("lines", lambda x: T.is_credit(x) | (F.length(x) > K.LABEL_LINE_CHARS))
    rows = rows.select("video_id", "start_time", credit.alias("credit"), T.read_label(F.col("lines")).isNotNull().alias("person"))
    later = F.max(F.col("person").cast("int")).over(Window.partitionBy("video_id").orderBy("start_time").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("later", F.coalesce(later, F.lit(0)))
    return rows.where(F.col("credit") & (F.col("later") == 0)).groupBy("video_id").agg(F.min("start_time").alias("end_s"))
