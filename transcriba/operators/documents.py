"""Documents built from transcripts: Markdown, SRT, corpus JSON, review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.numbers import clock


def srt(utterances: DataFrame) -> DataFrame:
    """video_id, srt: numbered blocks with times and `name: text`."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time", "text"))
    who = F.coalesce(F.concat("speaker", F.lit(": ")), F.lit(""))
    rows = utterances.select("video_id", n.alias("n"), F.concat(n.cast("string"), F.lit("\n"), clock(F.col("start_time"), True), F.lit(" --> "), clock(F.col("end_time"), True), F.lit("\n"), who, F.col("text")).alias("block"))
    return rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b")).select("video_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("srt"))


def markdown(utterances: DataFrame, media: DataFrame, stamps: bool = True) -> DataFrame:
    """K5: video_id, markdown: title, speakers in order of appearance, utterances."""
    stamp = F.concat(F.lit("["), clock(F.col("start_time")), F.lit("] ")) if stamps else F.lit("")
    line = F.concat(F.lit("**"), F.coalesce("speaker", F.lit("SPEAKER_?")), F.lit("** "), stamp, F.col("text"))
    rows = utterances.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time", line.alias("line"), "speaker"))).alias("b"))
    named = F.array_distinct(F.filter(F.transform("b", lambda x: x["speaker"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    body = F.array_join(F.transform("b", lambda x: x["line"]), "\n\n")
    return rows.join(media.select("video_id", "title"), "video_id").select("video_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join(named, ", "), F.lit("\n\n"), body).alias("markdown"))


# Keys of the corpus document and the columns they hold, in order.
VIDEO_KEYS = (("video_id", "video_id"), ("titulo", "title"), ("archivo", "path"), ("checksum_sha256", "checksum"), ("duracion_s", "duration_seconds"), ("proyecto", "project"), ("curso", "course_name"), ("estado", "processing_status"), ("inicio_contenido_s", "content_start_s"))
CHUNK_KEYS = (("chunk_id", "chunk_id"), ("inicio_s", "start_time"), ("fin_s", "end_time"), ("texto", "full_text"), ("tipo_discurso", "discourse_type"), ("confianza", "avg_confidence"))


def corpus_json(media: DataFrame, chunks: DataFrame, mentions: DataFrame | None = None, notes: DataFrame | None = None, exported: str = "", wanted: DataFrame | None = None) -> DataFrame:
    """K1: video_id, json of each medium: its facts, its chunks in time order with their entities, its notes in time order, the time of export.

    Columns of VIDEO_KEYS and CHUNK_KEYS that a table lacks are null. mentions: chunk_id, label, entity_type; entities of a chunk come
    by label. notes: video_id, timestamp_s, text. Media without chunks have an empty list. ValueError names a wanted video_id that is unknown.
    """
    if wanted is not None:
        lost = wanted.select("video_id").join(media.select("video_id"), "video_id", "left_anti").orderBy("video_id").first()
        if lost is not None:
            raise ValueError(f"unknown video: {lost.video_id}")
        media = media.join(wanted.select("video_id").distinct(), "video_id", "left_semi")
    take = lambda rows, keys: [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(k) for k, c in keys]
    entity = "array<struct<label:string,tipo:string>>"
    if mentions is not None:
        per = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct(F.col("label"), F.col("entity_type").alias("tipo")))).alias("entidades"))
        chunks = chunks.join(per, "chunk_id", "left")
    else:
        chunks = chunks.withColumn("entidades", F.lit(None).cast(entity))
    said = F.struct(*take(chunks, CHUNK_KEYS), F.coalesce("entidades", F.array().cast(entity)).alias("entidades"))
    item = F.struct("start_time", F.col("chunk_id").alias("id"), said.alias("c"))
    body = chunks.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("c")).select("video_id", F.transform("c", lambda x: x["c"]).alias("chunks"))
    rows = media.select("video_id", F.struct(*take(media, VIDEO_KEYS)).alias("video")).join(body, "video_id", "left")
    note = "array<struct<timestamp_s:double,texto:string>>"
    if notes is not None:
        per = notes.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.col("timestamp_s").cast("double").alias("timestamp_s"), F.col("text").alias("texto")))).alias("n"))
        rows = rows.join(per, "video_id", "left")
    else:
        rows = rows.withColumn("n", F.lit(None).cast(note))
    kind = body.schema["chunks"].dataType
    whole = F.struct("video", F.coalesce("chunks", F.array().cast(kind)).alias("chunks"), F.coalesce("n", F.array().cast(note)).alias("anotaciones_manuales"), F.lit(exported).alias("exportado_el"))
    return rows.select("video_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def low_confidence(segments: DataFrame, below: float = K.LOW_CONFIDENCE, n: int = K.LISTED_LOW) -> DataFrame:
    """the n least confident segments below the limit: a review list."""
    return segments.where(F.col("confidence") < below).orderBy("confidence", "video_id", "start_time").limit(n)


def dossier(entity: DataFrame) -> DataFrame:
    """label_norm and its evidence over all chunks in time order, as one document."""
    rows = entity.groupBy("label_norm").agg(F.array_sort(F.collect_list(F.struct("video_id", "start_time", "surface"))).alias("e"))
    return rows.select("label_norm", F.size("e").alias("evidences"), F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["video_id"].cast("string"), F.lit(" "), clock(x["start_time"]), F.lit(" "), x["surface"])), "\n").alias("document"))


def _frequent(words: Column, n: int) -> Column:
    """The n most frequent of an array's words, ties by first occurrence: sorted with their positions, equal words are runs.

    The array is sorted once and each run is counted by where the next begins, so a long text costs little more than its sort.
    """
    placed = F.sort_array(F.transform(words, lambda x, i: F.struct(x.alias("word"), i.alias("pos"))))
    begins = lambda w: F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (F.get(w, i - 1)["word"] != x["word"]), F.struct(x["word"].alias("word"), x["pos"].alias("pos"), i.alias("at")))), lambda x: x.isNotNull())
    counted = lambda w, b: F.transform(b, lambda x, j: F.struct((x["at"] - F.coalesce(F.get(b, j + 1)["at"], F.size(w))).alias("n"), x["pos"].alias("pos"), x["word"].alias("word")))
    runs = T.once(placed, lambda w: T.once(begins(w), lambda b: counted(w, b)))
    return F.transform(F.slice(F.sort_array(runs), 1, n), lambda x: x["word"])


def local_summaries(chunks: DataFrame, id_col: str = "chunk_id", text: str = "full_text", n: int = 5) -> DataFrame:
    """Id, summary: the first sentence and the n most frequent keywords, ties by first occurrence.

    Words are counted within their own row: nothing is shuffled, and a row repeats or lacks its id as it may.
    """
    rows = chunks.select(id_col, T.first_sentence(F.col(text)).alias("first"), (F.trim(text) == "").alias("blank"), _frequent(T.keyword_candidates(F.col(text)), n).alias("k"))
    full = F.when(F.col("blank"), "").when(F.size("k") > 0, F.concat("first", F.lit(" ["), F.array_join("k", ", "), F.lit("]"))).otherwise(F.col("first"))
    return rows.select(id_col, full.alias("summary"))
