"""Entities, identities, labels, and changes to the catalogue of media."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def entity_mentions(chunks: DataFrame, text: str = "full_text", kind: str = "persona") -> DataFrame:
    """One row for each entity of a chunk: chunk_id, video_id, surface, label_norm, entity_type."""
    rows = chunks.select("chunk_id", "video_id", F.posexplode(T.capitalised_words(F.col(text))).alias("pos", "surface"))
    rows = rows.withColumns({"label_norm": T.normalize_label(F.col("surface")), "entity_type": F.lit(kind)})
    return rows.groupBy("chunk_id", "video_id", "label_norm", "entity_type").agg(F.min_by("surface", "pos").alias("surface"))


def entity_catalogue(mentions: DataFrame) -> DataFrame:
    """One row for each (label_norm, entity_type): the first label, mentions and videos."""
    first = F.struct("video_id", "chunk_id", "surface")
    return mentions.groupBy("label_norm", "entity_type").agg(F.min_by("surface", first).alias("label"), F.count("*").alias("mentions"), F.countDistinct("video_id").alias("videos"))


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """Source, target (source < target), weight: chunks that mention both.

    A chunk's entities are few; their pairs are formed inside its array, so no join meets a hot entity.
    """
    sets = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("label_norm")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice(F.col("e"), i + 2, F.size("e")), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))


def upsert_media(old: DataFrame, new: DataFrame) -> DataFrame:
    """Media by checksum: path and title of the new row, its provenance where given; the rest stays."""
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, F.col("a.checksum") == F.col("b.checksum"), "full_outer")
    keep = {"path": F.coalesce("b.path", "a.path"), "title": F.coalesce("b.title", "a.title"), "source_url": F.coalesce("b.source_url", "a.source_url")}
    cols = [keep[c].alias(c) if c in keep else F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in old.columns]
    return rows.select(*cols)


def ingest(found: DataFrame, known: DataFrame, project: str | None) -> DataFrame:
    """What becomes of each scanned file (checksum, path, title): bucket new, done or pending.

    A known medium without a project joins this one; one that has a project keeps it.
    """
    first = found.groupBy("checksum").agg(F.min(F.struct("path", "title")).alias("f"))
    rows = first.join(known.select("checksum", "video_id", "processing_status", "project_id"), "checksum", "left")
    bucket = F.when(F.col("video_id").isNull(), "new").when(F.col("processing_status") == "completed", "done").otherwise("pending")
    return rows.select("checksum", F.col("f.path").alias("path"), F.col("f.title").alias("title"), bucket.alias("bucket"), F.coalesce("project_id", F.lit(project)).alias("project_id"))


def rename_speakers(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Display names by (video_id, speaker_label); a blank name deletes the row."""
    keys = ["video_id", "speaker_label"]
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes.where(F.trim("display_name") != "").select(*keys, F.trim("display_name").alias("display_name")))


def delete_videos(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A dependent table without the rows of deleted videos; unknown ids change nothing."""
    return table.join(gone.select("video_id").distinct(), "video_id", "left_anti")


def holdout(rows: DataFrame, person: str, order: str) -> DataFrame:
    """Of each person the first half of the rows, rounded down, trains; the rest tests; single rows train."""
    w, n = Window.partitionBy(person).orderBy(order), F.count("*").over(Window.partitionBy(person))
    return rows.withColumn("part", F.when((n == 1) | (F.row_number().over(w) <= F.floor(n / 2)), "train").otherwise("test"))


def diarization_errors(rows: DataFrame) -> DataFrame:
    """Fusions and fragmentations of clusters against persons; unlabelled rows do not count."""
    r = rows.where(F.col("person").isNotNull() & F.col("cluster").isNotNull())
    fusion = r.groupBy("cluster").agg((F.countDistinct("person") - 1).alias("fusions")).select("fusions", F.lit(0).cast("long").alias("fragmentations"))
    parts = r.groupBy("person").agg((F.countDistinct("cluster") - 1).alias("fragmentations")).select(F.lit(0).cast("long").alias("fusions"), "fragmentations")
    both = fusion.unionByName(parts)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in both.columns])
