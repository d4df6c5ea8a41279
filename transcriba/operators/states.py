"""Changes of state: media, projects, derived tables of a video, versions of embeddings, confirmed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_fields(media: DataFrame, changes: DataFrame, *fields: str, key: str = "video_id") -> DataFrame:
    """Media with the named fields of the rows that changes (one row for each key) holds; a null is set as null.

    The setters of a status with its error, of a content start and of a project are this with their fields.
    """
    new = changes.select(key, F.struct(*fields).alias("_new"))
    rows = media.join(new, key, "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in media.columns])


def fill_speakers(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments with the speakers found afterwards (video_id, segment_id, speaker); the others keep theirs."""
    return set_fields(segments.withColumn("_k", F.struct("video_id", "segment_id")), found.withColumn("_k", F.struct("video_id", "segment_id")), "speaker", key="_k").drop("_k")


def append_new(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """A table with a batch added; a row whose key is there already is left out, so a batch may be repeated."""
    return table.unionByName(rows.select(*table.columns).dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def clean_derived(gone: DataFrame, segments: DataFrame, chunks: DataFrame, vectors: DataFrame, keep_segments: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, chunks and vectors without those of the videos to be processed again.

    A run that resumes keeps the segments. Vectors (chunk_id) go with their chunks; what is not there
    changes nothing, so the cleanup may be repeated.
    """
    ids = gone.select("video_id").distinct()
    lost = chunks.join(ids, "video_id", "left_semi").select("chunk_id")
    kept = segments if keep_segments else segments.join(ids, "video_id", "left_anti")
    return kept, chunks.join(ids, "video_id", "left_anti"), vectors.join(lost, "chunk_id", "left_anti")


def delete_projects(projects: DataFrame, media: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects without the deleted ones, and media, which stay and belong to no project then."""
    ids = gone.select("project_id").distinct()
    held = media.join(ids.withColumn("_gone", F.lit(True)), "project_id", "left")
    free = F.when(F.col("_gone").isNull(), F.col("project_id"))
    return projects.join(ids, "project_id", "left_anti"), held.select(*[free.alias(c) if c == "project_id" else F.col(c) for c in media.columns])


def pick(table: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """the rows whose keys are wanted; none when none is."""
    return table.join(wanted.select(*keys), list(keys), "left_semi")


def skip_completed(batch: DataFrame, media: DataFrame) -> DataFrame:
    """the media of a batch that are not completed by now; the current table decides, not the batch."""
    return batch.join(media.where("processing_status = 'completed'").select("video_id"), "video_id", "left_anti")


def completed(media: DataFrame) -> DataFrame:
    """the media that may be exported."""
    return media.where("processing_status = 'completed'")


def activate_version(versions: DataFrame, model: str, dimensions: int) -> DataFrame:
    """V3: versions (version_id, model_name, dimensions, is_active) with an active one of the model.

    The one that is active for it stays. Otherwise all are switched off and a new one is added, also
    for a model that was active before. Versions are a row for each model change.
    """
    has = versions.agg(F.coalesce(F.bool_or((F.col("model_name") == model) & F.col("is_active")), F.lit(False)).alias("has"), (F.coalesce(F.max("version_id"), F.lit(0)) + 1).alias("next"))
    old = versions.join(F.broadcast(has), F.lit(True)).withColumn("is_active", F.col("is_active") & F.col("has"))
    new = has.where("not has").select(F.col("next").cast("long").alias("version_id"), F.lit(model).alias("model_name"), F.lit(dimensions).alias("dimensions"), F.lit(True).alias("is_active"))
    return old.select("version_id", "model_name", "dimensions", "is_active").unionByName(new)


def update_vectors(vectors: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """V2: an index (chunk_id, embedding) after chunks are removed and others added; an added one replaces its old vector."""
    out = vectors
    for gone in (removed, added):
        out = out if gone is None else out.join(gone.select("chunk_id"), "chunk_id", "left_anti")
    return out if added is None else out.unionByName(added.select("chunk_id", "embedding"))


# Fixed value: the evidence of a name that a person gave.
BY_HAND = "Nombre confirmado a mano por el usuario"


def confirmed_names(identities: DataFrame, names: DataFrame) -> DataFrame:
    """identities in which a name given by hand replaces the one read, surely, with a line of evidence more.

    identities: video_id, speaker, name, confidence, evidence. names: video_id, speaker_label, display_name.
    """
    given = names.select("video_id", F.col("speaker_label").alias("speaker"), F.col("display_name").alias("_given"))
    hand = F.col("_given").isNotNull()
    new = {
        "name": F.coalesce("_given", "name"),
        "confidence": F.when(hand, "ALTO").otherwise(F.col("confidence")),
        "evidence": F.when(hand, F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.array(F.lit(BY_HAND)))).otherwise(F.col("evidence")),
    }
    return identities.join(given, ["video_id", "speaker"], "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in identities.columns])


def accepted_by_default(name: Column, confidence: Column) -> Column:
    """an identity that is ticked before anybody looks: it has a name and is sure."""
    return F.coalesce((name != "") & (confidence == "ALTO"), F.lit(False))


def accepted_names(identities: DataFrame, checked: Column) -> DataFrame:
    """the names of ticked identities that are not blank, trimmed."""
    return identities.where(checked & (F.trim("name") != "")).select("video_id", F.col("speaker").alias("speaker_label"), F.trim("name").alias("display_name"))


#: The tables of a video in the order in which a deletion empties them, and the key by which a row belongs to it.
CASCADE = (("vectors", "chunk_id"), ("mappings", "chunk_id"), ("mentions", "video_id"), ("notes", "video_id"), ("speakers", "video_id"), ("chunks", "video_id"), ("segments", "video_id"), ("videos", "video_id"))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without what hangs on the deleted videos (video_id), in the order of CASCADE.

    Vectors and mappings go by the chunks that go. Entities and their relations stay: other videos may
    stand behind them. Unknown ids and a second deletion change nothing; tables of other names come back as they are.
    RuntimeError if a deleted video has chunks and there is no table of vectors: they would be left behind.
    """
    ids = gone.select("video_id").distinct()
    lost = tables["chunks"].join(ids, "video_id", "left_semi").select("chunk_id").distinct()
    if "vectors" not in tables and lost.limit(1).count():
        raise RuntimeError("the videos have indexed chunks: deleting them takes the index too")
    keys = dict(CASCADE)
    return {name: rows.join(lost if keys[name] == "chunk_id" else ids, keys[name], "left_anti") if name in keys else rows for name, rows in tables.items()}
