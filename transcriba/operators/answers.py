"""Answers from evidence: the gate, citations, real usage, dossiers; and small provider stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import numbers as N
from ..functions import text as T

# Fixed value: the answer where there is no evidence.
NO_EVIDENCE = "No hay evidencia suficiente en tu biblioteca para esta pregunta."


def hash_embedding(c: Column, dimensions: int = 8) -> Column:
    """A deterministic unit vector from the SHA-256 of a text; stands in where no model is given."""
    digest = F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    return N.unit(F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5))


def used_tokens(usage: DataFrame) -> DataFrame:
    """Input and output tokens of calls whose providers name them differently; null and zero count as absent."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in names], F.lit(0))
    return usage.withColumns({"tokens_in": first("prompt_tokens", "input_tokens", "prompt_token_count"), "tokens_out": first("completion_tokens", "output_tokens", "candidates_token_count")})


def ask(questions: DataFrame, evidence: DataFrame, model: Callable[[str, str], str] | None, system: str = "") -> DataFrame:
    """Q5: question_id, answer, cited, grounded. Without evidence the answer is fixed and no model is called.

    evidence: question_id, rank, title, start_time, end_time, text. A model is a callable of system and
    user text, called on the executors for the questions of an Arrow batch one after another.
    """
    from .search import framed

    item = F.struct("rank", "title", "start_time", "end_time", "text")
    per = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    rows = questions.join(per, "question_id", "left").withColumn("n", F.coalesce(F.size("e"), F.lit(0)))
    text = framed(F.col("question"), F.col("e"))
    if model is None:
        answer = F.lit(NO_EVIDENCE)
    else:
        answer = F.when(F.col("n") > 0, _asked(model, system)(F.when(F.col("n") > 0, text))).otherwise(NO_EVIDENCE)
    rows = rows.withColumn("answer", answer)
    return rows.select("question_id", "answer", T.cited(F.col("answer"), F.col("n")).alias("cited"), (F.size(T.cited(F.col("answer"), F.col("n"))) > 0).alias("grounded"))


def _asked(model: Callable[[str, str], str], system: str):
    """The model over an Arrow batch of user texts; null stays null."""

    @F.arrow_udf("string")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if u is None else model(system, u) for u in batch.to_pylist()], pa.string())

    return call


def estimate(questions: DataFrame, evidence: DataFrame, system: str, model: str, provider: str) -> DataFrame:
    """Q6: question_id, evidences, tokens_in, tokens_out, dollars, known: what each question would cost, before any call.

    System text, question and evidence texts count as input; the answer as a fixed number. Local
    providers cost nothing and count as catalogued.
    """
    per = evidence.groupBy("question_id").agg(F.count("*").alias("evidences"), F.sum(N.estimated_tokens(F.col("text"))).alias("read"))
    zero = F.lit(0).cast("long")
    rows = questions.join(per, "question_id", "left").withColumn("tokens_in", (N.estimated_tokens(F.lit(system)) + N.estimated_tokens(F.col("question")) + F.coalesce("read", zero)).cast("long"))
    known = N.price(F.lit(model))["known"] | F.lit(provider in K.LOCAL_PROVIDERS)
    return rows.select("question_id", F.coalesce("evidences", zero).alias("evidences"), "tokens_in", F.lit(K.ANSWER_TOKENS).cast("long").alias("tokens_out"), N.cost(F.col("tokens_in"), F.lit(K.ANSWER_TOKENS), F.lit(model), F.lit(provider)).alias("dollars"), known.alias("known"))


def dossier_cost(estimates: DataFrame) -> DataFrame:
    """Entities, tokens_in, tokens_out, dollars over the estimates of entities that have evidence; one row."""
    rows = estimates.where("evidences > 0")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c, kind in (("tokens_in", "long"), ("tokens_out", "long"), ("dollars", "double"))]
    return rows.agg(F.count("*").alias("entities"), *sums)


def sources_list(evidence: Column, cited: Column) -> Column:
    """Numbered sources; those that the answer does not cite say so."""
    return F.array_join(F.transform(evidence, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["title"], F.lit(" "), N.clock(e["start_time"]), F.when(F.array_contains(cited, i + 1), "").otherwise(" (no citada)"))), "\n")


def calibrated_factor(runs: DataFrame, model: str) -> DataFrame:
    """Model, factor: the mean of observed factors of runs with a duration; the table's factor without any."""
    seen = runs.where(F.col("duration_s") > 0).groupBy(F.lit(model).alias("model")).agg(F.avg(F.col("work_s") / F.col("duration_s")).alias("factor"))
    start = runs.sparkSession.createDataFrame([(model, dict(K.TIME_FACTORS).get(model, dict(K.TIME_FACTORS)["small"]))], "model string, initial double")
    return start.join(seen, "model", "left").select("model", F.coalesce("factor", "initial").alias("factor"))


def reading_marks(utterances: DataFrame) -> DataFrame:
    """The utterances at which a reading opens (a citation differs from the open one) or closes.

    utterances: video_id, start_time, citation_id. A reading closes on the first utterance without one.
    """
    w = Window.partitionBy("video_id").orderBy("start_time")
    before = F.lag("citation_id").over(w)
    mark = F.when(F.col("citation_id").isNotNull() & ~before.eqNullSafe(F.col("citation_id")), "open").when(F.col("citation_id").isNull() & before.isNotNull(), "close")
    return utterances.withColumn("mark", mark).where("mark is not null")


def audio_slice(samples: Column, start: Column, end: Column, rate: int = 16000) -> Column:
    """The samples of [start, end) seconds within bounds, scaled to [-1, 1)."""
    i = F.greatest(F.floor(start * rate), F.lit(0))
    j = F.least(F.floor(end * rate), F.size(samples))
    return F.when(j > i, F.transform(F.slice(samples, (i + 1).cast("int"), (j - i).cast("int")), lambda x: x.cast("double") / 32768)).otherwise(F.array().cast("array<double>"))


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Annotations by annotation_id; a changed text replaces the old one, a null text deletes it."""
    kept = notes.join(changes.select("annotation_id"), "annotation_id", "left_anti")
    return kept.unionByName(changes.where(F.col("text").isNotNull()).select(*notes.columns))


def register_copy(media: DataFrame, copies: DataFrame) -> DataFrame:
    """Trimmed copies as pending media that inherit the original's project.

    copies: video_id (of the original), new_id, path, checksum.
    """
    rows = copies.join(media.select("video_id", "title", "project_id"), "video_id")
    return rows.select(F.col("new_id").alias("video_id"), F.concat("title", F.lit(" (recortado)")).alias("title"), "path", "checksum", F.lit("pending").alias("processing_status"), "project_id")
