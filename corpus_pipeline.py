"""From documents to token shards: five stages, each by one operator of transcriba.llm.

Quality rules drop documents that they reject; of each class of near-duplicates the document with the
least id stays; documents that hold a benchmark item go; sources are mixed to tempered weights, which
repeats documents of small sources and loses none; what is left becomes token shards with their index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcriba.llm.common import columns, fresh, materialise, table
from transcriba.llm.decontaminate import with_hits
from transcriba.llm.mixing import mix_sources
from transcriba.llm.near_dup import near_duplicates
from transcriba.llm.quality import quality_scores, train_quality
from transcriba.llm.queries import tokenizer_path
from transcriba.llm.token_store import write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half; the rules learn from labels that are not held out.

    A row is judged by its own text: null ids, repeated rows and columns of any name are left as they
    are. Null, empty and very long texts get a score as others do; an empty table stays empty.
    """
    model, score = train_quality(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return quality_scores(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*columns(docs))


#: Bytes of dropped ids up to which they are broadcast; beyond, documents and ids meet by a shuffle.
BROADCAST_BYTES = 16 << 20


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id, a null id being less than any other.

    Rows that share an id share its fate: they stay if one does, so repeated rows stay repeated and no
    document without an id goes for another's sake. Null and empty texts are one class; an empty table
    stays empty; further columns are left as they are.
    """
    decided = materialise(spark, near_duplicates(docs).select("doc_id", "class_id"))
    stay = decided.groupBy(F.col("class_id").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("least"))
    stay = materialise(spark, stay.select("c", F.col("least.doc_id").alias("stay")))
    gone = fresh(docs, "gone")
    others = decided.join(stay, F.col("class_id").eqNullSafe(F.col("c"))).where(~F.col("doc_id").eqNullSafe(F.col("stay"))).select(F.col("doc_id").alias(gone)).distinct()
    others = materialise(spark, others.join(stay.select("stay"), F.col(gone).eqNullSafe(F.col("stay")), "left_anti"))
    small = 8 * others.count() <= BROADCAST_BYTES
    return docs.join(F.broadcast(others) if small else others, docs["doc_id"].eqNullSafe(others[gone]), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches an item of the benchmark.

    Each row is judged by its own text and dropped in place: rows that share an id or have none decide
    nothing for each other. Null and empty texts match nothing; an empty table stays empty.
    """
    hits = fresh(docs, "hits")
    return with_hits(docs, table(spark, sf_dir, "benchmark"), hits_col=hits).where(F.size(hits) == 0).select(*columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to 1.5 times on average.

    A null source is a source of its own, a document without words stays once, and equal rows share one
    fate. The stage returns the columns of documents, so the order of the mixed passes is not kept here.
    """
    return mix_sources(docs).select(*columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards in id order and reads every record back: doc_id, start, n_tokens, ids_crc32, shard.

    Null texts hold the end id alone; null ids come first; repeated rows are records of their own.
    """
    return write_tokens(docs, tokenizer_path(), 2).records(docs.select("doc_id"))


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("decontaminate", decontaminate), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: rules are learnt, signatures are hashed and ids come from a tokenizer. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs)
    return docs
