"""Retrieval: postings and BM25, exact vector search, entity overlap, fusion, evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import constants as K
from ..functions import numbers as N
from ..functions import text as T

_PARTS = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Folded lower-case terms of a text."""
    return F.filter(F.split(T.fold(F.lower(F.coalesce(c, F.lit("")))), _PARTS), lambda x: x != "")


def phrases(words: Column, n: int, first: list[str] | None = None) -> Column:
    """Every run of n words, as one string; of those that begin with a word of first, where it is given."""
    if n == 1:
        return words
    last = F.greatest(F.size(words) - n + 1, F.lit(0))
    run = lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")
    heads = F.slice(words, F.lit(1), last)
    if first is None:
        return F.transform(heads, lambda _, i: run(i))
    return F.filter(F.transform(heads, lambda x, i: F.when(x.isin(first), run(i))), lambda x: x.isNotNull())


def query_terms(queries: DataFrame) -> DataFrame:
    """Q1: query_id, term, times, words. What white space separates is one term; a term of several words is a phrase."""
    said = queries.select("query_id", F.explode(F.split(F.coalesce("query", F.lit("")), r"\s+")).alias("said"))
    rows = said.select("query_id", tokens(F.col("said")).alias("w")).where(F.size("w") > 0)
    return rows.groupBy("query_id", F.array_join("w", " ").alias("term"), F.size("w").alias("words")).agg(F.count("*").alias("times"))


def project_filter(c: Column, project) -> Column:
    """every project for the sentinel "__todos__", no project for None, else that project."""
    if project == "__todos__":
        return F.lit(True)
    return c.isNull() if project is None else c == project


#: Distinct terms of all queries up to which they are broadcast to the chunks.
BROADCAST_TERMS = 1_000_000
#: Distinct terms of all queries up to which the plan holds them, so that other words never become rows.
PLAN_TERMS = 2_000


def bm25(chunks: DataFrame, queries: DataFrame, columns: tuple[str, ...] = ("full_text", "summary"), k1: float = 1.2, b: float = 0.75, project="__todos__") -> DataFrame:
    """query_id, chunk_id, bm25 (negative, lower is better) of chunks that hold any term of a query.

    A term that a query repeats counts each time; a phrase is found within one column. Statistics are
    those of all chunks; a project (of chunks' column project_id, as project_filter takes it) only
    selects among them, before any limit. The query set is stated: its terms meet the words of the
    chunks as these are made, so only words of queries are shuffled. Statistics and scores read one
    exchange of these counts (with a project, a second pass makes the scores): no branch filters or
    drops a column of it. An empty word, which is no term, stands for the chunk itself.
    """
    terms = query_terms(queries)
    wanted = terms.select("term", "words").union(queries.sparkSession.createDataFrame([("", 1)], "term string, words int")).distinct()
    lengths = sorted(r.words for r in wanted.select("words").distinct().collect())  # as many as phrases have lengths
    asked = wanted.count()
    few = asked <= BROADCAST_TERMS
    keys = F.broadcast(wanted.select("term")) if few else wanted.select("term")
    known = [r.term for r in wanted.collect()] if asked <= PLAN_TERMS else None
    kept = ["project_id"] if project != "__todos__" else []
    every = chunks.select("chunk_id", *kept, *[tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    words = [F.col(f"w{i}") for i in range(len(columns))]
    size = F.aggregate(F.array(*[F.size(w) for w in words]), F.lit(0), lambda x, y: x + y)
    heads = sorted({x.split(" ")[0] for x in known if " " in x}) if known is not None else None
    said = F.concat(F.array(F.lit("")), *[phrases(w, n, heads) for w in words for n in lengths])
    if known is not None:
        said = F.filter(said, lambda x: x.isin(known))
    # The length is a column before words become rows: beside the explode, each row would carry all words of its chunk.
    sized = every.withColumn("len", size)
    hits = sized.select("chunk_id", *kept, "len", F.explode(said).alias("term"))
    hits = (hits if known is not None else hits.join(keys, "term")).groupBy("chunk_id", *kept, "len", "term").agg(F.count("*").alias("tf"))
    per = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.avg("len").alias("avglen"))
    chunk = F.col("term") == ""
    whole = per.agg(F.max(F.when(chunk, F.col("df"))).alias("n"), F.max(F.when(chunk & (F.col("avglen") > 0), F.col("avglen"))).alias("avg"))  # one row
    stats = per.join(F.broadcast(whole.select("n", F.coalesce("avg", F.lit(1.0)).alias("avgdl"))), F.lit(True))
    if kept:
        hits = hits.where(project_filter(F.col("project_id"), project))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    weight = terms.join(stats, "term")
    rows = hits.join(F.broadcast(weight) if few else weight, "term")
    return rows.groupBy("query_id", "chunk_id").agg((-F.sum(F.col("times") * idf * tf)).alias("bm25"))


#: Numbers of the vectors, and of the queries, that one cell holds at most; products of a cell at a time.
CELL_VALUES, ASKED_VALUES, PRODUCTS = 4_000_000, 1_000_000, 4_000_000


def _matrix(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of a column of vectors (-1: null or with a null in it), and the vectors of the most common length with zeros for the others."""
    c = c.combine_chunks()
    size = pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = c.flatten()
    ends = np.cumsum(np.maximum(size, 0))
    if flat.null_count:
        bad = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
        size[np.searchsorted(ends, bad, side="right")] = -1
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    d = int(np.bincount(size[size >= 0]).argmax()) if (size >= 0).any() else 0
    out, ok = np.zeros((len(size), d)), size == d
    out[ok] = values[(ends[ok] - d)[:, None] + np.arange(d)]
    return size, out


def _best_of_cell(q: np.ndarray, v: np.ndarray, valid: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of v and products of the k best of each query; equal products go by place, invalid vectors come last.

    A matrix product says which come near the k best, by more than its error; those are summed from the first
    number to the last, as a fold would, so equal vectors have equal products.
    """
    found, step, n = [], max(1, PRODUCTS // max(1, len(v))), len(v)
    slack = 1e-12 * (1 + np.linalg.norm(q, axis=1)) * (1 + np.linalg.norm(v, axis=1).max(initial=0.0))
    for lo in range(0, len(q), step):
        near = np.nan_to_num(q[lo : lo + step] @ v.T, nan=np.inf, posinf=np.inf, neginf=-np.finfo(float).max)
        near[:, ~valid] = -np.inf
        floor = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
        i, j = np.nonzero(near >= (floor - slack[lo : lo + step])[:, None])
        exact = np.zeros(len(i))
        for c in range(q.shape[1]):
            exact += q[lo + i, c] * v[j, c]
        order = np.lexsort((place[j], np.where(np.isnan(exact), -np.inf, -exact), ~valid[j], i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)  # of equal rows the first
        top = np.arange(len(i)) - first < k
        found.append((lo + i[top], j[top], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def cell_top(asked: DataFrame, vectors: DataFrame, cell: list[str], k: int, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, semantic: the k largest inner products of each query with the vectors of its cell, as candidates.

    asked: cell columns, query_id, q; vectors: cell columns, id, embedding. Cells are grouped by Spark; who makes them bounds them.
    """
    kinds = {f.name: f.dataType for f in (*asked.schema.fields, *vectors.schema.fields)}
    out = StructType([StructField("query_id", kinds["query_id"]), StructField(id_col, kinds[id_col]), StructField("semantic", DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids = left.column("query_id").combine_chunks(), right.column(id_col).combine_chunks()
        if not len(names) or not len(ids):
            return pa.table([names.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=out.names)
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        (q_size, q), (v_size, v) = _matrix(left.column("q")), _matrix(right.column("embedding"))
        parts = []
        for d in np.unique(q_size):
            rows, ok = np.flatnonzero(q_size == d), (v_size == d) & (d >= 0)
            mine = q[rows] if d == q.shape[1] and d >= 0 else _matrix(left.column("q").take(pa.array(rows)))[1]
            held = v if d == v.shape[1] or not ok.any() else np.zeros((len(v), d))
            if held is not v:
                held[ok] = _matrix(right.column("embedding").take(pa.array(np.flatnonzero(ok))))[1]
            if not ok.any():
                mine, held = np.zeros((len(rows), 0)), np.zeros((len(v), 0))
            i, j, x = _best_of_cell(mine, np.where(ok[:, None], held, 0.0), ok, place, k)
            parts.append((rows[i], j, x, ~ok[j]))
        i, j, x, none = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(x, mask=none)], names=out.names)

    return asked.select(*cell, "query_id", "q").groupBy(*cell).cogroup(vectors.select(*cell, id_col, "embedding").groupBy(*cell)).applyInArrow(best, out)


def vector_top(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """L2: query_id, id, semantic, rank: the k largest inner products of each query, ties by id.

    queries (query_id, q) is a stated query set. Vectors are dealt into parts and queries into blocks of bounded size; each pair of
    them is a cell, whose products are made as matrices and which keeps k rows of a query. So nothing passes through the driver
    and memory stays that of a cell. The work is that of all pairs, as an exact answer demands.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    width = max(1, size.d or 1)
    parts = max(-(-size.n * width // CELL_VALUES), min(16, -(-size.n // 256)), 1)
    blocks = max(1, -(-queries.count() * width // ASKED_VALUES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"))
    held = vectors.select(id_col, "embedding", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), each(blocks).alias("block"))
    w = Window.partitionBy("query_id").orderBy(F.desc("semantic"), id_col)
    return cell_top(asked, held, ["block", "part"], k, id_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entity_overlap(query_entities: Column, chunk_entities: Column) -> Column:
    """Share of the query's entities that the chunk has; null for a query without entities."""
    n = F.size(F.array_distinct(query_entities))
    return F.when(n > 0, F.size(F.array_intersect(query_entities, chunk_entities)) / n)


def query_overlap(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, entities) -> DataFrame:
    """query_id, chunk_id, entity of candidate pairs: the share of a query's entities in the chunk.

    entities: a column function from a text to its distinct normalised labels. Texts are read for
    candidates alone; a query without entities gives no row.
    """
    asked = queries.select("query_id", entities(F.col("query")).alias("asked")).where(F.size("asked") > 0)
    pairs = candidates.select("query_id", "chunk_id").distinct().join(asked, "query_id")
    held = chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", entities(F.col("full_text")).alias("held"))
    return pairs.join(held, "chunk_id").select("query_id", "chunk_id", entity_overlap(F.col("asked"), F.col("held")).alias("entity"))


def fuse(semantic: DataFrame, textual: DataFrame, entities: DataFrame, confidence: DataFrame | Column, k: int, digits: int = 12) -> DataFrame:
    """Q2: weighted fusion of candidates of both searches, the k best of each query, ties by chunk_id.

    Signals are scaled within a query; confidence is not: a table (chunk_id, confidence), or a column over
    chunk_id. A missing signal is 0. Scores are rounded before they are ranked.
    """
    both = semantic.select("query_id", "chunk_id", "semantic").join(textual.select("query_id", "chunk_id", "bm25"), ["query_id", "chunk_id"], "full_outer")
    rows = both.join(entities, ["query_id", "chunk_id"], "left")
    rows = rows.withColumn("confidence", confidence) if isinstance(confidence, Column) else rows.join(confidence, "chunk_id", "left")
    w = N.per("query_id")
    rows = rows.withColumns({"s": N.minmax(F.col("semantic"), w), "t": N.minmax(F.col("bm25"), w, inverted=True)})
    rows = rows.withColumn("score", F.round(N.fused(F.col("s"), F.col("t"), F.col("entity"), F.col("confidence")), digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, entities, confidence: Column, n: int = K.CANDIDATES, k: int = 10, project="__todos__") -> DataFrame:
    """Q2: query_id, chunk_id, score and its signals: the k best of n candidates of each search, fused.

    queries: query_id, query. chunks: chunk_id, full_text, summary (project_id where a project is asked).
    vectors: chunk_id, embedding; query_vectors: query_id, q. J3: vectors know no project, so with one
    three times as many are taken and those of other projects dropped. confidence is a column over chunk_id.
    Signals are scaled within a query, confidence is not; a missing signal is 0; ties go by chunk_id.
    """
    filtered = project != "__todos__"
    n = max(n, k)
    semantic = vector_top(query_vectors, vectors, 3 * n if filtered else n)
    if filtered:
        own = chunks.where(project_filter(F.col("project_id"), project)).select("chunk_id")
        best = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "chunk_id")
        semantic = semantic.join(own, "chunk_id", "left_semi").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    first = Window.partitionBy("query_id").orderBy(F.round("bm25", 6), "chunk_id")
    textual = bm25(chunks, queries, project=project).withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)
    pairs = semantic.select("query_id", "chunk_id").union(textual.select("query_id", "chunk_id"))
    return fuse(semantic, textual, query_overlap(pairs, queries, chunks, entities), confidence, k, 5)


def diagnosis(fused: DataFrame, k: int = 15) -> DataFrame:
    """Q12: how the k best of each query came to their scores: every signal, raw and scaled; a missing one is 0, raw text null."""
    zero = F.lit(0.0)
    parts = [F.coalesce("semantic", zero).alias("semantic"), F.coalesce("s", zero).alias("semantic_scaled"), "bm25", F.coalesce("t", zero).alias("text_scaled"), F.coalesce("entity", zero).alias("entity"), F.coalesce("confidence", zero).cast("double").alias("confidence")]
    return fused.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score", *parts)


def rrf(rankings: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf from (query_id, source, chunk_id, pos), pos from 0."""
    return rankings.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("pos") + 1)).alias("rrf"))


def evidence(results: DataFrame, k: int = K.EVIDENCES, threshold: float = K.EVIDENCE_THRESHOLD) -> DataFrame:
    """Q3: of the k best results, those that reach the threshold."""
    return results.where((F.col("rank") <= k) & (F.col("score") >= threshold))


# The frame of a question to a model.
QUESTION, EVIDENCE = "PREGUNTA: ", "EVIDENCIA:"


def framed(question: Column, evidences: Column) -> Column:
    """What a model is asked: the question, then the evidence."""
    return F.concat(F.lit(QUESTION), question, F.lit(f"\n\n{EVIDENCE}\n"), prompt(evidences))


def prompt(evidences: Column) -> Column:
    """Numbered evidence blocks, separated by blank lines; fields title, start_time, end_time, text."""
    return F.array_join(F.transform(evidences, lambda e, i: F.format_string("[%d] «%s» %s–%s: \"%s\"", i + 1, e["title"], N.clock(e["start_time"]), N.clock(e["end_time"]), e["text"])), "\n\n")
