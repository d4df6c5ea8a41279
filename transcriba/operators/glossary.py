"""Glossary terms in texts: corrections of diacritics and suggestions of similar names.

Everything is decided once for each distinct word of all texts, by joins on folded forms; texts are
rebuilt only where a word of theirs changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..sources.tables import materialise

#: Letters of a word from which it is compared, and how similar a suggestion must be.
LETTERS, RATIO = 5, 0.85
#: Terms up to which a glossary is broadcast.
BROADCAST_TERMS = 100_000
#: Letters of a term up to which words meet it in cells, and words and terms of a cell, about.
LONG, CELL = 60, 8192
_LETTER_RUN = r"(\p{L}+)"
_PIECE = r"(\p{L}+|[^\p{L}]+)"


def glossary_terms(names: DataFrame) -> DataFrame:
    """Term of the single column of names and works: their distinct letter runs of LETTERS or more."""
    run = F.explode(F.regexp_extract_all(F.col(names.columns[0]), F.lit(_LETTER_RUN), 1))
    return names.select(run.alias("term")).where(F.length("term") >= LETTERS).distinct()


def in_case_of(word: Column, model: Column) -> Column:
    """Word in capitals, with a capital, or in lower case, as the model is: letter for letter, so ß is ẞ in capitals."""
    capital = F.substring(model, 1, 1)
    upper = (T.capitals(model) == model) & (F.lower(model) != model)
    return F.when(upper, T.capitals(word)).when((T.capitals(capital) == capital) & (F.lower(capital) != capital), F.concat(T.capitals(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))).otherwise(F.lower(word))


@F.arrow_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The matching-blocks ratio of two strings."""
    for a, b in pairs:
        yield pa.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def _segment_keys(c: Column, term: bool) -> Column:
    """Keys of which a word and a term of about its length share one if their similarity can reach RATIO.

    The ratio is twice the letters in matching blocks by those of both, so at most 1 - RATIO of all letters lie outside: gone from one
    or new in the other. A term in one segment more than that leaves a segment whole, moved by no more places. A term is filed under
    its segments, for each length that a word may have; a word looks under what it has at their places, for each length of a term.
    """
    def filed(off: Column) -> Column:
        other = F.length(c) + off
        n, m = (other, F.length(c)) if term else (F.length(c), other)
        edits = F.floor(_edits(n, m)).cast("int")
        shifts = F.array(F.lit(0)) if term else F.sequence(-edits, edits)

        def segment(i: Column) -> Column:
            start = F.floor(i * m / (edits + 1)).cast("int")
            size = F.floor((i + 1) * m / (edits + 1)).cast("int") - start
            fits = F.filter(shifts, lambda s: (start + s >= 0) & (start + s + size <= F.length(c)))
            return F.transform(fits, lambda s: F.struct(n.alias("n"), m.alias("m"), i.alias("i"), F.substring(c, 1, 1).alias("first"), F.substr(c, start + s + 1, size).alias("piece")))

        return F.when((n > 0) & (m > 0), F.flatten(F.transform(F.sequence(F.lit(0), edits), segment)))

    offs = F.array(*[F.lit(i) for i in range(-2, 3)])
    return F.array_distinct(F.flatten(F.filter(F.transform(offs, filed), lambda x: x.isNotNull())))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of each word, a row each, zeros after its end."""
    return np.array(words, dtype=f"U{max(map(len, words))}").view(np.uint32).reshape(len(words), -1)


def _bags(codes: np.ndarray) -> np.ndarray:
    """Letters of each word as bits: three for each of 21 kinds, as many set as letters of the kind, three at most.

    The bits in which two words differ are no more than the letters that one has and the other has not.
    """
    counts = np.zeros((len(codes), 21), np.uint8)
    for c in codes.T:
        counts[np.arange(len(codes)), c % 21] += c > 0
    unary = (np.uint64(1) << np.minimum(counts, 3).astype(np.uint64)) - np.uint64(1)
    return np.bitwise_or.reduce(unary << (3 * np.arange(21, dtype=np.uint64)), axis=1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows of code points; rows of a may end in zeros."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    row = np.zeros((len(b) + 1, b.shape[1]), np.int8)
    for x in a:
        before = row
        row = np.zeros_like(before)
        for j, y in enumerate(b):
            np.maximum(before[j + 1], row[j], out=row[j + 1])
            np.maximum(row[j + 1], before[j] + (x == y), out=row[j + 1])
    return row[-1]


def _edits(n: Column | np.ndarray, m: Column | int) -> Column | np.ndarray:
    """Letters of both that may lie outside the matching blocks, where their similarity reaches RATIO: to be rounded down."""
    return (n + m) * (1 - RATIO) + 1e-9


def _nearest(words: pa.Table, terms: pa.Table) -> pa.Table:
    """p, ratio, term: the most similar term of one length for each word of a cell that has one.

    The letters that two words have, then their longest common subsequence, bound the letters in matching blocks; only pairs
    that both bounds allow are matched, the best bound of a word first, until no bound is as good as what was found.
    """
    found = []
    if words.num_rows and terms.num_rows:
        p, plain, names = words.column("p").to_pylist(), terms.column("plain").to_pylist(), terms.column("term").to_pylist()
        a, b, m = _codes(p), _codes(plain), len(plain[0])
        bags, others, n = _bags(a), _bags(b), np.array([len(x) for x in p])
        most = np.floor(_edits(n, m)).astype(np.int64)
        for at in range(0, len(p), 256):
            w, t = np.nonzero(np.bitwise_count(bags[at : at + 256, None] ^ others) <= most[at : at + 256, None])
            w += at
            common = np.concatenate([_common(a[w[i : i + 65536]], b[t[i : i + 65536]]) for i in range(0, len(w), 65536)] or [np.zeros(0)]).astype(np.int64)
            may = n[w] + m - 2 * common <= most[w]
            w, t, common = w[may], t[may], common[may]
            order = np.lexsort((-common, w))
            last, best = -1, None
            for i, j, c in zip(w[order].tolist(), t[order].tolist(), common[order].tolist(), strict=True):
                if i != last:
                    if best:
                        found.append((p[last], -best[0], best[1]))
                    last, best = i, None
                if best and 2.0 * c / (len(p[i]) + m) < -best[0]:
                    continue
                ratio = SequenceMatcher(None, p[i], plain[j]).ratio()
                if ratio >= RATIO and (best is None or (-ratio, names[j]) < best):
                    best = (-ratio, names[j])
            if best:
                found.append((p[last], -best[0], best[1]))
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * 3, (pa.string(), pa.float64(), pa.string()), strict=True)], names=["p", "ratio", "term"])


def nearest_terms(words: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """p, ratio, term: terms of about the length of each word (column p) and its first letter, similar by RATIO, the most similar among them.

    terms: plain, term; longest is the most letters of a plain. Words meet the terms of one length and letter in cells of about
    CELL words and CELL terms; of each cell the best counts. Terms of more than LONG letters, which are few, meet words by segments.
    """
    n, m = F.length("p"), F.col("m")
    at = ["first", "m"]
    asked = words.where("p <> ''").select("p", F.left("p", F.lit(1)).alias("first"), F.explode(F.sequence(n - 2, n + 2)).alias("m")).where((m > 0) & (m <= LONG) & (F.abs(n - m) <= _edits(n, m)))
    held = terms.select("plain", "term", F.left("plain", F.lit(1)).alias("first"), F.length("plain").alias("m")).where((m > 0) & (m <= LONG))
    size = lambda rows, c: rows.groupBy(*at).agg(F.ceil(F.count("*") / CELL).cast("int").alias(c))
    cells = size(asked, "rows").join(size(held, "cols"), at)

    def dealt(rows: DataFrame, key: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        met = rows.join(cells, at).withColumn(names[0], F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return met.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("rows", "cols")

    cell = [*at, "i", "j"]
    parts = words.sparkSession.sparkContext.defaultParallelism * 4  # cells hold few bytes and much work
    left, right = dealt(asked, "p", "rows", "cols", ("i", "j")), dealt(held, "plain", "cols", "rows", ("j", "i"))
    left, right = left.repartition(parts, *cell), right.repartition(parts, *cell)
    out = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_nearest, "p string, ratio double, term string")
    if longest <= LONG:
        return out
    sought = words.where(n > LONG - 2).select("p", F.explode(_segment_keys(F.col("p"), False)).alias("key"))
    filed = terms.where(F.length("plain") > LONG).select("plain", F.explode(_segment_keys(F.col("plain"), True)).alias("key"))
    pairs = sought.join(filed, "key").select("p", "plain").distinct()
    scored = pairs.withColumn("ratio", similarity("p", "plain")).where(F.col("ratio") >= RATIO).join(terms, "plain")
    return out.unionByName(scored.select("p", "ratio", "term"))


def word_decisions(words: DataFrame, terms: DataFrame, hints: bool = True) -> DataFrame:
    """word, fixed, hint of the distinct words (column word) for which a glossary has something to say.

    fixed: the term of the same folded form in the word's own case, unless they differ by case alone.
    hint: for other capitalised words the most similar term (J14) of about the same length and the same
    first letter, the first in order among equals; without hints none is looked for. A word that is a term is left alone.
    Only words and terms that may be so similar by their letters are compared, not all of one length and letter.
    """
    known = terms.select("term", T.fold(F.lower("term")).alias("plain"))
    first = known.groupBy("plain").agg(F.min("term").alias("term"))
    count, longest = known.agg(F.count("*"), F.max(F.length("plain"))).first()
    side = F.broadcast if count <= BROADCAST_TERMS else (lambda x: x)
    own = words.where(F.length("word") >= LETTERS).join(side(terms.select(F.col("term").alias("word"))), "word", "left_anti")
    own = own.select("word", T.fold(F.lower("word")).alias("plain"))
    met = own.join(side(first), "plain", "left")
    met = materialise(met) if hints else met
    fixed = met.where(F.col("term").isNotNull() & (F.lower("term") != F.lower("word"))).select("word", in_case_of(F.col("term"), F.col("word")).alias("fixed"), F.lit(None).cast("string").alias("hint"))
    if not hints:
        return fixed
    capital = F.substring("word", 1, 1)
    open_words = met.where(F.col("term").isNull() & (F.upper(capital) == capital) & (F.lower(capital) != capital)).select("word", F.col("plain").alias("p"))
    scored = nearest_terms(open_words.select("p").distinct(), first, longest or 0)
    best = scored.groupBy("p").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "term")).alias("b"))
    near = open_words.join(best, "p")
    return fixed.unionByName(near.select("word", F.lit(None).cast("string").alias("fixed"), F.col("b.term").alias("hint")))


def correct_terms(texts: DataFrame, glossary: DataFrame, text: str = "text", hints: bool = True) -> DataFrame:
    """Texts with corrected, changes and suggestions, by a glossary (one column of names and works).

    A word that equals a term but for diacritics gets them back, in its own case: each occurrence is a
    change. A capitalised word that is only similar to a term is suggested once, never changed; without hints
    no suggestion is looked for. A null text counts as empty; an empty glossary changes nothing. Only words of which something
    is said are brought together by text, with their places; what lies between is taken from the text itself.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.regexp_extract_all(body, F.lit(_PIECE), 1)
    spoken = texts.select(F.explode(F.regexp_extract_all(body, F.lit(_LETTER_RUN), 1)).alias("word")).where(F.length("word") >= LETTERS).distinct()
    told = materialise(word_decisions(materialise(spoken), materialise(glossary_terms(glossary)), hints))
    # The same text may be there in many rows: it is known by its digest, and its words meet as a set.
    digest = F.unhex(F.sha2(body.cast("binary"), 256))
    pieces = texts.select(digest.alias("key"), F.posexplode(parts).alias("pos", "word")).where(F.length("word") >= LETTERS)
    note = F.struct("pos", "word", "fixed", "hint")
    built = pieces.join(told, "word").groupBy("key").agg(F.sort_array(F.collect_set(note)).alias("a"))
    out = texts.withColumn("_text_key", digest).join(built, F.col("_text_key") == F.col("key"), "left")

    def between(p: Column, a: Column) -> Column:
        end = lambda i: F.coalesce(F.get(a, i)["pos"], F.size(p))
        after = lambda i: F.array_join(F.slice(p, F.get(a, i)["pos"] + 2, F.greatest(end(i + 1) - F.get(a, i)["pos"] - 1, F.lit(0))), "")
        return F.concat(F.array_join(F.slice(p, F.lit(1), F.get(a, F.lit(0))["pos"]), ""), F.array_join(F.transform(a, lambda x, i: F.concat(F.coalesce(x["fixed"], x["word"]), after(i))), ""))

    pick = lambda f: F.transform(F.filter("a", lambda x: x[f].isNotNull()), lambda x: F.concat(x["word"], F.lit("→"), x[f]))
    none = F.array().cast("array<string>")
    corrected = F.when(F.col("a").isNotNull(), T.once(parts, lambda p: between(p, F.col("a"))))
    return out.select(*[F.col(c) for c in texts.columns], F.coalesce(corrected, body).alias("corrected"), F.coalesce(pick("fixed"), none).alias("changes"), F.coalesce(F.array_distinct(pick("hint")), none).alias("suggestions"))


def reading_text(texts: DataFrame, glossary: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Texts with reading and suggestions: cleaned, then by the glossary if there is one."""
    clean = texts.withColumn("_clean", T.clean_for_reading(F.col(text)))
    if glossary is None:
        return clean.withColumn("reading", F.col("_clean")).withColumn("suggestions", F.array().cast("array<string>")).drop("_clean")
    return correct_terms(clean, glossary, "_clean").withColumnRenamed("corrected", "reading").drop("_clean", "changes")
