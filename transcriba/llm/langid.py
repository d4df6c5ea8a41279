"""Language of a text in two steps: its family, then linear support vector machines between pairs of that family.

A text is the square root of its shares of byte n-grams (one to four bytes of lower-cased letters, words
bounded by spaces), hashed into a table: a vector of length one. One machine for each family tells it from
all others; within a family, one machine for each pair of languages votes. Spark counts the grams, of
learnt texts and of all texts alike; the driver fits the machines on a bounded sample of counted texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, named

#: Languages of one family, by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "malayo-polynesian": ("id", "jv", "ms", "tl"),
}
#: Buckets of hashed grams, and the longest gram in bytes.
BUCKETS, LONGEST = 1 << 13, 4
#: Texts that the fit reads of each language at most, taken by a hash of their id, and languages at most, the commonest first.
FIT_ROWS, FIT_LANGUAGES = 1_000, 40
#: Bytes of text counted at a time, and texts; a longer text is counted in pieces of so many bytes.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 128

_LETTER = np.full(256, 32, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").partition("-")[0]
    return next((f for f, own in FAMILIES.items() if code in own), lang)


def count_grams(texts: list[bytes]) -> np.ndarray:
    """Grams of each text by bucket, as a matrix; texts are lower-cased UTF-8."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    data = _LETTER[data]
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    data, row = data[keep].astype(np.uint32), row[keep].astype(np.int64) * BUCKETS
    out, packed = np.zeros(len(texts) * BUCKETS, np.int64), np.zeros(len(data), np.uint32)
    for k in range(LONGEST):
        n = len(data) - k
        if n <= 0:
            break
        packed = (packed[:n] << np.uint32(8)) | data[k:]
        h = (packed * np.uint32(0x9E3779B1) + np.uint32((k * 0x85EBCA6B) & 0xFFFFFFFF)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
        whole = row[:n] == row[k:]
        out += np.bincount((row[:n] + h)[whole], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def _counted(texts: list[str]):
    """Row ranges and their gram counts, block by block."""
    at = 0
    while at < len(texts):
        first = texts[at].lower().encode("utf-8", "surrogatepass")
        if len(first) > BLOCK_BYTES:
            total = np.zeros((1, BUCKETS), np.int64)
            for lo in range(0, len(first), BLOCK_BYTES):
                total += count_grams([first[lo : lo + BLOCK_BYTES]])
            yield at, at + 1, total
            at += 1
            continue
        block, size = [first], len(first)
        while at + len(block) < len(texts) and len(block) < BLOCK_TEXTS and size < BLOCK_BYTES:
            t = texts[at + len(block)].lower().encode("utf-8", "surrogatepass")
            if size + len(t) > BLOCK_BYTES:
                break
            block.append(t)
            size += len(t)
        yield at, at + len(block), count_grams(block)
        at += len(block)


def vectors(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length one, zeros for a text without grams."""
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 32.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine (squared hinge, classes weighing alike) for y of -1 and 1, by accelerated gradient."""
    mean = x.mean(0)
    side = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * np.float32(c)
    u = np.random.default_rng(0).random(x.shape[1], np.float32)
    for _ in range(12):  # the greatest eigenvalue bounds the step
        z = x @ u - mean @ u
        u = x.T @ (z * side) - mean * (z @ side)
        norm = float(np.linalg.norm(u))
        u /= max(norm, 1e-12)
    step = 1 / (1.0 + 2 * 1.1 * norm + 2 * float(side.sum()))
    w, b, v, vb, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 1.0
    for _ in range(steps):
        slack = np.maximum(1 - y * (x @ v - mean @ v + vb), 0)
        g = -2 * side * y * slack
        nw, nb = v - step * (v + x.T @ g - mean * g.sum()), vb - step * float(g.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b - mean @ w)


@dataclass
class LanguageModel:
    """Languages by family, a machine for each family and one for each pair within a family, side by side in one matrix."""

    families: dict[str, list[str]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each row: the product of the family's and of the least sure vote for the language."""
        n, names = len(counts), list(self.families)
        margin = vectors(counts) @ self.weights + self.bias
        sure = 1 / (1 + np.exp(-3 * np.clip(margin, -30, 30).astype(np.float64)))
        alone = len(names) == 1
        best = np.zeros(n, np.int64) if alone else margin[:, : len(names)].argmax(1)
        score = np.ones(n) if alone else sure[np.arange(n), best]
        out, at = [""] * n, 0 if alone else len(names)
        for f, name in enumerate(names):
            langs, rows = self.families[name], np.flatnonzero(best == f)
            pairs = list(combinations(range(len(langs)), 2))
            votes, total, least = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for k, (i, j) in enumerate(pairs):
                m, p = margin[rows, at + k], sure[rows, at + k]
                for own, sign, q in ((i, m, p), (j, -m, 1 - p)):
                    votes[:, own] += sign >= 0 if own == i else sign > 0
                    total[:, own] += sign
                    least[:, own] = np.minimum(least[:, own], q)
            at += len(pairs)
            # Most votes; of equals, the greatest sum of margins, then the first name.
            order = (votes * 1e6 + total).argmax(1)
            score[rows] *= least[np.arange(len(rows)), order]
            for r, o in zip(rows.tolist(), order.tolist(), strict=True):
                out[r] = langs[o]
        return out, score


def fit_languages(counts: np.ndarray, langs: list[str]) -> LanguageModel:
    """Families and machines for the languages of these rows; without rows, a model of no language."""
    known = sorted(set(langs))
    families: dict[str, list[str]] = {}
    for lang in known:
        families.setdefault(family_of(lang), []).append(lang)
    own, x = np.array([known.index(v) for v in langs], np.int64), vectors(counts)
    machines = []
    if len(families) > 1:
        for members in families.values():
            inside = np.isin(own, [known.index(v) for v in members])
            machines.append(fit_machine(x, np.where(inside, 1, -1).astype(np.float32)))
    for members in families.values():
        for a, b in combinations(members, 2):
            rows = np.isin(own, [known.index(a), known.index(b)])
            machines.append(fit_machine(x[rows], np.where(own[rows] == known.index(a), 1, -1).astype(np.float32)))
    if not machines:
        return LanguageModel(families)
    return LanguageModel(families, np.column_stack([w for w, _ in machines]).astype(np.float32), np.array([b for _, b in machines], np.float32))


def held_out(doc_id: Column) -> Column:
    """Rows whose language is never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sparse_counts(text: pa.Array) -> pa.Array:
    """Buckets and counts of a text that are not zero, as two runs of little-endian 32-bit integers."""
    out = []
    for _, _, counts in _counted(text.to_pylist()):
        for row in counts:
            at = np.flatnonzero(row)
            out.append(np.concatenate([at, np.minimum(row[at], (1 << 32) - 1)]).astype("<u4").tobytes())
    return pa.array(out, pa.binary())


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, fit_languages_most: int = FIT_LANGUAGES) -> LanguageModel:
    """Fits on at most fit_rows texts for each of at most fit_languages_most languages, from rows that are not held out.

    A row teaches if its id and language are not null and its text has a letter. Texts are chosen by a hash
    of their id under a limit for each language, so no language is sorted or gathered anywhere; rows that
    repeat an id teach once, by the least of their texts. A rare language teaches with all its rows.
    Without any row the model knows no language; with one language it always answers that.
    """
    lang = named(lang_col).cast("string")
    rows = docs.select(named(id_col).alias("id"), lang.alias("lang"), named(text_col).cast("string").alias("text")).where(named("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & has_letter(F.col("text")))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_languages_most).collect()
    if not found:
        return LanguageModel({})
    # A language of n rows gives those whose hash lies in the first fit_rows / n of its range.
    part = F.create_map(*[F.lit(v) for r in found for v in (r["lang"], float(min(1.0, fit_rows / r["n"])))])
    place = F.pmod(F.xxhash64(F.lit(13), F.col("id").cast("string")), F.lit(1 << 52)) / float(1 << 52)
    taken = rows.where(place < F.coalesce(F.try_element_at(part, F.col("lang")), F.lit(0.0)))
    taken = taken.groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.struct("lang", "text")).alias("v"))
    taken = taken.orderBy(F.xxhash64("id"), "id").limit(fit_rows * len(found))
    held = taken.select(F.col("v.lang").alias("lang"), F.arrow_udf(_sparse_counts, "binary")(F.col("v.text")).alias("grams")).collect()
    counts = np.zeros((len(held), BUCKETS), np.float32)
    for k, r in enumerate(held):
        at, n = np.frombuffer(r["grams"], "<u4").reshape(2, -1)
        counts[k, at] = n
    return fit_languages(counts, [r["lang"] for r in held])


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """docs with out_col: struct(lang, score) by the whole text alone.

    lang is one of the model's languages, or "und" with score 0 where the text is null, has no letter, or
    the model knows no language. Equal texts get equal answers; texts of any length are counted whole, in pieces;
    an empty table stays empty. Input columns keep their values whatever their names, but for one already
    named out_col: it gives way, so name another.
    """
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != out_col.lower()])
    known = bool(model.families)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, _, counts in _counted(text.to_pylist()):
            a, b = model.predict(counts)
            langs += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], fields=list(kind))

    text, own = named(text_col).cast("string"), fresh(docs, "_language")
    if not known:
        return docs.select(*columns(docs), F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")).alias(out_col))
    rows = docs.select(*columns(docs), predict(F.coalesce(text, F.lit(""))).alias(own))
    answer = F.when(has_letter(text), F.col(own)).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))
    return rows.select(*columns(docs), answer.alias(out_col))
