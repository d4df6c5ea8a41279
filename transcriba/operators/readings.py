"""Text read from frames: words to lines, the training set, the best line of a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

# The least confidence of a word; of a line to learn from, and its sightings.
WORD_CONFIDENCE, LEARN_CONFIDENCE, LEARN_SIGHTINGS = 70.0, 0.88, 3


def useful_word(c: Column) -> Column:
    """A word with two letters or more, or a number of four digits."""
    t = F.trim(c)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 2
    return F.coalesce(F.when(t.rlike(r"^\p{Nd}+$"), F.length(t) == 4).otherwise(letters), F.lit(False))


def told_lines(lines: DataFrame) -> DataFrame:
    """video_id, t, block, line, text, conf, y of each line of a frame, from lines that hold their words.

    lines: video_id, t, block, line, words: an array of (ord, text, conf (0 to 100), top) in any order. Each row is decided by
    itself. Words in doubt and those that say nothing are left out; a line of under three letters goes. conf is
    the mean as a share, y the top.
    """
    def tell(kept: Column) -> Column:
        said = F.sort_array(F.transform(kept, lambda x: F.struct(x["ord"].alias("ord"), F.trim(x["text"]).alias("w"))))
        text = F.trim(F.regexp_replace(F.array_join(F.transform(said, lambda x: x["w"]), " "), r"\s+", " "))
        total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["conf"])
        return F.struct(text.alias("text"), (total / F.size(kept) / 100).alias("conf"), F.array_min(F.transform(kept, lambda x: x["top"])).alias("y"))

    kept = F.filter("words", lambda x: (x["conf"] >= WORD_CONFIDENCE) & useful_word(x["text"]))
    told = F.filter(F.transform(F.filter(F.array(kept), lambda k: F.size(k) > 0), tell), lambda r: F.length(r["text"]) >= 3)  # exploded, not filtered: a filter would go below and work it all out once more
    return lines.select("video_id", "t", "block", "line", F.explode(told).alias("r")).select("video_id", "t", "block", "line", "r.*")


def read_lines(words: DataFrame) -> DataFrame:
    """The lines of told_lines, from words: video_id, t, block, line, ord, text, conf (0 to 100), top."""
    rows = words.where((F.col("conf") >= WORD_CONFIDENCE) & useful_word(F.col("text")))
    said = F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("w"))))
    lines = rows.groupBy("video_id", "t", "block", "line").agg(said.alias("s"), (F.avg("conf") / 100).alias("conf"), F.min("top").alias("y"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("s", lambda x: x["w"]), " "), r"\s+", " "))
    return lines.select("video_id", "t", "block", "line", text.alias("text"), "conf", "y").where(F.length("text") >= 3)


def learnable(labels: DataFrame) -> DataFrame:
    """labels good enough to learn from: sure, seen often, and no line long. Columns confidence, sightings, lines."""
    return labels.where((F.col("confidence") >= LEARN_CONFIDENCE) & (F.col("sightings") >= LEARN_SIGHTINGS) & F.forall("lines", lambda x: F.length(x) <= K.LABEL_LINE_CHARS))


def best_line(lines: Column, read: Column) -> Column:
    """Of a label's lines the first with the most words of the text read, folded; null when none shares one."""
    words = lambda c: F.array_distinct(F.split(T.normalize_ocr(c), " "))
    shared = F.transform(lines, lambda x: F.size(F.filter(F.array_intersect(words(x), words(read)), lambda w: w != "")))
    best = F.array_max(shared)
    return F.when(best > 0, F.get(lines, (F.array_position(shared, best) - 1).cast("int")))
