"""Times, scores and costs, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import constants as K


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """M1: seconds that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def minmax(c: Column, over, inverted: bool = False) -> Column:
    """M2: 0 to 1 within a window; all equal gives 1."""
    x = -c if inverted else c
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.when(c.isNull(), None).when(hi == lo, 1.0).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))


def fused(semantic: Column, bm25: Column, entity: Column, confidence: Column) -> Column:
    """M3: the weighted sum of signals; a missing one is 0."""
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in zip((semantic, bm25, entity, confidence), K.WEIGHTS.values(), strict=True)), F.lit(0.0))


def confidence(avg_logprob: Column) -> Column:
    """M4"""
    return F.coalesce(F.least(F.lit(1.0), F.exp(avg_logprob)), F.lit(0.0))


def clock(seconds: Column, millis: bool = False) -> Column:
    """M5: hh:mm:ss, with comma and milliseconds on demand; negative times are 0."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("int")
    parts = [F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), (whole % 60).cast("int")]
    if millis:
        return F.format_string("%02d:%02d:%02d,%03d", *parts, F.bround((s - whole) * 1000, 0).cast("int"))
    return F.format_string("%02d:%02d:%02d", *parts)


def human(seconds: Column) -> Column:
    """M7: hours and minutes, minutes, or seconds."""
    s = seconds.cast("int")
    h, m = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")
    return F.when(h > 0, F.format_string("%d h %d min", h, m)).when(m > 0, F.format_string("%d min", m)).otherwise(F.format_string("%d s", s))


def estimated_tokens(c: Column) -> Column:
    """M8"""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.floor(F.length(c) / K.CHARS_PER_TOKEN).cast("int") + 1)


def model_key(c: Column) -> Column:
    """M9: the catalogue's name of a model: before any colon, trimmed, lower case."""
    return F.lower(F.trim(F.split(F.coalesce(c, F.lit("")), ":")[0]))


def price(c: Column) -> Column:
    """M9: struct of input and output price and whether the model is catalogued; else the dearest output price."""
    key, top = model_key(c), max(K.PRICES, key=lambda p: p[2])
    out = None
    for name, i, o in K.PRICES:
        s = F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"), F.lit(True).alias("known"))
        out = F.when(key == name, s) if out is None else out.when(key == name, s)
    return out.otherwise(F.struct(F.lit(top[1]).alias("input"), F.lit(top[2]).alias("output"), F.lit(False).alias("known")))


def cost(tokens_in: Column, tokens_out: Column, model: Column, provider: Column) -> Column:
    """Dollars; local providers cost nothing."""
    p = price(model)
    return F.when(provider.isin(*K.LOCAL_PROVIDERS), 0.0).otherwise(tokens_in / 1e6 * p["input"] + tokens_out / 1e6 * p["output"])


def time_factor(model: Column, diarize: Column) -> Column:
    """Hours of work for an hour of audio."""
    out = None
    for name, f in K.TIME_FACTORS:
        out = F.when(model == name, f) if out is None else out.when(model == name, f)
    return out.otherwise(dict(K.TIME_FACTORS)["small"]) + F.when(diarize, K.DIARIZATION_FACTOR).otherwise(0.0)


def unit(v: Column) -> Column:
    """A vector of length one, with a floor under its norm."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(1e-10))
    return F.transform(v, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def per(*keys: str):
    """A window over all rows of the keys."""
    return Window.partitionBy(*keys)
