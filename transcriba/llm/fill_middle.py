"""Fill-in-middle: texts cut in three and put in another order, by one numpy kernel over Arrow's UTF-8 buffers.

A table of 256 classes says what each byte is; the classes of a byte and of the one before it say whether
a unit begins there; the running sum of these marks, less its value where a document begins, numbers the
units of every document; two binary searches in the sum find all cuts of all rows. The three pieces of
each text are views of the same buffer, so nothing is copied before the output is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, named

#: Marks put before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel takes at a time; a longer text is taken alone.
BLOCK_BYTES = 4 << 20

_CONTINUES, _OTHER, _SPACE, _LINE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _CONTINUES
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
#: Whether a unit begins at a byte, by the class of the byte before it and its own.
_BEGINS = {
    "char": np.array([[own != _CONTINUES for own in range(4)] for _ in range(4)]),
    "word": np.array([[before in (_SPACE, _LINE) and own == _OTHER for own in range(4)] for before in range(4)]),
    "line": np.array([[before == _LINE for _ in range(4)] for before in range(4)]),
}

TYPE = "struct<n: bigint, form: string, prefix: bigint, middle: bigint, output: string>"
_ARROW = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64()), ("output", pa.string())])


def cut_batch(texts: pa.StringArray, draws: list[np.ndarray], unit: str, plain_percent: int, spm_percent: int, marks: tuple[str, str, str]) -> pa.StructArray:
    """Units, form, cuts and output of all texts of a batch; draws are the four random integers of each."""
    n = len(texts)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int32, n + 1, texts.offset * 4)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    low, high = int(offsets[0]), int(offsets[-1])
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)

    kind = _CLASS[data[low:high]]
    begins = np.zeros(high - low, bool)
    if high > low:
        begins[1:] = _BEGINS[unit][kind[:-1], kind[1:]]
        begins[start[start < stop] - low] = True  # a document begins a unit of its own
    number = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])  # units that begin before a byte
    base = number[start - low]
    units = (number[stop - low] - base).astype(np.int64)

    a, b = draws[0] % (units + 1), draws[1] % (units + 1)
    prefix, until = np.minimum(a, b), np.maximum(a, b)
    # The byte where unit k + 1 of a document begins is the first whose number, itself counted, exceeds base + k.
    cut1 = np.minimum(np.searchsorted(number[1:], base + prefix, side="right") + low, stop)
    cut2 = np.minimum(np.searchsorted(number[1:], base + until, side="right") + low, stop)

    marked = pc.or_(pc.or_(pc.match_substring(texts, marks[0]), pc.match_substring(texts, marks[1])), pc.match_substring(texts, marks[2]))
    plain = (start == stop) | np.asarray(marked) | (draws[2] % 100 >= 100 - plain_percent)
    spm = ~plain & (draws[3] % 100 < spm_percent)

    edge = np.empty(3 * n + 1, np.int32)
    edge[0:-1:3], edge[1::3], edge[2::3], edge[-1] = start, cut1, cut2, high
    pieces = pa.StringArray.from_buffers(3 * n, pa.py_buffer(edge), raw[2] if raw[2] is not None else pa.py_buffer(b""))
    head, mid, tail = (pieces.take(pa.array(np.arange(k, 3 * n, 3))) for k in range(3))
    p, s, m = marks
    psm = pc.binary_join_element_wise(p, head, s, tail, m, mid, "")
    swapped = pc.binary_join_element_wise(s, tail, p, head, m, mid, "")
    is_plain = pa.array(plain)
    output = pc.if_else(is_plain, texts, pc.if_else(pa.array(spm), swapped, psm))
    form = pc.if_else(is_plain, "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    lengths = [pa.array(x, pa.int64(), mask=plain) for x in (prefix, until - prefix)]
    return pa.StructArray.from_arrays([pa.array(units), form, *lengths, output], fields=list(_ARROW))


def _blocks(texts: pa.StringArray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of a batch that hold at most limit bytes each, or one row."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        out.append((at, to))
        at = to
    return out


def draws(key: Column) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of a string, as integers from 0 to 2^32 - 1."""
    h = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1", marks: tuple[str, str, str] = MARKS, out_col: str = "fim") -> DataFrame:
    """docs with out_col: struct(n, form, prefix, middle, output) of every whole text.

    n counts the text's units: code points ("char"), words with the space after them ("word") or lines with
    their end ("line"). Two draws of 0 to n units cut the text in prefix, middle and suffix; prefix and
    middle are given in units, and are null where form is "plain". Then output is the text: for empty texts, texts
    that hold a mark, and plain_percent of the others. Else it is "spm" (suffix first) for spm_percent of the rest, or "psm".
    Draws come from SHA-256 of "seed:id", so a retried task gives the same rows and rows of one id the same draws.

    A null text counts as empty; a null id draws as the empty id does. Repeated rows and ties stay rows of
    their own; texts of any length are cut whole; an empty table stays empty. Input columns keep their
    values whatever their names, but for one already named out_col: it gives way, so name another.
    """
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != out_col.lower()])

    @F.arrow_udf(TYPE)
    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        texts = text.cast(pa.string())
        numbers = [h.to_numpy() for h in (h1, h2, h3, h4)]
        parts = [cut_batch(texts.slice(a, b - a), [x[a:b] for x in numbers], unit, plain_percent, spm_percent, marks) for a, b in _blocks(texts, BLOCK_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit("")))
    text, drawn = F.coalesce(named(text_col).cast("string"), F.lit("")), draws(key)
    held = [fresh(docs, f"_fim_{k}") for k in range(4)]
    rows = docs.select(*columns(docs), *[d.alias(h) for d, h in zip(drawn, held, strict=True)])
    return rows.select(*columns(docs), cut(text, *[F.col(h) for h in held]).alias(out_col))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from: a text that was cut holds no mark, so the three marks of its output are the only ones."""
    pattern = "|".join(rf"\Q{m}\E" for m in marks)
    part = F.split(output, pattern, 4)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "plain", output).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(psm)
