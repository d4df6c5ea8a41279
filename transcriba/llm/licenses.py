"""Licence scans: canonical digests of entire texts, joined to the digests of known licences.

Native throughout: a text loses case, punctuation, copyright lines and variant spellings, and its
digest meets the known digests in a hash join. Known are the whole texts in the folder license_texts
(named by identifier), each also without its title and without what follows its terms. The same
canonical form of each short line is joined to the digests of known notices, so a notice inside a longer
document is found by its entire line.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

# Identifier, name as notices write it.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Unlicense", "Unlicense"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
)
# How notices name a licence.
NOTICES = ("{0}", "the {0}", "SPDX-License-Identifier: {1}", "License: {1}", "License: {0}") + tuple(f"{lead}{verb} under {art}{{0}}" for lead in ("", "This work is ", "This file is ", "This software is ", "This project is ") for verb in ("licensed", "released", "distributed", "available") for art in ("the ", ""))
# Spellings that count as one, applied to lower-case words in this order.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("https", "http"), ("v 2", "version 2"), ("v 3", "version 3"))

#: Whole lines that only name owners and years, or reserve rights; a line that speaks of copyright notices, laws or holders is none.
COPYRIGHT = r"(?m)^[^\n\p{L}\p{N}]*(?:copyright[^\n\p{L}\p{N}]*(?:c\)|©|[0-9]{4}|year|yyyy|by )|\(c\)[^\n\p{L}\p{N}]*(?:copyright|[0-9]{4}|year|yyyy)|©|all rights reserved[^\n\p{L}\p{N}]*$)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """Lower-case words of each line; copyright lines are blank."""
    t = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), COPYRIGHT, "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def canonical(lines: Column) -> Column:
    """The canonical text of canonical lines: words joined by single spaces, spellings applied across line ends too."""
    t = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    for old, new in ACROSS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


#: Spellings of two words, which a line end may part.
ACROSS = tuple((old, new) for old, new in SPELLINGS if " " in old)


def canonical_text(text: str) -> str:
    """The same form of a known text, on the driver."""
    t = regex.sub(COPYRIGHT, "", text.lower())
    t = regex.sub(r"[^\p{L}\p{N}\n]+", " ", t)
    for old, new in SPELLINGS:
        t = t.replace(old, new)
    t = regex.sub(r"[ \n]+", " ", t).strip(" ")
    for old, new in ACROSS:
        t = t.replace(old, new)
    return t


def _forms(text: str) -> list[str]:
    """A whole text, and the same without its title, and both without what follows its terms."""
    end = text.find("END OF TERMS AND CONDITIONS")
    whole = [text] if end < 0 else [text, text[: end + len("END OF TERMS AND CONDITIONS")], text[:end]]
    bare = []
    for t in whole:
        lead, _, rest = t.strip("\n").partition("\n\n")
        if rest and len(lead) <= 120:
            bare.append(rest)
    return whole + bare


@lru_cache(maxsize=1)
def known_licenses() -> tuple[tuple[str, str], ...]:
    """(SHA-256 of the canonical text, identifier) of all known texts and notices; the first identifier of a text counts."""
    found: dict[str, str] = {}
    for spdx, text in known_texts():
        for form in _forms(text):
            found.setdefault(canonical_text(form), spdx)
    for form, spdx in known_notices():
        found.setdefault(form, spdx)
    return tuple(sorted((hashlib.sha256(k.encode()).hexdigest(), v) for k, v in found.items()))


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of the files of license_texts, whose names begin with the identifier."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.name.removesuffix(".txt").removesuffix(".notice").removesuffix(".regents"), f.read_text(encoding="utf-8")) for f in files]


def known_notices() -> list[tuple[str, str]]:
    """(canonical line, identifier) of how notices name the licences of NAMES."""
    found: dict[str, str] = {}
    for spdx, name in NAMES:
        for form in NOTICES:
            found.setdefault(canonical_text(form.format(name, spdx)), spdx)
    return sorted(found.items())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, text_digest, license (of the entire text, or null), n_notices, notices.

    text_digest is the SHA-256 of the canonical text. notices: identifiers of the lines that are entire
    known notices, distinct, in alphabetical order, comma-joined; n_notices counts such lines. One row
    per input row, repeated rows too; null and empty texts have the digest of the empty string, no
    licence and no notices; texts of any length are read whole; other columns are ignored; an empty
    table gives an empty result. Both joins probe the known digests, a fixed table of some thousand
    rows, which bounds its broadcast; lines of a row come together again by its number, without texts.
    """
    spark: SparkSession = docs.sparkSession
    known = known_licenses() if known is None else known
    ids = sorted({i for _, i in known})
    longest = max((len(k) for k, _ in known_notices()), default=0)
    table = spark.createDataFrame([(d, i, ids.index(i) // 60, 1 << ids.index(i) % 60) for d, i in known], "known string, license string, word int, bit long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), named(id_col).cast("long").alias("doc_id"), canonical_lines(named(text_col)).alias("lines"))
    short = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) <= longest) & (x != ""))
    rows = rows.select("row", "doc_id", F.sha2(canonical(F.col("lines")), 256).alias("text_digest"), short.alias("short"))
    whole = table.select(F.col("known").alias("text_digest"), "license")
    rows = rows.join(F.broadcast(whole), "text_digest", "left")
    lines = rows.select("row", "doc_id", "text_digest", "license", F.explode_outer("short").alias("line")).withColumn("known", F.sha2(F.col("line").cast("binary"), 256))
    lines = lines.join(F.broadcast(table.select("known", "word", "bit")), "known", "left")
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"w{w}") for w in range(len(ids) // 60 + 1)]
    out = lines.groupBy("row", "doc_id", "text_digest", "license").agg(F.count("bit").alias("n_notices"), *words)
    named_ids = [F.when(F.col(f"w{i // 60}").bitwiseAND(F.lit(1 << i % 60)) != 0, F.lit(x)) for i, x in enumerate(ids)]
    notices = F.when(F.col("n_notices") == 0, F.lit("")).otherwise(F.concat_ws(",", *named_ids))
    return out.select("doc_id", "text_digest", "license", "n_notices", notices.alias("notices"))


def license_sql(known: tuple[tuple[str, str], ...] | None = None) -> str:
    """The scan over `documents` in DuckDB's SQL."""
    known = known_licenses() if known is None else known
    values = ", ".join(f"('{d}', '{i}')" for d, i in known)
    longest = max(len(k) for k, _ in known_notices())
    t = rf"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT}', '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    x = r"trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))"
    for old, new in ACROSS:
        x = f"replace({x}, '{old}', '{new}')"
    return rf"""
        WITH known(k, license) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS r, doc_id, {t} AS lines FROM documents),
        l AS (SELECT r, trim(unnest(string_split(lines, chr(10)))) AS line FROM d),
        n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
              FROM l JOIN known ON sha256(line) = k WHERE length(line) <= {longest} AND line <> '' GROUP BY r),
        w AS (SELECT r, doc_id, {x} AS x FROM d)
        SELECT doc_id, sha256(x) AS text_digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
        FROM w LEFT JOIN known ON sha256(x) = k LEFT JOIN n USING (r)
    """
