"""Conversation repair, fill-in-middle, language ID: edge rows and brute-force counterparts."""

import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transcriba.llm import fill_middle as fm
from transcriba.llm import langid as li
from transcriba.llm import repair as rp
from transcriba.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def _against_sql(spark, name, table, rows, path):
    """Rows of the registered query and of its SQL over one table."""
    rows.write.parquet(f"{path}/{table}.parquet")
    df = QUERIES[name](spark, str(path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
        found = db.execute(ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        return Counter(map(tuple, df.select(*names).collect())), Counter(found.fetchall())


# -- conversation repair ----------------------------------------------------------------------------

LEGAL = re.compile("(s?(ua)+)?")


def _least(turns):
    """Least (cost, audit) by trying every sequence of edits with up to two insertions before each turn and at the end."""
    best = None
    for edits in itertools.product("DKR", repeat=len(turns)):
        if any(e != "D" and must for e, (_, must, _) in zip(edits, turns, strict=True)):
            continue
        base = sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and cut) for e, (_, _, cut) in zip(edits, turns, strict=True))
        for ins in itertools.product(range(3), repeat=len(turns) + 1):
            cost = base + 2 * sum(ins)
            audit = "".join("I" * n + e for n, e in zip(ins, (*edits, ""), strict=True))
            if best is not None and (cost, audit) >= best:
                continue
            kinds, at = [], 0
            for e in audit:
                if e in "IR":
                    kinds.append("*")
                elif e == "K":
                    kinds.append(turns[at][0])
                at += e != "I"
            out, want = "", "u"
            for k in kinds:
                out += want if k == "*" else k
                want = "a" if out[-1] == "u" else "u"
            if LEGAL.fullmatch(out):
                best = (cost, audit)
    return best


def test_chart_finds_the_least_repair():
    chart, rng = rp.Chart(), random.Random(4)
    for _ in range(150):
        turns = [(rng.choice("suaut"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        at, taken = chart.first, array("l")
        for t in turns:
            taken.append(chart.step(at, *t))
            at = chart.steps[taken[-1]].to
        assert chart.audit(taken) == _least(turns), turns
    with pytest.raises(ValueError, match="first"):
        rp.Chart((("Conv", ("u", "Conv")),))


def test_repair_of_edge_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
        (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 5, "assistant", "no end"), (2, None, None, None),
        (None, 3, "tool", "Odd!"), (None, 4, "assistant", " \t"),
        (3, None, "user", "x."), (3, None, "assistant", "y?\n"),
        (5, 9, "assistant", "Alone."),
        (6, 0, "system", "S" * 300_000 + "."), (6, 1, "user", "é"), (6, 2, "assistant", "Ok.  "),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"cost": F.lit(1), "c": F.lit(2), "n": F.lit(3)})
    df = df.withColumn("there", F.lit(True)).unionByName(df.limit(1).withColumns({"conv_id": F.lit(4).cast("long"), "there": F.lit(False)}))
    got = {r.conv_id: tuple(r)[1:] for r in rp.repair_conversations(df, present_col="there", held_bytes=1000).collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got == {
        1: (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.", "assistant:Yes.")),
        2: (4, 1, 1, 1, 2, 7, "DKDK", sha("user:Hi.", "assistant:no end")),
        None: (0, 1, 0, 0, 1, 6, "DD", EMPTY),
        3: (0, 0, 0, 0, 0, 4, "IKKI", sha("user:", "assistant:y?\n", "user:x.", "assistant:")),
        4: (0, 0, 0, 0, 0, 0, "", EMPTY),
        5: (0, 0, 0, 0, 0, 2, "IK", sha("user:", "assistant:Alone.")),
        6: (0, 0, 0, 2, 0, 2, "KKK", sha("system:" + "S" * 300_000 + ".", "user:é", "assistant:Ok.  ")),
    }
    assert rp.repair_conversations(df.limit(0)).count() == 0
    dotted = spark.createDataFrame([(1, 0, "user", "a.")], "`c.v` long, turn int, role string, text string")
    assert rp.repair_conversations(dotted, conv_col="c.v").columns[0] == "c.v"


def test_repair_query_equals_its_sql_on_made_up_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for c in [None, *range(120)]:
        for t in range(rng.randrange(1, 12)):
            turn = rng.choice([t, t, t, t + 1, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(["One.", "Two!", "Three", "é?", " ", "", "\t.", "a.\n\n", None, "ß"])))
    got, want = _against_sql(spark, "op11_repair_conversations", "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path)
    assert got == want and len(got) == 121


def test_long_conversation_is_linear(spark):
    """Turns of no known role keep several ways alive to the end; one conversation of 40,000 turns."""
    df = spark.range(40_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    (r,) = rp.repair_conversations(df, held_bytes=1 << 16).collect()
    assert r.cost == 80_000 and r.audit == "R" * 40_000
    lines = "\n".join(f"{('user', 'assistant')[i % 2]}:t{i}." for i in range(40_000))
    assert r.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


# -- fill in the middle -----------------------------------------------------------------------------


def _fim(doc_id, text):
    """The contract, by code points."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in fm.MARKS) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_edge_rows(spark, docs, no_docs):
    more = [(k, t, "en", "a", 1, "x", "y", "z") for k, t in enumerate(["<", "<P", "<P>", "a<S>b", "𝒳é€a" * 50, "\x00\x00", "<P" * 9 + ">", "S><M"] * 12, 100)]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"fim": F.lit(7), "form": F.lit("f"), "_fim_0": F.lit(1), "a.b": F.lit(2)})
    out = fm.fill_in_middle(rows, out_col="cut").withColumn("back", fm.restore(F.col("cut.output"), F.col("cut.form"))).collect()
    assert len(out) == rows.count() and {r.form for r in out} == {"f"} and {r.fim for r in out} == {7}
    for r in out:
        assert tuple(r.cut) == _fim(r.doc_id, r.text or "") and r.back == (r.text or "")
    assert {r.cut.form for r in out} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(no_docs).count() == 0 and "fim" in fm.fill_in_middle(rows).columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=20), st.integers(0, 2**32 - 1))
def test_kernel_cuts_at_units(texts, seed):
    rng = np.random.default_rng(seed)
    drawn = [rng.integers(0, 1 << 32, len(texts)) for _ in range(4)]
    arr = pa.array(["skipped é", *texts], pa.string()).slice(1)
    for unit, split in (("char", list), ("word", lambda t: re.findall(r"^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", t)), ("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t))):
        got = fm.cut_batch(arr, drawn, unit, 0, 50, ("<P>", "<S>", "<M>")).to_pylist()
        for k, text in enumerate(texts):
            units, g = split(text), got[k]
            assert g["n"] == len(units)
            if g["form"] != "plain":
                a, b = sorted(int(d[k]) % (len(units) + 1) for d in drawn[:2])
                p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
                assert g["output"] == (f"<S>{s}<P>{p}<M>{m}" if g["form"] == "spm" else f"<P>{p}<S>{s}<M>{m}") and (g["prefix"], g["middle"]) == (a, b - a)


def test_blocks_hold_all_rows():
    arr = pa.array(["abc", "", "x" * 50, "", "", "yy"])
    assert fm._blocks(arr, 10) == [(0, 2), (2, 3), (3, 6)] and fm._blocks(arr.slice(1, 2), 10) == [(0, 1), (1, 2)]


def test_fill_in_middle_query_equals_its_sql(spark, docs, tmp_path):
    got, want = _against_sql(spark, "op12_fill_in_middle", "documents", docs, tmp_path)
    assert got == want and sum(got.values()) == 12


# -- language ID ------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    out = QUERIES["op13_language_id"](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and len(held) > 30
    assert all(0 <= r.score <= 1 for r in rows)


def _plain_counts(text):
    """Grams by bucket, one at a time."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in (" " + text.lower() + " ").encode())
    data = re.sub(rb" +", b" ", data)
    out = np.zeros(li.BUCKETS, np.int64)
    for k in range(li.LONGEST):
        for i in range(len(data) - k):
            packed = int.from_bytes(data[i : i + k + 1], "big")
            out[((packed * 0x9E3779B1 + k * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - 13)] += 1
    return out


def test_counts_equal_plain_counts():
    texts = ["Der Hund, die  Katze!", "", "  ", "a", "Ünï 12 x-y\n", "日本"]
    got = li.count_grams([t.lower().encode() for t in texts])
    assert all((got[k] == _plain_counts(t)).all() for k, t in enumerate(texts))
    blocks = list(li._counted(["ab " * 700_000, *texts]))
    assert [b[:2] for b in blocks] == [(0, 1), (1, 7)] and (blocks[1][2] == got).all()
    assert abs(int(blocks[0][2].sum()) - 4 * 1_400_000 * 3 // 2) < 40


def test_families_come_first_and_pairs_vote():
    assert [li.family_of(x) for x in ("de", "EN-us", "pt_BR", "eu")] == ["germanic", "germanic", "romance", "eu"]
    rng, words = random.Random(2), {"de": "der die und ist nicht ein", "nl": "de het en niet een van", "fr": "le la et est pas un", "es": "el la y es no un", "it": "il la e non un di", "eu": "eta da ez bat hau"}
    texts = [(lang, " ".join(rng.choices(own.split(), k=12))) for lang, own in words.items() for _ in range(30)]
    counts = np.vstack([b[2] for b in li._counted([t for _, t in texts])])
    model = li.fit_languages(counts, [lang for lang, _ in texts])
    assert set(model.families) == {"germanic", "romance", "eu"} and model.weights.shape == (li.BUCKETS, 3 + 1 + 3)
    got, score = model.predict(counts)
    assert sum(a == b for a, (b, _) in zip(got, texts, strict=True)) >= 175 and ((score >= 0) & (score <= 1)).all()


def test_language_edge_rows(spark, docs, no_docs):
    model = li.train_languages(docs)
    assert set(sum(model.families.values(), [])) <= {"en", "de"}
    digits = spark.createDataFrame([(50, "12 !?", "en", "a", 1, "x", "y", "z")], docs.schema)
    rows = docs.unionByName(digits).withColumns({"score": F.lit(5), "_language": F.lit(6), "language": F.lit(7)})
    out = li.predict_languages(rows, model, out_col="guess").collect()
    assert len(out) == 13 and {r.score for r in out} == {5} and {r.language for r in out} == {7}
    for r in out:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert tuple(r.guess) == ("und", 0.0)
        else:
            assert r.guess.lang in ("en", "de") and 0 <= r.guess.score <= 1
    same = defaultdict(set)
    for r in out:
        same[r.text].add(tuple(r.guess))
    assert all(len(v) == 1 for v in same.values())
    nothing = li.train_languages(no_docs)
    assert nothing.families == {} and {r.language.lang for r in li.predict_languages(docs, nothing).collect()} == {"und"}
    one = li.train_languages(docs.where("lang = 'en'"))
    assert {r.language.lang for r in li.predict_languages(docs, one).collect()} == {"en", "und"}
    assert li.predict_languages(no_docs, model).count() == 0


def test_languages_are_learnt_from_rows_not_held_out_alone(spark):
    """Held-out rows with another language and fit limits leave the model as it is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = li.train_languages(docs)
    b = li.train_languages(docs.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert a.families == b.families and np.array_equal(a.weights, b.weights)
    few = li.train_languages(docs, fit_rows=5, fit_languages_most=2)
    assert len(sum(few.families.values(), [])) == 2
