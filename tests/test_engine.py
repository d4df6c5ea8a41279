"""Registered queries against their SQL, and literal cases of the functions and operators."""


import unicodedata
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from transcriba.functions import numbers as N
from transcriba.functions import text as T
from transcriba.operators import answers, catalogue, clustering, documents, exports, glossary, intervals, labels, readings, search, states
from transcriba.plans import registry
from transcriba.sources import tables
from transcriba.streaming import segments as stream

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for k in df:
        df[k] = df[k].map(lambda v: "<null>" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else repr(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(_norm(got), _norm(want))


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.clean_for_reading, "Eh, yo creo que sí", "Yo creo que sí"),
        (T.clean_for_reading, "la la casa de mi madre", "La casa de mi madre"),
        (T.clean_for_reading, "Hola  ,  mundo..", "Hola, mundo."),
        (T.is_hallucination, "Gracias por ver el video. Gracias por ver el video.", True),
        (T.is_hallucination, "Sí.", False),
        (T.is_hallucination, "", False),
        (T.discourse_type, "¿Y esto? No sé.", "pregunta"),
        (T.discourse_type, "Se define como el conjunto de reglas.", "definicion"),
        (T.discourse_type, "Por ejemplo, una casa.", "ejemplo"),
        (T.discourse_type, "En conclusión, llueve.", "resumen"),
        (T.discourse_type, "Llueve.", "exposicion"),
        (T.normalize_label, " García Márquez ", "garcia marquez"),
        (T.normalize_ocr, "Canción, 2020!", "CANCION 2020"),
        (T.name_key, "Carla Ulloa", "CARLAULLOA"),
        (T.strip_edges, "TE SOLEDAD BIANCHI —", "SOLEDAD BIANCHI"),
        (T.looks_like_name, "Juan de Dios", True),
        (T.looks_like_name, "Confiesó que he vivido", False),
        (T.looks_like_name, "Pablo Neruda, 1974", False),
        (T.is_credit, "Fundación Pablo Neruda", True),
        (T.useful_token, "1974", True),
        (T.useful_token, "12", False),
        (T.iso_date, "20240131", "2024-01-31"),
        (T.iso_date, "2024", None),
        (lambda c: F.array_join(T.spoken_names(c), "|"), "hola, yo soy Ana María Pérez y mi nombre es Ana", "Ana|Ana María Pérez"),
        (lambda c: F.array_join(T.url_list(c), "|"), " http://a \nx\nhttp://a\nHTTPS://b", "http://a|HTTPS://b"),
        (lambda c: F.array_join(T.cited(c, 3).cast("array<string>"), ","), "[1], [4], [1], [2]", "1,2"),
        (lambda c: F.array_join(T.capitalised_entities(c), ","), "Pablo y pablo Neruda, Pablo. La", "Pablo,Neruda"),
        (N.estimated_tokens, "", 0),
        (N.estimated_tokens, "x" * 400, 101),
    ],
)
def test_text_functions(spark, f, value, want):
    assert _one(spark, value, f) == want


@pytest.mark.parametrize(("lines", "want"), [(["CARLA ULLOA", "HISTORIADORA UNAM"], ("CARLA ULLOA", "HISTORIADORA", "UNAM")), (["Canto General", "Pablo Neruda, 1950"], None), (["FUNDACIÓN PABLO NERUDA"], None), ([], None)])
def test_read_label(spark, lines, want):
    got = _one(spark, lines, T.read_label, "array<string>")
    assert (tuple(got) if got else None) == want


def test_read_citation(spark):
    assert tuple(_one(spark, ["Canto General", "Pablo Neruda", "1950"], T.read_citation, "array<string>")) == ("Canto General", "Pablo Neruda", "1950")
    assert _one(spark, ["CARLA ULLOA", "HISTORIADORA"], T.read_citation, "array<string>") is None


@pytest.mark.parametrize(("s", "ms", "want"), [(0.0, False, "00:00:00"), (3725.0, False, "01:02:05"), (9.25, True, "00:00:09,250"), (-3.0, False, "00:00:00")])
def test_clock(spark, s, ms, want):
    assert _one(spark, s, lambda c: N.clock(c, ms), "double") == want


def _segments(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), f"t{i}", s) for i, (a, b, s) in enumerate(rows)], "video_id long, segment_id long, start_time double, end_time double, text string, speaker string")


@pytest.mark.parametrize(
    ("segs", "turns", "want"),
    [
        ([(0, 10, None)], [(0, 3, "S00"), (3, 10, "S01")], ["S01"]),
        ([(0, 5, None), (20, 20.4, None), (30, 35, None)], [(0, 5, "S00"), (30, 35, "S00")], ["S00", "S00", "S00"]),
        ([(0, 1, None), (10, 15, None)], [(10, 15, "S00")], [None, "S00"]),
        ([(0, 1, "kept")], [], ["kept"]),
        ([(290, 610, None)], [(0, 300, "a"), (301, 620, "b")], ["b"]),
    ],
)
def test_assign_speakers(spark, segs, turns, want):
    t = spark.createDataFrame([(1, float(a), float(b), s) for a, b, s in turns], "video_id long, start_time double, end_time double, speaker string")
    assert [r.speaker for r in intervals.assign_speakers(_segments(spark, segs), t).orderBy("segment_id").collect()] == want


def test_runs_and_utterances(spark):
    s = _segments(spark, [(0, 2, "a"), (2, 2.3, None), (2.3, 5, "a")])
    assert [(r.start_time, r.end_time) for r in intervals.merge_runs(s).collect()] == [(0, 5)]
    long = _segments(spark, [(10 * i, 10 * i + 9, "a") for i in range(30)])
    u = intervals.utterances(long, max_s=90.0).orderBy("start_time").collect()
    assert len(u) > 1 and sum((r.segment_ids for r in u), []) == list(range(30)) and " ".join(r.text for r in u) == " ".join(f"t{i}" for i in range(30))
    two = _segments(spark, [(0, 2, "a"), (400, 402, "a")])
    assert intervals.utterances(two).count() == 1 and intervals.utterances(two, pause=60.0).count() == 2
    cut = intervals.segment_chunks(_segments(spark, [(0, 6, None), (6.5, 12, None), (20, 26, None), (26.5, 32, None)]), 2.0, 10.0, 60.0)
    assert [r.chunk for r in cut.orderBy("segment_id").collect()] == [0, 0, 1, 1]
    assert intervals.segment_chunks(_segments(spark, [(0, 2, None), (50, 52, None)]), 2.0, 10.0, 60.0).agg(F.max("chunk")).first()[0] == 0


def test_search_pieces(spark):
    chunks = spark.createDataFrame([(1, "la canción de la nación", ""), (2, "otra cosa", ""), (3, "", "")], "chunk_id long, full_text string, summary string")
    hits = search.bm25(chunks, spark.createDataFrame([(1, "cancion"), (2, "!!")], "query_id long, query string")).collect()
    assert [(h.query_id, h.chunk_id) for h in hits] == [(1, 1)] and hits[0].bm25 < 0
    r = spark.createDataFrame([(1, s, c, p) for s, o in enumerate(("abc", "bac")) for p, c in enumerate(o)], "query_id long, source int, chunk_id string, pos int")
    assert search.rrf(r).orderBy(F.desc("rrf")).collect()[-1].chunk_id == "c"


def test_fusion_literal(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, -5.0), (1, "b", 0.1, -3.0)], "query_id long, chunk_id string, semantic double, bm25 double")
    out = search.fuse(rows.drop("bm25"), rows.drop("semantic"), spark.createDataFrame([(1, "a", 1.0)], "query_id long, chunk_id string, entity double"), spark.createDataFrame([("a", 0.8), ("b", 0.6)], "chunk_id string, confidence double"), 10)
    assert {r.chunk_id: round(r.score, 6) for r in out.collect()} == {"a": 0.98, "b": 0.06}


def test_catalogue(spark):
    names = spark.createDataFrame([(n,) for n in ("CARLA ULLOA", "ULLOA", "CARLA ULL", "CARLAULLOA", "SOLEDAD BIANCHI")], "name string")
    got = {r.name: r.canonical for r in labels.canonical_names(names).collect()}
    assert got == {n: "CARLA ULLOA" for n in ("CARLA ULLOA", "ULLOA", "CARLA ULL", "CARLAULLOA")} | {"SOLEDAD BIANCHI": "SOLEDAD BIANCHI"}
    turns = spark.createDataFrame([(1, 200.0, 260.0, "S01"), (1, 300.0, 420.0, "S02")], "video_id long, start_time double, end_time double, speaker string")
    shown = spark.createDataFrame([(1, 0, 205.0, 211.0, ["CARLA ULLOA", "HISTORIADORA"])], "video_id long, label_ord int, start_time double, end_time double, lines array<string>")
    by = {r.speaker: r for r in labels.identities(turns, shown).collect()}
    assert by["S01"].confidence == "ALTO" and by["S01"].name == "CARLA ULLOA" and by["S02"].off_screen
    read = spark.createDataFrame([(1, 0, float(i), t, 0.9, 1) for i, t in enumerate(("SOLEDAD BIANCHI", "TE SOLEDAD BIANCHI", "IANCHI", "SOLEDAD BIANCHI"))] + [(1, 1, 9.0, "SOLO", 0.9, 1)], "video_id long, session int, t double, text string, conf double, y int")
    fam = labels.label_families(read).collect()
    assert [(f.text, f.sightings) for f in fam] == [("SOLEDAD BIANCHI", 4)]


def test_clusters_and_glossary(spark):
    x = np.array([[1, 0], [0.99, 0.05], [0, 1], [0.02, 1]])
    assert clustering.average_linkage(x, 0.75).tolist() == [0, 0, 1, 1] and clustering.average_linkage(x[:1], 0.75).tolist() == [0]
    rows = spark.createDataFrame([(1, float(i), i + 1.0, v) for i, v in enumerate(x.tolist())] + [(2, 0.0, 0.1, [1.0, 0.0])], "video_id long, start_time double, end_time double, embedding array<double>")
    assert clustering.cluster_voices(rows).count() == 4
    clipped = clustering.cluster_voices(spark.createDataFrame([(1, 5.0, 90.0, [1.0, 0.0])], "video_id long, start_time double, end_time double, embedding array<double>")).first()
    assert clipped.end_time == 35.0
    names = spark.createDataFrame([("Roberto Bolaño",), ("Soledad Bianchi",), ("Estravagario",), ("Año",)], "name string")
    cases = ["¿Y Bolano? Sí, Bolano.", "Bianchy", None, "BOLANO y bolano", "Bolaño bolaño", "Bianchy, Bianchy y bianchy", "estravagário", "Ano nuevo", "Boliviano"]
    r = {x.n: x for x in glossary.correct_terms(spark.createDataFrame(list(enumerate(cases)), "n int, text string"), names).collect()}
    assert [r[i].corrected for i in range(9)] == ["¿Y Bolaño? Sí, Bolaño.", "Bianchy", "", "BOLAÑO y bolaño", "Bolaño bolaño", cases[5], "estravagario", "Ano nuevo", "Boliviano"]
    assert r[0].changes == ["Bolano→Bolaño"] * 2 and r[3].changes == ["BOLANO→BOLAÑO", "bolano→bolaño"] and not r[4].changes
    assert r[1].suggestions == ["Bianchy→Bianchi"] == r[5].suggestions and not r[8].suggestions and r[2].text is None
    assert not any(x.changes or x.suggestions for x in glossary.correct_terms(spark.createDataFrame([("Bolano",)], "text string"), names.limit(0)).collect())
    assert glossary.reading_text(spark.createDataFrame([("Bolano",)], "text string"), names).first().reading.startswith("Bolaño")


def test_semantic_cuts(spark):
    """W1 rule 4 against a walk over each video; the encoder sees the texts of both windows."""
    import random

    def encode(texts):
        return [[len(t) % 7 - 3, t.count("a") + 1] for t in texts]

    rng, rows = random.Random(5), []
    for v in range(30):
        at = 0.0
        for i in range(rng.randrange(1, 40)):
            at += rng.choice([0, 0, 0.5, 3.0])
            rows.append((v, i, at, at + 4.0, "".join(rng.choice("ab ") for _ in range(rng.randrange(12))), rng.choice(["x", "x", "x", None])))
            at += 4.0
    want = {}
    for v in range(30):
        own = [r for r in rows if r[0] == v]
        start = chunk = 0
        for i, r in enumerate(own):
            want[v, r[1]] = chunk
            if i == len(own) - 1:
                break
            n, spans = own[i + 1], r[3] - own[start][2]
            cut = spans >= 60 or (n[2] - r[3] > 2 and spans >= 12) or r[5] != n[5]
            if not cut and spans >= 12:
                (a, b), (c, d) = encode([" ".join(t for x in part if (t := x[4].strip())) for part in (own[max(start, i - 3) : i + 1], own[i + 1 : i + 5])])
                cut = (a * c + b * d) / ((a * a + b * b) * (c * c + d * d)) ** 0.5 < 0.55
            if cut:
                start, chunk = i + 1, chunk + 1
    frame = spark.createDataFrame(rows, "video_id long, segment_id long, start_time double, end_time double, text string, speaker string")
    got = {(r.video_id, r.segment_id): r.chunk for r in intervals.semantic_chunks(frame, encode, 2.0, 12.0, 60.0).collect()}
    assert got == want
    plain = {(r.video_id, r.segment_id): r.chunk for r in intervals.segment_chunks(frame, 2.0, 12.0, 60.0).collect()}
    assert plain != want and {(r.video_id, r.segment_id): r.chunk for r in intervals.semantic_chunks(frame, lambda texts: [[1.0]] * len(texts), 2.0, 12.0, 60.0).collect()} == plain


def test_review_list(spark):
    seg = spark.createDataFrame([(1, float(i), i + 1.0, 0.01 * i, f" t{i} ") for i in range(70)], "video_id long, start_time double, end_time double, confidence double, text string")
    who = spark.createDataFrame([(1, "A", None, "", True, 60.0, 5.0, 9.0, []), (1, "B", None, "", False, 30.0, 1.0, 2.0, []), (1, "C", "Ana", "MEDIO", False, 30.0, 3.0, 4.0, ["e1", "e2"]), (1, "D", "Eva", "ALTO", False, 9.0, 3.0, 4.0, [])], "video_id long, speaker string, name string, confidence string, off_screen boolean, spoken_s double, first_s double, last_s double, evidence array<string>")
    quotes = spark.createDataFrame([(1, 8.0, "T", None, None), (1, 2.0, "U", "W", "1999")], "video_id long, start_time double, title string, author string, year string")
    gone = spark.createDataFrame([(1, 4.0, "x" * 200)], "video_id long, start_time double, text string")
    hints = spark.createDataFrame([(1, "Bianchy→Bianchi"), (1, "Bianchy→Bianchi"), (1, "Ana→Anna")], "video_id long, hint string")
    got = exports.review_list(seg, who, quotes, gone, hints).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, len(got) + 1)) and {r.issues for r in got} == {len(got)}
    kinds = [r.issue for r in got]
    assert kinds == ["voice without name"] * 2 + ["name in doubt"] + ["text read aloud"] * 2 + ["probably invented"] + ["name to correct"] * 2 + ["low confidence"] * 25
    assert [(r.what, r.note) for r in got[:3]] == [("A", "off-screen voice"), ("B", "no clear function"), ("Ana", "MEDIO: e1; e2")]
    assert [r.what for r in got[3:5]] == ["T", "U"] and got[5].note == "x" * 160 and [r.what for r in got[6:8]] == ["Ana→Anna", "Bianchy→Bianchi"]
    assert [r.note for r in got[8:]] == [f"t{i}" for i in range(25)] and got[8].at_s == 0.0
    assert exports.review_list(seg.limit(0), who.where("name = 'Eva'")).count() == 0


def test_documents(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.1, "x", None), (1, 0.2, 0.7, "y", 0.1)], "video_id long, start_time double, end_time double, text string, confidence double")
    assert documents.low_confidence(rows).count() == 1
    m = spark.createDataFrame([(1, "T")], "video_id long, title string")
    c = spark.createDataFrame([(1, 5, 1.0, 2.0, "b"), (1, 4, 0.0, 1.0, "a")], "video_id long, chunk_id long, start_time double, end_time double, full_text string")
    assert documents.corpus_json(m, c).first().json.index('"a"') < documents.corpus_json(m, c).first().json.index('"b"')


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "m/sub").mkdir(parents=True)
    (tmp_path / "m/a.MP4").write_bytes(b"1")
    (tmp_path / "m/sub/b.txt").write_bytes(b"2")
    assert [r.title for r in tables.media_folder(spark, str(tmp_path / "m")).collect()] == ["a"]
    with pytest.raises(NotADirectoryError):
        tables.media_folder(spark, str(tmp_path / "none"))
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.json").write_text('{"video_id":1,"segment_id":1,"start_time":0.0,"end_time":7.5}\nbroken{\n')
    (tmp_path / "s/2.json").write_text('{"video_id":1,"segment_id":2,"start_time":8.0,"end_time":9.5}\n')
    for _ in range(2):
        stream.append_segments(stream.read_segments(spark, str(tmp_path / "s")), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 2 and stream.resume_points(got).first().resume_s == 9.5
    assert tables.json_document(spark, str(tmp_path / "absent.json"), "a long").count() == 0
    done = stream.process_each(spark.createDataFrame([("1",), ("x",)], "v string"), lambda v: str(int(v)), "v").collect()
    assert [r.done for r in done] == [True, False] and "ValueError" in done[1].error
    assert stream.next_state("pending", True) == "transcribing" and stream.next_state("indexing", False) == "failed"


def test_answers(spark):
    v = spark.createDataFrame([("hola",), (None,)], "x string").select(answers.hash_embedding(F.col("x")).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 and len(r.v) == 8 for r in v)
    q = spark.createDataFrame([(1, "¿qué?"), (2, "¿nada?")], "question_id long, question string")
    ev = spark.createDataFrame([(1, 1, "T", 5.0, 9.0, "texto")], "question_id long, rank int, title string, start_time double, end_time double, text string")
    got = {r.question_id: r for r in answers.ask(q, ev, lambda system, user: "[1] [7]" if user.startswith('PREGUNTA: ¿qué?\n\nEVIDENCIA:\n[1] «T»') else "?").collect()}
    assert got[1].cited == [1] and got[1].grounded and got[2].answer == answers.NO_EVIDENCE and not got[2].grounded
    e = ev.groupBy("question_id").agg(F.collect_list(F.struct("title", "start_time")).alias("e"))
    assert e.select(answers.sources_list(F.col("e"), F.array().cast("array<int>")).alias("s")).first().s == "1. T 00:00:05 (no citada)"
    s = spark.createDataFrame([([0, 16384, -32768, 5],)], "a array<int>").select(answers.audio_slice(F.col("a"), F.lit(0.5), F.lit(1.5), 2).alias("s"), answers.audio_slice(F.col("a"), F.lit(9.0), F.lit(9.5), 2).alias("t")).first()
    assert s.s == [0.5, -1.0] and s.t == []
    runs = spark.createDataFrame([(0.0, 5.0)], "duration_s double, work_s double")
    assert answers.calibrated_factor(runs, "tiny").first().factor == 0.10


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("a/b?", "x"), ("c", "y")], "name string, content string")
    exports.write_documents(docs, str(tmp_path / "out"), "name", "content")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"file=a_b_", "file=c"}
    labels = spark.createDataFrame([(1, 85.0, ["PRODUCCION"]), (1, 90.0, ["Ana Perez"]), (1, 95.0, ["MUSICA"])], "video_id long, start_time double, lines array<string>")
    assert exports.content_end(labels, spark.createDataFrame([(1, 100.0)], "video_id long, duration_seconds double")).first().end_s == 95.0


def test_state_changes(spark):
    v = spark.createDataFrame([(1, "m", 3, True), (2, "n", 3, False)], "version_id long, model_name string, dimensions int, is_active boolean")
    assert {(r.version_id, r.is_active) for r in states.activate_version(v, "m", 3).collect()} == {(1, True), (2, False)}
    # A model that was active before gets another version.
    assert {(r.version_id, r.model_name, r.is_active) for r in states.activate_version(v, "n", 4).collect()} == {(1, "m", False), (2, "n", False), (3, "n", True)}
    assert [r.version_id for r in states.activate_version(v.limit(0), "a", 2).collect()] == [1]
    who = spark.createDataFrame([(1, "A", " Ana ", "ALTO"), (1, "B", "", "ALTO"), (1, "C", None, "ALTO"), (1, "D", "Eva", "MEDIO")], "video_id long, speaker string, name string, confidence string")
    assert [(r.speaker_label, r.display_name) for r in states.accepted_names(who, states.accepted_by_default(F.col("name"), F.col("confidence"))).collect()] == [("A", "Ana")]
    m = spark.createDataFrame([(1, "p", "completed"), (2, None, "pending")], "video_id long, project_id string, processing_status string")
    assert [r.video_id for r in states.completed(m).collect()] == [1]
    assert states.pick(m, m.limit(0), "video_id").count() == 0
    projects, free = states.delete_projects(m.select("project_id").where("project_id is not null"), m, spark.createDataFrame([("p",)], "project_id string"))
    assert projects.count() == 0 and free.columns == m.columns and free.where("project_id is null").count() == 2


def test_readings(spark):
    label = spark.createDataFrame([(["SOLEDAD BIANCHI", "Crítica literaria"], "critica LITERARIA x"), (["ANA"], "otra"), ([], "otra")], "lines array<string>, read string")
    assert [r.b for r in label.select(readings.best_line(F.col("lines"), F.col("read")).alias("b")).collect()] == ["Crítica literaria", None, None]
    words = [("1973", True), ("12", False), ("—", False), ("V'1", False), ("de", True), (None, False), (" ", False)]
    for text, want in words:
        assert _one(spark, text, readings.useful_word) == want
    rows = spark.createDataFrame([(0.9, 3, ["a"]), (0.9, 2, ["a"]), (0.8, 3, ["a"]), (0.9, 3, ["a", "b" * 46])], "confidence double, sightings int, lines array<string>")
    assert readings.learnable(rows).count() == 1
    assert _one(spark, "/a b/ñ*~.mp4", T.resource_uri) == "file:///a%20b/%C3%B1%2A~.mp4" and _one(spark, "a b", T.resource_uri) == "a b"
    assert _one(spark, "", T.split_speakers) == [] and _one(spark, "A,B", T.split_speakers) == ["A", "B"]
    assert _one(spark, [], T.joined_speakers, "array<string>") is None


@pytest.mark.parametrize(("value", "want"), [("Thế ǎ ά", "the a α"), ("ﬁn ＡＢｃ ½", "fin abc 1⁄2"), ("Ñandú…", "nandu..."), ("дом й", "дом и"), ("が", "か")])
def test_fold_beyond_latin(spark, value, want):
    assert _one(spark, value, T.normalize_label) == want
    assert want == "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))


def test_containment_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = {(int(rng.integers(3)), "".join(rng.choice(list("abcd é"), rng.integers(0, 9)))) for _ in range(400)}
    frame = spark.createDataFrame([(s, k, len(k) % 3) for s, k in rows] + [(0, None, 1)], "s int, k string, seat int")
    got = {(r.s, r.k): r["head"] for r in labels.containment(frame, "k", "seat", ("s",)).collect()}
    want = {}
    for s, k in rows:
        if k:
            over = [x for t, x in rows if t == s and k in x and len(x) > len(k)]
            want[s, k] = min(over, key=lambda x: (-len(x), len(x) % 3, x.encode()), default=k)
    assert got == want


def test_stable_labels(spark):
    read = [(1, float(i), t, 0.9 if i else 0.6, 40) for i, t in enumerate(("SOLEDAD BIANCHI", "TE SOLEDAD BIANCHI", "IANCHI"))]
    read += [(1, 2.0, "POETA", 0.8, 60), (1, 3.0, "POETA,", 0.8, 61), (1, 9.0, "x", 0.9, 1), (1, 30.0, "RUIDO", 0.9, 1)]
    (r,) = labels.stable_labels(spark.createDataFrame(read, "video_id long, t double, text string, conf double, y int")).collect()
    assert (r.start_time, r.end_time, r["lines"], r.sightings) == (0.0, 9.0, ["SOLEDAD BIANCHI", "POETA,"], 3) or r["lines"] == ["SOLEDAD BIANCHI", "POETA"]
    assert abs(r.confidence - (0.8 + 0.8) / 2) < 1e-9


def test_identities_by_labels_and_speech(spark):
    turns = spark.createDataFrame([(1, 0.0, 50.0, "S00"), (1, 50.0, 100.0, "S01"), (1, 100.0, 150.0, "S02"), (1, 150.0, 250.0, "S03")], "video_id long, start_time double, end_time double, speaker string")
    rows = [(1, 0, 5.0, 8.0, ["CARLA ULLOA", "HISTORIADORA UDP"], 0.9, 4), (1, 1, 20.0, 23.0, ["CARLA ULL"], 0.8, 2), (1, 2, 60.0, 63.0, ["PABLO ROJAS", "POETA"], 0.9, 3), (1, 3, 70.0, 72.0, ["CARLAULLOA"], 0.9, 2)]
    shown = spark.createDataFrame(rows, "video_id long, label_ord int, start_time double, end_time double, lines array<string>, confidence double, sightings long")
    spoken = spark.createDataFrame([(1, 7, 101.0, "Hola, yo soy Ana Mora y más"), (1, 8, 120.0, "mi nombre es Eva"), (1, 9, 10.0, "yo soy Carla")], "video_id long, segment_id long, start_time double, text string")
    by = {r.speaker: r for r in labels.identities(turns, shown, spoken).collect()}
    shared = "«CARLA ULLOA» aparece atribuido a 2 voces distintas (S00, S01): revisar si la separación de voces partió a la misma persona"
    assert (by["S00"].name, by["S00"].role, by["S00"].institution, by["S00"].confidence) == ("CARLA ULLOA", "HISTORIADORA", "UDP", "MEDIO")
    assert by["S00"].evidence == ["Rótulo en pantalla [00:00:05]: «CARLA ULLOA / HISTORIADORA UDP» (leído 4 veces, OCR 90%)", "Rótulo repetido [00:00:20] confirma el nombre", shared, "Mención verbal [00:00:10]: se nombra a «Carla» (no altera la identificación visual)"]
    assert by["S01"].evidence == ["Rótulo en pantalla [00:01:00]: «PABLO ROJAS / POETA» (leído 3 veces, OCR 90%)", "CONFLICTO: otro rótulo [00:01:10] dice «CARLA ULLOA» sobre esta misma voz", shared]
    assert (by["S02"].name, by["S02"].confidence, len(by["S02"].evidence)) == ("Ana Mora", "MEDIO", 2) and by["S02"].evidence[0] == "Mención verbal [00:01:41]: se nombra a «Ana Mora»"
    assert by["S03"].off_screen and by["S03"].confidence == "BAJO" and by["S03"].evidence[0].startswith("Habla 2 min repartidos")


def test_live_videos_end_resume_and_time_out(spark, tmp_path):
    kinds = "video_id long, segment_id long, start_time double, end_time double, text string, speaker string, status string, at timestamp"

    def arrive(rows):
        df = spark.createDataFrame(rows, kinds.replace("at timestamp", "sec long")).withColumn("at", F.timestamp_seconds(F.col("sec") + 86400)).drop("sec")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream.run_available(stream.live_utterances(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), pause=2.0, max_s=6.0, late="1 second", idle_s=100), f"{tmp_path}/out", f"{tmp_path}/check")

    def found():
        return {(r.video_id, r.kind, r.speaker, r.start_time, r.end_time, r.text, r.n, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    arrive([(1, 0, 0.0, 1.0, " a ", "A", None, 1), (1, 1, 1.0, 2.0, None, "A", None, 2), (2, 0, 0.0, 1.0, "x", None, None, 2)])
    arrive([(1, 1, 1.0, 2.0, "again", "A", None, 3), (1, 2, 2.0, 3.0, "b", "A", None, 3), (1, 3, 9.0, 16.0, "c", "A", None, 4), (1, 4, 16.0, 17.0, "d", "A", None, 5)])
    assert found() == {(1, "utterance", "A", 0.0, 3.0, "a b", 3, None), (1, "utterance", "A", 9.0, 16.0, "c", 1, None)}
    arrive([(1, None, None, None, None, None, "completed", 6), (1, 5, 17.0, 18.0, "late", "A", None, 7), (3, 0, 0.0, 1.0, "z", "Z", None, 900)])
    arrive([(3, 1, 1.0, 2.0, "z", "Z", None, 901)])
    rest = found() - {(1, "utterance", "A", 0.0, 3.0, "a b", 3, None), (1, "utterance", "A", 9.0, 16.0, "c", 1, None)}
    assert {(1, "utterance", "A", 16.0, 17.0, "d", 1, None), (1, "status", None, None, 17.0, None, 5, "completed")} <= rest
    assert {(2, "utterance", None, 0.0, 1.0, "x", 1, None), (2, "status", None, None, 1.0, None, 1, "failed")} <= rest
    assert [stream.moved(a, b) for a, b in (("pending", "indexing"), ("indexing", "segmenting"), ("completed", "failed"), ("segmenting", "failed"))] == ["indexing", "indexing", "completed", "failed"]


def test_folds_are_linear(spark):
    """One video of 200,000 rows: chunks of 25 s, utterances of 90 s, frames every 5 s."""
    t = F.col("id") * 2.0
    rows = spark.range(200_000).select(F.lit(1).alias("video_id"), F.col("id").alias("segment_id"), t.alias("start_time"), (t + 1.5).alias("end_time"), F.lit("a").alias("speaker"), F.lit("hola").alias("text"))
    chunks = intervals.segment_chunks(rows, 2.0, 12.0, 25.0).groupBy("chunk").count().collect()
    assert len(chunks) == 15385 and max(r["count"] for r in chunks) == 13
    said = intervals.utterances(rows, 8.0, 90.0).select(F.size("segment_ids").alias("n")).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in said} == {46: 4347, 38: 1}
    assert intervals.sample_frames(rows.select("video_id", F.col("start_time").alias("t"), F.lit(1.0).alias("luma")), 5.0).count() == 66667


def test_containment_deals_large_scopes_into_cells(spark, monkeypatch):
    """Scopes of many blocks, line feeds and a null scope: equal to all pairs; a text stands in as many cells as its scope has blocks on either side."""
    rng = np.random.default_rng(3)
    texts = [(s, "".join(rng.choice(list("AB\n"), rng.integers(1, 9))), int(i)) for s in ("x", "y", None) for i in range(120)]
    frame = spark.createDataFrame(texts, "s string, k string, seat int")
    monkeypatch.setattr(labels, "BLOCK_CHARS", 150)
    got = {(r.s, r.k): (r["head"], r.seat) for r in labels.containment(frame, "k", "seat", ("s",)).collect()}
    least: dict = {}
    for s, k, i in texts:
        least[s, k] = min(i, least.get((s, k), i))
    want = {(s, k): min(((-len(h), i, h) for (t, h), i in least.items() if t == s and k in h)) for s, k in least}
    assert got == {key: (h, i) for key, (_, i, h) in want.items()}


def test_label_families_read_their_readings_once(spark):
    """Neither the lines of a screen nor their substrings are made again by each branch of the plan."""
    read = spark.createDataFrame([(1, 0, float(i), "ANA LUZ DIAZ"[i % 3 :], 0.9, i) for i in range(9)], "video_id int, session int, t double, text string, conf double, y int")
    plan = labels.label_families(read)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1
    assert "LogicalRDD" not in plan


def test_families_do_not_hang_on_the_order_of_rows(spark):
    """Spellings of one folded form are one family, and its confidence has the same last digits in whatever order and parts its readings come."""
    read = [(1, 0, float(i), t, c, 10 + i) for i, (t, c) in enumerate(zip(("Of Anlyer.", "of. Anlyer.", "of. Anlyer."), (0.1, 0.2, 0.3), strict=True))]
    kinds = "video_id int, session int, t double, text string, conf double, y int"
    frames = [spark.createDataFrame(r, kinds).coalesce(n) for r in (read, read[::-1], read[1:] + read[:1]) for n in (1, 3)]
    got = {(r.text, r.sightings, r.confidence, r.y) for f in frames for r in labels.label_families(f).collect()}
    assert len(got) == 1
    ((text, sightings, confidence, y),) = got
    assert (text, sightings, y) == ("Anlyer.", 3, 10) and abs(confidence - 0.2) < 1e-9


def test_confidence_of_a_label_adds_up_from_the_top(spark):
    """The mean of a label's lines is made in their order, so its last digits are the same wherever they were made."""
    shares = list(permutations((0.1, 0.2, 0.3)))
    read = [(v, float(j), t, c, 10 * i) for v, cs in enumerate(shares) for i, (t, c) in enumerate(zip(("ANA LUZ", "POETA", "CHILE"), cs, strict=True)) for j in range(2)]
    got = labels.stable_labels(spark.createDataFrame(read, "video_id long, t double, text string, conf double, y int")).collect()
    assert {r.video_id: (r["lines"], r.confidence) for r in got} == {v: (["ANA LUZ", "POETA", "CHILE"], (cs[0] + cs[1] + cs[2]) / 3) for v, cs in enumerate(shares)}


def test_invented_texts_are_normalised_once(spark):
    """A text is normalised once for all stock phrases, and long ones not at all; rules as before on texts at the edges."""
    cases = {None: False, "": False, "¡Gracias por ver el vídeo!": True, "Gracias por ver el video" + " a" * 15: True, "Gracias por ver el video" + " ab" * 6: False, "Sí. Sí. ¡Sí!": True, "... Ya. ya.": True, "Sí. No. Sí.": False, "!!! ???": False, "Gracias por ver el video " + "¿" * 500: True, "x " * 100 + "gracias por ver el video": False}
    cases["Gracias por ver el video" + " a" * 15] = 24 / 54 > 0.6
    got = {r.t: r.y for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.is_hallucination(F.col("t")).alias("y")).collect()}
    assert got == cases
    plan = spark.createDataFrame([("x",)], "t string").select(T.is_hallucination(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 8  # two for each place that normalises


def test_changes_look_for_no_suggestions(spark):
    assert "similarity" not in registry.queries()["t13_glossary_changes"](spark, SF)._jdf.queryExecution().toString()


def test_changes_keep_sharp_s_and_join_repeated_turns(spark, tmp_path):
    """A term that starts with ß and one in capitals with ẞ restore their words, letters without a capital stay, and a turn that is there twice is one row, as in SQL."""
    texts = ["Die ßungä, grüßen.", "ßunga und GRUẞEN", "grußen ßunga", "ǰabcx, JABCX", "ssunga SSUNGA"]
    rows = pd.DataFrame([(1, min(i, 3), "user", t) for i, t in enumerate(texts)] + [(1, 2, "user", "Grußen")], columns=["conv_id", "turn", "role", "text"])
    rows.to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    want = con.sql(registry.oracle_sql()["t13_glossary_changes"]).fetchall()
    assert set(want) == {(1, 1, "GRUẞEN→GRÜẞEN,ßunga→ßungä"), (1, 2, "Grußen→Grüßen,grußen→grüßen,ßunga→ßungä"), (1, 3, "JABCX→ǰABCX")}
    got = registry.queries()["t13_glossary_changes"](spark, str(tmp_path)).select("video_id", "segment_id", "changes").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_similar_words_share_a_segment(spark):
    """Every pair that all pairs would find shares a key, and few others do."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdef"), rng.integers(5, 22))) for _ in range(60)]
    near = [w[:i] + "".join(rng.choice(list("abx"), rng.integers(0, 3))) + w[i + int(rng.integers(0, 3)) :] for w in base for i in rng.integers(1, len(w), 3)]
    keys = lambda words, term: spark.createDataFrame([(w,) for w in set(words)], "w string").select(F.col("w").alias("t" if term else "p"), F.explode(glossary._segment_keys(F.col("w"), term)).alias("key"))
    met = {(r.p, r.t) for r in keys(near, False).join(keys(base, True), "key").select("p", "t").distinct().collect()}
    want = {(p, t) for p in set(near) for t in base if p[0] == t[0] and abs(len(p) - len(t)) <= 2 and SequenceMatcher(None, p, t).ratio() >= glossary.RATIO}
    assert len(want) > 30
    assert want <= met
    assert len(met) < len(set(near)) * len(base) / 5


def _alike(seed, letters, least=5, most=22):
    rng = np.random.default_rng(seed)
    base = sorted({"".join(rng.choice(list(letters), rng.integers(least, most))) for _ in range(80)})
    return sorted({w[:i] + "".join(rng.choice(list(letters), rng.integers(0, 3))) + w[i + int(rng.integers(0, 3)) :] for w in base for i in rng.integers(1, len(w), 4)}), base


def _most_similar(words, terms):
    from difflib import SequenceMatcher

    found = {p: min(((-SequenceMatcher(None, p, t).ratio(), t) for t in terms if p[0] == t[0] and abs(len(p) - len(t)) <= 2), default=(0, "")) for p in words}
    return {p: (-r, t.upper()) for p, (r, t) in found.items() if -r >= glossary.RATIO}


def test_nearest_terms_are_those_of_all_pairs(spark, monkeypatch):
    """Cells of a few words, terms of more letters than a cell takes, letters beyond the basic plane and equal ratios."""
    monkeypatch.setattr(glossary, "CELL", 6)
    monkeypatch.setattr(glossary, "LONG", 16)
    near, base = _alike(6, "abcdé\U00010428")
    frame = spark.createDataFrame([(p,) for p in near], "p string")
    terms = spark.createDataFrame([(t, t.upper()) for t in base], "plain string, term string")
    best = {}
    for r in glossary.nearest_terms(frame, terms, max(map(len, base))).collect():
        best[r.p] = min(best.get(r.p, (0, "")), (-r.ratio, r.term))
    want = _most_similar(near, base)
    assert len(want) > 40 and any(len(p) > 18 for p in want)
    assert {p: (-r, t) for p, (r, t) in best.items()} == want
    assert glossary.nearest_terms(frame, terms.limit(0), 0).count() == 0


def test_few_similar_words_are_matched(monkeypatch):
    """Of thousands of pairs in a cell only those are matched that their letters allow, and no more once the best is found."""
    import pyarrow as pa

    calls, matcher = [], glossary.SequenceMatcher
    monkeypatch.setattr(glossary, "SequenceMatcher", lambda *a: calls.append(a) or matcher(*a))
    near, base = _alike(7, "aehnort", 10, 11)
    near = [p for p in near if len(p) == 10]
    got = glossary._nearest(pa.table({"p": near}), pa.table({"plain": base, "term": [t.upper() for t in base]})).to_pylist()
    assert {r["p"]: (r["ratio"], r["term"]) for r in got if r["p"][0] == r["term"][0].lower()}.items() >= _most_similar(near, base).items()
    assert len(near) * len(base) > 5000 and len(calls) < 3 * len(near)


@pytest.mark.parametrize(("name", "once"), [("q8_identities", []), ("k9_body_lines", ["gracias por ver el video", "MapInArrow"])])
def test_what_labels_and_texts_say_is_worked_out_once(spark, name, once):
    """Joins read kept rows: no plan looks for names in texts, reads labels or normalises utterances again in each of its branches."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in (r"yo soy\s", "PERIODISTA", *once) if x in plan] == []


def test_package_works_out_its_steps_once(spark, monkeypatch):
    """What the package keeps is made of kept rows: utterances are judged in one plan, names in texts and labels in none of its own."""
    from transcriba.operators import editorial

    plans, keep = [], editorial.materialise
    monkeypatch.setattr(editorial, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    plans.append(registry.queries()["k8_package"](spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > 3
    assert sum("gracias por ver el video" in p for p in plans) == 1
    assert not any(x in p for p in plans for x in (r"yo soy\s", "PERIODISTA"))


def test_package_gathers_a_medium_once(spark, monkeypatch):
    """Lines are made and gathered in one plan for all documents that hold them, and documents are told from kept rows without a shuffle."""
    from transcriba.operators import editorial

    plans, keep = [], editorial.materialise
    monkeypatch.setattr(editorial, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    package = registry.queries()["k8_package"](spark, SF)
    plans.append(package._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("Título en pantalla: «") for p in plans) == 1
    assert "Exchange" not in package._jdf.queryExecution().executedPlan().toString()


def test_cleaning_and_loops_are_as_by_the_plain_rules(spark):
    """The guarded patterns of the cleanup, spoken text and loops give what the plain ones give: marks, cases, wide spaces, letters beyond ASCII."""
    bits = ["eh", "Ehm", "EHH,", "ém", "ahí", "mm.", "em em", "la la", "La lA la", "él él", "no", "nono", "a\u200da", "x_x x_x", "ÀÀ àà", "ß SS", "\u212aa ka", "  ", "\u3000", "\t", " ,", ",,", ";;:", ".", "! ", "? ", "a\u0301h", "12 12", "ah"]
    rng = np.random.default_rng(11)
    texts = ["", " ", "a. ", ". . .", "Sí. sí! SI?", "Hola. hola.", *(rng.choice([" ", "", ". "]).join(rng.choice(bits, int(rng.integers(1, 9)))) for _ in range(3000))]
    plain = [(r"(?<![\wáéíóúñ])(?:eh|ehh|ehhh|em|emm|mm|mmm|ah|ehm)(?![\wáéíóúñ])\s*[,.]?\s*", " "), (r"\b(\w+)(\s+\1\b)+", "$1"), (r"\s+([,.;:!?])", "$1"), (r"([,.;:])\1+", "$1"), (r"\s{2,}", " "), (r"^[,.;:\s]+", "")]
    t = F.col("t")
    want = t
    for pattern, new in plain:
        want = F.regexp_replace(want, f"(?iuU){pattern}", new)
        want = F.trim(want) if pattern == r"\s{2,}" else want
    want = F.concat(F.upper(F.left(want, F.lit(1))), F.substring(want, 2, 1 << 30))
    spoken = lambda c: F.trim(F.regexp_replace(F.regexp_replace(T.fold(F.lower(c)), "[^a-z0-9 ]", " "), r"\s+", " "))
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    every = F.filter(F.transform(T.sentences(t), spoken), lambda x: x != "")
    loop = (F.size(every) >= 2) & (F.size(F.array_distinct(every)) == 1) & (F.size(F.split(F.get(every, F.lit(0)), " ")) < 12)
    rows = rows.select("t", T.clean_for_reading(t).alias("got"), want.alias("want"), T.normalize_spoken(t).alias("said"), spoken(t).alias("plain"), T.is_loop(t).alias("loop"), F.coalesce(loop, F.lit(False)).alias("loops")).collect()
    assert [r.t for r in rows if (r.got, r.said, r.loop) != (r.want, r.plain, r.loops)] == []
    assert sum(r.got != r.t for r in rows) > 1000 and 3 < sum(r.loop for r in rows) < 2000


@pytest.mark.parametrize("name", ["t7_local_summary", "t27_read_lines"])
def test_rows_that_hold_their_words_are_not_shuffled(spark, name):
    assert "Exchange" not in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_vector_top_keeps_equal_products_apart(spark):
    """Copies of one vector tie and go by id; null, short and broken vectors come last; every id type; equal to all pairs."""
    rng = np.random.default_rng(7)
    v = [(f"v{i:03d}", [float(x) for x in rng.normal(size=5).astype("float32")]) for i in range(150)]
    v += [(f"w{i:03d}", v[3][1]) for i in range(40)] + [("n0", None), ("n1", [1.0]), ("n2", [1.0, None, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(v, "chunk_id string, embedding array<float>")
    asked = frame.where("chunk_id like 'v%0'").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r["rank"]): r.chunk_id for r in search.vector_top(asked, frame, 194).collect()}
    held, want = dict(v), {}
    for q in (i for i in held if i[0] == "v" and i[-1] == "0"):
        score = lambda i: sum(a * b for a, b in zip(held[q], held[i], strict=True)) if held[i] and len(held[i]) == 5 and None not in held[i] else None  # noqa: B023, E731
        by = sorted(held, key=lambda i: (score(i) is None, -(score(i) or 0), i))
        want |= {(q, n + 1): i for n, i in enumerate(by)}
    assert got == want
    assert "zip_with" not in search.vector_top(asked, frame, 3)._jdf.queryExecution().optimizedPlan().toString()
