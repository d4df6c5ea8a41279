"""Vector index on files, migrations, deletion of videos, learnt projections, editorial documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriba.operators import clustering, documents, editorial, exports, names, states
from transcriba.operators.vector_index import VectorIndex
from transcriba.sources.store import AddColumn, CreateTable, Store


def _vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "chunk_id long, embedding array<float>")


def test_index_is_exact_and_skips_buckets(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6)) * 0.15 + np.repeat(rng.normal(size=(12, 6)) * 3, 50, 0)
    x = x.astype(np.float32).astype(float)
    index = VectorIndex.create(_vectors(spark, range(600), x), str(tmp_path), 12)
    asked = _vectors(spark, range(20), x[::30] * 0.9).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    q = np.array([r.q for r in asked.orderBy("query_id").collect()], float)

    def best(x, ids, k):
        return {(i, int(ids[j])) for i, v in enumerate(q) for j in sorted(range(len(x)), key=lambda j: (-(v @ x[j]), ids[j]))[:k]}

    def found(index, k):
        return {(r.query_id, r.chunk_id) for r in index.search(asked, k).collect()}

    assert found(index, 7) == best(x, range(600), 7) and found(index, 700) == best(x, range(600), 700)
    pairs = index.plan(asked, 7).count()
    assert pairs < 0.5 * 20 * 12  # the share of buckets read
    touched = index.update(_vectors(spark, [3, 700], [x[3] * 2, x[599]]), _vectors(spark, [0, 9999], [x[0], x[0]]))
    assert touched <= 3
    again = VectorIndex(spark, str(tmp_path))
    y, ids = np.concatenate([x[1:], x[599:]]), [*range(1, 600), 700]
    y[2] = x[3] * 2
    assert found(again, 7) == best(y, ids, 7) and again.vectors().count() == 600 and again.update() == 0


def test_index_edges(spark, tmp_path):
    none = _vectors(spark, [], [])
    asked = _vectors(spark, [1], [[1.0, 0.0]]).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    one = VectorIndex.create(_vectors(spark, [1, 2], [[1, 0], [1, 0]]), f"{tmp_path}/a", 5)
    assert [(r.chunk_id, r["rank"]) for r in one.search(asked, 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    one.update(None, _vectors(spark, [1, 2], [[1, 0], [1, 0]]))
    assert none.count() == 0 and one.search(asked, 5).count() == 0


def test_migrations_apply_once_and_old_rows_get_defaults(spark, tmp_path):
    base, one, two = Store(spark, str(tmp_path)), (1, (CreateTable("t", (("id", "int"),)),)), (2, (AddColumn("t", "n", "int", "7"), CreateTable("u", (("x", "string"),))))
    assert base.version() == 0 and base.migrate([one]) == [1] and base.migrate([one]) == []
    base.append("t", spark.createDataFrame([(1,)], "id int"))
    assert base.migrate([two, one]) == [2] and base.migrate([one, two]) == [] and base.version() == 2 and base.read("u").columns == ["x"]
    base.append("t", spark.createDataFrame([(2, None), (3, 5)], "id int, n int"))
    base.append("t", spark.createDataFrame([(4,)], "id int"))
    assert {tuple(r) for r in Store(spark, str(tmp_path)).read("t").collect()} == {(1, 7), (2, None), (3, 5), (4, 7)}
    for bad in ((3, (AddColumn("t", "n", "int"),)), (3, (AddColumn("v", "n", "int"),)), (3, (CreateTable("t", (("a", "int"),)),))):
        with pytest.raises(ValueError, match="version 3"):
            base.migrate([bad])
    with pytest.raises(ValueError, match="unknown"):
        base.read("v")
    assert base.version() == 2


def test_cascade_needs_the_index(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "video_id int, chunk_id string")
    gone = spark.createDataFrame([(1,)], "video_id int")
    with pytest.raises(RuntimeError, match="index"):
        states.delete_cascade({"chunks": chunks}, gone)
    left = states.delete_cascade({"chunks": chunks, "vectors": chunks.select("chunk_id"), "relations": chunks}, gone)
    assert {k: v.count() for k, v in left.items()} == {"chunks": 1, "vectors": 1, "relations": 2}
    assert states.delete_cascade({"chunks": chunks}, gone.where("video_id = 9"))["chunks"].count() == 2


def test_discriminants_part_the_classes(spark):
    rng = np.random.default_rng(8)
    y = np.arange(160) % 4
    x = np.column_stack([rng.normal(size=160) * 6, rng.normal(size=160) * 6, np.cos(y * 1.57) + rng.normal(size=160) * 0.1, np.sin(y * 1.57) + rng.normal(size=160) * 0.1])
    rows = spark.createDataFrame([(1, float(i), i + 1.0, f"P{c}", v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "video_id long, start_time double, end_time double, person string, embedding array<double>")
    m = {(r.i, r.j): (r.within, r.between) for r in clustering.scatter(rows, "person").collect()}
    mean = x.mean(0)
    within = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in range(4))
    between = sum((y == c).sum() * np.outer(x[y == c].mean(0) - mean, x[y == c].mean(0) - mean) for c in range(4))
    assert all(np.isclose(w, within[k]) and np.isclose(b, between[k]) for k, (w, b) in m.items()) and len(m) == 10
    directions, at, before, after = clustering.tune_projection(rows)
    assert directions.shape == (4, 3) and sum(after) < sum(before) and 0 < at < 1
    kept = clustering.tune_projection(rows.where("person in ('P0', 'P1')"))
    assert kept[0] is None


def _matrix_linkage(x, threshold, k=0):
    """Average linkage by the whole matrix of distances, the nearest pair first."""
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups, d = [[i] for i in range(n)], 1 - unit @ unit.T
    while len(groups) > max(1, k):
        h, i, j = min((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if k == 0 and h > threshold:
            break
        groups[i] += groups.pop(j)
    label = np.zeros(n, int)
    for g, rows in enumerate(sorted(groups, key=min)):
        label[rows] = g
    return label.tolist()


def test_chains_give_the_clusters_of_the_matrix():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 30, 90):
        x = rng.normal(size=(n, 5)) + np.repeat(rng.normal(size=(-(-n // 10), 5)) * 2, 10, 0)[:n]
        for at in (0.2, 0.6, 0.75, 1.1):
            assert clustering.average_linkage(x, at).tolist() == _matrix_linkage(x, at)
        assert clustering.average_linkage(x, 0, min(4, n)).tolist() == _matrix_linkage(x, 0, min(4, n))
    assert clustering.average_linkage(np.zeros((0, 3)), 0.7).tolist() == []


def test_diarize_names_turns(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0.0, 2.0, w), (1, 2.0, 2.3, v), (1, 2.3, 5.0, w), (1, 5.0, 9.0, v), (1, 9.0, 60.0, v), (2, 0.0, 0.1, v)]
    got = clustering.diarize(spark.createDataFrame(rows, "video_id long, start_time double, end_time double, embedding array<double>")).collect()
    assert sorted(tuple(r[c] for c in ("video_id", "start_time", "end_time", "speaker")) for r in got) == [(1, 0.0, 5.0, "SPEAKER_00"), (1, 5.0, 60.0, "SPEAKER_01")]


def test_free_names_fill_gaps(spark):
    wanted = spark.createDataFrame([(1, "a.mp4"), (2, "a.mp4"), (3, "a.mp4"), (4, "b.mp4"), (5, "a_3.mp4"), (6, "a_3.mp4"), (7, "x.y"), (8, "nodot"), (9, "nodot")], "ord int, name string")
    taken = spark.createDataFrame([("a.mp4",), ("a_2.mp4",), ("a_5.mp4",), ("b_2.mp4",)], "name string")
    got = {r.ord: r.free for r in names.free_names(wanted, taken).collect()}
    assert got == {1: "a_4.mp4", 2: "a_6.mp4", 3: "a_7.mp4", 4: "b.mp4", 5: "a_3.mp4", 6: "a_3_2.mp4", 7: "x.y", 8: "nodot", 9: "nodot_2"}
    assert len(set(got.values())) == 9


def test_package_documents(spark):
    media = spark.createDataFrame([(1, "Poetas", "http://x", 65.0), (2, "Nada", None, 5.0)], "video_id long, title string, url string, duration_seconds double")
    rows = [(1, 1, 0.0, 4.0, "eh, hola hola a todos", 0.9, "S00"), (1, 2, 5.0, 9.0, "leo un texto", 0.5, "S00"), (1, 3, 20.0, 24.0, "sigo", 0.9, "S01"), (1, 4, 40.0, 44.0, "Gracias por ver el video", 0.9, "S01"), (1, 5, 60.0, 64.0, "tras el fin", 0.9, "S00")]
    segments = spark.createDataFrame(rows, "video_id long, segment_id long, start_time double, end_time double, text string, confidence double, speaker string")
    who = spark.createDataFrame([(1, "S00", "Carla Ulloa", "POETA", "UNAM", "ALTO", 0.0, 64.0, 12.0, False, ["visto"]), (1, "S01", None, None, None, "BAJO", 20.0, 44.0, 90.0, True, [])], "video_id long, speaker string, name string, role string, institution string, confidence string, first_s double, last_s double, spoken_s double, off_screen boolean, evidence array<string>")
    cards = spark.createDataFrame([(1, 1, 6.0, 9.0, "Canto", "Neruda", "1950")], "video_id long, citation_id long, start_time double, end_time double, title string, author string, year string")
    ends = spark.createDataFrame([(1, 50.0)], "video_id long, end_s double")
    got = {(r.video_id, r.file): r.content for r in editorial.package(media, segments, who, cards, ends).collect()}
    assert len(got) == 16
    assert got[1, "subtitulos.srt"] == "1\n00:00:00,000 --> 00:00:09,000\nCARLA ULLOA: Hola a todos leo un texto\n\n2\n00:00:20,000 --> 00:00:24,000\nVOZ EN OFF: Sigo\n"
    assert got[1, "transcripcion_completa.txt"].endswith("-" * 70 + "\n\n[00:00:00] CARLA ULLOA — POETA, UNAM\nHola a todos leo un texto\n\n[00:00:20] VOZ EN OFF — NARRACIÓN\nSigo\n")
    assert got[1, "transcripcion_completa.txt"].startswith("Poetas\n======\n\nFuente: http://x\nDuración: 00:01:05\n\nTranscripción automática")
    literal = got[1, "transcripcion_literal.md"]
    assert "eh, hola hola a todos" in literal and "[00:00:00] INICIO — LECTURA DE TEXTO\nTítulo en pantalla: «Canto» · Autor: Neruda · 1950" in literal and literal.endswith("sigo\n\n[00:00:20] FIN — LECTURA DE TEXTO")
    sheet = got[1, "participantes_identificados.csv"].split("\n")
    assert len(sheet) == 3 and sheet[2] == '"VOZ EN OFF","","NARRACIÓN","","S01","00:00:20","00:00:44","1.5","BAJO","Sin evidencia en el video","Voz en off / narración"'
    assert got[1, "citas_literarias.csv"].split("\n")[1].startswith('"1","00:00:06","00:00:09","Canto","Neruda","1950","Tarjeta sobreimpresa en 00:00:06","ALTO"')
    assert "probably invented" in got[1, "incertidumbres.csv"] and "- Voces distinguidas: 2" in got[1, "proceso_tecnico.md"]
    assert got[2, "subtitulos.srt"] == "" and got[2, "citas_literarias.csv"].count("\n") == 0


def test_prepared_transcripts(spark):
    media = spark.createDataFrame([(1, "T", "/a/b.mp4", None), (2, "U", "/a/c.mp4", "p")], "video_id long, title string, path string, project_id string")
    segments = spark.createDataFrame([(1, 1, 0.0, 1.0, "hola", None), (1, 2, 1.0, 2.0, "sí", "S00")], "video_id long, segment_id long, start_time double, end_time double, text string, speaker string")
    ask = lambda i: editorial.prepare(media, segments, None, spark.createDataFrame([(i,)], "video_id long"))
    with pytest.raises(ValueError, match="no transcript"):
        ask(2)
    with pytest.raises(ValueError, match="unknown"):
        ask(3)
    (r,) = editorial.FORMATS["md"](media, ask(1)).collect()
    assert r.markdown.startswith("# T\n\n- **Título:** T\n- **Archivo:** b.mp4\n\n> Trans") and r.markdown.endswith("**Intervienen:** SPEAKER_?, S00\n\n---\n\n`[00:00:00]` **SPEAKER_?:** hola\n\n`[00:00:01]` **S00:** sí\n")
    assert editorial.FORMATS["srt"](media, ask(1)).first().srt.startswith("1\n00:00:00,000 --> 00:00:01,000\nSPEAKER_?: hola\n\n2\n")
    assert [(r.start_time, r.end_time) for r in editorial.clip(segments, 0.5, 1.5).collect()] == [(0.0, 0.5), (0.5, 1.0)]
    for a, b in ((-1.0, 2.0), (3.0, 3.0)):
        with pytest.raises(ValueError, match="clip"):
            editorial.clip(segments, a, b)


def test_documents_never_overwrite_each_other(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "1"), ("a:b", "2"), ("c", "3"), ("a_b", "4")], "title string, json string")
    got = exports.write_documents(docs, f"{tmp_path}/out", "title", "json").collect()
    assert len({r.file for r in got}) == 4 and {r.value for r in spark.read.text(f"{tmp_path}/out").collect()} == {"1", "2", "3", "4"}
    media = spark.createDataFrame([(1, "t", "completed"), (2, "u", "failed")], "video_id long, title string, processing_status string")
    chunks = spark.createDataFrame([(1, "x", 0.0, 1.0, "hola")], "video_id long, chunk_id string, start_time double, end_time double, full_text string")
    rows = documents.corpus_json(media, chunks, exported="now")
    assert exports.completed_documents(media, rows).count() == 1
    text = {r.video_id: r.json for r in rows.collect()}
    assert '"entidades":[]' in text[1] and '"chunks":[]' in text[2] and '"estado":"failed"' in text[2] and text[1].endswith('"anotaciones_manuales":[],"exportado_el":"now"}')
    with pytest.raises(ValueError, match="unknown"):
        documents.corpus_json(media, chunks, wanted=spark.createDataFrame([(9,)], "video_id long"))
