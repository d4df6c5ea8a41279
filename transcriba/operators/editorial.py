"""The editorial package: what a video's documents say, line by line, and the files that hold it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.numbers import clock
from ..sources.tables import materialise
from .exports import review_list
from .glossary import reading_text
from .intervals import active_citation, utterances

# Headers of the sheets, lines of the documents.
PARTICIPANTS = ("Identificación", "Nombre", "Función", "Institución", "ID de voz", "Primera aparición", "Última aparición", "Minutos hablados", "Nivel de confianza", "Evidencia", "Observaciones")
CITATIONS = ("Nº", "Inicio", "Fin", "Título (según pantalla)", "Autor", "Año", "Evidencia", "Nivel de confianza", "Observaciones")
REVIEW = ("number", "issue", "at_s", "what", "note")
NO_EVIDENCE, OFF_SCREEN_NOTE, NARRATION = "Sin evidencia en el video", "Voz en off / narración", "NARRACIÓN"
CARD, CHECK_BY_EAR, NO_AUTHOR = "Tarjeta sobreimpresa en ", "El inicio y el fin del pasaje leído requieren cotejo con el audio", "No identificado"
READING_OPENS, READING_CLOSES = "INICIO — LECTURA DE TEXTO", "FIN — LECTURA DE TEXTO"


def interventions(segments: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Utterances for publication, cut at pauses of 8 s and spans of 90 s, with invented (T11 on the whole utterance).

    ends: video_id, end_s: where content ends; segments that start there or later are left out. Invented ones are
    flagged, not dropped: the documents leave them out and the review list names them.
    """
    rows = segments
    if ends is not None:
        rows = rows.join(ends.select("video_id", "end_s"), "video_id", "left").where(F.col("end_s").isNull() | (F.col("start_time") < F.col("end_s"))).drop("end_s")
    return utterances(rows, K.PAUSE_S, K.PARAGRAPH_S).withColumn("invented", T.is_hallucination(F.col("text")))


def body_lines(said: DataFrame, identities: DataFrame, citations: DataFrame | None = None, glossary: DataFrame | None = None, clean: bool = True) -> DataFrame:
    """video_id, ord, start_time, end_time, opens, who, short, text, closes of every utterance that is published.

    who is the voice with its role the first time and by name alone after; short is the name alone. clean gives the
    text as it reads, by the glossary if there is one. opens is the detail of a card whose reading begins here, closes says
    that one has ended. citations: video_id, citation_id, start_time, title, author, year. The utterances are made once, in the shared folder.
    """
    return _lines(materialise(said), identities, citations, glossary, clean)


def _lines(said: DataFrame, identities: DataFrame, citations: DataFrame | None, glossary: DataFrame | None, clean: bool) -> DataFrame:
    """body_lines of utterances that are kept already."""
    rows = said.where(~F.col("invented")).select("video_id", "start_time", "end_time", "speaker", "text")
    in_video = Window.partitionBy("video_id").orderBy("start_time", "end_time")
    rows = rows.withColumn("ord", F.row_number().over(in_video))
    times = rows.select("video_id", "ord", "start_time", "end_time")
    who = identities.select("video_id", "speaker", "name", "role", "institution", "off_screen")
    rows = rows.join(who.withColumn("known", F.lit(True)), ["video_id", "speaker"], "left")
    first = F.row_number().over(Window.partitionBy("video_id", "speaker").orderBy("ord")) == 1
    short = F.when(F.col("known"), T.editorial_label(F.col("name"), F.col("off_screen"))).otherwise("VOZ NO IDENTIFICADA")
    full = F.when(F.col("known") & first, T.descriptor(F.col("name"), F.col("off_screen"), F.col("role"), F.col("institution"))).otherwise(short)
    rows = rows.select("video_id", "ord", "start_time", "end_time", full.alias("who"), short.alias("short"), "text")
    detail = F.lit(None).cast("string")
    if citations is not None:
        card = citations.select("video_id", "citation_id", F.concat(F.lit("Título en pantalla: «"), "title", F.lit("»"), F.coalesce(F.concat(F.lit(" · Autor: "), "author"), F.lit("")), F.coalesce(F.concat(F.lit(" · "), "year"), F.lit(""))).alias("card"))
        now = active_citation(times, citations, "ord").join(card, ["video_id", "citation_id"], "left")
        rows = rows.join(now, ["video_id", "ord"], "left")
        detail = F.col("card")
    else:
        rows = rows.withColumn("citation_id", F.lit(None).cast("long"))
    before = F.lag("citation_id").over(Window.partitionBy("video_id").orderBy("ord"))
    begins = F.col("citation_id").isNotNull() & ~F.col("citation_id").eqNullSafe(before)
    rows = rows.withColumns({"opens": F.when(begins, detail), "closes": F.col("citation_id").isNull() & before.isNotNull()})
    if clean:
        rows = reading_text(rows, glossary).withColumn("text", F.col("reading"))
    return rows.select("video_id", "ord", "start_time", "end_time", "opens", "who", "short", "text", "closes")


def _gathered(lines: DataFrame, **parts: Column | str) -> DataFrame:
    """video_id, l: the parts of a video's lines in order."""
    return lines.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in parts.items()]))).alias("l"))


def _joined(line: Callable[[Column], Column], between: str) -> Column:
    """The lines of l as one text."""
    return F.array_join(F.transform("l", line), between)


def _document(lines: DataFrame, line: Column, between: str) -> DataFrame:
    return _gathered(lines, line=line).select("video_id", _joined(lambda x: x["line"], between).alias("body"))


def _stamp(c: str, ms: bool = False) -> Column:
    return clock(F.col(c), ms)


def _transcripts(lines: DataFrame) -> DataFrame:
    """video_id, l: what documents say of each line: opens and closes where a reading does, stamp and voice, block and short name, text and reading."""
    opens = F.coalesce(F.concat(F.lit("["), _stamp("start_time"), F.lit(f"] {READING_OPENS}\n"), "opens", F.lit("\n\n")), F.lit(""))
    closes = F.when(F.col("closes"), F.concat(F.lit("\n\n["), _stamp("start_time"), F.lit(f"] {READING_CLOSES}"))).otherwise("")
    voice = F.concat(F.lit("["), _stamp("start_time"), F.lit("] "), "who", F.lit("\n"))
    block = F.concat(F.col("ord").cast("string"), F.lit("\n"), _stamp("start_time", True), F.lit(" --> "), _stamp("end_time", True), F.lit("\n"), "short", F.lit(": "))
    return _gathered(lines, opens=opens, closes=closes, voice=voice, block=block, text="text", reading="reading")


def _csv(cells: list[Column]) -> Column:
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return F.concat_ws(",", *quoted)


def _sheet(header: tuple[str, ...], body: str) -> Column:
    """A CSV document of its lines, or the header alone."""
    return F.concat_ws("\n", F.lit(",".join(f'"{h}"' for h in header)), body)


def participant_rows(identities: DataFrame) -> DataFrame:
    """video_id, ord, and the eleven columns of the sheet of participants, by first appearance."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("first_s", "speaker"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cells = [
        T.editorial_label(F.col("name"), F.col("off_screen")), text("name"), F.coalesce("role", F.when(F.col("off_screen"), NARRATION), F.lit("")), text("institution"), F.col("speaker"),
        _stamp("first_s"), _stamp("last_s"), F.bround(F.col("spoken_s") / 60, 1), F.col("confidence"),
        F.when(F.size("evidence") > 0, F.array_join("evidence", " | ")).otherwise(NO_EVIDENCE), F.when(F.col("off_screen"), OFF_SCREEN_NOTE).otherwise(""),
    ]
    return identities.select("video_id", n.alias("ord"), *[c.alias(h) for c, h in zip(cells, PARTICIPANTS, strict=True)])


def citation_rows(citations: DataFrame) -> DataFrame:
    """video_id, ord, and the nine columns of the sheet of citations (start_time, end_time, title, author, year), in time order."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "citation_id"))
    sure = F.col("author").isNotNull() & F.col("year").isNotNull()
    cells = [n, _stamp("start_time"), _stamp("end_time"), F.col("title"), F.coalesce("author", F.lit(NO_AUTHOR)), F.coalesce("year", F.lit("")), F.concat(F.lit(CARD), _stamp("start_time")), F.when(sure, "ALTO").otherwise("MEDIO"), F.lit(CHECK_BY_EAR)]
    return citations.select("video_id", n.alias("ord"), *[c.alias(h) for c, h in zip(cells, CITATIONS, strict=True)])


def package(media: DataFrame, segments: DataFrame, identities: DataFrame, citations: DataFrame, ends: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """K8, K9: video_id, file, content: the eight documents of every medium (video_id, title, url, duration_seconds).

    The utterances and the voices are made once, in the shared folder, and so is what the documents of a medium say, gathered with
    each table shuffled once; the documents are then told row by row. The literal transcript keeps what was recognised; all others read clean.
    Word files and spreadsheets are Markdown and CSV with the same rows. A medium without utterances gets its documents with empty bodies.
    """
    said, identities = materialise(interventions(segments, ends)), materialise(identities)
    lines = _lines(said, identities, citations, None, False)
    lines = reading_text(lines if glossary is None else materialise(lines), glossary)  # a glossary asks for the lines three times
    doubts = review_list(segments, identities, citations, said.where("invented").select("video_id", "start_time", "text"))
    sheets = {
        "participants": participant_rows(identities).select("video_id", "ord", _csv([F.col(f"`{h}`") for h in PARTICIPANTS]).alias("line")),
        "citations": citation_rows(citations).select("video_id", "ord", _csv([F.col(f"`{h}`") for h in CITATIONS]).alias("line")),
        "doubts": doubts.select("video_id", F.col("number").alias("ord"), _csv([F.col(c) for c in REVIEW]).alias("line")),
    }
    parts = [_document(rows, F.col("line"), "\n").withColumnRenamed("body", name) for name, rows in sheets.items()]
    parts += [segments.groupBy("video_id").agg(F.count("*").alias("n")), identities.groupBy("video_id").agg(F.count("*").alias("voices"), F.count("name").alias("named")), citations.groupBy("video_id").agg(F.count("*").alias("cards"))]
    known = media.select("video_id", "title", "url", "duration_seconds")
    for rows in (*parts, _transcripts(lines)):
        known = known.join(rows, "video_id", "left")
    known = materialise(known)

    head = F.concat("title", F.lit("\n"), F.repeat(F.lit("="), F.length("title")), F.lit("\n\n"), F.coalesce(F.concat(F.lit("Fuente: "), "url", F.lit("\n")), F.lit("")), F.lit("Duración: "), _stamp("duration_seconds"), F.lit(f"\n\n{K.WARNING}\n\n{'-' * 70}\n\n"))
    heading = lambda what: F.concat(F.lit("# "), "title", F.lit(f"\n\n{what}\n\n> {K.WARNING}\n\n"))
    page = lambda head, body: F.concat(head, F.coalesce(body, F.lit("")))
    body = lambda text: _joined(lambda x: F.concat(x["opens"], x["voice"], x[text], x["closes"]), "\n\n")
    told = (("Segmentos de habla transcritos", "n"), ("Voces distinguidas", "voices"), ("Voces con nombre propio", "named"), ("Textos literarios anunciados por tarjeta", "cards"))
    process = F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), F.coalesce(F.col(c), F.lit(0)).cast("string")) for k, c in told])
    files = {
        "transcripcion_literal.md": page(heading("Transcripción literal (sin editar)"), body("text")),
        "transcripcion_limpia.md": page(heading("Transcripción editorial (versión de lectura)"), body("reading")),
        "transcripcion_completa.txt": page(head, _joined(lambda x: F.concat(x["voice"], x["reading"], F.lit("\n")), "\n")),
        "subtitulos.srt": page(F.lit(""), _joined(lambda x: F.concat(x["block"], x["reading"], F.lit("\n")), "\n")),
        "participantes_identificados.csv": _sheet(PARTICIPANTS, "participants"),
        "citas_literarias.csv": _sheet(CITATIONS, "citations"),
        "incertidumbres.csv": _sheet(REVIEW, "doubts"),
        "proceso_tecnico.md": page(F.lit("# Proceso técnico\n\n"), F.when(F.col("n").isNotNull(), process)),
    }
    return reduce(DataFrame.unionByName, [known.select("video_id", F.lit(name).alias("file"), content.alias("content")) for name, content in files.items()])


def prepare(media: DataFrame, segments: DataFrame, names: DataFrame | None = None, wanted: DataFrame | None = None, pause: float = 0.0) -> DataFrame:
    """The utterances of the wanted media (video_id; all media with segments if none are given) with who: the name given to the voice.

    A voice without a name goes by its label, a null one by SPEAKER_?. ValueError names a wanted medium that is unknown or has no segment.
    """
    if wanted is not None:
        for known, why in ((media, "unknown video: {}"), (segments, "video {} has no transcript yet: process it before an export")):
            lost = wanted.select("video_id").join(known.select("video_id"), "video_id", "left_anti").orderBy("video_id").first()
            if lost is not None:
                raise ValueError(why.format(lost.video_id))
        segments = segments.join(wanted.select("video_id").distinct(), "video_id", "left_semi")
    rows = utterances(segments, pause)
    label = F.coalesce("speaker", F.lit("SPEAKER_?"))
    if names is not None:
        given = names.select("video_id", F.col("speaker_label").alias("speaker"), F.col("display_name").alias("_given"))
        return rows.join(given, ["video_id", "speaker"], "left").withColumn("who", F.coalesce("_given", label)).drop("_given")
    return rows.withColumn("who", label)


def fact_sheet(media: DataFrame, projects: DataFrame | None = None, exported: str = "") -> DataFrame:
    """K5: video_id, sheet: a line for each fact of a medium that is there: title, source, channel, date, length, project, file, time of export.

    media: video_id, title, path and, where they exist, source_url, source_channel, source_published_at, duration_seconds, project_id.
    """
    has = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in media.columns else F.lit(None).cast("string")
    if projects is not None:
        media = media.join(projects.select("project_id", F.col("name").alias("_project")), "project_id", "left")
    length = F.when(F.col("duration_seconds") > 0, clock(F.col("duration_seconds"))) if "duration_seconds" in media.columns else F.lit(None).cast("string")
    facts = (
        ("Título", F.col("title")), ("Fuente", has("source_url")), ("Canal / autor", has("source_channel")), ("Publicado", has("source_published_at")), ("Duración", length),
        ("Proyecto", F.col("_project") if projects is not None else F.lit(None).cast("string")), ("Archivo", F.regexp_extract("path", r"([^/]*)$", 1)), ("Exportado", F.lit(exported or None).cast("string")),
    )
    return media.select("video_id", "title", F.concat_ws("\n", *[F.concat(F.lit(f"- **{k}:** "), v) for k, v in facts]).alias("sheet"))


def markdown_transcripts(media: DataFrame, said: DataFrame, projects: DataFrame | None = None, exported: str = "", stamps: bool = True) -> DataFrame:
    """K5: video_id, markdown: title, fact sheet, warning, voices in order of appearance, utterances (as prepare gives them)."""
    stamp = F.concat(F.lit("`["), _stamp("start_time"), F.lit("]` ")) if stamps else F.lit("")
    line = F.concat(stamp, F.lit("**"), "who", F.lit(":** "), "text", F.lit("\n"))
    rows = said.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time", line.alias("line"), "who"))).alias("b"))
    voices = F.array_distinct(F.transform("b", lambda x: x["who"]))
    body = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "sheet", F.lit(f"\n\n> {K.WARNING}\n\n**Intervienen:** "), F.array_join(voices, ", "), F.lit("\n\n---\n\n"), body)
    return rows.join(fact_sheet(media, projects, exported), "video_id").select("video_id", text.alias("markdown"))


def srt_transcripts(said: DataFrame) -> DataFrame:
    """K6: video_id, srt: a block for each utterance, as prepare gives them, with its voice."""
    rows = said.withColumn("ord", F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time")))
    block = F.concat(F.col("ord").cast("string"), F.lit("\n"), _stamp("start_time", True), F.lit(" --> "), _stamp("end_time", True), F.lit("\n"), "who", F.lit(": "), "text", F.lit("\n"))
    return _document(rows, block, "\n").withColumnRenamed("body", "srt")


#: What a transcript can be exported as, by ending: prepared utterances and media to video_id and one column of text.
FORMATS = {"md": lambda media, said: markdown_transcripts(media, said), "srt": lambda media, said: srt_transcripts(said)}


def clip(rows: DataFrame, start: float, end: float, margin: float = 0.0) -> DataFrame:
    """Rows (start_time, end_time) of the interval [start, end) in its own time, cut at its edges; ValueError if it is none."""
    if start < 0 or end <= start:
        raise ValueError("a clip needs 0 <= start < end")
    inside = rows.where((F.col("start_time") < end + margin) & (F.col("end_time") > start))
    return inside.withColumns({"start_time": F.greatest("start_time", F.lit(start)) - start, "end_time": F.least("end_time", F.lit(end + margin)) - start})
