"""Streams of transcript segments: progressive append, resume, per-item failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K

#: States that nothing follows.
FINAL = ("completed", "failed")
SCHEMA = "video_id long, segment_id long, start_time double, end_time double, text string, confidence double, speaker string"


def read_segments(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 8) -> DataFrame:
    """Segments from a folder of JSON lines as files arrive; broken lines are left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(folder)


def append_segments(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is appended once; after a failure the query goes on from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume_points(segments: DataFrame) -> DataFrame:
    """R2, A2: video_id and the second after which transcription goes on."""
    return segments.groupBy("video_id").agg(F.coalesce(F.max("end_time"), F.lit(0.0)).alias("resume_s"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count()


def process_each(items: DataFrame, work: Callable[[str], str], column: str) -> DataFrame:
    """Items with done, result and error: one item's failure touches no other."""
    @F.pandas_udf("done boolean, result string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((True, work(v), None))
            except Exception as e:  # noqa: BLE001
                rows.append((False, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["done", "result", "error"])

    return items.withColumn("_r", run(F.col(column))).select(*items.columns, "_r.*")


def next_state(state: str, ok: bool = True) -> str:
    """The state after a step: the next one, or failed. What is completed or failed stays so."""
    if state in FINAL:
        return state
    return K.STATES[K.STATES.index(state) + 1] if ok else "failed"


def moved(state: str, told: str) -> str:
    """The state after a report: failed from anywhere but an end, else the reported one if it lies ahead."""
    if state in FINAL or told not in K.STATES:
        return state
    return told if told == "failed" or K.STATES.index(told) > K.STATES.index(state) else state


class OpenVideo:
    """What is known of a video while its segments arrive: the open utterance, the last segment, the state. Its size is that of one utterance."""

    FIELDS = ("speaker", "start", "end", "text", "n", "last_id", "resume_s", "total", "status")

    def __init__(self, held: tuple | None = None) -> None:
        self.speaker, self.start, self.end, self.text, self.n, self.last_id, self.resume_s, self.total, self.status = held or (None, 0.0, 0.0, "", 0, None, 0.0, 0, "pending")

    def held(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def close(self, out: list[dict]) -> None:
        if self.n:
            out.append({"kind": "utterance", "speaker": self.speaker, "start_time": self.start, "end_time": self.end, "text": self.text, "n": self.n, "status": None})
        self.n, self.text = 0, ""

    def report(self, out: list[dict]) -> None:
        out.append({"kind": "status", "speaker": None, "start_time": None, "end_time": self.resume_s, "text": None, "n": self.total, "status": self.status})

    def segment(self, ident: int, start: float, end: float, text: str, speaker: str | None, pause: float, max_s: float, out: list[dict]) -> None:
        if self.last_id is not None and ident <= self.last_id:
            return  # sent again after a resume
        if self.n and (speaker != self.speaker or (pause > 0 and start - self.end > pause) or (max_s > 0 and self.end - self.start >= max_s)):
            self.close(out)
        if not self.n:
            self.speaker, self.start = speaker, start
        self.text = " ".join(x for x in (self.text, text.strip()) if x)
        self.end, self.last_id, self.n = end, ident, self.n + 1
        self.resume_s, self.total = max(self.resume_s, end), self.total + 1
        self.status = moved(self.status, "transcribing")


def live_utterances(stream: DataFrame, pause: float = K.PAUSE_S, max_s: float = 0.0, late: str = "10 minutes", idle_s: int = 3600) -> DataFrame:
    """R1, R2, R4, W5 on a stream: utterances as they close, and a video's state whenever it ends or is reported.

    stream: video_id, segment_id, start_time, end_time, text, speaker, status, at. A row with a status
    reports a state and carries no segment; completed and failed close the open utterance. at is the time of
    the row: a video that is silent for idle_s seconds of it, by the watermark, fails, and what it said so far is given.
    Segments of a video come in the order of their ids; one that comes again is left out, so a producer may
    resume from resume_points and repeat itself. Nulls in text count as empty; a null speaker is a speaker.
    A row: video_id, kind (utterance or status), speaker, start_time, end_time (of a status: the resume point), text, n, status.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        video, out = OpenVideo(state.get if state.exists else None), []
        if state.hasTimedOut:
            if video.status not in FINAL:  # what has ended is only forgotten
                video.status = "failed"
                video.close(out)
                video.report(out)
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "segment_id"], kind="stable", na_position="last")
            for r in rows.itertuples():
                if isinstance(r.status, str):
                    video.status = moved(video.status, r.status)
                    if video.status in FINAL:
                        video.close(out)
                    video.report(out)
                elif video.status not in FINAL:
                    text, who = (x if isinstance(x, str) else None for x in (r.text, r.speaker))
                    video.segment(int(r.segment_id), float(r.start_time), float(r.end_time), text or "", who, pause, max_s, out)
            state.update(video.held())
            latest = max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(latest + 1000 * idle_s + 1)
        if out:
            found = pd.DataFrame(out, columns=["kind", "speaker", "start_time", "end_time", "text", "n", "status"])
            found.insert(0, "video_id", key[0])
            yield found

    kinds = "video_id long, kind string, speaker string, start_time double, end_time double, text string, n long, status string"
    held = "speaker string, start double, end double, text string, n long, last_id long, resume_s double, total long, status string"
    return stream.withWatermark("at", late).groupBy("video_id").applyInPandasWithState(run, kinds, held, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Processes what has arrived and stops; the next run goes on from the checkpoint. The sink writes each batch once."""
    append_segments(stream, target, checkpoint).awaitTermination()
