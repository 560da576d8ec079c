"""Documents and artifacts to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.operators.cues import render_segments, render_text, subtitle_files


def json_document(columns: list[str]) -> Column:
    """One JSON object with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def artifacts(words: DataFrame, transcripts: DataFrame, cues: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """job_id, name, content: the transcript document always, others by format. transcripts: job_id, text."""
    order = F.sort_array(F.collect_list(F.struct("idx", "text", "start", "end", "speaker")))
    document = transcripts.join(words.groupBy("job_id").agg(order.alias("words")), "job_id", "left").select("job_id", F.lit("transcript.json").alias("name"), json_document(["job_id", "text", "words"]).alias("content"))
    out = document
    if "txt" in formats:
        out = out.unionByName(render_text(words, transcripts).select("job_id", F.lit("transcript.txt").alias("name"), "content"))
    names = {f: f"subtitles.{f}" for f in ("srt", "vtt") if f in formats}
    return out.unionByName(subtitle_files(cues, names, transcripts)) if names else out


def translation_artifacts(segments: DataFrame, language: str, formats: tuple[str, ...]) -> DataFrame:
    """job_id, name, content of a translation. segments: job_id, cue, text, start, end, speaker."""
    order = F.sort_array(F.collect_list(F.struct("cue", "text", "start", "end", "speaker")))
    out = segments.groupBy("job_id").agg(order.alias("segments")).select("job_id", F.lit(f"translation.{language}.json").alias("name"), json_document(["job_id", "segments"]).alias("content"))
    if "txt" in formats:
        out = out.unionByName(render_segments(segments).select("job_id", F.lit(f"translation.{language}.txt").alias("name"), "content"))
    names = {f: f"subtitles.{language}.{f}" for f in ("srt", "vtt") if f in formats}
    return out.unionByName(subtitle_files(segments, names)) if names else out


def write_artifacts(rows: DataFrame, path: str) -> None:
    """One text file a job and name, by the committer of Spark, which ends every file with a line feed."""
    body = F.regexp_replace("content", r"\n\z", "").alias("content")
    rows.select("job_id", "name", body).repartition("job_id", "name").write.mode("overwrite").partitionBy("job_id", "name").text(path)


def event_lines(events: DataFrame) -> DataFrame:
    """job_id, event_id, frame: server-sent events. events: job_id, event_id, stage, and the payload's columns."""
    payload = F.to_json(F.struct(*[c for c in events.columns if c != "event_id"]))
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.col("stage"), F.lit("\ndata: "), payload, F.lit("\n\n"))
    return events.select("job_id", "event_id", frame.alias("frame"))


def benchmark_table(rows: DataFrame) -> DataFrame:
    """line: a Markdown table's rows. rows: device, total, inference, speed."""
    shown = F.when(F.col("speed") >= 10, F.format_string("%.0f", "speed")).otherwise(F.format_string("%.1f", "speed"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "device", F.format_string("%.2f s", "total"), F.format_string("%.2f s", "inference"), F.concat(shown, F.lit("×"))), F.lit(" |")).alias("line"))
