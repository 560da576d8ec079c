"""Cues, wrapping and rendering against small cases and a plain reading of the rules."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from cuemill.functions import text as T
from cuemill.operators import cues as C

WORDS = "job_id string, idx int, text string, start double, end double, speaker string"


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def joined(tokens):
    out = ""
    for t in tokens:
        out += t if not out or t[:1] in ".,!?;:%)]}…" else " " + t
    return out


def plain_wrap(text, width=42):
    if len(text) <= width:
        return text
    lines = textwrap.wrap(text, width=width, break_long_words=False, break_on_hyphens=False)
    if len(lines) <= 2:
        return "\n".join(lines)
    spots = [m.start() for m in re.finditer(r"\s+", text)]
    if not spots:
        return text
    at = min(spots, key=lambda p: abs(p - len(text) // 2))
    return text[:at].strip() + "\n" + text[at:].strip()


def plain_cues(words, duration=None):
    groups, first, chars = [], 0, 0
    for i, (t, s, e, sp) in enumerate(words):
        chars += len(t) + (1 if chars else 0)
        nxt = words[i + 1] if i + 1 < len(words) else None
        if nxt is None or nxt[3] != sp or nxt[1] - e >= 0.8 or e - words[first][1] >= 7.0 or chars + 1 + len(nxt[0]) > 84 or re.search(r"[.!?…][\"'”’)]*$", t):
            groups.append((first, i + 1))
            first, chars = i + 1, 0
    out, past = [], 0.0
    for k, (a, b) in enumerate(groups):
        body = joined([w[0] for w in words[a:b]]).strip()
        start = max(words[a][1], past)
        caps = ([duration] if duration is not None else []) + ([words[groups[k + 1][0]][1] - 0.001] if k + 1 < len(groups) else [])
        end = max(min([max(words[b - 1][2], start + 0.7, start + len(body) / 20.0), *caps]), start + 0.001)
        out.append((k, plain_wrap(body), start, end, words[a][3], a, b))
        past = end
    return out


def test_wrap_matches_textwrap(spark):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.choice((1, 2, 3, 5, 8, 13, 50)) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["x" * 100, "", "a  b " * 20]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.wrap_lines(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in rows} == {i: plain_wrap(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("tokens", [["Hello", ",", "world", "!"], ["", "a"], ["a", "", "b"], ["(", "x", ")"], [",", "a"], []])
def test_join_tokens(spark, tokens):
    assert one(spark, T.join_tokens(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))) == joined(tokens)


def test_cues_match_the_rules(spark):
    rng = random.Random(7)
    jobs = {}
    for j in range(40):
        at, ws = 0.0, []
        for _ in range(rng.randint(1, 120)):
            at += rng.choice((0.0, 0.0005, 0.05, 0.3, 0.8, 1.0, 2.5))
            end = at + rng.choice((0.0, 0.1, 0.4, 3.0))
            ws.append((rng.choice(("a", "word", "longerword", "stop.", 'said."', "x" * 30, ",")), at, end, rng.choice((None, "1", "1", "1", "2"))))
            at = end if rng.random() < 0.9 else at
        jobs[f"j{j}"] = ws
    words = spark.createDataFrame([(j, i, *w) for j, ws in jobs.items() for i, w in enumerate(ws)], WORDS)
    durations = spark.createDataFrame([(j, ws[-1][2] + 0.5 if k % 2 else None) for k, (j, ws) in enumerate(jobs.items())], "job_id string, duration double")
    got = {}
    for r in C.build_cues(words, durations).collect():
        got.setdefault(r["job_id"], []).append((r["cue"], r["text"], r["start"], r["end"], r["speaker"], r["word_start"], r["word_end"]))
    for k, (j, ws) in enumerate(jobs.items()):
        assert sorted(got[j]) == plain_cues(ws, ws[-1][2] + 0.5 if k % 2 else None), j


def test_two_speakers_render(spark):
    words = spark.createDataFrame([("a", 0, "Hello", 0.0, 0.3, "1"), ("a", 1, "world.", 0.4, 0.8, "1"), ("a", 2, "Привет", 2.0, 2.4, "2"), ("a", 3, "мир!", 2.5, 2.9, "2")], WORDS)
    cues = C.build_cues(words, spark.createDataFrame([("a", 4.0)], "job_id string, duration double"))
    assert cues.count() == 2
    assert C.render_srt(cues).first()["content"] == "1\n00:00:00,000 --> 00:00:00,800\n[Speaker 1] Hello world.\n\n2\n00:00:02,000 --> 00:00:02,900\n[Speaker 2] Привет мир!\n"
    assert C.render_vtt(cues).first()["content"].startswith("WEBVTT\n\n00:00:00.000 --> ")
    assert C.render_text(words, spark.createDataFrame([("a", "x")], "job_id string, text string")).first()["content"] == "Speaker 1: Hello world.\nSpeaker 2: Привет мир!\n"


def test_unnamed_speakers(spark):
    rows = [("a", 0, "x", 0.0, 1.0, None), ("a", 1, "y", 1.0, 2.0, "1"), ("a", 2, "z", 2.0, 3.0, None)]
    text = C.render_text(spark.createDataFrame(rows, WORDS), spark.createDataFrame([("a", " x "), ("b", " only text ")], "job_id string, text string"))
    assert {r["job_id"]: r["content"] for r in text.collect()} == {"a": "Speaker None: x\nSpeaker 1: y\nSpeaker unknown: z\n", "b": "only text\n"}


def test_segments_as_text(spark):
    schema = "job_id string, cue int, text string, speaker string"
    rows = [("a", 0, "Hello,\nworld.", None), ("a", 1, "Again.", None), ("b", 0, "Hi.", "0"), ("b", 1, "Yes.", "1"), ("c", 0, "Who", None), ("c", 1, "me", "1")]
    got = {r["job_id"]: r["content"] for r in C.render_segments(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "Hello, world. Again.\n", "b": "Speaker 0: Hi.\nSpeaker 1: Yes.\n", "c": "Speaker unknown: Who\nSpeaker 1: me\n"}


def test_position_to_row(spark):
    cues = spark.createDataFrame([("a", 0, 1.0, 3.0), ("a", 1, 5.0, 6.0), ("a", 2, 20.0, 21.0)], "job_id string, cue int, start double, end double")
    at = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 3.5, 5.2, 12.0, 20.5)], "job_id string, at double")
    assert [r["cue"] for r in C.current_rows(at, cues).orderBy("at").collect()] == [-1, 0, 0, 1, -1, 2]


def test_find(spark):
    rows = spark.createDataFrame([("Hello World", "Привет", "Speaker 1")], "text string, translation string, label string")
    for needle, n in (("", 1), ("  ", 1), ("WORLD", 1), ("привет", 1), ("speaker 1", 1), ("nope", 0)):
        assert C.found_rows(rows, needle, "text", "translation", "label").count() == n


def test_white_space_and_labels(spark):
    for raw, want in (("a b", "a b"), (" a  b　", "a b"), ("a b\u0085c\x1cd", "a b c d"), ("﻿a", "﻿a"), ("   ", ""), ("", "")):
        assert one(spark, T.collapse(F.lit(raw))) == want
    for s, want in ((0.0, "00:00:00,000"), (3661.0015, "01:01:01,002"), (-1.0, "00:00:00,000"), (360000.0, "100:00:00,000"), (59.9996, "00:01:00,000")):
        assert one(spark, T.clock(F.lit(s))) == want
    for n, want in ((0, "0 B"), (1023, "1023 B"), (1536, "1.50 KB"), (10 * 1024, "10.0 KB"), (200 * 1024, "200 KB"), (-1, "–"), (3 * 1024**4, "3.00 TB")):
        assert one(spark, T.bytes_label(F.lit(n))) == want
    for s, want in ((75.0, "1:15"), (3725.0, "1:02:05"), (-1.0, "–"), (float("nan"), "–"), (0.0, "0:00")):
        assert one(spark, T.duration_label(F.lit(s))) == want
    for x, want in ((0.5, "50 %"), (2.0, "100 %"), (-1.0, "0 %"), (float("nan"), "–"), (0.125, "13 %")):
        assert one(spark, T.percent_label(F.lit(x))) == want
    assert one(spark, T.plural(F.lit(1), "file")) == "1 file" and one(spark, T.plural(F.lit(3), "file")) == "3 files"
    assert one(spark, T.display_name(F.lit("001-a.wav"), F.lit(True))) == "a.wav"
    assert one(spark, T.safe_stem(F.lit("Запись №1.mp3"))) == "Запись-1"
    assert one(spark, T.safe_stem(F.lit("???.mp3"))) == "media"
    assert one(spark, T.upload_name(F.lit("a b.wav"), F.lit(7))) == "007-a-b.wav"
    assert one(spark, T.first_line(F.lit("\n  \n x \ny"))) == "x"
    assert one(spark, T.tool_version(F.lit(""), F.lit(" v1\nmore"))) == "v1"
    assert one(spark, T.field_of(F.lit("a: 1\nModel name:  Z 9\n"), "Model name")) == "Z 9"
    assert one(spark, T.linked_library(F.lit("\tlibx.so.1 => /lib/libx.so.1 (0x00ff)"))).asDict() == {"name": "libx.so.1", "target": "/lib/libx.so.1"}
    assert one(spark, T.linked_library(F.lit("liby.so => not found")))["target"] is None


def test_subtitles_share_one_gathering(spark):
    """Both kinds under their names as they are by themselves, of cues that are gathered once; jobs without cues have a header."""
    cues_ = spark.createDataFrame([(1, 1, "b " * 60, 2.0, 3.5, None), (1, 0, "a", 0.0, 1.0, "x"), (2, 0, "c", 0.0, 1.0, None)], "job_id bigint, cue int, text string, start double, end double, speaker string")
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id bigint")
    made = C.subtitle_files(cues_, {"srt": "s", "vtt": "v"}, jobs)
    want = {(r["job_id"], "s", r["content"]) for r in C.render_srt(cues_).collect()} | {(r["job_id"], "v", r["content"]) for r in C.render_vtt(cues_, jobs).collect()}
    assert {tuple(r) for r in made.collect()} == want and len(want) == 5
    assert made._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1


def test_words_are_dealt_by_letters(spark):
    from cuemill.plans import views

    rows = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "job_id bigint, text string")
    assert views.dealt(rows, "job_id", 500).rdd.getNumPartitions() == 40
    assert views.dealt(rows.where("job_id < 0"), "job_id").count() == 0


def test_long_plain_texts_are_wrapped(spark):
    texts = spark.createDataFrame([("aaa " * 60 + "b",), ("a" * 42 + " " + "b" * 42,), ("a" * 30 + " " + "b" * 12 + " c",)], "t string")
    rows = [r[0] for r in texts.select(T.wrap_lines(F.col("t"))).collect()]
    assert [r.count("\n") for r in rows] == [1, 1, 1] and rows[1:] == ["a" * 42 + "\n" + "b" * 42, "a" * 30 + "\n" + "b" * 12 + " c"]
