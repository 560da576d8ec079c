"""Coercions, choices and predicates that each look at one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import bytes_label, collapse

#: Fixed values of the domain.
MEDIA = (".aac", ".avi", ".flac", ".m4a", ".mka", ".mkv", ".mov", ".mp3", ".mp4", ".mpeg", ".mpg", ".oga", ".ogg", ".opus", ".wav", ".webm")
FORMATS = ("txt", "srt", "vtt", "json")
FILES = {"json": "transcript.json", "txt": "transcript.txt", "srt": "subtitles.srt", "vtt": "subtitles.vtt"}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
ENDED = ("completed", "failed", "cancelled", "interrupted")
LANGUAGE = r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$"
#: Kinds of errors with their HTTP status and process exit code; others have 500 and 1.
HTTP_STATUS = {"missing_job": 404, "duplicate_job": 409, "active_job": 409, "full_queue": 429, "configuration": 422, "media": 422, "validation": 422, "artifact_conflict": 409}
EXIT_CODES = {"cancelled": 130, "configuration": 2, "missing_dependency": 3, "media": 2, "model": 3, "unsupported": 4, "artifact_conflict": 2}


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def optional(text: Column, kind: str) -> Column:
    """A value of a kind, null for null or empty text; anything else that isn't one fails the query (ANSI cast)."""
    return blank_to_null(text).cast(kind)


def required(value: Column, text: Column, name: str) -> Column:
    """value, which was made of text; text that makes none fails the query."""
    return F.when(value.isNotNull() | blank_to_null(text).isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} is invalid: "), text)))


def whole(text: Column) -> Column:
    """A whole number, null for anything else."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))


def choice(text: Column, allowed: tuple[str, ...]) -> Column:
    """One of the allowed words in lower case, null for others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*allowed), t)


def flag(text: Column) -> Column:
    """Boolean words, null for others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def language_code(text: Column) -> Column:
    """Lower case without spaces around; null if it is no language tag."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike(LANGUAGE), t)


def is_media(name: Column) -> Column:
    return reduce(lambda a, e: a | F.lower(name).endswith(e), MEDIA[1:], F.lower(name).endswith(MEDIA[0]))


def under(path: Column, roots: Column) -> Column:
    """Is a path one of the roots or below one?"""
    return F.exists(roots, lambda r: (path == r) | path.startswith(F.concat(r, F.lit("/"))))


def resolved(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def upload_folder(path: Column, staging: str) -> Column:
    """The staging folder that an uploaded file lies in; its name has 32 hexadecimal digits."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder.rlike(r"/[0-9a-f]{32}$") & (F.regexp_extract(folder, r"^(.*)/[^/]*$", 1) == staging.rstrip("/")), folder)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pick_stream(streams: Column, wanted: Column) -> Column:
    """The audio stream with the wanted index, the first if none is wanted, null if it isn't there."""
    return F.when(wanted.isNull(), F.get(streams, F.lit(0))).otherwise(F.get(F.filter(streams, lambda s: s["index"] == wanted), F.lit(0)))


def stream_error(streams: Column, wanted: Column) -> Column:
    """What is said where the wanted stream isn't there: which ones are."""
    there = F.array_join(F.transform(streams, lambda s: s["index"].cast("string")), ", ")
    return F.when(wanted.isNotNull() & ~F.exists(streams, lambda s: s["index"] == wanted), F.concat(F.lit("Audio stream "), wanted.cast("string"), F.lit(" is unavailable; available indexes: "), there))


def passes_through(path: Column, codec: Column, rate: Column, channels: Column) -> Column:
    """Can a WAV file be used as it is?"""
    return F.coalesce(F.lower(path).endswith(".wav") & codec.isin("pcm_s16le", "pcm_f32le") & rate.between(8_000, 96_000) & channels.isin(1, 2), F.lit(False))


def artifacts_there(files: Column, formats: Column, language: Column | None = None) -> Column:
    """Are the JSON document and a file for each format among the names? With language: those of its translation."""
    if language is None:
        names = F.create_map(*[F.lit(x) for pair in FILES.items() for x in pair])
        name = lambda f: names[f]
        first = F.lit(FILES["json"])
    else:
        name = lambda f: F.concat(F.when(f.isin("srt", "vtt"), "subtitles.").otherwise("translation."), language, F.lit("."), f)
        first = F.concat(F.lit("translation."), language, F.lit(".json"))
    return F.array_contains(files, first) & F.forall(formats, lambda f: F.array_contains(files, name(f)))


def action(state: Column, resume: Column, force: Column, ready: Column, wanted: Column | None = None, made: Column | None = None, matches: Column | None = None, there: Column | None = None) -> Column:
    """What to do with a source that has a manifest (state not null) or none.

    A translation may be wanted: then a completed job is only ready if its translation matches and its files are there, and
    one that exists (made) with other settings is a conflict.
    """
    done = state.eqNullSafe(F.lit("completed"))
    none = F.lit(False)
    wanted, made, matches, there = (none if c is None else F.coalesce(c, none) for c in (wanted, made, matches, there))
    ready = ready & (~wanted | (matches & there))
    clash = done & resume & wanted & made & ~matches
    return F.when(state.isNull() | force, "new").when(done & resume & ready, "skip").when(clash, "translation conflict").when(resume, "resume").otherwise("conflict")


def managed(explicit: Column, installed: Column, default: Column | None = None) -> Column:
    """A setting that nobody has set (null, empty or still the default) comes from the installation, if that has one."""
    unset = blank_to_null(explicit).isNull() if default is None else explicit.eqNullSafe(default)
    return F.when(unset & installed.isNotNull(), installed).otherwise(blank_to_null(explicit))


def judged_edit(typed: Column, original: Column, most: int = 1000) -> Column:
    """kind (restore, invalid, set) and text of what was left in a line."""
    text = collapse(typed)
    kind = F.when(text == original, "restore").when((F.length(text) == 0) | (F.length(text) > most), "invalid").otherwise("set")
    return F.struct(kind.alias("kind"), F.when(kind != "invalid", text).alias("text"))


def valid_edit(index: Column, text: Column) -> Column:
    """An edit's text is null (restore) or has 1 to 1000 letters; its index isn't negative."""
    return (index >= 0) & (text.isNull() | F.length(collapse(text)).between(1, 1000))


def job_end(source: Column, stage: Column) -> Column:
    return source.isNull() & stage.isin(*ENDED)


def setup_end(stage: Column) -> Column:
    return stage.isin("completed", "failed", "cancelled")


def setup_stage(message: Column) -> Column:
    """The stage that a message speaks of; the first that fits."""
    return F.when(message.contains("runtime"), "installing_runtime").when(message.contains("model"), "installing_models").when(message.contains("configuration"), "configuring").otherwise("validating")


def failure_kind(code: Column) -> Column:
    return F.when(code == 3, "model").when(code == 4, "unsupported").when(code != 0, "inference")


def http_status(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in HTTP_STATUS.items() for x in pair])[kind], F.lit(500))


def bundled_library(name: Column, prefixes: list[str]) -> Column:
    """prefix.so or prefix.so.version of one of the prefixes."""
    return reduce(lambda a, p: a | (name == f"{p}.so") | name.startswith(f"{p}.so."), prefixes, F.lit(False))


def tool_ok(said: Column, major: int = 3, minor: int = 26) -> Column:
    """Is the first version in a tool's words of this major version and new enough?"""
    a, b = (F.regexp_extract(said, r"version (\d+)\.(\d+)", k).try_cast("int") for k in (1, 2))
    return F.coalesce((a == major) & (b >= minor), F.lit(False))


def backend(explicit: Column, saved: Column, legacy: Column, archive: Column, compiler: Column) -> Column:
    """The first that is known: asked for, saved, of an older installation, of an archive, of a compiler; else cpu."""
    asked = F.when(explicit != "auto", explicit)
    return F.coalesce(asked, saved, legacy, archive, compiler, F.lit("cpu"))


def path_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def http_options(settings: Column, allowed: tuple[str, ...]) -> Column:
    """Names of settings that aren't allowed, sorted."""
    return F.array_sort(F.array_except(settings, F.array(*[F.lit(a) for a in allowed])))


def settled(*levels: Column) -> Column:
    """A setting from the first level that has it: command line, environment, file, default."""
    return F.coalesce(*levels)


def formats_ok(formats: Column) -> Column:
    return (F.size(formats) > 0) & (F.size(F.array_except(formats, F.array(*[F.lit(f) for f in FORMATS]))) == 0)


def languages_ok(source: Column, target: Column) -> Column:
    """Both or neither, and not the same."""
    return (source.isNull() & target.isNull()) | F.coalesce(source != target, F.lit(False))


def playable(upload: Column, local: Column, local_allowed: Column, kept: Column, kept_inside: Column) -> Column:
    """The file to play: the stored upload, else the source if its folder is allowed, else audio kept with the job."""
    return F.coalesce(upload, F.when(local_allowed, local), F.when(kept_inside, kept))


def progress_shown(stage: Column, status: Column) -> Column:
    return (status == "started") | stage.isin(*ENDED)


def exit_code(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair])[kind], F.lit(1))


def translation_matches(made: Column, model_sha: Column, source: Column, target: Column) -> Column:
    """Was a translation (struct of model_sha, source_language, target_language) made by this model in these languages?"""
    return F.coalesce(made["model_sha"].eqNullSafe(model_sha) & made["source_language"].eqNullSafe(source) & made["target_language"].eqNullSafe(target), F.lit(False)) & made.isNotNull() & target.isNotNull()


def kept_lines(text: Column, recorded: dict[str, Column]) -> Column:
    """The lines of a settings text without those that only repeat a recorded value; the rest as they are, in order."""
    names = "|".join(recorded)

    def repeats(line: Column) -> Column:
        name, value = (F.regexp_extract(line, rf"^\s*({names})\s*=\s*(.*?)\s*$", k) for k in (1, 2))
        return (name != "") & F.coalesce(F.create_map(*[x for k, v in recorded.items() for x in (F.lit(k), v)])[name] == value, F.lit(False))

    return F.array_join(F.filter(F.split(text, "(?<=\n)"), lambda x: ~repeats(F.regexp_replace(x, "[\r\n]+$", ""))), "")


#: What is said of an installation, in order.
ISSUES = ("setup has not been completed", "runtime is missing or its checksum changed", " model is missing or its checksum changed", "ASR model is not installed", "configuration file is missing", "diagnostics have not completed", "the last diagnostic run was not ready")
HEADLINES = ("Checking the installation…", "Using your own configuration", "Not installed yet", "Installed, but needs repair", "Installed and ready")
TONES = ("muted", "ok", "warning", "warning", "ok")
INSTALL_NOTE = "Choose a backend below and install the engine and speech model."
OWN_NOTE = "The installation record is missing, but your configuration already points at a working engine and models, so transcription is ready. Running setup would install managed copies alongside them."


def setup_issues(installed: Column, runtime_ok: Column, models_ok: Column, has_asr: Column, config_there: Column, doctor: Column) -> Column:
    """What is wrong with an installation, in order; it is ready if nothing is. models_ok: array of (kind, ok); doctor: true,
    false or null if never run."""
    models = F.transform(F.filter(models_ok, lambda m: ~m["ok"]), lambda m: F.concat(m["kind"], F.lit(ISSUES[2])))
    last = F.array(F.when(~has_asr, ISSUES[3]), F.when(~config_there, ISSUES[4]), F.when(doctor.isNull(), ISSUES[5]).when(~doctor, ISSUES[6]))
    return F.when(~installed, F.array(F.lit(ISSUES[0]))).otherwise(F.array_compact(F.concat(F.array(F.when(~runtime_ok, ISSUES[1])), models, last)))


def setup_actions(reuse: Column, legacy: Column, archive: Column) -> Column:
    """How an asset is had: reused, taken over, from an archive, or built."""
    return F.when(reuse, "reuse").when(legacy, "adopt").when(archive, "install").otherwise("build")


def install_summary(installed: Column, ready: Column, works: Column, issues: Column) -> Column:
    """headline, notes and tone on an installation: unknown (null), not recorded though what is configured works, absent,
    broken or ready."""
    case = F.when(installed.isNull(), 0).when(~installed & works, 1).when(~installed, 2).when(~ready, 3).otherwise(4)
    notes = F.when(case == 0, F.array().cast("array<string>")).when(case == 1, F.array(F.lit(OWN_NOTE))).when(case == 2, F.array(F.lit(INSTALL_NOTE))).otherwise(F.coalesce(issues, F.array().cast("array<string>")))
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), case + 1)
    return F.struct(pick(HEADLINES).alias("headline"), notes.alias("notes"), pick(TONES).alias("tone"))


def feature_installed(name: Column, features: Column, working: Column) -> Column:
    return F.array_contains(features, name) | F.coalesce(working, F.lit(False))


def route(fragment: Column) -> Column:
    """name and id of the screen that a URL's fragment asks for."""
    path = F.split(F.regexp_replace(fragment, "^#", ""), r"\?")[0]
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n, first = F.size(parts), F.get(parts, F.lit(0))
    name = F.when(n == 0, "new").when((n == 1) & first.isin("jobs", "storage", "setup"), first).when((n == 2) & (first == "jobs"), "job").otherwise("not-found")
    return F.struct(name.alias("name"), F.when(name == "job", F.try_url_decode(F.get(parts, F.lit(1)))).alias("id"))


def query_string(params: Column) -> Column:
    """?name=value&... of a map's entries that have a value, encoded, by name."""
    kept = F.filter(F.array_sort(F.map_entries(params)), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    text = F.array_join(F.transform(kept, lambda e: F.concat_ws("=", F.url_encode(e["key"]), F.url_encode(e["value"]))), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def api_error(status: Column, reason: Column, body: Column) -> Column:
    """code and message of a failed request: from its JSON body, else from the status."""
    v = F.try_parse_json(body)
    said = F.try_variant_get(v, "$.error.message", "string")
    return F.struct(F.when(said.isNotNull(), F.try_variant_get(v, "$.error.code", "string")).alias("code"), F.coalesce(said, F.rtrim(F.concat_ws(" ", F.lit("The server answered"), status.cast("string"), reason))).alias("message"))


def field_errors(errors: Column) -> Column:
    """field (the place, dotted) and message of each error (loc: array of text, msg)."""
    return F.transform(errors, lambda e: F.struct(F.array_join(e["loc"], ".").alias("field"), e["msg"].alias("message")))


def job_options_error(formats: Column, translate: Column, source: Column, target: Column, stream: Column, workers: Column) -> Column:
    """What is wrong with the options of a job, null if nothing. Numbers come as text, empty for none."""
    whole = lambda c, low, high: c.isNull() | (c == "") | F.coalesce(c.try_cast("int").between(low, high) & c.rlike(r"^\d+$"), F.lit(False))
    return F.when(F.size(F.array_intersect(formats, F.array(*[F.lit(f) for f in FORMATS]))) == 0, "formats").when(translate & (F.coalesce(blank_to_null(source), blank_to_null(target)).isNull() | blank_to_null(source).isNull() | blank_to_null(target).isNull()), "languages").when(translate & (source == target), "same language").when(~whole(stream, 0, (1 << 31) - 1), "stream").when(~whole(workers, 1, 8), "workers")


#: What is said of uploads that are too large.
LIMIT_TEXT = ("The selected files total ", ", but the server accepts at most ", " per upload. ", "Restart with a larger --max-upload-mb, or enter local paths instead.", "Restart with a larger --max-upload-mb.")


def limit_message(total: Column, limit: Column, local_paths: Column) -> Column:
    """The text to show instead of sending files that are too large, null if they fit or there is no limit."""
    a, b, c, local, plain = LIMIT_TEXT
    return F.when(upload_too_large(total, limit), F.concat(F.lit(a), bytes_label(total), F.lit(b), bytes_label(limit), F.lit(c), F.when(local_paths, local).otherwise(plain)))


def upload_too_large(total: Column, limit: Column) -> Column:
    return F.coalesce((limit > 0) & (total > limit), F.lit(False))
