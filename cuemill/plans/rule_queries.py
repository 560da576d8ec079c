"""Queries on rules, labels, documents and workflow steps, a row for each order, part or customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import identity, jobs, validate, workflow
from cuemill.operators.ordinals import with_base
from cuemill.plans import views
from cuemill.plans.registry import Queries
from cuemill.plans.views import table
from cuemill.sources import ingest, sinks

query = Queries()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS stream, CASE o_orderkey % 3 WHEN 0 THEN o_custkey END AS whole, CASE WHEN o_orderkey % 3 = 0 THEN 'cuda' END AS device, CASE WHEN o_orderkey % 4 = 0 THEN '/i/asr' WHEN o_orderkey % 4 = 1 THEN '/own' END AS model, CASE WHEN o_orderkey % 5 = 0 THEN 'vulkan' ELSE 'cpu' END AS managed FROM orders")
def p1_p9_p11_settings(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", rules.optional(F.when(key % 2 == 0, cust.cast("string")).otherwise(""), "bigint").alias("stream"), rules.whole(F.when(key % 3 == 0, F.concat(F.lit(" "), cust)).otherwise("1.5")).alias("whole"),
        rules.choice(F.when(key % 3 == 0, " CUDA ").otherwise("gpu"), ("auto", "cpu", "cuda")).alias("device"), rules.managed(F.when(key % 4 == 1, "/own").when(key % 4 == 2, ""), F.when(key % 4 == 0, "/i/asr")).alias("model"),
        rules.managed(F.when(key % 5 == 0, "auto").otherwise("cpu"), F.lit("vulkan"), F.lit("auto")).alias("managed"),
    )


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS formats_ok, o_orderkey % 3 = 0 OR o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 AS languages_ok, o_orderkey % 4 > 0 AND o_orderkey % 7 <> 0 AS edit_ok FROM orders")
def p12_p14_valid_settings(spark, d):
    key = F.col("o_orderkey")
    formats = F.filter(F.array(F.when(key % 2 == 0, "txt").otherwise("docx"), F.lit("srt")), lambda f: key % 5 != 0)
    source = F.when(key % 3 == 1, "en").when(key % 3 == 2, F.when(key % 2 == 0, "en").otherwise("de"))
    target = F.when(key % 3 == 2, "de")
    typed = F.when(key % 7 == 0, F.lit("x" * 1001)).when(key % 7 == 1, F.lit(None)).otherwise(" a ")
    return table(spark, d, "orders").select("o_orderkey", rules.formats_ok(formats).alias("formats_ok"), rules.languages_ok(source, target).alias("languages_ok"), rules.valid_edit((key % 4 - 1).cast("int"), typed).alias("edit_ok"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'Audio stream 9 is unavailable; available indexes: 1, 4' END AS error, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 4 END AS picked FROM orders""")
def p16_audio_streams(spark, d):
    key = F.col("o_orderkey")
    streams = F.array(F.struct(F.lit(1).alias("index")), F.struct(F.lit(4).alias("index")))
    wanted = F.when(key % 4 == 1, 1).when(key % 4 == 2, 4).when(key % 4 == 3, 9)
    return table(spark, d, "orders").select("o_orderkey", rules.stream_error(streams, wanted).alias("error"), rules.pick_stream(streams, wanted)["index"].alias("picked"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS matches, CASE WHEN o_orderkey % 3 = 0 THEN '/s/' || md5(CAST(o_orderkey AS VARCHAR)) END AS folder, array_to_string(CASE WHEN o_orderkey % 2 = 0 THEN ['model', 'zone'] ELSE ['model'] END, ',') AS refused, CASE o_orderkey % 4 WHEN 0 THEN 130 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 1 END AS code, CASE WHEN o_orderkey % 2 = 0 THEN 409 ELSE 500 END AS status FROM orders""")
def p19_p23_p30_p34_matches(spark, d):
    key = F.col("o_orderkey")
    made = F.when(key % 5 != 5, F.struct(F.when(key % 2 == 0, "m").otherwise("x").alias("model_sha"), F.lit("en").alias("source_language"), F.lit("de").alias("target_language")))
    path = F.concat(F.lit("/s/"), F.when(key % 3 == 0, F.md5(key.cast("string"))).when(key % 3 == 1, "short").otherwise(F.concat(F.md5(key.cast("string")), F.lit("/deeper"))), F.lit("/a.wav"))
    kind = F.when(key % 4 == 0, "cancelled").when(key % 4 == 1, "model").when(key % 4 == 2, "unsupported").otherwise("other")
    settings = F.filter(F.array(F.lit("zone"), F.lit("formats"), F.lit("model")), lambda s: (s != "zone") | (key % 2 == 0))
    return table(spark, d, "orders").select(
        "o_orderkey", rules.translation_matches(made, F.lit("m"), F.lit("en"), F.when(key % 3 == 0, "de").otherwise("fr")).alias("matches"), rules.upload_folder(path, "/s/").alias("folder"),
        F.array_join(rules.http_options(settings, ("formats", "diarize")), ",").alias("refused"), rules.exit_code(kind).alias("code"), rules.http_status(F.when(key % 2 == 0, "active_job").otherwise("other")).alias("status"),
    )


@query("""SELECT o_orderkey, '# own' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'model = /other' || chr(10) END || 'zone=1' AS kept, o_orderkey % 4 IN (0, 1) AS bundled, CASE o_orderkey % 5 WHEN 0 THEN 'cuda' WHEN 1 THEN 'cpu' WHEN 2 THEN 'vulkan' WHEN 3 THEN 'hip' ELSE 'cpu' END AS backend,
  CASE WHEN o_orderkey % 6 = 0 THEN 'reuse' WHEN o_orderkey % 6 < 3 THEN 'adopt' WHEN o_orderkey % 6 < 5 THEN 'install' ELSE 'build' END AS action, CASE o_orderkey % 4 WHEN 0 THEN '/u' WHEN 1 THEN '/l' WHEN 2 THEN '/k' END AS playable, o_orderkey % 4 = 0 AS tool_ok, CASE WHEN o_orderkey % 2 = 0 THEN '/abs' ELSE '/root/rel' END AS resolved FROM orders""")
def p36_p37_p38_p39_p40_p42_p44_setup(spark, d):
    key = F.col("o_orderkey")
    settings = F.concat(F.lit("# own\nmodel = "), F.when(key % 2 == 0, "/m").otherwise("/other"), F.lit("\nzone=1"))
    library = F.when(key % 4 == 0, "libnccl.so").when(key % 4 == 1, "libnccl.so.2").when(key % 4 == 2, "libnccl.sox").otherwise("libc.so")
    n = key % 5
    chosen = rules.backend(F.when(n == 0, "cuda").otherwise("auto"), F.when(n == 1, "cpu"), F.when(n == 2, "vulkan"), F.when(n == 3, "hip"), F.lit(None).cast("string"))
    said = F.when(key % 4 == 0, "cmake version 3.26.4").when(key % 4 == 1, "cmake version 3.9").when(key % 4 == 2, "cmake version 4.40").otherwise("no tool")
    m = key % 4
    return table(spark, d, "orders").select(
        "o_orderkey", rules.kept_lines(settings, {"model": F.lit("/m")}).alias("kept"), rules.bundled_library(library, list(identity.REDISTRIBUTABLE)).alias("bundled"), chosen.alias("backend"),
        rules.setup_actions(key % 6 == 0, key % 6 < 3, key % 6 < 5).alias("action"), rules.playable(F.when(m == 0, "/u"), F.lit("/l"), m == 1, F.lit("/k"), m == 2).alias("playable"),
        rules.tool_ok(said).alias("tool_ok"), rules.resolved(F.when(key % 2 == 0, "/abs").otherwise("rel"), "/root/").alias("resolved"),
    )


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 6 <> 0 AS installed, o_orderkey % 2 = 0 AS runtime, o_orderkey % 3 = 0 AS asr, o_orderkey % 5 = 0 AS config, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS doctor FROM orders),
i AS (SELECT *, CASE WHEN NOT installed THEN ['setup has not been completed'] ELSE list_filter([CASE WHEN NOT runtime THEN 'runtime is missing or its checksum changed' END, CASE WHEN k % 7 = 0 THEN 'asr model is missing or its checksum changed' END, CASE WHEN NOT asr THEN 'ASR model is not installed' END, CASE WHEN NOT config THEN 'configuration file is missing' END, CASE WHEN doctor IS NULL THEN 'diagnostics have not completed' WHEN NOT doctor THEN 'the last diagnostic run was not ready' END], lambda x: x IS NOT NULL) END AS issues FROM s)
SELECT k AS o_orderkey, array_to_string(issues, ';') AS issues, CASE WHEN k % 11 = 0 THEN 'Checking the installation…' WHEN NOT installed AND k % 12 = 0 THEN 'Using your own configuration' WHEN NOT installed THEN 'Not installed yet' WHEN len(issues) > 0 THEN 'Installed, but needs repair' ELSE 'Installed and ready' END AS headline,
  CASE WHEN k % 11 = 0 THEN 'muted' WHEN NOT installed AND k % 12 = 0 THEN 'ok' WHEN NOT installed OR len(issues) > 0 THEN 'warning' ELSE 'ok' END AS tone, CASE WHEN k % 11 = 0 THEN 0 WHEN NOT installed THEN 1 ELSE len(issues) END AS notes FROM i""")
def a12_p35_installations(spark, d):
    key = F.col("o_orderkey")
    models = F.array(F.struct(F.lit("asr").alias("kind"), (key % 7 != 0).alias("ok")))
    installed, doctor = key % 6 != 0, F.when(key % 4 == 0, F.lit(None)).otherwise(key % 4 > 1).cast("boolean")
    rows = table(spark, d, "orders").select("o_orderkey", installed.alias("installed"), rules.setup_issues(installed, key % 2 == 0, models, key % 3 == 0, key % 5 == 0, doctor).alias("issues"))
    said = rules.install_summary(F.when(key % 11 != 0, F.col("installed")), F.size("issues") == 0, key % 12 == 0, F.col("issues"))
    return rows.withColumn("said", said).select("o_orderkey", F.array_join("issues", ";").alias("issues"), "said.headline", "said.tone", F.size("said.notes").alias("notes"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'formats' WHEN 1 THEN 'languages' WHEN 2 THEN 'same language' WHEN 3 THEN 'stream' WHEN 4 THEN 'workers' END AS error, 'body.items.' || o_orderkey AS field, CASE WHEN o_orderkey % 2 = 0 THEN 'The selected files total ' || (o_orderkey % 500 + 101) || ' B, but the server accepts at most 100 B per upload. Restart with a larger --max-upload-mb' || CASE WHEN o_orderkey % 3 = 0 THEN ', or enter local paths instead.' ELSE '.' END END AS upload FROM orders""")
def p29_p45_a15_form_errors(spark, d):
    key = F.col("o_orderkey")
    n = key % 7
    formats = F.filter(F.array(F.lit("srt")), lambda f: n != 0)
    error = rules.job_options_error(formats, n.isin(1, 2), F.when(n == 1, "").otherwise("en"), F.lit("en"), F.when(n == 3, "-1").otherwise("2"), F.when(n == 4, "9").otherwise(""))
    fields = rules.field_errors(F.array(F.struct(F.array(F.lit("body"), F.lit("items"), key.cast("string")).alias("loc"), F.lit("bad").alias("msg"))))
    size = F.when(key % 2 == 0, key % 500 + 101).otherwise(50)
    return table(spark, d, "orders").select("o_orderkey", error.alias("error"), fields[0]["field"].alias("field"), rules.limit_message(size, F.lit(100), key % 3 == 0).alias("upload"))


@query("""SELECT c_custkey, printf('%03d-', c_custkey % 1000) || CASE WHEN c_custkey % 3 = 0 THEN 'media' ELSE 'ä-' || c_custkey || '.WAV' END AS stored, CASE WHEN c_custkey % 2 = 0 THEN 'x.wav' ELSE '012-x.wav' END AS shown, CASE c_custkey % 4 WHEN 0 THEN 'SRT subtitles' WHEN 1 THEN 'Plain text (edited)' WHEN 2 THEN 'de.srt' ELSE 'edited.other (edited)' END AS label,
  CASE c_custkey % 3 WHEN 0 THEN 'tool ' || c_custkey WHEN 1 THEN 'on stderr' ELSE 'unknown' END AS version, CASE WHEN c_custkey % 2 = 0 THEN 'libx.so' END AS library, CASE WHEN c_custkey % 4 = 0 THEN '/lib/libx.so' END AS target, 'é' || c_custkey || '_.-' AS stem FROM customer""")
def t13_t14_t19_t23_t27_w9_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "/a/b/ ?").otherwise(F.concat(F.lit("/a/ä ? "), k, F.lit(".WAV")))
    artifact = F.when(k % 4 == 0, "srt").when(k % 4 == 1, "edited.txt").when(k % 4 == 2, "de.srt").otherwise("edited.other")
    line = F.when(k % 4 == 0, "\tlibx.so => /lib/libx.so (0x7f00)").when(k % 4 == 2, "\tlibx.so => not found").otherwise("\tstatically linked")
    library = text.linked_library(line)
    return table(spark, d, "customer").select(
        "c_custkey", text.upload_name(name, (k % 1000).cast("int")).alias("stored"), text.display_name(F.lit("012-x.wav"), k % 2 == 0).alias("shown"), text.artifact_label(artifact).alias("label"),
        text.tool_version(F.when(k % 3 == 0, F.concat(F.lit("\n tool "), k, F.lit("\nmore"))).otherwise(""), F.when(k % 3 == 1, " on stderr\n")).alias("version"), library["name"].alias("library"), library["target"].alias("target"),
        text.safe_stem(F.concat(F.lit("-é"), k, F.lit("_.-!.tar.gz"))).substr(F.lit(1), F.length(F.concat(F.lit("é"), k, F.lit("_.-")))).alias("stem"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'jobs' WHEN 2 THEN 'job' WHEN 3 THEN 'not-found' ELSE 'setup' END AS route, CASE WHEN c_custkey % 5 = 2 THEN 'a b' || c_custkey END AS id, '?a=' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '&b=x+y' ELSE '' END AS query, CASE WHEN c_custkey % 2 = 0 THEN 'c' END AS code, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey ELSE 'The server answered 502 Bad' END AS message, greatest(0, CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 40 END) AS page FROM customer""")
def t24_t25_t26_l8_requests(spark, d):
    k = F.col("c_custkey")
    fragment = F.when(k % 5 == 0, "").when(k % 5 == 1, "#/jobs").when(k % 5 == 2, F.concat(F.lit("#/jobs/a%20b"), k, F.lit("?x=1"))).when(k % 5 == 3, "#/jobs/a/b").otherwise("#/setup")
    params = F.create_map(F.lit("b"), F.when(k % 2 == 0, "x y").otherwise(""), F.lit("a"), k.cast("string"))
    body = F.when(k % 2 == 0, F.concat(F.lit('{"error":{"code":"c","message":"m'), k, F.lit('"}}'))).otherwise("<html>")
    where, error = rules.route(fragment), rules.api_error(F.lit(502), F.lit("Bad"), body)
    page = F.when(k % 3 == 0, jobs.page_offset(40, 0, 30)).otherwise(jobs.page_offset(40, 5, 100))
    return table(spark, d, "customer").select("c_custkey", where["name"].alias("route"), where["id"].alias("id"), rules.query_string(params).alias("query"), error["code"].alias("code"), error["message"].alias("message"), page.alias("page"))


@query("""SELECT o_orderkey, sha256('/data/' || o_custkey || chr(0) || CASE WHEN o_orderkey % 2 = 0 THEN '/out' ELSE '<default-output>' END) AS mutation,
  sha256('{"force":' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"inputs":[{"modified_ns":' || o_orderkey || ',"path":"/data/' || o_custkey || '","size":5},{"missing":true,"path":"/data/caf\\u00e9"}],"output_dir":null}') AS request FROM orders""")
def h3_h4_request_ids(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("/data/"), cust)
    inputs = F.array(identity.path_identity(path, F.lit(5), key), identity.path_identity(F.lit("/data/café"), F.lit(None).cast("bigint"), key))
    request = identity.request_id(inputs, {"output_dir": F.lit("null"), "force": F.when(key % 3 == 0, "true").otherwise("false")})
    return table(spark, d, "orders").select("o_orderkey", identity.mutation_key(path.cast("string"), F.when(key % 2 == 0, "/out")).alias("mutation"), request.alias("request"))


_REGISTRY = """m AS (SELECT 'model' AS kind, CASE WHEN p_partkey % 50 = 0 THEN 'same' ELSE 'm' || p_partkey END AS id, CASE WHEN p_partkey % 7 = 0 THEN 'main' ELSE sha1(p_name) END AS revision, CASE WHEN p_partkey % 11 = 0 THEN 'x' WHEN p_partkey % 2 = 0 THEN sha256(p_name) END AS sha, CASE WHEN p_partkey % 13 = 0 THEN 'http://a' ELSE 'https://a' END AS url FROM part)"""


@query(f"""WITH {_REGISTRY}, a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN '../a' ELSE 'a' || s_suppkey END AS filename FROM supplier)
SELECT kind, id, fault FROM (SELECT kind, id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate' WHEN revision = 'main' THEN 'revision' WHEN sha = 'x' THEN 'digest' WHEN url = 'http://a' THEN 'url' END AS fault FROM m) WHERE fault IS NOT NULL
UNION ALL SELECT 'archive', filename, CASE WHEN k % 5 = 0 THEN 'digest' WHEN filename = '../a' THEN 'filename' ELSE 'url' END FROM a WHERE k % 5 = 0 OR filename = '../a' OR k % 4 = 0""")
def v4_registry_faults(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    models = table(spark, d, "part").select(F.when(k % 50 == 0, "same").otherwise(F.concat(F.lit("m"), k)).alias("id"), F.lit("asr").alias("kind"), F.when(k % 7 == 0, "main").otherwise(F.sha1("p_name")).alias("revision"), F.when(k % 11 == 0, "x").when(k % 2 == 0, F.sha2("p_name", 256)).alias("sha256"), F.when(k % 13 == 0, "http://a").otherwise("https://a").alias("url"))
    archives = table(spark, d, "supplier").select(s.cast("string").alias("backend"), F.lit("linux").alias("system"), F.lit("x86_64").alias("architecture"), F.array(F.lit("asr")).alias("features"), F.when(s % 9 == 0, "../a").otherwise(F.concat(F.lit("a"), s)).alias("filename"), F.when(s % 4 == 0, F.lit(None).cast("string")).otherwise("https://a").alias("url"), F.when(s % 5 == 0, "x").otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return validate.registry_faults(models, archives)


@query(f"WITH {views.RESULTS} SELECT job_id AS run, count(*) = 1 AND bool_and(state = 'completed' AND error IS NULL AND job_id % 3 = 0) AS ok FROM results GROUP BY job_id")
def v5_benchmark_ok(spark, d):
    r = views.results(spark, d).select(F.col("job_id").alias("run"), "state", F.lit(False).alias("skipped"), "error", F.when(F.col("job_id") % 3 == 0, "cuda").otherwise("cpu").alias("device"))
    return workflow.benchmark_ok(r, "cuda")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 1 END AS n, CAST(o_totalprice AS DOUBLE) AS duration, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS streams, CASE WHEN o_orderkey % 2 = 0 THEN 16000 END AS rate FROM orders""")
def p7_i7_tool_output(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    printed = F.when(key % 3 == 0, F.concat(F.lit(' {"n": '), cust, F.lit("}\n"))).when(key % 3 == 1, F.concat(F.lit('log {\n{"n": 1}\n{"n": '), cust + 1, F.lit("}\nend"))).otherwise("nothing")
    streams = F.array_compact(F.array(F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.lit(None).cast("string").alias("sample_rate")), F.when(key % 2 == 0, F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.lit("16000").alias("sample_rate")))))
    payload = F.to_json(F.struct(F.struct(F.col("o_totalprice").cast("string").alias("duration")).alias("format"), streams.alias("streams")))
    probed = ingest.probes(table(spark, d, "orders").select(F.concat_ws("|", key, printed).alias("path"), payload.alias("payload")))
    v = ingest.printed_json(F.regexp_replace("path", r"^\d+\|", ""))
    return probed.select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("o_orderkey"), F.try_variant_get(v, "$.n", "bigint").alias("n"), "duration", F.size("streams").alias("streams"), F.get("streams", F.lit(0))["sample_rate"].alias("rate"))


@query(f"""WITH {views.JOBS} SELECT '/out/' || id || '/manifest.json' AS path, id AS job_id, state, state AS state_detail, submitted_at AS created_at, media AS media_seconds, CAST(owner AS DOUBLE) AS inference, CASE WHEN owner % 2 = 0 THEN 'bad' END AS error, CASE WHEN owner % 3 = 0 THEN 'srt' ELSE 'txt' END AS artifact, owner AS size FROM jobs WHERE owner % 7 <> 0""")
def p15_i5_r13_manifests(spark, d):
    """Manifests written as JSON, some of another version, and read again with their artifacts."""
    owner = F.col("owner")
    item = F.create_map(F.when(owner % 3 == 0, "srt").otherwise("txt"), F.struct(F.lit("x").alias("path"), owner.alias("size"), F.lit("h").alias("sha256")))
    body = F.struct(F.when(owner % 7 == 0, 2).otherwise(1).alias("schema_version"), F.col("id").alias("job_id"), "state", F.col("submitted_at").alias("created_at"), F.struct(F.col("media").alias("duration")).alias("media"), F.create_map(F.lit("inference_seconds"), owner.cast("double")).alias("timings"), F.when(owner % 2 == 0, F.struct(F.lit("bad").alias("message"))).alias("error"), item.alias("artifacts"))
    docs = views.jobs(spark, d).select(F.concat(F.lit("/out/"), "id", F.lit("/manifest.json")).alias("path"), F.try_parse_json(F.to_json(body)).alias("doc"))
    m = ingest.manifests(docs)
    made = ingest.manifest_artifacts(m).select("path", F.col("name").alias("artifact"), "size")
    return m.select("path", "job_id", "state", "state_detail", "created_at", "media_seconds", F.col("timings")["inference_seconds"].alias("inference"), "error").join(made, "path")


@query(f"""WITH {views.EDITS}, {views.SEGMENTS} SELECT s.job_id, s.idx, e.text FROM segments s JOIN edits e ON e.job_id = s.job_id AND e.idx = s.idx WHERE e.text IS NOT NULL AND s.job_id % 4 <> 0 AND s.job_id % 5 <> 0""")
def i3_current_edit_documents(spark, d):
    """Edits saved as JSON documents, some of another version or transcript, and read again."""
    e = views.edits(spark, d)
    j = F.col("job_id")
    whole = e.groupBy("job_id").agg(F.collect_list("idx").alias("edited_indices"), F.collect_list(F.struct(F.col("idx").alias("index"), "text")).alias("segments"))
    body = F.struct(F.when(j % 4 == 0, 2).otherwise(1).alias("schema_version"), F.when(j % 5 == 0, "old").otherwise("sha").alias("source_transcript_sha256"), "edited_indices", "segments")
    docs = whole.select(j.cast("string").alias("path"), F.try_parse_json(F.to_json(body)).alias("doc"))
    from cuemill.operators.edits import current_edits

    made = ingest.edit_documents(docs).withColumn("job_id", F.col("path").cast("bigint"))
    return current_edits(made, made.select("job_id", F.lit("sha").alias("sha"))).withColumn("idx", F.col("idx").cast("bigint"))


@query("SELECT '/f/' || o_orderkey AS path, o_custkey AS size, o_orderkey AS mtime_ns, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, o_orderkey * 2 AS recorded_ns FROM orders WHERE o_custkey % 5 <> 0 AND o_orderkey % 3 <> 0")
def i15_cached_hashes(spark, d):
    """A fingerprint document for each customer, of two versions; entries may lack a field."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    entry = F.struct(cust.alias("size"), key.alias("mtime_ns"), F.when(key % 3 != 0, F.sha2(key.cast("string"), 256)).alias("sha256"), (key * 2).alias("recorded_ns"))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("/f/"), key), entry))).alias("entries"))
    return ingest.cached_hashes(docs.select(F.try_parse_json(F.to_json(F.struct(F.when(cust % 5 == 0, 2).otherwise(1).alias("version"), "entries"))).alias("doc")))


@query(f"""WITH {views.WORDS} SELECT job_id, count(*) AS words, max("end") AS duration, min(text) AS first, max("end") - min("start") AS span FROM words GROUP BY job_id""")
def i3_transcript_documents(spark, d):
    """Transcripts written as JSON documents and read again."""
    w = views.words(spark, d)
    body = F.struct(F.lit(1).alias("schema_version"), F.max("end").cast("string").alias("duration"), F.array_sort(F.collect_list(F.struct("idx", "text", "start", "end", "speaker"))).alias("words"))
    docs = w.groupBy("job_id").agg(body.alias("b")).select(F.col("job_id").cast("string").alias("path"), F.try_parse_json(F.to_json("b")).alias("doc"))
    t = ingest.transcript_documents(docs).select(F.col("path").cast("bigint").alias("job_id"), "duration", F.explode(ingest.rows_of("words")).alias("w"))
    return t.groupBy("job_id").agg(F.count("*").alias("words"), F.max("duration").alias("duration"), F.min("w.text").alias("first"), (F.max("w.end") - F.min("w.start")).alias("span"))


@query(f"""WITH {views.SEGMENTS}, b AS (SELECT job_id, idx, text, row_number() OVER (ORDER BY job_id, idx) - 1 AS ordinal FROM segments) SELECT ordinal, md5('tr ' || text) AS digest FROM b""")
def i10_translation_batches(spark, d):
    """A translator's answers, one list a job, put in one order over all jobs."""
    s = views.segments(spark, d)
    sizes = s.groupBy("job_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.struct(F.concat(F.lit("tr "), x["text"]).alias("text"))).alias("items"))
    first = with_base(sizes, "job_id", "n").withColumnRenamed("base", "first")
    return ingest.translation_batch(first.select("first", F.to_json("items").alias("payload"))).select("ordinal", F.md5("text").alias("digest"))


@query(f"""WITH {views.SEGMENTS}, n AS (SELECT job_id AS first, count(*) AS lines, count(*) FILTER (WHERE idx % 7 <> 6) AS got FROM segments GROUP BY job_id)
SELECT first, lines AS asked, CASE WHEN first % 5 = 0 THEN -1 ELSE CAST(got AS INT) END AS answered FROM n WHERE first % 5 = 0 OR got <> lines""")
def i10_uneven_batches(spark, d):
    """Some jobs get no answer, and some lines none."""
    s = views.segments(spark, d)
    asked = s.groupBy(F.col("job_id").alias("first")).agg(F.count("*").alias("lines"))
    lines = F.collect_list(F.when(F.col("idx") % 7 != 6, F.struct("text")))
    answered = s.where("job_id % 5 <> 0").groupBy(F.col("job_id").alias("first")).agg(F.to_json(lines).alias("payload"))
    return ingest.uneven_batches(asked, answered)


@query(f"""WITH {views.RESULTS}, r AS (SELECT job_id, pos, printf('%06d-%d', pos, job_id) AS stem, (job_id + pos) % 4 AS k FROM results)
SELECT stem, CASE WHEN k = 3 THEN NULL ELSE 'line ' || pos END AS text, CASE WHEN k = 3 THEN 'object' WHEN k = 2 THEN 'words' END AS fault FROM r""")
def i9_batch_by_stem(spark, d):
    """Every fourth input has no file, another fourth no words in it."""
    r = views.results(spark, d).select("job_id", "pos", F.format_string("%06d-%d", "pos", "job_id").alias("stem"), ((F.col("job_id") + F.col("pos")) % 4).alias("k"))
    body = F.struct(F.concat(F.lit("line "), "pos").alias("text"), F.when(F.col("k") != 2, F.array(F.struct(F.lit("a").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))).alias("words"))
    docs = r.where("k <> 3").select(F.concat(F.lit("/out/"), "stem", F.lit(".json")).alias("path"), F.to_json(body).alias("value"))
    made = ingest.transcripts(ingest.batch_results(docs, r.select("stem", F.col("stem").alias("job_id"), F.lit(None).cast("double").alias("duration"))))
    return made.select(F.col("job_id").alias("stem"), "text", "fault")


@query("""SELECT 's' || s_suppkey AS path, 'b' || s_nationkey AS backend, 'asr' || CASE WHEN s_nationkey % 2 = 0 THEN '|diar' ELSE '' END AS features, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'runtime:' || s_name || '|' END || 'asr:' || s_nationkey AS artifacts
FROM supplier WHERE s_suppkey % 5 > 1""")
def i14_install_states(spark, d):
    """Of every five documents one has another version, and one no version at all."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    runtime = F.when(k % 3 != 0, F.struct(F.col("s_name").alias("id"), F.lit("runtime").alias("kind")))
    features = F.when(n % 2 == 0, F.array(F.lit("asr"), F.lit("diar"))).otherwise(F.array(F.lit("asr")))
    body = F.to_json(F.struct(F.when(k % 5 == 0, 2).when(k % 5 != 1, 1).alias("schema_version"), F.concat(F.lit("b"), n).alias("backend"), features.alias("features"), *[F.lit("x").alias(c) for c in ingest.STATE[1:]], runtime.alias("runtime"), F.array(F.struct(n.cast("string").alias("id"), F.lit("asr").alias("kind"))).alias("models")))
    states = ingest.install_states(table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("path"), F.try_parse_json(body).alias("doc")))
    told = F.array_join(F.transform("artifacts", lambda a: F.concat_ws(":", a["kind"], a["id"])), "|")
    return states.select("path", "backend", F.array_join("features", "|").alias("features"), told.alias("artifacts"))


@query("""SELECT 'm' || p_partkey || '.json' AS path, CASE p_partkey % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'version' ELSE 'incomplete' END AS fault FROM part WHERE p_partkey % 4 <> 3""")
def i13_unread_registries(spark, d):
    k = F.col("p_partkey")
    model = F.struct(*[F.col("p_name").alias(n) for n in ingest.MODEL if n not in ("sha256", "url")])
    body = F.to_json(F.struct(F.when(k % 4 == 1, 2).otherwise(1).alias("schema_version"), F.struct(*[F.col("p_brand").alias(n) for n in ingest.RUNTIME]).alias("runtime"), F.when(k % 4 != 2, F.array(model)).alias("models")))
    return ingest.unread_registries(table(spark, d, "part").select(F.concat(F.lit("m"), k, F.lit(".json")).alias("path"), F.try_parse_json(F.when(k % 4 == 0, "{").otherwise(body)).alias("doc")))


@query(f"WITH {views.RESULTS} SELECT job_id, pos, 's' || pos AS source, CASE WHEN pos % 3 <> 0 THEN state WHEN job_id % 2 = 0 THEN 'cancelled' ELSE 'interrupted' END AS state, CASE WHEN pos % 3 <> 0 THEN error END AS error FROM results")
def r7_ended_sources(spark, d):
    r = views.results(spark, d).withColumn("source", F.concat(F.lit("s"), "pos"))
    return workflow.ended(r.select("job_id", F.col("pos").cast("bigint").alias("pos"), "source", (F.col("job_id") % 2 == 0).alias("stopped")), r.where("pos % 3 <> 0").select("job_id", "source", "state", "error"))


@query(f"WITH {views.RESULTS} SELECT job_id || '-' || pos AS source, CASE WHEN error IS NOT NULL THEN 'later' ELSE 'first' END AS state FROM results")
def u5_later_results(spark, d):
    """Results with an error are there a second time."""
    r = views.results(spark, d).select(F.concat_ws("-", "job_id", "pos").alias("source"), "error")
    return workflow.later_wins(r.select("source", F.lit("first").alias("state")), r.where("error IS NOT NULL").select("source", F.lit("later").alias("state")))


@query(f"WITH {views.RESULTS}, r AS (SELECT job_id, string_agg('f' || pos || ':' || state || ':' || coalesce(error, '-'), ',' ORDER BY pos) AS results FROM results GROUP BY job_id) SELECT CAST(o_orderkey AS VARCHAR) AS id, 'a.wav,b' || o_custkey AS inputs, coalesce(results, '') AS results FROM orders LEFT JOIN r ON job_id = o_orderkey")
def r14_job_rows(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    j = table(spark, d, "orders").select(key.cast("string").alias("id"), F.lit("completed").alias("state"), F.array(F.lit("/x/a.wav"), F.concat(F.lit("/y/b"), cust)).alias("inputs"))
    r = views.results(spark, d).select(F.col("job_id").cast("string").alias("job_id"), "pos", F.concat(F.lit("/z/f"), "pos").alias("source"), "state", "error")
    shown = F.transform("results", lambda x: F.concat_ws(":", x["source"], x["state"], F.coalesce(x["error"], F.lit("-"))))
    return workflow.job_rows(j, r).select("id", F.array_join("inputs", ",").alias("inputs"), F.array_join(shown, ",").alias("results"))


@query(f"""WITH {views.SEGMENTS}, {views.EDITS}, bad AS (SELECT DISTINCT job_id FROM edits WHERE job_id % 6 = 0), held AS (SELECT job_id, idx, text FROM edits WHERE text IS NOT NULL AND job_id NOT IN (SELECT job_id FROM bad)),
t AS (SELECT s.job_id, s.idx, coalesce(h.text, trim(regexp_replace(s.text, '[\\x09-\\x0d\\x1c-\\x20]+', ' ', 'g'))) AS text, s.speaker FROM segments s JOIN (SELECT DISTINCT job_id FROM held) USING (job_id) LEFT JOIN held h ON h.job_id = s.job_id AND h.idx = s.idx)
SELECT job_id, 'transcript.edited.txt' AS name, md5(CASE WHEN bool_or(speaker IS NOT NULL) THEN string_agg('Speaker ' || coalesce(speaker, 'unknown') || ': ' || text, chr(10) ORDER BY idx) ELSE string_agg(text, ' ' ORDER BY idx) END || chr(10)) AS digest FROM t GROUP BY job_id""")
def r5_r9_saved_edits(spark, d):
    s, e = views.segments(spark, d), views.edits(spark, d)
    later = e.unionByName(e.where("job_id % 6 = 0").select("job_id", F.lit(10_000).cast("bigint").alias("idx"), F.lit("late").alias("text")))
    _, _, files = workflow.saved_edits(s, views.earlier_edits(spark, d), later, ("txt",))
    return files.where("name = 'transcript.edited.txt'").select("job_id", "name", F.md5("content").alias("digest"))


@query(f"""WITH {views.WORDS} SELECT job_id, 'm' || job_id AS model, 's' AS source, CASE WHEN job_id % 2 = 0 THEN 'd' END AS diar, 'x' AS adapter FROM (SELECT DISTINCT job_id FROM words)""")
def r4_committed_provenance(spark, d):
    w = views.words(spark, d)
    j = F.col("job_id")
    t = w.groupBy("job_id").agg(F.max("end").alias("duration")).select("job_id", F.lit("t").alias("text"), "duration", F.create_map(F.lit("adapter"), F.lit("x"), F.lit("model_sha256"), F.lit("old")).alias("provenance"))
    ids = t.select("job_id", F.lit("s").alias("source_sha"), F.concat(F.lit("m"), j).alias("model_sha"), F.when(j % 2 == 0, "d").alias("diar_sha"))
    made, _ = workflow.committed(t, w, ids)
    p = F.col("provenance")
    return made.select("job_id", p["model_sha256"].alias("model"), p["source_sha256"].alias("source"), p["diar_model_sha256"].alias("diar"), p["adapter"].alias("adapter"))


@query(f"WITH {views.SEGMENTS}, {views.EDITS} SELECT s.job_id, count(*) FILTER (WHERE contains(lower(s.text), 'the')) AS shown, count(*) AS total, count(*) FILTER (WHERE s.idx % 4 = 1) AS invalid FROM segments s GROUP BY s.job_id")
def a17_a19_line_counts(spark, d):
    from cuemill.operators.edits import invalid_lines, visible

    s = views.segments(spark, d)
    shown, total = visible(F.contains(F.lower("text"), F.lit("the")))
    kinds = s.select("job_id", "idx", F.when(F.col("idx") % 4 == 1, "invalid").otherwise("set").alias("kind"))
    return s.groupBy("job_id").agg(shown.alias("shown"), total.alias("total")).join(invalid_lines(kinds), "job_id")


@query("SELECT count(DISTINCT l_suppkey) = 1 AS ok FROM lineitem")
def a18_one_root(spark, d):
    return identity.one_root(table(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_suppkey"), F.col("l_partkey")).alias("path")))


@query(f"WITH {views.JOBS}, w AS (SELECT CAST(c_custkey * 4 AS VARCHAR) AS id FROM customer) SELECT w.id, j.state, CASE WHEN j.id IS NULL THEN 'missing_job' END AS error FROM w LEFT JOIN jobs j ON j.id = w.id")
def l9_lookups(spark, d):
    return jobs.looked_up(views.jobs(spark, d), table(spark, d, "customer").select((F.col("c_custkey") * 4).cast("string").alias("id")))


@query(f"WITH {views.STAGE_EVENTS} SELECT job_id, event_id, source, stage, status, message, event_id % 5 AS completed, 5 AS total, value AS media_seconds FROM stage_events")
def p25_event_payloads(spark, d):
    e = views.stage_events(spark, d)
    null = F.lit(None)
    rows = e.select("job_id", "event_id", F.concat(F.lit("/data/in/"), "source").alias("source"), "stage", "status", "message", (F.col("event_id") % 5).alias("completed"), F.lit(5).alias("total"), null.cast("string").alias("timestamp"), F.col("value").alias("media_seconds"), null.cast("double").alias("estimated_seconds"))
    return jobs.payloads(rows).drop("timestamp", "estimated_seconds")


@query(f"""WITH {views.STAGE_EVENTS}, n AS (SELECT job_id AS stream_id, event_id % 3 AS run, event_id AS seq, stage, row_number() OVER (PARTITION BY job_id ORDER BY event_id % 3, event_id) AS event_id, max(event_id % 3) OVER (PARTITION BY job_id) AS latest, count(*) OVER (PARTITION BY job_id) AS last FROM stage_events)
SELECT stream_id, seq, event_id, stage FROM n WHERE run = latest AND last - event_id < 4 AND stage NOT IN ('completed', 'failed', 'cancelled')""")
def w7_st13_setup_events(spark, d):
    e = views.stage_events(spark, d).select(F.col("job_id").alias("stream_id"), (F.col("event_id") % 3).alias("run"), F.col("event_id").alias("seq"), "stage")
    return jobs.relayed(jobs.numbered_runs(e, 4)).select("stream_id", "seq", F.col("event_id").cast("bigint").alias("event_id"), "stage")


@query(f"WITH {views.RESULTS} SELECT job_id AS request_id, pos, l_partkey AS job_id, CASE WHEN l_partkey % 2 = 0 AND count(*) FILTER (WHERE l_partkey % 2 = 0) OVER (PARTITION BY job_id) > 1 THEN 'shared' ELSE 'isolated' END AS route FROM results")
def r8_batch_routes(spark, d):
    r = views.results(spark, d).select(F.col("job_id").alias("request_id"), F.col("pos").cast("bigint").alias("pos"), F.col("l_partkey").alias("job_id"), (F.col("l_partkey") % 2 == 0).alias("shared"))
    return jobs.batch_routes(r)


@query(f"""WITH h AS (SELECT s_suppkey AS host, s_nationkey % 2 = 0 AS transcription, s_nationkey % 3 = 0 AS translation, s_nationkey % 5 <> 0 AS diarization FROM supplier)
SELECT host, unnest(['txt', 'srt', 'vtt', 'json']) AS value, 'format' AS kind FROM h UNION ALL SELECT host, unnest({list(workflow.ASR_LANGUAGES)}), 'asr_language' FROM h UNION ALL SELECT host, unnest({list(workflow.TRANSLATION_LANGUAGES)}), 'translation_language' FROM h WHERE translation
UNION ALL SELECT host, 'transcription', 'feature' FROM h WHERE transcription UNION ALL SELECT host, 'translation', 'feature' FROM h WHERE translation UNION ALL SELECT host, 'diarization', 'feature' FROM h WHERE diarization""")
def p24_r15_capabilities(spark, d):
    n = F.col("s_nationkey")
    return workflow.capabilities(table(spark, d, "supplier").select(F.col("s_suppkey").alias("host"), (n % 2 == 0).alias("transcription"), (n % 3 == 0).alias("translation"), (n % 5 != 0).alias("diarization")))


@query("""SELECT '| ' || p_partkey || ' | ' || printf('%d.%02d s', p_size, 50) || ' | ' || printf('%d.%02d s', p_size * 2, 0) || ' | ' || CASE WHEN p_size >= 10 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.0' END || '× |' AS line FROM part""")
def k9_benchmark_lines(spark, d):
    return sinks.benchmark_table(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("device"), (F.col("p_size") + 0.5).cast("double").alias("total"), (F.col("p_size") * 2).cast("double").alias("inference"), F.col("p_size").cast("double").alias("speed")))
