"""Queries on files, folders, hashes and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import identity, storage
from cuemill.plans import views
from cuemill.plans.registry import Queries
from cuemill.plans.views import table

query = Queries()


@query(f"WITH {views.FILES}, {views.FOLDERS} SELECT p.path, coalesce(sum(f.size) FILTER (WHERE NOT f.is_symlink), 0)::BIGINT AS bytes FROM (SELECT DISTINCT path FROM folders) p LEFT JOIN files f ON starts_with(f.path, p.path || '/') GROUP BY p.path")
def a8_folder_bytes(spark, d):
    return storage.folder_bytes(views.files(spark, d).select("path", "size", "is_symlink"), views.folders(spark, d))


_REPORT = f"""{views.FILES}, {views.FOLDERS}, j AS (SELECT DISTINCT source AS id, CAST(substr(source, 4) AS INT) AS pos FROM files),
ranked AS (SELECT f.*, row_number() OVER (ORDER BY j.pos, CASE kind WHEN 'upload' THEN 0 ELSE 1 END, f.pos, path) AS r FROM folders f JOIN j ON j.id = f.job_id),
kept AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.r < a.r AND (b.path = a.path OR starts_with(a.path, b.path || '/')))),
sized AS (SELECT k.job_id, k.kind, coalesce((SELECT sum(size) FROM files f WHERE NOT f.is_symlink AND starts_with(f.path, k.path || '/')), 0) AS b FROM kept k),
sums AS (SELECT id, pos, coalesce(sum(b) FILTER (WHERE kind = 'upload'), 0)::BIGINT AS upload_bytes, coalesce(sum(b) FILTER (WHERE kind = 'output'), 0)::BIGINT AS output_bytes FROM j LEFT JOIN sized ON job_id = id GROUP BY id, pos)"""


def _storage(spark, d):
    jobs = views.files(spark, d).select(F.col("source").alias("id")).distinct().withColumn("pos", F.substring("id", 4, 9).cast("int"))
    return storage.storage_report(jobs, views.folders(spark, d), views.files(spark, d).select("path", "size", "is_symlink"))


@query(f"""WITH {_REPORT}, t AS (SELECT *, upload_bytes + output_bytes AS total_bytes, CAST(sum(upload_bytes + output_bytes) OVER () AS BIGINT) AS every FROM sums)
SELECT id, upload_bytes, output_bytes, total_bytes, CASE WHEN every = 0 THEN 0.0::DOUBLE ELSE CAST((total_bytes * 20000 + every) // (2 * every) AS DOUBLE) / 10000 END AS share, row_number() OVER (ORDER BY total_bytes DESC, pos) AS place FROM t""")
def a9_l3_storage_report(spark, d):
    """With the place of each row in the report."""
    rows = _storage(spark, d)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint"))


@query(f"WITH {_REPORT} SELECT CAST(sum(upload_bytes + output_bytes) AS BIGINT) AS total_bytes, CAST(sum(upload_bytes) AS BIGINT) AS upload_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes FROM sums")
def a9_storage_totals(spark, d):
    return storage.storage_totals(_storage(spark, d))


@query(f"WITH {views.FILES}, f AS (SELECT path FROM files WHERE doc_id % 50 = 7), c AS (SELECT DISTINCT '/data/' || source || '/' || lang AS path FROM files UNION SELECT '/data/none') SELECT path FROM c WHERE EXISTS (SELECT 1 FROM f WHERE starts_with(f.path, c.path || '/'))")
def p43_retained_caches(spark, d):
    f = views.files(spark, d)
    folders = f.select(F.concat(F.lit("/data/"), "source", F.lit("/"), "lang").alias("path")).unionByName(spark.createDataFrame([("/data/none",)], "path string"))
    return storage.retained_caches(folders, f.where("doc_id % 50 = 7").select("path"))


@query(f"WITH {views.FILES}, {views.FOLDERS} SELECT DISTINCT path FROM folders WHERE job_id = 'src5' AND path NOT IN (SELECT path FROM folders WHERE job_id <> 'src5')")
def j13_removable_folders(spark, d):
    return storage.removable(views.folders(spark, d), "src5")


@query(f"WITH {views.FILES}, {views.FOLDERS} SELECT DISTINCT '/data/' || source AS path FROM files WHERE '/data/' || source NOT IN (SELECT path FROM folders WHERE job_id = 'src0' OR job_id = 'src3')")
def j14_stale_uploads(spark, d):
    found = views.files(spark, d).select(F.concat(F.lit("/data/"), "source").alias("path")).distinct()
    return storage.stale_uploads(found, views.folders(spark, d).where(F.col("job_id").isin("src0", "src3")).select("path"))


@query(f"WITH {views.FILES} SELECT source AS upload_id, doc_id AS seq, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS total, sum(size) OVER (PARTITION BY source ORDER BY doc_id) > 50000 AS over FROM files")
def w10_running_upload_total(spark, d):
    parts = views.files(spark, d).select(F.col("source").alias("upload_id"), F.col("doc_id").alias("seq"), "size")
    return storage.running_total(parts, 50_000)


@query(f"""WITH {views.FILES}, f AS (SELECT doc_id AS pos, source || (CASE lang WHEN 'de' THEN '.MP3' WHEN 'fr' THEN '.txt' ELSE '.wav' END) AS name, size % 100 AS size, 0 AS modified FROM files),
i AS (SELECT name, size, modified, min(pos) AS pos FROM f WHERE pos % 3 <> 0 AND (lower(name) LIKE '%.mp3' OR lower(name) LIKE '%.wav') GROUP BY ALL)
SELECT pos, name, size, modified FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.pos % 3 = 0 AND f.name = i.name AND f.size = i.size)""")
def j15_added_files(spark, d):
    suffix = F.when(F.col("lang") == "de", ".MP3").when(F.col("lang") == "fr", ".txt").otherwise(".wav")
    f = views.files(spark, d).select(F.col("doc_id").alias("pos"), F.concat("source", suffix).alias("name"), (F.col("size") % 100).alias("size"), F.lit(0).alias("modified"))
    return storage.added_files(f.where("pos % 3 = 0"), f.where("pos % 3 <> 0"))


@query(f"WITH {views.FILES} SELECT path, starts_with(path, '/data/src1/') OR starts_with(path, '/data/src2/') AS allowed, regexp_extract(path, '[^/]+$') AS name FROM files")
def p22_allowed_paths(spark, d):
    return views.files(spark, d).select("path", rules.under(F.col("path"), F.array(F.lit("/data/src1"), F.lit("/data/src2"))).alias("allowed"), rules.base_name(F.col("path")).alias("name"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(t, '^[a-z]{2,3}(-[a-z0-9]{2,8})*$') THEN t END AS code FROM (SELECT c_custkey, lower(trim(' ' || left(c_mktsegment, CAST(2 + c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 2 = 0 THEN '-DE' ELSE '' END)) AS t FROM customer)""")
def p8_language_codes(spark, d):
    raw = F.concat(F.lit(" "), F.left("c_mktsegment", (2 + F.col("c_custkey") % 3).cast("int")), F.when(F.col("c_custkey") % 2 == 0, "-DE").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", rules.language_code(raw).alias("code"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'cli' END, CASE WHEN n_nationkey % 5 = 0 THEN 'env' END, 'default') AS level FROM nation")
def p9_p10_settings(spark, d):
    n = F.col("n_nationkey")
    word = F.when(n % 4 == 0, " YES").when(n % 4 == 1, "off").when(n % 4 == 2, "1").otherwise("maybe")
    return table(spark, d, "nation").select("n_nationkey", rules.flag(word).alias("flag"), rules.settled(F.when(n % 3 == 0, "cli"), F.when(n % 5 == 0, "env"), F.lit("default")).alias("level"))


@query("SELECT p_partkey, p_size BETWEEN 8 AND 48 AND p_partkey % 2 = 0 AND p_partkey % 3 < 2 AS passes FROM part")
def p17_passthrough(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", rules.passes_through(F.when(k % 2 == 0, "A.WAV").otherwise("a.mp3"), F.lit("pcm_s16le"), F.when(F.col("p_size") <= 48, F.col("p_size") * 1000), (k % 3 + 1).cast("int")).alias("passes"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS ready FROM orders")
def p18_artifacts_there(spark, d):
    k = F.col("o_orderkey")
    have = F.array_compact(F.array(F.when(k % 2 == 0, "transcript.json"), F.when(k % 3 == 0, "subtitles.srt"), F.lit("transcript.txt")))
    return table(spark, d, "orders").select("o_orderkey", rules.artifacts_there(have, F.array(F.lit("txt"), F.lit("srt"))).alias("ready"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def h1_content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""SELECT o_orderkey, sha256('{"options":{"device":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'caf\\u00e9' ELSE 'cpu' END || '","diarize":' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"stream":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(o_orderkey % 5 AS VARCHAR) END || '},"source":"' || sha256(CAST(o_custkey AS VARCHAR)) || '"}') AS id FROM orders""")
def h2_content_ids(spark, d):
    k = F.col("o_orderkey")
    options = {"stream": identity.json_number(F.nullif(k % 5, F.lit(0))), "device": identity.json_text(F.when(k % 2 == 0, "café").otherwise("cpu")), "diarize": F.when(k % 3 == 0, "true").otherwise("false")}
    return table(spark, d, "orders").select("o_orderkey", identity.content_id(F.sha2(F.col("o_custkey").cast("string"), 256), options).alias("id"))


@query(f"WITH {views.FILES} SELECT path, sha256(path) AS path_id, regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '') || '-' || left(md5(path), 10) || '-' || left(sha256(path), 8) AS folder FROM files")
def h5_h6_path_ids(spark, d):
    p = F.col("path")
    return views.files(spark, d).select("path", identity.path_id(p).alias("path_id"), identity.job_folder(p, F.md5(p)).alias("folder"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def h7_first_of_each(spark, d):
    return identity.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_totalprice * 100 AS BIGINT) AS recorded_ns FROM orders ORDER BY recorded_ns DESC, path LIMIT 1000")
def h8_kept_hashes(spark, d):
    return identity.kept_hashes(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("recorded_ns")))


@query("""SELECT o_orderkey AS job_id, 1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n, 'json' || CASE WHEN o_orderkey % 3 = 0 THEN ',subtitles.de.srt' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ',txt' ELSE '' END AS keys FROM orders""")
def h9_artifact_manifests(spark, d):
    k = F.col("o_orderkey")
    names = F.array_compact(F.array(F.lit("transcript.json"), F.lit("other.log"), F.when(k % 2 == 0, "transcript.txt"), F.when(k % 3 == 0, "subtitles.de.srt")))
    files = table(spark, d, "orders").select(k.alias("job_id"), F.explode(names).alias("name"), F.lit(1).alias("size"), F.lit("x").alias("sha256"))
    m = identity.artifact_manifest(files)
    return m.select("job_id", F.size("artifacts").alias("n"), F.array_join(F.array_sort(F.map_keys("artifacts")), ",").alias("keys"))


@query(f"WITH {views.FILES} SELECT path, size, doc_id AS mtime_ns, CASE WHEN doc_id % 3 = 1 THEN sha256(path) END AS sha256 FROM files")
def j9_known_hashes(spark, d):
    f = views.files(spark, d).select("path", "size", F.col("doc_id").alias("mtime_ns"))
    cache = f.select("path", (F.col("size") + F.when(F.col("mtime_ns") % 3 == 2, 1).otherwise(0)).alias("size"), "mtime_ns", F.when(F.col("mtime_ns") % 3 == 0, "broken").otherwise(F.sha2("path", 256)).alias("sha256"))
    return identity.known_hashes(f, cache)


@query(f"WITH {views.FILES} SELECT path, size, CAST(doc_id AS VARCHAR) AS sha256, doc_id % 4 = 1 AS valid FROM files")
def h10_valid_artifacts(spark, d):
    f = views.files(spark, d).select("path", "size", F.col("doc_id").cast("string").alias("sha256"), "doc_id")
    actual = f.where("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 4 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("doc_id") % 4 == 3, "x").otherwise(F.col("sha256")).alias("sha256"))
    return identity.valid_artifacts(f.drop("doc_id"), actual)


@query("SELECT s_suppkey AS id, 'model' AS kind, s_name AS sha256 FROM supplier WHERE s_suppkey % 2 = 0")
def j10_reusable(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("model").alias("kind"), F.col("s_name").alias("sha256"))
    return identity.reusable(s, s.where("id % 2 = 0"))


@query("""SELECT s_suppkey AS request_id, (CASE WHEN s_nationkey < 10 THEN 1 ELSE 0 END) + (CASE WHEN s_nationkey < 5 THEN 1 ELSE 0 END) AS matches, CASE WHEN s_nationkey BETWEEN 5 AND 9 THEN 'full.zip' END AS filename FROM supplier""")
def j11_matching_archives(spark, d):
    wanted = F.when(F.col("s_nationkey") < 5, F.array().cast("array<string>")).when(F.col("s_nationkey") < 10, F.array(F.lit("diarize"))).otherwise(F.array(F.lit("fly")))
    requests = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), F.lit("cpu").alias("backend"), F.lit("Linux").alias("system"), F.lit("X86_64").alias("architecture"), wanted.alias("features"))
    archives = spark.createDataFrame([("cpu", "linux", "x86_64", "full.zip", ["asr", "diarize"]), ("cpu", "linux", "x86_64", "small.zip", ["asr"]), ("cuda", "linux", "x86_64", "cuda.zip", ["asr"])], "backend string, system string, architecture string, filename string, features array<string>")
    return identity.matching_archives(requests, archives).withColumn("matches", F.col("matches").cast("int"))


_NEEDED = """needed AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'libcudart.so.' || s_suppkey WHEN 1 THEN 'libc.so.' || s_suppkey WHEN 2 THEN 'libcuda.so.1' ELSE 'libnccl.sox' END AS name, CASE s_nationkey % 3 WHEN 1 THEN '/usr/lib/x' WHEN 2 THEN '/app/lib/x' END AS target FROM supplier)"""


@query(f"""WITH {_NEEDED} SELECT array_to_string(list_sort(list(DISTINCT name)), ';') AS issues FROM needed WHERE target IS NULL AND name NOT IN ('libcuda.so.1', 'libnvidia-ml.so.1') OR regexp_matches(name, '^libcudart[.]so($|[.])') AND NOT starts_with(target, '/app/lib/')""")
def a16_j16_dependency_issues(spark, d):
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey") % 3
    name = F.when(k == 0, F.concat(F.lit("libcudart.so."), "s_suppkey")).when(k == 1, F.concat(F.lit("libc.so."), "s_suppkey")).when(k == 2, "libcuda.so.1").otherwise("libnccl.sox")
    edges = table(spark, d, "supplier").select(F.lit("f").alias("file"), name.alias("name"), F.when(n == 1, "/usr/lib/x").when(n == 2, "/app/lib/x").alias("target"))
    return identity.dependency_issues(edges, "/app/lib", host_driver=True).select(F.array_join("issues", ";").alias("issues"))


@query("SELECT p_name AS filename, md5(p_name) AS sha256, greatest(3 * CAST(p_size AS BIGINT) * 10000000, 536870912) AS minimum_free_bytes FROM part")
def h11_archive_rows(spark, d):
    return identity.archive_rows(table(spark, d, "part").select(F.col("p_name").alias("filename"), (F.col("p_size").cast("bigint") * 10_000_000).alias("size"), F.md5("p_name").alias("sha256")))


@query("""SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat([n_name, 'a'], ['a', 'z']))), ',') AS both, array_to_string(list_sort(list_filter(['txt', n_name], lambda x: x NOT IN ('txt', 'srt'))), ',') AS wrong, n_nationkey % 2 = 0 AS overlap FROM nation""")
def u1_u4_sets(spark, d):
    name = F.col("n_name")
    a, b = F.array(name, F.lit("a")), F.array(F.lit("a"), F.lit("z"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(identity.union_of(a, b), ",").alias("both"), F.array_join(identity.missing_from(F.array(F.lit("txt"), name), F.array(F.lit("txt"), F.lit("srt"))), ",").alias("wrong"), F.arrays_overlap(F.array(F.col("n_nationkey") % 2), F.array(F.lit(0))).alias("overlap"))


@query("SELECT sum(n_chars)::BIGINT AS total, count(*) AS files FROM documents")
def a15_total_size(spark, d):
    return table(spark, d, "documents").agg(F.sum("n_chars").alias("total"), F.count("*").alias("files"))


#: Hundredths, tenths or whole units by integers: ties go up.
@query("""SELECT n_chars, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 10240 THEN printf('%d.%02d KB', (n_chars * 200 + 1024) // 2048 // 100, (n_chars * 200 + 1024) // 2048 % 100) WHEN n_chars < 102400 THEN printf('%d.%d KB', (n_chars * 20 + 1024) // 2048 // 10, (n_chars * 20 + 1024) // 2048 % 10) ELSE printf('%d KB', (n_chars * 2 + 1024) // 2048) END AS label FROM (SELECT DISTINCT n_chars FROM documents WHERE n_chars IS NOT NULL) UNION ALL SELECT DISTINCT n_chars, '–' FROM documents WHERE n_chars IS NULL""")
def t15_byte_labels(spark, d):
    return table(spark, d, "documents").select("n_chars").distinct().select("n_chars", text.bytes_label(F.col("n_chars")).alias("label"))


@query("SELECT page_id, list_filter([trim(x) for x in string_split(html, chr(10))], lambda x: x <> '')[1] AS line FROM pages")
def t28_first_lines(spark, d):
    return table(spark, d, "pages").select("page_id", text.first_line(F.col("html")).alias("line"))
