"""Queries on readers and sinks: what is written to the shared folder is read back, and twins say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html
from ..sources import files, store, tables
from ..sources.tables import CHUNKS_SQL, chunks, table
from .queries import query


def _lines(spark, d, name, expr, where="true"):
    """A small file of lines made of the test tables, written as one."""
    rows = table(spark, d, name).where(where).selectExpr(f"{expr} AS value")
    path = store.scratch(spark, "lines")
    rows.coalesce(1).write.text(path)
    return path


_SUM = "CASE WHEN n_nationkey % 4 = 0 THEN 'not a sum' ELSE lower(sha2(n_name, 256)) || CASE WHEN n_nationkey % 2 = 0 THEN '  ./' ELSE ' *' END || 'books/' || n_name || '.zim' END"


@query("S22_checksums", "SELECT 'books/' || n_name || '.zim' AS path, sha256(n_name) AS sha256 FROM nation WHERE n_nationkey % 4 <> 0")
def checksums(spark, d):
    return tables.read_checksums(spark, _lines(spark, d, "nation", _SUM)).select("path", "sha256")


@query("S28_shelf_hash", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 <> 0 THEN sha256(n_name) END AS sha256 FROM nation")
def shelf_hash(spark, d):
    sums = tables.read_checksums(spark, _lines(spark, d, "nation", _SUM))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("elsewhere/"), "n_name", F.lit(".zim")).alias("path"))
    return files.hash_of(rows, sums).select("id", "sha256")


@query("S26_scope_file", "SELECT n_name AS entry FROM nation WHERE n_nationkey % 3 <> 0")
def scope_file(spark, d):
    return tables.read_scope(spark, _lines(spark, d, "nation", "CASE WHEN n_nationkey % 3 = 0 THEN '# ' || n_name WHEN n_nationkey % 3 = 1 THEN '  ' || n_name || '   # why' ELSE n_name END"))


@query("S12_csv", "SELECT s_suppkey::VARCHAR AS id, s_name || ', \"x\"' AS title FROM supplier")
def csv(spark, d):
    path = store.scratch(spark, "csv")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(', "x"')).alias("title")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path)


@query("S29_pins", "SELECT s_suppkey::VARCHAR AS id, max(s_name) AS title FROM supplier GROUP BY 1")
def pins(spark, d):
    path = store.scratch(spark, "pins")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    s.union(s).write.option("header", True).csv(path)
    return files.by_key(files.read_csv(spark, path), "id")


@query("S11_registry", "SELECT src, file, row_number() OVER (ORDER BY src::INT)::INT AS place FROM (SELECT n_nationkey::VARCHAR AS src, n_name AS file FROM nation)")
def registry(spark, d):
    path = store.scratch(spark, "registry")
    table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("src"), F.col("n_name").alias("file")).write.json(path)
    return files.read_registry(spark, path)


@query("S27_run_log", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def run_log(spark, d):
    path = store.scratch(spark, "log")
    log = table(spark, d, "conversations").select("conv_id", "turn", "text")
    for part in (0, 1):  # a run is appended to
        files.append_log(log.where(F.col("turn") % 2 == part), path)
    return tables.read_jsonl(spark, path, "conv_id long, turn long, text string").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("S18_provenance_ingest", f"WITH {CHUNKS_SQL} SELECT src, count(*) AS n FROM chunks WHERE src % 5 <> 2 OR i = 0 GROUP BY 1")
def provenance_ingest(spark, d):
    c, path = chunks(table(spark, d, "documents")).select("src", "cid", "dnum", "i"), store.scratch(spark, "provenance")
    files.ingest(c, path)
    files.ingest(c.where("src % 5 = 2 and i = 0"), path)  # some artifacts anew: their rows alone are replaced
    return spark.read.parquet(path).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("S20_upsert_sink", f"WITH {CHUNKS_SQL} SELECT cid, sha1(CASE WHEN src = 3 THEN 'x' || text ELSE text END) AS text FROM chunks WHERE NOT (src = 3 AND i % 2 = 1)")
def upsert_sink(spark, d):
    c, path = chunks(table(spark, d, "documents")).select("src", "cid", "i", "text"), store.scratch(spark, "sink")
    files.replace_source(c, c.where("false"), path)
    files.replace_source(c.where("src = 3").withColumn("text", F.concat(F.lit("x"), "text")), c.where("i % 2 = 1"), path)
    return spark.read.parquet(path).select("cid", F.sha1("text").alias("text"))


@query("S8_vector_blocks", "SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings")
def vector_blocks(spark, d):
    from ..operators import vectors

    b = vectors.blocks(table(spark, d, "embeddings"), 64)
    ids = F.length("ids") / 8
    return b.agg(F.sum("n").alias("n"), F.sum(ids).cast("long").alias("m")).crossJoin(table(spark, d, "embeddings").agg(F.sum("vec_id").cast("long").alias("ids"))).select(F.when(F.col("n") == F.col("m"), F.col("n")).alias("n"), "ids")


@query("S14_library", "SELECT n_name AS stem, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name || ' & more' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'eng' ELSE 'spa' END AS lang FROM nation")
def library(spark, d):
    path = _lines(spark, d, "nation", "'<book path=\"a/b\\\\' || n_name || '.zim\" ' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'title=\"' || n_name || ' &amp; more\" ' END || 'language=\"' || CASE WHEN n_nationkey % 2 = 0 THEN 'eng,fra' ELSE 'spa' END || '\"/>'")
    return files.library_books(spark, path)


@query("S15_archive_listing", "SELECT 'n' || n_nationkey || '.zim' AS name, length(n_name)::BIGINT AS bytes FROM nation WHERE n_nationkey % 5 = 0")
def archive_listing(spark, d):
    where = store.scratch(spark, "shelf")
    for r in table(spark, d, "nation").where("n_nationkey % 5 = 0").collect():  # five files
        store.put(spark, f"{where}/deep/n{r['n_nationkey']}.zim", r["n_name"].encode())
        store.put(spark, f"{where}/n{r['n_nationkey']}.txt", b"x")
    return files.listing(spark, where, "*.zim").select("name", "bytes")


@query("S2_pdf_folder", "SELECT 'a' || n_nationkey % 2 || '/p' || n_nationkey || '.pdf' AS path, length(n_name)::BIGINT AS bytes, row_number() OVER (PARTITION BY n_nationkey % 2 ORDER BY 'p' || n_nationkey || '.pdf')::INT AS place FROM nation WHERE n_nationkey % 5 = 1")
def pdf_folder(spark, d):
    where = store.scratch(spark, "pdf")
    for r in table(spark, d, "nation").where("n_nationkey % 5 = 1").collect():  # five files
        store.put(spark, f"{where}/a{r['n_nationkey'] % 2}/p{r['n_nationkey']}.pdf", r["n_name"].encode())
        store.put(spark, f"{where}/a{r['n_nationkey'] % 2}/p{r['n_nationkey']}.zip", b"x")
    return files.in_folders(files.listing(spark, where, "*.pdf"), where).select("path", "bytes", "place")


@query("M10_verify_folder", "SELECT 'n' || n_nationkey || '.bin' AS path, CASE WHEN n_nationkey = 3 THEN 'differs' WHEN n_nationkey = 5 THEN 'missing' WHEN n_nationkey = 7 THEN 'new' ELSE 'ok' END AS state FROM nation WHERE n_nationkey < 9")
def verify_folder(spark, d):
    where = store.scratch(spark, "verify")
    rows = table(spark, d, "nation").where("n_nationkey < 9")
    for r in rows.where("n_nationkey <> 5").collect():  # eight files
        store.put(spark, f"{where}/n{r['n_nationkey']}.bin", (r["n_name"] + "!" * (r["n_nationkey"] == 3)).encode())
    sums = rows.where("n_nationkey <> 7").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".bin")).alias("path"), F.sha2("n_name", 256).alias("sha256"))
    return files.verify(files.hashes(spark, where), sums)


@query("S33_chunk_file", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'a' || p_size || '.jsonl' WHEN p_size % 3 = 0 THEN 'b' || p_size || '.jsonl' WHEN p_size % 5 = 0 THEN 'd/c' || p_size || '.jsonl' END AS file FROM part")
def chunk_file(spark, d):
    p = table(spark, d, "part")
    there = p.select(F.explode(F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a"), "p_size")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("b"), "p_size")), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("d/c"), "p_size")))).alias("f")).where("f is not null").select(F.concat("f", F.lit(".jsonl")).alias("file")).distinct()
    names = F.array(*(F.concat(F.lit(x), F.col("p_size").cast("string"), F.lit(".jsonl")) for x in ("a", "b", "d/c")))
    return files.first_there(p.select(F.col("p_partkey").alias("id"), names.alias("names")), there, "id")


_LOG = "'load: ' || CASE s_suppkey % 3 WHEN 0 THEN 'CPU' WHEN 1 THEN 'CUDA0' ELSE 'CUDA_Host' END || ' model buffer size = ' || (s_suppkey * 10) || '.50 MiB'"


@query("S35_buffers", "SELECT CASE s_suppkey % 3 WHEN 1 THEN 'gpu' ELSE 'host' END AS place, count(*) AS n, round(sum(s_suppkey * 10 + 0.5), 2)::DOUBLE AS mib FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1")
def buffers(spark, d):
    lines = table(spark, d, "supplier").selectExpr(f"CASE WHEN s_suppkey % 4 = 0 THEN 'nothing' ELSE {_LOG} END AS value")
    return files.buffers(lines)


@query("S36_instances", "SELECT s_suppkey AS pid, s_suppkey - 1 AS parent FROM supplier WHERE s_suppkey % 5 = 2")
def instances(spark, d):
    lines = table(spark, d, "supplier").selectExpr("CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 5 <> 2 THEN 'PID PPID CMD' ELSE '  ' || s_suppkey || '  ' || (s_suppkey - 1) || ' python ' || CASE WHEN s_suppkey % 5 = 2 THEN 'Serve.py --port 80' ELSE 'other' END END AS value")
    return files.instances(files.processes(lines), ["serve.py", "--port"]).select("pid", "parent")


@query("S31_language_forms", "SELECT lang, count(*) AS books FROM (SELECT unnest(string_split(CASE WHEN s_suppkey % 3 = 0 THEN 'eng,spa' WHEN s_suppkey % 3 = 1 THEN 'eng' ELSE 'fra' END, ',')) AS lang FROM supplier) GROUP BY 1")
def language_forms(spark, d):
    pages = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "'<form action=\"/search\"><input name=\"books.filter.lang\" value=\"' || CASE WHEN s_suppkey % 3 = 0 THEN 'eng, spa' WHEN s_suppkey % 3 = 1 THEN 'eng' ELSE 'fra' END || '\"></form>' AS html")
    return files.form_languages(pages, "books.filter.lang")


@query("S32_catalogue_keys", "SELECT id, array_to_string(k, ',') AS keys FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN ['b' || s_suppkey, 'a'] ELSE ['a', 'c' || s_suppkey] END AS k FROM supplier)")
def catalogue_keys(spark, d):
    feed = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN '<link href=\"/content/b' || s_suppkey || '\"/><link href=\"/content/a\"/><link href=\"/content/b' || s_suppkey || '\"/>' ELSE '<link href=\"/content/a\"/><link href=\"/x/y\"/><link href=\"/content/c' || s_suppkey || '\"/>' END AS feed")
    return feed.select("id", F.array_join(files.content_keys(F.col("feed")), ",").alias("keys"))


@query("S1_page_entries")
def page_entries(spark, d):
    kept, stats = html.entries(table(spark, d, "pages"))
    return stats


@query("T6_page_title", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages WHERE NOT contains(regexp_extract(html, '<title>(.*?)</title>', 1), '&')")
def page_title(spark, d):
    p = table(spark, d, "pages")
    plain = p.where(~F.regexp_extract("html", "<title>(.*?)</title>", 1).contains("&"))
    return html.html_to_text(plain).select("page_id", "title")
