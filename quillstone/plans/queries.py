"""Queries over the test tables, each with its DuckDB twin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, quality, retrieval, vectors
from ..sources.tables import CHUNKS_SQL, chunks, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
TERMS_SQL = lambda c: f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)"
CONTENT_SQL = lambda c: f"(CASE WHEN len(list_filter({TERMS_SQL(c)}, lambda w: NOT list_contains({STOP_SQL}, w))) > 0 THEN list_filter({TERMS_SQL(c)}, lambda w: NOT list_contains({STOP_SQL}, w)) ELSE {TERMS_SQL(c)} END)[1:24]"
TOKENS_SQL = lambda c: f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
INDEX_SQL = lambda c: f"list_filter(string_split_regex(translate(lower({c}), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
COLLAPSE_SQL = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
WORDS_SQL = lambda c: f"list_filter(string_split_regex({c}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def asked(spark, *terms):
    return spark.createDataFrame([(q, t) for q, ts in enumerate(terms) for t in ts], "query_id int, term string")


BM25_SQL = f"""
WITH t AS (SELECT doc_id, {INDEX_SQL('text')} AS t FROM documents), s AS (SELECT count(*) AS N, avg(len(t)) AS avgdl FROM t),
q(query_id, term) AS (VALUES (0, 'water'), (0, 'for'), (0, 'the'), (1, 'elle'), (1, 'dans'), (2, 'und'), (2, 'nicht'), (2, 'that')),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), h AS (SELECT term, doc_id, dl, count(*) AS f FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
c AS (SELECT query_id, doc_id, round(sum(greatest(ln((N - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM h JOIN d USING (term) JOIN q USING (term), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM c)
SELECT query_id, doc_id, score, rank, source || '#' || doc_id AS citation FROM r JOIN documents USING (doc_id) WHERE rank <= 10"""


@query("L3_bm25_topk", BM25_SQL)
def bm25(spark, d):
    docs = table(spark, d, "documents")
    top = lexical.bm25(lexical.stored(docs), asked(spark, ["water", "for", "the"], ["elle", "dans"], ["und", "nicht", "that"]))
    return top.join(docs.select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "score", "rank", F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("citation"))


@query("A7_index_stats", f"WITH t AS (SELECT doc_id, {INDEX_SQL('text')} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM p GROUP BY 1")
def index_stats(spark, d):
    return lexical.stored(table(spark, d, "documents")).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("L1_query_terms", f"""SELECT conv_id, turn, CASE WHEN len({CONTENT_SQL('text')}) > 0 THEN array_to_string(list_transform({CONTENT_SQL('text')}, lambda w: '"' || w || '"'), ' OR ') END AS terms FROM conversations WHERE role = 'user'""")
def query_terms(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_terms(F.col("text")).alias("terms"))


@query("L8_followup", f"""
WITH q AS (SELECT conv_id, turn, text, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
o AS (SELECT conv_id, turn, {CONTENT_SQL('text')} AS own, list_concat({CONTENT_SQL("trim(substring(coalesce(p1, ''), 1, 400))")}, {CONTENT_SQL("trim(substring(coalesce(p2, ''), 1, 400))")}) AS e FROM q),
x AS (SELECT *, list_filter(e, lambda w, i: NOT list_contains(own, w) AND list_position(e, w) = i)[1:8] AS extra FROM o)
SELECT conv_id, turn, CASE WHEN len(own) <= 2 AND len(extra) > 0 THEN array_to_string(list_concat(own, extra), ' ') END AS retrieval FROM x""")
def followup(spark, d):
    return lexical.thread_words(table(spark, d, "conversations")).select("conv_id", "turn", lexical.followup(F.col("own"), F.col("earlier")).alias("retrieval"))


@query("L6_scoped", f"WITH t AS (SELECT doc_id, {INDEX_SQL('text')} AS t FROM documents) SELECT doc_id FROM t WHERE list_has_any(t, ['the', 'elle']) AND list_has_any(t, ['nicht', 'dans', 'water'])")
def scoped(spark, d):
    return lexical.scoped(lexical.stored(table(spark, d, "documents")), ["the", "elle"], ["nicht", "dans", "water"])


@query("A1_exact_dup", f"WITH {CHUNKS_SQL}, h AS (SELECT src, count(*) - 1 AS extra FROM chunks GROUP BY src, sha1({COLLAPSE_SQL('text')})) SELECT src, sum(extra)::BIGINT AS duplicates FROM h GROUP BY 1")
def exact_dup(spark, d):
    h = quality.keyed(chunks(table(spark, d, "documents"))).groupBy("src", "h").agg(F.count(F.lit(1)).alias("c"))
    return h.groupBy("src").agg(F.sum(F.col("c") - 1).alias("duplicates"))


@query("A2_shared_prefix", f"WITH {CHUNKS_SQL}, h AS (SELECT cid, sha1(substring({COLLAPSE_SQL('text')}, 1, 240)) AS opening FROM chunks) SELECT opening, count(*) AS n, min(cid) AS example FROM h GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, opening LIMIT 50")
def shared_prefix(spark, d):
    h = quality.keyed(chunks(table(spark, d, "documents"))).groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("example"))
    return h.where("n > 1").orderBy(F.desc("n"), "opening").limit(50)


PROSE_SQL = f"CASE WHEN len({WORDS_SQL('text')}) < 20 THEN 99.0::DOUBLE ELSE round(100.0::DOUBLE * length(regexp_replace(text, '[^.!?]', '', 'g')) / len({WORDS_SQL('text')}), 6) END"


@query("A3_low_prose", f"WITH {CHUNKS_SQL}, p AS (SELECT src, {PROSE_SQL} AS prose FROM chunks) SELECT src, count(*) AS n, count(*) FILTER (prose < 4) AS low, round(count(*) FILTER (prose < 4) / count(*), 6) AS share FROM p GROUP BY 1")
def low_prose(spark, d):
    rows = chunks(table(spark, d, "documents")).select("src", T.prose_score(F.col("text")).alias("prose"))
    low = F.count(F.when(F.col("prose") < 4, 1))
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), low.alias("low"), F.round(low / F.count(F.lit(1)), 6).alias("share"))


def _reasons(part: str, low: str) -> str:
    return f"""{CHUNKS_SQL}, k AS (SELECT *, sha1({COLLAPSE_SQL('text')}) AS h, sha1(substring({COLLAPSE_SQL('text')}, 1, 240)) AS o, {PROSE_SQL} AS prose FROM chunks),
r AS (SELECT src, dnum, i, cid, CASE WHEN count(*) OVER (PARTITION BY {part}o) >= 20 THEN 'boiler' WHEN {low} THEN 'lowprose' WHEN row_number() OVER (PARTITION BY {part}h ORDER BY src, dnum, i) > 1 THEN 'dup' END AS reason FROM k)"""


@query("A4_filter_reason", f"WITH {_reasons('', 'prose < 3.0')} SELECT cid, reason FROM r")
def filter_reason(spark, d):
    return quality.filter_reasons(chunks(table(spark, d, "documents")), 20, 3.0).select("cid", "reason")


@query("A5_within_artifact", f"WITH {_reasons('src, ', 'false')} SELECT src, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1, 2")
def within_artifact(spark, d):
    return quality.filter_reasons(chunks(table(spark, d, "documents")), 20, None, False).groupBy("src", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("A6_gutted", f"WITH {_reasons('', 'prose < 8.0')} SELECT src, count(*) AS total, count(*) FILTER (reason IS NULL) AS kept FROM r GROUP BY 1 HAVING count(*) > 20 AND count(*) FILTER (reason IS NULL) < 0.6 * count(*)")
def gutted(spark, d):
    return quality.gutted(quality.filter_reasons(chunks(table(spark, d, "documents")), 20, 8.0), 20, 0.6)


def _paths(spark, d):
    """Pages as documents of three artifacts whose paths meet every rule."""
    i = F.col("page_id")
    file = F.element_at(F.array(F.lit("ifixit_en_all"), F.lit("wikem_en_all"), F.lit("mdwiki_en_all"), F.lit("other_en")), (i % 4 + 1).cast("int"))
    path = F.when(i % 8 == 0, F.concat(F.lit("User/"), i)).when(i % 12 == 5, F.concat(F.lit("p/"), i, F.lit("/fr"))).when(i % 12 == 9, F.concat(F.lit("p/"), i, F.lit("/es"))).otherwise(F.concat(F.lit("p/"), i))
    return table(spark, d, "pages").select("page_id", "url", "html", file.alias("file"), path.alias("path"), (i % 3 == 0).alias("mirrored"))


PATHS_SQL = "paths AS (SELECT page_id, html, (['ifixit_en_all', 'wikem_en_all', 'mdwiki_en_all', 'other_en'])[page_id % 4 + 1] AS file, CASE WHEN page_id % 8 = 0 THEN 'User/' || page_id WHEN page_id % 12 = 5 THEN 'p/' || page_id || '/fr' WHEN page_id % 12 = 9 THEN 'p/' || page_id || '/es' ELSE 'p/' || page_id END AS path, page_id % 3 = 0 AS mirrored FROM pages), ex AS (SELECT *, CASE WHEN file LIKE 'ifixit\\_%' ESCAPE '\\' AND (path LIKE 'User/%' OR path LIKE '%/User/%') THEN 'user_profile' WHEN file LIKE 'wikem\\_%' ESCAPE '\\' AND path LIKE '%/%' AND list_contains([" + ", ".join(f"'{x}'" for x in T.TRANSLATIONS) + "], string_split(path, '/')[-1]) THEN 'translation' WHEN file LIKE 'mdwiki\\_%' ESCAPE '\\' AND mirrored THEN 'mirror' END AS reason FROM paths)"


@query("F1_excluded_reason", f"WITH {PATHS_SQL} SELECT page_id, reason FROM ex")
def excluded(spark, d):
    return _paths(spark, d).select("page_id", T.excluded_reason(F.col("file"), F.col("path"), F.col("mirrored")).alias("reason"))


@query("F2_exclusion_stats", f"WITH {PATHS_SQL} SELECT file, reason, count(*) AS n FROM ex WHERE reason IS NOT NULL GROUP BY 1, 2")
def exclusion_stats(spark, d):
    rows = _paths(spark, d).select("file", T.excluded_reason(F.col("file"), F.col("path"), F.col("mirrored")).alias("reason"))
    return rows.where("reason is not null").groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


_TITLE = "CASE doc_id % 6 WHEN 0 THEN 'Category: herbs' WHEN 1 THEN 'Tagsx' WHEN 2 THEN 'all pages of it' WHEN 3 THEN 'ÍNDEX' WHEN 4 THEN 'Index' ELSE '' END"
_PATH = "CASE doc_id % 7 WHEN 0 THEN 'Category:x' WHEN 1 THEN 'Tag/y' WHEN 2 THEN 'a/Tag/y' WHEN 3 THEN 'Special:z' ELSE 'A' END"


@query("F3_navigation", f"SELECT doc_id, regexp_matches(lower({_TITLE}), '^(category|categoría|tag|tags|index|contents|table of contents|all pages)([^\\p{{L}}\\p{{N}}_]|$)') OR starts_with({_PATH}, 'Category:') OR starts_with({_PATH}, 'Tag/') OR starts_with({_PATH}, 'Special:') OR (len({WORDS_SQL('text')}) > 40 AND len(list_distinct({WORDS_SQL('lower(text)')})) / len({WORDS_SQL('text')}) < 0.35) AS navigation FROM documents")
def navigation(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.expr(_TITLE).alias("title"), F.expr(_PATH).alias("path"))
    return rows.select("doc_id", T.is_navigation(F.col("title"), F.col("path"), F.col("text")).alias("navigation"))


@query("F4_exclusion_list", f"WITH {CHUNKS_SQL} SELECT src, count(*) AS n FROM chunks WHERE cid NOT IN (SELECT cid FROM chunks WHERE i % 5 = 2) GROUP BY 1")
def exclusion_list(spark, d):
    c = chunks(table(spark, d, "documents"))
    return c.join(c.where("i % 5 = 2").select("cid"), "cid", "left_anti").groupBy("src").agg(F.count(F.lit(1)).alias("n"))


COVER_SQL = f"""x AS (SELECT item_id AS a, len(s) AS total, unnest(s) AS g FROM (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT item_id, {WORDS_SQL('text')} AS w FROM benchmark))),
y AS (SELECT DISTINCT doc_id AS b, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT doc_id, {WORDS_SQL('text')} AS w FROM documents)),
c AS (SELECT a, b, round(count(*) / total, 6) AS coverage FROM x JOIN y USING (g) GROUP BY a, b, total)"""


def _cover(spark, d):
    return quality.containment(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("M13_containment_benchmark", f"WITH {COVER_SQL} SELECT a, b, coverage FROM c")
def containment(spark, d):
    return _cover(spark, d)


@query("A20_histogram", f"WITH {COVER_SQL} SELECT least(floor(coverage * 8), 7)::INT AS band, count(*) AS n FROM c GROUP BY 1")
def histogram(spark, d):
    return _cover(spark, d).groupBy(F.least(F.floor(F.col("coverage") * 8), F.lit(7)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


VEC_SQL = "s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0), dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)"


def _dense(spark, d, k=10):
    v = table(spark, d, "embeddings")
    return retrieval.exact_topk(v, v.where("vec_id % 20 = 0"), k)


@query("V2_exact_topk", f"WITH {VEC_SQL} SELECT query_id, vec_id, score, rank FROM dn WHERE rank <= 10")
def exact_topk(spark, d):
    return _dense(spark, d)


@query("V1_normalise", "SELECT vec_id, round(e[1] / n, 6) + 0 AS first, round(e[2] / n, 6) + 0 AS second, round(list_sum(list_transform(e, lambda x: x / n)), 5) + 0 AS total FROM (SELECT vec_id, e, CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END AS n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 50 > 0)::INT) AS e FROM embeddings))")
def normalise(spark, d):
    """Every fiftieth vector is made zero, and stays so."""
    e = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 50 > 0).cast("int"))
    n = table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", retrieval.normalised(F.col("e")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return n.select("vec_id", (F.round(F.get("e", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("e", F.lit(1)), 6) + 0.0).alias("second"), (F.round(total, 5) + 0.0).alias("total"))


SPARSE_SQL = "sp AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(v.label - q.label), v.vec_id % 37, v.vec_id)::INT AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)"
FUSED_SQL = f"""{VEC_SQL}, {SPARSE_SQL}, u AS (SELECT query_id, vec_id AS id, rank AS d, NULL::INT AS s FROM dn WHERE rank <= 40 UNION ALL SELECT query_id, vec_id, NULL, rank FROM sp WHERE rank <= 40),
o AS (SELECT query_id, id, max(d) AS d, max(s) AS s FROM u GROUP BY 1, 2), f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + s), 0), 9) AS score FROM o)"""


def _far(q, rows):
    """Minus the distance of labels, then of vec_id % 37: what the second list is ordered by."""
    r = np.frombuffer(rows, "<f8").reshape(-1, 2)
    return -(1000 * np.abs(q[:, None, 0] - r[None, :, 0]) + r[None, :, 1])


def _lists(spark, d):
    v = table(spark, d, "embeddings")
    labels = v.select("vec_id", F.array(F.col("label").cast("double"), (F.col("vec_id") % 37).cast("double")).alias("embedding"))
    sparse = vectors.topk(labels, labels.where("vec_id % 20 = 0"), 40, _far).select("query_id", F.col("vec_id").alias("id"), "rank")
    return _dense(spark, d, 40).select("query_id", F.col("vec_id").alias("id"), "rank"), sparse


@query("R1_rrf", f"WITH {FUSED_SQL} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, s NULLS LAST)::INT AS rank, CASE WHEN d IS NULL THEN 'keyword' WHEN s IS NULL THEN 'dense' ELSE 'both' END AS origin FROM f")
def rrf(spark, d):
    return retrieval.fuse(*_lists(spark, d))


@query("R2_agreement", f"WITH {FUSED_SQL} SELECT query_id, count(*) FILTER (d IS NOT NULL AND s IS NOT NULL) AS in_both, CASE WHEN count(*) FILTER (d IS NOT NULL AND s IS NOT NULL) = 0 THEN 'low' WHEN count(*) FILTER (d IS NOT NULL AND s IS NOT NULL) <= 2 THEN 'weak' ELSE 'good' END AS agreement FROM f GROUP BY 1")
def agreement(spark, d):
    n = retrieval.fuse(*_lists(spark, d)).groupBy("query_id").agg(F.count(F.when(F.col("origin") == "both", 1)).alias("in_both"))
    return n.withColumn("agreement", retrieval.agreement(F.col("in_both")))


@query("M15_recall_at_k", f"WITH {VEC_SQL}, {SPARSE_SQL} SELECT dn.query_id, round(count(sp.vec_id) / 40, 6) AS recall FROM dn LEFT JOIN sp ON dn.query_id = sp.query_id AND dn.vec_id = sp.vec_id AND sp.rank <= 40 WHERE dn.rank <= 40 GROUP BY 1")
def recall(spark, d):
    truth, got = _lists(spark, d)
    return truth.select("query_id", "id").join(got.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / 40, 6).alias("recall"))


@query("K10_seeded_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def sample(spark, d):
    return quality.seeded_sample(table(spark, d, "documents"), "source", "doc_id", 5, "7").select("source", "doc_id")


@query("S6_reassemble", "SELECT doc_id AS dnum, sha1(text) AS text_sha1 FROM documents")
def reassemble(spark, d):
    c = chunks(table(spark, d, "documents")).groupBy("src", "dnum").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("p"))
    return c.select("dnum", F.sha1(F.array_join("p.text", "\n")).alias("text_sha1"))


@query("S4_page_as_of", f"WITH {CHUNKS_SQL}, p AS (SELECT dnum, i, sum(length(text) + 1) OVER (PARTITION BY dnum ORDER BY i) - length(text) - 1 AS start FROM chunks), o AS (SELECT doc_id AS dnum, unnest([0, length(text) // 2, length(text)]) AS off FROM documents) SELECT o.dnum, o.off::BIGINT AS off, max(p.i) AS page FROM o JOIN p ON o.dnum = p.dnum AND p.start <= o.off GROUP BY 1, 2")
def page_as_of(spark, d):
    docs = table(spark, d, "documents")
    w = Window.partitionBy("dnum").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pages = chunks(docs).select("dnum", "i", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start"))
    n = F.length("text").cast("long")
    offs = docs.select(F.col("doc_id").alias("dnum"), F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2), n))).alias("off"))
    return offs.join(pages, "dnum").where("start <= off").groupBy("dnum", "off").agg(F.max_by("i", "start").alias("page"))


@query("J14_neighbour", f"WITH {CHUNKS_SQL} SELECT cid, lag(cid) OVER w AS before, lead(cid) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY src, dnum ORDER BY i)")
def neighbour(spark, d):
    w = Window.partitionBy("src", "dnum").orderBy("i")
    return chunks(table(spark, d, "documents")).select("cid", F.lag("cid").over(w).alias("before"), F.lead("cid").over(w).alias("after"))


ANSWER_SQL = "a AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text || ' [1] and [3], [1] [12]' WHEN 1 THEN 'Not in archive. ' || text WHEN 2 THEN 'NOT IN ARCHIVE' || chr(10) || 'Unsourced - not from the archive: ' || text || ' [2]' WHEN 3 THEN text || ' [2] UNSOURCED - NOT FROM THE ARCHIVE more [9]' ELSE text END AS t FROM conversations), b AS (SELECT *, strpos(translate(t, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'UNSOURCED - NOT FROM THE ARCHIVE') AS pos FROM a), h AS (SELECT *, CASE WHEN pos > 0 THEN t[1:pos - 1] ELSE t END AS head, CASE WHEN pos > 0 THEN t[pos + 32:] END AS rest FROM b), u AS (SELECT *, list_transform(regexp_extract_all(head, '\\[(\\d{1,2})\\]', 1), lambda x: x::INT) AS c FROM h), v AS (SELECT *, list_filter(c, lambda x, i: x BETWEEN 1 AND 5 AND list_position(c, x) = i) AS used, list_filter(c, lambda x: NOT x BETWEEN 1 AND 5) AS bogus, contains(translate(head, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')[1:200], 'NOT IN ARCHIVE') AS absent FROM u)"


def _answers(spark, d):
    c, t = F.col("turn") % 5, F.col("text")
    a = F.when(c == 0, F.concat(t, F.lit(" [1] and [3], [1] [12]"))).when(c == 1, F.concat(F.lit("Not in archive. "), t)).when(c == 2, F.concat(F.lit("NOT IN ARCHIVE\nUnsourced - not from the archive: "), t, F.lit(" [2]"))).when(c == 3, F.concat(t, F.lit(" [2] UNSOURCED - NOT FROM THE ARCHIVE more [9]"))).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", a.alias("t"))


@query("N1_citations", f"WITH {ANSWER_SQL} SELECT conv_id, turn, array_to_string(used, ',') AS used, array_to_string(bogus, ',') AS bogus FROM v")
def citations(spark, d):
    used, bogus = T.citations(T.split_unsourced(F.col("t"))[0], F.lit(5))
    join = lambda a: F.array_join(a.cast("array<string>"), ",")
    return _answers(spark, d).select("conv_id", "turn", join(used).alias("used"), join(bogus).alias("bogus"))


@query("N3_grounding", f"WITH {ANSWER_SQL} SELECT conv_id, turn, CASE WHEN rest IS NOT NULL THEN CASE WHEN absent THEN 'unsourced' WHEN len(used) > 0 THEN 'grounded_plus' ELSE 'model_only' END WHEN absent THEN 'uncovered' WHEN len(used) > 0 THEN 'grounded' ELSE 'model_only' END AS state, coalesce(len(regexp_extract_all(rest, '\\[(\\d{{1,2}})\\]')), 0)::INT AS unsourced_citations FROM v")
def grounding(spark, d):
    rest = T.split_unsourced(F.col("t"))[1]
    n = F.when(rest.isNull(), 0).otherwise(F.size(F.regexp_extract_all(rest, F.lit(T.CITE), 1)))
    return _answers(spark, d).select("conv_id", "turn", T.grounding(F.col("t"), F.lit(5)).alias("state"), n.alias("unsourced_citations"))


@query("N5_budget", "SELECT conv_id, greatest(2048, least(3072, 8192 - (floor(sum(length(text)) / 3.3::DOUBLE)::INT + 64) - 256))::INT AS budget FROM conversations GROUP BY 1")
def budget(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("c")).select("conv_id", T.output_budget(F.col("c")).alias("budget"))


@query("G1_haversine", "WITH p AS (SELECT c_custkey AS k, (c_custkey * 37 % 180 - 90)::DOUBLE AS lat, (c_custkey * 101 % 360 - 180)::DOUBLE AS lon FROM customer), q AS (SELECT a.k, radians(a.lat) AS p1, radians(b.lat) AS p2, radians((b.lon - a.lon + 180) - 360 * floor((b.lon - a.lon + 180) / 360) - 180) AS dl FROM p a JOIN p b ON b.k = a.k + 1) SELECT k, round(2 * 6371 * asin(least(1.0::DOUBLE, sqrt(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2)))), 4) AS km FROM q")
def haversine(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), (k * 37 % 180 - 90).cast("double").alias("lat"), (k * 101 % 360 - 180).cast("double").alias("lon"))
    q = p.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, "k").select("k", F.round(T.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@query("A18_mode_share", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, first(lang ORDER BY n DESC, lang) AS mode, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1")
def mode_share(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "lang")
    return c.withColumns({"r": F.row_number().over(w), "t": F.sum("n").over(Window.partitionBy("source"))}).where("r = 1").select("source", F.col("lang").alias("mode"), F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("T8_repair_flags", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f\\x{2028}\\x{2029}]', ' ', 'g') <> text AS separators, contains(text, chr(173)) AS hyphens FROM documents")
def repair_flags(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.regexp_replace(t, "[\\x00-\\x08\\x0e-\\x1f\\u2028\\u2029]", " ") != t).alias("separators"), (T.dehyphenated(t) != t).alias("hyphens"))


@query("T13_lang_slug", "SELECT source, CASE WHEN contains(lower(source || '_' || lang || '_x'), '_es_') THEN 'es' ELSE 'en' END AS lang, regexp_replace(source || ' (' || lang || ')', '[^A-Za-z0-9._-]', '_', 'g') AS slug FROM documents GROUP BY source, documents.lang")
def lang_slug(spark, d):
    r = table(spark, d, "documents").select("source", "lang").distinct()
    return r.select("source", T.lang_of_name(F.concat_ws("_", "source", "lang", F.lit("x"))).alias("lang"), T.slug(F.concat(F.col("source"), F.lit(" ("), F.col("lang"), F.lit(")"))).alias("slug"))


@query("J19_recursive_roots", "WITH RECURSIVE p AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer), t AS (SELECT pid, pid AS root, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.pid, t.root, t.depth + 1 FROM p JOIN t ON p.parent = t.pid WHERE t.depth < 32) SELECT pid, root, depth FROM t")
def recursive_roots(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("pid"), F.when(k % 7 != 0, k - 1).alias("parent"))
    return spark.sql("WITH RECURSIVE t(pid, root, depth) AS (SELECT pid, pid, 0 FROM {p} WHERE parent IS NULL UNION ALL SELECT p.pid, t.root, t.depth + 1 FROM {p} p JOIN t ON p.parent = t.pid WHERE t.depth < 32) SELECT pid, root, depth FROM t", p=p)


@query("M1_row_state", "WITH r AS (SELECT p_partkey AS id, p_size % 3 = 0 AS indexed, p_size % 5 <> 0 AS on_disk, p_size * 10 AS want, CASE WHEN p_size % 7 = 0 THEN p_size * 9 ELSE p_size * 10 END AS have, p_size % 4 = 1 AS zim, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 2 = 0 END AS served FROM part) SELECT id, CASE WHEN indexed AND NOT on_disk THEN 'red' WHEN on_disk AND have <> want THEN 'red' WHEN on_disk AND zim AND served = false THEN 'red' WHEN on_disk AND indexed THEN 'green' WHEN on_disk THEN 'amber' ELSE 'grey' END AS state, CASE WHEN indexed AND NOT on_disk THEN 'gone' WHEN on_disk AND have <> want THEN 'size' WHEN on_disk AND zim AND served = false THEN 'not_served' ELSE '' END AS cause FROM r")
def row_state(spark, d):
    from ..operators.corpus import row_state as state

    s = F.col("p_size")
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (s % 3 == 0).alias("indexed"), (s % 5 != 0).alias("on_disk"), (s * 10).alias("want"), F.when(s % 7 == 0, s * 9).otherwise(s * 10).alias("have"), F.when(s % 4 == 1, "zim").otherwise("pdf").alias("kind"), F.when(s % 11 != 0, s % 2 == 0).alias("served"))
    return r.select("id", *state())


@query("M2_status_summary", "WITH t AS (SELECT source AS topic, CASE WHEN doc_id % 3 = 0 THEN 'green' WHEN doc_id % 5 = 0 THEN 'amber' WHEN doc_id % 7 = 0 THEN 'red' ELSE 'grey' END AS state, n_chars AS bytes FROM documents) SELECT topic, count(*) FILTER (state = 'green') AS green, count(*) FILTER (state = 'amber') AS amber, count(*) FILTER (state = 'red') AS red, count(*) FILTER (state = 'grey') AS grey, coalesce(sum(bytes) FILTER (state <> 'grey'), 0)::BIGINT AS bytes, (['green', 'amber', 'red', 'grey'])[min(list_position(['green', 'amber', 'red', 'grey'], state))] AS best FROM t GROUP BY 1")
def status_summary(spark, d):
    from ..operators.corpus import summary

    i = F.col("doc_id")
    return summary(table(spark, d, "documents").select(F.col("source").alias("topic"), F.when(i % 3 == 0, "green").when(i % 5 == 0, "amber").when(i % 7 == 0, "red").otherwise("grey").alias("state"), F.col("n_chars").alias("bytes")))


@query("A8_keyword_idf", "WITH n AS (SELECT count(*) AS N FROM part), t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part) SELECT w, count(*) AS df, round(1 + ln(N / count(*)), 6) AS idf FROM t, n GROUP BY w, N")
def keyword_idf(spark, d):
    from ..operators.corpus import keyword_idf as idf

    return idf(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_type"), " ").alias("words")))


@query("J7_prefix_cover", "WITH u AS (SELECT page_id, regexp_replace(url, '^https?://([^?#]*).*$', '\\1') AS path FROM pages), r AS (SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS root FROM u WHERE true) SELECT page_id, root FROM u JOIN r ON path = root OR starts_with(path, root || '/') OR starts_with(root, path || '/')")
def prefix_cover(spark, d):
    from ..operators.corpus import covers

    u = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://([^?#]*).*$", "$1").alias("path"))
    r = u.select(F.concat_ws("/", F.split("path", "/")[0], F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(None))).alias("root")).distinct()
    return covers(u, r)


@query("A13_timing_rates", "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(max(value) FILTER (r = n // 2 + 1), 6) AS upper_median, round(max(value) FILTER (r = least(n, floor(n * 0.95::DOUBLE)::BIGINT + 1)), 6) AS p95 FROM s GROUP BY 1")
def timing_rates(spark, d):
    # counts of values are ordered, not rows
    c = table(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumns({"upto": F.sum("c").over(Window.partitionBy("event_type").orderBy("value")), "n": F.sum("c").over(Window.partitionBy("event_type"))})
    at = lambda r: F.round(F.min(F.when(F.col("upto") >= r, F.col("value"))), 6)
    return c.groupBy("event_type").agg(at(F.floor(F.col("n") / 2) + 1).alias("upper_median"), at(F.least(F.col("n"), F.floor(F.col("n") * 0.95) + 1)).alias("p95"))


@query("C2_hard_split")
def hard_split(spark, d):
    from ..operators.chunking import hard_split as split

    return split(table(spark, d, "documents").select("doc_id", "text"))


@query("T1_html_text")
def html_text(spark, d):
    from ..operators.html import html_to_text

    return html_to_text(table(spark, d, "pages").select("page_id", "html"))
