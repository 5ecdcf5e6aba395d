"""Queries on answers, safety figures, result pages and vector search by codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions import text as T
from ..operators import html, retrieval, safety, vectors
from ..sources.tables import CHUNKS_SQL, chunks, table
from .queries import ANSWER_SQL, COLLAPSE_SQL, WORDS_SQL, _answers, query

FOLD_SQL = lambda c: f"trim(regexp_replace(translate(lower({c}), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
#: A prescription for every third turn, so that the detector meets figures.
DOSED = "CASE turn % 3 WHEN 0 THEN ' Take 500 mg every 8 hours.' WHEN 1 THEN ' The battery is 12 V, torque 25 Nm.' ELSE '' END"


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat("text", F.expr(DOSED)).alias("text"))


@query("B1_findings")
def findings(spark, d):
    t = _turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return safety.findings(t, "turn_id")


@query("B4_intent", "WITH t AS (SELECT conv_id, turn, ' ' || " + FOLD_SQL(f"text || {DOSED}") + " || ' ' AS t FROM conversations WHERE role = 'user'), c(category, w) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c in V.ASKABLE for w in V.CONTEXT[c] if len(w) > 3) + ") SELECT conv_id, turn, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM t JOIN c ON contains(t, ' ' || w || ' ') GROUP BY 1, 2")
def intent(spark, d):
    t = F.concat(F.lit(" "), T.folded(F.col("text")), F.lit(" "))
    asks = lambda c: F.when(F.exists(F.array(*(F.lit(f" {w} ") for w in V.CONTEXT[c] if len(w) > 3)), lambda w: F.col("t").contains(w)), c)
    rows = _turns(spark, d).where("role = 'user'").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.concat_ws(",", *map(asks, V.ASKABLE)).alias("categories")).where("categories <> ''")


@query("B5_assess")
def assess(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, d).withColumn("before", F.lag("text").over(w))
    return safety.assessed(t.where("role <> 'user'"), ["conv_id", "turn"], "text", "before")


@query("B6_rates")
def finding_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return safety.rates(safety.findings(docs, "doc_id"), docs, "doc_id", "source")


@query("N9_compare")
def compare(spark, d):
    a = _answers(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return safety.compared(a.withColumn("other", F.lead("t").over(w)).where("other is not null"), ["conv_id", "turn"], "t", "other")


_SPELLED_SQL = "text || ' 10 mg per kilogram of body weight daily, 5 grams per ml'"
for _p, _u in V.SPELLINGS:
    _SPELLED_SQL = f"regexp_replace({_SPELLED_SQL}, '{_p}', '{_u}', 'gi')"


@query("N7_spelled_units", f"SELECT conv_id, turn, sha1(regexp_replace({_SPELLED_SQL}, '\\s*/\\s*', '/', 'g')) AS spelled FROM conversations")
def spelled_units(spark, d):
    t = F.concat("text", F.lit(" 10 mg per kilogram of body weight daily, 5 grams per ml"))
    for p, u in V.SPELLINGS:
        t = F.regexp_replace(t, f"(?i){p}", u)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha1(F.regexp_replace(t, r"\s*/\s*", "/")).alias("spelled"))


@query("N10_content_words", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split(" + FOLD_SQL("text") + ", ' '), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in sorted(V.EMPTY)) + "], w)))), ' ') AS words FROM conversations")
def content_words(spark, d):
    words = F.filter(F.split(T.folded(F.col("text")), " "), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(V.EMPTY)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("words"))


@query("N6_messages", f"WITH r AS (SELECT conv_id, turn, {COLLAPSE_SQL("CASE WHEN turn % 3 = 0 THEN repeat(text || ' ', 20) ELSE text END")} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, sha1(string_agg('[' || k || '] turn ' || turn || chr(10) || t[1:4000] || CASE WHEN length(t) > 4000 THEN ' ... [passage truncated at 4000 characters]' ELSE '' END, chr(10) || chr(10) ORDER BY k)) AS body FROM r WHERE k <= 5 GROUP BY 1")
def messages(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = table(spark, d, "conversations").select("conv_id", "turn", T.collapsed(F.expr("CASE WHEN turn % 3 = 0 THEN repeat(text || ' ', 20) ELSE text END")).alias("t"), F.row_number().over(w).alias("k")).where("k <= 5")
    one = F.concat(F.lit("["), "k", F.lit("] turn "), "turn", F.lit("\n"), F.substring("t", 1, 4000), F.when(F.length("t") > 4000, " ... [passage truncated at 4000 characters]").otherwise(""))
    parts = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("p")))).alias("p"))
    return parts.select("conv_id", F.sha1(F.array_join("p.p", "\n\n")).alias("body"))


@query("N12_prompt_variant", f"WITH {ANSWER_SQL} SELECT conv_id, turn, CASE WHEN rest IS NOT NULL AND absent THEN 'recall' ELSE 'check' END AS variant FROM v")
def prompt_variant(spark, d):
    head, rest = T.split_unsourced(F.col("t"))
    absent = F.substring(T.ascii_upper(head), 1, 200).contains(T.ABSENT)
    return _answers(spark, d).select("conv_id", "turn", F.when(rest.isNotNull() & absent, "recall").otherwise("check").alias("variant"))


@query("T28_reasoning", "WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'plan ' || turn || '</think> ' ELSE '' END || text AS t FROM conversations) SELECT conv_id, turn, CASE WHEN contains(t, '</think>') THEN trim(split_part(t, '</think>', 1)) END AS reasoning, sha1(CASE WHEN contains(t, '</think>') THEN trim(t[strpos(t, '</think>') + 8:]) ELSE t END) AS answer FROM r")
def reasoning(spark, d):
    t = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("plan "), "turn", F.lit("</think> "))).otherwise(""), "text")
    before, after = T.split_reasoning(F.col("t"))
    return table(spark, d, "conversations").select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", before.alias("reasoning"), F.sha1(after).alias("answer"))


@query("A17_answer_summary", f"WITH {ANSWER_SQL}, s AS (SELECT turn % 5 AS kind, length(t) AS n, row_number() OVER (PARTITION BY turn % 5 ORDER BY length(t)) AS r, count(*) OVER (PARTITION BY turn % 5) AS c FROM v) SELECT kind, count(*) AS answers, max(n) AS longest, max(n) FILTER (r = c // 2 + 1) AS upper_median, count(*) FILTER (n > 300) AS truncated FROM s GROUP BY 1")
def answer_summary(spark, d):
    n = F.length("t").cast("long")
    s = _answers(spark, d).select((F.col("turn") % 5).alias("kind"), n.alias("n"))
    # counts of lengths, not rows, are ordered
    c = s.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("kind").orderBy("n")
    c = c.withColumns({"upto": F.sum("c").over(w), "total": F.sum("c").over(Window.partitionBy("kind"))})
    return c.groupBy("kind").agg(F.sum("c").alias("answers"), F.max("n").alias("longest"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("upper_median"), F.sum(F.when(F.col("n") > 300, F.col("c")).otherwise(0)).alias("truncated"))


@query("J18_answer_runs", f"WITH {ANSWER_SQL}, runs AS (SELECT conv_id, turn, used, length(t) AS n FROM v) SELECT x.conv_id, x.turn, (y.n - x.n)::BIGINT AS longer, len(x.used) = len(y.used) AS same_citations FROM runs x JOIN runs y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn")
def answer_runs(spark, d):
    used, _ = T.citations(T.split_unsourced(F.col("t"))[0], F.lit(5))
    a = _answers(spark, d).select("conv_id", "turn", F.size(used).alias("c"), F.length("t").cast("long").alias("n"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("n2") - F.col("n")).alias("longer"), (F.col("c") == F.col("c2")).alias("same_citations"))


# -- result pages


def _pool(spark, d):
    """Chunks as candidates of one list for each source: by digest, with the rules' verdicts."""
    c = chunks(table(spark, d, "documents")).withColumn("text_key", F.sha1(T.collapsed(F.col("text"))))
    w = Window.partitionBy("src").orderBy(F.md5("cid"), "cid")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 400").select(
        F.col("src").alias("query_id"), "rank", "src", "dnum", "i", "cid", "text_key",
        F.when(F.col("dnum") % 11 == 0, "mirror").alias("reason"), T.is_navigation(F.lit(""), F.lit(""), F.col("text")).alias("navigation"),
    )


@query("R4_page_assembly")
def page_assembly(spark, d):
    return retrieval.page(_pool(spark, d), 20)


@query("R6_suppressed")
def suppressed(spark, d):
    return retrieval.page(_pool(spark, d), 20).where("outcome <> 'beyond'").groupBy("query_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


NAV_SQL = f"(len({WORDS_SQL('text')}) > 40 AND len(list_distinct({WORDS_SQL('lower(text)')})) / len({WORDS_SQL('text')}) < 0.35)"


@query("K4_page_fill", f"WITH {CHUNKS_SQL}, p AS (SELECT src AS query_id, dnum % 11 = 0 OR {NAV_SQL} AS gone, row_number() OVER (PARTITION BY src ORDER BY md5(cid), cid) AS rank FROM chunks), q AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank) AS k FROM p WHERE rank <= 400) SELECT query_id, count(*) FILTER (NOT gone AND k <= 20) AS kept, coalesce(min(rank) FILTER (NOT gone AND k = 20), max(rank)) AS consumed, max(k) < 20 AS candidates_exhausted FROM q GROUP BY 1")
def page_fill(spark, d):
    p = _pool(spark, d).select("query_id", "rank", (F.col("reason").isNotNull() | F.col("navigation")).alias("gone"))
    q = p.withColumn("k", F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(Window.partitionBy("query_id").orderBy("rank")))
    stays = ~F.col("gone")
    return q.groupBy("query_id").agg(F.count(F.when(stays & (F.col("k") <= 20), 1)).alias("kept"), F.coalesce(F.min(F.when(stays & (F.col("k") == 20), F.col("rank"))), F.max("rank")).cast("long").alias("consumed"), (F.max("k") < 20).alias("candidates_exhausted"))


@query("A19_duplicate_slots", f"WITH {CHUNKS_SQL}, p AS (SELECT src, sha1({COLLAPSE_SQL('text')}) AS h, row_number() OVER (PARTITION BY src ORDER BY md5(cid), cid) AS rank FROM chunks), g AS (SELECT src, h, count(*) AS n FROM p WHERE rank <= 400 GROUP BY 1, 2) SELECT src AS query_id, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicate_slots, count(*) FILTER (n > 1) AS texts FROM g GROUP BY 1")
def duplicate_slots(spark, d):
    g = _pool(spark, d).groupBy("query_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    return g.groupBy("query_id").agg(F.coalesce(F.sum(F.when(more, F.col("n") - 1)), F.lit(0)).alias("duplicate_slots"), F.count(F.when(more, 1)).alias("texts"))


@query("U5_append_fill", f"WITH {CHUNKS_SQL}, p AS (SELECT src, dnum, i, cid, row_number() OVER (PARTITION BY src ORDER BY md5(cid), cid) AS rank FROM chunks), u AS (SELECT src, cid, 0 AS list, rank FROM p WHERE rank <= 400 AND i % 3 = 1 UNION ALL SELECT src, cid, 1, rank FROM p WHERE rank <= 400), f AS (SELECT src, cid, min((list, rank)) AS first FROM u GROUP BY 1, 2), k AS (SELECT src AS query_id, cid, row_number() OVER (PARTITION BY src ORDER BY first) AS place FROM f) SELECT * FROM k WHERE place <= 30")
def append_fill(spark, d):
    p = _pool(spark, d).select("query_id", "cid", "i", "rank")
    u = p.where("i % 3 = 1").select("query_id", "cid", F.lit(0).alias("list"), "rank").unionByName(p.select("query_id", "cid", F.lit(1).alias("list"), "rank"))
    f = u.groupBy("query_id", "cid").agg(F.min(F.struct("list", "rank")).alias("first"))
    return f.select("query_id", "cid", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long").alias("place")).where("place <= 30")


# -- search by codes


@query("V5_pq_search")
def pq_search(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.pq_search(v, v.where("vec_id % 20 = 0"), 10)


@query("V9_pq_recall")
def pq_recall(spark, d):
    """Each query finds itself, and the share of the exact ten that the search by codes gives."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    got, exact = vectors.pq_search(v, q, 10), retrieval.exact_topk(v, q, 10)
    both = exact.select("query_id", "vec_id").join(got.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    self_ = F.max((F.col("query_id") == F.col("vec_id")) & F.col("hit").isNotNull())
    return both.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"), F.coalesce(self_, F.lit(False)).alias("finds_itself"))


@query("A24_table_share")
def table_share(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    rows = F.concat(F.lit("<table><tr><th>page<th>size</tr><tr><td>"), F.col("page_id"), F.lit("<td>"), F.length("html"), F.lit("</tr></table>"))
    return html.table_share(p.select("page_id", F.concat("html", rows).alias("html")))
