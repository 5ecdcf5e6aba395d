"""Queries on texts and titles, PDF tables, result pages, vectors by codes, evaluation, counts and sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import figures
from ..functions import text as T
from ..functions import titles
from ..operators import corpus, evaluation, pages, pdf, quality, retrieval, safety, vectors
from ..sources import store
from ..sources.tables import CHUNKS_SQL, chunks, table
from .answers import DOSED, FOLD_SQL, _pool, _turns
from .queries import ANSWER_SQL, COLLAPSE_SQL, VEC_SQL, WORDS_SQL, _answers, _dense, query

# -- texts


@query("T7_dehyphenate", "SELECT doc_id, sha1(replace(regexp_replace(t, '(\\p{L})' || chr(173) || '\\s*(\\p{L})', '\\1\\2', 'g'), chr(173), '')) AS plain FROM (SELECT doc_id, regexp_replace(text, '([aeiou]{2}) ?([b-z])', '\\1' || chr(173) || ' \\2', 'g') || ' ' || chr(173) AS t FROM documents)")
def dehyphenate(spark, d):
    t = F.concat(F.regexp_replace("text", "([aeiou]{2}) ?([b-z])", "$1­ $2"), F.lit(" ­"))
    return table(spark, d, "documents").select("doc_id", F.sha1(T.dehyphenated(t)).alias("plain"))


@query("T16_accent_fold", f"SELECT page_id, sha1(translate(lower(url || ' Ça, Ñandú!'), '{T.ACCENTED}', '{T.PLAIN}')) AS folded FROM pages")
def accent_fold(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(figures.folded(F.concat("url", F.lit(" Ça, Ñandú!")))).alias("folded"))


@query("T20_prose_score", f"SELECT doc_id, CASE WHEN len({WORDS_SQL('text')}) < 20 THEN 99.0 ELSE round(100.0::DOUBLE * len(regexp_extract_all(text, '[.!?]')) / len({WORDS_SQL('text')}), 6) END::DOUBLE AS score FROM documents")
def prose_score(spark, d):
    return table(spark, d, "documents").select("doc_id", T.prose_score(F.col("text")).alias("score"))


@query("T29_fingerprints", f"SELECT doc_id, sha1({COLLAPSE_SQL('text')}) AS whole, sha1(({COLLAPSE_SQL('text')})[1:240]) AS opening FROM documents")
def fingerprints(spark, d):
    return quality.keyed(table(spark, d, "documents")).select("doc_id", F.col("h").alias("whole"), "opening")


_T25 = "CASE doc_id % 5 WHEN 0 THEN 'How do I ' || text[1:60] || '? - Brand' WHEN 1 THEN 'What is this?' WHEN 2 THEN text[1:170] || '?' WHEN 3 THEN 'Welcome to the page of ' || text[1:40] || '?' ELSE text[1:80] END"


@query("T25_clean_titles", f"WITH t AS (SELECT doc_id, trim(regexp_replace({_T25}, ' - Brand$', '')) AS t FROM documents) SELECT doc_id, t AS title FROM t WHERE ends_with(t, '?') AND length(t) BETWEEN 25 AND 150 AND len({WORDS_SQL('t')}) >= 5 AND NOT regexp_matches(lower(t), '^(welcome|index|home|contents)') AND NOT contains(t, chr(10))")
def clean_titles(spark, d):
    t = F.expr(_T25.replace("text[1:60]", "substring(text, 1, 60)").replace("text[1:170]", "substring(text, 1, 170)").replace("text[1:40]", "substring(text, 1, 40)").replace("text[1:80]", "substring(text, 1, 80)"))
    return table(spark, d, "documents").select("doc_id", titles.question(t, F.lit("Brand")).alias("title")).where("title is not null")


@query("T26_shell_words", "SELECT p_partkey AS id, 'go ''' || replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' it''s' ELSE '' END, '''', '''\"''\"''') || ''' ' || p_brand[7:8] AS command FROM part")
def shell_words(spark, d):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " it's").otherwise(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("go "), titles.shell_word(name), F.lit(" "), titles.shell_word(F.substring("p_brand", 7, 2))).alias("command"))


@query("T27_citation", f"WITH {CHUNKS_SQL} SELECT cid, (i + 1) || '/' || n AS chunk, CASE WHEN src % 4 = 0 THEN 'pdf' ELSE 'zim' END AS kind, CASE WHEN src % 4 = 0 THEN '/files/s%20' || src || '/a/' || dnum || '.pdf#page=' || CASE WHEN i % 2 = 0 THEN i + 1 ELSE 1 END WHEN src % 3 = 0 THEN '/viewer#seen/b' || src || '/a/' || dnum || '.pdf' ELSE '/viewer#b' || src || '/a/' || dnum || '.pdf' END AS url, CASE WHEN src % 4 <> 0 THEN src % 3 = 0 END AS book_verified FROM chunks")
def citation(spark, d):
    c = chunks(table(spark, d, "documents"))
    s = F.col("src")
    row = F.struct(
        F.lit("f").alias("file"), F.concat(F.lit("s "), s).alias("shelf"), F.concat(F.lit("a/"), "dnum", F.lit(".pdf")).alias("path"), F.lit("").alias("title"), F.col("i").alias("i"), F.col("n").alias("n"),
        F.when(F.col("i") % 2 == 0, F.col("i") + 1).alias("page"), F.when(s % 4 != 0, F.concat(F.lit("b"), s)).alias("book"), F.when((s % 4 != 0) & (s % 3 == 0), F.concat(F.lit("seen/b"), s)).alias("served"),
    )
    return c.select("cid", row.alias("r")).select("cid", pages.citation(F.col("r")).alias("c")).select("cid", "c.chunk", "c.kind", "c.url", "c.book_verified")


@query("T35_public_rows", "SELECT p_partkey AS id, p_brand AS title FROM part")
def public_rows(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.col("p_size").alias("_kw"), F.col("p_type").alias("_idf"))
    return titles.public(rows)


@query("T36_requirements", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '2.' || p_size || '.1' END AS pin, CASE p_partkey % 4 WHEN 0 THEN 'windows' WHEN 1 THEN 'macos' WHEN 2 THEN 'linux' END AS platform FROM part")
def requirements(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("numpy==1.0\n"), F.when(k % 3 == 0, F.concat(F.lit("torch=="), F.lit("2."), "p_size", F.lit(".1\n"))).otherwise("torchvision==9\n"), F.lit("--index x"))
    name = F.element_at(F.array(F.lit("tool-win-x64.zip"), F.lit("Tool_macOS.tar.gz"), F.lit("tool-linux.tar.gz"), F.lit("tool.pdf")), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), titles.pinned(text, "torch").alias("pin"), titles.platform(name).alias("platform"))


@query("T12_pretty_title", "WITH s AS (SELECT doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS t FROM documents), b AS (SELECT doc_id, first(trim(t) ORDER BY length(t) % 17 DESC, i) AS top FROM s WHERE trim(t) <> '' AND 2 * i < n GROUP BY 1) SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN source END, top, 'doc-' || doc_id) AS title FROM documents LEFT JOIN b USING (doc_id)")
def pretty_title(spark, d):
    """Lines stand for a page's blocks; their lengths give sizes of type."""
    docs = table(spark, d, "documents")
    b = docs.select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", "text", (F.length("text") % 17).alias("size"), (F.col("i") / F.col("n")).alias("y"))
    named = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("meta"), F.concat(F.lit("doc-"), "doc_id").alias("file"))
    return titles.pretty(named, b, "doc_id")


# -- PDF tables

_GRID = "g AS (SELECT o_orderkey AS id, list_transform(range(0, (o_orderkey % 4)::INT + 1), lambda r: list_transform(range(0, (o_orderkey % 10)::INT + 1), lambda c: CASE WHEN (r * 3 + c * 5 + o_orderkey) % 7 = 0 THEN '' WHEN (r + c + o_orderkey) % 11 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN '7' WHEN o_orderkey % 17 = 0 AND c = 1 THEN '1 2 3 4 5 6 7' WHEN o_orderkey % 19 = 0 AND r = 0 THEN repeat('word ', 50) ELSE 'cell ' || (r * 10 + c) END)) AS rows, (o_orderkey % 3) * 4 AS original, (o_orderkey % 9) / 10.0 AS width FROM orders WHERE o_orderkey % 5 = 0)"


def _grid(spark, d):
    o = F.col("o_orderkey")

    def cell(r, c):
        return F.when((r * 3 + c * 5 + o) % 7 == 0, "").when((r + c + o) % 11 == 0, "x").when(o % 13 == 0, "7").when((o % 17 == 0) & (c == 1), "1 2 3 4 5 6 7").when((o % 19 == 0) & (r == 0), F.repeat(F.lit("word "), 50)).otherwise(F.concat(F.lit("cell "), (r * 10 + c).cast("string")))

    upto = lambda n: F.sequence(F.lit(0), n.cast("int"))
    rows = F.transform(upto(o % 4), lambda r: F.transform(upto(o % 10), lambda c: cell(r, c)))
    return table(spark, d, "orders").where("o_orderkey % 5 = 0").select(o.alias("id"), rows.alias("rows"), ((o % 3) * 4).alias("original"), ((o % 9) / 10.0).alias("width"))


_FIG = "len(regexp_extract_all(c, '\\d+(?:[.,]\\d+)?'))"


@query("T9_table_gate", f"""WITH {_GRID}, f AS (SELECT *, flatten(rows) AS cells, len(rows[1]) AS n, list_filter(flatten(rows), lambda c: c <> '') AS filled FROM g) SELECT id, CASE WHEN len(rows) < 2 OR n < 2 THEN 'too small' WHEN n > 8 THEN 'too many columns' WHEN len(filled) / len(cells) < 0.4 THEN 'mostly empty'
WHEN len(list_filter(cells, lambda c: length(c) > 200)) > 0 THEN 'a column collapsed' WHEN len(list_filter(cells, lambda c: {_FIG} >= 6 AND {_FIG} / greatest(1, len(list_filter(string_split_regex(c, '\\s+'), lambda w: w <> ''))) > 0.6)) > 0 THEN 'figures run together'
WHEN len(filled) >= 6 AND len(list_filter(filled, lambda c: length(c) = 1)) / len(filled) >= 0.4 THEN 'columns were sliced' WHEN original >= 4 AND n * 2 <= original THEN 'slice of a wider table' WHEN width < 0.18 THEN 'sliver of a page' ELSE '' END AS why FROM f""")
def table_gate(spark, d):
    return _grid(spark, d).select("id", pdf.quality(F.col("rows"), F.col("original"), F.col("width")).alias("why"))


@query("T37_cells", "SELECT doc_id, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cell FROM documents")
def cells(spark, d):
    t = F.regexp_replace("text", "([a-z]{2})([a-z]{2})", "$1\u00ad $2")
    return table(spark, d, "documents").select("doc_id", F.sha1(pdf.cleaned(t)).alias("cell"))


@query("T10_table_text")
def table_text(spark, d):
    return pdf.tables(_grid(spark, d).select("id", "rows", "width"))


@query("T11_page_text", "WITH b AS (SELECT l_orderkey AS id, l_linenumber * 10.0 AS y0, l_partkey::VARCHAR AS t FROM lineitem WHERE l_linenumber NOT IN (3, 4)), x AS (SELECT DISTINCT l_orderkey AS id, 27.0 AS y0, 'Table.' AS t FROM lineitem WHERE l_linenumber = 3), p AS (SELECT id, y0, t FROM b UNION SELECT id, y0, t FROM x UNION SELECT l_orderkey, l_linenumber * 10.0, l_partkey::VARCHAR FROM lineitem WHERE l_linenumber = 4 AND l_orderkey NOT IN (SELECT id FROM x)) SELECT id, string_agg(t, chr(10) ORDER BY y0, t) AS text FROM p GROUP BY 1")
def page_text(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    y = F.col("l_linenumber") * 10.0
    at = [F.col("l_orderkey").alias("id"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(50.0).alias("x1"), (y + 8).alias("y1")]
    blocks = l.select(*at, F.col("l_partkey").cast("string").alias("text"))
    boxes = l.where("l_linenumber = 3").select("l_orderkey").distinct().select(F.col("l_orderkey").alias("id"), F.lit(0.0).alias("x0"), F.lit(27.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(50.0).alias("y1"), F.lit("Table.").alias("text"))
    return pdf.page_text(blocks, boxes)


# -- answers and figures


@query("N2_unsourced_split", f"WITH {ANSWER_SQL} SELECT conv_id, turn, rest IS NOT NULL AS marked, length(rest)::INT AS after FROM v")
def unsourced_split(spark, d):
    _, rest = T.split_unsourced(F.col("t"))
    return _answers(spark, d).select("conv_id", "turn", rest.isNotNull().alias("marked"), F.length(rest).alias("after"))


@query("N4_unsourced_citations", f"WITH {ANSWER_SQL} SELECT conv_id, turn, len(regexp_extract_all(coalesce(rest, ''), '\\[(\\d{{1,2}})\\]'))::INT AS n FROM v")
def unsourced_citations(spark, d):
    _, rest = T.split_unsourced(F.col("t"))
    return _answers(spark, d).select("conv_id", "turn", F.size(F.regexp_extract_all(F.coalesce(rest, F.lit("")), F.lit(T.CITE), 1)).alias("n"))


_DOSE_ONLY = f"WITH t AS (SELECT conv_id, turn, {DOSED} AS t FROM conversations)"


@query("N8_figures", f"{_DOSE_ONLY}, f AS (SELECT conv_id, turn, unnest(CASE turn % 3 WHEN 0 THEN ['dose|mg=500', 'dose|every8hours='] WHEN 1 THEN ['electrical|v=12', 'torque_tolerance|nm=25'] ELSE [] END) AS f FROM t) SELECT conv_id, turn, array_to_string(list_sort(list(f)), ';') AS figures FROM f GROUP BY 1, 2")
def answer_figures(spark, d):
    """Of sentences that are put behind the turns: what is in them is known."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(DOSED).alias("t")).select("conv_id", "turn", figures.values(F.col("t")).alias("v")).where(F.size("v") > 0)
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(F.transform("v", lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";").alias("figures"))


@query("B2_hard_units", f"{_DOSE_ONLY} SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '500 mg|every 8 hours' WHEN 1 THEN '25 Nm' ELSE '' END AS hard FROM t")
def hard_units(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", figures.scan(F.expr(DOSED)).alias("f"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(F.filter("f", lambda x: x["tier"] == "hard"), lambda x: x["term"]), "|").alias("hard"))


@query("B3_context_words", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'dose' WHEN doc_id % 3 = 1 THEN 'per kg' END AS word FROM documents")
def context_words(spark, d):
    near = F.when(F.col("doc_id") % 3 == 0, "overdoses of a dose, take").when(F.col("doc_id") % 3 == 1, "so much per kg of it").otherwise("doserate perkg")
    from ..functions import vocabulary as V

    return table(spark, d, "documents").select("doc_id", figures.first_word(near, V.CONTEXT["dose"]).alias("word"))


@query("A26_finding_counts", "SELECT category, tier, count(*) AS n FROM (SELECT unnest(CASE turn % 3 WHEN 0 THEN [('dose', 'hard'), ('dose', 'hard')] WHEN 1 THEN [('electrical', 'lifted'), ('torque_tolerance', 'hard')] ELSE [] END) AS f FROM conversations) AS x, LATERAL (SELECT f[1] AS category, f[2] AS tier) GROUP BY 1, 2")
def finding_counts(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(DOSED).alias("text"))
    return safety.findings(rows, "id").groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("F5_wants_suggestion", "SELECT p_partkey AS id, p_size % 3 = 0 OR (['grounded', 'grounded_plus', 'uncovered', 'unsourced', 'model_only'])[p_size % 5 + 1] IN ('unsourced', 'uncovered', 'model_only') AS wants FROM part")
def wants_suggestion(spark, d):
    s = F.col("p_size")
    g = F.element_at(F.array(*map(F.lit, ["grounded", "grounded_plus", "uncovered", "unsourced", "model_only"])), (s % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), corpus.wants_suggestion(g, s % 3).alias("wants"))


# -- suggestion

_SCORED = ["p_partkey % 20 AS query_id", "CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'es' END AS ql0", "p_partkey AS id", "(p_size % 40) / 10.0 AS score", "p_size % 3 AS hits"]
_ROWS = ["p_partkey AS id", "CASE p_partkey % 7 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' WHEN 2 THEN 'red' ELSE 'grey' END AS state", "CASE WHEN p_partkey % 11 <> 0 THEN p_size * 10 END AS bytes", "CASE WHEN p_partkey % 3 = 0 THEN 'es' ELSE 'en' END AS lang", "p_partkey % 5 <> 0 AS suggest", "p_partkey % 17 = 3 AS encyclopedia"]
_OFFER_SQL = f"""s AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'es' END AS ql, id, score, hits FROM (SELECT {', '.join(_SCORED)} FROM part WHERE p_partkey % 4 <> 1 AND p_partkey % 20 < 18)), r AS (SELECT {', '.join(_ROWS)} FROM part),
j AS (SELECT s.*, state, bytes FROM s JOIN r USING (id) WHERE suggest), c AS (SELECT query_id, max(score) AS covered FROM j WHERE state = 'green' GROUP BY 1),
k AS (SELECT j.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hits DESC, list_position(['amber', 'grey', 'red'], state), coalesce(bytes, 0), id)::INT AS place FROM j LEFT JOIN c USING (query_id) WHERE state <> 'green' AND score >= greatest(2.0, 0.5 * coalesce(covered, 0))),
o AS (SELECT query_id, id, score::DOUBLE AS score, place, false AS fallback FROM k WHERE place <= 3), e AS (SELECT lang AS ql, min(id) AS id FROM r WHERE suggest AND state <> 'green' AND encyclopedia GROUP BY 1),
a AS (SELECT DISTINCT query_id, ql FROM s WHERE query_id NOT IN (SELECT query_id FROM o) AND query_id NOT IN (SELECT query_id FROM c WHERE covered >= 2.0))"""


def _offered(spark, d):
    p = table(spark, d, "part")
    s = p.where("p_partkey % 4 <> 1 and p_partkey % 20 < 18").selectExpr(*_SCORED).withColumn("ql", F.when(F.col("query_id") % 2 == 0, "en").otherwise("es")).drop("ql0")
    rows = p.selectExpr(*_ROWS).withColumn("topics", F.when(F.col("encyclopedia"), F.array(F.lit("reference"))).otherwise(F.array(F.lit("reference"), F.lit("x"))))
    return corpus.offered(s, rows)


@query("M5_suggestion_floor", f"WITH {_OFFER_SQL} SELECT query_id, id, score, fallback FROM o UNION ALL SELECT query_id, e.id, 0.0::DOUBLE, true FROM a JOIN e USING (ql)")
def suggestion_floor(spark, d):
    return _offered(spark, d).select("query_id", "id", F.col("score").cast("double").alias("score"), "fallback")


@query("K5_suggestion_order", f"WITH {_OFFER_SQL} SELECT query_id, id, place FROM o")
def suggestion_order(spark, d):
    return _offered(spark, d).where("not fallback").select("query_id", "id", "place")


# -- counts and sizes


@query("A10_counts", f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT dnum) AS documents, count(DISTINCT src) AS artifacts, count(*) FILTER (i = 0) AS firsts FROM chunks")
def counts(spark, d):
    # counts of each document first, so that no distinct set is held
    by = chunks(table(spark, d, "documents")).groupBy("src", "dnum").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("i") == 0, 1)).alias("f"))
    return by.groupBy("src").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("f").alias("f")).agg(F.sum("n").alias("chunks"), F.sum("d").alias("documents"), F.count(F.lit(1)).alias("artifacts"), F.sum("f").alias("firsts"))


@query("A12_kind_counts", "SELECT c_nationkey % 3 AS kind, count(*) AS n, count(DISTINCT c_nationkey) AS names FROM customer GROUP BY 1")
def kind_counts(spark, d):
    one = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 3).alias("kind"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"))


@query("A15_percentile", "SELECT lang, list_sort(list(n_chars))[least(count(*), floor(count(*) * 0.9)::BIGINT + 1)] AS p90, list_sort(list(n_chars))[least(count(*), floor(count(*) * 0.5)::BIGINT + 1)] AS p50 FROM documents GROUP BY 1")
def percentile(spark, d):
    return quality.percentiles(table(spark, d, "documents"), "lang", "n_chars", {"p90": 0.9, "p50": 0.5})


@query("J10_not_indexed", "SELECT s_name AS book FROM supplier EXCEPT SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0")
def not_indexed(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_name").alias("book")).subtract(s.where("s_suppkey % 3 = 0").select("s_name"))


@query("J6_catalogue_topics", "SELECT p_partkey AS id, coalesce(n_name, '') AS topics, n_name IS NOT NULL AS known FROM part LEFT JOIN nation ON p_partkey = n_nationkey")
def catalogue_topics(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("topics"))
    return corpus.with_topics(table(spark, d, "part").select(F.col("p_partkey").alias("id")), n)


@query("J17_predicted_actual", "SELECT a.p_brand AS file, predicted, actual, round(actual / predicted, 6) AS ratio FROM (SELECT p_brand, sum(p_size)::BIGINT AS predicted FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a JOIN (SELECT p_brand, count(*) AS actual FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) b USING (p_brand)")
def predicted_actual(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("file")).agg(F.sum("p_size").cast("long").alias("predicted"))
    b = p.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("file")).agg(F.count(F.lit(1)).alias("actual"))
    return a.join(b, "file").withColumn("ratio", F.round(F.col("actual") / F.col("predicted"), 6))


@query("K12_newest_match", "WITH c AS (SELECT o_custkey AS repo, o_orderkey AS sha, o_orderdate AS day, o_orderkey % 3 = 0 AS matches, o_orderkey % 50 AS score FROM orders) SELECT repo, coalesce(first(sha ORDER BY day DESC, sha DESC) FILTER (matches), first(sha ORDER BY score DESC, sha)) AS sha, bool_or(matches) AS exact FROM c GROUP BY 1")
def newest_match(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), k.alias("sha"), F.col("o_orderdate").alias("day"), (k % 3 == 0).alias("matches"), (k % 50).alias("score"))
    return corpus.newest_match(c, "repo")


@query("M21_search_coverage", "SELECT s_nationkey AS form, first(s_suppkey ORDER BY s_suppkey % 4 DESC, s_suppkey % 7 DESC, s_suppkey) AS best, sum(s_suppkey % 4)::BIGINT AS langs FROM supplier GROUP BY 1")
def search_coverage(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("form"), k.alias("id"), (k % 4).alias("langs"), (k % 7).alias("books"))
    return rows.groupBy("form").agg(F.max_by("id", F.struct("langs", "books", -F.col("id"))).alias("best"), F.sum("langs").cast("long").alias("langs"))


@query("M22_invariants", "SELECT 'twice' AS fault, s_nationkey::VARCHAR AS what FROM supplier GROUP BY s_nationkey HAVING count(*) > 1 UNION ALL SELECT 'relative', s_name FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'gone', s_name FROM supplier WHERE s_suppkey % 3 = 0")
def invariants(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("key"), F.concat(F.when(k % 4 == 0, "a/").otherwise("/a/"), "s_name").alias("path"), (k % 3 != 0).alias("there"))
    return corpus.library_faults(rows)


@query("M29_sizes", "SELECT p_partkey AS id, p_partkey * 4287 <= 400000 AS fits, CASE p_size % 3 WHEN 0 THEN 64.0 WHEN 1 THEN 16.0 ELSE 4096.0 END AS bytes_per_vector FROM part")
def sizes(spark, d):
    s = F.col("p_size")
    spec = F.when(s % 3 == 0, "OPQ64,PQ64").when(s % 3 == 1, "PQ32x4").otherwise("Flat")
    fits, each = corpus.store_size(F.col("p_partkey"), F.lit(400000), spec, F.lit(1024))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fits.alias("fits"), each.alias("bytes_per_vector"))


@query("M30_hours", "SELECT p_type AS kind, round(sum(CASE WHEN p_size % 2 = 0 THEN p_size * 0.05 ELSE p_size * 10 * 0.0025 END) / 3600, 6) AS hours FROM part GROUP BY 1")
def hours(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("pages"), (F.col("p_size") * 10).alias("chunks"))
    return corpus.hours(rows, "kind", 0.05, 0.0025)


@query("M33_query_groups", "SELECT p_size % 3 AS pass, p_brand AS source, count(*) AS n FROM part JOIN nation ON p_size % 25 = n_nationkey WHERE p_size % 3 > 0 GROUP BY 1, 2")
def query_groups(spark, d):
    p = table(spark, d, "part").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("scope")), F.col("p_size") % 25 == F.col("scope"))
    return p.where("p_size % 3 > 0").groupBy((F.col("p_size") % 3).alias("pass"), F.col("p_brand").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("M38_home_tiles", "SELECT p_type AS topic, concat_ws(', ', CASE WHEN g > 0 THEN g || ' searchable' END, CASE WHEN a > 0 THEN a || ' browsable' END) AS line FROM (SELECT p_type, count(*) FILTER (p_size % 5 = 0) AS g, count(*) FILTER (p_size % 5 = 1) AS a FROM part GROUP BY 1) WHERE g + a > 0")
def home_tiles(spark, d):
    s = F.col("p_size") % 5
    t = table(spark, d, "part").groupBy(F.col("p_type").alias("topic")).agg(F.count(F.when(s == 0, 1)).alias("green"), F.count(F.when(s == 1, 1)).alias("amber"))
    return corpus.tiles(t)


@query("F11_row_platform", "SELECT p_partkey AS id FROM part WHERE (['win', 'mac', 'linux', 'any'])[p_partkey % 4 + 1] IN ('linux', 'any')")
def row_platform(spark, d):
    name = F.element_at(F.array(F.lit("t-win.exe"), F.lit("t-macos.zip"), F.lit("t-linux.gz"), F.lit("book.pdf")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").where(F.coalesce(titles.platform(name), F.lit("linux")) == "linux").select(F.col("p_partkey").alias("id"))


# -- pages, vectors and evaluation


@query("A19_source_pairs", f"WITH {CHUNKS_SQL}, p AS (SELECT src, sha1({COLLAPSE_SQL('text')}) AS h, row_number() OVER (PARTITION BY src ORDER BY md5(cid), cid) AS rank FROM chunks), u AS (SELECT DISTINCT src, h FROM p WHERE rank <= 400) SELECT a.src AS one, b.src AS other, count(*) AS texts FROM u a JOIN u b ON a.h = b.h AND a.src < b.src GROUP BY 1, 2")
def source_pairs(spark, d):
    t = _pool(spark, d).select(F.col("query_id").alias("src"), "text_key").distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("src")).alias("s")).where(F.size("s") > 1)
    # lists of sources, not of chunks: as many as there are artifacts
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    return t.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.other").agg(F.count(F.lit(1)).alias("texts"))


@query("R7_references", f"WITH {CHUNKS_SQL} SELECT 0 AS query_id, c.cid, (r - 1 + 0.5)::DOUBLE AS rank FROM (SELECT dnum, row_number() OVER (ORDER BY dnum) + 1 AS r, src FROM (SELECT DISTINCT dnum, src FROM chunks WHERE i = 1 AND dnum % 9 = 0 ORDER BY dnum LIMIT 2)) x JOIN chunks c ON c.dnum = x.dnum AND c.i = 1")
def references(spark, d):
    """The first passages of documents refer to a table that the next one holds; two neighbours at most are put in."""
    c = chunks(table(spark, d, "documents"))
    text = F.when((F.col("i") == 0) & (F.col("dnum") % 9 == 0), F.concat("text", F.lit(" as table A2 and by the below"))).when((F.col("i") == 1) & (F.col("dnum") % 9 == 0), F.concat(F.lit("Table A2 here. "), "text")).otherwise(F.col("text"))
    said = c.withColumn("text", text)
    have = c.where("i = 1 and dnum % 9 = 0").select("dnum").distinct()
    first = vectors.numbered(c.where("i = 0").join(have, "dnum", "left_semi").select("dnum", "cid"), ["dnum"], "r").select(F.lit(0).alias("query_id"), (F.col("r") + 1).cast("int").alias("rank"), "cid")
    return pages.expand(first, said).where("of is not null").select("query_id", "cid", "rank")


@query("V4_pq_codes")
def pq_codes(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.coded(v, vectors.train(v, 16)).select(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n")).limit(1)


@query("V6_rerank_depth", f"WITH {VEC_SQL} SELECT query_id, count(*) AS n FROM dn WHERE rank <= 40 GROUP BY 1")
def rerank_depth(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    return vectors.pq_search(v, q, 40, depth=400).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("V7_backend", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'codes' WHEN p_size % 3 = 0 THEN 'store' ELSE 'none' END AS backend, p_size % 2 <> 0 AS fell_back FROM part")
def backend(spark, d):
    s = F.col("p_size")
    name, fell = retrieval.backend([("codes", s % 2 == 0), ("store", s % 3 == 0)])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("backend"), fell.alias("fell_back"))


@query("V8_coverage_gap", "SELECT s_suppkey AS file, coalesce(n_nationkey * 10 <> s_suppkey * 10, true) AS missing FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey AND n_nationkey % 2 = 0")
def coverage_gap(spark, d):
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(k.alias("file"), (k * 10).alias("chunks"))
    n = F.col("n_nationkey").cast("long")
    return corpus.coverage_gaps(r, table(spark, d, "nation").where("n_nationkey % 2 = 0").select(n.alias("file"), (n * 10).alias("rows")))


@query("V10_misses", f"WITH {VEC_SQL}, x AS (SELECT * FROM dn WHERE rank <= 2), f AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dn WHERE vec_id % 40 <> 0) SELECT e.query_id, e.vec_id AS lost, f.vec_id AS took, coalesce(f.score >= 0.95 * e.score, false) AS copy FROM x e JOIN f ON e.query_id = f.query_id AND f.rank = 1 WHERE e.rank = 1 AND e.vec_id <> f.vec_id")
def misses(spark, d):
    v = table(spark, d, "embeddings")
    found = vectors.topk(v.where("vec_id % 40 <> 0"), v.where("vec_id % 20 = 0"), 2)
    return evaluation.usurpers(_dense(spark, d, 2), found).select("query_id", "lost", "took", "copy")


@query("V10_verdict", "SELECT p_partkey AS id, CASE WHEN m / 100.0 <= 0.02 THEN 'sound' WHEN m > 0 AND c / m >= 0.8 THEN 'copies' WHEN 1 - m / 100.0 >= 0.7 THEN 'worn' ELSE 'broken' END AS verdict FROM (SELECT p_partkey, p_size AS m, p_size * (p_partkey % 3) // 2 AS c FROM part)")
def miss_verdict(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), evaluation.verdict(F.lit(100.0), s, F.floor(s * (F.col("p_partkey") % 3) / 2)).alias("verdict"))


_EDITION = "regexp_extract(source, '([0-9]+)$', 1)::INT"


@query("M14_mirror_set", f"WITH p AS (SELECT doc_id, {_EDITION} AS src, sha1(text[1:40]) AS path, text, {WORDS_SQL('text')} AS w FROM documents), g AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM p), x AS (SELECT a.doc_id AS mine, CASE WHEN len(a.w) < 5 THEN (a.text = b.text)::INT ELSE round(len(list_intersect(a.s, b.s)) / len(a.s), 6) END AS c FROM g a JOIN g b ON a.path = b.path WHERE a.src % 2 = 0 AND b.src % 2 = 1) SELECT mine, max(c)::DOUBLE AS coverage FROM x GROUP BY 1 HAVING max(c) >= 0.99")
def mirror_set(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("src"), F.sha1(F.substring("text", 1, 40)).alias("path"), "text")
    return evaluation.mirror_set(p.where("src % 2 = 0"), p.where("src % 2 = 1"))


@query("M16_without_itself", f"WITH {CHUNKS_SQL}, r AS (SELECT dnum % 40 AS query_id, cid, src, dnum FROM chunks WHERE i < 3) SELECT query_id, cid FROM r WHERE NOT (dnum = query_id)")
def without_itself(spark, d):
    c = chunks(table(spark, d, "documents"))
    r = c.where("i < 3").select((F.col("dnum") % 40).alias("query_id"), "cid")
    o = c.where("i = 0 and dnum < 40").select(F.col("dnum").alias("query_id"), F.concat_ws(":", "src", "dnum").alias("prefix"))
    return evaluation.without_itself(r, o)


@query("M17_hash_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('3|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 4")
def hash_sample(spark, d):
    return evaluation.sample_by_hash(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 4, "3")


@query("M19_page_changes", f"WITH {VEC_SQL}, off_ AS (SELECT query_id, vec_id, rank FROM dn WHERE rank <= 5), on_ AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dn WHERE vec_id % 4 <> 0 AND dn.rank <= 7), a AS (SELECT query_id, list(vec_id ORDER BY rank) AS a FROM on_ WHERE rank <= 5 GROUP BY 1), b AS (SELECT query_id, list(vec_id ORDER BY rank) AS b FROM off_ GROUP BY 1) SELECT query_id, coalesce(len(a), 0) = 5 AS full, coalesce(a, []) <> b AS changed, len(list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x)))::INT AS gone FROM b LEFT JOIN a USING (query_id)")
def page_changes(spark, d):
    off = store.kept(_dense(spark, d, 7).select("query_id", F.col("vec_id").alias("cid"), "rank"), "pages")
    on = off.where("cid % 4 <> 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return evaluation.page_changes(on, off, 5)


@query("M20_revisions")
def revisions(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("path"), F.substring("text", 1, 800).alias("text"))
    k = F.col("path").cast("long")
    new = docs.where(k % 70 != 0).select("path", F.when(k % 20 == 0, F.col("text")).when(k % 30 == 0, F.reverse("text")).otherwise(F.concat("text", F.lit(" more"))).alias("text"))
    return evaluation.revisions(docs, new)


@query("A25_scoped_slots", "WITH s AS (SELECT o_custkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'scoped' END AS mode, o_orderkey % 3 <> 0 AS topic, o_orderkey % 5 <> 0 AS place FROM orders), p AS (SELECT mode, query_id, count(*) AS n, count(*) FILTER (topic) AS t, count(*) FILTER (place) AS p, count(*) FILTER (topic AND place) AS b FROM s GROUP BY 1, 2) SELECT mode, sum(n)::BIGINT AS slots, sum(t)::BIGINT AS topic, sum(p)::BIGINT AS place, sum(b)::BIGINT AS both, count(*) FILTER (t < n) AS pages_losing_topic FROM p GROUP BY 1")
def scoped_slots(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.when(k % 2 == 0, "plain").otherwise("scoped").alias("mode"), (k % 3 != 0).alias("topic"), (k % 5 != 0).alias("place"))
    return evaluation.scoped_slots(s)
