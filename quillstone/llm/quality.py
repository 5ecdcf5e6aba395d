"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every text gets its counts in one scan; from them, KLL sketches of three rates are built for each language and source
over all documents that pass the base rules. Sketches merge, so partial ones are made before the shuffle, and groups of
fewer than LEAST documents fall back on the merged sketches of their language, then on those of all.

A rate is (count + 1) / (total + prior): symbols among characters, repeated lines among lines, words in repeated windows
among words. So texts without any differ by their lengths, and quartiles say what is usual in a group. A document whose rate
is beyond q75 * (q75 / q25) ** 3 of its group goes: three quartile distances on a scale of logarithms. There is no fixed
cutoff; a quartile distance counts as a factor of NARROW at least, so that a group of nearly equal documents doesn't
reject plain ones. Verdicts are joined to the counts.

Three-word windows are compared by a 64-bit hash inside one text. A null text has no words and fails the base
rules; null lang and source are groups of their own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

SPACES = " \t\n\x0b\f\r"
#: Documents that a group's own thresholds need.
LEAST = 100
#: Least factor between the third quartile and the first.
NARROW = 1.25
#: Of each rate: what is counted, of how many, and the prior of the total.
RATES = {"symbol_rate": ("n_symbols", "word_chars", 500), "dup_line_rate": ("n_dup_lines", "n_lines", 20), "repeat_rate": ("n_repeat_words", "n_words", 50)}
#: Size of the sketches: rank error below 0.2 %; groups of up to this many documents are exact.
SKETCH = 2048


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each text, and the columns to keep."""
    text = F.coalesce("text", F.lit(""))
    bare = lambda c: F.translate(c, SPACES, "")
    rows = docs.select(*keep, text.alias("t_"))
    rows = rows.select(
        *keep,
        F.length(bare(F.col("t_"))).cast("long").alias("word_chars"),
        (F.length("t_") - F.length(F.translate("t_", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t_", "\n"), lambda x: F.length(bare(x)) > 0).alias("lines_"),
        F.filter(F.split("t_", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w_"),
    )
    window = F.when(F.size("w_") >= 3, F.transform(F.slice("w_", 1, F.size("w_") - 2), lambda x, i: F.xxhash64(x, F.col("w_")[i + 1], F.col("w_")[i + 2]))).otherwise(F.array().cast("array<long>"))
    rows = rows.select(*keep, "word_chars", "n_symbols", F.size("w_").cast("long").alias("n_words"), F.size("lines_").cast("long").alias("n_lines"), (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), window.alias("g_"))
    # windows in order of their hash; equal neighbours are the repeated ones
    ordered = F.when(F.size(F.array_distinct("g_")) < F.size("g_"), F.sort_array(F.transform("g_", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.select("*", ordered.alias("s_")).drop("g_")
    same = lambda e, k: ((k > 0) & (F.get("s_", k - 1)["g"] == e["g"])) | F.coalesce(F.get("s_", k + 1)["g"] == e["g"], F.lit(False))
    rows = rows.select("*", F.sort_array(F.transform(F.filter("s_", same), lambda e: e["i"])).alias("p_")).drop("s_")
    covered = F.aggregate("p_", F.struct(F.lit(-10).alias("at"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")), lambda a: a["n"])
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured(counts: DataFrame) -> DataFrame:
    rate = lambda n, total, prior: (F.col(n) + 1).cast("double") / (F.col(total) + prior)
    return counts.withColumns({m: rate(*parts) for m, parts in RATES.items()} | {"base_failed": base_failed()})


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable sketches of each measure for each language and source, over documents that pass the base rules."""
    return counts.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in RATES))


def fences(sk: DataFrame) -> DataFrame:
    """lang, source and the highest value of each measure that is kept."""
    merged = lambda by: sk.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in RATES))

    def fence(m: str) -> Column:
        q = lambda r: F.kll_sketch_get_quantile_double(m, F.lit(r))
        ratio = F.greatest(q(0.75) / q(0.25), F.lit(NARROW))
        return q(0.75) * ratio * ratio * ratio

    top = lambda df, tag: df.select(*[c for c in ("lang", "source") if c in df.columns], F.col("n").alias(f"n_{tag}"), *(fence(m).alias(f"{m}_{tag}") for m in RATES))
    own, by_lang, every = top(sk, "own"), top(merged(["lang"]), "lang"), top(merged([]).where("n > 0"), "all")
    # a row for each group, not for each document; the last side is one row
    rows = own.join(by_lang.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(every), F.lit(True), "left")
    pick = lambda m: F.when(F.col("n_own") >= LEAST, F.col(f"{m}_own")).when(F.col("n_lang") >= LEAST, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
    return rows.select("lang", "source", *(pick(m).alias(f"{m}_max") for m in RATES))


def judged(docs: DataFrame, where: str, *keep: str) -> DataFrame:
    """Counts, base_failed and kept for each document."""
    counts = staged(measured(text_counts(docs, *keep)), where)
    limits = fences(sketches(counts)).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    rows = counts.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    # a group without limits has no document that passes the base rules
    within = F.lit(True)
    for m in RATES:
        within &= F.coalesce(F.col(m) <= F.col(f"{m}_max"), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & within)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, f"{shared_dir(spark)}/counts", "doc_id", "lang", "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_M = list(RATES)
_R = {m: f"greatest(quantile_disc({m}, 0.75) / quantile_disc({m}, 0.25), {NARROW}::DOUBLE)" for m in _M}
_Q = ", ".join(f"quantile_disc({m}, 0.75) * {_R[m]} * {_R[m]} * {_R[m]} AS {m}_max" for m in _M)
_V = ", ".join(f"(({n} + 1)::DOUBLE / ({total} + {prior})) AS {m}" for m, (n, total, prior) in RATES.items())
COUNTS_SQL = r"""
t AS (SELECT *, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
c AS (SELECT a.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM a LEFT JOIN r USING (doc_id))"""
JUDGED_SQL = (
    COUNTS_SQL
    + f""",
m AS (SELECT *, {_V}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
o AS (SELECT lang, source, count(*) AS n, {_Q} FROM m WHERE NOT base_failed GROUP BY 1, 2),
lg AS (SELECT lang, count(*) AS n, {_Q} FROM m WHERE NOT base_failed GROUP BY 1),
al AS (SELECT {_Q} FROM m WHERE NOT base_failed),
f AS (SELECT o.lang, o.source, {", ".join(f"CASE WHEN o.n >= {LEAST} THEN o.{m}_max WHEN lg.n >= {LEAST} THEN lg.{m}_max ELSE al.{m}_max END AS {m}_max" for m in _M)}
      FROM o JOIN lg ON o.lang IS NOT DISTINCT FROM lg.lang CROSS JOIN al),
j AS (SELECT m.*, NOT base_failed AND {" AND ".join(f"coalesce({m} <= {m}_max, true)" for m in _M)} AS kept
      FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)"""
)
SQL = {"op8_quality_rules": f"WITH {JUDGED_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM j"}
QUERIES = {"op8_quality_rules": op8_quality_rules}
