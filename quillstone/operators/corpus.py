"""State of a library's rows, its summary, keyword weights and path cover."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content, folded, lang_votes

RANK = ["green", "amber", "red", "grey"]


def row_state() -> tuple[Column, Column]:
    """state and cause from indexed, on_disk, kind, want, have (bytes or null) and served (null: the library is unknown)."""
    c = F.col
    gone = c("indexed") & ~c("on_disk")
    size = c("on_disk") & (c("kind") != "folder") & (c("want") != 0) & (c("have") != c("want"))
    unserved = c("on_disk") & (c("kind") == "zim") & ~F.coalesce(c("served"), F.lit(True))
    cause = F.when(gone, "gone").when(F.coalesce(size, F.lit(False)), "size").when(unserved, "not_served").otherwise("")
    state = F.when(cause != "", "red").when(c("on_disk") & c("indexed"), "green").when(c("on_disk"), "amber").otherwise("grey")
    return state.alias("state"), cause.alias("cause")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of each state, bytes that are there, and the best state, for each topic (topic, state, bytes)."""
    s = F.col("state")
    rank = F.array_position(F.array(*map(F.lit, RANK)), s)
    return rows.groupBy("topic").agg(*(F.count(F.when(s == x, 1)).alias(x) for x in RANK), F.coalesce(F.sum(F.when(s != "grey", F.col("bytes"))), F.lit(0)).alias("bytes"), F.min_by(s, rank).alias("best"))


def keyword_idf(rows: DataFrame) -> DataFrame:
    """w, df, idf = 1 + ln(N / df) over rows of id and words."""
    n = rows.agg(F.count(F.lit(1)).alias("N"))
    df = rows.select("id", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("w", "df", F.round(1 + F.log(F.col("N") / F.col("df")), 6).alias("idf"))


def covers(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of paths with each root that equals the path, holds it, or lies in it.

    Both sides list their directories, so this is an equi join on a directory and not a nested loop.
    """
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/"))
    below = paths.select("*", F.explode(up("path")).alias("root")).join(roots, "root")
    above = paths.join(roots.select("root", F.explode(up("root")).alias("path")), "path").where("path <> root")
    columns = [c for c in paths.columns if c != "path"]
    return below.select(*columns, "root").unionByName(above.select(*columns, "root"))


# Endings and beginnings of names that a fetch leaves out; the exports go only where weights are.
NO_ENDINGS, NO_PLACES, EXPORTS, COPIES = (".jpg", ".jpeg", ".png", ".gif"), ("imgs/", ".gitattributes"), ("onnx/",), (".bin", ".pt")


def keep_names(files: DataFrame) -> DataFrame:
    """Files (repo, name) that a fetch takes: no images, and no second copy of weights where a .safetensors is."""
    name, low = F.col("name"), F.lower("name")
    any_ = lambda *tests: reduce(or_, tests)
    weights = files.where(name.endswith(".safetensors")).select("repo").distinct().withColumn("st", F.lit(True))
    image = any_(*(low.endswith(x) for x in NO_ENDINGS), *(name.startswith(x) for x in NO_PLACES))
    copy = F.coalesce("st", F.lit(False)) & any_(*(low.endswith(x) for x in COPIES), *(name.startswith(x) for x in EXPORTS))
    return files.join(weights, "repo", "left").where(~image & ~copy).drop("st")


def has_words(hay: Column, words: list[str]) -> Column:
    """Whether a haystack in lower case holds every word."""
    return F.forall(F.array(*map(F.lit, words)), lambda w: hay.contains(w)) if words else F.lit(True)


def match_trees(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """path and state of each of my files (path, h): same, renamed (its hash stands elsewhere), missing or differs."""
    at = theirs.select("path", F.col("h").alias("h_"), F.lit(True).alias("there"))
    # one row for each hash: a common content isn't multiplied
    found = theirs.groupBy("h").agg(F.min("path").alias("found"))
    state = F.when(F.col("h_") == F.col("h"), "same").when(F.col("found").isNotNull(), "renamed").when(F.col("there").isNull(), "missing").otherwise("differs")
    return mine.select("path", "h").join(at, "path", "left").join(found, "h", "left").select("path", state.alias("state"))


def pin_state(pinned: Column, found: Column) -> Column:
    return F.when(found.isNull(), "UNPINNED").when(pinned.isNull(), "PINNED").when(pinned == found, "CONFIRMED").otherwise("DISAGREES")


def index_state(stamp: Column, now: Column) -> Column:
    return F.when(stamp.isNull(), "missing").when(stamp != now, "stale").otherwise("current")


def coverage(registry: DataFrame, stamp: DataFrame) -> DataFrame:
    """total and covered chunks of the registry (file, chunks), files without a stamp (file, rows) and with another count."""
    j = registry.join(stamp, "file", "left")
    same = F.col("rows") == F.col("chunks")
    return j.agg(F.sum("chunks").alias("total"), F.coalesce(F.sum(F.when(same, F.col("chunks"))), F.lit(0)).alias("covered"), F.count(F.when(F.col("rows").isNull(), 1)).alias("missing"), F.count(F.when(~same, 1)).alias("changed"))


def verify_repair(before: DataFrame, after: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Rows whose fixed columns changed, whose text was repaired, and that stand on one side alone."""
    new = after.select(key, F.lit(True).alias("there_"), *(F.col(c).alias(f"{c}_") for c in [*fixed, "text"]))
    j = before.withColumn("here_", F.lit(True)).join(new, key, "full")
    both = F.col("here_").isNotNull() & F.col("there_").isNotNull()
    same = lambda c: F.col(c).eqNullSafe(F.col(f"{c}_"))
    changed = F.lit(False)
    for c in fixed:
        changed = changed | ~same(c)
    return j.agg(F.count(F.when(both & changed, 1)).alias("changed"), F.count(F.when(both & ~same("text"), 1)).alias("repaired"), F.count(F.when(~both, 1)).alias("missing"))


def calibrate(rows: DataFrame) -> DataFrame:
    """Ratios of actual to predicted for each file: in total, their upper median, lowest and highest."""
    r = rows.withColumn("ratio", F.col("actual") / F.col("predicted"))
    w = Window.partitionBy("file").orderBy("ratio")
    n = r.groupBy("file", "ratio").agg(F.count(F.lit(1)).alias("c"), F.sum("actual").alias("a"), F.sum("predicted").alias("p"))
    n = n.withColumns({"upto": F.sum("c").over(w), "total_": F.sum("c").over(Window.partitionBy("file"))})
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total_") / 2), F.col("ratio")))
    return n.groupBy("file").agg(F.round(F.sum("a") / F.sum("p"), 6).alias("total"), F.round(median, 6).alias("upper_median"), F.round(F.min("ratio"), 6).alias("lowest"), F.round(F.max("ratio"), 6).alias("highest"))


# Endings by which a word may differ from a keyword.
ENDINGS = ["s", "es", "ed", "d", "ing", "er", "ers"]


def token_match(t: Column, k: Column) -> Column:
    """Equal, or both of four letters or more and one is the other with a common ending."""
    longer = lambda a, b: F.startswith(a, b) & F.substr(a, F.length(b) + 1).isin(ENDINGS)
    return (t == k) | ((F.length(t) >= 4) & (F.length(k) >= 4) & (longer(t, k) | longer(k, t)))


#: Questions that are sent to all tasks.
ASKED = 10_000


def suggest(rows: DataFrame, asked: DataFrame, most: int = 3, least: float = 2.0) -> DataFrame:
    """query_id, id, score, place: rows (id, keywords, lang) that may answer a question (query_id, question), most each.

    A phrase found whole counts 2, with all its words 1.5, a single word 1, each times the mean weight of its words and
    1.25 in the question's language, else 0.85. Distinct keywords meet all questions, which are broadcast if they are
    ASKED at most; more are dealt out with the keywords.
    """
    q = asked.select("query_id", folded(F.col("question")).alias("q"), lang_votes(F.col("question")).alias("ql"))
    q = q.select("query_id", "q", "ql", content(F.split("q", " ")).alias("qt"))
    key = rows.select("id", "lang", F.explode(F.array_distinct(F.transform("keywords", folded))).alias("k")).select("id", "lang", "k", content(F.split("k", " ")).alias("kt")).where(F.size("kt") > 0)
    n = rows.agg(F.count(F.lit(1)).alias("N"))
    df = key.select("id", F.explode("kt").alias("w")).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weighed = key.select("k", "kt").distinct().select("k", F.explode("kt").alias("w")).join(df, "w").crossJoin(F.broadcast(n)).groupBy("k").agg(F.avg(1 + F.log(F.col("N") / F.col("df"))).alias("weight"))
    # distinct keywords meet the questions, then the rows that have them
    few = asked.limit(ASKED + 1).count() <= ASKED
    hits = key.select("k", "kt").distinct().crossJoin(F.broadcast(q) if few else q)
    whole = F.concat(F.lit(" "), F.col("q"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("k"), F.lit(" ")))
    every = F.forall("kt", lambda w: F.exists("qt", lambda t: token_match(t, w)))
    phrase = F.col("k").contains(" ")
    points = F.when(phrase & whole, 2.0).when(every, F.when(phrase, 1.5).otherwise(1.0))
    hits = hits.select("query_id", "ql", "k", points.alias("points")).where("points is not null").join(weighed, "k")
    scored = hits.join(key.select("id", "lang", "k"), "k").groupBy("query_id", "id", "lang", "ql").agg(F.sum(F.col("points") * F.col("weight")).alias("s"), F.count(F.lit(1)).alias("hits"))
    scored = scored.select("query_id", "id", "hits", F.round(F.col("s") * F.when(F.col("lang") == F.col("ql"), 1.25).when(F.col("lang").isin("mul", ""), 1.1).otherwise(0.85), 2).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hits"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def extrapolate(rows: DataFrame) -> DataFrame:
    """file, density (chunks a document), est_chunks: what all documents (chunks, seen) of a file have, if they are as those that were seen."""
    g = rows.groupBy("file").agg(F.sum(F.when(F.col("seen"), F.col("chunks"))).alias("c"), F.count(F.when(F.col("seen"), 1)).alias("n"), F.count(F.lit(1)).alias("every")).where("n > 0")
    return g.select("file", F.round(F.col("c") / F.col("n"), 6).alias("density"), F.round(F.col("c") * F.col("every") / F.col("n"), 3).alias("est_chunks"))


#: Order of states of rows that are offered.
OFFERED = ["amber", "grey", "red"]


def offered(scored: DataFrame, rows: DataFrame, most: int = 3, least: float = 2.0, share: float = 0.5) -> DataFrame:
    """query_id, id, score, place, fallback: what is offered to a question, of scores (query_id, ql, id, score, hits) and rows (id, state, bytes, lang, topics, suggest).

    Rows that are searchable already are never offered, but the best of them sets how much better others have to be. Where nothing is left and
    no searchable row comes up to the least score, the encyclopedia in the question's language is, if it isn't there yet.
    """
    s = scored.join(rows.where("suggest"), "id")
    best = s.where("state = 'green'").groupBy("query_id").agg(F.max("score").alias("covered"))
    s = s.where(F.col("state").isin(OFFERED)).join(best, "query_id", "left").where(F.col("score") >= F.greatest(F.lit(least), share * F.coalesce("covered", F.lit(0.0))))
    rank = F.array_position(F.array(*map(F.lit, OFFERED)), F.col("state"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hits"), rank, F.coalesce("bytes", F.lit(0)), "id")
    out = s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "id", "score", "place", F.lit(False).alias("fallback"))
    asked = scored.select("query_id", "ql").distinct().join(out.select("query_id").distinct(), "query_id", "left_anti").join(best, "query_id", "left").where(F.coalesce("covered", F.lit(0.0)) < least)
    book = rows.where(F.col("suggest") & F.col("state").isin(OFFERED) & (F.col("topics") == F.array(F.lit("reference")))).groupBy(F.col("lang").alias("ql")).agg(F.min("id").alias("id"))
    return out.unionByName(asked.join(book, "ql").select("query_id", "id", F.lit(0.0).alias("score"), F.lit(1).alias("place"), F.lit(True).alias("fallback")))


def wants_suggestion(grounding: Column, results: Column) -> Column:
    """Whether a question is offered books: nothing was found, or the answer doesn't stand on the library."""
    return (results == 0) | grounding.isin("unsourced", "uncovered", "model_only")


def with_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """The rows (id) with their topics, empty where a row has none."""
    return rows.join(topics, "id", "left").select("id", F.coalesce("topics", F.lit("")).alias("topics"), F.col("topics").isNotNull().alias("known"))


def newest_match(commits: DataFrame, by: str) -> DataFrame:
    """by, sha, exact: the newest commit (sha, day, matches, score) that matches, else the one with the best score."""
    hit = F.max_by("sha", F.when(F.col("matches"), F.struct("day", "sha")))
    near = F.max_by("sha", F.struct("score", -F.col("sha")))
    return commits.groupBy(by).agg(F.coalesce(hit, near).alias("sha"), F.max("matches").alias("exact"))


def library_faults(rows: DataFrame) -> DataFrame:
    """fault, what: keys of more than one book, paths that aren't absolute, and files that aren't there (name, key, path, there)."""
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("fault"), F.col("key").alias("what"))
    own = F.filter(F.array(F.when(~F.col("path").startswith("/"), "relative"), F.when(~F.col("there"), "gone")), lambda f: f.isNotNull())
    return twice.unionByName(rows.select(F.explode(own).alias("fault"), F.col("name").alias("what")))


#: Bytes of a vector in the retired store.
STORED = 4287


def store_size(chunks: Column, cap: Column, spec: Column, width: Column) -> tuple[Column, Column]:
    """Whether a store of whole vectors stays below a cap, and the bytes of a vector by the spec of its codes (PQ64, PQ32x4, or whole)."""
    parts, bits = F.regexp_extract(spec, r"PQ(\d+)(?:x(\d+))?$", 1), F.regexp_extract(spec, r"PQ(\d+)(?:x(\d+))?$", 2)
    coded = parts.try_cast("double") * F.coalesce(bits.try_cast("double"), F.lit(8.0)) / 8.0
    return chunks * STORED <= cap, F.coalesce(coded, width.cast("double") * 4)


def hours(rows: DataFrame, by: str, page: float, chunk: float) -> DataFrame:
    """by, hours: pages are charged where their number is known, else chunks."""
    cost = F.when(F.col("pages").isNotNull(), F.col("pages") * page).otherwise(F.col("chunks") * chunk)
    return rows.groupBy(by).agg(F.round(F.sum(cost) / 3600, 6).alias("hours"))


def tiles(topics: DataFrame) -> DataFrame:
    """topic and a line of its counts, for topics that have any."""
    some = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    return topics.where("green + amber > 0").select("topic", F.concat_ws(", ", some("green", "searchable"), some("amber", "browsable")).alias("line"))


def coverage_gaps(registry: DataFrame, stamp: DataFrame) -> DataFrame:
    """file, missing: whether an index lacks a file's rows, or has another number of them."""
    return registry.join(stamp, "file", "left").select("file", F.coalesce(F.col("rows") != F.col("chunks"), F.lit(True)).alias("missing"))
