"""Operators on small constructed cases."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import titles
from quillstone.operators import catalogue, chunking, corpus, evaluation, html, lexical, pages, pdf, places, quality, tiles, vectors
from quillstone.plans import registry
from quillstone.plans.runs import tile_of
from quillstone.sources import files, store, tables
from quillstone.streaming import ingest


def test_index_phrases_and_swap(spark):
    docs = spark.createDataFrame([(1, "Ñandú corre. Corre mucho"), (2, "the corre ñandu"), (3, None), (4, "naïve_x other words here that go on and on and on and on and on and on until naive again x")], "doc_id long, text string")
    path = store.scratch(spark, "index")
    lexical.build(docs, path)
    i = lexical.Index(spark, path)
    ask = lambda *t: {r["doc_id"] for r in lexical.bm25(i, spark.createDataFrame([(0, x) for x in t], "query_id int, term string"), 9).collect()}
    assert ask("nandu") == ask("ñandú") == {1, 2} and ask("nandu_corre") == {1} and ask("corre_nandu") == {2} and ask("naive_x") == {4} and ask("...") == set()
    q = spark.createDataFrame([(0, "naive"), (0, "again")], "query_id int, term string")
    snip = lexical.snippets(i, lexical.bm25(i, q, 3), q, docs, 4).collect()
    assert [r["snippet"] for r in snip] == ["naive again x"]
    lexical.build(docs.where("doc_id = 2"), path)  # another index in its place
    assert ask("nandu") == {2} and not store.exists(spark, f"{path}.building")


def test_sentences():
    t = "One two three. Four five! Six seven eight nine ten? " + "word " * 25 + "end."
    parts = chunking.sentences(t, 8, 3)
    assert parts[0] == "One two three. Four five!" and all(len(p.split()) <= 8 for p in parts)
    assert parts[1].startswith("Four five!") or parts[1].startswith("Six")
    assert [w for p in chunking.sentences(t, 8, 0) for w in p.split()] == t.split()
    assert chunking.sentences("", 8) == [] and chunking.sentences("  \n ", 8) == []
    assert chunking.located("aa bb aa bb", ["aa bb", "aa bb"]) == [0, 6] and chunking.located("abc", ["zzz", "c"]) == [0, 2]


def test_fallbacks(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None), (3, "")], "doc_id long, text string")

    def bad(text):
        raise RecursionError

    get = lambda a, b: [(r["doc_id"], r["status"], r["text"]) for r in chunking.with_fallback(docs, a, b).collect()]
    assert get(bad, chunking.windows) == [(1, "fallback", "x y")] and get(bad, bad) == [(1, "dropped", None)] and get(chunking.windows, bad) == [(1, "split", "x y")]


def test_pages(spark):
    rows = spark.createDataFrame([(1, 2, "bb"), (1, 1, "aaa"), (1, 3, None), (2, 1, "")], "d int, p int, text string")
    got = {r["d"]: r for r in pages.joined(rows, ["d"], "p").collect()}
    assert (got[1]["text"], got[1]["starts"], got[1]["pages"]) == ("aaa\nbb\n", [0, 4, 7], [1, 2, 3]) and got[2]["text"] == ""
    at = spark.range(1).select(*(pages.page_at(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(4)), F.lit(k)).alias(f"k{k}") for k in (0, 3, 4, 9))).first()
    assert tuple(at) == (1, 1, 2, 2)


def test_references(spark):
    said = ["see table A2 below", "see the table below", "as Figure 7-30 and by the way below", "Table B above. Table B: x", "chart and the figures following", None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", pages.reference(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["r"] and (r["r"]["label"], r["r"]["up"]) for r in rows] == [("A2", False), None, ("7-30", False), None, None, None]
    c = [("1:1:0", 1, 1, 0, "what table A2 above says"), ("1:1:1", 1, 1, 1, "Table A2 is here"), ("1:2:0", 1, 2, 0, "see table 13 below"), ("1:2:1", 1, 2, 1, "table 2013 only"), ("1:3:0", 1, 3, 0, "see table C1 below"), ("1:3:1", 1, 3, 1, "figure C1: x")]
    chunks = spark.createDataFrame(c, "cid string, src int, dnum int, i int, text string")
    shown = spark.createDataFrame([(0, 1, "1:1:0"), (0, 2, "1:2:0"), (0, 3, "1:3:0")], "query_id int, rank int, cid string")
    got = [(r["rank"], r["cid"]) for r in pages.expand(shown, chunks).orderBy("rank").collect()]
    assert got == [(1.0, "1:1:0"), (1.5, "1:1:1"), (2.0, "1:2:0"), (3.0, "1:3:0"), (3.5, "1:3:1")]
    assert pages.expand(shown, chunks, 1).count() == 4


def test_pdf_tables(spark):
    assert pdf.table_text([["WATER", ""], ["1 l", "2 drops"], ["5 l", ""]]) == "Table (WATER). 1 l: 2 drops. 5 l."
    assert pdf.table_text([["a", "b", "c"], ["1", "2", "3"]]) == "Table:\n| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |"
    assert pdf.table_text([["1", "", "3"], ["4", "5", "6"]], ["x", "y", "z"], True).splitlines()[1:3] == ["| x | y | z |", "|---|---|---|"]
    assert pdf.table_text([["a run of names", "", ""], ["1", "2", "3"]]).startswith("Table (a run of names):\n| 1 |") and pdf.table_text([["a", ""]]) is None
    cells = spark.createDataFrame([(0, "wa\u00ad ter  x\u00ad"), (1, None)], "i int, c string").select("i", pdf.cleaned(F.col("c")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in cells] == ["water x", ""]
    rows = spark.createDataFrame([(1, [["", "", ""], ["a", "", "b b"], ["c", None, "d"]], 0.5), (2, [["", ""]], 0.5), (3, [["x"]], 0.5), (4, [["cap", ""], ["k", "v"], ["l", "w"]], 0.5), (5, [["k", "v"], ["l", "w"]], 0.1)], "id int, rows array<array<string>>, width double")
    got = {r["id"]: (r["why"], r["text"]) for r in pdf.tables(rows).collect()}
    assert got == {1: ("", "Table. a: b b. c: d."), 2: ("empty", None), 3: ("caption only", None), 4: ("", "Table (cap). k: v. l: w."), 5: ("sliver of a page", None)}


def test_revisions(spark):
    old = spark.createDataFrame([("a", "same"), ("b", "a long text that is nearly the same"), ("c", "abc"), ("d", "gone")], "path string, text string")
    new = spark.createDataFrame([("a", "same"), ("b", "a long text that is nearly the same!"), ("c", "xyz"), ("e", "new")], "path string, text string")
    assert {r["path"]: r["state"] for r in evaluation.revisions(old, new).collect()} == {"a": "identical", "b": "near", "c": "differs", "d": "gone", "e": "new"}


def test_offers(spark):
    rows = spark.createDataFrame([(1, "green", 5, "en", ["x"], True), (2, "grey", None, "en", ["x"], True), (3, "amber", 9, "en", ["x"], True), (4, "red", 1, "es", ["reference"], True), (5, "grey", 1, "en", ["reference"], False)], "id int, state string, bytes long, lang string, topics array<string>, suggest boolean")
    scored = spark.createDataFrame([(0, "en", 1, 9.0, 1), (0, "en", 2, 4.0, 1), (0, "en", 3, 5.0, 1), (1, "en", 2, 3.0, 1), (1, "en", 3, 3.0, 1), (2, "es", 2, 1.0, 1), (3, "es", 1, 2.5, 1)], "query_id int, ql string, id int, score double, hits int")
    got = sorted((r["query_id"], r["place"], r["id"], r["fallback"]) for r in corpus.offered(scored, rows).collect())
    # 9.0 is covered already, so 4.0 is too little; what is on the drive is first; the encyclopedia only where nothing else is and nothing is covered
    assert got == [(0, 1, 3, False), (1, 1, 3, False), (1, 2, 2, False), (2, 1, 4, True)]


def test_catalogue_rules(spark):
    rows = [("https://huggingface.co/a/b", "m/", "PINNED COMMIT " + "a" * 40), ("https://huggingface.co/a/b/", "m.gguf", ""), ("https://github.com/a/b/releases/tag/v1", "t.zip", None), ("https://x.org/t.zip extra", "t.zip", ""), ("https://x.org/other.zip", "t.zip", ""), ("https://x.org/page", "t.zip", ""), ("by mail", "t.zip", ""), (None, "t.zip", None)]
    got = [tuple(r["f"]) for r in spark.createDataFrame(rows, "u string, n string, t string").select(catalogue.fetch_of(F.col("u"), F.col("n"), F.col("t")).alias("f")).collect()]
    assert [g[0] for g in got] == ["hf-repo", "hf-file", "github-asset", "direct", "direct", "manual", "manual", "manual"]
    assert got[0][2] == "a" * 40 and got[1][1].endswith("/a/b/resolve/main/m.gguf") and got[2][1].endswith("/a/b/releases/download/v1/t.zip") and got[3][1] == "https://x.org/t.zip"
    inside = spark.createDataFrame([("lib/a",), ("lib/../lib/b",), ("../lib",), ("library",), ("lib",), ("lib/..",), ("x/..//lib/./c",)], "p string").select(catalogue.contained(F.col("p"), F.lit("lib")).alias("x")).collect()
    assert [r["x"] for r in inside] == [True, True, False, False, True, False, True]


def test_readers_and_sinks(spark):
    assert files.library_books(spark, store.scratch(spark, "none")) is None
    c = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "src int, cid string, text string")
    with pytest.raises(Exception, match="no row"):
        tables.fetch(c, spark.createDataFrame([("z",)], "cid string"), "cid").collect()
    new = spark.createDataFrame([(2, "q"), (2, "r")], "id int, v string")
    assert tables.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), new, "id").count() == 2
    assert [r["n"] for r in vectors.numbered(spark.createDataFrame([(k,) for k in (5, 3, 9, 7, 1)], "k int").repartition(3), ["k"], "n").orderBy("k").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="no row"):
        vectors.gather(spark.createDataFrame([(0, "a")], "row long, v string"), spark.createDataFrame([(5,)], "row long")).collect()
    kept, stats = html.entries(spark.createDataFrame([(1, "<p>" + "word " * 30), (2, "<p>x"), (3, None)], "page_id long, html string"))
    assert [r["page_id"] for r in kept.collect()] == [1] and tuple(stats.first()) == (3, 1, 2)


def test_tiles(spark):
    import gzip

    data = tile_of([{"name": "A", "population_rank": 3}, {"name": "B", "kind": "x"}, {"kind": "y"}], [(2048, 2048), (10, 4000), (1, 1)])
    assert [(a.get("name"), x, y) for a, x, y, _ in tiles.points(gzip.compress(data), "places")] == [("A", 2048, 2048), ("B", 10, 4000), (None, 1, 1)]
    assert tiles.points(data, "roads") == [] and tiles.points(b"", "places") == []
    with pytest.raises(ValueError):
        tiles.points(data[:-3], "places")
    got = {r["name"]: r for r in tiles.places_in(spark.createDataFrame([(0, 0, 0, data), (1, 0, 0, None)], "z int, x long, y long, data binary")).collect()}
    assert set(got) == {"A", "B"} and (got["A"]["lon"], round(got["A"]["lat"], 9), got["A"]["poprank"]) == (0.0, 0.0, 3) and got["B"]["lat"] < -80


def test_small_rules(spark):
    rows = [("How do I keep water for a year? - Shop", "Shop"), ("What is it?", "x"), ("Welcome to the index of all things?", "x")]
    assert [r["q"] for r in spark.createDataFrame(rows, "t string, b string").select(titles.question(F.col("t"), F.col("b")).alias("q")).collect()] == ["How do I keep water for a year?", None, None]
    words = [r["w"] for r in spark.createDataFrame([("a b",), ("it's",), ("plain-1",), ("",)], "t string").select(titles.shell_word(F.col("t")).alias("w")).collect()]
    assert words == ["'a b'", "'it'\"'\"'s'", "plain-1", "''"]
    p = quality.percentiles(spark.createDataFrame([("a", v) for v in (1, 1, 2, 9)] + [("b", 5)], "k string, v int"), "k", "v", {"p50": 0.5, "p100": 1.0})
    assert {r["k"]: (r["p50"], r["p100"]) for r in p.collect()} == {"a": (2, 9), "b": (5, 5)}


def test_streams(spark):
    incoming, path, check = (store.scratch(spark, n) for n in ("incoming", "chunks", "checkpoint"))
    schema = "src int, cid string, text string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(incoming)
    run = lambda: ingest.ingest_chunks(spark, incoming, path, check, schema).awaitTermination(120)
    put((1, "a", "x"), (2, "b", "y"))
    run()
    put((1, "a", "z"), (1, "c", "w"))
    run()
    run()  # nothing new
    assert sorted((r["src"], r["cid"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "a", "z"), (1, "c", "w"), (2, "b", "y")]
    events = spark.createDataFrame([("j", "running", "2024-01-01 00:01:00"), ("j", "cancelled", "2024-01-01 00:02:00"), ("j", "done", "2024-01-01 00:03:00"), ("k", "queued", "2024-01-01 00:01:00")], "job string, state string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["job"]: r["state"] for r in ingest.job_states(events).collect()} == {"j": "cancelled", "k": "queued"}


def test_statuses_of_every_row(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, None), (3, ""), (4, " \n "), (None, "z")], "doc_id long, text string")

    def bad(text):
        raise RecursionError

    get = lambda a, b: sorted((r["doc_id"] or 0, r["status"], r["n"]) for r in chunking.statuses(docs, a, b).collect())
    assert get(chunking.windows, bad) == [(0, "split", 1), (1, "split", 1), (1, "split", 1), (2, "split", 0), (3, "split", 0), (4, "split", 0)]
    assert {(s, n) for _, s, n in get(bad, bad)} == {("dropped", 0)} and len(get(bad, chunking.windows)) == 6


def test_fallback_query_counts_rows(spark, tmp_path):
    # empty and null texts, texts of white space and ids that occur again are rows of the SQL
    rows = [(5, ""), (5, "a"), (3, None), (3, " "), (3, "b"), (1, "c"), (1, "c"), (2, " \n"), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["status"]: r["n"] for r in registry.queries()["C3_fallback"](spark, f"file://{tmp_path}").collect()}
    assert got == {"dropped": 2, "fallback": 3, "split": 4}


def test_human_size_rounds_as_sql(spark):
    # ties go to the even digit, and what is printed is the exact value of the double, not its shortest decimal
    at = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.65, 0.75, 0.95, 0.96, 1.25, 11.25, 999.95, 1023.95, 1023.96, -0.25, -0.35, 1e15 + 0.25]
    rows = spark.createDataFrame([(i, x * 1024) for i, x in enumerate(at)] + [(-1, None)], "i int, n double")
    got = {r["i"]: (r["a"], r["s"]) for r in rows.select("i", T.one_decimal(F.col("n") / 1024).alias("a"), T.human_size(F.col("n")).alias("s")).collect()}
    assert [got[i][0] for i in range(len(at))] == [f"{x:.1f}" for x in at] and got[-1] == (None, None)
    assert (got[11][1], got[13][1], got[14][1]) == ("11.2 KB", "1024.0 KB", "1024.0 KB")


def test_nearest_names_meet_by_positions(spark):
    # many points and rows at one position: 500 x 2000 pairs would meet by rows, 1 x 2 do by positions
    at = spark.range(500).select(F.col("id").alias("s"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    named = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("norm"), F.lit(1.0).alias("lat"), F.lit(2.1).alias("lon"))
    near = places.nearest_names(at, named, 50.0, "s", "k")
    got = near.collect()
    assert len(got) == 1000 and {(r["norm"], r["k"]) for r in got} == {("a", 0), (None, 1)} and {round(r["km"], 3) for r in got} == {11.118}
    # equal distances go by id, and a key at two positions has the nearest of both
    at = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 1.0), (2, None, 0.0)], "s int, lat double, lon double")
    named = spark.createDataFrame([(9, "x", 0.0, 0.1), (8, "x", 0.1, 0.0), (7, "x", 0.0, 1.05), (6, "x", None, 0.0)], "k int, norm string, lat double, lon double")
    assert [(r["s"], r["k"]) for r in places.nearest_names(at, named, 50.0, "s", "k").collect()] == [(1, 7)]


def test_mirror_set_compares_few(spark, monkeypatch):
    # one path of 200 rows on each side: not all 40,000 pairs are compared
    words = lambda i: [f"w{i}x{j}" for j in range(300)]
    text = lambda i, gone=(): " ".join(["one opening that all of them share"] + [w for j, w in enumerate(words(i)) if j not in gone])
    mine = [(i, "p", text(i)) for i in range(200)] + [(900, "p", "a b"), (901, "p", "a c"), (902, "q", text(7)), (903, None, text(7)), (904, "p", None), (905, "p", text(5, {299}))]
    # 3 follows in full with more words; of 4 a word at the end lacks (1 of 303 runs), of 6 one within (5 of 303)
    theirs = [(i, "p", text(1000 + i)) for i in range(195)] + [(500, "p", text(3) + " and more"), (501, "p", text(4, {299})), (502, "p", text(6, {100})), (503, "p", "a b"), (504, "p", text(5))]
    seen, plain = [], evaluation.pair_coverage
    monkeypatch.setattr(evaluation, "pair_coverage", lambda pairs: (seen.append(pairs.count()), plain(pairs))[1])
    schema = "id long, path string, text string"
    a, b = spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema)
    got = {r["mine"]: r["coverage"] for r in evaluation.mirror_set(a, b).collect()}
    assert got == {3: 1.0, 4: round(302 / 303, 6), 5: 1.0, 900: 1.0, 905: 1.0} and sum(seen) < 50
    low = {r["mine"]: r["coverage"] for r in evaluation.mirror_set(a, b, 0.95).collect()}
    assert low == got | {6: round(298 / 303, 6)}


def test_index_deals_common_words(spark, monkeypatch):
    # a word that all documents have is dealt out by their keys; rows of one key are one document; a document may have more words than a step
    monkeypatch.setattr(lexical, "WORDS", 7)
    texts = ["the a the", "the", "", None, "the b of the the of the b b b b b b b"] + ["the x"] * 395
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "more the of"), (None, "the of")]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        path = store.scratch(spark, "index")
        lexical.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    i = lexical.Index(spark, path)
    files = i.postings.where("term = 'the'").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1
    got = {(r["term"], r["key"]): (r["tf"], r["places"]) for r in i.postings.collect()}
    assert got[("the", 0)] == (2, [0, 2]) and got[("the", 4)] == (4, [0, 3, 4, 6]) and got[("b", 4)][0] == 8 and got[("of", None)] == (1, [1])
    assert got[("the", 1)] == (2, [0, 1]) and got[("of", 1)] == (1, [2])
    n = sum(len((t or "").split()) for _, t in rows)
    assert i.totals.first().asDict() == {"N": 402, "avgdl": n / 402, "stamp": ""}
    asked = spark.createDataFrame([(0, "of_the"), (1, "the_the"), (2, "the_of_the")], "query_id int, term string")
    assert sorted((r["query_id"], r["doc_id"]) for r in lexical.scored(i, asked).where("doc_id <> 1").collect()) == [(0, 4), (1, 4), (2, 4)]


def test_phrases_are_not_ranked(spark, sf):
    # no window puts all hits of a query in one task
    plan = lambda q: registry.queries()[q](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan("L4_phrase") and plan("L7_keyword_scoped").count("Window [") == 1


def test_shared_paths_in_squares(spark, monkeypatch):
    monkeypatch.setattr(quality, "SIDE", 10)
    mine = [(i, 0, "p") for i in range(95)] + [(200, 0, "q"), (201, 0, None), (202, 0, "r"), (5, 2, "p")]
    theirs = [(1000 + i, 1, "p") for i in range(45)] + [(2000, 1, "q"), (2001, 1, None), (2002, 1, "s")]
    make = lambda rows: spark.createDataFrame(rows + rows[:3], "doc_id long, src int, path string")
    pairs = quality.shared_paths(make(mine), make(theirs), "doc_id")
    got = sorted((r["mine"], r["theirs"]) for r in pairs.collect())
    # rows that are equal count once; a key of two artifacts counts for each
    assert got == sorted([(i, 1000 + j) for i in [*range(95), 5] for j in range(45)] + [(200, 2000)])
    # the pairs of the common path don't meet by the path alone
    assert "[path" in (plan := pairs._jdf.queryExecution().optimizedPlan().toString()) and any(" i#" in line and " j#" in line for line in plan.splitlines() if "Join Inner" in line)


def test_neighbours_across_blocks(spark):
    # pairs at the edge of a block, below zero, of ids that occur again, without text, with gaps
    text = lambda i: " ".join(f"w{j}" for j in range(i % 5, 12)) + " x\ty"
    rows = [(i, text(i)) for i in [*range(-66, -60), -1, 0, 1, *range(60, 70), 127, 128, 128, 500]] + [(2, None), (129, "a b"), (None, "w0 w1 w2 w3 w4 w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in quality.neighbours(docs).collect())
    s = docs.where("doc_id is not null").select("doc_id", F.coalesce(T.shingles(F.coalesce("text", F.lit(""))), F.array()).alias("s"))
    o = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    want = s.join(o, "doc_id").select("doc_id", F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t")).collect()
    assert got == sorted(tuple(r) for r in want) and len(got) > 15
    # a text goes through one exchange, and its runs through none
    plan = quality.neighbours(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
