"""Every query with a DuckDB twin against it, and the operators on constructed cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import figures
from quillstone.functions import text as T
from quillstone.operators import chunking, corpus, html, places, quality, retrieval, safety, vectors
from quillstone.plans import registry
from quillstone.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([r.asDict() for r in df.collect()], columns) == plain([dict(zip(columns, r, strict=True)) for r in got.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_windows():
    assert chunking.windows("") == [] and chunking.windows("x" * 1024) == ["x" * 1024]
    assert [len(p) for p in chunking.windows("y" * 2500)] == [1024, 1024, 452]
    text = ("word " * 500).strip()
    assert " ".join(chunking.windows(text)) == text and all(len(p) <= 1024 for p in chunking.windows(text))


def test_html():
    # a tag parts words, entities are decoded twice, a run of prose is one line
    text, title = html.plain("<title>A &amp;amp; b</title><script>x()</script><p>One<b>two</b> [12]</p><div>&lt;3<footer>gone")
    assert title == "A & b" and text == "A & b One two <3"
    assert html.plain("") == ("", "")


def test_html_tables():
    pairs = "<p>x</p><table><caption>Doses</caption><tr><th>Age</th><th>mg</th></tr><tr><td>1</td><td>5</td></tr><tr><td>2</td></tr></table>after"
    assert html.plain(pairs)[0] == "x\nTable (Doses). Age: mg. 1: 5. 2.\nafter"
    wide = "<table><tr><th>a<th>b<th>c<tr><td>1<td>2<td>3</table>"
    assert html.plain(wide)[0] == "Table:\n| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |"
    assert html.plain(f"<table><tr><td>{wide}</td></tr></table> t")[0] == "a b c 1 2 3\nt"  # a table that holds a table is layout
    assert html.plain("<table><tr><td>one</td></tr></table>")[0] == "one"
    cells = [["h", "i", "j"]] + [["", "", "x"]] * 60
    assert html.render(cells, True) is None and html.render([["a"] * 13] * 2, False) is None and html.render([["a" * 401, "b"]] * 2, False) is None


def test_html_furniture():
    page = "<div class='x navbox'><div>q</div>r</div>z<!-- htdig_noindex -->no<!-- /htdig_noindex --> <ol class=references><li>s</ol> end <div id=catlinks>open"
    assert html.plain(page)[0] == "z end" and html.plain(page, strip=False)[0] == "q r zno s end open"


def test_filter_reasons(spark):
    rows = [(1, d, i, f"1:{d}:{i}", t) for d, i, t in [(1, 0, "menu"), (1, 1, "same words"), (2, 0, "menu"), (2, 1, "same  words"), (3, 0, "menu")]]
    got = {r["cid"]: r["reason"] for r in quality.filter_reasons(spark.createDataFrame(rows, "src int, dnum long, i long, cid string, text string"), 3).collect()}
    assert got == {"1:1:0": "boiler", "1:2:0": "boiler", "1:3:0": "boiler", "1:1:1": None, "1:2:1": "dup"}


def test_containment_of_itself(spark, sf):
    d = tables.table(spark, sf, "documents").where("doc_id < 20").select(F.col("doc_id").alias("id"), "text")
    same = quality.containment(d, d).where("a = b")
    assert {r["coverage"] for r in same.collect()} == {1.0}


def test_fusion_ties(spark):
    lists = [spark.createDataFrame(x, "query_id int, id string, rank int") for x in ([(0, "a", 1), (0, "b", 2)], [(0, "c", 1), (0, "b", 2)])]
    got = retrieval.fuse(*lists).orderBy("rank").collect()
    assert [(r["id"], r["origin"]) for r in got] == [("b", "both"), ("a", "dense"), ("c", "keyword")]


def test_text_rules(spark):
    row = spark.range(1).select(
        T.query_terms(F.lit("What is the dose, for a child?")).alias("q"), T.query_terms(F.lit("the of")).alias("only"), T.query_terms(F.lit("?")).alias("none"),
        T.is_navigation(F.lit("Tags: x"), F.lit(""), F.lit("")).alias("nav"), T.dehyphenated(F.lit("wa­\nter­ 1")).alias("d"),
        F.round(T.haversine_km(F.lit(0.0), F.lit(179.5), F.lit(0.0), F.lit(-179.5)), 1).alias("km"), T.grounding(F.lit("x [2]"), F.lit(1)).alias("g"),
    ).first()
    assert row["q"] == '"dose" OR "child"' and row["only"] == '"the" OR "of"' and row["none"] is None
    assert row["nav"] and row["d"] == "water 1" and row["km"] == 111.2 and row["g"] == "model_only"


def test_readers(spark, tmp_path):
    (tmp_path / "sums").write_text("a" * 64 + "  ./x y.zim\n" + "B" * 64 + " *z\nbad\n")
    (tmp_path / "scope").write_text("# all\none # more\n\n two\n")
    assert sorted(map(tuple, tables.read_checksums(spark, str(tmp_path / "sums")).collect())) == [("a" * 64, "x y.zim"), ("b" * 64, "z")]
    assert [r[0] for r in tables.read_scope(spark, str(tmp_path / "scope")).collect()] == ["one", "two"]
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(a, b, "id").collect())) == [(1, "a"), (2, "c")]


def of_texts(spark, expression, *texts):
    """An expression of a column t (or a and b) over texts (or pairs of them)."""
    pairs = [t if isinstance(t, tuple) else (t, None) for t in texts]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(pairs)], "i int, a string, b string")
    return [r["x"] for r in rows.select("i", expression(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


def test_findings(spark):
    long = ["5 mg/kg mg 12 V battery 10 to 15 PSI every 6 hours", "é" * 50 + " 3 ml dose " + "x" * 10_000]
    texts = ["500 mg/kg every 8 hours", "2 tablets", "a dose of 2 tablets", "11 pounds of it", "11 pounds pressure", "in standard 5 V mistake", "an LM317T regulator, COVID19 model", "smiles inchi kegg 5 mg", None, "", "Take two cc by oral infusion, 3 mg/L cada 8 horas", "12 Nm 5 MA 7 mA 1 000 psi", "M8 bolt 5 kg dose", *long]
    found = of_texts(spark, lambda a, b: figures.scan(a), *texts)
    kinds = [[(f["term"], f["category"], f["tier"]) for f in x] for x in found]
    assert kinds[:10] == [
        [("500 mg/kg", "dose", "hard"), ("every 8 hours", "dose", "hard")], [], [("2 tablets", "dose", "lifted")], [], [("11 pounds", "pressure", "lifted")], [],
        [("LM317T", "part_number", "soft")], [], [], [],
    ]
    # the first category of hard units has the number, cased units are read as they stand
    assert kinds[10] == [("two cc", "dose", "lifted"), ("3 mg", "dose", "hard"), ("cada 8 horas", "dose", "hard")]
    assert kinds[11] == [("12 Nm", "torque_tolerance", "hard"), ("7 mA", "electrical", "hard"), ("1 000 psi", "pressure", "hard")]
    assert kinds[12] == [("M8", "part_number", "soft"), ("5 kg", "dose", "lifted")]
    for t, x in zip(texts, found, strict=True):
        assert all(t[f["at"] : f["until"]] == f["term"] for f in x) and all(a["until"] <= b["at"] for a, b in zip(x, x[1:], strict=False))
    assert all(found[-2:])
    judged = of_texts(spark, figures.assess, ("none", "what dose for a child"), ("5 mg", None), (None, None), ("5 mg 5 MG 6 mg", "a fuse of 3 psi"))
    assert [j["level"] for j in judged] == ["possible", "present", "none", "present"]
    assert judged[3]["terms"] == ["5 mg", "6 mg", "3 psi"] and judged[3]["categories"] == ["dose", "electrical", "pressure"]


def test_compare(spark):
    absent, mark = "NOT IN ARCHIVE", "UNSOURCED - NOT FROM THE ARCHIVE"
    cases = [
        (("10 mg per kilogram of body weight", "around 10 mg/kg per dose"), "agree"), (("500 mg every 8 hours", "250 mg every 8 hours"), "disagree"),
        ((absent, absent), "both_unsupported"), ((absent, "yes"), "disagree"), ((f"{absent}\n{mark} 5 mg", absent), "one_declined"),
        ((f"{absent} {mark} 5 mg", f"{absent} {mark} 5 mg"), "agree_unsourced"), ((f"{absent} {mark} 5 mg", f"{absent} {mark} 6 mg"), "disagree_unsourced"), ((f"{absent} {mark} a", f"{absent} {mark} b"), "no_basis_unsourced"),
        (("", ""), "no_basis"), ((None, "word"), "no_basis"), (("green apples fall", "apples fall green today"), "agree"),
    ]
    assert of_texts(spark, figures.compare, *(c[0] for c in cases)) == [c[1] for c in cases]


def test_safety_tables(spark):
    rows = spark.createDataFrame([(1, "a", "5 mg and 6 mg"), (2, "a", None), (3, "b", "")], "id long, source string, text string")
    found = safety.findings(rows, "id")
    assert sorted(r["term"] for r in found.collect()) == ["5 mg", "6 mg"]
    assert sorted(map(tuple, safety.rates(found, rows, "id", "source").collect()), key=repr) == [("a", "dose", 1, 0.5), ("b", None, 0, 0.0)]


def test_page_walk(spark):
    # 3 repeats 1's text, so 4 of the same document still stands; 5 repeats 1's document
    rows = [(0, 1, 1, 1, "x", None, False), (0, 2, 1, 2, "y", "mirror", False), (0, 3, 1, 3, "x", None, False), (0, 4, 1, 3, "z", None, False), (0, 5, 1, 1, "w", None, False), (0, 6, 1, 6, "n", None, True), (0, 7, 1, 7, "v", None, False), (0, 8, 1, 8, "u", None, False)]
    pool = spark.createDataFrame(rows, "query_id int, rank int, src int, dnum int, text_key string, reason string, navigation boolean")
    got = [r["outcome"] for r in retrieval.page(pool, 3).orderBy("rank").collect()]
    assert got == ["kept", "mirror", "same_text", "kept", "same_document", "navigation", "kept", "beyond"]


def test_search_by_codes(spark, sf):
    v = tables.table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.exact_topk(v, q, 10).collect()}
    for i in (0, 20):
        assert {b for a, b in exact if a == i} == set(sorted(rows, key=lambda j: (-round(float(rows[i] @ rows[j]), 6), j))[:10])
    got = {(r["query_id"], r["vec_id"]) for r in vectors.pq_search(v, q, 10).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert vectors.topk(none, none, 3).count() == 0


def test_places_and_suggestions(spark):
    at = spark.createDataFrame([(1, 0.0, 179.9), (2, 50.0, 0.0)], "s int, lat double, lon double")
    named = spark.createDataFrame([(7, 0.1, -179.9), (8, 51.0, 0.0), (9, 50.1, 0.1)], "k int, lat double, lon double")
    assert sorted((r["s"], r["k"]) for r in places.within(at, named, 30.0).collect()) == [(1, 7), (2, 9)]
    rows = spark.createDataFrame([(1, ["first aid"], "en"), (2, ["burn", "aid"], "en"), (3, ["quemadura"], "es"), (4, ["who was"], "en")], "id int, keywords array<string>, lang string")
    asked = spark.createDataFrame([(0, "first aid for burns"), (1, "who was it")], "query_id int, question string")
    got = corpus.suggest(rows, asked).collect()
    # equal scores: the row that matched more keywords is first
    assert [(r["query_id"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == [(0, 2), (0, 1)]


def test_search_holds_few_hits(spark, monkeypatch):
    # many blocks of both sides, a task that may hold one block of queries, ids that occur again: the same rows as all scores in order
    rng = np.random.default_rng(5)
    rows = [(int(i % 90), [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 4 = 0")
    seen, best = [], vectors.best
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    for held in (1, 60, 10**6):
        monkeypatch.setattr(vectors, "HELD", held)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.topk(v, q, 3).collect())
        seen.append(got)
    want = []
    for i in {a for a, _ in rows if a % 4 == 0}:
        every = sorted(((-round(float(np.dot(x, y)), 6), b) for a, x in rows if a == i for b, y in rows))[:3]
        want += [(i, r, b, -s) for r, (s, b) in enumerate(every, 1)]
    assert seen[0] == sorted(want) and seen[1] == seen[0] and seen[2] == seen[0] and best is vectors.best


def test_search_takes_pairs_one_by_one(spark, sf):
    # blocks are read from the shared folder: none is made anew for each pair of partitions, whose workers would hold them
    v = tables.table(spark, sf, "embeddings").repartition(4)
    plan = vectors.topk(v, v.where("vec_id % 20 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
