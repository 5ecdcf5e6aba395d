"""Each stage of the pipeline on its own input."""

from collections import Counter

import corpus_pipeline
from quillstone.llm.common import shared_dir, staged

from .test_operators import brute_components, brute_hits, brute_repeats, check_packing, words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    where, columns = shared_dir(spark), docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = staged(stage(spark, docs, sf), f"{where}/{n}")
        if name == "best_fit_packing":
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            want = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
            assert check_packing(rows, want, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1
            break
        assert sorted(out.columns) == sorted(columns)
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            assert all(len(words(t)) >= 50 and before[i] == t for i, t in after.items()) and len(after) > len(before) / 2
        if name == "near_duplicates":
            assert set(after) == {i for i, x in brute_components(before, 5).items() if x[2]}
        if name == "repeated_passages":
            want = brute_repeats(before, 20)
            assert set(after) == set(before) and all(len(words(t)) == want[i][0] - want[i][1] for i, t in after.items())
        if name == "decontamination":
            assert set(after) == {i for i, x in brute_hits(before, items).items() if x[1] == 0}
        docs = out.select(*columns)


def test_odd_rows(spark, sf):
    """Nulls, empty texts, repeated rows and ids, and an empty table, through every stage."""
    some = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    long = next(r for r in some if len((r[1] or "").split()) > 200)
    words_ = long[1].split()
    other = " ".join(f"{w}{k}" for k, w in enumerate(words_[:120]))
    tail = " ".join(f"z{w}" for w in words_[:150]) + " " + " ".join(words_[40:100])
    odd = [(long[0], long[1], "en", "s", 1), (long[0], other, "en", "s", 1), (None, other + " x", None, None, None), (None, None, None, None, None), (7, "", "en", "s", 0), (9000, tail, "en", "s", 5), (9001, other, "en", "s", 5), (9001, other, "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(some + odd, schema)
    name, stage = corpus_pipeline.STAGES[1]
    kept = stage(spark, docs, sf).collect()
    # of the copies of other, the one with the least id stays; the two rows of one id that differ both do
    assert sum(r["text"] in (other, other + " x") for r in kept) == 1 and sum(r["doc_id"] == long[0] for r in kept) == 2
    cut = corpus_pipeline.STAGES[2][1](spark, docs, sf).collect()
    assert len(cut) == len(some) + len(odd)
    mine = [r for r in cut if r["doc_id"] == 9000][0]
    assert len(words(mine["text"])) < len(words(tail)) - 20 and mine["n_chars"] == len(mine["text"])
    assert {r["text"] for r in cut if r["doc_id"] is None} == {other + " x", None}
    left, empty = docs, docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, left, sf)
        assert stage(spark, empty, sf).count() == 0, name
        if name != "best_fit_packing":
            left = staged(rows, f"{shared_dir(spark)}/{name}")
    assert rows.select("doc_id").distinct().count() > 20
    n = corpus_pipeline.STAGES[3][1](spark, docs, sf).count()
    assert n == len(some) + len(odd) - sum(x[1] > 0 for x in brute_hits(dict(enumerate(r["text"] for r in docs.collect())), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]).values())


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
