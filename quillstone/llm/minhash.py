"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

A table's key is a pair (A_i, B_j) of collisions from two small collections of SIDE members each, every
member HALF minhashes; so SIDE * SIDE tables need 2 * SIDE * HALF minhashes, about their square root.
At the least similarity 0.8 a pair is missed with a chance below 2 * (1 - 0.8**3)**16 = 2.1e-5.

1. Each document's set, its 64-bit sum and the members' hashes come from one scan. Documents with equal sets
   are one class from here on, so thousands of copies weigh as one.
2. A class looks up its A members; those that no other class has are dropped before the pairs are formed.
3. Classes that share a table key are joined by a forest over their A member's classes (no pairs within a
   key); its edges are contracted to about one a class, and components of this graph hold every link that the
   tables can find.
4. In each such component links are found exactly, on full sets: a search from class to class compares the
   class at hand, through an inverted index, with those that aren't reached yet; it ends once all are reached.
   Components of more than LARGE shingles are searched in rounds over the cluster, HUBS classes at a time.

A null or empty text has no shingles, is linked with nothing and kept. Fewer words than a shingle are one
shingle. doc_id null: the row takes part, its component is the least id that isn't null, or null. Rows of one
doc_id are documents of their own if their texts differ. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, arrow_texts, grams, mix, shared_dir, shuffle_parts, slices, staged, table
from .tok import release

HALF, SIDE = 3, 16
#: Classes of one A member beyond which they are dealt out by whole table keys.
HOT = 20_000
#: Shingles of a component that one task searches; larger ones go over the cluster.
LARGE = 4_000_000
#: Classes, and shingles in all, that are sent to every task in one round over the cluster.
HUBS, HUB_SHINGLES = 64, 1_000_000
_SEEDS = np.random.default_rng(7).integers(1, 2**63, 2 * SIDE * HALF, dtype=np.uint64)
NULL_ID = (1 << 63) - 1


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    w = Words(texts, SPACE, lower=True)
    g, out = grams(w.hash, k), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(grams(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_sum(s: np.ndarray) -> int:
    """A 64-bit sum of a set, 0 for the empty one, as a signed number."""
    with np.errstate(over="ignore"):
        x = mix(np.array([np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s))])) if len(s) else np.zeros(1, np.uint64)
    return int(x.view(np.int64)[0])


def members(s: np.ndarray) -> np.ndarray:
    """Hashes of the 2 * SIDE members of a set's collections."""
    low = np.empty(len(_SEEDS), np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096, None] ^ _SEEDS
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(29)
        part *= np.uint64(0x94D049BB133111EB)
        m = part.min(axis=0)
        low = m if i == 0 else np.minimum(low, m)
    h = low.reshape(2 * SIDE, HALF)
    out = np.arange(1, 2 * SIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(HALF):
        out = mix(out ^ h[:, j])
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), cls (the set's sum), a and b: members of both collections."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, j in slices(batch.column("text")):
                sets = shingle_sets(arrow_texts(batch.column("text").slice(i, j - i)), k)
                sums, both = [set_sum(s) for s in sets], []
                for s, c in zip(sets, sums, strict=True):
                    if c not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[c] = members(s).view(np.int64) if len(s) else np.zeros(2 * SIDE, np.int64)
                    both.append(known[c])
                flat = np.concatenate(both) if both else np.zeros(0, np.int64)
                m = flat.reshape(-1, 2 * SIDE)
                at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SIDE)
                lists = lambda x, at=at: pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(list(map(len, sets)), pa.int64()), pa.array(sums, pa.int64()), lists(m[:, :SIDE]), lists(m[:, SIDE:])], ["doc_id", "n", "cls", "a", "b"])

    return docs.mapInArrow(rows, "doc_id long, n long, cls long, a array<long>, b array<long>")


def least_labels(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row the least row that shares a key with it, directly or by others, in the same group.

    keys: rows x SIDE, each column a collection of its own.
    """
    label = np.arange(len(group))
    orders = []
    for j in range(keys.shape[1]):
        order = np.lexsort((keys[:, j], group))
        new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (keys[order, j][1:] != keys[order, j][:-1])])
        orders.append((order, np.flatnonzero(new), np.cumsum(new) - 1))
    while True:
        before = label.copy()
        for order, starts, run in orders:
            label[order] = np.minimum.reduceat(label[order], starts)[run]
        if (label == before).all():
            return label


def candidate_edges(classes: DataFrame, where: str, hot: int = HOT) -> DataFrame:
    """u, v: classes that share a table key, as a forest over each A member's classes (no pairs within a key).

    An A member's classes meet in one task with their B members, unless more than hot classes have it: those
    are dealt out by the whole table key, and each goes to the first class of the key.
    """
    parts = shuffle_parts(classes.sparkSession)
    a = classes.select("cls", F.explode("a").alias("x"))
    shared = a.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    live = staged(a.join(shared, "x").groupBy("cls").agg(F.collect_list(F.struct("x", "c")).alias("xs")), f"{where}/live")
    rows = live.join(classes.select("cls", "b"), "cls").select("cls", F.explode("xs").alias("s"), "b").select("cls", "s.x", "s.c", "b")

    def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            x, cls = b.column("x").to_numpy(), b.column("cls").to_numpy()
            keys = b.column("b").flatten().to_numpy().reshape(len(x), -1)
            if not len(x):
                continue
            held.append((x, cls, keys))
            if sum(len(h[0]) for h in held) < 20_000:
                continue
            x, cls, keys = (np.concatenate(p) for p in zip(*held, strict=True))
            cut = int(np.searchsorted(x, x[-1], "left"))  # the last member may go on
            if cut:
                label = least_labels(x[:cut], keys[:cut])
                some = label != np.arange(cut)
                yield edges(cls[:cut][some], cls[label[some]])
            held = [(x[cut:], cls[cut:], keys[cut:])]
        if held:
            x, cls, keys = (np.concatenate(p) for p in zip(*held, strict=True))
            label = least_labels(x, keys)
            some = label != np.arange(len(x))
            yield edges(cls[some], cls[label[some]])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = first = None
        for b in batches:
            key, cls = b.column("key").to_numpy(), b.column("cls").to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hub = np.where(head >= 0, cls[np.maximum(head, 0)], first if first is not None else 0)
            last_key, first = key[-1], hub[-1]
            got = np.unique(np.stack([cls, hub], axis=1)[cls != hub], axis=0)
            yield edges(np.ascontiguousarray(got[:, 0]), np.ascontiguousarray(got[:, 1]))

    out = rows.where(F.col("c") <= hot).select("x", "cls", "b").repartition(parts, "x").sortWithinPartitions("x", "cls").mapInArrow(forest, "u long, v long")
    if shared.where(F.col("c") > hot).limit(1).count():
        keys = rows.where(F.col("c") > hot).select("cls", "x", F.explode("b").alias("y")).select("cls", F.xxhash64("x", "y").alias("key"))
        out = out.union(keys.repartition(parts, "key").sortWithinPartitions("key", "cls").mapInArrow(stars, "u long, v long"))
    return contracted(out)


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v) with the same components: u keeps its least v, and this v takes u's other ones.

    A u has SIDE edges at most, SIDE * SIDE more if it was dealt out by whole keys. The v are few hubs, so edges
    from hub to hub repeat, and about one edge a class is left for the rounds to come.
    """
    near = edges.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("v"))
    least = F.col("v")[0]
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    both = F.transform("v", lambda x, i: F.when(i == 0, pair(F.col("u"), x)).otherwise(pair(least, x)))
    return near.select(F.explode(both).alias("e")).select("e.u", "e.v").distinct()


def components(edges: DataFrame, where: str) -> DataFrame:
    """node, root (the least node of its component) for each node of an edge.

    In each round every node joins its least neighbour (of two that chose each other the less stays), labels jump
    to their own label's until none moves, and the edges are contracted to the groups, named by their least nodes.
    A node with an edge is never alone in its group, so nodes halve at least and rounds are logarithmic in them.
    """
    both = staged(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), f"{where}/edges")
    rounds: list[DataFrame] = []
    while both.limit(1).count():
        n = len(rounds)
        if n > 64:  # beyond log2 of any count of nodes
            raise RuntimeError("components don't come to an end")
        to = staged(both.groupBy("u").agg(F.min("v").alias("l")), f"{where}/near{n}")
        over = lambda t: t.select(F.col("u").alias("l"), F.col("l").alias("j"))
        stays = (F.col("j") == F.col("u")) & (F.col("u") < F.col("l"))
        to = staged(to.join(over(to), "l").select("u", F.when(stays, F.col("u")).otherwise(F.col("l")).alias("l")), f"{where}/hooks{n}")
        jumps = 0
        while True:
            moved = staged(to.join(over(to), "l").select("u", F.col("j").alias("l"), (F.col("j") != F.col("l")).alias("moved")), f"{where}/jumps{n}_{jumps}")
            to, jumps = moved.select("u", "l"), jumps + 1
            if moved.where("moved").limit(1).count() == 0:
                break
        to = staged(to.join(to.groupBy("l").agg(F.min("u").alias("m")), "l").select("u", F.col("m").alias("l")), f"{where}/labels{n}")
        rounds.append(to)
        ends = both.join(to, "u").select("v", F.col("l").alias("a")).join(to.select(F.col("u").alias("v"), F.col("l").alias("b")), "v")
        both = staged(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{where}/edges{n}")
    # from the last round back: a group's label is its group's in the next round, if it had an edge there
    labels = None
    for n, to in reversed(list(enumerate(rounds))):
        labels = to if labels is None else staged(to.join(labels.select(F.col("u").alias("l"), F.col("l").alias("j")), "l", "left").select("u", F.coalesce("j", "l").alias("l")), f"{where}/roots{n}")
    labels = both.select("u", F.col("v").alias("l")) if labels is None else labels  # no edges
    return labels.select(F.col("u").alias("node"), F.col("l").alias("root"))


def linked(inter: np.ndarray, a: int, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """den * intersection >= num * union."""
    return den * inter >= num * (a + b - inter)


def search(sets: list[np.ndarray], num: int = 80, den: int = 100) -> np.ndarray:
    """Component number (its first member) of each set; every pair that could still join two is compared."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, ids = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(ids, kind="stable")
    post, at = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))]) if len(ids) else np.zeros(1, np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    label = np.full(n, -1, np.int64)
    left = n
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], left, queue = seed, left - 1, [seed]
        while queue and left:
            u = queue.pop()
            own = ids[first[u] : first[u + 1]]
            a, k = at[own], at[own + 1] - at[own]
            where = np.repeat(a - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
            inter = np.bincount(post[where], minlength=n)
            found = np.flatnonzero((label < 0) & (inter > 0) & linked(inter, int(size[u]), size, num, den))
            label[found] = seed
            left -= len(found)
            queue += found.tolist()
    return label


def exact_components(members_: DataFrame, where: str, k: int, num: int, den: int) -> DataFrame:
    """members_: root, cls, n, text of classes. cls, link (a class of its true component, the same for all of it)."""
    spark = members_.sparkSession
    sized = members_.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > LARGE).select("root")
    large = staged(sized, f"{where}/large")
    small = members_.join(large, "root", "left_anti")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        root, cls, texts = None, [], []

        def done() -> pa.RecordBatch:
            lab = search(shingle_sets(texts, k), num, den)
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([cls[x] for x in lab.tolist()], pa.int64())], ["cls", "link"])

        for b in batches:
            for r, c, t in zip(b.column("root").to_pylist(), b.column("cls").to_pylist(), arrow_texts(b.column("text")), strict=True):
                if r != root:
                    if cls:
                        yield done()
                    root, cls, texts = r, [], []
                cls.append(c)
                texts.append(t)
        if cls:
            yield done()

    out = small.repartition(shuffle_parts(spark), "root").sortWithinPartitions("root", "cls").mapInArrow(rows, "cls long, link long")
    if large.limit(1).count():
        out = out.unionByName(search_large(staged(members_.join(large, "root", "left_semi").select("root", "cls", "n", "text"), f"{where}/hot"), where, k, num, den))
    return out


def search_large(rows: DataFrame, where: str, k: int, num: int, den: int) -> DataFrame:
    """The same search over the cluster: each round compares a bounded set of classes with all that aren't reached yet."""
    spark = rows.sparkSession
    state = staged(rows.select("root", "cls", "n", F.lit(None).cast("long").alias("link"), F.lit(False).alias("done")), f"{where}/state0")
    n = 0
    while True:
        # per component: reached classes that haven't been compared; where there are none, the least one not reached
        open_ = state.where("link is not null and not done")
        seeds = state.where("link is null").join(open_.select("root").distinct(), "root", "left_anti").groupBy("root").agg(F.min("cls").alias("cls")).withColumn("link", F.col("cls"))
        waiting = state.where("link is null").select("root").distinct()
        hubs = open_.join(waiting, "root", "left_semi").select("root", "cls", "link").unionByName(seeds.select("root", "cls", "link")).limit(HUBS)
        hubs = hubs.join(rows.select("cls", "n", "text"), "cls").orderBy("n", "cls").collect()  # HUBS rows at most
        if not hubs:
            break
        total, chosen = 0, []
        for h in hubs:
            if chosen and total + h["n"] > HUB_SHINGLES:
                break
            chosen.append(h)
            total += h["n"]
        sent = spark.sparkContext.broadcast([(h["root"], h["link"], s) for h, s in zip(chosen, shingle_sets([h["text"].encode() for h in chosen], k), strict=True)])

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for root, cls, s in zip(b.column("root").to_pylist(), b.column("cls").to_pylist(), shingle_sets(arrow_texts(b.column("text")), k), strict=True):
                    for r, link, h in sent.value:
                        if r == root and linked(np.array([len(np.intersect1d(s, h, assume_unique=True))]), len(h), np.array([len(s)]), num, den)[0]:
                            out.append((cls, link))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["cls", "found"])

        free = state.where("link is null").select("cls")
        found = rows.join(free, "cls", "left_semi").select("root", "cls", "text").mapInArrow(compare, "cls long, found long")
        used = {h["cls"]: h["link"] for h in chosen}
        own = spark.createDataFrame(list(used.items()), "cls long, own long")
        n += 1
        state = staged(
            state.join(found, "cls", "left").join(F.broadcast(own), "cls", "left").select("root", "cls", "n", F.coalesce("link", "own", "found").alias("link"), (F.col("done") | F.col("own").isNotNull()).alias("done")),
            f"{where}/state{n}",
        )
        sent.unpersist()
    return state.select("cls", "link")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; sets are linked if den * intersection >= num * union."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    docs = docs.select(docs["doc_id"].cast("long"), "text")
    sig = staged(signatures(docs, k), f"{where}/sig")
    classes = sig.where("n > 0").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("doc"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = staged(classes, f"{where}/classes")
    roots = components(candidate_edges(classes, where), where)
    wanted = classes.select("cls", "doc", "n").join(roots, classes["cls"] == roots["node"]).select("root", "cls", "doc", "n")
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text").join(wanted, "doc")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of rows that share a doc_id, those whose set is the class's
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                same = [set_sum(s) == c for s, c in zip(shingle_sets(arrow_texts(part.column("text")), k), part.column("cls").to_pylist(), strict=True)]
                yield part.filter(pa.array(same, pa.bool_())).select(["root", "cls", "n", "text"])

    found = texts.mapInArrow(own, "root long, cls long, n long, text string").dropDuplicates(["cls"]) if has_repeats(docs) else texts.select("root", "cls", "n", "text")
    links = staged(exact_components(found, where, k, num, den), f"{where}/links")
    least = links.join(classes.select("cls", "doc"), "cls")
    least = least.join(least.groupBy("link").agg(F.min("doc").alias("least")), "link").select("cls", "least")
    every = classes.select("cls", "doc").join(least, "cls", "left").select("cls", F.coalesce("least", "doc").alias("least"))
    rows = sig.select("doc_id", "n", "cls").join(every, "cls", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("least", F.lit(NULL_ID)))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def has_repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def components_sql(source: str, k: int) -> str:
    """DuckDB CTEs up to comp(doc_id, n, component_id) over a relation with doc_id and text."""
    return rf"""
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - {k - 2})), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS c FROM (SELECT doc_id, list_sort(list(s)) AS h FROM s GROUP BY 1)),
rs AS (SELECT s.* FROM s JOIN cls USING (doc_id) WHERE doc_id = c),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM rs a JOIN rs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT DISTINCT c, c FROM cls UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(m.b, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id)
         LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) m ON m.a = cls.c)"""


SQL = {"op5_tensored_minhash": f"WITH RECURSIVE {components_sql('documents', 4)} SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM comp"}
QUERIES = {"op5_tensored_minhash": op5_tensored_minhash}
