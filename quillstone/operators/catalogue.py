"""Rows of a catalogue: kinds, sources, quality rules, cover by artifacts, order, needs, and what can be done about a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import artifact_path, slug
from .corpus import covers

# Kinds and shelves of corpora, languages of topics, statuses that are kept, and files that are none of a catalogue.
KINDS, SHELVES, LANGS, KEPT = ["zim", "pdf", "folder"], ["02", "03", "04", "05", "06", "07", "08"], ["en", "es", "mul"], ["VERIFIED", "UNPROVEN"]
SKIPPED = r"^(python-wheels|links-|requirements-|library\.xml)"
SUFFIX = r"\.(zim|gguf|pmtiles|pdf|zip|tar\.gz|exe|msi|txt|md|bin)$"
#: Groups of a library page in their order.
GROUPS = ["red", "green", "amber", "grey"]


def first_rule(texts: list[Column], rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first pattern that the first text holds, else of the first that the next one does."""
    out = None
    for text in texts:
        for pattern, value in rules:
            hit = F.coalesce(text, F.lit("")).rlike(pattern)
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def kind_of(name: Column, shelf: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.endswith(".zim"), "zim").when(low.endswith(".gguf"), "gguf").when(low.endswith(".pmtiles"), "pmtiles").when(low.endswith(".pdf"), "pdf")
    return out.when(low.endswith("/"), F.when(shelf.startswith("01-models"), "model-repo").otherwise("folder")).when(low.rlike(r"\.(zip|tar\.gz|exe|msi)$"), "software").otherwise("file")


def fetch_of(url: Column, name: Column, notes: Column) -> Column:
    """struct<fetch, fetch_url, revision> from a row's address, file name and notes."""
    u = F.split(F.trim(F.coalesce(url, F.lit(""))), " ")[0]
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    folder = name.endswith("/")
    hub, git = r"^https://huggingface\.co/([^/]+/[^/]+)/?$", r"^https://github\.com/([^/]+/[^/]+)/releases/tag/([^/\s]+)"
    pinned = F.regexp_extract(F.coalesce(notes, F.lit("")), r"PINNED COMMIT ([0-9a-f]{40})", 1)
    rev = F.when(pinned != "", pinned).otherwise("main")
    repo, release, tag = F.regexp_extract(u, hub, 1), F.regexp_extract(u, git, 1), F.regexp_extract(u, git, 2)
    bare = F.regexp_replace(u, "/+$", "")
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    same = (ext != "") & F.lower(F.regexp_extract(bare, "([^/]*)$", 1)).endswith(F.concat(F.lit("."), ext)) & ~folder
    direct = (bare.endswith(base) & ~folder) | same | u.contains("/resolve/") | (u.rlike(r"^https://ndownloader\.figshare\.com/files/\d+$") & ~folder)
    of = lambda kind, address, revision: F.struct(F.lit(kind).alias("fetch"), address.alias("fetch_url"), revision.alias("revision"))
    none = F.lit("")
    return (
        F.when(~u.startswith("http"), of("manual", none, none))
        .when((repo != "") & folder, of("hf-repo", F.concat(F.lit("https://huggingface.co/"), repo), rev))
        .when(repo != "", of("hf-file", F.concat(F.lit("https://huggingface.co/"), repo, F.lit("/resolve/"), rev, F.lit("/"), base), rev))
        .when((release != "") & ~folder, of("github-asset", F.concat(F.lit("https://github.com/"), release, F.lit("/releases/download/"), tag, F.lit("/"), base), tag))
        .when(direct, of("direct", u, none))
        .otherwise(of("manual", none, none))
    )


def row_id(name: Column) -> Column:
    """The id of a file: its name without the suffix, in lower case."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), SUFFIX, "")
    return F.lower(F.regexp_replace(F.regexp_replace(slug(base, "-"), "-+", "-"), "^-+|-+$", ""))


def kept_rows() -> Column:
    """Of manifest rows (status, filename, source_url): those that belong to a catalogue."""
    f = F.trim(F.coalesce("filename", F.lit("")))
    return F.coalesce(F.col("status").isin(KEPT) & (f != "") & ~f.startswith("(") & ~f.rlike(SKIPPED) & F.trim("source_url").startswith("http"), F.lit(False))


def is_corpus() -> Column:
    return F.coalesce(F.col("kind").isin(KINDS) & F.substring("shelf", 1, 2).isin(SHELVES), F.lit(False))


def build(manifest: DataFrame, sums: DataFrame, licences: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Catalogue rows of a manifest (category, filename, source_url, sha256, bytes, notes, status), and what they lack.

    The hash is the manifest's, else that of the shelf's checksum list (shelf, path, sha256); where both differ the row is a gap. An id that
    several files would share gets their shelf before it. Rows are numbered: starters first, then by shelf and file.
    """
    m = manifest.where(kept_rows()).select(F.col("category").alias("shelf"), F.trim("filename").alias("file"), "source_url", F.nullif(F.lower("sha256"), F.lit("")).alias("own"), "bytes", "notes")
    s = sums.groupBy("shelf", F.col("path").alias("file")).agg(F.max("sha256").alias("listed"))
    rows = m.join(s, ["shelf", "file"], "left").withColumn("base_id", row_id(F.col("file")))
    rows = rows.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("base_id")))
    f = fetch_of(F.col("source_url"), F.col("file"), F.col("notes"))
    rows = rows.select(
        F.when(F.col("same") > 1, F.concat(row_id(F.col("shelf")), F.lit("-"), "base_id")).otherwise(F.col("base_id")).alias("id"), "shelf", "file", kind_of(F.col("file"), F.col("shelf")).alias("kind"),
        first_rule([F.col("file"), F.col("source_url")], licences, "Unknown").alias("license"), f.alias("f"), F.coalesce("own", "listed").alias("sha256"), "bytes", "own", "listed",
        F.when(F.coalesce(F.col("notes"), F.lit("")).contains("starter"), "starter").otherwise("full").alias("profile"),
    )
    lacks = F.filter(
        F.array(
            F.when(F.col("own").isNotNull() & F.col("listed").isNotNull() & (F.col("own") != F.col("listed")), "sha256 differs from the checksum list"),
            F.when(F.col("sha256").isNull(), "no sha256"), F.when(F.col("bytes").isNull(), "no size"), F.when(F.col("license") == "Unknown", "no license"), F.when(F.col("f.fetch") == "manual", "fetched by hand"),
        ),
        lambda x: x.isNotNull(),
    )
    catalogue = rows.select("id", "shelf", "file", "kind", "license", "f.*", "sha256", "bytes", "profile")
    return catalogue, rows.select("id", F.explode(lacks).alias("gap"))


def catalogue_order() -> list[Column]:
    """Starters first, then shelves and files."""
    return [F.col("profile") != "starter", F.col("shelf"), F.col("file")]


def topic_faults(catalogue: DataFrame, topics: DataFrame, known: list[str]) -> DataFrame:
    """id, fault: where topics (id, topics, lang, suggest, keywords_en, keywords_es, blurb_en) and the catalogue's corpora don't agree."""
    ids, named = catalogue.where(is_corpus()).select("id").distinct(), topics.select("id").distinct()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = F.array(
        F.when(F.exists(F.split(F.coalesce("topics", F.lit("")), r"\|"), lambda t: (t != "") & ~t.isin(known)), "unknown topic"), F.when(blank("topics"), "no topics"),
        F.when(~F.coalesce(F.col("lang").isin(LANGS), F.lit(False)), "lang"), F.when(~F.coalesce(F.col("suggest").isin("yes", "no"), F.lit(False)), "suggest"),
        F.when((F.col("suggest") == "yes") & blank("keywords_en") & blank("keywords_es"), "no keywords"), F.when(blank("blurb_en"), "no blurb"),
    )
    own = topics.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("fault"))
    twice = topics.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("named twice").alias("fault"))
    return ids.subtract(named).withColumn("fault", F.lit("no topics row")).unionByName(named.subtract(ids).withColumn("fault", F.lit("no corpus row"))).unionByName(twice).unionByName(own.distinct())


def local_rows(artifacts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """path of artifacts (shelf, file) that no row (shelf, file) covers, is covered by, or equals."""
    a = artifacts.select(artifact_path(F.col("shelf"), F.col("file")).alias("path")).distinct()
    roots = catalogue.select(artifact_path(F.col("shelf"), F.col("file")).alias("root")).distinct()
    return a.join(covers(a.withColumn("own", F.col("path")), roots).select(F.col("own").alias("path")).distinct(), "path", "left_anti")


def actions(state: Column, cause: Column, fetch: Column, id_: Column, path: Column, page: Column, tool: str = "tool") -> Column:
    """What an operator can do about a row: array<struct<label, kind, value>>."""
    do = lambda label, kind, value: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), value.alias("value"))
    run = lambda what, *rest: F.concat(F.lit(f"{tool} {what}"), *rest)
    by_hand = F.array(do("get it from the publisher", "url", F.coalesce(page, F.lit(""))), do("place it at", "path", path), do("then check it", "command", run("fetch --verify ", id_)))
    get = F.when(fetch == "manual", by_hand).otherwise(F.array(do("download it", "command", run("fetch ", id_))))
    index = F.array(do("stop the node", "command", run("down")), do("index it", "command", run("index --add ", id_)), do("start the node again", "command", run("up")))
    serve = F.array(do("rebuild the library", "command", run("library")))
    return F.when(state == "grey", get).when(state == "amber", index).when((state == "red") & (cause == "not_served"), serve).when(state == "red", get).otherwise(F.slice(get, 1, 0))


def fetch_need(rows: DataFrame) -> DataFrame:
    """Files and bytes that are missing or partial and aren't fetched by hand (state, how, bytes)."""
    return rows.where(F.col("state").isin("missing", "partial") & (F.col("how") != "manual")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def shelf_totals(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """shelf, files, bytes, and whether the manifest (shelf, n_files, n_bytes) says so; a shelf of one side alone doesn't agree."""
    own = files.groupBy("shelf").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    return own.join(manifest, "shelf", "full").select("shelf", "files", "bytes", F.coalesce((F.col("files") == F.col("n_files")) & (F.col("bytes") == F.col("n_bytes")), F.lit(False)).alias("agrees"))


def settings(defaults: DataFrame, file: DataFrame, environment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, value, origin of each setting (name, kind, value): environment before file before default; and what is wrong.

    A value that isn't of its kind (int, bool, text) gives way to the default, and a name without a default is refused.
    """
    given = environment.withColumn("origin", F.lit("environment")).unionByName(file.withColumn("origin", F.lit("file"))).withColumn("nth", F.when(F.col("origin") == "environment", 0).otherwise(1))
    first = given.groupBy("name").agg(F.min_by(F.struct("value", "origin"), "nth").alias("g"))
    rows = defaults.join(first, "name", "left")
    good = F.when(F.col("kind") == "int", F.col("g.value").try_cast("long").isNotNull()).when(F.col("kind") == "bool", F.lower("g.value").isin("true", "false", "yes", "no", "1", "0")).otherwise(F.lit(True))
    use = F.col("g.value").isNotNull() & good
    values = rows.select("name", F.when(use, F.col("g.value")).otherwise(F.col("value")).alias("value"), F.when(use, F.col("g.origin")).otherwise("default").alias("origin"))
    bad = rows.where(F.col("g.value").isNotNull() & ~good).select("name", F.lit("bad value").alias("problem"))
    return values, bad.unionByName(given.select("name").distinct().join(defaults.select("name"), "name", "left_anti").withColumn("problem", F.lit("unknown setting")))


def degraded(parts: list[tuple[Column, str]]) -> Column:
    """Messages of the conditions that hold, in their order, parted by semicolons; null without any."""
    said = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in parts)), lambda m: m.isNotNull())
    return F.when(F.size(said) > 0, F.array_join(said, "; "))


def service_level(on: Column, up: Column, age: Column, local: Column) -> Column:
    """off, far, up (answered within a minute), warn (within five) or down."""
    return F.when(~on, "off").when(~local, "far").when(up & (age <= 60), "up").when(up & (age <= 300), "warn").otherwise("down")


def contained(path: Column, base: Column) -> Column:
    """Whether a path, once its dots are resolved, lies below a folder."""
    steps = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    walk = F.aggregate(steps, F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")), lambda a, s: F.when(s == "..", F.struct(F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(a["p"], F.array(s)).alias("p"), a["ok"].alias("ok"))))
    full = F.array_join(walk["p"], "/")
    return walk["ok"] & ((full == base) | full.startswith(F.concat(base, F.lit("/"))))


def profile_of(total_mib: Column, free_mib: Column, sizes: dict[str, int], needs: dict[str, int], unified: Column) -> Column:
    """The largest profile (GiB of memory) that the machine has 95 % of (of three quarters, where memory is shared); else the smallest if its need and a GiB are free."""
    have = F.when(unified, total_mib * 0.75).otherwise(total_mib.cast("double"))
    out = None
    for name, gib in sorted(sizes.items(), key=lambda x: -x[1]):
        fits = have >= 0.95 * gib * 1024
        out = F.when(fits, name) if out is None else out.when(fits, name)
    least = min(sizes, key=sizes.get)
    return out.when(free_mib >= needs[least] + 1024, least)


def scope_plan(scope: DataFrame, registry: DataFrame, files: DataFrame) -> DataFrame:
    """file and what a build would do about it: MISSING, SKIP, RE-INDEX (it has changed), or build (new or partial)."""
    rows = scope.select("file").distinct().join(files.select("file", "stamp"), "file", "left").join(registry.select("file", F.col("stamp").alias("built"), "done"), "file", "left")
    return rows.select("file", F.when(F.col("stamp").isNull(), "MISSING").when(F.col("done").isNull(), "build new").when(~F.col("done"), "build partial").when(F.col("built") != F.col("stamp"), "RE-INDEX").otherwise("SKIP").alias("plan"))


def set_state(needed: Column, there: Column, readable: Column, same: list[Column]) -> Column:
    """Validity of a stamped set: not_needed, absent, unreadable, stale or ok; anything unknown is stale."""
    fresh = F.lit(True)
    for s in same:
        fresh = fresh & F.coalesce(s, F.lit(False))
    return F.when(~needed, "not_needed").when(~there, "absent").when(~readable, "unreadable").when(fresh, "ok").otherwise("stale")


def line_ends(raw: Column, plain: Column, pinned: Column, newest: Column) -> Column:
    """What rewriting a file's line ends would do: same (it has none to rewrite), proven (the plain bytes are the pinned or newest ones), else unproven."""
    return F.when(raw == plain, "same").when(F.coalesce(plain == pinned, F.lit(False)) | F.coalesce(plain == newest, F.lit(False)), "proven").otherwise("unproven")


def outcome(there: Column, want_size: Column, have_size: Column, want_hash: Column, have_hash: Column, changed: Column, failed: Column) -> Column:
    """State of a fetched file: FAILED, CHANGED (the source has another size), CONFLICT (what was there differs), MISMATCH (of hashes), present or fetched."""
    wrong = F.coalesce(want_size != have_size, F.lit(False))
    return (
        F.when(failed, "FAILED").when(changed, "CHANGED").when(there & wrong, "CONFLICT").when(F.coalesce(want_hash != have_hash, F.lit(False)), F.when(there, "CONFLICT").otherwise("MISMATCH"))
        .when(there, "present").when(wrong, "MISMATCH").otherwise("fetched")
    )


def run_steps(steps: DataFrame) -> DataFrame:
    """run, nth, state of the steps of runs (run, nth, due, ok): done, failed, up to date, or not run, which all are behind a failure."""
    w = Window.partitionBy("run").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("due") & ~F.col("ok")).over(w), F.lit(False))
    return steps.select("run", "nth", F.when(stopped, "not run").when(~F.col("due"), "up to date").when(F.col("ok"), "done").otherwise("failed").alias("state"))


def substitution(want: Column, newest: Column) -> tuple[Column, Column]:
    """What became of an edition that a row asks for, and the newer one that was taken in its place."""
    state = F.when(newest.isNull(), "gone").when(newest == want, "same").when(newest > want, "substituted").otherwise("older")
    return state, F.when(newest > want, newest)


def affordable(need: Column, free: Column, total: Column) -> Column:
    """Whether a model fits into memory: fits, fits once others go (evict), or is too large."""
    return F.when(need <= free, "fits").when(need <= total, "evict").otherwise("too large")


def sum_update(lines: DataFrame) -> DataFrame:
    """shelf, path, plan, total: a line of a checksum list is rewritten if it is the only one of its path; the list's total stays with it."""
    n = lines.groupBy("shelf", "path").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("shelf").agg(F.sum("n").alias("lines"))
    one = F.col("n") == 1
    return n.join(total, "shelf").select("shelf", "path", F.when(one, "rewrite").otherwise("refuse").alias("plan"), F.when(one, F.col("lines")).alias("total"))
