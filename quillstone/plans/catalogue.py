"""Queries on catalogues: building them, their faults, states, needs and settings. Inputs are written in expressions that both engines take."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as C
from ..operators import corpus
from ..sources.tables import table
from .queries import query

LICENCES = [("^small", "by-sa"), ("(?i)PLATED", "public domain"), ("^medium|ring", "mixed")]
LICENCES_HERE = LICENCES + [("example", "by")]
_FILE = "CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN '(none)' WHEN p_partkey % 37 = 0 THEN 'links-' || p_name WHEN p_partkey % 7 = 0 THEN 'books/' || replace(p_name, ' ', '_') || '/' ELSE replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '.zim' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.gguf' ELSE '.txt' END END"
_URL = "CASE p_partkey % 9 WHEN 0 THEN 'https://huggingface.co/a/b' WHEN 1 THEN 'https://github.com/a/b/releases/tag/v1.2' WHEN 2 THEN 'https://example.org/get/' || replace(p_name, ' ', '_') || '.zim and more' WHEN 3 THEN 'https://x.org/resolve/f' WHEN 4 THEN 'ask them' WHEN 5 THEN 'https://example.org/other.pdf/' WHEN 6 THEN 'https://ndownloader.figshare.com/files/77' WHEN 7 THEN 'https://huggingface.co/a/b/' ELSE 'https://y.org/page' END"
MANIFEST = [
    "CASE p_partkey % 4 WHEN 0 THEN '02-core' WHEN 1 THEN '01-models' WHEN 2 THEN '08-more' ELSE '10-index' END AS category", f"{_FILE} AS filename", f"{_URL} AS source_url",
    "CASE WHEN p_partkey % 6 = 0 THEN lower(md5(p_name)) WHEN p_partkey % 6 = 1 THEN '' END AS sha256", "CASE WHEN p_partkey % 11 <> 0 THEN p_size * 1000 END AS bytes",
    "CASE p_partkey % 10 WHEN 0 THEN 'starter' WHEN 1 THEN 'PINNED COMMIT 0123456789abcdef0123456789abcdef01234567 of it' END AS notes",
    "CASE p_partkey % 8 WHEN 0 THEN 'GONE' WHEN 1 THEN 'UNPROVEN' ELSE 'VERIFIED' END AS status",
]
M_SQL = f"man AS (SELECT {', '.join(MANIFEST)} FROM part)"


def manifest(spark, d):
    return table(spark, d, "part").selectExpr(*MANIFEST)


KIND_SQL = lambda f, s: f"CASE WHEN lower({f}) LIKE '%.zim' THEN 'zim' WHEN lower({f}) LIKE '%.gguf' THEN 'gguf' WHEN lower({f}) LIKE '%.pmtiles' THEN 'pmtiles' WHEN lower({f}) LIKE '%.pdf' THEN 'pdf' WHEN {f} LIKE '%/' THEN CASE WHEN starts_with({s}, '01-models') THEN 'model-repo' ELSE 'folder' END WHEN lower({f}) LIKE '%.zip' OR lower({f}) LIKE '%.tar.gz' OR lower({f}) LIKE '%.exe' OR lower({f}) LIKE '%.msi' THEN 'software' ELSE 'file' END"
_U = "string_split(trim(source_url), ' ')[1]"
_BASE = "regexp_extract(filename, '([^/]*)/*$', 1)"
_BARE = f"regexp_replace({_U}, '/+$', '')"
_REV = "coalesce(nullif(regexp_extract(coalesce(notes, ''), 'PINNED COMMIT ([0-9a-f]{40})', 1), ''), 'main')"
_HUB, _GIT = "'^https://huggingface\\.co/([^/]+/[^/]+)/?$'", "'^https://github\\.com/([^/]+/[^/]+)/releases/tag/([^/\\s]+)'"
_EXT = f"lower(regexp_extract({_BASE}, '\\.([^.]*)$', 1))"
FETCH_SQL = f"""CASE WHEN NOT starts_with({_U}, 'http') THEN 'manual' WHEN regexp_matches({_U}, {_HUB}) THEN CASE WHEN filename LIKE '%/' THEN 'hf-repo' ELSE 'hf-file' END
WHEN regexp_matches({_U}, {_GIT}) AND filename NOT LIKE '%/' THEN 'github-asset' WHEN filename NOT LIKE '%/' AND (ends_with({_BARE}, {_BASE}) OR ({_EXT} <> '' AND ends_with(lower(regexp_extract({_BARE}, '([^/]*)$', 1)), '.' || {_EXT})) OR regexp_matches({_U}, '^https://ndownloader\\.figshare\\.com/files/\\d+$')) THEN 'direct'
WHEN contains({_U}, '/resolve/') THEN 'direct' ELSE 'manual' END"""
URL_SQL = f"""CASE "fetch" WHEN 'hf-repo' THEN 'https://huggingface.co/' || regexp_extract({_U}, {_HUB}, 1) WHEN 'hf-file' THEN 'https://huggingface.co/' || regexp_extract({_U}, {_HUB}, 1) || '/resolve/' || {_REV} || '/' || {_BASE}
WHEN 'github-asset' THEN 'https://github.com/' || regexp_extract({_U}, {_GIT}, 1) || '/releases/download/' || regexp_extract({_U}, {_GIT}, 2) || '/' || {_BASE} WHEN 'direct' THEN {_U} ELSE '' END"""
RULE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(coalesce({c}, ''), '{p}') THEN '{v}'" for c in ("filename", "source_url") for p, v in LICENCES_HERE) + " ELSE 'Unknown' END"
KEPT_SQL = "status IN ('VERIFIED', 'UNPROVEN') AND trim(coalesce(filename, '')) <> '' AND NOT starts_with(trim(filename), '(') AND NOT regexp_matches(trim(filename), '^(python-wheels|links-|requirements-|library\\.xml)') AND starts_with(trim(source_url), 'http')"
SLUG_SQL = lambda f: f"lower(trim(regexp_replace(regexp_replace(regexp_extract({f}, '([^/]*)/*$', 1), '\\.(zim|gguf|pmtiles|pdf|zip|tar\\.gz|exe|msi|txt|md|bin)$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '-'))"


@query("T22_source_rules", f"""WITH {M_SQL}, f AS (SELECT *, {FETCH_SQL} AS "fetch" FROM man) SELECT category, filename, {KIND_SQL('filename', 'category')} AS kind, "fetch", {URL_SQL} AS fetch_url, CASE WHEN "fetch" LIKE 'hf%' THEN {_REV} WHEN "fetch" = 'github-asset' THEN regexp_extract({_U}, {_GIT}, 2) ELSE '' END AS revision, {RULE_SQL} AS license FROM f""")
def source_rules(spark, d):
    c = F.col
    m = manifest(spark, d)
    return m.select("category", "filename", C.kind_of(c("filename"), c("category")).alias("kind"), C.fetch_of(c("source_url"), c("filename"), c("notes")).alias("f"), C.first_rule([c("filename"), c("source_url")], LICENCES_HERE, "Unknown").alias("license")).select("category", "filename", "kind", "f.*", "license")


@query("F8_kept_rows", f"WITH {M_SQL} SELECT category, count(*) AS n FROM man WHERE {KEPT_SQL} GROUP BY 1")
def kept_rows(spark, d):
    return manifest(spark, d).where(C.kept_rows()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("F6_is_corpus", f"WITH {M_SQL} SELECT category, count(*) AS n FROM man WHERE {KIND_SQL('filename', 'category')} IN ('zim', 'pdf', 'folder') AND category[1:2] IN ('02', '03', '04', '05', '06', '07', '08') GROUP BY 1")
def is_corpus(spark, d):
    rows = manifest(spark, d).select(F.col("category").alias("shelf"), C.kind_of(F.col("filename"), F.col("category")).alias("kind"))
    return rows.where(C.is_corpus()).groupBy(F.col("shelf").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("T18_slug", f"WITH {M_SQL} SELECT filename, regexp_replace(filename, '[^A-Za-z0-9._-]', '_', 'g') AS file_slug, {SLUG_SQL('filename')} AS row_slug FROM man")
def slugs(spark, d):
    return manifest(spark, d).select("filename", T.slug(F.col("filename")).alias("file_slug"), C.row_id(F.col("filename")).alias("row_slug"))


SUMS = ["'02-core' AS shelf", "replace(p_name, ' ', '_') || '.zim' AS path", "lower(md5(CASE WHEN p_partkey % 12 = 0 THEN p_name || '!' ELSE p_name END)) AS sha256"]
BUILD_SQL = f"""{M_SQL}, sums AS (SELECT shelf, path AS file, max(sha256) AS listed FROM (SELECT {', '.join(SUMS)} FROM part WHERE p_partkey % 5 = 0) GROUP BY 1, 2),
kept AS (SELECT category AS shelf, trim(filename) AS file, *, nullif(lower(sha256), '') AS own, {FETCH_SQL} AS "fetch", {RULE_SQL} AS license, {SLUG_SQL('trim(filename)')} AS base_id FROM man WHERE {KEPT_SQL}),
b AS (SELECT k.*, listed, count(*) OVER (PARTITION BY base_id) AS same FROM kept k LEFT JOIN sums s ON k.shelf = s.shelf AND k.file = s.file),
cat AS (SELECT *, CASE WHEN same > 1 THEN {SLUG_SQL('shelf')} || '-' || base_id ELSE base_id END AS id, {KIND_SQL('file', 'shelf')} AS kind, CASE WHEN contains(coalesce(notes, ''), 'starter') THEN 'starter' ELSE 'full' END AS profile FROM b)"""


def _built(spark, d):
    return C.build(manifest(spark, d), table(spark, d, "part").where("p_partkey % 5 = 0").selectExpr(*SUMS), LICENCES_HERE)


@query("M7_catalogue_build", f"""WITH {BUILD_SQL} SELECT id, shelf, file, kind, license, "fetch", coalesce(own, listed) AS sha256, bytes, profile FROM cat""")
def catalogue_build(spark, d):
    return _built(spark, d)[0].drop("fetch_url", "revision")


@query("M7_catalogue_gaps", f"""WITH {BUILD_SQL} SELECT id, unnest(list_filter([CASE WHEN own <> listed THEN 'sha256 differs from the checksum list' END, CASE WHEN coalesce(own, listed) IS NULL THEN 'no sha256' END, CASE WHEN bytes IS NULL THEN 'no size' END, CASE WHEN license = 'Unknown' THEN 'no license' END, CASE WHEN "fetch" = 'manual' THEN 'fetched by hand' END], lambda x: x IS NOT NULL)) AS gap FROM cat""")
def catalogue_gaps(spark, d):
    return _built(spark, d)[1]


@query("K9_catalogue_order", f"WITH {BUILD_SQL}, o AS (SELECT DISTINCT profile, shelf, file FROM cat) SELECT shelf, file, profile, row_number() OVER (ORDER BY profile <> 'starter', shelf, file)::INT AS place FROM o ORDER BY place LIMIT 50")
def catalogue_order(spark, d):
    first = _built(spark, d)[0].select("profile", "shelf", "file").distinct().orderBy(*C.catalogue_order()).limit(50)
    return first.groupBy().agg(F.array_sort(F.collect_list(F.struct((F.col("profile") != "starter").alias("late"), "shelf", "file", "profile"))).alias("r")).select(F.posexplode("r").alias("i", "r")).select("r.shelf", "r.file", "r.profile", (F.col("i") + 1).alias("place"))


TOPIC_ROWS = [
    "{id} AS id", "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'health|water' WHEN 2 THEN 'health|magic' ELSE 'power' END AS topics", "CASE p_partkey % 6 WHEN 0 THEN 'fr' WHEN 1 THEN 'es' ELSE 'en' END AS lang",
    "CASE p_partkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS suggest", "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS keywords_en", "CASE WHEN p_partkey % 7 = 0 THEN p_type END AS keywords_es", "CASE WHEN p_partkey % 13 <> 0 THEN p_type END AS blurb_en",
]
FAULT_SQL = f"""{M_SQL}, cr AS (SELECT DISTINCT {SLUG_SQL('filename')} AS id FROM man WHERE {KIND_SQL('filename', 'category')} IN ('zim', 'pdf', 'folder') AND category[1:2] IN ('02', '03', '04', '05', '06', '07', '08')),
tp AS (SELECT {', '.join(TOPIC_ROWS).format(id=SLUG_SQL(_FILE))} FROM part WHERE p_partkey % 3 <> 1)"""


@query("M6_topic_faults", f"""WITH {FAULT_SQL} SELECT id, 'no topics row' AS fault FROM (SELECT id FROM cr EXCEPT SELECT id FROM tp) UNION ALL SELECT id, 'no corpus row' FROM (SELECT id FROM tp EXCEPT SELECT id FROM cr) UNION ALL SELECT id, 'named twice' FROM tp GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT id, unnest(list_filter([CASE WHEN len(list_filter(string_split(topics, '|'), lambda t: t NOT IN ('', 'health', 'water', 'power'))) > 0 THEN 'unknown topic' END, CASE WHEN topics = '' THEN 'no topics' END, CASE WHEN lang NOT IN ('en', 'es', 'mul') THEN 'lang' END,
CASE WHEN suggest NOT IN ('yes', 'no') THEN 'suggest' END, CASE WHEN suggest = 'yes' AND keywords_en = '' AND coalesce(keywords_es, '') = '' THEN 'no keywords' END, CASE WHEN coalesce(blurb_en, '') = '' THEN 'no blurb' END], lambda x: x IS NOT NULL)) FROM tp""")
def topic_faults(spark, d):
    rows = manifest(spark, d).select(C.row_id(F.col("filename")).alias("id"), F.col("category").alias("shelf"), C.kind_of(F.col("filename"), F.col("category")).alias("kind"))
    topics = table(spark, d, "part").where("p_partkey % 3 <> 1").selectExpr(f"{_FILE} AS id", *TOPIC_ROWS[1:]).withColumn("id", C.row_id(F.col("id")))
    return C.topic_faults(rows, topics, ["health", "water", "power"])


@query("U6_symmetric_difference", f"WITH {FAULT_SQL} SELECT id, 'catalogue' AS only_in FROM (SELECT id FROM cr EXCEPT SELECT id FROM tp) UNION ALL SELECT id, 'topics' FROM (SELECT id FROM tp EXCEPT SELECT id FROM cr)")
def symmetric_difference(spark, d):
    f = topic_faults(spark, d).where(F.col("fault").isin("no topics row", "no corpus row"))
    return f.select("id", F.when(F.col("fault") == "no topics row", "catalogue").otherwise("topics").alias("only_in"))


ARTIFACTS, SHELVES = ["p_type AS shelf", "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand || '/' || p_name END AS file"], ["p_type || '/' || p_brand AS shelf", "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS file"]


@query("J8_local_rows", f"WITH a AS (SELECT DISTINCT CASE WHEN shelf = file THEN shelf ELSE shelf || '/' || file END AS path FROM (SELECT {', '.join(ARTIFACTS)} FROM part)), r AS (SELECT DISTINCT CASE WHEN file = '' THEN shelf ELSE shelf || '/' || file END AS root FROM (SELECT {', '.join(SHELVES)} FROM part WHERE p_size % 9 = 0)) SELECT path FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE root = path OR starts_with(path, root || '/') OR starts_with(root, path || '/'))")
def local_rows(spark, d):
    p = table(spark, d, "part")
    return C.local_rows(p.selectExpr(*ARTIFACTS), p.where("p_size % 9 = 0").selectExpr(*SHELVES))


STATES = ["p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' WHEN 2 THEN 'red' WHEN 3 THEN 'green' ELSE 'amber' END AS state", "CASE WHEN p_partkey % 7 = 0 THEN 'manual' ELSE 'direct' END AS how", "p_size * 1000 AS bytes", "p_brand AS title", "CASE WHEN p_partkey % 2 = 0 THEN 'not_served' ELSE 'gone' END AS cause"]


@query("A23_fetch_need", f"SELECT count(*) AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM (SELECT {', '.join(STATES)} FROM part) WHERE state IN ('missing', 'partial') AND how <> 'manual'")
def fetch_need(spark, d):
    return C.fetch_need(table(spark, d, "part").selectExpr(*STATES))


@query("K8_group_order", f"SELECT state, title, count(*) AS n, row_number() OVER (ORDER BY list_position(['red', 'green', 'amber', 'grey'], state), title)::INT AS place FROM (SELECT {', '.join(STATES)} FROM part) WHERE state IN ('red', 'green', 'amber', 'grey') GROUP BY 1, 2")
def group_order(spark, d):
    g = table(spark, d, "part").selectExpr(*STATES).where(F.col("state").isin(C.GROUPS)).groupBy("state", "title").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, C.GROUPS)), F.col("state"))
    # a row for each group and title, so few enough to be put in one list
    rows = g.groupBy().agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "title", "state", "n"))).alias("r"))
    return rows.select(F.posexplode("r").alias("i", "r")).select("r.state", "r.title", "r.n", (F.col("i") + 1).alias("place"))


@query("T34_actions", f"SELECT id, CASE WHEN state = 'amber' THEN 'command:tool down|command:tool index --add ' || id || '|command:tool up' WHEN state = 'red' AND cause = 'not_served' THEN 'command:tool library' WHEN state = 'red' AND how = 'manual' THEN 'url:|path:x/' || title || '|command:tool fetch --verify ' || id WHEN state = 'red' THEN 'command:tool fetch ' || id ELSE '' END AS todo FROM (SELECT {', '.join(STATES)} FROM part)")
def actions(spark, d):
    c = F.col
    a = C.actions(c("state"), c("cause"), c("how"), c("id").cast("string"), F.concat(F.lit("x/"), "title"), F.lit(None).cast("string"))
    return table(spark, d, "part").selectExpr(*STATES).select("id", F.array_join(F.transform(a, lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), "|").alias("todo"))


@query("A22_shelf_totals", "WITH o AS (SELECT p_type AS shelf, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM part WHERE p_type <> 'PROMO' GROUP BY 1), m AS (SELECT p_type AS shelf, count(*) AS n_files, sum(p_size + (p_type LIKE 'E%' AND p_partkey = 1)::INT)::BIGINT AS n_bytes FROM part WHERE p_type NOT LIKE 'S%' GROUP BY 1) SELECT coalesce(o.shelf, m.shelf) AS shelf, files, bytes, coalesce(files = n_files AND bytes = n_bytes, false) AS agrees FROM o FULL JOIN m ON o.shelf = m.shelf")
def shelf_totals(spark, d):
    p = table(spark, d, "part")
    files = p.where("p_type <> 'PROMO'").select(F.col("p_type").alias("shelf"), F.col("p_size").alias("bytes"))
    m = p.where("p_type not like 'S%'").groupBy(F.col("p_type").alias("shelf")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.expr("p_size + int(p_type like 'E%' and p_partkey = 1)")).cast("long").alias("n_bytes"))
    return C.shelf_totals(files, m)


SET = ["'k' || CAST(p_partkey % 40 AS STRING) AS name"]
DEFAULTS, FROM_FILE, FROM_ENV = [*SET, "CASE p_partkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'bool' ELSE 'text' END AS kind", "'0' AS value"], ["'k' || CAST(p_partkey AS STRING) AS name", "CASE p_partkey % 4 WHEN 0 THEN 'x' ELSE '1' END AS value"], ["'k' || CAST(p_partkey * 3 AS STRING) AS name", "CASE p_partkey % 5 WHEN 0 THEN 'maybe' ELSE 'yes' END AS value"]
SETTINGS_SQL = f"""d AS (SELECT {', '.join(DEFAULTS)} FROM part WHERE p_partkey <= 30), f AS (SELECT {', '.join(FROM_FILE)} FROM part WHERE p_partkey BETWEEN 5 AND 35), e AS (SELECT {', '.join(FROM_ENV)} FROM part WHERE p_partkey <= 14),
g AS (SELECT coalesce(e.name, f.name) AS name, coalesce(e.value, f.value) AS given, CASE WHEN e.name IS NOT NULL THEN 'environment' ELSE 'file' END AS origin FROM f FULL JOIN e ON f.name = e.name),
r AS (SELECT d.*, given, origin, CASE kind WHEN 'int' THEN try_cast(given AS BIGINT) IS NOT NULL WHEN 'bool' THEN lower(given) IN ('true', 'false', 'yes', 'no', '1', '0') ELSE true END AS good FROM d LEFT JOIN g USING (name))"""


def _settings(spark, d):
    p = table(spark, d, "part")
    return C.settings(p.where("p_partkey <= 30").selectExpr(*DEFAULTS), p.where("p_partkey between 5 and 35").selectExpr(*FROM_FILE), p.where("p_partkey <= 14").selectExpr(*FROM_ENV))


@query("S34_settings", f"WITH {SETTINGS_SQL} SELECT name, CASE WHEN given IS NOT NULL AND good THEN given ELSE value END AS value, CASE WHEN given IS NOT NULL AND good THEN origin ELSE 'default' END AS origin FROM r")
def settings(spark, d):
    return _settings(spark, d)[0]


@query("S34_setting_problems", f"WITH {SETTINGS_SQL} SELECT name, 'bad value' AS problem FROM r WHERE given IS NOT NULL AND NOT good UNION ALL SELECT name, 'unknown setting' FROM g WHERE name NOT IN (SELECT name FROM d)")
def setting_problems(spark, d):
    return _settings(spark, d)[1]


@query("M31_health", "SELECT p_partkey AS id, nullif(concat_ws('; ', CASE WHEN p_size % 2 = 0 THEN 'no vectors' END, CASE WHEN p_size % 3 = 0 THEN 'keyword index is stale' END, CASE WHEN p_size % 5 = 0 THEN 'no gazetteer' END), '') AS degraded FROM part")
def health(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.degraded([(s % 2 == 0, "no vectors"), (s % 3 == 0, "keyword index is stale"), (s % 5 == 0, "no gazetteer")]).alias("degraded"))


@query("M37_service_level", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'off' WHEN p_size % 5 = 0 THEN 'far' WHEN p_size % 3 > 0 AND p_size * 10 <= 60 THEN 'up' WHEN p_size % 3 > 0 AND p_size * 10 <= 300 THEN 'warn' ELSE 'down' END AS level FROM part")
def service_level(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.service_level(s % 7 != 0, s % 3 > 0, s * 10, s % 5 != 0).alias("level"))


@query("M24_profile", "SELECT c_custkey AS id, CASE WHEN h >= 0.95 * 64 * 1024 THEN 'large' WHEN h >= 0.95 * 24 * 1024 THEN 'medium' WHEN h >= 0.95 * 8 * 1024 THEN 'small' WHEN c_custkey * 53 % 9000 >= 5000 + 1024 THEN 'small' END AS profile FROM (SELECT c_custkey, c_custkey * 997 % 90000 * CASE WHEN c_custkey % 2 = 0 THEN 0.75 ELSE 1 END AS h FROM customer)")
def profile(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), C.profile_of(k * 997 % 90000, k * 53 % 9000, {"small": 8, "medium": 24, "large": 64}, {"small": 5000}, k % 2 == 0).alias("profile"))


@query("M28_scope_plan", "WITH s AS (SELECT DISTINCT p_partkey % 200 AS file FROM part), r AS (SELECT n_nationkey * 3 AS file, n_nationkey % 4 AS stamp, n_nationkey % 5 <> 0 AS done FROM nation), f AS (SELECT s_suppkey AS file, s_suppkey % 4 AS stamp FROM supplier WHERE s_suppkey % 3 < 2) SELECT s.file, CASE WHEN f.stamp IS NULL THEN 'MISSING' WHEN done IS NULL THEN 'build new' WHEN NOT done THEN 'build partial' WHEN r.stamp <> f.stamp THEN 'RE-INDEX' ELSE 'SKIP' END AS plan FROM s LEFT JOIN f ON s.file = f.file LEFT JOIN r ON s.file = r.file")
def scope_plan(spark, d):
    s = table(spark, d, "part").select((F.col("p_partkey") % 200).alias("file"))
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    r = table(spark, d, "nation").select((n * 3).cast("long").alias("file"), (n % 4).cast("long").alias("stamp"), (n % 5 != 0).alias("done"))
    return C.scope_plan(s, r, table(spark, d, "supplier").where("s_suppkey % 3 < 2").select(k.alias("file"), (k % 4).alias("stamp")))


@query("M34_set_state", "SELECT p_partkey AS id, CASE WHEN p_size % 11 = 0 THEN 'not_needed' WHEN p_size % 7 = 0 THEN 'absent' WHEN p_size % 5 = 0 THEN 'unreadable' WHEN coalesce(p_size % 3 = CASE WHEN p_size % 4 <> 0 THEN 1 END, false) AND p_size % 2 = 1 THEN 'ok' ELSE 'stale' END AS state FROM part")
def set_state(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.set_state(s % 11 != 0, s % 7 != 0, s % 5 != 0, [s % 3 == F.when(s % 4 != 0, 1), s % 2 == 1]).alias("state"))


@query("M35_line_ends", "WITH b AS (SELECT doc_id, text AS raw, replace(text, chr(10), '') AS plain FROM documents) SELECT doc_id, CASE WHEN raw = plain THEN 'same' WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'proven' ELSE 'unproven' END AS state FROM b")
def line_ends(spark, d):
    raw, plain = F.encode("text", "utf-8"), F.encode(F.replace("text", F.lit("\n"), F.lit("")), "utf-8")
    rows = table(spark, d, "documents").select("doc_id", T.blob_id(raw).alias("raw"), T.blob_id(plain).alias("plain"))
    k = F.col("doc_id")
    return rows.select("doc_id", C.line_ends(F.col("raw"), F.col("plain"), F.when(k % 3 == 0, F.col("plain")), F.when(k % 4 == 0, F.col("plain")).otherwise(F.col("raw"))).alias("state"))


@query("M39_contained", "SELECT p_partkey AS id, p_partkey % 4 IN (0, 3) OR (p_partkey % 4 = 2 AND p_size % 2 = 0) AS inside FROM part")
def contained(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    path = F.when(k % 4 == 0, F.concat(F.lit("lib/./a/"), "p_name")).when(k % 4 == 1, F.concat(F.lit("library/../lib2/"), "p_name")).when(k % 4 == 2, F.when(s % 2 == 0, "x/../lib\\a").otherwise("lib/../../lib/a")).otherwise("lib/a/../b")
    return table(spark, d, "part").select(k.alias("id"), C.contained(path, F.lit("lib")).alias("inside"))


@query("S23_fetch_outcome", "SELECT p_partkey AS id, CASE WHEN p_size % 13 = 0 THEN 'FAILED' WHEN p_size % 11 = 0 THEN 'CHANGED' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'CONFLICT' WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'CONFLICT' ELSE 'MISMATCH' END WHEN p_size % 2 = 0 THEN 'present' WHEN p_size % 3 = 0 THEN 'MISMATCH' ELSE 'fetched' END AS outcome FROM part")
def fetch_outcome(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.outcome(s % 2 == 0, F.lit(5), F.when(s % 3 == 0, 6).otherwise(5), F.lit("a"), F.when(s % 5 == 0, "b").when(s % 7 == 0, F.lit(None)).otherwise("a"), s % 11 == 0, s % 13 == 0).alias("outcome"))


@query("A9_status_summary", f"WITH r AS (SELECT id, CASE WHEN state IN ('missing', 'partial') THEN 'grey' ELSE state END AS state, bytes, unnest(string_split(title || '|' || how, '|')) AS topic FROM (SELECT {', '.join(STATES)} FROM part)) SELECT topic, count(*) FILTER (state = 'green') AS green, count(*) FILTER (state = 'amber') AS amber, count(*) FILTER (state = 'red') AS red, count(*) FILTER (state = 'grey') AS grey, coalesce(sum(bytes) FILTER (state <> 'grey'), 0)::BIGINT AS bytes, (['green', 'amber', 'red', 'grey'])[min(list_position(['green', 'amber', 'red', 'grey'], state))] AS best FROM r GROUP BY 1")
def status_summary(spark, d):
    r = table(spark, d, "part").selectExpr(*STATES).withColumn("state", F.when(F.col("state").isin("missing", "partial"), "grey").otherwise(F.col("state")))
    return corpus.summary(r.select(F.explode(F.array("title", "how")).alias("topic"), "state", "bytes")).withColumn("bytes", F.col("bytes").cast("long"))
