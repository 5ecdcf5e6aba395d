"""Text expressions on columns."""

from __future__ import annotations

import unicodedata
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query drops; membership changes results.
STOP = """
a an and are as at be been but by can could do does did for from get got had has
have how i if in into is it its me my no not of on or our so that the their them
then there these they this to us was we were what when where which who why will
with would you your
someone something anyone anything everyone everything nothing should must might
shall being doing done very more most some any each other such only same too just
also still even about after before
al como con de del donde el ella en es esta este hacer hay la las le lo los mas me
mi mucho muy no o para por que se si sin su sus tan te un una uno unos y ya
alguien algo alguno cual cuando donde quien todo todos poco mucha muchos
""".split()
# Languages of translated pages that are left out.
TRANSLATIONS = ["ar", "de", "fr", "hi", "id", "it", "ja", "ko", "pl", "pt", "ru", "tr", "vi", "zh"]

# Letters up to U+024F with one letter below their accents: ACCENTED becomes PLAIN, place by place.
_PAIRS = [(chr(c), b) for c in range(0xC0, 0x250) if len(b := "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))) == 1 and chr(c) == chr(c).lower() and b != chr(c)]
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def folded(text: Column) -> Column:
    """Lower case, Latin accents off, anything but a-z and 0-9 to single spaces. Ligatures and combining marks are not taken apart."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


# Words that vote for a language and carry no content in a question.
VOTES_EN = """
a an the of to in on for with and or is are was were be been how what why when where which who whom do does did can could should would will i my me we
our you your it its this that these those from by at as about into than then there their they them if not no yes so get got have has had any some much
many very please tell explain
""".split()
VOTES_ES = """
el la los las un una unos unas de del al a en con por para y o u e es son fue era ser estar esta estan como que porque cuando donde cual cuales quien
quienes hacer hago hace puedo puede pueden se mi mis me yo tu tus su sus lo le les este esto ese esa eso nos hay muy mas menos sin sobre entre debo debe
dime explica
""".split()
ONLY_EN, ONLY_ES = [w for w in VOTES_EN if w not in VOTES_ES], [w for w in VOTES_ES if w not in VOTES_EN]


def lang_votes(text: Column) -> Column:
    """es if more words are Spanish alone than English alone, else en."""
    t = F.split(folded(text), " ")
    n = lambda words: F.size(F.filter(t, lambda w: w.isin(words)))
    return F.when(n(ONLY_ES) > n(ONLY_EN), "es").otherwise("en")


def content(words_: Column) -> Column:
    """Words without those that vote for a language."""
    return F.filter(words_, lambda w: ~w.isin(*VOTES_EN, *VOTES_ES) & (w != ""))


def percent_path(path: Column) -> Column:
    """Percent-encoded, with slashes kept; letters, digits and _.-~ stay."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def one_decimal(x: Column) -> Column:
    """A double as C's %.1f writes it: its exact binary value is rounded, ties go to the even digit. Java's rounds the shortest decimal half up."""
    a = F.abs(x)
    whole = F.floor(a)
    part = a - whole
    # only 0.25 and 0.75 are ties; else a double that equals a bound's nearest double lies on the side that the exact bound leaves it on
    ups = []
    for k in range(10):
        bound = (2 * k + 1) / 20
        up = k % 2 == 1 if k in (2, 7) else Fraction(bound) > Fraction(2 * k + 1, 20)
        ups.append(((part >= bound) if up else (part > bound)).cast("long"))
    tenths = sum(ups[1:], ups[0])
    exact = F.concat(F.when(F.signum(x) < 0, "-").otherwise(""), (whole + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(a < float(2**53), exact).when(a.isNotNull(), F.format_string("%.1f", x))


def human_size(n: Column, base: int = 1024) -> Column:
    """A number of bytes with one decimal in the largest unit below it, up to TB."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        one = F.concat(one_decimal(n.cast("double") / float(base**k)), F.lit(f" {unit}"))
        out = one if unit == "TB" else F.when(n < float(base ** (k + 1)), one).otherwise(out)
    return out


def blob_id(data: Column) -> Column:
    """The id that git gives a file's bytes."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "utf-8")
    return F.sha1(F.concat(head, F.lit(b"\0"), data))


def artifact_path(shelf: Column, file: Column) -> Column:
    """Place below the root: forward slashes, none at the ends; a folder that is its own shelf stands once."""
    plain = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), F.lit("/"))
    s, f = plain(shelf), plain(file)
    return F.when((f == "") | (F.substring_index(s, "/", -1) == f), s).otherwise(F.concat(s, F.lit("/"), f))


def row_title(library: Column, blurb: Column, id_: Column) -> Column:
    """The library's title, else what stands before a colon in the blurb, else the id."""
    return F.coalesce(F.nullif(library, F.lit("")), F.nullif(F.substring_index(blurb, ": ", 1), F.lit("")), id_)


def split_reasoning(text: Column) -> tuple[Column, Column]:
    """What stands before the first kind of closing mark that occurs (null without one), and the rest."""
    before, after = F.lit(None).cast("string"), text
    for mark in reversed(["</think>", "</thinking>", "<|end_of_thought|>"]):
        has = text.contains(mark)
        before = F.when(has, F.trim(F.substring_index(text, mark, 1))).otherwise(before)
        after = F.when(has, F.trim(F.substring(text, F.locate(mark, text) + len(mark), F.length(text)))).otherwise(after)
    return before, after


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def content_words(q: Column, most: int = 24) -> Column:
    """The first words of two or more letters that aren't function words; if there are none, all such words."""
    raw = F.filter(F.split(F.lower(q), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)
    own = F.filter(raw, lambda w: ~w.isin(STOP))
    return F.slice(F.when(F.size(own) > 0, own).otherwise(raw), 1, most)


def query_terms(q: Column, most: int = 24) -> Column:
    """The words as quoted alternatives, null without any."""
    words = content_words(q, most)
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda x: x != "")


def prose_score(text: Column) -> Column:
    """Sentence ends a hundred words; 99 for less than 20 words."""
    n = F.size(words(text))
    return F.when(n < 20, F.lit(99.0)).otherwise(F.round(100.0 * F.regexp_count(text, F.lit("[.!?]")) / n, 6))


def excluded_reason(file: Column, path: Column, mirrored: Column, on: bool = True) -> Column:
    """user_profile, translation, mirror or null; nothing is excluded with filters off."""
    last = F.element_at(F.split(path, "/"), -1)
    rule = (
        F.when(file.startswith("ifixit_") & (path.startswith("User/") | path.contains("/User/")), "user_profile")
        .when(file.startswith("wikem_") & path.contains("/") & last.isin(TRANSLATIONS), "translation")
        .when(file.startswith("mdwiki_") & mirrored, "mirror")
    )
    return rule if on else F.lit(None).cast("string")


def is_navigation(title: Column, path: Column, text: Column) -> Column:
    w = F.transform(words(text), F.lower)
    return F.coalesce(
        F.lower(title).rlike(r"^(category|categoría|tag|tags|index|contents|table of contents|all pages)([^\p{L}\p{N}_]|$)")
        | path.startswith("Category:") | path.startswith("Tag/") | path.startswith("Special:")
        | ((F.size(w) > 40) & (F.size(F.array_distinct(w)) / F.size(w) < 0.35)),
        F.lit(False),
    )


def lang_of_name(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("_es_") | n.contains(".es."), "es").otherwise("en")


def slug(text: Column, fill: str = "_") -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", fill)


def dehyphenated(text: Column) -> Column:
    """Soft hyphens between letters go with the white space after them, all others go alone."""
    return F.replace(F.regexp_replace(text, "(?<=\\p{L})\u00ad\\s*(?=\\p{L})", ""), F.lit("\u00ad"), F.lit(""))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k words; empty with fewer."""
    # the words are bound by a lambda, else they were split anew for each run
    runs = lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - k + 1), lambda x, i: F.array_join(F.slice(w, i + 1, k), " ")))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(words(text)), runs), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; longitudes wrap at the antimeridian."""
    dlon = F.radians(F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# -- answers

CITE, UNSOURCED, ABSENT = r"\[(\d{1,2})\]", "UNSOURCED - NOT FROM THE ARCHIVE", "NOT IN ARCHIVE"


def ascii_upper(text: Column) -> Column:
    """Upper case of ASCII letters alone, so that places stay the same (a full upper case can be longer)."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def split_unsourced(text: Column) -> tuple[Column, Column]:
    """The part that must be grounded, and what follows the mark (null without one)."""
    at = F.locate(UNSOURCED, ascii_upper(text))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(UNSOURCED), F.length(text)))


def citations(text: Column, n: Column) -> tuple[Column, Column]:
    """Passages cited in order of first appearance, and numbers that name none."""
    all_ = F.transform(F.regexp_extract_all(text, F.lit(CITE), 1), lambda x: x.cast("int"))
    ok = lambda x: (x >= 1) & (x <= n)
    return F.array_distinct(F.filter(all_, ok)), F.filter(all_, lambda x: ~ok(x))


def grounding(text: Column, n: Column) -> Column:
    head, rest = split_unsourced(F.trim(F.coalesce(text, F.lit(""))))
    used, _ = citations(head, n)
    absent, cited = F.substring(ascii_upper(head), 1, 200).contains(ABSENT), F.size(used) > 0
    return F.when(rest.isNotNull(), F.when(absent, "unsourced").when(cited, "grounded_plus").otherwise("model_only")).when(absent, "uncovered").when(cited, "grounded").otherwise("model_only")


def output_budget(chars: Column) -> Column:
    """Tokens left for an answer after a prompt of so many characters, 2048 to 3072."""
    return F.greatest(F.lit(2048), F.least(F.lit(3072), 8192 - (F.floor(chars / 3.3).cast("int") + 64) - 256))
